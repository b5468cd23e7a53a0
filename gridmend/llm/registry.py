"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontamination, language_id, line_dedup, ngram_join, prefix_trie, quality_classifier, quality_rules, span_dedup, sql, token_counts, token_files, warc
from .common import shared_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify_languages(docs.drop("lang"), language_id.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that stays; SQL has no such cut into sentences, tests hold it against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.span_dedup(docs).select("doc_id", "text", "n_chars", "n_sentences", "n_removed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    files = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs).select("doc_id", "class_id", "n_links", "n_copies")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    both = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), byte_bpe.pack_ids("ids").alias("packed"), byte_bpe.decoded_bytes(F.col("ids"), ranks).alias("decoded"))
    return both.select("doc_id", "n_tokens", byte_bpe.sha256(F.col("packed")).alias("ids_sha256"), byte_bpe.sha256(F.col("decoded")).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document has."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.classify_quality(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.share_first_turns(convs))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.QUERIES)
