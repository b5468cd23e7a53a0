"""A training corpus from raw documents: each stage calls one operator and passes on what it keeps.

Null or clashing columns, empty tables, ties and repeated rows have the results that the operators' modules define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.llm import byte_bpe, decontamination, ngram_join, quality_rules, span_dedup
from gridmend.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).filter("kept").select(*COLUMNS)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts."""
    return ngram_join.one_per_class(docs).select(*COLUMNS)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document of nothing else goes."""
    left = span_dedup.span_dedup(docs)
    return left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_sentences"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks)
    both = encoded.withColumn("decoded", byte_bpe.decoded_bytes(F.col("ids"), ranks))
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("decodes"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_a_kind),
    ("substring dedup", cut_repeated_spans),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: Sketches, hash bands and token merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each stage but the last is written and read again, as the next one reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
