"""Every query and pipeline stage over tables with nulls, empty and very long texts, repeated rows, clashing columns; and over empty ones."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridmend.llm import language_id, quality_classifier, registry, token_files
from gridmend.llm.common import shared_path

CLASHES = ["ids", "kept", "key", "statistics", "class_id", "n_removed", "score", "_doc", "at", "max_marks", "text_", "band", "start", "valid", "_text", "_class", "found"]


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """A folder of documents, pages, labels and benchmark."""
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = docs.orderBy("doc_id").limit(120).union(docs.orderBy("doc_id").limit(5))
    long = "word " * 40_000 + "x" * 50_000 + " é" * 5000
    more = [(None, None, None, None, None), (None, "no id here", "en", "s", 1), (900, None, "en", None, 1), (901, "", None, "s", 0), (902, " \n\t ", "en", "s", 4), (903, long, "en", "s", 1), (904, "!?#$" * 500, "en", "s", 1), (905, "<|endoftext|> in a text", "en", "s", 1), (906, "́\U0001f600\x00 z", "xx", "s", 1), (907, "tie", "en", "s", 1), (907, "eit", "en", "s", 1), (907, "tie", "en", "s", 1)]
    both = some.union(spark.createDataFrame(more, docs.schema))
    both.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3, "doc_id").write.parquet(f"{folder}/documents.parquet")
    pages = spark.createDataFrame([(1, "u", "a"), (2, None, "a"), (None, "u", None), (3, "u", ""), (4, "v", long), (4, "v", long), (5, "é", "ü")], "page_id long, url string, html string")
    pages.select("*", *[F.lit("clash").alias(c) for c in ("sha1", "response", "revisit", "path", "n")]).write.parquet(f"{folder}/pages.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.union(spark.createDataFrame([(None, 1, 0), (900, None, None), (901, 7, 0)], labels.schema)).select("*", F.lit("clash").alias("statistics")).write.parquet(f"{folder}/labels.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    items.union(spark.createDataFrame([(None, None), (77, ""), (78, "!!")], items.schema)).select("*", F.lit("clash").alias("df")).write.parquet(f"{folder}/benchmark.parquet")
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    talk = [(None, 1, "user", "no id"), (700, None, "user", "first"), (700, None, "user", "first"), (700, 3, None, None), (700, 2, "", ""), (701, 0, "user", long), (701, 0, "user", long), (702, 5, "é", "\x00")]
    turns.union(spark.createDataFrame(talk, turns.schema)).select("*", *[F.lit("clash").alias(c) for c in ("ids", "at", "hi", "own", "depth")]).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for name in ("documents", "pages", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_trie_and_phrases(spark, odd, empty):
    """Not a row for each row of their tables; brute force has the rest (test_new_operators)."""
    nodes = registry.queries()["op12_prefix_trie"](spark, odd).collect()
    root = [n for n in nodes if n["depth"] == 0]
    own = spark.read.parquet(f"{odd}/conversations.parquet").filter("conv_id is not null")
    assert len(root) == 1 and root[0]["n_convs"] == own.select("conv_id").distinct().count() and root[0]["parent_conv_id"] is None
    assert sum(n["n_children"] for n in nodes) == len(nodes) - 1 and sum(n["n_children"] == 0 for n in nodes) == root[0]["n_leaves"]
    phrases = registry.queries()["op13_collocations"](spark, odd).collect()
    assert phrases and all(p["a"] >= 10 and p["a"] <= min(p["l"], p["r"]) for p in phrases) and {p["lang"] for p in phrases} >= {"en"}
    for name in ("op12_prefix_trie", "op13_collocations"):
        assert registry.queries()[name](spark, empty).count() == 0


OTHER_ROWS = ("op12_prefix_trie", "op13_collocations")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(OTHER_ROWS)))
def test_a_row_for_each_row(spark, odd, empty, name):
    table = "pages" if "warc" in name else "documents"
    there = spark.read.parquet(f"{odd}/{table}.parquet").count()
    got = registry.queries()[name](spark, odd)
    key = "page_id" if "warc" in name else "doc_id"
    rows = got.collect()
    assert key in got.columns and got.schema[key].dataType.simpleString() == "bigint"
    if "decontamination" not in name:
        assert len(rows) == there
        whole = sorted(r[0] if r[0] is not None else -1 for r in spark.read.parquet(f"{odd}/{table}.parquet").select(key).collect())
        assert sorted(r[key] if r[key] is not None else -1 for r in rows) == whole
    assert registry.queries()[name](spark, empty).count() == 0


def test_stages_of_the_pipeline(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, folder)
            assert made.columns == corpus_pipeline.COLUMNS
            made.write.parquet(path := shared_path(spark, "stage"))
            docs = spark.read.parquet(path)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert all(r["decodes"] for r in last) and len(last) == docs.count()
        assert (len(last) > 20) == (folder == odd)
    # each stage on rows that the ones before it would have kept from it
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, odd).count() > 50, name


def texts_of(spark, odd):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()]


def test_digests_of_op8(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts_of(spark, odd):
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in registry.op8_byte_bpe(spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_columns_of_op3_and_op4(spark, odd):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = texts_of(spark, odd)
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    want = sorted((str(i), len(t.encode()), len(x), len(x) > 1024) for (i, t), x in zip(rows, ids))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in registry.op3_token_counts(spark, odd).collect()) == want
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0], hashlib.md5(rows[k][1].encode()).digest()))
    start, whole = 0, []
    for k in order:
        own = np.array([*ids[k], 2], "<u4")
        whole.append((rows[k][0], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    got = [tuple(r) for r in registry.op4_token_files(spark, odd).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == whole


def test_token_files_have_the_stated_form(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/t", partitions=4)
    for f in tmp_path.glob("t/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {(c := meta.row_group(g).column(k)).path_in_schema: c for k in range(meta.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_column_index and c.has_offset_index for c in columns.values() if not c.path_in_schema.startswith("ids")) and ids.has_offset_index
            assert ids.compression == "ZSTD" and meta.row_group(g).total_byte_size < 2 * token_files.ROW_GROUP


def test_texts_of_one_id_keep_their_order_over_files(spark):
    rows = [(7, f"text number {k}") for k in range(200)]
    path = shared_path(spark, "one-id")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), P.path("byte_bpe_50k.json"), path, partitions=6)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in sorted(rows, key=lambda r: hashlib.md5(r[1].encode()).digest())]
    assert [r["ids"] for r in token_files.read_tokens(spark, path).orderBy("start").collect()] == want


def test_ftrl_is_the_plain_algorithm():
    """Follow-the-regularised-leader, one coordinate at a time."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(60)]
    z, n = np.zeros((40, 3)), np.zeros((40, 3))
    A, B, L1, L2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2

    def w(i, c):
        return 0.0 if abs(z[i, c]) <= L1 else (np.sign(z[i, c]) * L1 - z[i, c]) / ((B + np.sqrt(n[i, c])) / A + L2)

    for _ in range(2):
        for label, at, x in rows:
            logits = np.array([sum(v * w(i, c) for i, v in zip(at, x)) for c in range(3)])
            p = np.exp(logits - logits.max())
            p /= p.sum()
            old = {(i, c): w(i, c) for i in at for c in range(3)}
            for i, v in zip(at, x):
                for c in range(3):
                    g = v * (p[c] - (c == label))
                    sigma = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / A
                    z[i, c] += g - sigma * old[i, c]
                    n[i, c] += g * g
    want = np.array([[w(i, c) for i in range(40)] for c in range(3)])
    assert np.allclose(language_id.train_ftrl(rows, 3, 2)[:, :40], want, atol=1e-6)


def test_discriminant_is_the_plain_one(spark):
    rng = np.random.default_rng(6)
    d = len(quality_classifier.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (120, d))])
    y = np.repeat([0, 1], [80, 120])
    model = quality_classifier.fit(spark.createDataFrame([(v.tolist(), int(q)) for v, q in zip(x, y)], "statistics array<double>, quality int"))
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * own[0] + 120 * own[1]) / 200
    density = []
    for c in (0, 1):
        s = (1 - quality_classifier.SHRINK_POOLED) * own[c] + quality_classifier.SHRINK_POOLED * pooled
        s = (1 - quality_classifier.SHRINK_IDENTITY) * s + quality_classifier.SHRINK_IDENTITY * np.diag(np.diag(pooled))
        m = x - x[y == c].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(s), m) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), density[1] - density[0])
    loss = {f: np.logaddexp(0, (1 - 2 * y) * (f * (density[1] - density[0]) + np.log(1.5))).sum() for f in quality_classifier.FACTORS}
    assert model.factor == min(loss, key=loss.get)
