"""Operators on single texts against the libraries and plain Python: BPE, token counts, statistics, language, quality."""

import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridmend.llm import byte_bpe, language_id, pretokens, quality_classifier, quality_rules, token_counts, token_files
from gridmend.llm.common import shared_path
from gridmend.llm.textarrays import Words, texts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = "aB1 \n\t'srelvdm.!é中 　́\U0001f600\x1c\x85Ⅷ²z"
EDGES = ["", " ", "\n\n\nx", "don't 's !'s 'll'LL we're", "z" * 5000, "zaz" * 700, " " * 500 + "x", "'", "a'", "<|endoftext|>"]


def fuzz(n, seed):
    r = random.Random(seed)
    return EDGES + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_byte_bpe_is_the_library_s():
    own = byte_bpe.ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    cases = fuzz(3000, 1)
    got = []
    for _, _, raw, offsets in texts(pa.array(cases), 1 << 12):
        ids, ends = own.encode(raw, offsets)
        assert own.decode(ids)[0].tobytes() == raw.tobytes()
        got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [library.encode_ordinary(t) for t in cases]


def test_every_code_point_is_cut_as_the_library_does():
    """The libraries' own tables of letters and numbers, so the versions of Unicode agree."""
    own = byte_bpe.ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    points = [c for c in [*range(1, 0x32400), *range(0xE0000, 0xE0200), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20000):
        cases = [f"{chr(c)}a{chr(c)} {chr(c)}1{chr(c)}" for c in points[k : k + 20000]]
        for _, _, raw, offsets in texts(pa.array(cases), 1 << 30):
            ids, ends = own.encode(raw, offsets)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode_ordinary_batch(cases, num_threads=2)


def test_token_counts_are_the_library_s():
    cases = fuzz(2000, 2) + ["<|endoftext|>hi <|endoftext|> x"]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(cases, add_special_tokens=False)]
    assert token_counts.merges(JSON).tokens(cases) == want


def test_bpe_rows(spark):
    odd = spark.createDataFrame([(None, None, 5), (1, "", 6), (2, "hi there", 7), (2, "hi there", 8)], "doc_id long, text string, ids int")
    rows = byte_bpe.decode(byte_bpe.encode(odd, RANKS), RANKS).orderBy("token_starts").collect()
    assert [bytes(r["decoded"]) for r in rows].count(b"hi there") == 2 and len(rows) == 4
    assert rows[-1]["token_starts"] == [0, 2]
    assert byte_bpe.encode(odd.limit(0), RANKS).count() == 0


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(3, "x y"), (None, None), (1, ""), (2, "<|endoftext|>hi"), (2, "<|endoftext|>hi")], "doc_id long, text string")
    path = shared_path(spark, "t")
    token_files.write_tokens(docs, JSON, path)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(None, 0, 1), (1, 1, 1), (2, 2, 3), (2, 5, 3), (3, 8, 3)]
    assert rows[2]["ids"] == [50256, 5303, 2]
    assert [r["doc_id"] for r in token_files.read_tokens(spark, path, 2, 3).orderBy("start").collect()] == [2, 2, 3]
    metadata = token_files.read_metadata(spark, path)
    assert "ids" not in metadata._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def plain_stats(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    tri, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            cover.update(range(i, i + 3))
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    cases = fuzz(200, 3) + ["a a a a a", "a b c a b c", "x\nx\n \n \nx", "1 2 3 9 1 2 3 1 2 3"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in quality_rules.text_stats(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_stats(cases[r["doc_id"]])


def test_quality_rules_keep_clean_and_reject_junk(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").collect()
    assert not [r for r in rows if r["quality"] == 0 and r["kept"]]
    assert not [r for r in rows if r["quality"] == 1 and not r["base_failed"] and not r["kept"]]
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", None)], "doc_id long, text string, lang string, source string")
    assert [(r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(odd).collect()] == [(True, False)] * 2
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_fences_follow_each_group(spark):
    """What one source keeps another one rejects; in one without symbols the one document with some stands out."""
    def row(k, source, marks, symbols=0):
        return (k, "en", source, 100, 500, symbols, 0, 0, marks, 10)

    loud = [row(k, "loud", 30 + k % 15) for k in range(200)]
    plain = [row(1000 + k, "plain", 44 if k == 1 else 8 + k % 4, 8 if k == 0 else 0) for k in range(200)]
    stats = spark.createDataFrame(loud + plain, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    limits = quality_rules.thresholds(stats)
    kept = {r["doc_id"] for r in quality_rules.apply_rules(stats, limits).filter("kept").collect()}
    assert kept == {*range(200), *range(1002, 1200)}
    floors = {r["source"]: r["at_floor"] for r in limits.collect()}
    assert "symbols" in floors["plain"] and "marks" not in floors["loud"]
    fences = {r["source"]: r["max_marks"] for r in limits.collect()}
    assert fences["loud"] > 0.44 > fences["plain"]


def test_fences_of_the_data_come_from_sketches(spark):
    """On real ratios four of five fences differ from group to group and aren't set by the floor."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_rules.text_stats(docs)
    assert stats.filter("n_words >= 50").groupBy("lang", "source").count().filter(f"count >= {quality_rules.MIN_GROUP}").count() > 5
    limits = quality_rules.thresholds(stats).collect()
    for r in ("marks", "word_length", "repeats"):
        assert len({x[f"max_{r}"] for x in limits}) > 5, r
    assert sum("marks" in x["at_floor"] or "word_length" in x["at_floor"] for x in limits) < len(limits) / 10


def test_quality_rules_with_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 1.0, 2, 3, 4, 5, 6), (2, None, None, "a", 1.0, 2, 3, 4, 5, 6)], "doc_id long, text string, lang string, source string, max_symbols double, _w int, _lang int, kept int, n_words int, _counts int")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert rows[1]["kept"] is True and rows[1]["n_words"] == 60 and rows[1]["max_symbols"] == 1.0 and rows[1]["_w"] == 2 and rows[2]["base_failed"]
    assert quality_rules.quality_rules(docs.select("doc_id", "text")).count() == 2


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs)
    assert (model.weights == 0).mean() > 0.3
    rows = language_id.identify_languages(docs, model).filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    odd = spark.createDataFrame([(None, None, 1.0), (2, " 12 !", 2.0)], "doc_id long, text string, score double")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify_languages(odd, model).collect()} == {("und", 0.0)}
    assert language_id.fit(docs.limit(0)).languages == []


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify_quality(docs.select("doc_id", "text"), labels, ["doc_id"]).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    odd = docs.limit(0)
    assert quality_classifier.classify_quality(odd, labels).count() == 0


def test_words_and_chunks():
    cases = ["a b", "", "c", " d  e ", "f"]
    for size in (1, 3, 100):
        got = []
        for _, _, raw, offsets in texts(pa.array(cases), size):
            w = Words(raw, offsets)
            got += [[bytes(raw[a:b]) for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.first, w.first[1:])]
        assert got == [c.encode().split() for c in cases]


@pytest.mark.parametrize("seed", range(3))
def test_hash_clash_is_caught(seed, monkeypatch):
    """With hashes of two bits every piece clashes; results stay right."""
    from gridmend.llm import piece_table

    own = byte_bpe.Ranks(RANKS)
    true = piece_table.span_hashes
    monkeypatch.setattr(piece_table, "span_hashes", lambda *a: true(*a) & np.uint64(6))
    raw = np.frombuffer(b"one two three four five six seven", np.uint8)
    ids, _ = own.encode(raw, np.array([0, len(raw)]))
    assert own.decode(ids)[0].tobytes() == raw.tobytes()


def test_equal_rows_are_dealt_to_many_files(spark):
    """A third of all rows without an id and with one text, in no file of their own."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) text").repartition(6)
    path = shared_path(spark, "equal")
    token_files.write_tokens(rows, P.path("byte_bpe_50k.json"), path, partitions=12)
    sizes = [r["count"] for r in token_files._files(spark, path).groupBy("part").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1200
    read = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["start"] for r in read] == [0, *__import__("itertools").accumulate(r["n_tokens"] for r in read)][:-1]


def test_sample_is_bounded_in_bytes(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    took = []
    plain = language_id.train_ftrl
    monkeypatch.setattr(language_id, "train_ftrl", lambda rows, n: took.append(sum(6 * len(at) for _, at, _ in rows)) or plain(rows, n))
    language_id.fit(docs)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 200_000)
    language_id.fit(docs)
    assert took[1] < 300_000 < took[0]
