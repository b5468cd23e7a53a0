"""Operators over all documents against brute force: the similarity join, span dedup, decontamination, WARC, the pipeline."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from gridmend.llm import common, components, decontamination, ngram_join, span_dedup, warc
from gridmend.llm.common import shared_path


def grams(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_copies(n, words=120, seed=4):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    cases = near_copies(60) + near_copies(5, seed=9) + ["a b", "a  b", "", None, "   ", "a b c d e f"] + near_copies(3, seed=9)
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").selectExpr("*", "'old' class_id")
    rows = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    distinct = sorted({t for t in cases if t and t.strip()})
    sets = {t: grams(t) for t in distinct}
    links = {t: [u for u in distinct if u != t and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])] for t in distinct}
    first = {t: cases.index(t) for t in distinct}
    root = dict(first)
    for _ in distinct:
        for t in distinct:
            root[t] = min([root[t], *(root[u] for u in links[t])])
    assert len(rows) == len(cases)
    for i, t in enumerate(cases):
        want = (root[t], len(links[t])) if t and t.strip() else (i, 0)
        assert (rows[i]["class_id"], rows[i]["n_links"]) == want, i
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_one_per_class_keeps_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.one_per_class(docs).collect()) == [1, 3]
    base = near_copies(1)[0]
    near = [base, base + " more", base + " still", base + " yet"]
    odd = [(None, near[0]), (None, near[1]), (None, near[1]), (1, "p q r s t u v"), (1, near[2][5:]), (1, near[3][5:]), (None, None), (None, " "), (7, "")]
    kept = ngram_join.one_per_class(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 _key", "2 class_id", "3 n")).collect()
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:3]) for r in kept if r["text"] and r["text"].strip()) == sorted([(1, "p q"), (1, near[2][5:8])])
    assert len([r for r in kept if not (r["text"] or "").strip()]) == 3 and kept[0]["class_id"] == 2


def test_recall_on_planted_pairs(spark):
    """Of pairs from 0.8 up, in which words are replaced at random, at least 99 in 100 are linked."""
    r = random.Random(3)
    rows, want = [], 0
    for k in range(300):
        base = [f"w{r.randint(0, 10**7)}" for _ in range(150)]
        other = list(base)
        for _ in range(r.randint(1, 3)):
            other[r.randrange(150)] = f"x{r.randint(0, 10**7)}"
        a, b = grams(" ".join(base)), grams(" ".join(other))
        if 5 * len(a & b) >= 4 * len(a | b):
            want += 1
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sum(x["n_links"] == 1 and x["class_id"] == x["doc_id"] // 2 * 2 for x in got) / 2
    assert want > 250 and linked >= 0.99 * want


def test_unlike_texts_of_a_chain_are_not_compared(spark, monkeypatch):
    """Texts that only others tie together share no bucket, so no group holds them both."""
    words = [f"c{k}" for k in range(400)]
    chain = [" ".join(words[k : k + 100]) for k in range(0, 300, 5)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    uniq = docs.select("doc_id", ngram_join.digest(ngram_join.F.col("text")).alias("key"), ngram_join._signer(5, *ngram_join.plan_bands(0.8))(ngram_join.F.col("text")).alias("bands")).selectExpr("key", "doc_id rep", "bands")
    shared = {r["rep"]: {b["band"] for b in r["buckets"]} for r in ngram_join._placed(uniq).collect()}
    assert not any(shared[a] & shared[b] for a in shared for b in shared if abs(a - b) > 30)
    rows = ngram_join.ngram_join(docs).collect()
    assert {r["class_id"] for r in rows} == {0} and max(r["n_links"] for r in rows) <= 6


def test_bands_reach_the_recall():
    bands, rows = ngram_join.plan_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= ngram_join.MAX_HASHES


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    star = spark.createDataFrame([(0, k) for k in range(1, 500)] + [(k, k + 500) for k in range(1, 500)], "a long, b long")
    assert {r["root"] for r in components.connected(star, "a", "b").collect()} == {0}


PASSAGE = " ".join(f"p{i}" + ("." if i % 17 == 16 else "") for i in range(60))


def deduped(spark, rows, **limits):
    found = span_dedup.span_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    return [(r["doc_id"], r["text"]) for r in found]


def test_span_dedup(spark):
    rows = [(2, f"Own start here.\n{PASSAGE}\nOwn end there."), (1, f"{PASSAGE}"), (3, "Short one. Short two."), (4, "Short one. Short two."), (5, None), (6, ""), (None, PASSAGE), (1, PASSAGE)]
    got = set(deduped(spark, rows))
    assert got == {(2, "Own start here.\nOwn end there."), (1, PASSAGE), (3, "Short one. Short two."), (4, "Short one. Short two."), (5, None), (6, ""), (None, "")}
    assert deduped(spark, [(1, f"{PASSAGE}\nmiddle words.\n{PASSAGE}")]) == [(1, f"{PASSAGE}\nmiddle words.\n")]
    empty = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string").limit(0)
    assert span_dedup.span_dedup(empty).count() == 0
    named = spark.createDataFrame([("b", f"x {PASSAGE}", 1, 2), ("a", PASSAGE, 1, 2), (None, PASSAGE, 1, 2)], "doc_id string, text string, n_removed int, _doc int")
    found = {r["doc_id"]: r["text"] for r in span_dedup.span_dedup(named).collect()}
    assert found["a"] == PASSAGE and len(found["b"].split()) <= 18 and found[None] == ""


def test_span_dedup_leaves_other_bytes_alone(spark):
    """What goes is lines as a whole, or sentences with the white space between them and what stays."""
    lines = "One two three 3 3.\nFour five six 6 6.\nSeven eight nine 9 9."
    rows = [(1, lines), (2, f"Intro.\n\n    indented.\n\n{lines}\n...\n\nTail  end. "), (3, f"  Head.   {lines.replace(chr(10), ' ')}   Tail.\n x"), (4, f" \n  {lines}\n\n y"), (5, f"A.\tB c. {lines.replace(chr(10), ' ')}\t\n\n  D.")]
    got = dict(deduped(spark, rows))
    assert got[1] == lines
    assert got[2] == "Intro.\n\n    indented.\n\n...\n\nTail  end. "
    assert got[3] == "  Head.   Tail.\n x" and got[4] == " \n\n y" and got[5] == "A.\tB c.\t\n\n  D."


def test_span_dedup_inside_lines(spark):
    """Passages in mid-line go to their last sentence, and those without full stops at any offset but for a few words."""
    short = " ".join(" ".join(f"s{n}w{i}" for i in range(n)) + "." for n in (9, 20, 10, 3))
    plain = " ".join(f"q{i}" for i in range(80))
    rows = [(0, short), (1, f"Own start. {short} Own end."), (100, plain)]
    rows += [(101 + k, " ".join([f"x{k}y{i}" for i in range(k)] + [plain] + [f"z{k}y{i}" for i in range(40 - k)])) for k in range(0, 40, 3)]
    got = {d: t.split() for d, t in deduped(spark, rows)}
    assert got[1] == "Own start. Own end.".split() and got[100] == plain.split()
    for k in range(0, 40, 3):
        left = got[101 + k]
        assert sum(w[0] in "xz" for w in left) == 40 and sum(w[0] == "q" for w in left) <= 20, k


def test_span_dedup_against_brute_force(spark):
    """All windows of three sentences, with no least number of words and no cuts inside sentences."""
    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 4))) + r.choice(".!?") for _ in range(9)]
    rows = [(i, "".join(r.choice(pool) + r.choice([" ", "\n", "\n \n", "  "]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    split = {i: re.findall(r"[^\s].*?[.!?](?=\s|$)", t, re.S) for i, t in rows}
    first, gone = {}, {i: set() for i in split}
    for i in sorted(split):
        for k in range(len(split[i]) - 2):
            window = " ".join(" ".join(split[i][k : k + 3]).split())
            if first.setdefault(window, (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    for i, t in deduped(spark, rows, sentences=3, window_words=0, span_words=1000, cap=1000):
        assert t.split() == " ".join(x for k, x in enumerate(split[i]) if k not in gone[i]).split(), i
    assert sum(map(len, gone.values())) > 20


def test_equal_runs_need_both_hashes(spark, monkeypatch):
    """Runs that share their first hash by chance stay."""
    rows = [(k, " ".join(f"d{k}s{j}w{i}" for j in range(3) for i in range(6)).replace("w5", "w5.")) for k in range(6)] + [(9, PASSAGE), (10, PASSAGE)]
    plain = span_dedup.Sentences.__init__

    def same(self, *x):
        plain(self, *x)
        self.hashes = self.hashes * 0 + 7

    monkeypatch.setattr(span_dedup.Sentences, "__init__", same)
    spark.sparkContext._jvm.System.gc()
    made = []
    import pyarrow as pa

    for _, t in rows:
        made.append(span_dedup._hasher(3, 15, 25, 25).func(iter([pa.array([t])])).__next__().to_pylist()[0])
    assert all(x["h"] == 7 for runs in made for x in runs)
    seconds = [{x["g"] for x in runs} for runs in made]
    assert seconds[-1] == seconds[-2] and all(not (a & b) for i, a in enumerate(seconds[:-1]) for b in seconds[:i])
    gone = span_dedup._remover(3, 15, 25, 25).func(iter([(pa.array([rows[0][1], PASSAGE]), pa.array([made[-1], made[-1]], span_dedup._RUNS_ARROW))])).__next__().to_pylist()
    assert gone[0]["n_removed"] == 0 and gone[1]["text"] == ""


def spans_by_hand(rows, sentences=3, window_words=15, span_words=25):
    """The module's rules over texts in which every sentence ends with a mark and has at most 25 words, so that no stretch is cut."""
    split = [[s.split() for s in re.findall(r"\S[^.!?\n]*[.!?]?", t)] for _, t in rows]
    runs = []
    for i, own in enumerate(split):
        size = [len(x) for x in own]
        found = set()
        for k in range(len(own)):
            if k + sentences <= len(own) and sum(size[k : k + sentences]) >= window_words:
                found.add((k, k + sentences - 1))
            ahead = next((j for j in range(k + 1, len(own)) if sum(size[k : j + 1]) >= span_words), None)
            back = next((j for j in range(k - 1, -1, -1) if sum(size[j : k + 1]) >= span_words), None)
            found |= {(k, ahead)} if ahead is not None else set()
            found |= {(back, k)} if back is not None else set()
        runs += [(rows[i][0], a, b, i, tuple(w for x in own[a : b + 1] for w in x)) for a, b in found]
    first, gone = {}, [set() for _ in rows]
    for _, a, b, i, words in sorted(runs):
        if first.setdefault(words, (i, a)) != (i, a):
            gone[i] |= set(range(a, b + 1))
    return {rows[i][0]: (" ".join(w for k, x in enumerate(own) if k not in gone[i] for w in x), len(gone[i])) for i, own in enumerate(split)}


def test_span_dedup_defaults_against_brute_force(spark):
    r = random.Random(21)
    pool = [" ".join(f"p{k}w{r.randint(0, 9)}" for _ in range(r.randint(2, 14))) + r.choice(".!?") for k in range(25)]
    passages = [[r.choice(pool) for _ in range(r.randint(2, 5))] for _ in range(8)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts += r.choice(passages) if r.random() < 0.6 else [f"own{i}x{r.randint(0, 99)} " * r.randint(1, 12) + "end."]
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    want = spans_by_hand(rows)
    got = {x["doc_id"]: (" ".join(x["text"].split()), x["n_removed"]) for x in span_dedup.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(n for _, n in want.values()) > 100


def test_hot_runs_buckets_and_roots_are_split(spark, monkeypatch):
    """A passage in all documents: the join that finds it is split. A root with all others as neighbours: no part has more than its share."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10k")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = spark.range(6000).selectExpr("id AS _doc", "cast(7 AS long) h", "cast(7 AS long) g").union(spark.range(3000).selectExpr("id", "id * 31 + 100", "id")).repartition(8)
        repeated = common.cut(rows.groupBy("h", "g").agg(F.min("_doc").alias("first")), "repeated")
        joined = rows.join(repeated.hint("merge"), ["h", "g"])
        sizes = [x["n"] for x in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        plan = joined._jdf.queryExecution().executedPlan()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString() or max(sizes) < 6000, plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    monkeypatch.setattr(components, "PART_EDGES", 100)
    edges = spark.range(1, 3000).selectExpr("0 AS a", "id AS b")
    parts = []
    plain = components._with_least
    monkeypatch.setattr(components, "_with_least", lambda e, least, n: parts.append(n) or plain(e, least, n))
    found = components.connected(edges, "a", "b")
    assert found.count() == 2999 and found.filter("root <> 0").count() == 0 and max(parts) >= 2 * 2999 // 100


def plain_leaks(texts, items):
    """All (position, item_id) by windows, BM25 and overlaps in plain Python, with the module's parameters."""
    D = decontamination
    words = {k: D.words_of(t) for k, (_, t) in enumerate(items) if t and D.words_of(t)}
    df = Counter(w for x in words.values() for w in set(x))
    mean = sum(map(len, words.values())) / len(words)
    length = {k: math.ceil(math.log(len(x), D.GROWTH)) for k, x in words.items()}
    longest = {g: max(len(x) for k, x in words.items() if length[k] == g) for g in length.values()}

    def weight(k, w):
        tf = words[k].count(w)
        return math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(words[k]) / mean))

    weights = {k: {w: weight(k, w) for w in set(x)} for k, x in words.items()}
    found = set()
    for i, t in enumerate(texts):
        have = D.words_of(t or "")
        for k, x in words.items():
            s = longest[length[k]]
            for a in range(0, max(math.ceil(len(have) / s) - 1, 1) * s, s):
                window = have[a : a + 2 * s]
                if sum(v for w, v in weights[k].items() if w in set(window)) < D.SHARE * sum(weights[k].values()) * (1 - 1e-9):
                    continue
                question, answer = D.question_and_answer(items[k][1])
                n = min(D.N, len(question))
                runs = lambda y: {tuple(y[j : j + n]) for j in range(len(y) - n + 1)}  # noqa: B023, E731
                own = runs(question)
                if len(own & runs(window)) >= D.OVERLAP * len(own) and sum(w in window for w in answer) >= D.OVERLAP * len(answer):
                    found.add((i, items[k][0]))
    return found


def test_decontamination_against_brute_force(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    tests = [(r["item_id"], r["text"]) for r in items]
    long = " ".join(f"long{k}" for k in range(300))
    tests += [(None, "a nameless item of some words."), (tests[0][0], "the same id with other words in it."), (10**6, long), (10**6 + 1, None), (10**6 + 2, " . "), (10**6 + 3, "Äpfel ÜBER Öl, sagt man. Ja.")]
    texts = [r["text"] for r in docs] + [None, "", "x " * 500 + tests[0][1] + " y" * 500, tests[1][1].upper(), " ".join(reversed(tests[1][1].split())), "So: A nameless, item of some words", "The same id with other words in it! " + tests[0][1], f"{long} {tests[2][1]}", "äpfel über öl sagt man ja"]
    want = plain_leaks(texts, tests)
    assert len(want) >= 9
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(tests, "item_id long, text string")
    for pass_bytes in (decontamination.PASS_BYTES, 1500):
        got = [(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench, pass_bytes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = {r["doc_id"] for r in decontamination.without_leaks(frame, bench, pass_bytes).collect()}
        assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert decontamination.find_leaks(frame, bench.limit(0)).count() == 0 and decontamination.find_leaks(frame.limit(0), bench).count() == 0
    named = decontamination.find_leaks(frame, bench.selectExpr("concat('i', item_id) item_id", "text")).collect()
    assert {r["item_id"] for r in named} == {None if k is None else f"i{k}" for _, k in want}


def test_bound_loses_nothing(spark, small):
    """All that a full scan of scores finds, block bounds find."""
    import numpy as np

    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, 12) % 60)) for i in range(50)]
    index = decontamination.Index(items, 50, 12.0)
    passage = np.repeat(np.arange(40), 15)
    term = rng.integers(0, len(index.vocabulary), 600)
    keys = np.unique(passage * len(index.vocabulary) + term)
    p, t = keys // len(index.vocabulary), keys % len(index.vocabulary)
    full = np.zeros((40, 50))
    for a, b in zip(p, t):
        s = slice(index.starts[b], index.starts[b + 1])
        full[a, index.item[s]] += index.weight[s]
    want = set(zip(*(x.tolist() for x in np.nonzero(full >= index.need[None, :] * (1 - 1e-9)))))
    got = index.scores(p, t, 40)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want and want


@pytest.mark.parametrize("split", [7, 200, 1 << 20])
def test_warc(spark, split):
    trap = "\x1f" * 9 + "WARC/1.1"
    rows = [(None, "u", None), (1, "u", ""), (2, None, "x"), (2, None, "x"), (3, "a\nb", "x"), (4, "q", trap), (5, "q", "é" * 4000)]
    folder = shared_path(spark, "w")
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, file_bytes=300)
    got = warc.read_warc(spark, folder, files, split, with_payload=True).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in got) == [(-1, "revisit", 1), (1, "response", -1), (2, "revisit", 3), (2, "revisit", 3), (3, "response", -1), (4, "response", -1), (5, "response", -1)]
    for r in got:
        html = dict((k, h) for k, _, h in rows)[r["page_id"]] or ""
        assert r["valid"] and r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


@pytest.mark.parametrize("split", [50, 400, 1 << 20])
def test_warc_damage_is_reported(tmp_path, split):
    """Each damaged place is one row, whatever the byte ranges, and all whole records are read."""
    import io

    members = [warc.record(k, "u", f"payload {k} ".encode() * 30, "x", None, False) for k in range(6)]
    torn = members[2][: len(members[2]) // 2]
    flipped = bytearray(members[4])
    flipped[-6] ^= 255  # the checksum
    data = members[0] + members[1] + torn + members[3] + bytes(flipped) + b"junk" + members[5] + b"tail"

    def places(data):
        found = [x for a in range(0, len(data), split) for x in warc.scan(io.BytesIO(data), a, min(a + split, len(data)))]
        return sorted(at for at, f in found if f is None), [f["warc-record-id"] for _, f in found if f]

    at = [len(members[0] + members[1]), len(members[0] + members[1] + torn + members[3]), len(data) - 4]
    assert places(data) == (at, [f"<urn:page:{k}>" for k in (0, 1, 3, 5)])
    assert places(b"no archive") == ([0], []) and places(b"") == ([], []) and places(b"".join(members))[0] == []
    assert places(b"xx" + members[0] + b"yy" + members[1])[0] == [0, len(members[0]) + 2]


def test_pages_of_one_payload_are_split(spark):
    """A payload that a third of all pages share is written by many tasks."""
    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        pages = spark.range(0, 12000, 1, 12).selectExpr("id page_id", "concat('u', id) url", "case when id % 3 = 0 then '' else concat('page ', id, repeat(' x', 20)) end html")
        files = warc.write_warc(pages, shared_path(spark, "hot")).collect()
        assert sum(f["n_records"] for f in files) == 12000 and max(f["n_records"] for f in files) < 2500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).collect()
    assert out and all(r["decodes"] for r in out) and len({r["doc_id"] for r in out}) == len(out)


def plain_spans(rows):
    """What span_dedup leaves of (doc_id, text), as words, by the module's sentences and runs of whole words in place of hashes."""
    import numpy as np

    D, runs, own = span_dedup, [], {}
    for d, text in sorted(rows):
        raw = np.frombuffer(text.encode(), np.uint8)
        s = D.Sentences(raw, np.array([0, len(raw)]), D.SENTENCES, D.WINDOW_WORDS, D.SPAN_WORDS, D.CAP)
        w = [raw[a:b].tobytes().decode() for a, b in zip(s.words.starts, s.words.ends)]
        lines = [raw[: s.words.starts[k]].tobytes().count(10) for k in range(len(w))]
        natural = [k == 0 or lines[k] != lines[k - 1] or w[k - 1][-1] in ".!?" for k in range(len(w))] + [True]
        bounds = [*s.starts.tolist(), len(w)]
        sentences = [w[a:b] for a, b in zip(bounds, bounds[1:])]
        size, n, found = [len(x) for x in sentences], len(sentences), set()
        for k in range(n):
            if k + 3 <= n and sum(size[k : k + 3]) >= D.WINDOW_WORDS and all(natural[bounds[j]] for j in range(k, k + 4)):
                found.add((k, k + 2))
            ahead = next((j for j in range(k + 1, n) if sum(size[k : j + 1]) >= D.SPAN_WORDS), None)
            back = next((j for j in range(k - 1, -1, -1) if sum(size[j : k + 1]) >= D.SPAN_WORDS), None)
            found |= {x for x in ((k, ahead), (back, k)) if None not in x}
        own[d] = sentences
        runs += [(d, a, b, tuple(x for y in sentences[a : b + 1] for x in y)) for a, b in found]
    first, gone = {}, {d: set() for d in own}
    for d, a, b, words in sorted(runs):
        if first.setdefault(words, (d, a)) != (d, a):
            gone[d] |= set(range(a, b + 1))
    return {d: " ".join(x for k, y in enumerate(own[d]) if k not in gone[d] for x in y) for d in own if not gone[d] or len(gone[d]) < len(own[d])}


def test_pipeline_against_plain_stages(spark, small):
    """The first two stages by their SQL, the third and fourth in plain Python, the last by the library."""
    import duckdb
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from gridmend.llm import sql

    con = duckdb.connect()
    con.execute(f"create table documents as select * from read_parquet('{small}/documents.parquet')")
    found = con.execute(sql.OP1)
    names = [d[0] for d in found.description]
    kept = [r[names.index("doc_id")] for r in found.fetchall() if r[names.index("kept")]]
    con.execute(f"delete from documents where doc_id not in ({', '.join(map(str, kept))})")
    found = con.execute(sql.OP7)
    names = [d[0] for d in found.description]
    ones = {r[names.index("doc_id")] for r in found.fetchall() if r[names.index("class_id")] == r[names.index("doc_id")]}
    texts = [r for r in con.execute("select doc_id, text from documents").fetchall() if r[0] in ones]
    left = plain_spans(texts)
    items = duckdb.connect().execute(f"select item_id, text from read_parquet('{small}/benchmark.parquet')").fetchall()
    order = sorted(left)
    leaked = {order[i] for i, _ in plain_leaks([left[d] for d in order], items)}
    want = {d: t for d, t in left.items() if d not in leaked}
    rows = corpus_pipeline.run(spark, small).collect()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(x): int(n) for x, n in (line.split() for line in file if line.strip())}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: library.decode(r["ids"]) for r in rows}
    assert {d: " ".join(t.split()) for d, t in got.items()} == {d: " ".join(t.split()) for d, t in want.items()}
    assert all(r["ids"] == library.encode_ordinary(got[r["doc_id"]]) for r in rows) and leaked and len(kept) > len(ones) > len(want)
