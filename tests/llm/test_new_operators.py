"""Line dedup, the prefix trie and collocations against brute force, with hot keys, ties, repeats and nulls."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import pytest

from gridmend.llm import collocations, common, line_dedup, prefix_trie, sql
from gridmend.llm import registry as R

WHITE = " \t\n\x0b\x0c\r"
A_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lines_by_hand(docs, min_chars=40, min_docs=5):
    key = lambda line: line.strip(WHITE).translate(A_Z)
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    last = {k: max((x for x in ds if x is not None), default=None) for k, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), None if t is None else "\n".join(stay)))
    return out


def odd_documents():
    r = random.Random(3)
    common_line = "This line stands in very many documents, with É and ß in it"
    pool = [f"shared line number {k} which is long enough to count here" for k in range(12)]
    docs = []
    for k in range(150):
        lines = [r.choice(pool) if r.random() < 0.4 else f"own {k} {r.random()}" for _ in range(r.randint(0, 7))]
        if k % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(["  ", "", "\t"]) + (common_line.upper().replace("É", "É") if k % 2 else common_line) + "\r")
        docs.append((k, "\n".join(lines)))
    docs += [(None, pool[0]), (None, pool[0] + "\nmore"), (None, None), (500, None), (501, ""), (502, "\n\n"), (503, "x" * 40), (503, "x" * 39)]
    docs += [(504, "\n".join(pool)), (504, "\n".join(pool)), (505, pool[0] + "\n" + pool[0]), (506, "y" * 40 + "\n" + "z\n" * 20_000)]
    return docs + [(600 + k, "y" * 40) for k in range(4)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' h", "'clash' pos", "'old' n_dropped", "'clash' _row").repartition(7)
    rows = line_dedup.line_dedup(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows], key=key) == sorted(lines_by_hand(docs), key=key)
    assert all(r["h"] == "clash" and r["pos"] == "clash" for r in rows) and any(r["n_dropped"] for r in rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_of_text_ids(spark):
    docs = [(f"d{k}", "w" * 50) for k in range(6)]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert rows == {d: t if d == "d5" else "" for d, t in docs}


def trie_by_hand(turns):
    own = defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            own[c].append((n is not None, n or 0, prefix(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(xs)] for c, xs in own.items()}
    seqs = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + xs[h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    rows = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def prefix(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest() + len(text or "").to_bytes(4, "big")


def some_turns():
    r = random.Random(5)
    say = ["hi", "hello there", "é\U0001f600", "", None, "what is it", "bye", "x" * 300]
    turns = [(c, n, r.choice(["user", "assistant", None]), r.choice(say)) for c in range(230) if c % 7 != 3 for n in range(r.randint(0, 6))]
    turns += [(c, n, "user", say[n]) for c in range(300, 420) for n in range(8)]  # very many copies
    turns += [(250, n, "user", f"t{n}") for n in range(150)] + [(251, None, "user", "late"), (251, 0, "user", "b"), (251, 0, "user", "a"), (251, 0, "user", "a"), (None, 1, "user", "none")]
    return turns + [(-5, 0, "user", "hi"), (-5, 1, "user", "hi")]


@pytest.mark.parametrize("tree_rows", [40_000, 9])
def test_trie_against_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(prefix_trie, "TREE_ROWS", tree_rows)
    turns = [t for t in some_turns() if t[0] is None or t[0] >= 0]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 hi", "2 ids").repartition(5)
    made = prefix_trie.prefix_trie(prefix_trie.share_first_turns(prefix_trie.conversations(df)))
    rows = sorted(tuple(r) for r in made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    want = sorted(trie_by_hand(turns))
    fix = lambda rs: [tuple(-1 if x is None else x for x in r) for r in rs]
    assert sorted(fix(rows)) == sorted(fix(want))
    assert max(r[3] for r in rows if r[1] == 3) > 20 and max(r[1] for r in rows) > 100
    assert prefix_trie.prefix_trie(prefix_trie.conversations(df.limit(0))).count() == 0


def test_radix_nodes_grow_and_split():
    tree, r = prefix_trie.Tree(), random.Random(1)
    keys = [bytes([a]) + b"tail" for a in range(256)] + [b"", b"\x07tail and more", b"\x07ta"] + [r.randbytes(r.randint(1, 9)) for _ in range(500)]
    for k, key in enumerate(keys):
        tree.add(key, k)
    assert tree.root.layout == 256 and tree.root.end == [256]
    found, stack = {}, [(tree.root, b"")]
    layouts = set()
    while stack:
        node, at = stack.pop()
        at += node.edge
        layouts.add(node.layout)
        assert node.end or len(node.children()) != 1 or node is tree.root  # paths are compressed
        for kid in node.children():
            assert node.child(kid.edge[0]) is kid
        if node.end:
            found[at] = node.end
        stack += [(kid, at) for kid in node.children()]
    want = defaultdict(list)
    for k, key in enumerate(keys):
        want[key].append(k)
    assert found == want and layouts >= {4, 256}
    small = prefix_trie.Tree()
    for n in range(49):
        small.add(bytes([n]), n)
        assert small.root.layout == (4 if n < 4 else 16 if n < 16 else 48 if n < 48 else 256)


def phrases_by_hand(docs, min_count=10, top=2000):
    one, two, three = (defaultdict(Counter) for _ in range(3))
    for lang, text in docs:
        lang, piece = lang or "und", []
        for ch in (text or "").translate(A_Z) + "\n":
            if ch in ".,;:!?\n\x0b\x0c\r":
                w = [x for x in "".join(piece).replace("\t", " ").split(" ") if x]
                one[lang].update(w)
                two[lang].update(zip(w, w[1:]))
                three[lang].update(zip(w, w[1:], w[2:]))
                piece = []
            else:
                piece.append(ch)
    rows = []
    for lang in one:
        f = lambda *w: (one, two, three)[len(w) - 1][lang][w if len(w) > 1 else w[0]]  # noqa: E731, B023
        long = {w: a for w, a in three[lang].items() if a >= min_count}
        found = []
        for w, a in [*two[lang].items(), *long.items()]:
            if a < min_count or len(w) == 2 and any(100 * b >= 50 * a for x, b in long.items() if w in (x[:2], x[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f(*w[:k]) * f(*w[k:])), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f(*w[:k]), f(*w[k:])))
        n = sum(one[lang].values())
        rows += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return rows


def phrase_documents():
    r = random.Random(11)
    words = [f"w{k}" for k in range(40)] + ["É", "é", "a\xa0b", "x-y", "ZZ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(r.choice(["en", "en", "de", None]), r.choice([". ", ",", "\n", " ; ", "!?"]).join(" ".join(r.choices(words, weights, k=r.randint(1, 9))) for _ in range(9))) for _ in range(250)]
    docs += [("en", "new york city. Always new york city"), ("en", "strong tea"), ("fr", "un deux trois")] * 30 + [("en", None), (None, ""), ("en", "\t \t"), ("en", "same same " * 30_000)]
    return docs


@pytest.mark.parametrize(("top", "limit"), [(2000, 200_000), (25, 0), (3, 200_000)])
def test_phrases_against_brute_force(spark, monkeypatch, top, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 4000)
    docs = phrase_documents()
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 n", "2 h1").repartition(6)
    rows = collocations.collocations(df, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, rows)) == sorted(phrases_by_hand(docs, top=top))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_thresholds_are_lowered_until_enough_survive(spark, monkeypatch):
    """Two-word phrases that longer ones hold drop out, so the first threshold leaves too few."""
    docs = [("en", ". ".join(f"a{k} b{k} c{k}" for k in range(40)))] * 12 + [("en", ". ".join(f"d{k} e{k % 7}" for k in range(30)))] * 15
    rounds = []
    thresholds = collocations._thresholds
    monkeypatch.setattr(collocations, "FIRST", 1)
    monkeypatch.setattr(collocations, "_thresholds", lambda *x: rounds.append(1) or thresholds(*x))
    rows = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), top=50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, rows)) == sorted(phrases_by_hand(docs, top=50)) and len(rounds) >= 2


def test_words_that_share_a_hash_begin_again(spark, monkeypatch):
    seeds = []
    count = collocations.count_words

    def told(rows, seed):
        seeds.append(seed)
        made = count(rows, seed)
        return made.withColumn("h1", made["h1"] * 0) if seed == 1 else made

    monkeypatch.setattr(collocations, "count_words", told)
    docs = [("en", "a b c")] * 12
    assert [r["phrase"] for r in collocations.collocations(spark.createDataFrame(docs, "lang string, text string")).collect()] == ["a b c"] and seeds == [1, 2]


def test_products_pass_64_bits(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big, big + 1), (big, 2 * big, big)], "a long, l long, r long")
    assert [r[0] for r in df.select(collocations._score("a", "l", "r")).collect()] == [10**6 * big * big // (big * (big + 1)), 500_000]


def test_queries_against_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{small}/{name}.parquet')")
    for name in ("op11_line_dedup", "op12_prefix_trie", "op13_collocations"):
        df = R.queries()[name](spark, small)
        found = con.execute(sql.QUERIES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted([tuple(r[c] for c in names) for r in df.collect()], key=key) == sorted(found.fetchall(), key=key)
