"""Headers and texts against all pairs with the glossary."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gridmend.functions.clean import normalise
from gridmend.operators import mapping as M
from gridmend.plans import more_queries


def longest(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for k, d in enumerate(b):
            new.append(row[k] + 1 if c == d else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    p, q = (" ".join(filter(None, [both, s])) for s in (left, right))
    pairs = [(p, q)] + ([(both, p), (both, q)] if both else [])
    return max(2 * longest(a, b) / (len(a) + len(b)) for a, b in pairs)


def texts():
    r = random.Random(5)
    plain = sorted({p for _, _, p, _ in M.glossary_rows(M.MORE_PHRASES)})
    out = [None, "", "  ", "--", "Ünïcode", "x" * 5000, "a b c d e f g h i", "st", "BLDG  VALUE", "the year of construction", "building value value"]
    for p in r.sample(plain, 60):
        k = r.randrange(len(p))
        out += [p, p[:k] + p[k + 1 :], p[:k] + r.choice("aeqz1 ") + p[k:], p[::-1], p + " " + r.choice(plain), p.upper() + " #"]
    return out + out[:40]


def test_lexical_is_the_best_of_all_pairs(spark):
    rows = M.glossary_rows(M.MORE_PHRASES)
    headers = spark.createDataFrame([(t,) for t in texts()], "header string")
    known = {r["header"]: (r["bare"] or "", r["long"] or "") for r in headers.distinct().select("header", normalise(F.col("header")).alias("bare"), M.prepare(F.col("header")).alias("long")).collect()}
    got = {(r["header"], r["target"]): (r["lexical"], r["phrase"], r["exact"]) for r in M.lexical(headers, rows).collect()}
    assert len(got) == 17 * len(known)
    for h, (bare, long) in known.items():
        best = {}
        for t, _, p, rank in rows:
            q = M._plain(p)
            if q:
                x = (q == bare, 1.0 if q == bare else ratio(long, q), -rank, p)
                best[t] = max(best.get(t, (False, -1.0, 0, "")), x, key=lambda x: x[:3])
        for t, (exact, s, _, p) in best.items():
            assert got[h, t][1:] == (p, exact) and abs(got[h, t][0] - s) < 1e-4, (h, t)
    assert M.lexical(headers.limit(0), rows).count() == 0


def test_match_target_finds_what_all_pairs_find(spark):
    rows = M.glossary_rows(M.MORE_PHRASES)
    cells = spark.createDataFrame([(t,) for t in texts()], "value string")
    plain = {r["value"]: r["t"] for r in cells.distinct().select("value", normalise(F.col("value")).alias("t")).collect()}
    want = {}
    for v, t in plain.items():
        words, found = list(dict.fromkeys((t or "").split(" "))), []
        for target, k, p, rank in rows:
            q = M._plain(p)
            if not q or not t:
                continue
            own, share = set(q.split()), len(set(q.split())) / len(words)
            if q == t:
                found.append((2.0, -k, -rank, target))
            elif len(words) <= M.MAX_TOKENS and own <= set(words):
                found += [(0.9 + 0.1 * share, -k, -rank, target)] if share >= M.MIN_SHARE else []
            elif len(words) <= M.MAX_TOKENS and (s := SequenceMatcher(None, t, q).ratio()) >= M.FUZZY:
                found.append((s, -k, -rank, target))
        if found:
            want[v] = max(found)[3]
    found = M.match_target(cells, rows)
    assert {r["value"]: r["target"] for r in found.collect()} == want and len(want) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert M.match_target(cells.limit(0), rows).count() == 0 and M.match_target(cells, []).count() == 0


def test_most_misspelt_texts_are_found(spark, small):
    texts = more_queries.misspelt(spark, small)
    found = M.match_target(texts.select(F.col("header").alias("value")), M.glossary_rows()).count()
    assert found >= 0.5 * texts.count()
