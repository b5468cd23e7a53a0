"""What a model says, against the findings and the columns that it is about."""

from gridmend.operators import mapping, profile, verify

REPLY = "rec_id string, op string, confidence double, rows array<long>, befores array<string>, afters array<string>, evidence array<string>, named_rec string, proposed_op string, cited_row long, cited_before string, cited_after string, prose string, doubt string"
GOOD = ("R-001", "zip5", 0.95, [3, 9], ["2110"], ["02110"], ["2110", "02110", "3"], "R-001", "zip5", 3, "2110", "02110", "Row 3 has 2110 where 02110 is meant, 100% of the time.", None)


def test_each_claim_of_a_reply(spark):
    names = [x.split()[0] for x in REPLY.split(", ")]
    wrong = {"named_rec": ("R-2", "another recommendation"), "cited_row": (4, "row isn't affected"), "cited_before": ("7", "value isn't there"), "cited_after": ("1", "corrected value isn't the engine's"), "proposed_op": ("set_null", "operation differs"), "prose": ("A row of 77 that is not in the file that this is about.", "a number has no evidence"), "confidence": (0.6, "doubt isn't stated")}
    rows = [GOOD] + [tuple(value if n == name else x for n, x in zip(names, GOOD)) for name, (value, _) in wrong.items()] + [(*GOOD[:-2], "short", None), (*GOOD[:-2], "long " * 400, None), (*GOOD[:9], None, None, None, *GOOD[12:])]
    got = [r["failures"] for r in verify.verify_prose(spark.createDataFrame(rows, REPLY).coalesce(1)).collect()]
    assert got == [[], *[[text] for _, text in wrong.values()], ["prose is too short"], ["prose is too long"], []]


def test_each_claim_of_a_choice(spark):
    cells = spark.createDataFrame([("a", k, v) for k, v in enumerate(["Masonry", "Frame", "Masonry", "Joisted Masonry", "Frame"])], "column string, pos int, value string")
    good = ("a", "Const Type", ["Construction", "Occupancy"], "const type", "Construction", "construction type", "category", "masonry", "The values are materials.")
    fields = ["column", "header", "candidates", "named_column", "target", "phrase", "shape", "sample", "reason"]
    wrong = {"named_column": ("Occ", "another column"), "target": ("Country", "not a candidate"), "phrase": ("made up", "no such phrase"), "shape": ("year", "column isn't of the shape"), "sample": ("Brick", "quotes a value that the column lacks"), "reason": (" ", "no reason")}
    rows = [good] + [tuple(v if f == name else x for f, x in zip(fields, good)) for name, (v, _) in wrong.items()] + [tuple("prose" if f == "shape" else x for f, x in zip(fields, good)), tuple("wall type" if f == "phrase" else x for f, x in zip(fields, good))]
    replies = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, column string, header string, candidates array<string>, named_column string, target string, phrase string, shape string, sample string, reason string")
    found = verify.verify_choices(replies, cells, profile.profile(cells, 2026), mapping.glossary(spark))
    got = {r["k"]: r["failures"] for r in found.collect()}
    assert got[0] == [] and got[len(wrong) + 1] == ["no such shape"]
    for k, (name, (_, text)) in enumerate(wrong.items(), 1):
        assert text in got[k], name
    assert got[len(wrong) + 2] in ([], ["phrase isn't like the header"])


def test_replies_in_fences(spark):
    texts = spark.createDataFrame([("```json\n{\"target\": \"City\"}\n```",), ("{\"target\": \"Zip\"}",), ("[1]",), ("none",), (None,)], "t string").coalesce(1)
    assert [r[0] and r[0]["target"] for r in texts.select(verify.parse_reply(texts["t"], "target string")).collect()] == ["City", "Zip", None, None, None]


def test_an_override_leaves_other_columns_their_targets(spark):
    choices = spark.createDataFrame([("s", 0, "City", []), ("s", 1, "Zip", []), ("s", 2, "State", ["no reason"])], "sheet string, column_idx int, target string, failures array<string>")
    mappings = spark.createDataFrame([("s", 0, None), ("s", 5, "Zip")], "sheet string, column_idx int, target string")
    assert [r["column_idx"] for r in verify.overrides(choices, mappings).collect()] == [0]
