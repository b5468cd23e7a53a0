"""Calls of a model as a stage: retries, the cache, both verifications, and what the audit has."""

import json

from pyspark.sql import functions as F

from gridmend import run
from gridmend.operators import mapping, model, profile, review
from gridmend.scratch import scratch
from gridmend.sources import grid


def counting(tmp_path, answer, fail=0):
    """A model that leaves a file for each call; the first `fail` calls of a prompt fail."""
    folder = str(tmp_path)

    def ask(system, user):
        import hashlib
        import os
        import uuid

        key = hashlib.md5(user.encode()).hexdigest()
        before = len([x for x in os.listdir(folder) if x.startswith(key)])
        open(f"{folder}/{key}-{uuid.uuid4().hex}", "w").close()
        if before < fail:
            raise TimeoutError("busy")
        return answer(json.loads(user))

    return ask


def test_prompts_are_asked_once_and_kept(spark, tmp_path):
    asked = spark.createDataFrame([(k, json.dumps({"k": k % 3})) for k in range(30)], "id int, prompt string").repartition(4)
    cache = scratch(spark, "cache")
    ask = counting(tmp_path, lambda x: str(x["k"]), fail=1)
    first = model.ask_all(asked, ask, "s", cache, tries=2).collect()
    assert {(r["id"] % 3, r["reply"], r["tries"]) for r in first} == {(0, "0", 2), (1, "1", 2), (2, "2", 2)} and len(list(tmp_path.iterdir())) == 6
    again = model.ask_all(asked, ask, "s", cache).collect()
    assert {r["tries"] for r in again} == {0} and len(list(tmp_path.iterdir())) == 6

    def broken(system, user):
        raise ValueError("no")

    bad = model.ask_all(asked, broken, "other", cache, tries=1).collect()
    assert {(r["reply"], r["error"]) for r in bad} == {(None, "ValueError: no")}


def test_reasoning_keeps_only_what_holds(spark, tmp_path):
    rules = ["DQ-05", "DQ-07", "DQ-11", "DQ-13", "DQ-14", "DQ-16", "DQ-18", "DQ-03"]
    found = spark.createDataFrame([(f, rule, row, "Zip", "High", f"v{row}", None, None) for f in ("a", "b") for rule in rules for row in range(3, 40)], "file_id string, rule string, sheet_row long, field string, severity string, before string, after string, op string")
    recs = review.recommendations(found)
    wanted = model.eligible(recs)
    assert {r["file_id"]: r["count"] for r in wanted.groupBy("file_id").count().collect()} == {"a": 6, "b": 6}
    assert wanted.filter("confidence >= 0.7").isEmpty()

    def answer(x):
        if x["rec_id"] == "R-002":
            return "no json"
        good = {"named_rec": x["rec_id"], "cited_row": x["rows"][0], "prose": f"Row {x['rows'][0]} and others hold values that nobody can read as they stand.", "doubt": "A person should look."}
        return "```json\n" + json.dumps(good | ({"cited_row": 999} if x["rec_id"] == "R-003" else {})) + "\n```"

    out, audit = model.reason(recs, found, counting(tmp_path, answer))
    said = {(r["file_id"], r["rec_id"]): r["prose"] for r in out.collect()}
    log = {(r["file_id"], r["rec_id"]): r for r in audit.collect()}
    assert len(said) == 16 and len(log) == 12
    for key, row in log.items():
        assert (said[key] is not None) == row["accepted"] and row["stage"] == "reasoning"
        assert row["failures"] == {"R-002": ["not a JSON object"], "R-003": ["row isn't affected"]}.get(key[1], [])
    assert sum(row["accepted"] for row in log.values()) >= 6 and model.reason(recs, found, None) == (recs, None)


def test_adjudication_changes_a_close_column(spark, tmp_path):
    cells = spark.createDataFrame([("s", 0, k, v) for k, v in enumerate(["Masonry", "Frame", "Masonry", "Joisted Masonry", "Frame"])] + [("s", 1, k, "Boston") for k in range(5)], "sheet string, column_idx int, pos int, value string")
    maps = spark.createDataFrame([("s", 0, "Const Type", "Occupancy", 0.6, 0.01, "Construction", 0.5, "fused"), ("s", 1, "Place", "City", 0.6, 0.02, "County", 0.5, "fused"), ("s", 2, "Cnty", "County", 0.9, 0.5, "City", 0.9, "exact")], "sheet string, column_idx int, header string, target string, fused double, margin double, runner_up string, confidence double, method string")
    profiled = profile.profile(cells.select(model.column_key().alias("column"), "pos", "value"), 2026)

    def answer(x):
        good = {"named_column": x["header"], "target": x["candidates"][1], "reason": "Its values are of that kind."}
        return json.dumps(good | {"sample": "masonry"} if x["header"] == "Const Type" else good)

    out, audit = model.adjudicate(maps, cells, profiled, mapping.glossary(spark), counting(tmp_path, answer))
    got = {r["column_idx"]: (r["target"], r["method"]) for r in out.collect()}
    assert got == {0: ("Construction", "adjudicated"), 1: ("City", "fused"), 2: ("County", "exact")}  # County is another column's
    assert {r["column_idx"]: r["accepted"] for r in audit.collect()} == {0: True, 1: True}
    lies = counting(tmp_path, lambda x: json.dumps({"named_column": x["header"], "target": x["candidates"][1], "reason": "r", "sample": "none such"}))
    out, audit = model.adjudicate(maps, cells, profiled, mapping.glossary(spark), lies)
    assert {r["target"] for r in out.collect()} == {"Occupancy", "City", "County"} and audit.filter("accepted").isEmpty()
    assert audit.filter(F.array_contains("failures", "quotes a value that the column lacks")).count() == 2


def test_a_run_with_a_model(spark, tmp_path):
    """The stages between mapping, assessment and review; another session finds the model's words and the audit of its calls."""
    (tmp_path / "calls").mkdir()
    rows = [["Loc #", "Street Address", "Const", "Occ", "Bldg Value", "Yr Built"]] + [[f"L{k}", f"{k} Main Street", "Frame", "Office", str(500_000 + k), "3015" if k == 3 else str(1950 + k)] for k in range(8)]
    (tmp_path / "m.xlsx").write_bytes(grid.write_xlsx(rows))

    def answer(x):
        if "rec_id" in x:
            return json.dumps({"named_rec": x["rec_id"], "prose": "The values that are shown can't be what was meant by whoever wrote them.", "doubt": "A person should look."})
        return json.dumps({"named_column": x["header"], "target": x["candidates"][0], "reason": "It reads like that."})

    ask, out = counting(tmp_path / "calls", answer), f"file://{tmp_path}/out"
    r = run.map_columns(run.find_sheets(run.read(spark, f"file://{tmp_path}/m.xlsx", 2026, "m", out)))
    before = {x["column_idx"]: x["target"] for x in r.mappings.collect()}
    run.adjudicate(r, ask)
    assert {x["column_idx"]: x["target"] for x in r.mappings.collect()} == before and r.opinions.count() == mapping.low_margin(r.mappings).count()
    run.reason(run.assess(r), ask)
    again = run.resume(spark, out, "m")
    said = {x["rule"]: x["prose"] for x in again.recommendations.collect()}
    assert said["DQ-05"] and again.reasons.filter("accepted").count() == sum(p is not None for p in said.values())
    assert run.clean(run.decide(again)).cleaned.count() == 8
