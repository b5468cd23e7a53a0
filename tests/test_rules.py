"""Cases of each rule with the look-alikes that it leaves alone, and invariants of the review queue and the transformation."""

import pytest
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.operators import frame as FR
from gridmend.operators import mapping, profile, review, rules, score, transform


def table(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(k + 2, *[columns[c][k] for c in columns]) for k in range(n)]
    return spark.createDataFrame(rows, "sheet_row long, " + ", ".join(f"{c} string" for c in columns))


def hits(df, rule, year=2026):
    return sorted((r["sheet_row"], r["field"], r["after"]) for r in rules.run_rules(df, year, [rule]).collect())


def test_missing_values(spark):
    df = table(spark, contents=["100", None, "", "N/A", "250", "  "])
    assert [r for r, _, _ in hits(df, "DQ-01")] == [3, 4, 5, 7]


def test_amounts(spark):
    df = FR.with_clean(table(spark, building_value=["$2,100,000.00", "(45,000)", "1e5", "--45", "12", "see"]))
    got = [(r["v"], r["s"], r["r"]) for r in df.orderBy("sheet_row").select(F.col("c_building_value.value").alias("v"), F.col("c_building_value.status").alias("s"), F.col("c_building_value.removed").alias("r")).collect()]
    assert got == [(2100000.0, "reformatted", "$,"), (-45000.0, "reformatted", ",()"), (None, "unparseable", ""), (45.0, "ok", ""), (12.0, "ok", ""), (None, "unparseable", "")]


@pytest.mark.parametrize(("zip_", "state", "seven", "eight"), [("2110", "MA", 0, 1), ("7520", "TX", 1, 0), ("00802", "VI", 0, 0), ("73301", "TX", 0, 0), ("06390", "NY", 0, 0), ("75502", "AR", 0, 0), ("90210", "NY", 1, 0), ("02110-1234", "MA", 0, 1), ("90210", "Atlantis", 0, 0)])
def test_zip_and_state(spark, zip_, state, seven, eight):
    df = table(spark, zip=[zip_], state=[state])
    assert (len(hits(df, "DQ-07")), len(hits(df, "DQ-08"))) == (seven, eight)


def test_states(spark):
    df = table(spark, state=["TX", "tx", "Texas", "V.I.", "ZZ", None])
    assert hits(df, "DQ-09") == [(3, "State", "TX"), (4, "State", "TX"), (5, "State", "VI"), (6, "State", None)]


def test_sprinklers(spark):
    df = table(spark, sprinklers=["Yes", "Partial", "0", "100%", "13", "NFPA 13R", "None", "halon", "Y"])
    assert hits(df, "DQ-11") == [(r, "Fire Sprinklers (Y/N)", a) for r, a in ((2, "Y"), (3, None), (4, "N"), (5, "Y"), (6, None), (7, "Y(13R)"), (9, None))]


def test_placeholders_need_repeats(spark):
    assert hits(table(spark, year_built=["1900", "1990"]), "DQ-12") == []
    assert len(hits(table(spark, year_built=["1900"] * 3 + ["0"]), "DQ-12")) == 4


def test_duplicate_locations(spark):
    df = table(spark, address=["100 Main Street", "100 Main St.", "1000 Main St"], zip=["02110", "02110", "02110"], reference=["a", "b", "c"])
    assert [r for r, _, _ in hits(df, "DQ-13")] == [2, 3]
    assert rules.duplicate_groups(df).collect()[0]["distinct_references"] is True


def test_frame_height(spark):
    df = table(spark, construction=["Wood Frame", "Steel Frame", "Masonry Non-Combustible (ISO 4)", "frame"], storeys=["14", "14", "14", "6"])
    assert [r for r, _, _ in hits(df, "DQ-14")] == [2]


def test_totals_row(spark):
    df = table(spark, reference=["a", "b", "Grand Total"], building_value=["100", "200", "300"], contents=["10", "20", "30"])
    assert [r for r, _, _ in hits(df, "DQ-15")] == [4]
    assert hits(table(spark, building_value=["100", "100"]), "DQ-15") == []


def test_stated_total(spark):
    df = table(spark, building_value=["2000000", "100"], contents=["1000000", "5"], tiv=["2200000", "105"])
    assert [r for r, _, _ in hits(df, "DQ-16")] == [2]


def test_mixed_dates(spark):
    df = table(spark, year_built=["1990", "1991", "01/01/1990", "1920's"])
    assert [r for r, _, _ in hits(df, "DQ-17")] == [4, 5]
    assert hits(table(spark, year_built=["01/01/1990", "02/02/1991"]), "DQ-17") == []


def test_placeholder_supersedes_range(spark):
    found = review.reconcile(rules.run_rules(table(spark, storeys=["0", "3"], year_built=["0", "1980"]), 2026))
    assert {(r["rule"], r["field"]) for r in found.collect()} == {("DQ-12", "Storeys"), ("DQ-12", "Year Built")}


def test_every_rule_runs_or_says_why(spark):
    df = table(spark, zip=["1"])
    rows = rules.rule_status(df, rules.run_rules(df, 2026)).collect()
    assert len(rows) == 18 and all(r["evaluated"] != bool(r["reason"]) for r in rows)


def test_empty_frame(spark):
    df = table(spark, building_value=["1"], state=["TX"]).filter("false")
    found = rules.run_rules(df, 2026)
    assert found.count() == 0 and score.quality_score(score.completeness(df), found).first()["validity"] == 1.0


def test_apply_and_audit(spark):
    df = table(spark, state=["tx", "MA"], building_value=["$5", "7"], sprinklers=["Yes", "1.5"], storeys=["1.5", "2"])
    found = review.reconcile(rules.run_rules(df, 2026))
    recs = review.recommendations(found)
    accept = recs.filter("op is not null").selectExpr("rec_id", "'accept' decision", "cast(null as string) edited_op", "'me' reviewer")
    done = transform.apply_decisions(recs, accept)
    cleaned, audit = transform.transform(df, found, done)
    first = cleaned.orderBy("sheet_row").first()
    assert (first["state"], first["building_value"], first["sprinklers"], first["storeys"]) == ("TX", "5", "Y", "1.5")
    assert sorted(r["field"] for r in audit.collect()) == ["Building Value", "Fire Sprinklers (Y/N)", "State"]
    none = transform.apply_decisions(recs, accept.filter("false"))
    assert transform.transform(df, found, none)[1].count() == 0 and not transform.all_decided(none)
    assert review.invalid(recs, found).count() == 0


def test_unsupported_operation(spark):
    df = table(spark, state=["tx"])
    found = review.reconcile(rules.run_rules(df, 2026))
    recs = review.recommendations(found)
    edit = recs.filter("rule = 'DQ-09'").selectExpr("rec_id", "'edit' decision", "'rename' edited_op", "'me' reviewer")
    with pytest.raises(transform.NotSupported):
        transform.transform(df, found, transform.apply_decisions(recs, edit))


def test_row_rules_stay_in_the_jvm_and_scan_once(spark):
    df = table(spark, **{c: ["1"] for c in S.COLUMNS})
    names = [r.name for r in rules.REGISTRY if not r.across_rows]
    plan = rules.run_rules(df, 2026, names)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Scan") == 1


def test_assignment_and_ratio():
    import numpy as np

    gain = np.array([[0.9, 0.8, 0.0], [0.85, 0.1, 0.0]])
    assert mapping.best_assignment(gain).tolist() == [1, 0]
    assert round(mapping.token_set_ratio("sprink", "sprinkler"), 2) == 0.8
    assert mapping.token_set_ratio("building value", "value") == 1.0


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in [(3, 5), (5, 5), (4, 3), (1, 1)]:
        gain = rng.random((n, m)).round(2)
        got = mapping.best_assignment(gain)
        total = sum(gain[i, j] for i, j in enumerate(got) if j >= 0)
        best = max(sum(gain[i, j] for i, j in zip(rows, cols)) for k in [min(n, m)] for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(total - best) < 1e-9 and len({j for j in got if j >= 0}) == min(n, m)


def test_digits_of_zips_and_amounts(spark):
    df = table(spark, a=["29640"] * 3, b=["1000", "20000", "500"], c=["02110", "1", "7"])
    got = {r["column"]: r["digits_are"] for r in profile.resolve_digits(profile.cells(df, ["a", "b", "c"]), 2026).collect()}
    assert got["a"] == "zip" and got["b"] == "currency"


def test_a_hot_location_is_split(spark):
    """A third of all rows at one address: the join that gives them their findings may be split."""
    settings = {"skewJoin.skewedPartitionThresholdInBytes": "20k", "advisoryPartitionSizeInBytes": "10k", "skewJoin.skewedPartitionFactor": "1.2", "coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}", None) for k in settings}
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.range(9000).selectExpr("id AS sheet_row", "if(id % 3 = 0, '1 Main Street', concat(id div 2, ' Oak Avenue')) address", "'02110' zip", "concat('L', id) reference").repartition(6)
        found = rules.run_rules(df, 2026, ["DQ-13"])
        rows = found.collect()
        assert len(rows) >= 3000 and "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.adaptive.{k}") if v is None else spark.conf.set(f"spark.sql.adaptive.{k}", v)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
