"""Some queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["clean_amount", "dq07", "dq11", "dq12", "reconcile", "recommendations", "completeness", "quality_score", "audit_diff", "profile_column", "nearest_decisions", "lexical_match", "misspelt_headers"]


def rounded(rows):
    return sorted([tuple(round(float(x), 4) if isinstance(x, float) or hasattr(x, "quantize") else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    rows = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert rounded([tuple(r[c] for c in cols) for r in df.collect()]) == rounded(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 10
