"""DuckDB SQL for the queries on the schedule fixture, put together from common table expressions."""

from __future__ import annotations

from gridmend import schema as S
from gridmend.plans.fixture import SOV_SQL

YEAR = 2026
COLS = [c for c in S.COLUMNS if c not in ("county", "country", "other")]
AMOUNTS = [c for c in S.VALUE_COLUMNS if c != "other"]
INTEGERS = S.INTEGER_COLUMNS


def quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def null(c: str) -> str:
    return f"({c} IS NULL OR lower({strip(c)}) IN {among(S.NULL_TOKENS)})"


def render(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {strip(c)} = '' THEN '(empty)' ELSE {c} END"


def number(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS HUGEINT) AS VARCHAR) ELSE rtrim(rtrim(CAST(CAST({v} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.') END"


def amount(c: str) -> str:
    """v_, s_ and r_ of a column: value, status, removed."""
    return f"""
 {strip(c)} AS t_{c}, regexp_matches(t_{c}, '^\\(.*\\)$') AS b_{c},
 CASE WHEN b_{c} THEN regexp_extract(t_{c}, '^\\((.*)\\)$', 1) ELSE t_{c} END AS i_{c},
 regexp_replace(i_{c}, '[$£€¥,\\s]', '', 'g') AS d_{c}, starts_with(d_{c}, '-') AS m_{c},
 CASE WHEN m_{c} THEN substr(d_{c}, 2) ELSE d_{c} END AS e_{c},
 CASE WHEN regexp_matches(e_{c}, '^-?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST(e_{c} AS DOUBLE) END AS n_{c},
 CASE WHEN {null(c)} THEN NULL WHEN b_{c} OR m_{c} THEN -n_{c} ELSE n_{c} END AS v_{c},
 array_to_string(list_sort(list_distinct(regexp_extract_all(i_{c}, '[$£€¥,\\s]'))), '') || CASE WHEN b_{c} THEN '()' ELSE '' END AS x_{c},
 CASE WHEN {null(c)} THEN 'empty' WHEN n_{c} IS NULL THEN 'unparseable'{f" WHEN v_{c} <> floor(v_{c}) THEN 'fractional'" if c in INTEGERS else ""} WHEN x_{c} <> '' THEN 'reformatted' ELSE 'ok' END AS s_{c},
 CASE WHEN {null(c)} OR n_{c} IS NULL THEN '' ELSE x_{c} END AS r_{c}"""


def table(values: dict[str, str], name: str, *columns: str) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in values.items()) + ")"


def state_case(c: str) -> str:
    names = " ".join(f"WHEN lower({strip(c)}) = {quoted(k)} THEN {quoted(v)}" for k, v in S.STATE_NAMES.items())
    return f"CASE WHEN {null(c)} THEN NULL WHEN upper({strip(c)}) IN {among(S.STATE_CODES)} THEN upper({strip(c)}) {names} END"


ZIPS = "zips(st, lo, hi) AS (VALUES " + ", ".join(f"('{s}', {lo}, {hi})" for s, found in S.ZIP_RANGES.items() for lo, hi in found) + ")"
SOV = f"sov AS ({SOV_SQL.replace('{source}', 'customer')})"
CLEAN = f"c AS (SELECT *, {','.join(amount(c) for c in AMOUNTS + INTEGERS)}, {state_case('state')} AS code, replace({strip('zip')}, ' ', '') AS zc FROM sov)"
SHAPE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, {quoted(p)}) THEN {quoted(n)}" for n, p in S.DATE_SHAPES) + " END"
ADDRESS = (
    "array_to_string(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE w "
    + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in S.STREET_WORDS.items() if k != v)
    + " ELSE w END), ' ')"
)
FRAME = "NOT (" + " OR ".join(f"contains(lower({{0}}), {quoted(x)})" for x in S.FRAME_EXCLUSIONS) + ") AND regexp_matches(lower({0}), '\\b(" + "|".join(S.FRAME_TERMS) + ")\\b')"


def with_(body: str, *more: str) -> str:
    return f"WITH {', '.join([SOV, CLEAN, ZIPS, *more])} {body}"


def found(rule: str, column: str | None, where: str, before: str | None = None, after: str = "CAST(NULL AS VARCHAR)", op: str = "CAST(NULL AS VARCHAR)", source: str = "c", field: str | None = None) -> str:
    f = S.FIELD_OF[column] if column else field
    level = "High" if rule == "DQ-01" and f in S.ELEVATED else S.RULES[rule][0]
    return f"SELECT '{rule}' AS rule, sheet_row, {quoted(f) if f else 'CAST(NULL AS VARCHAR)'} AS field, '{level}' AS severity, {render(before or column)} AS before, {after} AS after, {op} AS op FROM {source} WHERE {where}"


def usable(c: str) -> str:
    return f"CASE WHEN s_{c} IN ('ok', 'reformatted') THEN v_{c} END"


def rule_sql(year: int = YEAR) -> dict[str, str]:
    """The findings of each rule over c."""
    union = " UNION ALL ".join
    text = [c for c in COLS if c not in AMOUNTS + INTEGERS]
    digits, leading = "regexp_matches(zc, '^[0-9]+$')", among(S.LEADING_ZERO_STATES)
    z = f"NOT {null('zip')}"
    prefix = "CAST(substr(zc, 1, 3) AS INT)"
    four = "(regexp_matches(zc, '^[0-9]+$') AND length(zc) = 4)"
    after8 = f"CASE WHEN regexp_matches(zc, '^[0-9]{{5}}[-\\s]?[0-9]{{4}}$') THEN substr(zc, 1, 5) WHEN {four} THEN '0' || zc WHEN length(regexp_replace(zc, '[^0-9]', '', 'g')) = 5 THEN regexp_replace(zc, '[^0-9]', '', 'g') END"
    fine8 = f"({digits} AND (length(zc) = 5 OR ({four} AND coalesce(code NOT IN {leading}, false))))"
    st = strip("state")
    code9 = "CASE " + " ".join(f"WHEN lower({st}) = {quoted(k)} THEN {quoted(v)}" for k, v in S.STATE_NAMES.items()) + f" WHEN upper({st}) IN {among(S.STATE_CODES)} THEN upper({st}) END"
    sp = strip("sprinklers")
    key = f"regexp_replace(lower({sp}), '\\.+$', '')"
    figure = f"replace(regexp_replace({sp}, '%+$', ''), ',', '')"
    num = f"CASE WHEN regexp_matches({figure}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST({figure} AS DOUBLE) END"
    share = f"({num}) / CASE WHEN {sp} LIKE '%!%' ESCAPE '!' AND right({sp}, 1) = '%' OR right({sp}, 1) = '%' OR ({num}) > 1 THEN 100.0 ELSE 1.0 END"
    after11 = f"CASE WHEN {key} IN {among(S.SPRINKLER_AMBIGUOUS)} THEN NULL WHEN {share} = 0 THEN 'N' WHEN {share} = 1 THEN 'Y' WHEN ({num}) IS NOT NULL THEN NULL " + " ".join(f"WHEN {key} = {quoted(k)} THEN {quoted(v)}" for k, v in S.SPRINKLER_SPELLINGS.items()) + " END"
    shape = SHAPE.replace("{0}", strip("year_built"))
    return {
        "DQ-01": union([*(found("DQ-01", c, f"s_{c} = 'empty'") for c in AMOUNTS + INTEGERS), *(found("DQ-01", c, null(c)) for c in text)]),
        "DQ-02": union(found("DQ-02", c, f"s_{c} = 'unparseable'") for c in AMOUNTS),
        "DQ-03": union(found("DQ-03", c, f"s_{c} IN ('unparseable', 'fractional')") for c in INTEGERS),
        "DQ-04": union(found("DQ-04", c, f"{usable(c)} < 0") for c in AMOUNTS),
        "DQ-05": found("DQ-05", "year_built", f"{usable('year_built')} NOT BETWEEN {S.EARLIEST_YEAR} AND {year}"),
        "DQ-06": union(found("DQ-06", c, f"{usable(c)} < 1") for c in ("storeys", "number_of_buildings")),
        "DQ-07": found("DQ-07", "zip", f"{z} AND ({four} AND code NOT IN {leading} OR {digits} AND length(zc) = 5 AND code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM zips WHERE st = code AND {prefix} BETWEEN lo AND hi))", strip("zip")).replace("FROM c WHERE", "FROM (SELECT *, CASE WHEN regexp_matches(zc, '^[0-9]+$') THEN zc ELSE '000' END AS zd FROM c) c WHERE").replace("CAST(substr(zc, 1, 3) AS INT)", "CAST(substr(zd, 1, 3) AS INT)"),
        "DQ-08": found("DQ-08", "zip", f"{z} AND NOT {fine8}", strip("zip"), after8, f"CASE WHEN {after8} IS NOT NULL THEN 'zip5' END"),
        "DQ-09": found("DQ-09", "state", f"NOT {null('state')} AND NOT (upper({st}) IN {among(S.STATE_CODES)} AND {st} = upper({st}) AND length({st}) = 2)", st, code9, f"CASE WHEN {code9} IS NOT NULL THEN 'state_to_abbrev' END"),
        "DQ-10": union(found("DQ-10", c, f"s_{c} = 'reformatted'", None, number(f"v_{c}"), "'strip_currency_to_float'") for c in AMOUNTS),
        "DQ-11": found("DQ-11", "sprinklers", f"NOT {null('sprinklers')} AND {sp} NOT IN {among(S.SPRINKLER_CODES)}", None, after11, f"CASE WHEN {after11} IS NOT NULL THEN 'map_values' END"),
        "DQ-12": union([
            found("DQ-12", "year_built", f"v_year_built = 0 OR v_year_built IN ({', '.join(map(str, S.PLACEHOLDER_YEARS))}) AND ny >= {S.PLACEHOLDER_REPEATS}", None, op="'set_null'", source="(SELECT *, count(*) OVER (PARTITION BY v_year_built) AS ny FROM c)"),
            found("DQ-12", "storeys", "v_storeys = 0", None, op="'set_null'"), *(found("DQ-12", c, f"v_{c} = 1", None, op="'set_null'") for c in AMOUNTS)]),
        "DQ-13": found("DQ-13", "address", "address_key <> '' AND n > 1", source=f"(SELECT *, count(*) OVER (PARTITION BY address_key, zip_key) AS n FROM (SELECT *, CASE WHEN {null('address')} THEN '' ELSE {ADDRESS.replace("{0}", 'address')} END AS address_key, CASE WHEN {null('zip')} THEN '' ELSE substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5) END AS zip_key FROM c))"),
        "DQ-14": found("DQ-14", "construction", f"NOT {null('construction')} AND {FRAME.replace("{0}", strip('construction'))} AND v_storeys > {S.MAX_FRAME_STOREYS}", strip("construction")),
        "DQ-17": found("DQ-17", "year_built", "shape IS NOT NULL AND (SELECT count(DISTINCT shape) FROM s17) > 1 AND shape <> (SELECT shape FROM s17 WHERE shape IS NOT NULL GROUP BY shape ORDER BY count(*) DESC, min(sheet_row) LIMIT 1)", None, f"CASE WHEN v_year_built = floor(v_year_built) THEN {number('v_year_built')} END", "CASE WHEN v_year_built = floor(v_year_built) THEN 'to_int' END", source=f"(SELECT *, CASE WHEN NOT {null('year_built')} THEN {shape} END AS shape FROM c)"),
        "DQ-18": union(found("DQ-18", c, f"v_building_value > 0 AND v_{c} > v_building_value * 10", None) for c in ("contents", "bi")),
    }


S17 = f"s17 AS (SELECT sheet_row, CASE WHEN NOT {null('year_built')} THEN {SHAPE.replace("{0}", strip('year_built'))} END AS shape FROM c)"
RULES = rule_sql()
ALL = f"f AS ({' UNION ALL '.join(RULES.values())})"
LOST = "k AS (SELECT * FROM f WHERE NOT (rule IN ('DQ-05', 'DQ-06') AND EXISTS (SELECT 1 FROM f g WHERE g.rule = 'DQ-12' AND g.field = f.field AND g.sheet_row = f.sheet_row)))"
ACTION = "coalesce(CASE op " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, (_, v) in S.OPERATIONS.items()) + " END, 'flag_for_review')"
CONFIDENCE = "coalesce(CASE op " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, (v, _) in S.OPERATIONS.items()) + " END, CASE rule " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, (_, v) in S.RULES.items() if v) + f" END, {S.DEFAULT_FLAG_CONFIDENCE})"
RANK = "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"
RECS = f"""r AS (SELECT 'R-' || lpad(CAST(position AS VARCHAR), 3, '0') AS rec_id, * FROM (
 SELECT CAST(row_number() OVER (ORDER BY {RANK}, rule, coalesce(field, ''), n_findings DESC, coalesce(op, '')) AS INT) AS position, * FROM (
 SELECT rule, field, op, {ACTION} AS action_type, min(severity) AS severity, count(*) AS n_findings, count(DISTINCT sheet_row) AS n_rows, min(sheet_row) AS first_row, max(sheet_row) AS last_row, round(CAST({CONFIDENCE} AS DOUBLE), 2) AS confidence, {CONFIDENCE} < 0.7 AS uncertain FROM k GROUP BY rule, field, op)))"""


def on_findings(body: str, *more: str) -> str:
    return with_(body, S17, ALL, LOST, *more)
