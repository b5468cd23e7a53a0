"""DuckDB SQL of the queries that find headers and score sheets: which texts name a target, the factors of each candidate, and the sheets' scores.

Texts that name a target only by likeness of letters have no SQL form; the schedules have none in the rows that are scanned, which `match_target` checks.
"""

from __future__ import annotations

import re

from gridmend.operators import mapping as M
from gridmend.operators import sheets as SH
from gridmend.plans import oracle as O

KIND = f"CASE WHEN regexp_matches({O.strip('value')}, '^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\s*%?\\s*\\)?$|^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]+(?:\\.[0-9]+)?\\s*%?\\s*\\)?$') THEN 'number' ELSE 'text' END"
NORMAL = "trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'))"
_plain = lambda p: re.sub("[^a-z0-9]+", " ", p.lower()).strip()
_PHRASES = ", ".join(f"({O.quoted(t)}, {k}, {r}, {O.quoted(_plain(p))})" for t, k, p, r in M.glossary_rows())


def matches(scan: str) -> str:
    """m: (value, target) of the texts of g in the rows scanned."""
    return f"""ph(target, ordinal, rank, p) AS (VALUES {_PHRASES}),
 tx AS (SELECT DISTINCT value, {NORMAL} AS t FROM g WHERE {scan}),
 sc AS (SELECT value, target, ordinal, rank, CASE WHEN t = p THEN 2.0 WHEN len(tw) <= {M.MAX_TOKENS} AND len(list_filter(pw, lambda x: NOT list_contains(tw, x))) = 0 AND len(pw) / len(tw) >= {M.MIN_SHARE} THEN 0.9 + 0.1 * (len(pw) / len(tw)) END AS s
  FROM (SELECT *, list_distinct(string_split(t, ' ')) AS tw, list_distinct(string_split(p, ' ')) AS pw FROM tx, ph WHERE t <> '')),
 m AS (SELECT value, target FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY s DESC, ordinal, rank) AS k FROM sc WHERE s IS NOT NULL) WHERE k = 1)"""


_LONG = "MAP {" + ", ".join(f"{O.quoted(k)}: {O.quoted(v)}" for k, v in M.ABBREVIATIONS.items()) + "}"
_MASKS = "list_transform(string_split(wl, ''), lambda c: CAST(list_sum(list_transform(range(length(wr)), lambda i: CASE WHEN wr[i + 1] = c THEN CAST(1 AS BIGINT) << CAST(i AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS BIGINT))"
#: lx: (header, target, ordinal, lexical, phrase, exact) of all pairs of a header of hs and a phrase; a subsequence's length by rows of bits
LEXICAL = f"""gp(target, ordinal, rank, phrase, p) AS (VALUES {", ".join(f"({O.quoted(t)}, {k}, {r}, {O.quoted(p)}, {O.quoted(_plain(p))})" for t, k, p, r in M.glossary_rows())}),
 hn AS (SELECT header, {NORMAL.replace("value", "header")} AS bare FROM (SELECT DISTINCT header FROM hs)),
 hl AS (SELECT header, bare, array_to_string(list_transform(string_split(bare, ' '), lambda w: concat_ws(' ', w, {_LONG}[w])), ' ') AS long FROM hn),
 pw AS (SELECT *, list_sort(list_distinct(string_split(long, ' '))) AS x, list_sort(list_distinct(string_split(p, ' '))) AS y FROM hl, gp),
 pb AS (SELECT *, list_filter(x, lambda w: list_contains(y, w)) AS b, list_filter(x, lambda w: NOT list_contains(y, w)) AS xl, list_filter(y, lambda w: NOT list_contains(x, w)) AS yr FROM pw),
 pt AS (SELECT *, array_to_string(b || xl, ' ') AS wl, array_to_string(b || yr, ' ') AS wr, length(array_to_string(b, ' ')) AS nb FROM pb),
 pm AS (SELECT *, (CAST(1 AS BIGINT) << CAST(length(wr) AS BIGINT)) - 1 AS full_row, {_MASKS} AS masks FROM pt),
 pc AS (SELECT *, length(wr) - bit_count(list_reduce(masks, lambda v, m: ((v + (v & m)) | (v - (v & m))) & full_row, full_row)) AS n FROM pm),
 sx AS (SELECT *, bare = p AS exact, CASE WHEN bare = p THEN 1.0 WHEN long = '' THEN 0.0 WHEN nb > 0 AND (len(xl) = 0 OR len(yr) = 0) THEN 1.0
  ELSE greatest(2 * n / (length(wl) + length(wr)), CASE WHEN nb > 0 THEN greatest(2 * nb / (nb + length(wl)), 2 * nb / (nb + length(wr))) ELSE 0.0 END) END AS s FROM pc),
 lx AS (SELECT header, target, ordinal, round(s, 4) AS lexical, phrase, exact FROM (SELECT *, row_number() OVER (PARTITION BY header, target ORDER BY exact DESC, s DESC, rank) AS k FROM sx) WHERE k = 1)"""


#: ca: each candidate's factors; needs g and m
CANDIDATES = f"""rw AS (SELECT sheet, row_idx, n_cols, count(*) AS filled, count(DISTINCT {NORMAL}) AS different FROM g WHERE row_idx < {SH.SCAN} GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT {NORMAL}) / count(*) >= {SH.MIN_UNIQUE}),
 ce AS (SELECT sheet, row_idx, {NORMAL} AS t, arg_min({KIND}, col_idx) AS kind, max(target) AS target FROM g LEFT JOIN m USING (value) WHERE row_idx < {SH.SCAN} GROUP BY ALL),
 br AS (SELECT sheet, row_idx, avg(CASE WHEN kind = 'text' THEN 1.0 ELSE 0.0 END) AS label_density, avg(CASE WHEN target IS NOT NULL THEN 1.0 ELSE 0.0 END) AS vocabulary FROM ce GROUP BY ALL),
 st AS (SELECT sheet, row_idx, avg(share) AS type_consistency FROM (SELECT sheet, row_idx, col_idx, max(n) / sum(n) AS share FROM (SELECT rw.sheet, rw.row_idx, g.col_idx, {KIND} AS kind, count(*) AS n FROM rw JOIN g ON g.sheet = rw.sheet AND g.row_idx > rw.row_idx GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
 ca AS (SELECT *, {" + ".join(f"{w} * {k}" for k, w in SH.HEADER_WEIGHTS.items())} AS score FROM (SELECT sheet, row_idx, label_density, filled / n_cols AS fill, different / filled AS uniqueness, coalesce(type_consistency, 0.0) AS type_consistency, vocabulary FROM rw JOIN br USING (sheet, row_idx) LEFT JOIN st USING (sheet, row_idx)))"""

_PARTS = ["header_density", "type_consistency", "null_ratio", "row_continuity", "vocabulary_overlap", "data_scale"]
#: ss: each sheet's factors and score; needs g, m, ca and hd(sheet, header_row)
SCORES = f"""bd AS (SELECT g.*, header_row + 1 AS start FROM g JOIN hd USING (sheet) WHERE row_idx > header_row),
 rq AS (SELECT sheet, count(DISTINCT row_idx) AS data_rows, count(*) / (count(DISTINCT row_idx) * max(n_cols)) AS null_ratio, count(DISTINCT row_idx) / (max(n_rows) - max(start)) AS row_continuity FROM bd GROUP BY sheet),
 tc AS (SELECT sheet, avg(share) AS type_consistency FROM (SELECT sheet, col_idx, max(n) / sum(n) AS share FROM (SELECT sheet, col_idx, {KIND} AS kind, count(*) AS n FROM bd GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
 vo AS (SELECT sheet, count(DISTINCT target) / {SH.N_TARGETS} AS vocabulary_overlap FROM g JOIN hd USING (sheet) JOIN m USING (value) WHERE row_idx = header_row GROUP BY sheet),
 sf AS (SELECT sheet, CAST(data_rows AS BIGINT) AS data_rows, round(ca.score, 3) AS header_density, round(tc.type_consistency, 3) AS type_consistency, round(null_ratio, 3) AS null_ratio, round(row_continuity, 3) AS row_continuity, round(coalesce(vocabulary_overlap, 0), 3) AS vocabulary_overlap, round(least(1.0, log10(data_rows + 1) / log10({1.0 + SH.FULL_SCALE})), 3) AS data_scale
  FROM hd JOIN ca ON ca.sheet = hd.sheet AND ca.row_idx = hd.header_row JOIN rq ON rq.sheet = hd.sheet JOIN tc ON tc.sheet = hd.sheet LEFT JOIN vo ON vo.sheet = hd.sheet),
 ss AS (SELECT *, round({" + ".join(f"{k} * {SH.SHEET_WEIGHTS[k]}" for k in _PARTS)}, 3) AS score FROM sf)"""
SCORES = SCORES.replace("SELECT sheet, CAST(data_rows", "SELECT hd.sheet, CAST(data_rows")

CLASSES = """SELECT sheet, CASE WHEN k = 1 THEN 'Primary' WHEN secondary THEN 'Secondary' ELSE 'Reject' END AS class,
 round(greatest(0.0, least(1.0, CASE WHEN k = 1 THEN score + 0.5 * (score - coalesce(nxt, 0.0)) WHEN secondary THEN score ELSE 1 - (0.7 * vocabulary_overlap + 0.3 * score) END)), 3) AS confidence, score
 FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt, score >= 0.40 AND data_rows >= 2 AND header_density > 0 AND vocabulary_overlap >= 0.15 AS secondary FROM ss WINDOW w AS (ORDER BY score DESC, data_rows DESC, sheet))"""


def varied(sov: str, columns: list[str], words: list[list[str]], doubled: tuple[int, int]) -> str:
    """cells of the sheets whose headers are elsewhere, in other words and in another order, a third of them in two lines."""
    head = lambda k: f"CASE WHEN n % 2 = 0 THEN {O.quoted(words[0][k])} ELSE {O.quoted(words[1][k])} END"
    own = " UNION ALL ".join(f"SELECT n, row_idx, ({k} + n) % 9 AS col_idx, {c} AS value FROM vb" for k, c in enumerate(columns))
    top = " UNION ALL ".join(f"SELECT n, n, ({k} + n) % 9, " + (f"CASE WHEN two = 1 THEN 'Values' ELSE {head(k)} END" if k in doubled else head(k)) + " FROM vs" for k in range(9))
    sub = " UNION ALL ".join(f"SELECT n, n + 1, ({k} + n) % 9, {head(k)} FROM vs WHERE two = 1" for k in doubled)
    return f"""sov AS ({sov}), vb AS (SELECT c_nationkey AS n, CAST(c_nationkey % 3 = 0 AS INT) + c_nationkey + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_idx, sov.* FROM sov JOIN customer ON sheet_row = c_custkey + 2),
 vs AS (SELECT DISTINCT n, CAST(n % 3 = 0 AS INT) AS two FROM vb),
 vc AS ({own} UNION ALL SELECT n, row_idx, 9, 'see file' FROM vb UNION ALL {top} UNION ALL {sub} UNION ALL SELECT n, r, 0, 'Part ' || r FROM (SELECT n, unnest(range(n)) AS r FROM vs)),
 cells AS (SELECT CAST(n AS VARCHAR) AS sheet, CAST(row_idx AS INT) AS row_idx, CAST(col_idx AS INT) AS col_idx, value FROM vc), hd AS (SELECT CAST(n AS VARCHAR) AS sheet, n AS header_row FROM vs)"""
