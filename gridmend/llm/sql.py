"""DuckDB SQL of the operators that SQL can express, for small tables.

op1: while a group has fewer documents than a sketch has room for, its quantiles are exact, and so are those here. op7: MinHash
misses a pair at the threshold with a chance of 1 in 2,000; there and here all found pairs are verified in full. op11 to op13: as they are.
"""

import string

from .collocations import MIN_COUNT, SCALE, SHARE, TOP as BEST
from .line_dedup import MIN_CHARS, MIN_DOCS
from .prefix_trie import BLOCK, BLOCK_TURNS
from .quality_rules import FLOORS, LEAST_SPREAD, MARKS, MIN_GROUP, REACH, SYMBOLS, TAIL, TOP

_RATIO = {"symbols": "n_symbols / n_words", "marks": "n_marks / n_words", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / n_words", "word_length": "word_chars / n_words"}


def _levels(tag: str, rows: str, fence) -> str:
    """Fences of (lang, source), lang and all from rows; each group takes the first level with enough rows."""
    def level(name: str, *keys: str) -> str:
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        return f"{tag}{name} AS (SELECT {''.join(k + ', ' for k in keys)}{', '.join(f'{fence(r)} AS {r}' for r in _RATIO)} FROM {rows} {group} HAVING count(*) >= {MIN_GROUP if keys else 1})"

    chosen = ", ".join(f"coalesce(o.{r}, l.{r}, a.{r}) AS {r}" for r in _RATIO)
    joined = f"grp LEFT JOIN {tag}o o ON grp.lang IS NOT DISTINCT FROM o.lang AND grp.source IS NOT DISTINCT FROM o.source LEFT JOIN {tag}l l ON grp.lang IS NOT DISTINCT FROM l.lang LEFT JOIN {tag}a a ON true"
    return f"{level('a')}, {level('l', 'lang')}, {level('o', 'lang', 'source')}, {tag} AS (SELECT grp.lang, grp.source, {chosen} FROM {joined})"


_FIRST = _levels("f1", "seen", lambda r: f"quantile_disc({r}, 0.75) + greatest({REACH} * (quantile_disc({r}, 0.75) - quantile_disc({r}, 0.5)), {LEAST_SPREAD[r]})")
_SECOND = _levels("f2", "usual", lambda r: f"quantile_disc({r}, {TOP}) + greatest({TAIL} * (quantile_disc({r}, {TOP}) - quantile_disc({r}, 0.5)), {FLOORS[r]})")
_SAME = "x.lang IS NOT DISTINCT FROM {0}.lang AND x.source IS NOT DISTINCT FROM {0}.source"

OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 g AS (SELECT rid, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS tri FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
 c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g WHERE tri IS NOT NULL),
 v AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n >= 2) GROUP BY rid),
 st AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '{MARKS}', '', 'g')) AS BIGINT) AS n_marks, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN v USING (rid)),
 grp AS (SELECT DISTINCT lang, source FROM st),
 seen AS (SELECT lang, source, {', '.join(f'({x})::DOUBLE AS {r}' for r, x in _RATIO.items())} FROM st WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words),
 {_FIRST},
 usual AS (SELECT x.* FROM seen x JOIN f1 ON {_SAME.format('f1')} WHERE {' AND '.join(f'x.{r} <= f1.{r}' for r in _RATIO)}),
 {_SECOND}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN false ELSE {' AND '.join(f'({x}) <= coalesce(f2.{r}, f1.{r})' for r, x in _RATIO.items())} END AS kept
FROM st x JOIN f1 ON {_SAME.format('f1')} JOIN f2 ON {_SAME.format('f2')}"""

OP7 = r"""WITH RECURSIVE d AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 u AS (SELECT text, any_value(ws) AS ws, min(doc_id) AS rep, count(*) AS n_copies FROM d WHERE len(ws) > 0 GROUP BY text),
 g AS (SELECT DISTINCT rep, array_to_string(ws[k : k + 4], ' ') AS gram FROM (SELECT rep, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM u)),
 n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
 e AS (SELECT x.rep AS a, y.rep AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rep <> y.rep GROUP BY x.rep, y.rep
  HAVING 5 * count(*) >= 4 * ((SELECT n FROM n WHERE n.rep = x.rep) + (SELECT n FROM n WHERE n.rep = y.rep) - count(*))),
 r AS (SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 k AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
 m AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(u.n_copies, 1) AS BIGINT) AS n_copies
FROM d LEFT JOIN u ON d.text = u.text LEFT JOIN k ON k.rep = u.rep LEFT JOIN m ON m.rep = u.rep"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
 k AS (SELECT *, translate(trim(line, {_WHITE}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
 r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
 g AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""

# crc32 bit by bit, as the database has no function for it
_CRC_BYTE = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {_CRC_BYTE}), 4294967295)"

OP12 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) || lpad(length(text)::VARCHAR, 10, '0') ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS ids, {_CRC} % {BLOCK_TURNS} AS h FROM t GROUP BY conv_id),
 s AS (SELECT o.conv_id, list_concat(coalesce(b.ids[1 : o.h], []), o.ids[o.h + 1 :]) AS ids FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % {BLOCK}),
 m AS (SELECT conv_id, d, len(ids) AS size, array_to_string(ids[1 : d], '') AS p, array_to_string(ids[1 : d - 1], '') AS up, CASE WHEN d > 0 THEN right(ids[d], 10)::BIGINT ELSE 0 END AS chars FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM s)),
 n AS (SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(size) = d AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM m GROUP BY p, d),
 k AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
 a AS (SELECT left(p, j * 42) AS p, j AS d, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM (SELECT *, unnest(generate_series(0, d)) AS j FROM n) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON a.p = n.p AND a.d = n.d LEFT JOIN k ON k.up = n.p AND k.d = n.d LEFT JOIN n q ON n.d > 0 AND q.p = n.up AND q.d = n.d - 1"""

_CUT_SCORE = f"CAST(a::HUGEINT * a * {SCALE} // ({{l}}::HUGEINT * {{r}}) AS BIGINT)"

OP13 = rf"""WITH p AS (SELECT row_number() OVER () AS pid, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?
-]')) AS piece FROM documents)),
 w AS (SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT pid, lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p)),
 g AS (SELECT lang, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY pid ORDER BY i)),
 u AS (SELECT lang, w, count(*) AS f FROM g GROUP BY ALL), b AS (SELECT lang, w, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL), t AS (SELECT lang, w, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
 two AS (SELECT b.lang, b.w || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, b.w, b.w2 FROM b JOIN u x ON x.lang = b.lang AND x.w = b.w JOIN u y ON y.lang = b.lang AND y.w = b.w2 WHERE b.f >= {MIN_COUNT}),
 held AS (SELECT lang, w, w2, max(f) AS f FROM (SELECT lang, w, w2, f FROM t UNION ALL SELECT lang, w2, w3, f FROM t) GROUP BY ALL),
 parts AS (SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, y.f AS r1, z.f AS l2, v.f AS r2 FROM t JOIN u x ON x.lang = t.lang AND x.w = t.w JOIN b y ON y.lang = t.lang AND y.w = t.w2 AND y.w2 = t.w3 JOIN b z ON z.lang = t.lang AND z.w = t.w AND z.w2 = t.w2 JOIN u v ON v.lang = t.lang AND v.w = t.w3),
 three AS (SELECT *, {_CUT_SCORE.format(l='l1', r='r1')} AS s1, {_CUT_SCORE.format(l='l2', r='r2')} AS s2 FROM parts),
 c AS (SELECT two.lang, phrase, a, l, r, {_CUT_SCORE.format(l='l', r='r')} AS score FROM two LEFT JOIN held h ON h.lang = two.lang AND h.w = two.w AND h.w2 = two.w2 WHERE h.f IS NULL OR 100 * h.f < {SHARE} * a
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three),
 k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM c)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM k JOIN (SELECT lang, sum(f) AS n FROM u GROUP BY lang) USING (lang) WHERE rank <= {BEST}"""

QUERIES = {"op1_quality_rules": OP1, "op7_ngram_join": OP7, "op11_line_dedup": OP11, "op12_prefix_trie": OP12, "op13_collocations": OP13}
