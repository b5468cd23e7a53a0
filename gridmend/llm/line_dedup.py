"""Line dedup: lines that many documents have go, except in the last document that has them.

A text is cut at newlines. A line's key is the line without white space (0x20, 0x09-0x0D) at its ends and with A-Z in lower case.
Lines are exploded with their positions, and the MD5s of keys of `min_chars` code points or more counted, in two steps: by rows, with partial
sums, which leaves the few keys that `min_docs` rows have; then, for those only, by distinct documents, with the largest doc_id
that has the key. A document gets the positions of its lines to drop, and the lines that stay are joined again by position.

What is shuffled of all lines is a hash and a count, then (key, document, position) of the shared ones if their keys are too many to
broadcast, and each text once, as its lines. No key gathers its documents in one place: counts and the largest id are partial
aggregates, and the joins by key have sides that adaptive execution can split.

Result: the rows of docs, with text the text that stays, n_chars its length, n_lines (before dropping) and n_dropped.

Defined results: a null text stays null, an empty one empty; both count as one line. A text of which no line stays is empty. Rows that share a
doc_id count as one document; so do all rows without one, which comes before all others. Integer doc_ids are ordered as numbers, others as
strings. Equal rows lose the same lines. Other columns pass through; ones named like new ones are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, digest, join_small

MIN_CHARS, MIN_DOCS = 40, 5
_WHITE = " \t\n\x0b\x0c\r"


def keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h, doc_id, _row, pos) of the lines whose key has min_chars code points or more; _row tells a document's rows apart."""
    lines = rows.select("doc_id", "_row", F.posexplode("_lines").alias("pos", "line")).filter(F.octet_length("line") >= min_chars)
    keys = lines.withColumn("key", F.btrim("line", F.lit(_WHITE))).filter(F.char_length("key") >= min_chars)
    return keys.select(digest(F.translate("key", string.ascii_uppercase, string.ascii_lowercase)).alias("h"), "doc_id", "_row", "pos")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the lines of at least min_chars that min_docs documents have, but for the last of those documents."""
    rows = docs.drop("_row", "_lines", "_drop").withColumn("_row", F.xxhash64("text")).withColumn("_lines", F.split("text", "\n"))
    lines = keyed_lines(rows, min_chars)
    common = cut(lines.groupBy("h").count().filter(F.col("count") >= min_docs).select("h"), "common-lines")
    shared = cut(join_small(lines, common, "h", "inner"), "shared-lines")
    held = shared.groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    repeated = cut(held.filter(F.col("n") >= min_docs).select("h", "last"), "repeated-lines")
    gone = join_small(shared, repeated, "h", "inner").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = cut(gone.groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_of")).agg(F.collect_set("pos").alias("_drop")), "lines-to-drop")
    joined = rows.drop("text").join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_of")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    left = joined.withColumn("text", F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")))
    new = {"n_chars": F.length("text").cast("long"), "n_lines": F.greatest(F.size("_lines"), F.lit(1)).cast("long"), "n_dropped": F.greatest(F.size("_drop"), F.lit(0)).cast("long")}
    kept = left.withColumns(new).drop("_row", "_lines", "_drop", "_doc", "_of")
    return kept.select(*[c for c in docs.columns if c in kept.columns], *[c for c in ("n_chars", "n_lines", "n_dropped") if c not in docs.columns])
