"""A quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

`document_statistics` describes each whole text by STATISTICS, each a logarithm or a share, from arrays over the text's bytes.
`fit` takes per class the count, mean and covariance of all labelled rows, gathered as sums with partial aggregation, and
shrinks each covariance towards the pooled one and both towards a multiple of the identity. `score` turns the difference
of the classes' log densities, each from a Mahalanobis distance by a Cholesky factor that is worked out once, into a probability.
Statistics depend on each other, so that difference says too much; it is multiplied by the one of FACTORS under which the labels
that were learned from are likeliest, again from sums over all of them.

Defined results: a null or empty text has statistics of 0 and gets a score like any other. A null doc_id is neither learned from
nor held out. Labels other than 0 and 1, and null ones, aren't learned from; a label row that repeats counts again. If a class has no
labelled rows, the other's share of the labels, (n + 1) / (n + 2), is everyone's score. Other columns pass through; ones with the
names of new ones are replaced. With a column named statistics, that one is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut
from .textarrays import Words, shingles, span_hashes, texts

STATISTICS = ["log_words", "word_length", "symbols", "upper", "digits", "punctuation", "repeated_trigrams", "distinct_words", "repeated_lines", "line_words", "line_ends"]
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.05
CUTOFF = 0.3
FACTORS = [2 ** (k / 2) for k in range(-12, 3)]
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 symbol, 4 other punctuation
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 4
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many values there are, and how many of them aren't the first of their kind."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(rows, minlength=n), np.bincount(r[again], minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each text, a row each."""
    n = len(offsets) - 1
    w = Words(raw, offsets)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row_of * 5 + _KIND[raw], minlength=5 * n).reshape(n, 5)
    chars = np.bincount(row_of[(raw & 0xC0) != 0x80], minlength=n)
    spaces = np.bincount(w.row, (w.ends - w.starts), n)
    hashes = w.hashes()
    words, word_again = _repeats(w.row, hashes, n)
    grams, gram_rows = shingles(w, 3)
    trigrams, gram_again = _repeats(gram_rows, grams, n)
    new_line = np.ones(len(w.starts), bool)
    lines_at = np.append(0, np.cumsum(raw == 10))[w.starts]
    new_line[1:] = (lines_at[1:] != lines_at[:-1]) | (w.row[1:] != w.row[:-1])
    starts = np.flatnonzero(new_line)
    ends = np.append(starts[1:], len(new_line)) if len(starts) else starts
    lines, line_again = _repeats(w.row[starts], span_hashes(hashes, starts, ends), n)
    stops = np.bincount(w.row, np.isin(raw[w.ends - 1], [ord(c) for c in ".!?"]), n) if len(w.row) else np.zeros(n)
    some = lambda x: np.maximum(x, 1)
    return np.column_stack([
        np.log1p(words), spaces / some(words), np.log1p(10 * kinds[:, 3] / some(words)), np.log1p(10 * kinds[:, 1] / some(chars)), np.log1p(10 * kinds[:, 2] / some(chars)), np.log1p(10 * kinds[:, 4] / some(chars)),
        gram_again / some(trigrams), np.log1p(words - word_again) - np.log1p(words), line_again / some(lines), np.log1p(words / some(lines)), stops / some(words),
    ])


@F.arrow_udf(T.ArrayType(T.DoubleType(), False))
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    d = len(STATISTICS)
    for column in batches:
        found = [statistics(raw, offsets) for _, _, raw, offsets in texts(column)]
        values = np.concatenate(found).ravel() if found else np.zeros(0)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * d, pa.int32()), pa.array(values))


def document_statistics(docs: DataFrame) -> DataFrame:
    return docs.withColumn("statistics", _statistics(F.col("text")))


@dataclass
class Discriminant:
    """Per class (0, 1): its count of labels, mean, Cholesky factor of the covariance and log determinant of that factor.

    factor: what the difference of log densities is multiplied by.
    """

    counts: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_det: np.ndarray
    factor: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log density of class 1 less that of class 0."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_det):
            z = _forward(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - log_det)
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if not self.counts.all():
            return np.full(len(x), (self.counts[1] + 1) / (self.counts.sum() + 2))
        odds = self.factor * self.difference(x) + np.log(self.counts[1] / self.counts[0])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The z of factor @ z = b, for a lower triangular factor and all columns of b."""
    z = np.empty_like(b)
    for i in range(len(b)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


def fit(labelled: DataFrame) -> Discriminant:
    """From rows of statistics and quality; one row of sums per class reaches the driver."""
    d = len(STATISTICS)
    x = [F.col("statistics")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = labelled.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("ss")
    )
    counts, means, covariances = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums.collect():
        c, n = int(row["quality"]), row["n"]
        counts[c], means[c] = n, np.array(row["s"]) / n
        for (i, j), v in zip(pairs, row["ss"]):
            covariances[c, i, j] = covariances[c, j, i] = v / n - means[c, i] * means[c, j]
    pooled = np.einsum("c,cij->ij", counts, covariances) / max(counts.sum(), 1)
    scale = np.maximum(np.diag(pooled), 1e-6)
    mixed = (1 - SHRINK_POOLED) * covariances + SHRINK_POOLED * pooled
    mixed = (1 - SHRINK_IDENTITY) * mixed + SHRINK_IDENTITY * np.diag(scale)
    factors = np.linalg.cholesky(mixed)
    model = Discriminant(counts, means, factors, np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1))
    return _softened(model, labelled) if counts.all() else model


def _softened(model: Discriminant, labelled: DataFrame) -> Discriminant:
    """model with the factor of the least log loss; one row of sums reaches the driver."""
    prior = float(np.log(model.counts[1] / model.counts[0]))
    known = labelled.filter(F.col("quality").isin(0, 1)).select(_differences(model)(F.col("statistics")).alias("d"), (1 - 2 * F.col("quality")).alias("sign"))

    def loss(factor: float) -> Column:
        wrong = F.col("sign") * (factor * F.col("d") + prior)  # log(1 + exp(wrong)), for large values too
        return F.sum(F.greatest(wrong, F.lit(0.0)) + F.log1p(F.exp(-F.abs(wrong))))

    losses = list(known.agg(*[loss(f).alias(f"f{k}") for k, f in enumerate(FACTORS)]).first())
    return replace(model, factor=FACTORS[int(np.argmin(losses))])


def _differences(model: Discriminant):
    @F.arrow_udf(T.DoubleType())
    def difference(column: pa.Array) -> pa.Array:
        return pa.array(model.difference(_rows(column)))

    return difference


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _scorer(model: Discriminant):
    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_rows(column)))

    return score


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, or their columns `keep` (doc_id among them), with held_out, score and predicted."""
    rows = document_statistics(docs)
    rows = cut(rows.select(*keep, "statistics") if keep else rows, "statistics")
    known = labels.filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    model = fit(cut(rows.select("doc_id", "statistics").join(known, "doc_id").select("statistics", "quality"), "labelled"))
    out = rows.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", _scorer(model)(F.col("statistics")))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int")).drop("statistics")
