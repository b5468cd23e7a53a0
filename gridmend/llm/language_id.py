"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all learnable documents, as sums per bucket. Weights are trained by follow-the-regularised-leader
(FTRL-proximal) with L1 and L2 penalties on a bounded sample: at most about SAMPLE_PER_LANGUAGE documents of each language and
SAMPLE of all, and fewer where those would have more than SAMPLE_BYTES of features, chosen by a hash of doc_id; the features of the sample, and
nothing else, reach the driver. A fifth of the sample is kept from training
and sets the temperature by which scores are divided, so that a score is the probability of being right. Every document is then
scored in one pass, whole, with no shuffle.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn from. A
null doc_id is neither learned from nor held out. Rows that repeat each get a row. Text is compared in lower case, and what isn't a
letter counts as a space. Other columns pass through; ones with the names of new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import crc_mod, join_small

BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE, SAMPLE, EPOCHS = 1000, 20_000, 2
#: of a document at most FEATURE_BYTES for each different n-gram, of which a character begins three at most
SAMPLE_BYTES, FEATURE_BYTES = 256 << 20, 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"
_ROWS, _CHARS = 64, 1 << 19
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_U = np.uint64


def _pieces(column: pa.Array) -> Iterator[list[str]]:
    """The texts, in lower case, a few at a time."""
    held: list[str] = []
    size = 0
    for k in range(0, len(column), 1024):
        for t in column.slice(k, 1024).to_pylist():
            held.append((t or "").lower())
            size += len(held[-1])
            if len(held) >= _ROWS or size >= _CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each bucket that a text has, in order, and whether a text has a letter."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    letter = pretokens.kinds()[points] == pretokens.LETTER
    codes = np.where(letter, points, 0).astype(np.uint64)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    base = row * BUCKETS
    mixed = np.zeros(len(codes), np.uint64)
    usable = np.ones(len(codes), bool)
    for n in range(1, 4):
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        mixed = mixed[:size] + codes[n - 1 :] * _FACTORS[n - 1]
        if n == 1:
            usable = letter
        else:  # within one text, and no two spaces in a row
            here = row[n - 2 : -1] == row[n - 1 :]
            usable = (usable[:size] if n > 2 else np.ones(size, bool)) & here & (letter[n - 2 : -1] | letter[n - 1 :])
        bucket = (((mixed + _U(n)) * _U(0xD6E8FEB86659FD93)) >> _U(50)).astype(np.int64)
        counts += np.bincount((base[:size] + bucket)[usable], minlength=len(counts))
    at = np.flatnonzero(counts)
    return at // BUCKETS, at % BUCKETS, counts[at], np.bincount(row[letter], minlength=len(texts)) > 0


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for piece in _pieces(batch.column(0)):
            total += np.bincount(ngram_counts(piece)[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "df"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for piece in _pieces(batch.column("text")):
            row, at, counts, _ = ngram_counts(piece)
            ends = np.searchsorted(row, np.arange(len(piece) + 1))
            packed = [(at[a:b].astype("<u2").tobytes(), counts[a:b].astype("<f4").tobytes()) for a, b in zip(ends, ends[1:])]
            part = batch.slice(done, len(piece))
            done += len(piece)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("order"), *[pa.array(c, pa.binary()) for c in zip(*packed)]], names=["lang", "order", "at", "n"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        row, at, counts, has_letter = ngram_counts(texts)
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        x = np.log1p(counts.astype(np.float32)) * self.idf[at]
        norm = np.maximum(np.sqrt(np.bincount(row, x * x, n)), 1e-12)
        logits = np.column_stack([np.bincount(row, x * w[at], n) for w in self.weights])
        p = softmax(logits / norm[:, None] / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
        return names, np.where(has_letter, p[np.arange(n), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp((x - x.max(axis=-1, keepdims=True)).astype(np.float64))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes x buckets) from rows of (class, buckets, values)."""
    z, n = np.zeros((2, BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, x in rows:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    return weights(z, n).T.astype(np.float32)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing."""
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """From doc_id, text and lang of the documents that may be learned from."""
    own = docs.select("doc_id", "text", "lang").filter((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    most = F.least(F.lit(BUCKETS), 3 * F.coalesce(F.char_length("text"), F.lit(0))) * FEATURE_BYTES
    sizes = own.groupBy("lang").agg(F.count("*").alias("size"), F.avg(most).alias("bytes"))
    found = sizes.orderBy("lang").collect()  # a row per language
    languages = [(r["lang"], r["size"]) for r in found]
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), 1.0)
    df = np.zeros(BUCKETS)
    counted = own.select("text").mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    for r in counted.collect():  # a row per bucket
        df[r["bucket"]] = r["df"]
    idf = (np.log((1 + sum(n for _, n in languages)) / (1 + df)) + 1).astype(np.float32)
    per_language = min(per_language, max(SAMPLE // len(languages), 1))
    share = min(1.0, SAMPLE_BYTES / max(sum(min(r["size"], per_language) * r["bytes"] for r in found), 1.0))
    rates = sizes.select(F.col("lang").alias("_lang"), (F.least(F.lit(1.0), per_language / F.col("size")) * share).alias("_rate"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = join_small(own, rates, F.col("lang") == F.col("_lang"), "inner").filter(F.pmod(order, F.lit(1 << 20)) < F.col("_rate") * (1 << 20))
    rows = chosen.select("lang", order.alias("order"), "text").mapInArrow(_sample_features, "lang string, order long, at binary, n binary").collect()
    number = {lang: k for k, (lang, _) in enumerate(languages)}
    train, test = [], []
    for r in sorted(rows, key=lambda r: (r["order"] % 1_000_003, r["order"], r["lang"])):
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        x = np.log1p(np.frombuffer(r["n"], "<f4")) * idf[at]
        if len(at):
            (test if r["order"] % 5 == 0 else train).append((number[r["lang"]], at, x / np.linalg.norm(x)))
    weights = train_ftrl(train, len(languages))
    logits = np.array([weights[:, at] @ x for _, at, x in test]).reshape(len(test), len(languages))
    return Model([lang for lang, _ in languages], idf, weights, calibrate(logits, np.array([k for k, _, _ in test], np.int64)))


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _predictor(held):
    @F.arrow_udf(_RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = held.value
        for column in batches:
            names, scores = [], [np.zeros(0)]
            for piece in _pieces(column):
                n, s = model.predict(piece)
                names += n
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    return predict


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats
    made = docs.withColumn("_found", _predictor(held)(F.col("text"))).withColumn("held_out", held_out(F.col("doc_id")))
    return made.withColumns({c: F.col("_found")[c] for c in ("lang_pred", "score")}).drop("_found")
