"""Which target each source column is: header evidence, value evidence, and the best one-to-one assignment."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend import schema as S
from gridmend.functions.clean import normalise
from gridmend.operators import profile
from gridmend.operators.memory import FLOOR, FULL
from gridmend.scratch import dealt

WEIGHTS = {"lexical": 0.30, "semantic": 0.35, "fingerprint": 0.35}
MIN_SCORE, ADMISSIBLE_LEXICAL, ADMISSIBLE_SEMANTIC, LOW_MARGIN = 0.25, 0.90, 0.70, 0.15
MARGIN_FULL, MARGIN_PENALTY = 0.20, 0.35
FUZZY, MAX_TOKENS, MIN_SHARE = 0.86, 8, 0.34
# Header phrases of each target, and abbreviations with what they stand for. More phrases come as a parameter.
VOCABULARY: dict[str, list[str]] = {
    "Reference": ["reference", "ref", "loc", "loc no", "loc number", "location", "location id", "location no", "location number", "location ref", "site", "site id", "premises", "premises no", "building id", "account", "acct", "policy loc"],
    "Address": ["address", "street address", "street", "addr", "address 1", "address line 1", "location address", "situs address", "property address", "mailing address"],
    "City": ["city", "town", "municipality", "city name"],
    "State": ["state", "st", "province", "state code", "state name", "state abbrev"],
    "Zip": ["zip", "zipcode", "zip code", "postal code", "postcode", "zip5", "post code"],
    "County": ["county", "parish", "district", "county name"],
    "Country": ["country", "nation", "country code", "ctry"],
    "Building Value": ["building value", "bldg value", "building", "bldg", "building tiv", "building replacement cost", "bldg repl cost", "repl cost", "replacement cost", "real property", "structure value", "building amount", "building limit"],
    "Contents": ["contents", "contents value", "cont", "personal property", "business personal property", "bpp", "stock", "contents tiv", "contents limit"],
    "BI": ["bi", "business income", "business interruption", "bi ee", "bi/ee", "bi and ee", "extra expense", "time element", "loss of income", "bi value", "bi limit"],
    "Occupancy": ["occupancy", "occ", "occupancy type", "occupancy class", "use", "usage", "operations", "class of occupancy"],
    "Construction": ["construction", "const", "constr", "construction type", "constr type", "iso class", "iso construction", "building construction", "wall type"],
    "Storeys": ["storeys", "stories", "story", "storys", "floors", "num floors", "no of floors", "number of storeys", "number of stories", "stories above grade", "height stories"],
    "Number of Buildings": ["number of buildings", "no of buildings", "num buildings", "bldgs", "buildings", "bldg count", "building count", "no of bldgs", "qty buildings"],
    "Year Built": ["year built", "yr blt", "yr built", "yob", "built", "year of construction", "construction year", "year constructed", "orig year built"],
    "Fire Sprinklers (Y/N)": ["fire sprinklers", "fire sprinkler", "sprinklers", "sprinkler", "sprk", "sprinklered", "auto sprinkler", "sprinkler y n", "prot sprinkler", "fire prot"],
    "Other": ["other", "other value", "misc", "miscellaneous", "other property", "other tiv", "eq other", "other limit"],
}
ABBREVIATIONS: dict[str, str] = {
    "bldg": "building", "bldgs": "buildings", "repl": "replacement", "rc": "replacement cost", "val": "value", "vals": "values", "amt": "amount",
    "tiv": "total insurable value", "yr": "year", "blt": "built", "yob": "year built", "eyb": "effective year built", "const": "construction",
    "constr": "construction", "cons": "construction", "occ": "occupancy", "sprk": "sprinkler", "spkr": "sprinkler", "spr": "sprinkler",
    "prot": "protection", "st": "state", "addr": "address", "cnty": "county", "ctry": "country", "cntry": "country", "bi": "business income",
    "ee": "extra expense", "bpp": "business personal property", "pers": "personal", "prop": "property", "qty": "quantity", "num": "number",
    "no": "number", "seq": "sequence", "ref": "reference", "loc": "location", "desc": "description", "acct": "account", "sq": "square", "ft": "feet",
}


# The long tail of header phrases.
MORE_PHRASES: dict[str, list[str]] = {
    "Reference": ["loc #", "location #", "no", "num", "item", "item no", "seq", "sequence", "line", "line no", "row", "key", "unit", "branch", "branch no", "store", "store no", "plant", "plant no", "facility id", "sov id"],
    "Address": ["address1", "addr1", "street no and name", "physical address", "risk address", "insured location", "location desc", "site address", "premises address", "building address", "loc address", "street 1"],
    "City": ["city town", "city or town", "locality", "suburb", "place"],
    "State": ["st.", "state prov", "state/prov", "province state", "region", "st cd"],
    "Zip": ["zip 4", "zip+4", "zip code 5", "postal", "pc", "post"],
    "County": ["county parish", "borough", "cnty", "county/parish"],
    "Country": ["country name", "iso country", "cntry", "domicile"],
    "Building Value": ["bldg", "building val", "bldg val", "building rc", "bldg rc", "rc value", "building replacement value", "real property value", "structure", "building tiv value", "bldg limit", "building sum insured", "prop damage bldg"],
    "Contents": ["contents val", "content", "bpp value", "personal prop", "pers property", "machinery and equipment", "m&e", "equipment", "stock and contents", "contents sum insured", "contents rc"],
    "BI": ["bi value", "bi/ee value", "business income value", "business interruption value", "time element value", "ee", "extra exp", "rental income", "loss of rents", "gross earnings", "bi limit value", "profits"],
    "Occupancy": ["risk class", "business type", "industry", "sic", "naics", "occ code", "occ class", "tenancy", "occupancy desc", "occupancy description", "building use", "property use"],
    "Construction": ["construction desc", "construction class", "const class", "constr class", "iso const", "building type", "frame type", "material", "wall construction", "roof and wall", "cons", "construction code"],
    "Storeys": ["no stories", "num stories", "# stories", "# floors", "storys above grade", "floor count", "levels", "no of levels", "height", "stories/floors"],
    "Number of Buildings": ["# bldgs", "# buildings", "no bldgs", "num bldgs", "count of buildings", "structures", "no of structures", "bldg qty", "units", "no of units"],
    "Year Built": ["yr", "year", "yr of construction", "date built", "year of build", "original construction year", "construction date", "built year", "vintage", "effective year built", "eyb"],
    "Fire Sprinklers (Y/N)": ["sprinkler y/n", "sprinklered y n", "sprinkler system", "auto sprinklers", "fire suppression", "suppression", "sprinkler indicator", "spr", "spkr", "sprink", "sprinkler coverage", "fire protection"],
    "Other": ["other val", "misc value", "other prop value", "yard improvements", "outdoor property", "fences and signs", "improvements", "betterments", "tenant improvements", "eq value", "equipment breakdown", "all other"],
}


def glossary_rows(extra: dict[str, list[str]] | None = None) -> list[tuple[str, int, str, int]]:
    """(target, ordinal, phrase, rank): each target's name and phrases, longest first."""
    rows = []
    for k, t in enumerate(S.FIELD_NAMES):
        phrases = {p.lower().strip() for p in [t, *VOCABULARY[t], *(extra or {}).get(t, [])]}
        rows += [(t, k, p, r) for r, p in enumerate(sorted(phrases, key=lambda p: (-len(p), p)))]
    return rows


def glossary(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of glossary_rows."""
    return spark.createDataFrame(glossary_rows(extra), "target string, ordinal int, phrase string, rank int")


def prepare(header: Column) -> Column:
    """A normalised header with what its abbreviations stand for put behind them."""
    long = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(normalise(header), " "), lambda t: F.concat_ws(" ", t, long[t])), " ")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence. Bit k of the row is off where a match of b's letter k adds to the length."""
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for c in a:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _similar(a: str, b: str) -> float:
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """How alike two phrases are, whatever their order and repeats of words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not left or not right):
        return 1.0
    whole = [" ".join(filter(None, [both, s])) for s in (left, right)]
    found = [_similar(*whole)]
    return max(found + [_similar(both, w) for w in whole] if both else found)


@F.pandas_udf(T.DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where a is null."""
    return pd.Series([None if x is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letters(texts: list[str]) -> np.ndarray:
    """A row a text: how often it has each letter of a normalised text."""
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], np.int64).reshape(len(texts), len(_LETTERS))


class _Phrases:
    """A glossary laid out for `best`: its phrases by target, their letters, and where each word is."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        named = sorted(((k, r, t, p, _plain(p)) for t, k, p, r in rows if _plain(p)), key=lambda x: x[:2])
        self.names = [(t, k) for k, t in sorted({(x[0], x[2]) for x in named})]
        self.phrases, self.plain = [x[3] for x in named], [x[4] for x in named]
        self.sets = [set(p.split()) for p in self.plain]
        self.letters = _letters([" ".join(sorted(s)) for s in self.sets])
        self.sizes = self.letters.sum(1)
        self.spans = [[i for i, x in enumerate(named) if x[0] == k] for _, k in self.names]
        self.with_word: dict[str, list[int]] = {}
        for i, s in enumerate(self.sets):
            for w in s:
                self.with_word.setdefault(w, []).append(i)

    def best(self, bare: str, long: str) -> list[tuple[float, str, bool]]:
        """(score, phrase, exact) of each target. A phrase is scored only while a bound of its score reaches the best so far.

        Common letters bound the longest common subsequence; what shared words alone give is known from their lengths.
        """
        words = set(long.split())
        own = _letters([" ".join(sorted(words))])[0]
        bound = 2 * np.minimum(self.letters, own).sum(1) / np.maximum(self.sizes + own.sum(), 1)
        shared: dict[int, list[str]] = {}
        for w in words:
            for i in self.with_word.get(w, ()):
                shared.setdefault(i, []).append(w)
        for i, ws in shared.items():
            both = sum(map(len, ws)) + len(ws) - 1
            whole = len(ws) in (len(words), len(self.sets[i]))
            bound[i] = 1.0 if whole else max(bound[i], 2 * both / (both + min(own.sum(), self.sizes[i])))
        out = []
        for span in self.spans:
            exact = next((i for i in span if self.plain[i] == bare), None)
            if exact is not None:
                out.append((1.0, self.phrases[exact], True))
                continue
            top, at = -1.0, span[0]
            for i in sorted(span, key=lambda i: (-bound[i], i)):
                if bound[i] < top - 1e-9:
                    break
                score = token_set_ratio(long, self.plain[i])
                if (score, -i) > (top, -at):
                    top, at = score, i
            out.append((top, self.phrases[at], False))
        return out


def _plain(phrase: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", phrase.lower()))


def lexical(headers: DataFrame, phrases: list[tuple[str, int, str, int]]) -> DataFrame:
    """(header, target, ordinal, lexical, phrase, exact) for each different header and target; phrases: `glossary_rows`.

    Each different header is one row of a task, which holds the glossary and looks for each target's best phrase from the highest bound down:
    no pairs of headers and phrases are rows of a table. Ties go to the longest phrase. A null or wordless header scores 0 everywhere.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Phrases(phrases)
        for pdf in batches:
            rows = [(h, t, k, *x) for h, b, l in zip(pdf["header"], pdf["bare"], pdf["long"]) for (t, k), x in zip(known.names, known.best(b, l))]
            yield pd.DataFrame(rows, columns=["header", "target", "ordinal", "lexical", "phrase", "exact"])

    own = headers.select("header").distinct().select("header", F.coalesce(normalise(F.col("header")), F.lit("")).alias("bare"), F.coalesce(prepare(F.col("header")), F.lit("")).alias("long"))
    return own.mapInPandas(score, "header string, target string, ordinal int, lexical double, phrase string, exact boolean").withColumn("lexical", F.round("lexical", 4))


def _grams(text: str) -> list[str]:
    return [text[k : k + 2] for k in range(len(text) - 1)]


def _shared(both: float) -> int:
    """How many pairs of letters two texts with so many letters in all share at least, if their ratio is FUZZY or more.

    Matched letters are FUZZY * both / 2 or more on either side, and all others at most the rest; each gap between matched blocks holds one of those.
    """
    return max(1, math.ceil((1.5 * FUZZY - 1) * both - 1 - 1e-9))


def _index(spark, phrases: list[tuple[str, int, str, int]]) -> DataFrame:
    """The keys by which texts meet phrases: the whole phrase, its rarest word, and enough of its rarest letter pairs that a text alike has one of them."""
    plain = [(t, k, r, _plain(p)) for t, k, p, r in phrases if _plain(p)]
    often = Counter(w for *_, p in plain for w in set(p.split())) + Counter(g for *_, p in plain for g in set(_grams(p)))
    rows = []
    for t, k, r, p in plain:
        words, grams = sorted(set(p.split())), _grams(p)
        keys = ["=" + p, "w" + min(words, key=lambda w: (often[w], w))]
        spare = _shared(len(p) * 2 / (2 - FUZZY)) - 1  # the shortest text alike has FUZZY / (2 - FUZZY) of the phrase's letters
        for g in sorted(set(grams), key=lambda g: (-often[g], g)):
            if grams.count(g) <= spare:
                spare -= grams.count(g)
            else:
                keys.append("g" + g)
        rows += [(key, t, k, r, p, words, grams) for key in keys]
    names = ["_key", "target", "ordinal", "rank", "_phrase", "_words", "_grams"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names))


def match_target(cells: DataFrame, phrases: list[tuple[str, int, str, int]]) -> DataFrame:
    """(value, target) of each different cell text that reads as a target's header; phrases: `glossary_rows`.

    Each text meets phrases by an equal join on keys: itself, its words, its letter pairs. Only what has the lengths and pairs of a likeness is compared.
    """
    longest = max([len(_plain(p)) for _, _, p, _ in phrases], default=0)
    own = dealt(cells.select("value").distinct(), "value").withColumn("_text", normalise(F.col("value"))).filter("_text != ''")
    own = own.withColumn("_own", F.array_distinct(F.split("_text", " "))).withColumn("_n", F.size("_own"))
    near = (F.col("_n") <= MAX_TOKENS) & F.length("_text").between(2, math.ceil(longest * (2 - FUZZY) / FUZZY))
    pairs = F.when(near, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - 1, F.lit(1))), lambda k: F.substr("_text", k, F.lit(2))))).otherwise(F.array())
    mark = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(kind), x))
    keys = F.concat(F.array(F.concat(F.lit("="), "_text")), mark("w", F.when(F.col("_n") <= MAX_TOKENS, F.col("_own")).otherwise(F.array())), mark("g", F.col("_pairs")))
    keyed = own.withColumn("_pairs", pairs).withColumn("_key", F.explode(keys)).withColumn("_chars", F.length("_text"))
    index = _index(cells.sparkSession, phrases).withColumnRenamed("_key", "_met")
    # by letter pairs only phrases of like length are met, by a word only those of enough words: what else is alike meets by another key
    share = F.size("_words") / F.col("_n")
    shorter, both = F.least(F.col("_chars"), F.length("_phrase")), F.col("_chars") + F.length("_phrase")
    fits = F.when(F.col("_key").startswith("g"), 2 * shorter >= FUZZY * both).when(F.col("_key").startswith("w"), share >= MIN_SHARE).otherwise(True)
    met = keyed.join(index, (F.col("_key") == F.col("_met")) & fits)
    exact = F.col("_text") == F.col("_phrase")
    inside = F.size(F.array_except("_words", "_own")) == 0
    met = met.withColumn("_plain", F.when(exact, 2.0).when(inside & (F.col("_n") <= MAX_TOKENS) & (share >= MIN_SHARE), 0.9 + 0.1 * share))
    common = F.size(F.filter("_grams", lambda g: F.array_contains("_pairs", g)))
    alike = F.col("_key").startswith("g") & ~inside & (common >= (1.5 * FUZZY - 1) * both - 1 - 1e-9)
    found = met.filter(F.col("_plain").isNotNull() | alike).withColumn("_score", F.coalesce("_plain", _sequence_ratio(F.when(F.col("_plain").isNull(), F.col("_text")), "_phrase")))
    return found.filter(F.col("_plain").isNotNull() | (F.col("_score") >= FUZZY)).groupBy("value").agg(F.max_by("target", F.struct("_score", -F.col("ordinal"), -F.col("rank"))).alias("target"))


def fuse(lexical_: Column, fingerprint: Column, abstained: Column, semantic: Column | None = None) -> Column:
    """The mean of the channels that have an opinion, by their weights."""
    total = F.lit(WEIGHTS["lexical"]) + F.when(abstained, 0.0).otherwise(WEIGHTS["fingerprint"])
    score = lexical_ * WEIGHTS["lexical"] + F.when(abstained, 0.0).otherwise(fingerprint * WEIGHTS["fingerprint"])
    if semantic is not None:
        total, score = total + F.when(semantic.isNull(), 0.0).otherwise(WEIGHTS["semantic"]), score + F.coalesce(semantic * WEIGHTS["semantic"], F.lit(0.0))
    return F.round(score / total, 4)


def margin_confidence(fused: Column, margin: Column) -> Column:
    closeness = 1 - F.least(F.greatest(margin, F.lit(0.0)) / MARGIN_FULL, F.lit(1.0))
    return F.round(fused * (1 - MARGIN_PENALTY * closeness), 4)


def exact_boost(confidence: Column, fused: Column, exact: Column, fingerprint: Column) -> Column:
    return F.when(exact & (fingerprint >= 0.5), F.greatest(confidence, F.least(fused, F.lit(0.995)))).otherwise(confidence)


def method(target: Column, exact: Column, lexical_: Column, fingerprint: Column, semantic: Column | None = None) -> Column:
    """How a column got its target: unresolved, exact, the only channel that supports it, or fused."""
    channels = {"lexical": lexical_, "fingerprint": fingerprint} | ({} if semantic is None else {"semantic": semantic})
    some = F.array_compact(F.array(*[F.when(score > 0, name) for name, score in channels.items()]))
    return F.when(target.isNull(), "unresolved").when(exact, "exact").when(F.size(some) == 1, some[0]).otherwise("fused")


def low_margin(mappings: DataFrame) -> DataFrame:
    """Columns with a target whose runner-up is close: what a second opinion is for."""
    return mappings.filter(F.col("target").isNotNull() & (F.col("margin") < LOW_MARGIN))


def review_flag(confidence: Column, target: Column) -> Column:
    return F.when(target.isNull() | (confidence < 0.50), "required").when(confidence >= 0.85, "auto").otherwise("suggested")


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row in the one-to-one assignment of the largest total gain; -1 for rows left over.

    Shortest augmenting paths with potentials, one row at a time; ties go to lower numbers.
    """
    n, m = gain.shape
    size = max(n, m)
    cost = np.zeros((size, size))
    cost[:n, :m] = -gain
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.full(size + 1, -1)
    for i in range(size):
        match[size] = i
        least, before, done = np.full(size, np.inf), np.full(size, size), np.zeros(size + 1, bool)
        j = size
        while True:
            done[j] = True
            row = match[j]
            slack = cost[row] - u[row] - v[:size]
            better = ~done[:size] & (slack < least - 1e-12)
            least[better], before[better] = slack[better], j
            free = np.where(done[:size], np.inf, least)
            nxt = int(free.argmin())
            step = free[nxt]
            u[match[done]] += step
            v[done] -= step
            least[~done[:size]] -= step
            j = nxt
            if match[j] < 0:
                break
        while j != size:
            match[j], j = match[before[j]], before[j]
    out = np.full(n, -1)
    for j in range(m):
        if 0 <= match[j] < n:
            out[match[j]] = j
    return out


_ASSIGNED = "sheet string, column_idx int, header string, target string, fused double, margin double, runner_up string"


def assign(evidence: DataFrame) -> DataFrame:
    """From (sheet, column_idx, header, target, ordinal, lexical, semantic, fused): a row per column with its target or null.

    One sheet is one task's group: its columns times seventeen targets. Evidence that only fits the values doesn't claim a target.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["column_idx", "ordinal"], kind="stable")
        columns, targets = pdf["column_idx"].unique(), pdf.drop_duplicates("ordinal").sort_values("ordinal")["target"].tolist()
        fused = pdf["fused"].to_numpy().reshape(len(columns), len(targets))
        admissible = ((pdf["lexical"] >= ADMISSIBLE_LEXICAL) | (pdf["semantic"].fillna(0) >= ADMISSIBLE_SEMANTIC)).to_numpy().reshape(fused.shape)
        headers = pdf.drop_duplicates("column_idx")["header"].tolist()
        rows = []
        for i, j in enumerate(best_assignment(np.where(admissible, fused, 0.0))):
            if j < 0:
                rows.append((pdf["sheet"].iloc[0], int(columns[i]), headers[i], None, 0.0, 0.0, None))
                continue
            others = [(fused[i, k], -k) for k in range(len(targets)) if k != j]
            second = max(others, default=(0.0, 0))
            good = fused[i, j] >= MIN_SCORE and admissible[i, j]
            rows.append((pdf["sheet"].iloc[0], int(columns[i]), headers[i], targets[j] if good else None, float(fused[i, j]), round(float(fused[i, j] - second[0]), 4), targets[-second[1]] if others else None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _ASSIGNED.split(", ")])

    return evidence.groupBy("sheet").applyInPandas(solve, _ASSIGNED)


GRAMS, DIMENSIONS = (3, 4, 5), 512


def hashed_grams(texts: pd.Series) -> np.ndarray:
    """A vector a text: its character n-grams, hashed to DIMENSIONS places with signs, as the logarithm of their counts. The encoder at hand; others are a parameter."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, text in enumerate(texts):
        padded = f" {text} "
        grams = Counter(padded[k : k + n] for n in GRAMS for k in range(len(padded) - n + 1))
        for gram, n in grams.items():
            h = zlib.crc32(gram.encode())
            out[i, h % DIMENSIONS] += math.log1p(n) * (1 if h >> 31 else -1)
    return out


def semantic_scores(columns: DataFrame, descriptions: dict[str, str], encode: Callable[[pd.Series], np.ndarray] | None = hashed_grams) -> DataFrame:
    """(header, target, semantic) of each different header and described target: the calibrated cosine of their vectors.

    The descriptions, one a target, go to the tasks, which encode them once each beside the headers that they hold. encode None, or one that
    raises ImportError in a task, gives null scores: fusion then leaves the channel out.
    """
    targets, said = list(descriptions), pd.Series(list(descriptions.values()), dtype=object)
    schema = "header string, target string, semantic double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        known = None
        for pdf in batches:
            try:
                known = unit(encode(said)) if known is None else known
                found = unit(encode(pdf["long"])) @ known.T
            except ImportError:
                found = np.full((len(pdf), len(targets)), np.nan)
            made = np.clip((found - FLOOR) / (FULL - FLOOR), 0, 1).round(4)
            yield pd.DataFrame({"header": np.repeat(pdf["header"].to_numpy(), len(targets)), "target": np.tile(targets, len(pdf)), "semantic": made.ravel()})

    headers = columns.select("header").distinct().withColumn("long", F.coalesce(prepare(F.col("header")), F.lit("")))
    if encode is None:
        return headers.select("header", F.explode(F.array(*map(F.lit, targets))).alias("target"), F.lit(None).cast("double").alias("semantic"))
    return headers.mapInPandas(score, schema).withColumn("semantic", F.nanvl("semantic", F.lit(None)))


def build_evidence(columns: DataFrame, cells: DataFrame, phrases: list[tuple[str, int, str, int]], year: int, semantic: DataFrame | None = None) -> DataFrame:
    """A row per column (sheet, column_idx, header) and target, with the scores of each channel; cells: (sheet, column_idx, pos, value).

    semantic: (header, target, semantic) of `semantic_scores` or another model; where it has none the channel is left out.
    """
    key = F.struct("sheet", "column_idx")
    fits = profile.fingerprint(profile.profile(cells.select(key.alias("column"), "pos", "value", *[c for c in ("type",) if c in cells.columns]), year))
    fits = fits.select("column.*", "target", "fingerprint", "abstained")
    named = lexical(columns, phrases).select("header", "target", "ordinal", "lexical", "exact")
    out = columns.join(named, "header").join(fits, ["sheet", "column_idx", "target"], "left").fillna({"fingerprint": 0.0, "abstained": True})
    out = out.withColumn("semantic", F.lit(None).cast("double")) if semantic is None else out.join(semantic, ["header", "target"], "left")
    return out.withColumn("fused", fuse(F.col("lexical"), F.col("fingerprint"), F.col("abstained"), F.col("semantic")))


def map_columns(evidence: DataFrame) -> DataFrame:
    """The stage's output: per column its target, confidence, method, flag, runner-up and the scores behind them."""
    scores = evidence.select("sheet", "column_idx", "target", "exact", "lexical", "fingerprint", "semantic")
    chosen = assign(evidence).join(scores, ["sheet", "column_idx", "target"], "left")
    plain = margin_confidence(F.col("fused"), F.col("margin"))
    boosted = exact_boost(plain, F.col("fused"), F.coalesce("exact", F.lit(False)), F.coalesce("fingerprint", F.lit(0.0)))
    chosen = chosen.withColumn("confidence", F.when(F.col("target").isNull(), 0.0).otherwise(boosted))
    return chosen.withColumn("method", method(F.col("target"), F.coalesce("exact", F.lit(False)), F.col("lexical"), F.col("fingerprint"), F.coalesce("semantic", F.lit(0.0)))).withColumn("flag", review_flag(F.col("confidence"), F.col("target")))


def unmapped_targets(mappings: DataFrame) -> DataFrame:
    """(sheet, target) of the targets that no column of a sheet took."""
    targets = mappings.sparkSession.createDataFrame([(t,) for t in S.FIELD_NAMES], "target string")
    every = mappings.select("sheet").distinct().crossJoin(F.broadcast(targets))  # seventeen rows a sheet
    return every.join(mappings.filter("target is not null"), ["sheet", "target"], "left_anti")


def mapping_block(mappings: DataFrame) -> DataFrame:
    """Per sheet: resolved and unresolved columns, those to review, those of low margin, and the mean confidence of the resolved."""
    got = F.col("target").isNotNull()
    mean = F.coalesce(F.round(F.avg(F.when(got, F.col("confidence"))), 4), F.lit(0.0))
    return mappings.groupBy("sheet").agg(F.count_if(got).alias("resolved"), F.count_if(~got).alias("unresolved"), F.count_if(F.col("flag") == "required").alias("required"), F.count_if(got & (F.col("margin") < LOW_MARGIN)).alias("low_margin"), mean.alias("confidence"))


def mapping_issues(mappings: DataFrame, sheets: DataFrame, semantic: bool = False, model: bool = False) -> DataFrame:
    """(sheet, rule, field, severity): columns for review, sheets without headers, and what a run had to do without."""
    none = F.lit(None).cast("string").alias("field")
    rows = mappings.filter("flag = 'required'").select("sheet", F.lit("mapping_requires_review").alias("rule"), F.col("target").alias("field"), F.when(F.col("target").isNull(), "High").otherwise("Medium").alias("severity"))
    rows = rows.unionByName(sheets.select("sheet").distinct().join(mappings, "sheet", "left_anti").select("sheet", F.lit("mapping_no_headers").alias("rule"), none, F.lit("High").alias("severity")))
    if not model:
        rows = rows.unionByName(low_margin(mappings).select("sheet").distinct().select("sheet", F.lit("adjudicator_unavailable").alias("rule"), none, F.lit("Medium").alias("severity")))
    if not semantic:
        rows = rows.unionByName(mappings.select("sheet").distinct().select("sheet", F.lit("semantic_channel_unavailable").alias("rule"), none, F.lit("Medium").alias("severity")))
    return rows
