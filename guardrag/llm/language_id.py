"""Language identification by hierarchical discrimination.

First the language family is decided, then one-versus-one linear support vector machines
separate the languages within it. Features are relative frequencies of hashed byte 2-grams and
3-grams of the lower-cased text, non-letters folded to one space, over the whole text.

Training uses a sample of labelled texts: the ``max_per_lang`` distinct ones with the smallest hashes of each language (documented
bound, the same texts every time, whatever their copies), reduced to feature vectors on the
executors. The model is a table of 2 * 2**12 + 2**12 rows with one column per pair of
classes; its size does not depend on the data. Prediction is a scan in place: a table look-up per byte and
one sum per document, no shuffle.

Results: ``lang_pred`` is a learned language, or ``und`` (score 0) for null text or text without a
letter. ``score`` is the smaller of the two decisions' calibrated probabilities.

Edge cases: rows whose language is null are never learned from; with no labelled row every text is
``und``; with one language all texts with letters get it; families with one member need no second step; repeated rows get
equal results; ties go to the alphabetically first class; a very long text is one row of sums, as any other. ``identify`` replaces
columns of the input named like its results, ``accepted`` returns every column as it was. More than ``MAX_LANGS`` languages are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardrag.llm.arrowtext import LOWER, pieces
from guardrag.llm.columns import put_back, set_aside

UNDETERMINED = "und"
MAX_PER_LANG = 250
LANG_PARTS = 16
MAX_LANGS = 200
MIN_SCORE = 0.5
BITS = (12, 13)
RESULTS = ("__lang", "__lang_score")
WIDTH = sum(1 << b for b in BITS)

#: FIXED VALUES: families of language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}

_FOLD = LOWER.copy()
_FOLD[0:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def gram_numbers(data: np.ndarray) -> list[np.ndarray]:
    """Feature number of the 2-gram and the 3-gram at every byte of the folded text."""
    x = _FOLD[data].astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    a = (two * np.uint32(2654435761)) >> np.uint32(32 - BITS[0])
    b = ((three * np.uint32(2246822519)) >> np.uint32(32 - BITS[1])) + np.uint32(1 << BITS[0])
    return [a, b]


def _counts(data: np.ndarray) -> np.ndarray:
    """Feature counts of a text as 2-byte numbers (scaled down together where one would not fit)."""
    out = np.zeros(WIDTH, dtype=np.int64)
    if len(data) >= 3:
        for numbers in gram_numbers(data):
            out += np.bincount(numbers, minlength=WIDTH)
    top = out.max()
    return (out * 65_535 // top if top > 65_535 else out).astype(np.uint16)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear support vector machine, by dual coordinate descent on the rows' inner products."""
    products = (x @ x.T).astype(np.float64) + 1.0  # 1: the bias as one more feature
    products *= y[:, None]
    products *= y
    norms = products.diagonal() + 1e-12
    alpha, margins = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = min(max(alpha[i] + (1 - margins[i]) / norms[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                margins += step * products[i]
    return (alpha * y).astype(np.float32) @ x, float(alpha @ y)


class Model:
    """Pairwise machines over families and within families; ``table`` holds one weight column per pair."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, c: float = 10.0):
        self.langs = sorted(langs)
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        family = np.array([family_of(v) for v in y]) if len(y) else np.array([], dtype=str)
        self.scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32) if len(x) else np.ones(WIDTH, np.float32)
        x = x * self.scale
        self.pairs: list[tuple[str, str]] = []
        columns, bias, slopes = [], [], []
        jobs = [(p, family) for p in combinations(self.families, 2)]
        jobs += [(p, y) for f in self.families for p in combinations(self.members[f], 2)]
        for (a, b), target in jobs:
            rows = np.flatnonzero((target == a) | (target == b))
            sign = np.where(target[rows] == a, 1.0, -1.0)
            own = x if len(rows) == len(x) else x[rows]
            w, offset = _svm(own, sign, c)
            margins = sign * (own @ w + offset)
            slopes.append(min((0.5, 1.0, 2.0, 4.0, 8.0), key=lambda s: float(np.logaddexp(0, -s * margins).mean() + 0.02 * s)))
            self.pairs.append((a, b))
            columns.append(w * self.scale)
            bias.append(offset)
        self.table = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((WIDTH, 0), np.float32)
        self.bias, self.slopes = np.array(bias), np.array(slopes)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pair margins of every row: a sum of table entries over the row's grams."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.pairs)))
        lengths = np.diff(offsets)
        if not len(self.pairs) or len(data) < 3:
            return out + self.bias
        for k, numbers in zip((2, 3), gram_numbers(data)):
            for j in range(len(self.pairs)):
                run = np.zeros(len(numbers) + 1)
                np.cumsum(self.table[:, j][numbers], dtype=np.float64, out=run[1:])
                ends = np.maximum(offsets[1:] - (k - 1), offsets[:-1])
                ok = lengths >= 3
                out[ok, j] += run[np.minimum(ends, len(numbers))[ok]] - run[offsets[:-1][ok]]
        return out / np.maximum(lengths, 1)[:, None] + self.bias

    def _vote(self, classes: list[str], rows: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winning class number, probability) by pairwise votes; margins break ties, then the order of names."""
        votes, weight, sure = np.zeros((len(rows), len(classes))), np.zeros((len(rows), len(classes))), np.ones((len(rows), len(classes)))
        for j, (a, b) in enumerate(self.pairs):
            if a in classes and b in classes:
                m = margins[rows, j]
                p = 1 / (1 + np.exp(-np.clip(self.slopes[j] * m, -30, 30)))
                for name, sign, share in ((a, 1, p), (b, -1, 1 - p)):
                    at = classes.index(name)
                    votes[:, at] += (m >= 0) if sign > 0 else (m < 0)
                    weight[:, at] += np.tanh(sign * m)
                    sure[:, at] = np.minimum(sure[:, at], share)
        best = np.argmax(votes * 1000 + weight, axis=1)
        return best, sure[np.arange(len(rows)), best]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(margins)
        names, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        if not self.langs:
            return names, score
        every = np.arange(n)
        family, first = self._vote(self.families, every, margins)
        for f, name in enumerate(self.families):
            rows = every[family == f]
            best, second = self._vote(self.members[name], rows, margins)
            names[rows] = np.array(self.members[name], dtype=object)[best]
            score[rows] = np.minimum(first[rows], second)
        return names, score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> Model:
    """Fit a model to the rows of ``labelled`` with a language: the ``max_per_lang`` distinct texts of each with the smallest hashes."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model([], np.zeros((0, WIDTH)), np.array([]))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # First within parts of a language, so that a language with most of the rows is ranked by several tasks; then over the parts' smallest.
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))
    in_lang = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    smallest = hashed.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(LANG_PARTS)))
    smallest = smallest.withColumn("place", in_part).where(F.col("place") <= max_per_lang).withColumn("place", in_lang).where(F.col("place") <= max_per_lang).select("lang", "h")
    picked = hashed.join(F.broadcast(smallest), ["lang", "h"]).select("lang", "h", "text")  # max_per_lang hashes per language

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            packed = [zlib.compress(_counts(data[a:b]).tobytes(), 1) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(packed, pa.binary())], names=["lang", "h", "n", "counts"])

    # One vector of a few KB for each hash reaches the driver; copies of a text have equal vectors.
    one = picked.mapInArrow(vectors, "lang string, h long, n long, counts binary").groupBy("lang", "h").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    found = sorted((r["lang"], r["n"], bytes(r["counts"])) for r in one.collect())
    x = np.empty((len(found), WIDTH), dtype=np.float32)
    for i, (_, n, counts) in enumerate(found):
        x[i] = np.frombuffer(zlib.decompress(counts), dtype=np.uint16) / np.float32(max(n, 1))
    y = np.array([lang for lang, _, _ in found])
    return Model(sorted(set(y.tolist())), x, y)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.concatenate(([0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))))
    out = letter[offsets[1:]] > letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__lang`` and ``__lang_score`` added, in place."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in RESULTS])
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in pieces(batches, text_col, 1 << 20):
            lang, score = m.predict(m.margins(data, offsets))
            blank = ~_has_letter(data, offsets)
            lang[blank], score[blank] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
                                             names=[*names, "__lang", "__lang_score"])

    return docs.mapInArrow(run, schema)


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def accepted(docs: DataFrame, train_on: DataFrame, text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is determined with at least ``min_score``, their columns unchanged."""
    model = train(train_on, text_col, lang_col)
    rows, names = set_aside(docs, RESULTS)
    found = identify(rows, model, names.get(text_col, text_col))
    return found.where((F.col("__lang") != UNDETERMINED) & (F.col("__lang_score") >= min_score)).select(*put_back(docs.columns, names))
