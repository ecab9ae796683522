"""Ordinal quality classifier: cumulative-link regression on graded ratings.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good). One score, the sum of the
weights of a text's hashed features, is shared by all grades; ordered
thresholds cut it: ``P(grade <= k) = sigmoid(threshold_k - score)``. This gives
the expected grade and the tail probability ``P(grade >= g)`` that selects
documents.

Features of the whole text are present or not: its words (letters and digits,
lower case) and their first bytes, its runs of other signs, and bands of how much is upper case,
signs, digits or repeated words, and of the length. Each is hashed into one of
``2 ** BITS`` buckets, and every bucket has a weight.

The model is fitted in one task on a sample of at most ``max_rows`` rated
documents, those with the smallest hash of their id; all documents are scored,
each where it is read, without a shuffle.

Defined results: null or empty texts have only the features of an empty text;
a document with several ratings has its worst; ratings without a grade, without
a document or with a null id are left out; rows that repeat an id are one rated
document, and each is scored; without any usable rating, all features weigh
nothing, and documents get the grades' even odds and are kept; further columns
are kept by ``select`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, NOT_SPACE, hash_spans, mix, slices, utf8, word_spans
from .scratch import staged

GRADES = 3
MAX_ROWS = 20_000
BITS = 18
STEPS = 150
RATE = 0.08
RIDGE = 1.0
STEM_BYTES = 4
#: Documents are kept from this probability of the highest grade.
KEEP_FROM = 0.5

_SIGN = NOT_SPACE & ~ALNUM
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = ALNUM & ~_DIGIT


def _share(mask: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of 16 bands: the share of a text's bytes in ``whole`` that the mask holds, in finer steps where it is small."""
    total = lambda m: np.diff(np.append(0, np.cumsum(m))[offsets])
    part, all_ = total(mask), total(whole)
    return np.floor(15 * np.sqrt(part / np.maximum(all_, 1))).astype(np.uint64)


def hashed(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of texts: their number, and (text, bucket) of all features that they hold, each once, in order."""
    for a, b in slices(col):
        buf, offsets = utf8(col.slice(a, b - a))
        n = b - a
        low = LOWER[buf]
        starts, ends, at = word_spans(low, offsets, ALNUM)
        of_word = np.repeat(np.arange(n), np.diff(at))
        words = _buckets(of_word, hash_spans(low, starts, ends, 1))
        stems = _buckets(of_word, hash_spans(low, starts, np.minimum(ends, starts + STEM_BYTES), 3))
        starts, ends, sign_at = word_spans(buf, offsets, _SIGN)
        signs = _buckets(np.repeat(np.arange(n), np.diff(sign_at)), hash_spans(buf, starts, ends, 2))
        ink = NOT_SPACE[buf]
        bands = [_share(_UPPER[buf], offsets, _LETTER[buf]), _share(_SIGN[buf], offsets, ink), _share(_DIGIT[buf], offsets, ink)]
        count = np.diff(at)
        size = np.floor(np.log2(count + 1.0)).astype(np.uint64)
        fresh = (15 * np.bincount(words >> BITS, minlength=n) // np.maximum(count, 1)).astype(np.uint64)
        tags = [band + np.uint64(100 * i) for i, band in enumerate(bands, 1)]
        tags += [size + np.uint64(400), fresh + np.uint64(500) + np.uint64(20) * np.minimum(size, np.uint64(12))]
        shape = [_buckets(np.arange(n), mix(t ^ np.uint64(0xD1B54A32D192ED03))) for t in tags]
        held = np.unique(np.concatenate([words, stems, signs, *shape]))
        yield n, held >> BITS, held & ((1 << BITS) - 1)


def _buckets(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Text and bucket in one number, each pair once."""
    return np.unique((rows.astype(np.int64) << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))


def features(col: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each text."""
    for n, rows, cols in hashed(col):
        at = np.searchsorted(rows, np.arange(n + 1))
        yield from (cols[at[k] : at[k + 1]] for k in range(n))


@dataclass(frozen=True)
class OrdinalModel:
    """A weight for each bucket, and the thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, col: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for n, rows, cols in hashed(col):
            out.append(np.bincount(rows, self.weights[cols], n))
        return np.concatenate(out)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g from 1: one column each."""
        return _sigmoid(scores[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a cumulative-link model, by full-batch Adam steps.

    (rows, cols) name the features that are present. The first threshold is
    free, the others follow at exp(gap).
    """
    n, cuts = len(grade), GRADES - 1
    seen = np.bincount(grade, minlength=GRADES) + 1.0
    odds = np.cumsum(seen)[:-1] / seen.sum()
    first = np.log(odds / (1 - odds))
    at = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    mean, square = np.zeros_like(at), np.zeros_like(at)

    def thresholds(at: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(at[width], np.exp(at[width + 1 :])))

    for step in range(1, steps + 1):
        score = np.bincount(rows, at[cols], n)
        cut = thresholds(at)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = edge[grade + 1] - score, edge[grade] - score
        s_high, s_low = _sigmoid(high), _sigmoid(low)
        prob = np.maximum(s_high - s_low, 1e-12)
        d_high, d_low = s_high * (1 - s_high) / prob, s_low * (1 - s_low) / prob
        by_score = (d_high - d_low) / n  # of the negative log likelihood
        grad = np.empty_like(at)
        grad[:width] = np.bincount(cols, by_score[rows], width) + ridge * at[:width] / n
        by_cut = np.array([(d_low[grade == k + 1].sum() - d_high[grade == k].sum()) / n for k in range(cuts)])
        grad[width] = by_cut.sum()
        for k in range(1, cuts):
            grad[width + k] = by_cut[k:].sum() * np.exp(at[width + k])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        at = at - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:width], thresholds(at)


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``grade`` of each rated document: toxic 0, poor 1, good 2; its worst if it has several."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(id_col).alias("id"), grade.alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.min("grade").alias("grade"))


def _fitter(steps: int, ridge: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols, grade = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for batch in batches:
            at = len(grade)
            for n, row, col in hashed(batch.column(1)):
                rows.append((row + at).astype(np.int32))
                cols.append(col.astype(np.int32))
                at += n
            grade += batch.column(0).to_pylist()
        weights, cuts = fit_ordinal(np.concatenate(rows), np.concatenate(cols), np.array(grade, np.int64), 1 << BITS, steps, ridge)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([cuts.tobytes()])], ["weights", "cuts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, steps: int = STEPS, ridge: float = RIDGE) -> OrdinalModel:
    """Fit the model on at most ``max_rows`` rated documents."""
    rated = grades(labels, id_col).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rated = F.broadcast(rated)  # max_rows ids and grades
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = staged(texts.join(rated, "id").groupBy("id").agg(F.min("grade").cast("int").alias("grade"), F.min("text").alias("text")), "quality-sample")
    fitted = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("grade", "text").mapInArrow(_fitter(steps, ridge), "weights binary, cuts binary").first()
    if fitted is None:
        return OrdinalModel(np.zeros(1 << BITS), np.array([-1.0, -0.5]))
    return OrdinalModel(np.frombuffer(fitted["weights"], float), np.frombuffer(fitted["cuts"], float))


def _scorer(model, keep: list[str], text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            tails = own.tails(own.scores(batch.column(text)))
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(1 - tails[:, 0])], [*keep, "expected_grade", "tail", "bottom"])

    return run


def score(docs: DataFrame, model: OrdinalModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``expected_grade``, ``tail`` (probability of the highest grade) and ``bottom`` (of the lowest)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(_scorer(shared, keep, text_col), f"{kind}, expected_grade double, tail double, bottom double")


def select(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those whose tail probability is below ``keep_from``; only texts go to the Python workers."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, **options))

    def tail(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.tails(shared.value.scores(texts))[:, -1])

    return docs.where(F.arrow_udf(tail, "double")(F.col("text").cast("string")) >= keep_from)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its expected grade, tail probability, and whether it is kept."""
    got = score(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"])
    return got.select("doc_id", F.round("expected_grade", 4).alias("expected_grade"), F.round("tail", 4).alias("tail_probability"), (F.col("tail") >= KEEP_FROM).alias("keep"))
