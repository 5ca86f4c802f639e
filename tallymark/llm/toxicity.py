"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one-gap skip-grams of the lower-cased words of the whole text
(ASCII punctuation parts words). Per-coordinate learning rates and L1 leave few non-zero weights; those are
what is broadcast, and the hash space (2**bits) bounds their number whatever the corpus holds.

Edge cases: a null or empty text has no feature and scores the bias alone; a label row that is null, has no document or
is held out is not learnt from; several label rows of a document count as one, the largest; with no row to learn from,
or one class only, every score is 0.0. Documents sharing a doc_id are scored each by its own text. A null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WordHashes, mix64, packed, pick, text_slices, texts_of, unpacked

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_PARTS = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled documents that are learnt from: those of the smallest hashed doc_id.

    A feature takes part once `min_rows` of them hold it (the inclusion rule that goes with FTRL)."""

    bits: int = 20
    max_rows: int = 12_000
    min_rows: int = 5
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1


@dataclass(frozen=True)
class Weights:
    index: np.ndarray
    value: np.ndarray
    bias: float
    trained: bool


def features(text: str, words: WordHashes, bits: int) -> np.ndarray:
    """Hashed n-gram indices of a text, with repeats."""
    h = words.of(text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split())
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ np.uint64(0xC2B2AE3D27D4EB4F))
        skips = h[:-2] * np.uint64(0xD6E8FEB86659FD93) + (h[2:] ^ np.uint64(0xA0761D6478BD642F))
        return (mix64(np.concatenate([h, pairs, skips])) >> np.uint64(64 - bits)).astype(np.int64)


def fit(rows: list[tuple[int, np.ndarray]], s: Settings) -> Weights:
    """FTRL-proximal over (label, distinct indices) rows in the order given; the positive class is weighted to balance."""
    positive = sum(y for y, _ in rows)
    if not rows or positive in (0, len(rows)):
        return Weights(np.empty(0, np.int64), np.empty(0), 0.0, False)
    seen = np.bincount(np.concatenate([at for _, at in rows]), minlength=1 << s.bits) >= s.min_rows
    rows = [(y, at[seen[at]]) for y, at in rows]
    boost = min(5.0, (len(rows) - positive) / positive)
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias, bias_n = float(np.log(positive * boost / (len(rows) - positive))), 0.0
    for _ in range(s.epochs):
        for y, at in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= s.l1, 0.0, (np.sign(zi) * s.l1 - zi) / ((s.beta + root) / s.alpha + s.l2))
            score = bias + w.sum()
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, score))))
            g = (p - y) * (boost if y else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + bias_n**0.5)
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    index = np.flatnonzero(w)
    return Weights(index, w[index], bias, True)


def score_texts(texts: Iterable[str], weights: Weights, dense: np.ndarray, words: WordHashes, bits: int) -> np.ndarray:
    if not weights.trained:
        return np.array([0.0 for _ in texts])
    out = []
    for text in texts:
        at = features(text, words, bits)
        out.append(weights.bias + dense[np.unique(at[dense[at] != 0])].sum())
    return 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Weights:
    """Learn from at most `max_rows` labelled documents that are not held out, in one task, and fetch the sparse weights."""
    # max_rows rows of two numbers: the broadcast has that bound.
    rows = labels.select(F.col("doc_id").cast("long").alias("__tm_id"), F.col("toxic").cast("int").alias("__tm_y"))
    rows = rows.where(F.col("__tm_y").isin(0, 1) & F.col("__tm_id").isNotNull() & ~held_out(F.col("__tm_id")))
    rows = rows.groupBy("__tm_id").agg(F.max("__tm_y").alias("__tm_y")).withColumn("__tm_h", F.xxhash64("__tm_id"))
    rows = rows.orderBy("__tm_h", "__tm_id").limit(settings.max_rows)
    docs = pick(documents, "doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__tm_id"))

    def featurise(batches):
        words = WordHashes()
        for batch in text_slices(batches):
            blobs = [np.unique(features(x, words, settings.bits)).astype("<u4").tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("__tm_h"), batch.column("__tm_y"), pa.array(blobs, pa.binary())], ["h", "y", "f"])

    def learn(batches):
        rows = [(y, np.frombuffer(f, "<u4").astype(np.int64)) for b in batches for y, f in zip(b.column("y").to_pylist(), b.column("f").to_pylist())]
        w = fit(rows[: settings.max_rows], settings)
        yield pa.RecordBatch.from_arrays([pa.array([w.index.astype("<i8").tobytes()], pa.binary()), pa.array([w.value.astype("<f8").tobytes()], pa.binary()), pa.array([w.bias]), pa.array([w.trained])], ["i", "v", "b", "t"])

    ready = docs.select("__tm_h", "__tm_y", "text").mapInArrow(featurise, "h long, y int, f binary")
    ready = ready.repartition(1).sortWithinPartitions("h", "y", "f")
    found = ready.mapInArrow(learn, "i binary, v binary, b double, t boolean").collect()
    if not found:
        return Weights(np.empty(0, np.int64), np.empty(0), 0.0, False)
    (w,) = found
    return Weights(np.frombuffer(w.i, "<i8"), np.frombuffer(w.v, "<f8"), w.b, w.t)


def score(documents: DataFrame, weights: Weights, column: str = "score", settings: Settings = Settings()) -> DataFrame:
    """`documents` with one more column, the toxicity score of each whole text; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    bits = settings.bits

    @F.arrow_udf("double")
    def of_text(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, w = WordHashes(), shared.value
        dense = np.zeros(1 << bits)
        dense[w.index] = w.value
        for array in arrays:
            yield pa.array(score_texts((x.as_py() or "" for x in array), w, dense, words, bits), pa.float64())

    return documents.withColumn(column, of_text(F.col("text").cast("string")))


def toxicity(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    weights = train(documents, labels, settings)
    return score(pick(documents, "doc_id", "text"), weights, settings=settings).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The documents that score below `threshold`, with their columns as they were."""
    weights = train(documents, labels, settings)
    return unpacked(score(packed(documents), weights, settings=settings).where(F.col("score") < threshold))
