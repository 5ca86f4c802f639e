"""Importance resampling towards a target: documents are weighed by how much likelier their features are in the target texts.

Features are runs of words hashed into buckets. The documents' counts are written once, as a sparse matrix in CSR blocks (1 MB of text a
block, a row each; row groups and Arrow batches hold a few, so that a task's memory does not grow with its share of the table) in the shared folder. Column sums of the blocks, a vector as long as there are buckets, give the corpus's distribution; the target's
comes the same way. A bucket's gain is the rounded log of their ratio, and a block times the vector of gains gives its documents' weights. Gumbel
noise from a hash of the doc_id turns the highest scores into a weighted sample without replacement.

The draw needs no global sort in one task: scored rows are dealt by ranges of (score, doc_id), the sizes of the ranges (one number a partition) give
each range's first rank, and rows are numbered inside their range. Rows equal in all columns are counted before they are dealt, so that
copies can't fill a range.

Edge cases: a null or empty text has no feature and weight 0, and is never drawn (fewer than `least_words`); a null doc_id draws the noise of the text
"null" and comes last among equal scores; rows that share score and doc_id are ordered by n_features and weight, and rows equal in all are
interchangeable. An empty target or corpus counts as one without features. Other columns are never read and may bear any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import bound_batches, staged

from .base import pick, text_slices, texts_of

#: Bytes of words: digits, lower-case letters and all of non-ASCII characters; A-Z are lowered and the rest parts words.
_PARTS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_BLOCK = "doc_id array<long>, words array<long>, indptr array<long>, indices array<int>, counts array<int>"


@dataclass(frozen=True)
class Settings:
    """`longest` is the most words of a feature; `percent` of the documents with `least_words` or more are drawn."""

    buckets: int = 10_000
    longest: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    block_bytes: int = 1 << 20


class Buckets(dict):
    """Buckets of features, remembered up to a bound; what is forgotten is computed again, with the same result."""

    def __init__(self, n: int, limit: int = 200_000):
        super().__init__()
        self.n, self.limit = n, limit

    def __missing__(self, feature: bytes) -> int:
        value = self[feature] = crc32(feature) % self.n
        return value


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PARTS).split()


def bucket_counts(text: str, buckets: Buckets, longest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the buckets of the text's features in ascending order with their counts."""
    words = words_of(text)
    if len(buckets) > buckets.limit:
        buckets.clear()
    found = np.fromiter((buckets[x] for x in words), np.int32, len(words))
    more = [np.fromiter((crc32(b" ".join(words[i : i + n])) % buckets.n for i in range(len(words) - n + 1)), np.int32) for n in range(2, longest + 1)]
    return len(words), *np.unique(np.concatenate([found, *more]), return_counts=True)


def csr_blocks(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The sparse count matrix of `rows` (doc_id, text): one row a block of documents, with its CSR arrays and the documents' word counts."""
    kinds = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())] * 2
    names = ["doc_id", "words", "indptr", "indices", "counts"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(s.buckets)
        for batch in text_slices(batches, limit=s.block_bytes):
            found = [bucket_counts(x, buckets, s.longest) for x in texts_of(batch)]
            indptr = np.concatenate([[0], np.cumsum([len(at) for _, at, _ in found])])
            arrays = [batch.column("doc_id").to_pylist(), [n for n, _, _ in found], indptr, np.concatenate([at for _, at, _ in found]), np.concatenate([c for _, _, c in found])]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(arrays, kinds)], names)

    return pick(rows, "doc_id", "text").mapInArrow(build, _BLOCK)


def column_sums(blocks: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Features by bucket, over all documents: each task sends at most one number a bucket, and so does the result."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in batches:
            indices, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "counts"))
            # Whole numbers below 2**53 are exact as doubles.
            total += np.bincount(indices, weights=counts, minlength=s.buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(s.buckets, np.int64)
    for bucket, n in blocks.select("indices", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of target to corpus share of each bucket, both smoothed by one, rounded down."""
    n = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(c + 1) * float(t_all + n)))) for c, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: each block's matrix times the vector of gains."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, indptr, indices, counts = (batch.column(c)[k].values for c in ("doc_id", "words", "indptr", "indices", "counts"))
                indptr, indices, counts = (x.to_numpy(zero_copy_only=False) for x in (indptr, indices, counts))
                runs = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (counts, counts * v[indices])]
                n, weight = (x[indptr[1:]] - x[indptr[:-1]] for x in runs)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(times, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, times 1000 and rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    return F.floor(-1000 * F.ln(-F.ln((F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`scored` (doc_id, n_words, n_features, weight, score) with the rank of the documents drawn, null for the others."""
    able = F.coalesce(F.col("n_words") >= s.least_words, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    kinds = scored.where(able).groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("n"))
    ranged = staged(kinds.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-ranges")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    drawn = s.percent * sum(n for _, n in sizes) // 100
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    before = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, before long"))
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(before, "part").withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    rank = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n")))
    placed = placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; `target` has the texts to come near to."""
    bound_batches(documents.sparkSession)
    blocks = staged(csr_blocks(documents, s), "resample-csr", wide=True)
    gain = gains(column_sums(blocks, s), column_sums(csr_blocks(target, s), s))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed))
    return draw(staged(scored, "resample-scores"), s)


def drawn_documents(documents: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents drawn, with their columns as they were. Rows that share a doc_id stay together: all of them, if one is drawn."""
    ids = resample(documents, target, s).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__tm_drawn")).distinct()
    return documents.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__tm_drawn")), "left_semi")
