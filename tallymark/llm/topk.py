"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers floor(64 x). The index of a block of rows holds, for each dimension and each value that occurs, a posting
segment of the rows with that value; its impact for a query is the query's component times the value, counted from
the dimension's least favourable value, so that impacts are never negative. Segments are processed by descending
quantised impact (the largest over a group of queries), which adds to the accumulators of their rows. What is still unprocessed bounds how much any score can
grow. Processing stops only on that proof: once a query's k-th best accumulator exceeds what rows outside a short
list can reach, the list's rows are scored exactly and ranked. A query that gains no short list is processed to the end, which is exact too.

Queries and rows are dealt into a grid of cells of bounded size; each cell yields at most k rows a query and a window over those picks the answer.

Edge cases: vectors that are null, empty, or hold a null or a non-finite component take no part. A query meets the vectors of its own length. A row
never answers its own query (equal vec_id); ties go to the smaller vec_id. Rows that share a vec_id are rows of their own as answers; as queries those
equal in their integers are one, and others of one vec_id are answered each for itself, k rows each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 64


class ImpactIndex:
    """Posting segments of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low, self.high = vectors.min(0), vectors.max(0)
        self.segments: list[tuple[int, int, np.ndarray]] = []
        for d in range(vectors.shape[1]):
            order = np.argsort(vectors[:, d], kind="stable")
            values, at = np.unique(vectors[order, d], return_index=True)
            self.segments += [(d, int(v), rows) for v, rows in zip(values, np.split(order, at[1:]))]
        self.dims = np.array([s[0] for s in self.segments])
        self.values = np.array([s[1] for s in self.segments])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of the query, row numbers and exact scores of the k best rows of the block."""
        for at in range(0, len(queries), GROUP):
            for j, found, scores in self._group(query_ids[at : at + GROUP], queries[at : at + GROUP], k):
                yield at + j, found, scores

    def _group(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        n = len(self.ids)
        base = np.where(q >= 0, self.low, self.high)  # the least favourable value by query and dimension
        # Impact of each segment for each query, and the order for the group: the largest first, in quantised levels.
        impact = q[:, self.dims] * (self.values[None, :] - base[:, self.dims])
        most = impact.max(0)
        level = np.floor(np.log2(most + 1) * 4).astype(int)
        order = np.argsort(-level, kind="stable")
        score = np.zeros((n, len(q)), np.int64)
        # Left over for a query: by dimension, the largest impact among its unprocessed segments.
        left = np.zeros((self.vectors.shape[1], len(q)), np.int64)
        stops = [int(len(order) * f) for f in (0.6, 0.75, 0.85, 0.92, 1.0)]
        start, open_queries = 0, np.arange(len(q))
        whole = (q * base).sum(1)
        for stop in stops:
            for s in order[start:stop]:
                d, _, rows = self.segments[s]
                score[rows] += impact[:, s]
            start = stop
            left[:] = 0
            for s in order[stop:]:
                np.maximum(left[self.dims[s]], impact[:, s], out=left[self.dims[s]])
            rest = left.sum(0)
            still = []
            for j in open_queries.tolist():
                own = self.ids != query_ids[j]
                column = score[:, j]
                many = int(own.sum())
                if many > k:
                    floor = np.partition(column[own], many - k)[many - k]
                    possible = np.flatnonzero(own & (column + rest[j] >= floor))
                else:
                    possible = np.flatnonzero(own)
                if len(possible) > max(4 * k, n // 20) and stop < len(order):
                    still.append(j)  # no short list yet
                    continue
                exact = self.vectors[possible] @ q[j]
                best = np.lexsort((self.ids[possible], -exact))[:k]
                yield j, possible[best], exact[best]
            open_queries = np.array(still, int)
            if not still:
                return


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v = floor(64 x) as array<long> of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & fit).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 64)).alias("v"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", rows_per_cell: int = 16_384, queries_per_cell: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query (vec_id divisible by `every`) among all other rows."""
    rows = integers(vectors, id_column, vector)
    is_query = F.col("vec_id") % every == 0
    n, q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    g, r = max(1, math.ceil(n / rows_per_cell)), max(1, math.ceil(q / queries_per_cell))
    rows = rows.withColumn("length", F.size("v"))
    left = rows.select("length", F.pmod(F.xxhash64("vec_id"), F.lit(g)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), F.lit(False).alias("query"), "vec_id", "v")
    asked = rows.where(is_query).select("length", "vec_id", "v").distinct()
    right = asked.select("length", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), F.pmod(F.xxhash64("vec_id"), F.lit(r)).cast("int").alias("r"), F.lit(True).alias("query"), "vec_id", "v")

    def cell(table: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = [], [], [], []
        ids, column = table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
        matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.int64)
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        if query.any() and not query.all():
            index = ImpactIndex(ids[~query], matrix[~query])
            asked, marks = ids[query], table.column("mark").to_numpy()[query]
            for j, found, scores in index.search(asked, matrix[query], k):
                out[0].extend([int(asked[j])] * len(found))
                out[1].extend(index.ids[found].tolist())
                out[2].extend(scores.tolist())
                out[3].extend([int(marks[j])] * len(found))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64()), "mark": pa.array(out[3], pa.int64())})

    # The mark of a query tells vectors of one id apart.
    dealt = left.unionByName(right).withColumn("mark", F.xxhash64("v"))
    found = dealt.groupBy("length", "g", "r").applyInArrow(cell, "query_id long, vec_id long, score long, mark long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")  # k rows a cell of the query's line
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v AS asked, r.vec_id AS vec_id, list_dot_product([x::DOUBLE FOR x IN q.v], [x::DOUBLE FOR x IN r.v])::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v r ON q.vec_id <> r.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= 20
"""
