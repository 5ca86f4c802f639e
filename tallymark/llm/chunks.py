"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends before a word whose preceding 32 bytes hash below a mark, or, where those
32 bytes hold no white space (Chinese, Japanese, Thai, base64), before any character for which they do so below a lower one. So chunks begin and end with
their content and fall back into step soon after an insertion, in any script. Chunks are
deduplicated by a 128-bit digest: all but the first one in the corpus, by doc_id and then place, are copies. Neighbouring copies
make a span; spans of `MIN_SPAN` bytes or more are reported. A passage that documents share is found but for the
chunks at its two ends, which hold foreign text.

Edge cases: a null or empty text has no chunk. Text that offers no such place, as a run of one character, is cut at `LONGEST` bytes, between characters. Rows that share
a doc_id are one document: they are no copies of each other. A null doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import mix64, packed, pick, text_slices, texts_of, unpacked

SHORTEST, LONGEST, MIN_SPAN = 24, 256, 128
#: One word start in 2**MASK_BITS ends a chunk: chunks of about 60 bytes in prose. Without white space, one character in 2**DENSE_BITS does.
MASK_BITS, DENSE_BITS, WINDOW = 2, 4, 32
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[raw[i]] in 32 bits, so over the last 32 bytes; by doubling the window."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else h[k:]
    return h


def boundaries(raw: np.ndarray) -> list[int]:
    """Where the chunks of a text end."""
    n = len(raw)
    if not n:
        return []
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    h = gear(raw)
    ok = starts[(h[starts - 1] >> np.uint32(32 - MASK_BITS)) == 0]
    spaces = np.flatnonzero(space)
    if n > WINDOW and (not len(spaces) or max(spaces[0], n - spaces[-1], np.diff(spaces).max(initial=0)) > WINDOW):
        at = np.arange(WINDOW, n)
        seen = np.concatenate([[0], np.cumsum(space)])
        dense = at[(seen[at] == seen[at - WINDOW]) & ~space[at] & ((raw[at] & 0xC0) != 0x80) & ((h[at - 1] >> np.uint32(32 - DENSE_BITS)) == 0)]
        ok = np.union1d(ok, dense)
    cuts, last = [], 0
    for c in [*ok.tolist(), n]:
        while c - last > LONGEST:
            end = last + LONGEST
            while end > last + 1 and (raw[end] & 0xC0) == 0x80:
                end -= 1
            cuts.append(end)
            last = end
        if c - last >= SHORTEST or c == n:
            cuts.append(c)
            last = c
    return cuts


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id, tkey, first, end (bytes), d1, d2, again (an equal chunk precedes it in its text) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh3_128_digest

        for batch in text_slices(batches):
            at, first, end, digest, again = [], [], [], [], []
            for text in texts_of(batch):
                raw = text.encode("utf-8", "surrogatepass")
                cuts = boundaries(np.frombuffer(raw, np.uint8))
                start, seen = 0, set()
                for c in cuts:
                    d = xxh3_128_digest(raw[start:c])
                    first.append(start)
                    end.append(c)
                    digest.append(d)
                    again.append(d in seen)
                    seen.add(d)
                    start = c
                at.append(len(cuts))
            two = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(batch.num_rows), at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("tkey").take(row), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(again, pa.bool_())],
                ["doc_id", "tkey", "first", "end", "d1", "d2", "again"],
            )

    rows = pick(documents, "doc_id", "text")
    return rows.withColumn("tkey", text_key(F.col("text"))).mapInArrow(run, "doc_id long, tkey long, first int, end int, d1 long, d2 long, again boolean")


def duplicate_spans(documents: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """doc_id, first, end (UTF-8 bytes), n_chunks, first_doc_id (least document that holds one of its chunks), tkey (hash of the text) of every span of copies.

    Two shuffles of chunks by digest, one summed before it; copies alone go on to the window, which sees one text at a time.
    """
    every = chunks(documents).withColumn("order", F.coalesce("doc_id", F.lit(-(2**63))))
    held = every.groupBy("d1", "d2").agg(F.min("order").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = every.join(held, ["d1", "d2"]).where("again or holder < order")
    text = Window.partitionBy("doc_id", "tkey").orderBy("first")
    copies = copies.withColumn("new", F.when(F.col("first") <= F.lag("end").over(text), 0).otherwise(1)).withColumn("span", F.sum("new").over(text))
    spans = copies.groupBy("doc_id", "tkey", "span").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("holder").alias("holder"))
    return spans.where(F.col("end") - F.col("first") >= min_span).select("doc_id", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), "n_chunks", F.when(F.col("holder") > -(2**63), F.col("holder")).alias("first_doc_id"), "tkey")


def remove_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without the bytes of `spans` (doc_id, tkey, first, end); a text without spans, null included, stays as it is."""
    found = spans.groupBy(F.col("doc_id").alias("__tm_doc"), F.col("tkey").alias("__tm_tkey")).agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("__tm_spans"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, cuts in zip(texts, runs):
            text, cuts = text.as_py(), cuts.as_py()
            if text is None or not cuts:
                out.append(text)
                continue
            raw, at, left = text.encode("utf-8", "surrogatepass"), 0, []
            for c in cuts:
                left.append(raw[at : max(at, c["first"])])
                at = max(at, c["end"])
            out.append(b"".join([*left, raw[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    joined = packed(documents).join(found, F.col("doc_id").eqNullSafe(F.col("__tm_doc")) & (text_key(F.col("text")) == F.col("__tm_tkey")), "left")
    return unpacked(joined, {"text": cut(F.col("text"), F.col("__tm_spans"))})
