"""Line dedup by winnowing: later copies of repeated runs of lines are deleted.

A document is the sequence of its `\\n`-split lines that hold a word. A *gram* is the shortest run of lines that holds `MIN_WORDS` words
and begins, or ends, at a given one. Every gram is a fingerprint (winnowing with a window of one: a gram that a wider window leaves out can be
the only one that holds a line), and each occurrence but the first one in the corpus, by (doc_id, place), is deleted.

This deletes just the lines of later copies of runs of `MIN_WORDS` words or more, whichever earlier document holds the run: take a
line of such a run. If the run holds `MIN_WORDS` words up to and with this line, the gram that ends here is in the run; if not, the gram that begins
where the run begins goes beyond this line and is in the run. The first occurrence of a line stays, since no gram that holds it occurred before.

Edge cases: a null or empty text has no lines. White-space lines take part in nothing and go only inside a deleted run.
Within one document the first run stays. Rows equal in doc_id and text are the same document and get the same answer; a null doc_id sorts
first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import staged

from .base import packed, pick, text_slices, texts_of, unpacked

MIN_WORDS = 25


def fingerprints(hashes: list[int], words: list[int]) -> list[tuple[int, int, bytes]]:
    """(first line, lines, digest) of every gram, once each."""
    from xxhash import xxh3_128_digest

    raw, n = np.array(hashes, np.uint64).tobytes(), len(hashes)
    spans, end, total = set(), 0, 0
    for i in range(n):
        while end < n and total < MIN_WORDS:
            total += words[end]
            end += 1
        if total < MIN_WORDS:
            break
        spans.add((i, end))
        total -= words[i]
    start = total = 0
    for i in range(n):
        total += words[i]
        while total - words[start] >= MIN_WORDS:
            total -= words[start]
            start += 1
        if total >= MIN_WORDS:
            spans.add((start, i + 1))
    return [(i, end - i, xxh3_128_digest(raw[8 * i : 8 * end])) for i, end in sorted(spans)]


def parse(text: str) -> tuple[list[int], list[int]]:
    """Hash and word count of each line that holds a word."""
    from xxhash import xxh3_64_intdigest

    hashes, words = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        n = len(line.split())
        if n:
            hashes.append(xxh3_64_intdigest(line))
            words.append(n)
    return hashes, words


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _prints(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches):
            prints = []
            for text in texts_of(batch):
                prints.append([{"pos": i, "n": n, "f1": int.from_bytes(d[:8], "little", signed=True), "f2": int.from_bytes(d[8:], "little", signed=True)} for i, n, d in fingerprints(*parse(text))])
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(prints, kind)], ["doc_id", "tkey", "prints"])

    rows = pick(documents, "doc_id", "text").withColumn("tkey", text_key(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, tkey long, prints array<struct<pos: int, n: int, f1: long, f2: long>>")


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text) and runs (array of first and end line) of each document with later copies. Lines without a word aren't counted."""
    prints = staged(_prints(documents), "line-prints")
    own = F.struct("doc_id", "tkey", "pos")
    marks = prints.select("doc_id", "tkey", F.inline("prints")).withColumn("own", own)
    first = marks.groupBy("f1", "f2").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first < last").drop("last")
    spans = marks.join(first, ["f1", "f2"]).where("own > first").select("doc_id", "tkey", F.col("pos").alias("first"), (F.col("pos") + F.col("n")).alias("end"))
    return spans.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("runs"))


def cut(text: str, runs: list) -> tuple[str, int]:
    """The text without the lines of `runs`, and how many lines with a word went."""
    lines, gone = text.split("\n"), set()
    for r in runs:
        gone.update(range(r["first"], r["end"]))
    out, k, last_gone = [], 0, False
    for line in lines:
        if line.encode("utf-8", "surrogatepass").split():
            last_gone = k in gone
            k += 1
            if last_gone:
                continue
        elif last_gone and k in gone:  # a blank line inside a run
            continue
        out.append(line)
    return "\n".join(out), len(gone)


def _cut_documents(documents: DataFrame) -> DataFrame:
    """row, doc_id, text of each document, and cut: the text left and the number of lines deleted, null where nothing is."""
    runs = repeated_runs(documents).select(F.col("doc_id").alias("run_doc"), F.col("tkey").alias("run_tkey"), "runs")

    @F.arrow_udf("text string, n int")
    def cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
        done = [cut(t.as_py() or "", r.as_py()) if r.is_valid else None for t, r in zip(texts, spans)]
        return pa.array([None if d is None else {"text": d[0], "n": d[1]} for d in done], pa.struct([("text", pa.string()), ("n", pa.int32())]))

    joined = packed(documents).join(runs, F.col("doc_id").eqNullSafe(F.col("run_doc")) & (text_key(F.col("text")) == F.col("run_tkey")), "left")
    return joined.select("row", "doc_id", "text", F.when(F.col("runs").isNotNull(), cut_text(F.col("text"), F.col("runs"))).alias("cut"))


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_lines_deleted, kept_sha256 (of the text that stays) of each document."""
    rows = _cut_documents(pick(documents, "doc_id", "text"))
    left = F.coalesce(F.col("cut.text"), F.col("text"), F.lit(""))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return rows.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n_lines_deleted"), F.sha2(left, 256).alias("kept_sha256"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents without later copies of repeated runs; n_chars follows the text, and a document of which no word is left goes."""
    rows = _cut_documents(documents)
    text = F.coalesce(F.col("cut.text"), F.col("text"))
    emptied = F.col("cut").isNotNull() & ~F.col("cut.text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("cut").isNotNull(), F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(rows.where(~F.coalesce(emptied, F.lit(False))), new)
