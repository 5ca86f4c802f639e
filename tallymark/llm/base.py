"""What the corpus operators share: batching, word hashes and column clean-up.

Conventions, for every operator of this package:

* Only the columns an operator names are read; other columns may hold anything and bear any name, since operators that return whole rows carry them in
  one struct.
* A null text counts as the empty text; a null doc_id, lang or source is a value of its own, equal to other nulls.
* Words are `[^\\x20\\x09-\\x0D]+`, which is exactly what bytes.split() yields on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of a text, for SQL and regex engines.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to `limit` words; what it forgets is computed again, with the same result."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def packed(documents: DataFrame) -> DataFrame:
    """row (a struct of all columns), doc_id, text, source: no column of the table can clash with what is added to these."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in documents.columns]).alias("row")
    return documents.select(row, *[(F.col(f"`{n}`") if n in documents.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (("doc_id", "long"), ("text", "string"), ("source", "string"))])


def unpacked(rows: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The table's columns again, those in `new` replaced."""
    new = new or {}
    names = rows.schema["row"].dataType.names
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is null, so that narrow inputs work too."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])
