"""Fill-in-middle: each text is cut into prefix, middle and suffix at unit boundaries and put in another order.

A text becomes an array of code points (UTF-32). A table by (class of the left neighbour, class of the right one) says where a unit ends,
`flatnonzero` gives the boundaries, two ranks drawn from a hash of the doc_id pick two of them, and the pieces are sliced and encoded
again. Rows are independent: there is no shuffle, and one text is the most that a task holds besides its Arrow batch.

Edge cases: a null text counts as empty; an empty text and one that holds a marker already stay as they are (form `plain`), since the cut could not
be undone; a null doc_id hashes like the text "null", so such rows share their draws. Pieces may be empty. A unit is never cut, however long.
Repeated rows give repeated results; other columns are never read and may bear any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import packed, pick, text_slices, texts_of, unpacked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of code points: 0 other, 1 white space of ASCII, 2 the line feed.
_CLASS = np.zeros(128, np.int8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
#: By unit, whether one ends between a left and a right class: a line ends after its line feed, a word after the white space that follows it.
ENDS = {
    "line": np.array([[0, 0, 0], [0, 0, 0], [1, 1, 1]], bool),
    "word": np.array([[0, 0, 0], [1, 0, 0], [1, 0, 0]], bool),
    "character": np.ones((3, 3), bool),
}


@dataclass(frozen=True)
class Settings:
    """`rate` and `spm_rate` are per cent: texts that are cut at all, and of those the ones that begin with the suffix."""

    seed: int = 7
    unit: str = "line"
    rate: int = 100
    spm_rate: int = 50


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: str
    prefix: int | None = None
    middle: int | None = None


def boundaries(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units begin, and the length at the end: n + 1 numbers for n units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = _CLASS[np.minimum(points, 127)]
    inner = np.flatnonzero(ENDS[unit][kind[:-1], kind[1:]]) + 1
    return np.concatenate([[0], inner, [len(points)]])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(doc_id: int | None, text: str, s: Settings = Settings()) -> Cut:
    """The transformed text of one document."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = boundaries(points, s.unit)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(doc_id, s.seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= s.rate:
        return Cut(n, "plain", text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (points[: at[a]], points[at[a] : at[b]], points[at[b] :]))
    spm = h4 % 100 < s.spm_rate
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return Cut(n, "spm" if spm else "psm", output, int(at[a]), int(at[b] - at[a]))


def restore(output: str, form: str) -> str:
    """The text that `cut` was given. No text that is cut holds a marker and no marker overlaps itself, so the first ones found are those put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    x, y, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return x + middle + y if form == "psm" else y + middle + x


def transform(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with the transformed text in place of theirs, and their other columns as they were."""

    @F.arrow_udf("string")
    def output(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            yield pa.array([cut(i, t or "", settings).output for i, t in zip(ids.to_pylist(), texts.to_pylist())], pa.string())

    rows = packed(documents).withColumn("__tm_output", output(F.col("doc_id"), F.col("text")))
    return unpacked(rows, {"text": F.col("__tm_output")})


def digests(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                x = cut(doc_id, text, settings)
                rows.append((doc_id, x.n, x.form, x.prefix, x.middle, sha(x.output), sha(restore(x.output, x.form))))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    return pick(documents, "doc_id", "text").mapInArrow(run, schema)


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
ranked AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS p, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(p, q)], '') AS prefix, array_to_string(units[least(p, q) + 1:greatest(p, q)], '') AS middle,
         array_to_string(units[greatest(p, q) + 1:], '') AS suffix FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
