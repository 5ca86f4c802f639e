"""Token ids as Arrow files of equal-length sequences.

Layout. Documents are dealt into shards by ascending doc_id; a shard is one Arrow IPC *file* `part-<shard>-<attempt>.arrow` with
fixed-size-list record batches: `ids` (fixed_size_list<uint16 or uint32>[length]) and `mask` (fixed_size_list<bool>[length],
false on the padding that ends the shard's last sequence). The buffers are written uncompressed, so a memory map gives any
sequence as a view. Beside it `part-....docs` (Arrow as well) holds doc_id, first (place in the shard) and n_tokens.
The manifest, a DataFrame, names the files of the attempts that succeeded; a file that a lost executor left behind is in no manifest.

Encoding asks the tokenizers library, once per distinct word: white space is dropped by this tokenizer and no rule of it
looks across white space, so a text's ids are those of its words in a row. Words are looked up in lower case without their closing
ASCII punctuation, where that changes nothing. A batch's texts are split and its words told apart by Arrow, so that Python meets a word
once in a batch.

Edge cases: a null text is the empty text, whose ids are the end id alone. A null doc_id sorts first. Rows that share a doc_id
are ordered by their text's hash; identical rows are interchangeable. An empty table has no files and no rows.
"""

from __future__ import annotations

import math
import os
import posixpath
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import new_path, staged

from .base import pick, text_slices
from .pieces import gather

_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"  # no apostrophe: it may begin a contraction; no <>: they may end a special token
_ALNUM = np.array([chr(k).isalnum() and k < 128 for k in range(256)])


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer drops white space.

    `words` are asked of the library at a time. Beyond `cores` remembered words, the half that the fewest calls met is forgotten.
    """

    def __init__(self, path: str, words: int = 4096, cores: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        (self.mark,) = self.library.encode("\x01", add_special_tokens=False).ids
        self.words, self.limit, self.cores = words, cores, _Pool()
        # Whether an id ends a piece; where no id says so, words are parted by a mark.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.wide = len(self.ends) > 1 << 16
        if suffix := getattr(self.library.model, "end_of_word_suffix", None):
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        probe = "A  word,\n\tand another's; É 漢 12 (x)! "
        if self.encode([probe])[0].tolist() != self.library.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path}: the ids of a text are not those of its words in a row")

    def _library(self, words: list[str], between: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of letters: one piece each, so that the ids that end pieces part them, if they are as many."""
        ids = self._library(words, " ")
        last = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._marked(words)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of any words without the mark."""
        ids = self._library(words, " \x01 ")
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library.encode(words[0], add_special_tokens=False).ids
        return np.array(ids, np.int64), np.array([len(ids)])

    def _ask(self, words: list[str]) -> None:
        """Ask the library for the ids of words and remember them, in this order."""
        kinds: dict = {self._letters: [], self._marked: [], self._single: []}
        for k, w in enumerate(words):
            odd = not w or "\x01" in w or unicodedata.combining(w[0])
            kinds[self._letters if w.isalpha() else self._single if odd else self._marked].append(k)
        order, ids, sizes = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for ask, places in kinds.items():
            step = 1 if ask == self._single else self.words
            for at in range(0, len(places), step):
                group = ask([words[k] for k in places[at : at + step]])
                ids.append(group[0])
                sizes.append(group[1])
            order += places
        flat, size, at = np.concatenate(ids), np.concatenate(sizes), np.empty(len(words), np.int64)
        at[order] = np.arange(len(words))
        self.cores.add(flat[gather((np.cumsum(size) - size)[at], size[at])], size[at])

    def _parts(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words, the numbers of their cores and of their tails."""
        core = pc.ascii_rtrim(words, characters=_TAIL.decode())
        length = pc.binary_length(core).to_numpy()
        data = np.frombuffer(core.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(core.buffers()[1], np.int32)[core.offset + 1 : core.offset + 1 + len(core)]
        last = np.where(length > 0, data[ends - 1] if len(data) else 0, 0)
        fine = _ALNUM[last]
        far = np.flatnonzero(last >= 128)
        # The tail would join a mark, which NFC or lower case may bring forth.
        fine[far] = [unicodedata.normalize("NFC", w).lower()[-1].isalnum() for w in _strings(core.take(pa.array(far)))]
        core = pc.if_else(pa.array(fine), core, words)
        lower = pc.and_(pa.array(fine), pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<|"))))
        core = pc.if_else(lower, pc.ascii_lower(core), core)

        whole = pc.binary_length(words).to_numpy().astype(np.int64)
        size = np.where(fine, whole - length, 0)
        stop = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
        text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[gather(stop - size, size)]
        tail = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(text))
        return self._numbers(core), self._numbers(tail)

    def _numbers(self, words: pa.StringArray) -> np.ndarray:
        coded = words.dictionary_encode()
        return self.cores.numbers(_strings(coded.dictionary))[coded.indices.to_numpy()]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and how many each text has; null is the empty text."""
        if len(self.cores) > self.limit:
            self.cores.forget(self.limit // 2)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        both = np.stack(self._parts(coded.dictionary), 1).ravel()
        if self.cores.missing:
            self._ask(self.cores.missing)
        size = self.cores.size[both]
        ids = self.cores.ids[gather(self.cores.at[both], size)]
        size = size.reshape(-1, 2).sum(1)
        flat = ids[gather((np.cumsum(size) - size)[which], size[which])]
        ends = np.append(0, np.cumsum(size[which]))[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return flat, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, size = self.column(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(size)[:-1]) if texts else []


def _strings(words: pa.StringArray) -> list[str]:
    """The strings of an array none of which holds a space; several times faster than to_pylist."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


class _Pool(dict):
    """Words by number, and the ids of each in one array."""

    def __init__(self):
        super().__init__()
        self.missing: list[str] = []
        self.ids, self.at, self.size, self.met = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.missing.append(word)
        return k

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words; those of `missing` are the next ones, whose ids are to be added."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.met[out[out < len(self.met)]] += 1
        return out

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.met = np.concatenate([self.met, np.ones(len(sizes), np.int64)])
        self.missing = []

    def forget(self, most: int) -> None:
        """Keep the `most` words that the most calls met; their counts are halved, so that old ones fade."""
        keep = np.sort(np.argpartition(-self.met, most)[:most])
        words = list(self)  # in the order of their numbers
        self.clear()
        self.update((words[k], n) for n, k in enumerate(keep.tolist()))
        ids, size, met = self.ids[gather(self.at[keep], self.size[keep])], self.size[keep], self.met[keep]
        self.ids, self.at, self.size, self.met = ids, np.cumsum(size) - size, size, met // 2


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# -- files -----------------------------------------------------------------------------------------------------------


def _open(uri: str):
    """File system and path of a folder; Hadoop's names for S3 are Arrow's `s3`."""
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        uri = "s3://" + uri.removeprefix(name) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class SequenceFile:
    """Writes one shard: a flat run of ids cut into sequences of `length`."""

    def __init__(self, folder: str, shard: int, length: int, wide: bool):
        self.name, self.length, self.kind = f"part-{shard:08d}-{uuid.uuid4().hex}", length, pa.uint32() if wide else pa.uint16()
        self.files, self.folder = _open(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.files.open_output_stream(f"{self.folder}/{self.name}.arrow")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest = np.empty(0, np.uint32)
        self.docs: list[pa.RecordBatch] = []
        self.tokens = 0

    def append(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents, their ids in a row and how many each has."""
        first = self.tokens + np.cumsum(sizes) - sizes
        doc_ids = pa.array(doc_ids.to_pylist(), pa.int64())  # a copy: a slice would hold the texts that came with it
        self.docs.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], schema=_DOCS))
        self.tokens += len(ids)
        flat = np.concatenate([self.rest, ids])
        whole = len(flat) // self.length * self.length
        if whole:
            self._write(flat[:whole], np.ones(whole, bool))
        self.rest = flat[whole:]

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, kind), self.length) for x, kind in ((ids.astype(self.kind.to_pandas_dtype()), self.kind), (mask, pa.bool_()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        if len(self.rest):
            room = -len(self.rest) % self.length
            self._write(np.append(self.rest, np.zeros(room, np.uint32)), np.append(np.ones(len(self.rest), bool), np.zeros(room, bool)))
        self.writer.close()
        self.sink.close()
        table = pa.Table.from_batches(self.docs, _DOCS).combine_chunks()
        with self.files.open_output_stream(f"{self.folder}/{self.name}.docs") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        return self.name, self.tokens, table.num_rows


class ShardReader:
    """Random access to a shard. On a local file system the ids are views of a memory map."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        files, at = _open(folder)
        path = posixpath.join(at, name)
        source = pa.memory_map(f"{path}.arrow") if isinstance(files, fs.LocalFileSystem) else files.open_input_file(f"{path}.arrow")
        self.file = pa.ipc.open_file(source)
        with files.open_input_file(f"{path}.docs") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.flat = [self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True) for k in range(self.file.num_record_batches)]
        self.ends = np.cumsum([len(x) for x in self.flat])

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask."""
        batch = int(np.searchsorted(self.ends, k * self.length, side="right"))
        row = k - (int(self.ends[batch - 1]) // self.length if batch else 0)
        mask = self.file.get_batch(batch).column("mask")[row]
        return self.flat[batch][row * self.length : (row + 1) * self.length], np.array(mask.as_py(), bool)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n ids from place `first` on; a view where they lie in one batch."""
        batch = int(np.searchsorted(self.ends, first, side="right"))
        parts = []
        while n:
            start = first - (int(self.ends[batch - 1]) if batch else 0)
            part = self.flat[batch][start : start + n]
            parts.append(part)
            first, n, batch = first + len(part), n - len(part), batch + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write(documents: DataFrame, path: str, folder: str | None = None, length: int = 2048, end_id: int = 1, rows_per_shard: int = 10_000, most_shards: int = 10_000) -> tuple[DataFrame, str]:
    """Encode and write all documents; the manifest (shard, name, n_tokens, n_docs, start) and the folder.

    Shards are ranges of doc_id between approximate quantiles, so one shuffle of the texts orders them; each task
    streams its sorted rows into files and holds one batch at a time. Beyond `most_shards` they grow instead.
    """
    spark = documents.sparkSession
    folder = folder or new_path(spark, "tokens")
    docs = pick(documents, "doc_id", "text")
    shards = max(1, min(most_shards, math.ceil(docs.count() / rows_per_shard)))
    bounds: list[int] = []
    if shards > 1:  # `shards` numbers at most come to the driver
        cuts = [k / shards for k in range(1, shards)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 10 * shards).alias("b")).first().b or []))

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array) -> pa.Array:
        # The least value stands for null, which sorts first.
        return pa.array(np.searchsorted(np.array(bounds, np.int64), ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right"), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]):
        tool, out = encoder(path), None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(shard)) + 1):
                if not len(piece):
                    continue
                if out is None or out[0] != shard[piece[0]]:
                    if out is not None:
                        yield _row(out)
                    out = int(shard[piece[0]]), SequenceFile(folder, int(shard[piece[0]]), length, tool.wide)
                for part in text_slices(iter([batch.slice(int(piece[0]), len(piece))]), limit=8 << 20):
                    ids, size = tool.column(part.column("text"))
                    out[1].append(part.column("doc_id"), np.insert(ids, np.cumsum(size), end_id), size + 1)
        if out is not None:
            yield _row(out)

    dealt = docs.withColumn("shard", shard_of("doc_id")).repartitionById(shards, "shard").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie").select("shard", "doc_id", "text")
    manifest = staged(dealt.mapInArrow(run, "shard int, name string, n_tokens long, n_docs long"), "manifest")
    # One row a shard: `most_shards` rows at most meet in this window.
    return manifest.selectExpr("*", "coalesce(sum(n_tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0) as start"), folder


def _row(out: tuple[int, SequenceFile]) -> pa.RecordBatch:
    name, tokens, docs = out[1].close()
    return pa.RecordBatch.from_arrays([pa.array([out[0]], pa.int32()), pa.array([name]), pa.array([tokens], pa.int64()), pa.array([docs], pa.int64())], ["shard", "name", "n_tokens", "n_docs"])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(folder, name)
                for docs in shard.docs.to_batches(max_chunksize=8192):
                    first, size = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(shard.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(first.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(first + start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("name", "start").repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
