"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The library is only asked for the vocabulary; the merges are done here on flat numpy arrays, all words of a batch at
once: a round takes each word's best pair by rank, merges its leftmost non-overlapping occurrences in all words together
and compacts the arrays, until no word has a pair left. Merging all occurrences at once equals the library's
one-at-a-time order unless a piece built on the merged one ranks no later than it; such pieces are found when the
vocabulary is loaded, and for those a round merges the leftmost occurrence only.

A word of more than `LONG` characters (base64, runs of spaces, unspaced scripts) would be scanned once for each of its many ranks. Its places
wait in buckets by the rank of the pair that begins there instead, and a round touches the places of the best rank and their neighbours
alone; pieces that can't be merged together are merged there from left to right, from a heap. The work grows with the word's length, not with its square.

A text is parted into words where no piece can cross: before a space that follows a non-space and before a line feed,
if the vocabulary allows that. What a word encodes to is remembered per worker up to a bound.

Edge cases: a null text is the empty text, whose ids are the begin and end ids alone and which decodes to "".
Repeated rows and doc_ids are encoded each for itself. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import pick, text_slices, texts_of

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Words of more characters than these are merged by buckets.
LONG = 256


class PieceModel:
    """The vocabulary of a SentencePiece BPE model, as tables for the merge rounds."""

    def __init__(self, path: str, remember: int = 250_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        scores = [sp.get_score(i) for i in range(size)]
        self.bos, self.eos, unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        #: Symbols are pieces and the characters that pieces are made of; other characters never merge.
        self.symbols = dict(ids)
        for piece in ids:
            for c in piece:
                self.symbols.setdefault(c, size + len(self.symbols))
        self.other = size + len(self.symbols) + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        rank = np.full(size, _NONE, np.int32)
        for i in ids.values():
            rank[i] = order[scores[i]]
        pairs = {}
        lone = np.zeros(size, bool)
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.other + 1) + right] = i
                    for part in (left, right):
                        if part < size and rank[i] <= rank[part]:
                            lone[part] = True
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank, self.lone = np.append(rank, _NONE), np.append(lone, False)
        #: ids that stand for a symbol: itself, or the bytes of a character without a piece.
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.as_bytes = {b: byte_ids.get(b, unknown) for b in range(256)} if byte_ids else None
        self.unknown = unknown
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.line_breaks = self.breaks and not any("\n" in p for p in ids)
        #: What each id decodes to.
        said = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.said, self.is_byte = said, np.array([sp.is_byte(i) for i in range(size)])
        self.said_flat = np.frombuffer(b"".join(said), np.uint8)
        self.said_len = np.array([len(x) for x in said], np.int64)
        self.said_at = np.cumsum(self.said_len) - self.said_len
        self.spaced = np.array([p.startswith(SPACE) and not special[i] for i, p in enumerate(names)])
        self.silent = np.array([sp.is_control(i) for i in range(size)])
        self.remember, self.known = remember, _Known()
        probe = "A  word,\n\tand another's; É 漢 😀 aaaa 12"
        if self.encode([probe])[0].tolist() != [self.bos, *sp.encode(probe), self.eos]:
            raise ValueError(f"{path}: a normaliser or a rule that these merge rounds don't know")

    # -- encoding ------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The escaped text cut into words; joined, they are the text with its dummy prefix."""
        if not text:
            return []
        mark = next((m for m in ("\0", "\x01", "\U0010fffe") if m not in text), None)
        whole = SPACE + text.replace(" ", (mark or "") + SPACE if self.breaks else SPACE)
        if mark is None or not self.breaks:
            return [whole]
        if self.line_breaks:
            whole = whole.replace("\n", mark + "\n")
        run = SPACE + mark + SPACE
        if run in whole:  # spaces in a row belong to one word
            whole = whole.replace(run, SPACE + SPACE).replace(run, SPACE + SPACE)
        return whole.split(mark)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.of_char[chars]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        at = np.arange(len(text), dtype=np.int64)  # where each symbol began, for characters without a piece
        done_sym, done_at = [], []
        if lens.max(initial=0) > LONG:
            big = np.repeat(lens > LONG, lens)
            ids, places = self._merge_long(sym[big], word[big])
            done_sym.append(ids)
            done_at.append(at[big][places])
            sym, word, at = sym[~big], word[~big], at[~big]
        pair = self._pairs(sym[:-1], sym[1:])
        pair[word[:-1] != word[1:]] = -1
        pair = np.append(pair, -1)[: len(sym)]
        while len(sym):
            order = self.rank[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(order, first)
            size = np.diff(np.append(first, len(sym)))
            over = np.repeat(best == _NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_at.append(at[over])
                live = ~over
                sym, word, at, pair, order = sym[live], word[live], at[live], pair[live], order[live]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(order == np.repeat(best, size))
            # Leftmost, non-overlapping: every second of a row of neighbours.
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            if self.lone[pair[hit]].any():
                again = np.append(False, word[hit[1:]] == word[hit[:-1]])
                hit = hit[~(again & self.lone[pair[hit]])]
            sym[hit] = pair[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep)[hit] - 1
            sym, word, at, pair = sym[keep], word[keep], at[keep], pair[keep]
            for k in (now, now[now > 0] - 1):
                inside = k[k + 1 < len(sym)]
                fresh_pair = self._pairs(sym[inside], sym[inside + 1])
                fresh_pair[word[inside] != word[inside + 1]] = -1
                pair[k] = -1
                pair[inside] = fresh_pair
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        back = np.argsort(at, kind="stable")
        sym, at = sym[back], at[back]
        ends = np.cumsum(lens)
        if (odd := np.flatnonzero(sym >= self.size)).size:  # characters without a piece become bytes
            out, counts = [], np.ones(len(sym), np.int64)
            for k in odd.tolist():
                raw = chr(chars[at[k]]).encode("utf-8", "surrogatepass")
                ids = [self.as_bytes[b] for b in raw] if self.as_bytes else [self.unknown]
                out.append(ids)
                counts[k] = len(ids)
            flat = np.repeat(sym, counts)
            where = np.cumsum(counts) - counts
            for k, ids in zip(odd.tolist(), out):
                flat[where[k] : where[k] + len(ids)] = ids
            at, sym = np.repeat(at, counts), flat
        return sym, np.diff(np.searchsorted(at, ends), prepend=0)

    def _merge_long(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of long words and the places where they begin.

        `pair[k]` is the piece that the symbol at k makes with the next one. A symbol that never merges stands between words and at both ends.
        """
        edges = np.flatnonzero(np.append(word[1:] != word[:-1], True)) + 1
        places = np.delete(np.arange(len(sym) + len(edges) + 1, dtype=np.int32), np.append(0, edges + np.arange(1, len(edges) + 1)))
        flat = np.full(len(sym) + len(edges) + 1, self.other, np.int32)
        flat[places] = sym
        sym, n = flat, len(flat)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.append(self._pairs(sym[:-1], sym[1:]), np.int32(-1))
        waiting: dict[int, list] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Put places into the buckets of their pairs' ranks."""
            rank = self.rank[pair[at]]
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
            for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)]):
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(at[a:b])

        wait(np.arange(n, dtype=np.int32))
        while ranks:
            r = heappop(ranks)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[self.rank[pair[hit]] == r]
            if not len(hit):
                continue
            if self.lone[pair[hit]].any():
                wait(self._one_by_one(r, hit, sym, pair, before, after))
                continue
            # Leftmost, non-overlapping: every second of a row of neighbours.
            fresh = np.append(True, after[hit[:-1]] != hit[1:])
            row = np.arange(len(hit))
            hit = hit[(row - np.maximum.accumulate(np.where(fresh, row, 0))) % 2 == 0]
            gone = after[hit]
            sym[hit], pair[gone] = pair[hit], -1
            after[hit] = after[gone]
            before[after[hit]] = hit
            changed = np.unique(np.concatenate([hit, before[hit]]))
            pair[changed] = self._pairs(sym[changed], sym[after[changed]])
            wait(changed)
        kept = places[before[after[places]] == places]  # a place that was merged into an earlier one is no longer its neighbour's
        return sym[kept], np.searchsorted(places, kept)

    def _one_by_one(self, rank: int, hit: np.ndarray, sym: np.ndarray, pair: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Merge the pairs of this rank, and those of no later one that come of it, in the library's order; returns the places whose new pairs rank later."""
        n, width, known = len(sym), self.other + 1, self.pairs
        sym, pair, before, after, ranks = map(memoryview, (sym, pair, before, after, self.rank))
        heap = [rank * n + k for k in hit.tolist()]
        heapify(heap)
        later = []
        while heap:
            r, k = divmod(heappop(heap), n)
            made = pair[k]
            if made < 0 or ranks[made] != r:
                continue
            gone = after[k]
            sym[k], pair[gone] = made, -1
            after[k] = ahead = after[gone]
            before[ahead] = k
            for at in (before[k], k):
                pair[at] = made = known.get(sym[at] * width + sym[after[at]], -1)
                if made >= 0:
                    if ranks[made] <= rank:
                        heappush(heap, ranks[made] * n + at)
                    else:
                        later.append(at)
        return np.unique(np.array(later, np.int32))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; -1 for none (rank[-1] is no rank)."""
        key = left.astype(np.int64) * (self.other + 1) + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.made[k], np.int32(-1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, begin and end ids included."""
        if len(self.known) > self.remember:
            self.known = _Known()
        known = self.known
        found = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in map(self.words, texts)]
        if known.waiting:
            ids, sizes = self.merge(known.waiting)
            known.add(ids, sizes)
        out = []
        for k in found:
            size = known.size[k]
            ids = np.empty(int(size.sum()) + 2, np.uint32)
            ids[0], ids[-1] = self.bos, self.eos
            ids[1:-1] = known.ids[gather(known.at[k], size)]
            out.append(ids)
        return out

    def forget(self) -> None:
        """Drop what is remembered, so that an idle worker holds no words."""
        self.known = _Known()

    # -- decoding ------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        raw = self.said_flat[gather(self.said_at[ids], self.said_len[ids])].tobytes()
        cut = 1 if self.spaced[ids[0]] else 0  # the dummy prefix
        try:
            return raw[cut:].decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_slowly(ids)[cut:]

    def _decode_slowly(self, ids: np.ndarray) -> str:
        """Byte ids that make no character each become U+FFFD."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.said[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode("utf-8"))
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.said[i].decode("utf-8"))
        return "".join(out)


class _Known(dict):
    """Words that were encoded before: their ids in one array."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []
        self.ids, self.at, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.waiting.append(word)
        return k

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.waiting = []


def gather(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs [at, at + size) one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(at - (ends - size), size) + np.arange(total)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a worker, loaded once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        for batch in text_slices(batches):
            ids = m.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        m.forget()

    return pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` yields, in short."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        for batch in text_slices(batches):
            ids = m.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(m.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        m.forget()

    return pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
