"""The corpus operators against brute-force versions, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tallymark.llm import chunks, lines, mixing, near_dedup, outliers, pieces, pii, token_files, topk, toxicity

#: Columns beyond those of the table, named like what operators add on the way.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __size string, score string, __tm_key string, row string, tokens string, runs string, key int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Texts with near and exact copies, shared passages, nulls, empties, a long one, repeated rows and an extra column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160), 5000) for _ in range(40)]
    base = prose(rng, 120, 5000).split()
    for k in range(12):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    passage = "\n".join(prose(rng, 14, 5000) for _ in range(5))
    texts += [f"{prose(rng, 30, 5000)}\n{passage}\n{prose(rng, 20, 5000)}" for _ in range(4)]
    texts += [texts[0], texts[1], None, "", " \n\t ", "one", "One", "a b c d", "A b c d", prose(rng, 9000, 300), "é ñ 漢字\x00 \x1c x", "x" * 3000]
    more = "extra", None, "mine", "r", None, "runs", 7
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), *more) for k, t in enumerate(texts)]
    return rows + [rows[2], (None, "null id", "en", "s1", 7, *more), (None,) * 12]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


# -- 1 -----------------------------------------------------------------------------------------------------------------


def brute_counts(t):
    t, w = t or "", words(t)
    seen, dup, grams = set(), 0, collections.Counter(zip(w, w[1:], w[2:]))
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_outlier_counts_and_empty(docs, empty):
    got = sorted(((r.doc_id, tuple(r)[1:6], r.base_failed) for r in outliers.quality(docs).collect()), key=str)
    want = sorted(((r[0], c := brute_counts(r[1]), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in corpus()), key=str)
    assert got == want
    assert outliers.quality(empty).count() == 0


def brute_mcd(z):
    """Concentration steps on whole sorted rows, from both starts, and the reweighting; no bins."""
    floor, share = np.diag(np.square(outliers.FLOOR)), outliers.SHARE

    def distances(m, s):
        return np.einsum("ni,ij,nj->n", z - m, np.linalg.inv(s), z - m)

    best = None
    quartiles = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
    for m, s in ((z.mean(0), np.cov(z.T, bias=True) + floor), (quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floor)):
        for _ in range(outliers.STEPS):
            inner = z[np.argsort(distances(m, s), kind="stable")[: int(np.ceil(share * len(z)))]]
            m, s = inner.mean(0), np.cov(inner.T, bias=True) * outliers.consistency(share) + floor
        if best is None or np.linalg.slogdet(s)[1] < best[0]:
            best = (np.linalg.slogdet(s)[1], m, s)
    inner = z[distances(*best[1:]) <= outliers.quantile(0.975, 5)]
    return inner.mean(0), np.linalg.inv(np.cov(inner.T, bias=True) * outliers.consistency(0.975) + floor)


def test_mcd_against_numpy(spark):
    """The final estimate is that of concentration steps on whole rows in numpy, but for the bins' width, and rejects what is planted."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 5)) * 4096).astype(np.int64)
    x[:60] += 12 * 4096
    frame = spark.createDataFrame([("g", *map(int, r)) for r in x], "key string, " + ", ".join(f"x{i} long" for i in range(5)))
    (r,) = outliers.estimates(frame).collect()
    mean, w = np.array([r[f"m{i}"] for i in range(5)]), np.zeros((5, 5))
    for i, j in outliers._PAIRS:
        w[i, j] = w[j, i] = r[f"w{i}{j}"] / (1 if i == j else 2)
    d2 = np.einsum("ni,ij,nj->n", x / 4096 - mean, w, x / 4096 - mean)
    limit = outliers.quantile(outliers.QUANTILE, 5)
    want_mean, want_w = brute_mcd(x / 4096)
    assert np.abs(mean - want_mean).max() < 0.02 and np.abs(np.linalg.inv(w) - np.linalg.inv(want_w)).max() < 0.05
    assert (d2[:60] > limit).all() and (d2[60:] < limit).all()
    z = x / 4096
    m, s = z[60:].mean(0), np.cov(z[60:].T)
    assert np.abs(mean - m).max() < 0.15
    inner = np.einsum("ni,ij,nj->n", z - m, np.linalg.inv(s), z - m) <= outliers.quantile(0.975, 5)
    want = np.cov(z[inner & (np.arange(600) >= 60)].T) * outliers.consistency(0.975) + np.diag(np.square(outliers.FLOOR))
    assert np.abs(np.linalg.inv(w) - want).max() < 0.25
    assert abs(outliers.chi_square(11.0705, 5) - 0.95) < 1e-4


def long_words(rng, n, end=""):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) + end for _ in range(n))


def test_symbol_junk_is_rejected(spark):
    """Texts with a symbol after every word, about an eighth of their characters, go; the clean ones stay."""
    rng = random.Random(11)
    rows = [(k, long_words(rng, rng.randint(60, 300), "|" * (k >= 400)), "en", "s") for k in range(420)]
    got = {r.doc_id: r.kept for r in outliers.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, kept in got.items() if kept != (k < 400)] == []


def test_estimates_are_drawn_to_wider_ones():
    one = {"fitted": 1_000_000} | {f"m{i}": 1.0 for i in range(5)} | {f"w{i}{j}": float(i == j) for i, j in outliers._PAIRS}
    wide = one | {"fitted": 0} | {f"m{i}": 3.0 for i in range(5)}
    assert outliers.drawn([one, wide, wide])["m0"] == pytest.approx(1.0, abs=1e-3)
    assert outliers.drawn([one | {"fitted": outliers.PRIOR}, wide, wide])["m0"] == pytest.approx(2.0)
    assert outliers.drawn([one | {"fitted": 1}, wide, wide])["m0"] == pytest.approx(3.0, abs=0.02)


def test_rare_languages_are_judged(spark):
    """Small groups are judged by the same rule."""
    rng = random.Random(13)
    rows = [(k, long_words(rng, rng.randint(60, 300), "|||" * (k >= 100)), None if k % 2 else f"l{k % 5}", "s") for k in range(104)] + [(200, "short", "l1", "s")]
    got = {r.doc_id: r for r in outliers.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all((r.distance is None) == r.base_failed for r in got.values())
    assert [k for k, r in got.items() if r.kept != (k < 100)] == []


# -- 2, 8 ----------------------------------------------------------------------------------------------------------------


def test_gear_and_shift_resistance():
    rng = random.Random(4)
    raw = np.frombuffer(prose(rng, 300).encode(), np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear(raw).tolist() == want
    text = raw.tobytes()

    def parts(t):
        ends = chunks.boundaries(np.frombuffer(t, np.uint8))
        return [t[a:b] for a, b in zip([0, *ends], ends)]

    assert b"".join(parts(text)) == text
    shifted = parts(b"an insertion " + text)
    assert len(set(parts(text)) & set(shifted)) >= len(parts(text)) - 2
    for alphabet in ("".join(map(chr, range(0x4E00, 0x5E00))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        whole = "".join(rng.choice(alphabet) for _ in range(2000)).encode()
        before = parts(whole)
        for lead in ("".join(rng.choice(alphabet) for _ in range(n)).encode() for n in (1, 2, 7, 300)):
            after = parts(lead + whole)
            assert b"".join(after) == lead + whole and len(set(before) & set(after)) >= len(before) - 6
        assert all(p.decode() for p in before)
    assert max(map(len, parts(("漢" * 500).encode()))) <= chunks.LONGEST
    for p in parts(("漢" * 500).encode()):
        p.decode()


def test_chunk_spans_against_brute_force(docs, empty):
    rows = [r for r in corpus()]
    held = collections.defaultdict(set)
    cut = {}
    for r in rows:
        raw = (r[1] or "").encode()
        ends = chunks.boundaries(np.frombuffer(raw, np.uint8))
        cut[(r[0], r[1])] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)]
        for _, _, c in cut[(r[0], r[1])]:
            held[c].add(-(2**63) if r[0] is None else r[0])
    want = set()
    for (i, _), parts in cut.items():
        seen, run = set(), None
        for a, b, c in [*parts, (None, None, None)]:
            copy = c is not None and (c in seen or min(held[c]) < (-(2**63) if i is None else i))
            seen.add(c)
            if copy and run:
                run[1] = b
            elif copy:
                run = [a, b]
            if not copy:
                if run and run[1] - run[0] >= chunks.MIN_SPAN:
                    want.add((i, *run))
                run = None
    got = {(r.doc_id, r["first"], r.end) for r in chunks.duplicate_spans(docs).collect()}
    assert got == want and len(want) > 5
    assert chunks.duplicate_spans(empty).count() == 0
    left = chunks.remove_spans(docs, chunks.duplicate_spans(docs))
    assert left.columns == docs.columns and left.count() == docs.count()
    cuts = collections.defaultdict(list)
    for r in chunks.duplicate_spans(docs).collect():
        cuts[r.doc_id].append((r["first"], r.end))

    def without(i, t):
        raw = (t or "").encode()
        return t if i not in cuts or t is None else b"".join(raw[a:b] for a, b in zip([0, *[z for _, z in sorted(cuts[i])]], [*[a for a, _ in sorted(cuts[i])], len(raw)])).decode()

    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((r[0], without(r[0], r[1])) for r in rows), key=str)
    fresh, shared = " ".join(f"u{k}" for k in range(80)), rows[45][1]
    d = docs.sparkSession.createDataFrame([(1, "a b"), (2, shared), (3, shared), (3, fresh), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in chunks.remove_spans(d, chunks.duplicate_spans(d)).collect()}
    assert {(1, "a b"), (2, shared), (3, fresh), (3, None)} < got and len(got) == 5 and (3, shared) not in got


def test_lines_leave_one_copy_and_catch_runs(docs, empty):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    rows = {r[0]: r[1] for r in corpus()}
    shared = [k for k, t in rows.items() if t and t.count("\n") >= 6]
    passage = rows[shared[0]].split("\n")[1:6]
    assert kept[shared[0]] == rows[shared[0]]
    for k in shared[1:]:
        assert kept[k].split("\n") == [x for x in rows[k].split("\n") if x not in passage]
    said = lambda texts: {x for t in texts for x in (t or "").split("\n") if x.strip()}
    assert said(r[1] for r in corpus()) == said(r.text for r in out.collect())
    report = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert report[shared[1]].n_lines_deleted == 5 and report[3].n_lines_deleted == 0
    assert lines.line_report(docs).count() == docs.count()
    assert lines.drop_repeated_lines(empty).count() == 0


def test_line_runs_within_and_across(spark):
    rng = random.Random(6)
    run = [prose(rng, 10, 9000) for _ in range(40)]
    texts = ["\n".join(run), "\n".join(["head a b", *run[5:30], "tail c d"]), "\n".join([*run[:4], "", *run[:4]]), "\n".join(["solo", *run[7:8], "end"])]
    d = spark.createDataFrame(list(enumerate(texts)), ["doc_id", "text"])
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(d).collect()}
    assert got[0] == texts[0] and got[1] == "head a b\ntail c d" and got[3] == texts[3]
    assert 2 not in got  # every line of it is in document 0


def test_line_runs_with_short_tails(spark):
    """Tails of many short lines go, and so does a run whose first line alone occurred before."""
    rng = random.Random(12)
    line = lambda n: prose(rng, n, 9**9)
    menu = [line(40), *[line(1) for _ in range(20)]]
    run = [line(30), *[line(6) for _ in range(4)]]
    exact = [line(5) for _ in range(5)]
    texts = [[*menu, "end of one"], ["other", *menu, "end of two"], [run[0], "alone"], [*run, "kept a"], [*run, "kept b"], [*exact, "here"], ["there", *exact]]
    d = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], ["doc_id", "text"])
    got = {r.doc_id: r.text.split("\n") for r in lines.drop_repeated_lines(d).collect()}
    assert got == {0: texts[0], 1: ["other", "end of two"], 2: texts[2], 3: [*run[1:], "kept a"], 4: ["kept b"], 5: texts[5], 6: ["there"]}


GONE = object()


def brute_lines(rows):
    """id, text and what is left of it: every line goes that lies in a run of MIN_WORDS words or more which occurred before, by (doc_id, place)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines_ = (t or "").split("\n")
        at = [k for k, x in enumerate(lines_) if WORDS.search(x)]
        own = [lines_[k] for k in at]
        counts, gone = [len(words(x)) for x in own], set()
        for z in range(1, len(own) + 1):
            for a in range(z):
                run = tuple(own[a:z])
                if sum(counts[a:z]) >= lines.MIN_WORDS:
                    if run in seen:
                        gone |= set(range(a, z))
                    seen.add(run)
        blank = {k for k in range(len(lines_)) if k not in at and (p := [n for n, x in enumerate(at) if x < k]) and p[-1] in gone and p[-1] + 1 in gone}
        drop = {at[n] for n in gone} | blank
        left = "\n".join(x for k, x in enumerate(lines_) if k not in drop)
        out.append((i, t, t if not gone else left if words(left) else GONE))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([1, 2, 6, 12, 30]), 9**9) for _ in range(25)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(pool))
            text += [*pool[a : a + rng.randint(1, 9)], *([prose(rng, 3, 9**9)] if rng.random() < 0.7 else []), *([" "] if rng.random() < 0.2 else [])]
        rows.append((k, "\n".join(text) if k % 17 else None))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((r.doc_id, r.text) for r in lines.drop_repeated_lines(d).collect()), key=str) == sorted(((i, left) for i, _, left in brute_lines(rows) if left is not GONE), key=str)


# -- 3, 5 ------------------------------------------------------------------------------------------------------------------


def test_pieces_of_long_words_equal_the_library():
    """Texts without word breaks, runs of spaces and rows of pieces that can't be merged together, among short words; the merges must not take squared time."""
    import time

    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp, rng = pieces.PieceModel(path), SentencePieceProcessor(model_file=path), random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choices(letters, k=60_000)), " " * 9_999, "th" * 5_000, "the" * 3_000 + "an" * 300, "😀a" * 700, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5_000))]
    texts += ["x".join("  " * rng.randrange(1, 300) + "".join(rng.choices("andthe r", k=400)) for _ in range(9)), "ab " * 9 + "return" * 200 + "\n" + "ab " * 9, "z" * pieces.LONG, "z" * (pieces.LONG + 1)]
    texts += ["".join(rng.choices(rng.choice(["the an", "ab", "aA1 ", "▁ a", "ret urn\n"]), k=rng.randrange(200, 900))) for _ in range(300)]
    for text, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == [m.bos, *sp.encode(text), m.eos]
        assert m.decode(ids) == sp.decode(ids.tolist())
    began = time.perf_counter()
    m.encode(["".join(rng.choices(letters, k=400_000))])
    assert time.perf_counter() - began < 20  # by rounds over the whole word: more than a minute


def test_pieces_equal_the_library(docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = sorted((tuple(r) for r in pieces.digests(docs, path).collect()), key=str)
    want = []
    for r in corpus():
        ids = [1, *sp.encode(r[1] or ""), 2]
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.digests(empty, path).count() == 0
    m, rng = pieces.PieceModel(path, remember=50), random.Random(9)
    parts = [" ", "   ", "\n", "▁", "a", "the", "ing", "é", "漢", "😀", "\t", "\0", "<s>", "<0x0A>", "ababab", "1999", "..."]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert m.encode([t])[0].tolist() == [1, *sp.encode(t), 2]
        ids = [rng.randrange(32_000) for _ in range(5)] + [rng.randrange(3, 259) for _ in range(4)]
        assert m.decode(ids) == sp.decode(ids)


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest, folder = token_files.write(docs, path, length=64, rows_per_shard=20)
    assert manifest.count() > 2
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest, folder).collect()), key=lambda r: r[1])
    ids = collections.Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in corpus())
    assert collections.Counter((d, n, c) for d, _, n, c in got) == collections.Counter({(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())): n for (d, x), n in ids.items()})
    at = 0
    for k, (d, start, n, _) in enumerate(got):
        assert start == at and (k == 0 or got[k - 1][0] is None or d is not None and got[k - 1][0] <= d)
        at += n
    name = manifest.orderBy("shard").first().name
    shard = token_files.ShardReader(folder, name)
    row, mask = shard.sequence(0)
    assert len(row) == len(mask) == 64 and row.base is not None and mask.all()
    assert token_files.read(*token_files.write(empty, path)).count() == 0
    small, rng = token_files.WordEncoder(path, words=20, cores=30), random.Random(8)
    parts = [" ", "\n", "a", "The", "it's", "'", "É", "é", "́", "漢", "Σ", "İ", "😀", "\x01", "\x1c", "<|endoftext|>", ".", ",!", "<", "|>", "12", "_"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert small.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_encoder_asks_once_a_batch(monkeypatch):
    """A word that a batch repeats is looked up once, one that was met often outlives the words met once, and letters that NFC takes apart keep their ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    tool = token_files.WordEncoder(path, words=7, cores=40)
    for t in ["\u0958.", "x\u0958, y", "\u0958", "İ. İx", "½. Ⅷ; ʰ:", "a\xa0b.", "\0 \u200b.", "ᄀ ᅡ."]:
        assert tool.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)
    looked = []
    monkeypatch.setattr(token_files._Pool, "numbers", lambda self, words, numbers=token_files._Pool.numbers: (looked.extend(words), numbers(self, words))[1])
    texts = ["often Often, OFTEN. often! " * 50, None, "", "often"]
    ids, size = tool.column(pa.array(texts))
    assert size.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts] and size.sum() == len(ids)
    assert looked.count("often") == 1
    for k in range(60):
        text = "often " + " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{c}" for c in "uvwxyz")
        assert tool.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(tool.cores) <= 40 + 8 and "often" in tool.cores
    assert tool.encode([]) == [] and [len(x) for x in tool.column(pa.array([], pa.string()))] == [0, 0]


# -- 4 -----------------------------------------------------------------------------------------------------------------------


def test_mixing_equals_its_sql(docs, empty):
    got = mixing.taken(docs)
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(str, c.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()))
    rows = got.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str(tuple(r)) for r in rows) == want
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(docs.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.taken(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mixing_of_repeated_rows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(6)]), prose(rng, rng.choice([0, 3, 3, 40]), 5), rng.choice(["a", "b", None])) for _ in range(12)] * 4 + [(1, "a b c d", "z")] * 9 + [(2, "x", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    c = duckdb.connect()
    c.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(str, c.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()))
    got = mixing.taken(d).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert sum(len(words(r.text)) for r in mixing.mix(d).collect()) == sum(r.taken for r in got)


def test_targets_pour_over(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 100), (None, 9)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 3.0 and got[None] <= 27.0 and abs(sum(got.values()) - 120) < 1e-9
    assert got["c"] == pytest.approx(3 * min(30.0, got["a"])) or got["a"] == 30.0


# -- 6 -----------------------------------------------------------------------------------------------------------------------


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(size=8) / 3]) for k in range(300)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (320, None), (340, []), (360, [float("nan")] * 8), (380, [None] * 8), (400, [float("inf")] * 8), (7, rows[9][1])]
    vectors = {}
    for k, v in rows:
        if v and None not in v and np.isfinite(v).all():
            vectors.setdefault(k, []).append(np.floor(64 * np.array(v)).astype(int))
    for cell in (10_000, 40):
        got = collections.defaultdict(list)
        for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_per_cell=cell, queries_per_cell=4).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.score, r.vec_id))
        for q in (k for k in vectors if k % 20 == 0):
            want = sorted(((-int(x @ vectors[q][0]), k) for k, xs in vectors.items() if k != q for x in xs))[:20]
            assert got[q] == [(-s, k) for s, k in want]
    # A query row that is repeated is one query; another vector under the same id is a query of its own.
    more = [*rows, (20, rows[20][1]), (20, rows[20][1]), (40, rows[41][1])]
    for cell in (10_000, 40):
        answers = collections.Counter()
        for r in topk.search(spark.createDataFrame(more, "vec_id long, embedding array<double>"), rows_per_cell=cell, queries_per_cell=4).collect():
            answers[r.query_id, r.rank, r.vec_id, r.score] += 1
        want = collections.Counter()
        pool = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in more if k in vectors and v and None not in v and np.isfinite(v).all()]
        for q, v in {(k, tuple(v)) for k, v in pool if k % 20 == 0}:
            for rank, (s, k) in enumerate(sorted((-int(x @ np.array(v)), k) for k, x in pool if k != q)[:20]):
                want[q, rank + 1, k, -s] += 1
        assert answers == want and len({k for q, _, k, _ in answers if q == 60}) == 20
    mixed = [(k, [0.5] * (9 if k % 3 == 0 else 8)) for k in range(100)]
    for cell in (10_000, 7):
        got = topk.search(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), rows_per_cell=cell).collect()
        assert {(r.query_id, r.vec_id) for r in got} == {(q, v) for q in range(0, 100, 20) for v in [k for k in range(100) if k != q and (k % 3 == 0) == (q % 3 == 0)][:20]}
    clash = spark.createDataFrame([(k, [0.5, float(k)], k, k, "x") for k in range(30)], "vec_id long, embedding array<double>, v long, g long, score string")
    assert topk.search(clash).count() == 40
    few = topk.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert few.count() == 2
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# -- 7 -----------------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[k]

    return sorted((m.start(), n, m.end(), k) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], t or "") if ok(k, m.group()))


def test_pii_base_against_re(spark, empty):
    rng = random.Random(5)
    parts = [" ", "a@b.c", "x.y@m-n.co.uk", "@", ".", "-", "_", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+44 20 7946 0958", "+", "12", "😀", "é", "\n", "0"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(300)] + [(900, None), (901, "x" * 5000 + "@"), (None, "a@b.c")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        spans = plain_spans(t)
        said = ",".join(f"{x}:{a}:{b}" for a, _, b, x in spans)
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert set(filter(None, said.split(","))) <= set(got[k].spans.split(","))
        assert got[k].n_email == sum(s[3] == "email" for s in spans)
    assert pii.report(empty).count() == 0


def twin_matches(t, pattern):
    found = list(regex.finditer(pattern, t))
    for k, m in enumerate(found):
        low = found[k - 1].end() if k else 0
        high = found[k + 1].start() if k + 1 < len(found) else len(t)
        yield m.start(), m.end(), m.group(), t[low : m.start()][-24:], t[m.end() : high][:12]


def twin_candidates(t):
    """code, first, end, said, before, after, by loops in Python."""
    names = list(pii.GENERATORS)
    for code, name in enumerate(names):
        for a, z, said, before, after in twin_matches(t, pii.GENERATORS[name]):
            if name == "number":
                runs = [(m.start(), m.end()) for m in re.finditer("[0-9]+", said)]
                for i in range(len(runs)):
                    for n in range(1, 8):
                        if i + n > len(runs):
                            break
                        first, end = runs[i][0], runs[i + n - 1][1]
                        first -= first > 0 and said[first - 1] == "("
                        part = said[first:end]
                        if 7 <= len(re.sub("[^0-9]", "", part)) <= 19 and re.fullmatch(r"\(?[0-9]+(?:[\x20()./-]{1,3}[0-9]+)*", part):
                            yield 0, a + first, a + end, part, (before + said[max(0, first - 24) : first])[-24:], (said[end:] + after)[:12]
            elif name == "address6" and said.count(":") < 3 or name == "secret" and not (re.search("[0-9]", said) and re.search("[A-Za-z]", said)):
                continue
            else:
                yield code, a, z, said, before, after


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def twin_features(code, said, before, after):
    runs, digits = re.findall("[0-9]+", said), re.sub("[^0-9]", "", said)
    size = lambda k: len(runs[k]) if -len(runs) <= k < len(runs) else 0
    f = [len(said), len(digits), len(runs), max(map(len, runs), default=0), size(0), size(1), size(-1), *[said.count(c) for c in "(.- /"], code]
    f += [1 if "@" in said else 2 if re.search(r"(?i)[\[({]at", said) else 3 if re.search(r"(?i) at ", said) else 0]
    f += [len(re.sub("(?i)[^a-z]", "", said)), sum(bool(re.search(c, said)) for c in ("[0-9]", "[a-z]", "[A-Z]")), bool(re.search("^[0-9a-fA-F]+$", said)), bool(re.search("(?i)dot", said))]
    f += [bool(re.search(w, before, re.A)) for w in pii._BEFORE_WORDS] + [bool(re.search(pii._AFTER_WORDS, after, re.A))]
    f += [bool(re.search(r"[A-Za-z0-9@_]$", before)), bool(re.search(r"[0-9][)./ -]{1,2}\(?$", before)), bool(re.search("^[A-Za-z0-9@_]", after)), bool(re.search(r"^[)./ -]{1,3}[0-9]", after))]
    return [*map(float, f), float(14 <= len(digits) <= 19 and luhn(digits)), float(bool(re.search(r"^\(?(?:19|20)[0-9]{2}(?![0-9])", said)))]


def twin_added(t, model):
    """Every candidate that touches no base span scored, the best of those that overlap."""
    spans = plain_spans(t)
    trees, thresholds = model

    def leaf(tree, f):
        while isinstance(tree, tuple):
            tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
        return float(f"{tree:.6f}")

    rows = set()
    for code, a, z, said, before, after in twin_candidates(t):
        if any(b < z and a < y for b, _, y, _ in spans):
            continue
        f = twin_features(code, said, before, after)
        kind = "card" if code == 0 and f[1] >= 14 else pii._OF_CODE[code]
        score = sum(rate * leaf(tree, f) for rate, tree in trees)
        if score >= thresholds[kind]:
            rows.add((a, z, kind, score, code))
    return {f"{k}:{a}:{z}" for a, z, k, s, c in rows if not any(b < z and a < y and (u, y - b, -b, -d) > (s, z - a, -a, -c) for b, y, _, u, d in rows)}


@pytest.fixture(scope="module")
def pii_model(docs):
    return pii.fit(*pii.examples(docs))


SAID = {
    "please call (415) 555-2671 today": {"(415) 555-2671"},
    "it cost 12.30 on 2020-10-11, pages 1234-1250": set(),
    "on 2024-01-05 (415) 555-2671 we": {"(415) 555-2671"},
    "room 12 (415) 555-2671 was": {"(415) 555-2671"},
    "card 4111.1111.1111.1111 12/26 end": {"4111.1111.1111.1111"},
    "call 4155552671 now": {"4155552671"},
    "call 1-415-555-2671 now": {"1-415-555-2671"},
    'this token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was': {"04dbebab91ab85687d33eeaaf9ac699e1188f962"},
    "write to bob.smith [at] mail [dot] com please": {"bob.smith [at] mail [dot] com"},
    "password: hunter2x and": {"hunter2x"},
    "order 4155552671 shipped": set(),
    "Licensed under version 4.0 of": set(),
    "host 4.0.1.2 is": {"4.0.1.2"},
    "a@b.c and x": {"a@b.c"},
    "": set(),
}


def test_pii_finds_what_the_base_does_not(spark, docs, pii_model, monkeypatch):
    monkeypatch.setattr(pii, "examples", lambda *a: (None, None))
    monkeypatch.setattr(pii, "fit", lambda *a: pii_model)
    d = spark.createDataFrame([(*r, k) for k, r in enumerate([(1, t) for t in SAID] * 2)], "doc_id long, text string, found int")
    got = [r.text for r in pii.redact(d).collect()]
    assert len(got) == 2 * len(SAID) and "please call [PHONE] today" in got
    rows = pii.find(d).collect()
    said = {r.text: {r.text[s["first"] : s["end"]] for s in [*r.base, *r.added]} for r in rows}
    assert said == SAID


def test_pii_added_spans_against_brute_force(spark, docs, pii_model, monkeypatch):
    x, y = pii.examples(docs)
    model = pii_model
    assert x.shape == (len(y), pii._FEATURES) and 0.1 < y.mean() < 0.5
    assert [1 for _ in model[1]] and all(c >= 0 for c in model[1].values())
    monkeypatch.setattr(pii, "examples", lambda *a: (None, None))
    monkeypatch.setattr(pii, "fit", lambda *a: model)
    rng = random.Random(15)
    parts = [" ", " ", "a@b.co", "bob [at] x.org", "call ", "tel: ", "order ", "(415) ", "555-2671", "4111.1111.1111.1111", "1.2.3.4", "12", "4155552671", "2001:db8:0:0:1:0:0:1", " at home dot com", "token = ", '"04dbebab91ab85687d33eeaaf9ac69"', "/", "-", "é", "😀", "\n", "+1 415 555 2671", "key: ab12cd34"]
    texts = [t for t, _, _ in pii.made_up(200, seed=5)] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    texts += [" ".join(["12 34", "(415) 555-2671", "a1b2c3d4e5f6a7b8c9d0e1"] * 60)]  # more matches than a chunk
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        base = {f"{x}:{a}:{b}" for a, _, b, x in plain_spans(t)}
        assert got[k] - base == twin_added(t, model) - base, t


def test_pii_long_texts(spark, docs, pii_model, monkeypatch):
    """Long runs of labels, digits, dots, brackets or addresses neither recurse nor take squared time; what lies across two windows is found once."""
    monkeypatch.setattr(pii, "examples", lambda *a: (None, None))
    monkeypatch.setattr(pii, "fit", lambda *a: pii_model)
    texts = ["ab@" + "bb." * 300_000 + "bb", "x at " + "bb dot " * 9_000 + "com", "1." * 4_000, "12 " * 4_000, "(" * 1_000_000, "a" * 1_000_000 + "@", ":" * 100_000, "key=" * 20_000, "me@x.org " * 20_000]
    texts += ["word " * 798 + "call (415) 555-2671 now " + "word " * 900 + "call (415) 555-2671 now"]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].n_email == 1 and got[8].n_email == 20_000 and got[2].n_ip > 1
    at = [m.start() for m in re.finditer(r"\(415", texts[9])]
    assert at[0] < pii.WINDOW < at[0] + 14 and got[9].spans == ",".join(f"phone:{a}:{a + 14}" for a in at)


# -- 9 -----------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = random.Random(7)
    bad = ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for k in range(1500):
        t, y = prose(rng, rng.randint(5, 60)).split(), int(rng.random() < 0.15)
        for _ in range(3 * y):
            t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, 1, y))
    rows += [(5000, None), (5001, ""), (None, "idiot scum moron"), rows[0]]
    labels += [(3, 1, None), (None, 1, 1), (7777, 1, 1), labels[4]]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows)
    truth = {k: y for k, _, y in labels[:1500]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    swapped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity(d, swapped).collect())) == sorted(map(str, got))
    assert all(r.score == 0 for r in toxicity.toxicity(d, lab.limit(0)).collect())
    assert toxicity.toxicity(empty, lab).count() == 0


def test_ftrl_against_plain_loops():
    """The vectorised learner and scorer equal per-coordinate loops over dictionaries."""
    rng = random.Random(19)
    s = toxicity.Settings(bits=8, min_rows=2, epochs=2, l1=0.5)
    rows = [(int(rng.random() < 0.3), np.array(sorted({rng.randrange(256) for _ in range(rng.randint(0, 9))}), np.int64)) for _ in range(80)]
    got = toxicity.fit(rows, s)
    held = collections.Counter(int(i) for _, at in rows for i in at)
    positive = sum(y for y, _ in rows)
    boost = min(5.0, (len(rows) - positive) / positive)
    z, n, bias, bias_n = collections.defaultdict(float), collections.defaultdict(float), np.log(positive * boost / (len(rows) - positive)), 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else (np.sign(z[i]) * s.l1 - z[i]) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for y, at in rows:
            at = [int(i) for i in at if held[int(i)] >= s.min_rows]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-(bias + sum(w.values())))) - y) * (boost if y else 1.0)
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + bias_n**0.5)
    want = {i: weight(i) for i in list(z) if weight(i)}
    assert got.bias == pytest.approx(bias) and dict(zip(got.index.tolist(), got.value.tolist())) == pytest.approx(want)
    dense, hashes = np.zeros(256), toxicity.WordHashes()
    dense[got.index] = got.value
    texts = ["", "a b c d a b", "x " * 30]
    plain = [1 / (1 + np.exp(-(got.bias + sum(dense[i] for i in set(toxicity.features(t, hashes, 8).tolist()))))) for t in texts]
    assert toxicity.score_texts(texts, got, dense, hashes, 8) == pytest.approx(plain)


def test_toxicity_of_long_texts_and_more_columns(spark):
    rng = random.Random(23)
    long = prose(rng, 60_000, 50)
    rows = [(k, long if k < 2 else prose(rng, 20, 90) + " scum" * (k % 2), "mine", 1.5, "t") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, __tm_id double, row string")
    lab = spark.createDataFrame([(k, 1, k % 2) for k in range(2, 60)], "doc_id long, quality int, toxic int")
    left = toxicity.drop_toxic(d, lab)
    assert left.columns == d.columns and {r.score for r in left.collect()} == {"mine"}
    kept = {r.doc_id for r in toxicity.toxicity(d, lab).collect() if r.predicted == 0}
    assert {r.doc_id for r in left.collect()} == kept


# -- 10 ----------------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    def shingle(t):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    s = [(r[0], shingle(r[1])) for r in rows]
    root = {i: i for i, _ in s if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(a), None if i is None else find(i)) for i, a in s]


def test_near_duplicates_against_all_pairs(docs, empty, monkeypatch):
    want = sorted(brute_components(corpus()), key=str)
    for block, short in ((512, 32), (3, 1)):  # the second deals every open list into cells
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "SHORT", short)
        rows = near_dedup.near_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _, c in want if i == c}
    assert near_dedup.near_duplicates(empty).count() == 0


def near_copies(seed=21):
    """A base of which all copies lie near the threshold, a template with texts of its own, and two groups tied by one document."""
    rng = random.Random(seed)
    base, template = prose(rng, 60, 9**9).split(), prose(rng, 50, 9**9).split()
    texts = [" ".join(base)]
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9**9)}"
        texts.append(" ".join(w))
    texts += [" ".join([*template, *prose(rng, rng.randint(8, 20), 9**9).split()]) for _ in range(60)]
    one = prose(rng, 100, 9**9).split()
    texts += [" ".join(one[k : k + 80]) for k in range(0, 20, 4)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)] + [(3, texts[order[9]]), (3, texts[order[3]])]


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rows = near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute_components(rows), key=str)
    assert len({c for _, _, c in want}) > 20
    for block, short, hubs in ((512, 32, 12), (4, 2, 1)):
        for name, value in (("BLOCK", block), ("SHORT", short), ("HUBS", hubs)):
            monkeypatch.setattr(near_dedup, name, value)
        got = near_dedup.near_duplicates(d).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


# -- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage against its plain version over what the one before it left, to the final rows."""
    import corpus_pipeline
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(31)
    rows = corpus()
    rows += [(1000 + k, prose(rng, 30, 50) + " scum moron" * (k % 3 == 0), "en", f"s{k % 4}", 9, *rows[0][5:]) for k in range(120)]
    labels = [(r[0], 1, int("scum" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, lab = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    verdict = {(r.doc_id, r.text): r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, lab)).collect()}
    left = [r for r in rows if verdict[r[:2]] < 0.5]
    assert 30 < len(rows) - len(left) < 60 and not any("scum" in (r[1] or "") for r in left)
    # Line dedup: rows equal in id and text get the same answer.
    cut = {(i, t): new for i, t, new in brute_lines(list({r[:2] for r in left}))}
    left = [(r[0], cut[r[:2]], *r[2:]) for r in left if cut[r[:2]] is not GONE]
    # Near-duplicates: one document a component; equal rows once; null ids stay.
    component = {r[:2]: c for r, (_, _, c) in zip(left, brute_components(left))}
    left = list({r[:2]: r for r in left if r[0] == component[r[:2]]}.values())
    c = duckdb.connect()
    c.register("documents", spark.createDataFrame(left, SCHEMA).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    taken = c.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()
    copies = {(i, n): t // n if n else None for i, n, t in taken}
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for i, t, *_ in left:
        n = copies[(i, len(words(t)))]
        ids = [1, *sp.encode(t or ""), 2]
        if n is not None:
            want[(i, len(ids), tuple(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += n
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {(i, len(words(t))) for i, t, *_ in left}
    got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in final if (r.doc_id, 0) not in sizes)
    assert got == collections.Counter({k: n for k, n in want.items() if n and (k[0], 0) not in sizes}) and sum(got.values()) > 50


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tallymark.session import staged

    rows = corpus()
    labels = [(k, 1, 0) for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns, name
        n.append(docs.count())
    assert n[0] == n[1] >= n[2] > n[3]  # nothing toxic here; copies go
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == n[4] and set(final.columns) >= {"doc_id", "n_tokens", "ids"}
