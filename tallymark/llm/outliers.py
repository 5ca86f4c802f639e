"""Quality rules with robust multivariate outliers.

Every text gets five counts and two base rules (too short; mostly repeated). For the rest, minimum-covariance-determinant
estimates by language and source judge the transformed counts: documents whose squared Mahalanobis distance is beyond a high
chi-square quantile are rejected.

The MCD runs on all documents that pass the base. Transformed counts are fixed-point integers, so every sum is exact and reruns
agree. A concentration step is one pass that sums moments by (group, start, distance bin); cumulating the bins up to the share
`SHARE` of the group gives the next mean and scatter, so no group meets in one task and nothing but moments
is shuffled. Two starts (all documents; medians and quartile ranges) are concentrated until no determinant falls any more, `STEPS` times at most, and the
one of smaller determinant is reweighted. A variance floor keeps the scatter regular where a count is zero in most documents.

One rule judges all: a group's location and scatter are drawn towards those of its language, and these towards the estimate over all documents, as if each had
`PRIOR` documents of the wider one; so a large group is judged by its own estimate, a small one mostly by the wider ones.
Edge cases: a null or empty text has all counts 0 and fails the base. Null lang and null source are groups of their own. Repeated
rows and ids are judged each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import staged

from .base import SPACES, pick, text_slices, texts_of

SYMBOLS = "#*$%&|<>"
SHARE, PRIOR, STEPS, QUANTILE = 0.75, 200, 8, 0.9995
P, ONE = 5, 4096
#: The least standard deviation of each coordinate, in its own units.
FLOOR = (0.35, 0.06, 0.5, 0.5, 0.5)
BINS = 1024
#: Files of a table of states, which has a row per group and start.
FILES = 4
#: Sums are taken in so many parts, which only meet as Python's integers: a sum of 64 bits holds 10**9 rows of the largest product.
PARTS = 64


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    for w in words:
        if w not in number:
            number[w] = len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    m = len(number)
    pair = ids[:-1] * m + ids[1:]
    if m > 1 << 20:  # three numbers would not fit one integer
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * m + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed of each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches):
            rows = np.array([counts(t) for t in texts_of(batch)], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "source")], *[pa.array(rows[:, k]) for k in range(5)]], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    rows = pick(documents, "doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.asinh(50 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))), F.asinh(100 * F.col("n_dup_lines") / n), F.asinh(5 * F.col("n_repeat_words") / n)]
    return [F.round(x * ONE).cast("long").alias(f"x{k}") for k, x in enumerate(parts)]


def chi_square(x: float, k: int) -> float:
    """The chi-square distribution function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def quantile(q: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """What makes the scatter of the innermost `share` of normal rows unbiased."""
    return share / chi_square(quantile(share, P), P + 2) if share < 1 else 1.0


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]]
_STATE = "key string, start int, fitted long, det double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"w{i}{j} double" for i, j in _PAIRS])


def state(key: str, start: int, fitted: int, n: int, s: np.ndarray, ss: np.ndarray, factor: float) -> dict:
    """Mean and inverse scatter from exact sums of `n` fixed-point rows."""
    mean = s / n
    scatter = (ss / n - np.outer(mean, mean)) / ONE**2 * factor + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(scatter)
    return {"key": key, "start": start, "fitted": fitted, "det": float(np.linalg.slogdet(scatter)[1])} | {f"m{i}": mean[i] / ONE for i in range(P)} | {f"w{i}{j}": inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS}


def _sums(row) -> tuple[np.ndarray, np.ndarray]:
    ss = np.zeros((P, P))
    for i, j in _PAIRS:
        ss[i, j] = ss[j, i] = float(row[f"s{i}{j}"])
    return np.array([float(row[f"s{i}"]) for i in range(P)]), ss


def concentrate(rows, share: float, limit: int | None = None) -> dict:
    """The next state of a group from its moments by bin, over the innermost bins that hold `share` of it or lie below bin `limit`."""
    by_bin = rows.groupby("bin")["n"].sum().sort_index()
    n = by_bin.cumsum().to_numpy()
    fitted = int(n[-1])
    last = int(np.searchsorted(n, math.ceil(share * fitted))) if limit is None else max(0, int(np.searchsorted(by_bin.index.to_numpy(), limit)) - 1)
    inside = rows[rows["bin"] <= by_bin.index[last]]
    # Python's integers: sums over bins and parts may leave 64 bits.
    inner = dict(zip(_MOMENTS, inside[_MOMENTS].to_numpy(dtype=object).sum(axis=0)))
    s, ss = _sums(inner)
    used = int(inner["n"])
    factor = consistency(used / fitted) if limit is None else consistency(0.975)
    return state(rows["key"].iloc[0], int(rows["start"].iloc[0]), fitted, used, s, ss, factor)


def _part() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the state's m.. and w..."""
    d = [F.col(f"x{i}") / ONE - F.col(f"m{i}") for i in range(P)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + F.col(f"w{i}{j}") * d[i] * d[j]
    return F.greatest(out, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.least(F.floor(F.log1p(d2) * 128), F.lit(BINS - 1)).cast("int")


def _bin_of(d2: float) -> int:
    return min(int(math.log1p(d2) * 128), BINS - 1)


def _kept(states: DataFrame) -> DataFrame:
    """The states in a few files: spread over a file a task, their footers outweigh them, and joins would take them for large and deal the rows by group."""
    return staged(states.repartition(FILES), "mcd")


def _step(rows: DataFrame, states: DataFrame, share: float, limit: int | None = None) -> DataFrame:
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]]
    binned = rows.join(states, "key").withColumn("bin", _bin(distance()))
    moments = binned.groupBy("key", "start", "bin", _part()).agg(*sums)

    def solve(pdf):
        import pandas as pd

        return pd.DataFrame([concentrate(pdf, share, limit)])

    return _kept(moments.groupBy("key", "start").applyInPandas(solve, _STATE))


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: mean and scatter of all rows of a group. Start 1: medians and quartile ranges, from exact histograms."""
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]]
    whole = rows.groupBy("key", _part()).agg(*sums)
    cells = rows.select("key", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / 64) for i in range(P)])).alias("i", "cell")).groupBy("key", "i", "cell").agg(F.count("*").alias("n"))

    def first(pdf):
        import pandas as pd

        r = dict(zip(_MOMENTS, pdf[_MOMENTS].to_numpy(dtype=object).sum(axis=0)))
        s, ss = _sums(r)
        return pd.DataFrame([state(pdf["key"].iloc[0], 0, int(r["n"]), int(r["n"]), s, ss, 1.0)])

    def second(pdf):
        import pandas as pd

        out, var = {}, []
        for i in range(P):
            c = pdf[pdf["i"] == i].sort_values("cell")
            n = c["n"].cumsum().to_numpy()
            low, mid, high = (c["cell"].to_numpy()[min(int(np.searchsorted(n, q * n[-1])), len(n) - 1)] for q in (0.25, 0.5, 0.75))
            out[f"m{i}"] = (mid + 0.5) * 64 / ONE
            var.append(((high - low) * 64 / ONE / 1.349) ** 2 + FLOOR[i] ** 2)
        fitted = int(pdf[pdf["i"] == 0]["n"].sum())
        w = {f"w{i}{j}": 1 / var[i] if i == j else 0.0 for i, j in _PAIRS}
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "start": 1, "fitted": fitted, "det": float(np.log(var).sum())} | out | w])

    return _kept(whole.groupBy("key").applyInPandas(first, _STATE).unionByName(cells.groupBy("key").applyInPandas(second, _STATE)))


def estimates(rows: DataFrame) -> DataFrame:
    """The reweighted MCD state of every group key in `rows` (key, x0..)."""
    states = _starts(rows)
    for k in range(STEPS):
        before, states = states, _step(rows, states, SHARE)
        fell = states.select("key", "start", F.col("det").alias("now")).join(before.select("key", "start", "det"), ["key", "start"]).where("now < det - 1e-4")
        if k and fell.isEmpty():  # the first step goes from a share of one to `SHARE`
            break
    best = states.groupBy("key").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    states = _kept(states.join(best, ["key", "start"]))
    return _step(rows, states, SHARE, limit=_bin_of(quantile(0.975, P)))


def drawn(levels: list[dict]) -> dict:
    """Location and inverse scatter of a group (`levels`: its own state, its language's, that of all), each level drawn towards the next."""
    mean = scatter = None
    for r in reversed(levels):
        own_mean, w = np.array([r[f"m{i}"] for i in range(P)]), np.zeros((P, P))
        for i, j in _PAIRS:
            w[i, j] = w[j, i] = r[f"w{i}{j}"] / (1 if i == j else 2)
        own = np.linalg.inv(w)
        share = 1.0 if mean is None else r["fitted"] / (r["fitted"] + PRIOR)
        mean = own_mean if mean is None else share * own_mean + (1 - share) * mean
        scatter = own if scatter is None else share * own + (1 - share) * scatter
    inverse = np.linalg.inv(scatter)
    return {f"m{i}": mean[i] for i in range(P)} | {f"w{i}{j}": inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS}


def judges(groups: DataFrame, states: DataFrame) -> DataFrame:
    """own, m0.., w00..: what each group (own, pool, whole) is judged by; one row a group."""
    columns = ["fitted", *[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i, j in _PAIRS]]
    for side in ("own", "pool", "whole"):
        groups = groups.join(states.select(F.col("key").alias(side), F.struct(*columns).alias(f"{side}_state")), side)

    def run(frames: Iterator):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([{"own": r.own} | drawn([r.own_state, r.pool_state, r.whole_state]) for r in pdf.itertuples()], columns=["own", *columns[1:]])

    return groups.mapInPandas(run, "own string, " + ", ".join(f"{c} double" for c in columns[1:]))


def quality(documents: DataFrame, cutoff: float = QUANTILE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance (squared; null where the base fails) of each document."""
    key = lambda pooled: F.to_json(F.struct("lang", *([] if pooled else ["source"]), F.lit(pooled).alias("pooled")))
    rows = staged(measure(documents).select("*", key(False).alias("own"), key(True).alias("pool"), F.lit("all").alias("whole"), *_vector()), "quality")
    names = [f"x{i}" for i in range(P)]
    passed = rows.where("not base_failed")
    found = estimates(passed.select(F.explode(F.array("own", "pool", "whole")).alias("key"), *names))
    judge = _kept(judges(passed.select("own", "pool", "whole").distinct(), found)).withColumnRenamed("own", "judged")
    judged = rows.join(judge, (F.col("own") == F.col("judged")) & ~F.col("base_failed"), "left").withColumn("distance", F.when(F.col("m0").isNotNull(), distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= quantile(cutoff, P))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance")
