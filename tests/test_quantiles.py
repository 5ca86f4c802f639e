"""Exact order statistics, cluster gates and image hashes against plain versions."""

import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark.operators import pairs, quantiles, stats


@pytest.mark.parametrize("bins", [64, 2048])
def test_medians_against_sorting(spark, bins):
    rng = random.Random(4)
    inf = float("inf")
    groups = {
        "a": [rng.random() * 10 ** rng.randint(-8, 8) for _ in range(501)], "b": [7.0] * 300, "c": [1.0, 2.0], "d": [5.5], "e": [float(rng.randrange(4)) for _ in range(400)], None: [3.0, -1.0, 2.0],
        "f": [0.0, 5e-324, 1e308, -1e308, 1.7976931348623157e308], "g": [inf, -inf, 1.0, 2.0], "h": [inf] * 3 + [0.0], "i": [1.0, 1.0000000000000002, 1.0000000000000004],
    }
    rows = [(k, x, "z") for k, xs in groups.items() for x in xs] + [("a", None, "z"), ("a", float("nan"), "z"), ("none", None, "z")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, x double, k string").repartition(5)
    n = F.col("n")
    got = {r.key: (r.n, r["at"]) for r in quantiles.at_ranks(frame, "key", "x", [F.floor((n - 1) / 2), F.floor(n / 2), F.lit(0), n - 1, n], bins).collect()}
    assert got == {k: (len(xs), [s[(len(s) - 1) // 2], s[len(s) // 2], s[0], s[-1], None]) for k, xs in groups.items() for s in [sorted(xs)]}
    got = {r.key: r.median for r in quantiles.medians(frame.where("key in ('a', 'b', 'c', 'd', 'e')"), "key", "x").collect()}
    assert got == {k: statistics.median(groups[k]) for k in "abcde"}
    assert {r.key: r.median for r in quantiles.medians(frame.where("key in ('c', 'd')"), "key", "x", whole_even=True).collect()} == {"c": 2.0, "d": 5.5}
    assert quantiles.medians(frame.limit(0), "key", "x").count() == 0


def test_medians_have_no_buffer(spark):
    """The plan of the last step holds no aggregate that keeps a group's values."""
    frame = spark.range(1000).select((F.col("id") % 3).alias("key"), F.col("id").cast("double").alias("min_price"), F.lit(2).alias("store_count"), F.lit("t").alias("type"))
    plan = stats.market_slices(frame.withColumn("region", F.col("key").cast("string")), "region")._jdf.queryExecution().toString().lower()
    assert "median(" not in plan and "percentile" not in plan and "collect_list(min_price" not in plan


def test_market_rules(spark):
    rows = [(["Cabernet"], "Salta", "Tinto", 100.0, 2), (["Malbec"], "Salta", None, 100.0, 2), (["Malbec", "Syrah"], "Salta", "Tinto", 201.0, 3), (["Malbec"], "Maipú", "", None, 3), (["Malbec"], "Maipú", "Tinto", 9.0, 1), ([], "Maipú", "Blanco", 50.0, 9), (None, None, None, 0.0, 9)]
    rows += [([f"v{k:02d}"], None, None, 5.0, 2) for k in range(14)]
    frame = spark.createDataFrame(rows, "varietals array<string>, region string, type string, min_price double, store_count int")
    got = {kind: [tuple(r) for r in stats.market_slices(frame, kind).collect()] for kind in ("varietal", "region", "type")}
    n = 4 + 14
    assert got["varietal"] == [("Malbec", 2, 2 / n, 151.0)] + [(f"v{k:02d}", 1, 1 / n, 5.0) for k in range(11)]
    assert got["region"] == [("Salta", 3, 3 / n, 100.0)]
    assert set(got["type"]) == {("Tinto", 2, 2 / n, None), ("Blanco", 1, 1 / n, None)}


def test_cluster_gates(spark):
    rows = [
        (1, "Alta", 2019, None, ["fosil", "gris"]), (2, "Baja", 2019, None, ["fosil", "gris"]),  # a conflict
        (3, "Alta", None, None, ["uno", "dos"]), (4, "Bodega Alta", None, None, ["uno", "dos"]),  # one brand holds the other
        (5, "Alta", 2019, None, ["tres", "mar"]), (6, "Baja", None, None, ["tres", "mar"]),  # vintages
        (7, "Alta", None, "x6", ["luz", "sol"]), (8, "Baja", None, None, ["luz", "sol"]),  # formats
        (9, None, None, None, ["pan", "sal"]), (10, "Baja", None, None, ["pan", "sal"]), (11, "", None, None, ["pan", "sal"]),  # no brand
        (12, "Alta", None, None, ["solo"]), (13, "Baja", None, None, ["solo"]),  # one token
        *[(20 + k, f"b{k}", None, None, ["muy", "comun"]) for k in range(7)],  # too many
        (30, "Álta", None, None, ["eco", "rio", "lago"]), (31, "ALTA", None, None, ["eco", "rio", "lago"]), (32, "Otra", None, None, ["eco", "rio", "lago"]),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id int, brand string, vintage int, format string, tokens array<string>, w int")
    assert {tuple(r.members) for r in pairs.token_pair_clusters(frame, "id", "tokens", "w").collect()} == {(1, 2), (30, 31, 32)}


def test_hashes_that_share_a_word(spark):
    """Ten thousand hashes with one word in common, groups that share two and three, and close pairs inside: the same pairs as by comparing all."""
    rng = random.Random(8)
    values = set()
    while len(values) < 2000:
        values.add("0000" + "".join(rng.choice("0123456789abcdef") for _ in range(60)))
    base = list(values)
    for h in base[:30]:
        x = int(h, 16)
        for _ in range(rng.randint(1, 12)):
            x ^= 1 << rng.randrange(256)
        values.add(f"{x:064x}")
    flat = int("0" * 40 + "abc" * 8, 16)
    for k in range(60):  # flat pictures: all but a few words are the same for many
        values.add(f"{flat ^ (rng.getrandbits(16) << (16 * rng.randrange(3))):064x}")
    hashes = sorted(values)
    want = {}
    numbers = [int(h, 16) for h in hashes]
    for i, x in enumerate(numbers):
        for j in range(i + 1, len(numbers)):
            d = (x ^ numbers[j]).bit_count()
            if d <= 10:
                want[i, j] = d
    frame = spark.createDataFrame([(f"u{k:05d}", h) for k, h in enumerate(hashes)], "url string, hash string").repartition(6)
    for hot in (20, 200):
        got = {(int(r.a[1:]), int(r.b[1:])): r.distance for r in pairs.near_hashes(frame, 10, hot=hot).collect()}
        assert got == want
    assert len(want) > 100


def test_placeholder_suspects(spark):
    rows = [("h", f"g{k}", f"b{k % 3}") for k in range(5)] + [("i", f"g{k}", f"b{k % 2}") for k in range(9)] + [("j", f"g{k}", ["x", "y", "", None][k % 4]) for k in range(8)] + [(None, "g", "b")]
    out = pairs.placeholder_suspects(spark.createDataFrame(rows, "hash string, group_slug string, brand string"))
    assert [tuple(r) for r in out.collect()] == [("h", 5, 3, "g0")]
    assert collections.Counter(r[0] for r in rows)["i"] == 9
