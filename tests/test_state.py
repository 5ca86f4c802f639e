"""Versions and the keyed cache: what a run that stops half-way leaves, and what the next one does."""

import collections

import pytest
from pyspark.sql import functions as F

from tallymark.operators import pairs
from tallymark.operators.ranking import numbered
from tallymark.sources.paging import listed, page_verdicts
from tallymark.sources.versions import ConcurrentCommit, KeyedCache, Versions


def test_versions(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/v")
    frame = lambda *rows: spark.createDataFrame(rows, "slug string, n int")
    with pytest.raises(LookupError):
        kept.read("groups")
    assert kept.commit({"groups": frame(("a", 1)), "offers": frame()}) == 1
    half = kept.write({"groups": frame(("b", 2)), "offers": frame(("o", 1))})  # the run dies here
    assert kept.numbers() == [1] and [tuple(r) for r in kept.read("groups").collect()] == [("a", 1)]
    with pytest.raises(LookupError):
        kept.read("groups", back=1)
    assert kept.commit({"groups": frame(("c", 3))}) == 2
    assert [tuple(r) for r in kept.read("groups").collect()] == [("c", 3)] and [tuple(r) for r in kept.read("groups", back=1).collect()] == [("a", 1)]
    assert kept.read("offers", number=1).count() == 0
    assert kept.vacuum() == [half["folder"].removeprefix("data/")]
    assert [tuple(r) for r in kept.read("groups", number=1).collect()] == [("a", 1)]
    other = Versions(spark, f"file://{tmp_path}/v")
    written = other.write({"groups": frame(("d", 4))})
    other.numbers = lambda: [1]  # it has looked before version 2 came
    with pytest.raises(ConcurrentCommit):
        other.publish(written)
    assert kept.numbers() == [1, 2]


def asker(path):
    """Answers by key, and a note of every key that is asked."""

    def ask(rows):
        def run(batches):
            for b in batches:
                with open(path, "a") as f:
                    f.writelines(f"{n}\t{k}\n" for n, k in zip(b["batch"], b["key"]))
                yield b.assign(answer=[None if k.endswith("9") else f"re {k}" for k in b["key"]])[["key", "answer"]]

        return rows.mapInPandas(run, "key string, answer string")

    return ask


def test_cache_asks_once(spark, tmp_path):
    cache, log = KeyedCache(spark, f"file://{tmp_path}/c"), tmp_path / "asked"
    said = lambda: [x.split("\t") for x in log.read_text().splitlines()] if log.exists() else []
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string").repartition(3)
    first = [f"k{n:03d}" for n in range(50)]
    assert cache.fill(frame([*first, "k001", None]), asker(log)) == 50
    batches = collections.Counter(n for n, _ in said())
    assert sorted(batches.values()) == [10, 20, 20] and sorted(k for _, k in said()) == first
    assert [k for n, k in said() if n == "0"] and {k for n, k in said() if n == "0"} == set(first[:20])
    assert cache.fill(frame(first), asker(log)) == 0 and len(said()) == 50  # keys without an answer are known too
    # A run that is cut off between write and commit: nothing of it is seen, and the next one asks its keys again, once.
    cache.append(spark.createDataFrame([("k900", "lost")], "key string, answer string"), publish=False)
    assert cache.fill(frame([*first, "k900", "k901"]), asker(log)) == 2
    assert cache.fill(frame([*first, "k900", "k901"]), asker(log)) == 0
    assert collections.Counter(k for _, k in said())["k900"] == 1
    rows = {r.key: (r.answer, r.run) for r in cache.answers(frame(["k003", "k009", "k900", "new", None])).collect()}
    assert rows == {"k003": ("re k003", 1), "k009": (None, 1), "k900": ("re k900", 2), "new": (None, None), None: (None, None)}
    before = {tuple(r) for r in cache.known().collect()}
    cache.compact()
    assert len(cache._parts()) == 1 and {tuple(r) for r in cache.known().collect()} == before
    cache.append(spark.createDataFrame([("k003", "later")], "key string, answer string"))
    assert {r.key: r.answer for r in cache.known().collect()}["k003"] == "later"


def test_cache_commits_in_groups(spark, tmp_path):
    """What fails while asking loses its own commit only."""
    cache = KeyedCache(spark, f"file://{tmp_path}/c")
    keys = spark.createDataFrame([(f"k{n:02d}",) for n in range(60)], "key string")

    def dies(rows):
        return rows.withColumn("answer", F.when(F.col("key") == "k45", F.raise_error(F.lit("no line"))).otherwise(F.lit("x")))

    with pytest.raises(Exception, match="no line"):
        cache.fill(keys, dies, batch=10, per_commit=2)
    assert sorted(r.key for r in cache.known().collect()) == [f"k{n:02d}" for n in range(40)]
    assert cache.fill(keys, lambda rows: rows.withColumn("answer", F.lit("y")), batch=10) == 20


def test_numbered(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009, k) for k in range(1009)] + [(None, -1)], "x int, k int").repartition(7)
    got = {r.x: r.number for r in numbered(rows, [F.col("x").asc_nulls_first()]).collect()}
    assert got == {None: 0, **{x: x + 1 for x in range(1009)}}
    assert numbered(rows.limit(0), [F.col("x")]).count() == 0


def test_health_of_stores_that_are_gone(spark):
    previous = spark.createDataFrame([(f"s{k}", 300) for k in range(10)], "store_slug string, product_count long")
    current = spark.createDataFrame([(f"s{k}", 300, 0) for k in range(4)] + [("new", None, 0)], "store_slug string, product_count long, errors int")
    assert {tuple(r) for r in pairs.health(previous, current).collect()} == {("error:total", None, 3000, 1200), ("warn:silent zero", "new", 0, 0)}
    assert pairs.health(previous.limit(0), current.where("store_slug <> 'new'")).count() == 0


def test_paging_stops(spark):
    items = [("a", 1, 1, "u1"), ("a", 1, 2, "u2"), ("a", 2, 3, "u2"), ("a", 2, 4, "u3"), ("a", 3, 5, "u1"), ("a", 3, 6, "u3"), ("a", 4, 7, "u9"), ("b", 1, 1, "u1"), ("b", 2, 2, "x"), ("b", 2, 3, "y"), ("c", 1, 1, "u"), ("c", 1, 2, "w"), ("c", 3, 3, "z"), ("d", 1, 1, None), ("e", 1, 1, "p"), ("e", 1, 0, "p"), ("e", 1, 2, "q"), ("e", 2, 3, "r"), ("e", 2, 3, "s"), ("e", 3, 9, "t"), ("e", 3, 9, "t2")]
    pages = [("a", k, True) for k in (1, 2, 3, 4)] + [("b", 1, True), ("b", 2, True), ("c", 1, True), ("c", 3, True), ("d", 1, True), ("e", 1, True), ("e", 1, True), ("e", 2, None), ("e", 3, True), ("f", 1, False)]
    items = spark.createDataFrame([(*r, "e") for r in items], "store_slug string, page int, ord int, external_url string, reason string").repartition(3)
    got = page_verdicts(spark.createDataFrame(pages, "store_slug string, page int, ok boolean"), items, full=2)
    said = {(r.store_slug, r.page): (r.items, r.new, r.counts, r.reason) for r in got.collect()}
    assert said == {
        ("a", 1): (2, 2, True, None), ("a", 2): (2, 1, True, None), ("a", 3): (2, 0, False, "nothing new"), ("a", 4): (1, 1, False, "after end"), ("b", 1): (1, 1, True, "short"), ("b", 2): (2, 2, False, "after end"),
        ("c", 1): (2, 2, True, None), ("c", 3): (1, 1, False, "gap"), ("d", 1): (0, 0, False, "empty"), ("e", 1): (2, 2, True, None), ("e", 2): (2, 2, False, "failed"), ("e", 3): (2, 2, False, "after end"), ("f", 1): (0, 0, False, "failed"),
    }
    assert {(r.store_slug, r.external_url, r.ord) for r in listed(items, got).collect()} == {("a", "u1", 1), ("a", "u2", 2), ("a", "u3", 4), ("b", "u1", 1), ("c", "u", 1), ("c", "w", 2), ("e", "p", 0), ("e", "q", 2)}
    assert page_verdicts(spark.createDataFrame([], "store_slug string, page int, ok boolean"), items).count() == 0


def test_decided_pairs_from_the_cache(spark, tmp_path):
    """Grey pairs that a cached answer settles become links; a no settles them too, and only those without a commit are still to ask."""
    from tallymark.operators import resolve

    group = "struct<name: string, brand: string, vintage: int>"
    rows = [(1, 2, ("Uno ", "Sur", 2019), ("uno", None, None)), (2, 1, ("uno", None, None), ("Uno ", "Sur", 2019)), (3, 4, ("a", "b", None), ("a", "c", None)), (5, 6, ("new", None, None), ("newer", None, None)), (7, 8, ("odd", None, None), ("even", None, None))]
    grey = spark.createDataFrame(rows, f"a_id long, b_id long, a {group}, b {group}").withColumn("key", resolve.decision_key())
    keys = [r.key for r in grey.orderBy("a_id").collect()]
    assert keys[0] == keys[1] == "uno |sur|2019||uno||"  # the same whichever side comes first
    cache = KeyedCache(spark, f"file://{tmp_path}/c")
    cache.append(spark.createDataFrame([(keys[0], "yes"), (keys[2], "no"), (keys[4], None)], "key string, answer string"))
    asked = grey.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("key").alias("said"))
    links, left = resolve.decided_links(asked, cache.known(), F.col("said"))
    assert {(r.src, r.dst) for r in links.collect()} == {(1, 2), (2, 1)}
    assert {(r.a, r.b) for r in left.collect()} == {(5, 6)}


def test_repaired_images(spark):
    from tallymark.operators import resolve

    groups = spark.createDataFrame([("g", "gone"), ("h", "own"), ("i", None), ("j", "kept")], "group_slug string, image_url string")
    offers = spark.createDataFrame([("g", 2, "late"), ("g", 1, "early"), ("h", 1, "own"), ("i", 1, "first"), ("j", 1, None)], "group_slug string, ord int, image_url string")
    assert {r.group_slug: r.image_url for r in resolve.repair_images(groups, offers).collect()} == {"g": "early", "h": "own", "i": "first", "j": "kept"}


def test_store_lists_and_offer_labels(spark):
    from tallymark.functions.text import offer_label
    from tallymark.operators import serving

    rows = [("b", "B", 5, "t", ["x"], "vtex"), ("a", "A", 5, None, None, "tiendanube"), ("c", None, None, "t", [], "other"), ("d", "D", 9, "t", ["x", None], None), ("e", "E", 1, "t", None, "tiendanube")]
    stores = spark.createDataFrame(rows, "store_slug string, store_name string, product_count int, started_at string, errors array<string>, platform string")
    assert [(r.store_slug, r.product_count, r.errors) for r in serving.store_list(stores).orderBy("place").collect()] == [("d", 9, 2), ("a", 5, 0), ("b", 5, 1), ("e", 1, 0), ("c", 0, 0)]
    assert [(r.store_slug, r.platform_rank) for r in serving.store_table(stores).orderBy("place").collect()] == [("a", 1), ("e", 1), ("b", 4), ("c", 99), ("d", 99)]
    assert serving.store_list(stores.limit(0)).count() == 0

    names = [("Vino Luna Malbec Reserva 2019 750ml", "Luna", "Malbec Reserva"), ("Luna tinto 1985", "LUNA", "Luna"), ("A.B Gran Corte 375 CC", "A.B", "Gran Corte"), ("AxB Gran Corte", "A.B", "AxB Gran Corte"), ("Sol 2030  Blanco", None, "Sol 2030"), ("Sol y Luna", "", "Sol y Luna"), (None, "Luna", None)]
    d = spark.createDataFrame(names, "name string, brand string, want string")
    assert [r.got for r in d.select(offer_label(F.col("name"), F.col("brand")).alias("got")).collect()] == [n[2] for n in names]
