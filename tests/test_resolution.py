"""The resolution chain, brand inference and lineage against plain versions."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions.wine import words
from tallymark.operators import brands, chain, lineage

LISTING = "id long, ord long, store_slug string, url string, sku string, name string, brand string, image_url string, price double, in_stock boolean"


def plain_words(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", words(F.col("n")).alias("w")).collect()
    return {r.n: r.w or [] for r in rows}


def plain_two_passes(rows, generic, said):
    """Both passes as loops over all brands and all words."""
    rows = [dict(zip(("id", "name", "brand"), r)) for r in rows]
    known = {}
    for r in rows:
        r["brand"] = (r["brand"] or "").strip() or None
        r["from"] = "own" if r["brand"] else None
        if r["brand"] and len(r["brand"]) >= 3:
            known.setdefault(r["brand"].lower(), r["brand"])
    entries = sorted(((k, x) for k, x in known.items() if k not in generic), key=lambda e: -len(e[0]))
    for r in rows:
        if not r["brand"] and r["name"]:
            for label, shown in entries:
                if re.search(rf"(?a:\b){re.escape(label)}(?a:\b)", r["name"].lower()):
                    r["brand"], r["from"] = shown, "name"
                    break
    counts, shown = collections.defaultdict(collections.Counter), {}
    for r in rows:
        if r["brand"] and len(r["brand"].strip()) >= 3:
            label = r["brand"].strip().lower()
            shown.setdefault(label, r["brand"].strip())
            for w in set(said.get(r["name"], [])) - {x for x in label.split() if len(x) >= 3}:
                if len(w) >= 4:
                    counts[w][label] += 1
    lines = {w: shown[next(iter(c))] for w, c in counts.items() if len(c) == 1 and max(c.values()) >= 3}
    for r in rows:
        if not r["brand"]:
            hit = next((w for w in said.get(r["name"], []) if w in lines), None)
            if hit:
                r["brand"], r["from"] = lines[hit], "line"
    return {r["id"]: (r["brand"], r["from"]) for r in rows}


def test_two_passes_against_loops(spark):
    rng = random.Random(5)
    houses = ["Alta", "Alta Vista", "A. Lisa", "O'Brien", "Finca-Sur", "Reserva", "ab", "Catena (x)", "Río Sur", "alta vista", "x_y"]
    parts = ["alta", "vista", "a. lisa", "o'brien", "finca-sur", "finca", "sur", "reserva", "polígonos", "fosil", "malbec", "altamira", "catena (x)", "catena", "río", "x_y", "x", "2019"]
    rows = []
    for k in range(400):
        name = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        if k % 5 == 0:
            name = f"concreto {rng.choice(['malbec', 'fosil', 'altamira'])}"
        rows.append((k, name if k % 31 else None, (("Zuccardi" if k % 10 else None) if k % 5 == 0 else rng.choice(houses) if rng.random() < 0.4 else rng.choice([None, "", "  "])) if k % 7 else None))
    frame = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, name string, brand string, ord long").repartition(5)
    got = {r.id: (r.brand, r.brand_from) for r in brands.infer_brands(frame, ["reserva"]).collect()}
    want = plain_two_passes(rows, {"reserva"}, plain_words(spark, {r[1] for r in rows if r[1]}))
    assert got == want
    assert {x[1] for x in want.values()} == {"own", "name", "line", None}
    assert brands.infer_brands(frame.limit(0)).count() == 0


def test_lineage_over_runs(spark):
    """A slug that comes back, long chains and a merge of merged groups; each as a plain walk over the events in time."""
    rng = random.Random(9)
    events, alive = [], [f"s{k}" for k in range(60)]
    for t in range(25):
        gone = rng.sample(alive, 4)
        stay = [x for x in alive if x not in gone]
        for x in gone:
            events.append((t, "merge", x, rng.choice(stay)))
        back = rng.sample(gone, 2)  # slugs that a later run gives out again
        alive = stay + back
    events += [(50 + t, "rename", f"r{t}", f"r{t + 1}") for t in range(30)]

    def walk(t, slug):
        for e in sorted(events):
            if e[0] > t and e[2] == slug:
                slug, t = e[3], e[0]
        return slug

    frame = spark.createDataFrame([*events, (3, "none", None, "x"), (3, "none", "q", "q")], "t long, stage string, old string, new string").repartition(4)
    out = lineage.compress(frame).cache()
    got = {(r.t, r.old): (r.final, r.hops) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {(e[0], e[2]): walk(e[0], e[3]) for e in events}
    assert got[(50, "r0")] == ("r30", 30)
    rows = [(f"s{k % 60}", t) for k, t in enumerate(range(-1, 41))] + [("never", 1), (None, 1), ("r5", 0)]
    moved = lineage.follow(spark.createDataFrame(rows, "slug string, at long"), out, at=F.col("at"), into="now").collect()
    assert {(r.slug, r["at"]): r.now for r in moved} == {(s, t): walk(t, s) if s else None for s, t in rows} and len(moved) == len(rows)
    assert lineage.compress(frame.limit(0)).count() == 0


def test_histories_and_favourites_follow(spark):
    events = lineage.compress(spark.createDataFrame([(1, "image", "a", "b"), (2, "bucket", "b", "c")], "t long, stage string, old string, new string"))
    history = spark.createDataFrame([("a", 1, 5.0, 2), ("c", 1, 4.0, 1), ("b", 2, 9.0, 1), ("z", 1, 1.0, 1)], "slug string, date int, min double, stores int")
    assert {tuple(r) for r in lineage.follow_history(history, events).collect()} == {("c", 1, 4.0, 2), ("c", 2, 9.0, 1), ("z", 1, 1.0, 1)}
    lists = spark.createDataFrame([("u", 1, "z"), ("u", 2, "b"), ("u", 3, "a"), ("u", 4, "y"), ("w", 1, "c")], "user string, pos int, slug string")
    assert {(r.user, r.pos, r.slug) for r in lineage.follow_favourites(lists, events).collect()} == {("u", 1, "z"), ("u", 2, "c"), ("u", 3, "y"), ("w", 1, "c")}


@pytest.fixture(scope="module")
def rules(spark):
    prefixes = spark.createDataFrame([("a lisa", "A Lisa", 1)], "prefix string, brand string, ord int")
    return chain.Rules(prefixes, spark.createDataFrame([("varios",)], ["brand"]), spark.createDataFrame([("fam. sur", "Sur", 1)], "from string, to string, ord int"), ["vino"], ["a lisa"], ["malbec"], ["vino"])


def test_chain_edges(spark, rules):
    """Null and empty fields, repeated rows, ties; every listing with a key is in exactly one group; and an empty table."""
    rows = [
        (1, 1, "s", "u1", None, "A Lisa Malbec", None, None, 100.0, True), (2, 2, "t", "u2", None, "Vino A LISA", "Varios", None, None, None),
        (3, 3, "s", None, "7790000000001", "Uno Dos", "Sur", "i", 0.0, True), (4, 4, "t", None, "7790000000001", "Tres Dos", "fam. sur", "i", 50.0, False),
        (5, 5, None, "", "", "", "", "", None, False), (6, 6, "s", "u", "1", None, None, None, 1.0, True), (7, 7, "s", "u7", None, "&ntilde; &amp; Q8", "B&amp;B", None, 3.0, True), (8, 8, "s", "u7", None, "&ntilde; &amp; Q8", "B&amp;B", None, 3.0, True),
    ]
    out = chain.resolve_listings(spark.createDataFrame([(*r, "extra") for r in rows], LISTING + ", slug string").repartition(3), rules)
    groups = {r.slug: r for r in out.groups.collect()}
    offers = out.offers.collect()
    assert {r.slug for r in offers} == set(groups)
    assert sorted(r.id for r in offers) == [1, 2, 3, 4, 7, 8]
    label = [r for r in groups.values() if r.brand == "A Lisa"]
    assert len(label) == 1 and label[0].varietals == ["Malbec"] and label[0].min_price == 100.0
    sur = [r for r in groups.values() if r.brand == "Sur"]
    assert len(sur) == 1 and (sur[0].min_price, sur[0].store_count) == (None, 1)
    assert {(r.stage, r.old, r.new) for r in out.events.collect()} == {("number", "dos-sur-uno", "dos-sur-tres"), ("inherit", "lisa", "lisa-malbec")}
    empty = chain.resolve_listings(spark.createDataFrame([], LISTING), rules)
    assert empty.groups.count() == empty.offers.count() == empty.events.count() == 0


def test_merged_offers(spark):
    """Of equal offers the first by address, or the cheapest by shop, address and name, stays; the survivor lends from the others."""
    offers = [(1, 1, "s", "u", "n", "x", 9.0, True, False), (2, 2, "s", "u", "n", "y", 7.0, True, False), (3, 3, "t", "u", "n", "y", 8.0, False, False)]
    offers = spark.createDataFrame(offers, "id long, ord long, store_slug string, url string, name string, slug string, price double, in_stock boolean, is_collector boolean")
    groups = [("x", "X", None, None, None, None, ["Malbec"], None, "Tinto", 3, 1, 9.0, 9.0), ("y", "Y", "B", 2019, None, "i", ["Syrah"], "Salta", None, 1, 2, 7.0, 7.0)]
    groups = spark.createDataFrame(groups, "slug string, name string, brand string, vintage int, format string, image_url string, varietals array<string>, region string, type string, store_count long, offer_count long, min_price double, max_price double")
    state = chain.State(offers, groups)
    mapping = spark.createDataFrame([("x", "x"), ("y", "x")], "group_slug string, merged_into string")
    a = chain.merge(state, mapping, "image", "current", False, "url")
    assert [r.id for r in a.offers.collect()] == [1]
    (g,) = a.groups.collect()
    assert (g.name, g.brand, g.varietals, g.vintage, g.min_price) == ("X", None, ["Malbec", "Syrah"], None, 9.0)
    b = chain.merge(state, mapping, "bucket", "in_stock", True, "offer")
    assert sorted(r.id for r in b.offers.collect()) == [2, 3]
    (g,) = b.groups.collect()
    assert (g.name, g.brand, g.varietals, g.vintage, g.image_url, g.region, g.min_price, g.offer_count, g.store_count) == ("X", "B", ["Malbec"], 2019, "i", "Salta", 7.0, 2, 1)
    assert [(r.t, r.stage, r.old, r.new) for r in b.events[0].collect()] == [(1, "bucket", "y", "x")]
