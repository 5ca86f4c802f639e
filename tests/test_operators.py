"""Operators against small brute-force versions and worked cases."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import mathx, text, wine
from tallymark.operators import catalogue, graph, history, pages, pairs, resolve, search, serving, stats
from tallymark.sources import payloads
from tallymark.streaming import limiter, pageviews


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "said, want",
    [("Malbec 750 ml", None), ("Malbec x 6", "x6"), ("Malbec Magnum", "magnum"), ("Pack Malbec 375 cc", "375ml-pack"), ("Malbec 1,5 l", "1.5l"), ("Malbec x 750", "x750"), ("Malbec 375", "375ml"), ("Malbec x 375", "375ml"), ("Caja x 375 de 750 ml", "caja-x375"), ("Box 375cm³", "375ml-box"), ("", None)],
)
def test_format(spark, said, want):
    assert one(spark, text.extract_format(F.col("s")), s=said) == want


def test_scalars(spark):
    assert one(spark, text.slugify(F.col("s")), s=" Bodega Ñandú & Cía ") == "bodega-nandu-cia"
    assert one(spark, text.brand_page_key(F.col("s")), s="Bodegas Ñandú") == "nandu"
    assert one(spark, text.extract_vintage(F.col("s")), s="Malbec 2019 reserva 1800") == 2019
    assert one(spark, text.token_key(F.col("s"), F.col("b")), s="Malbec Reserva 2019 750ml", b="Casa") == "casa malbec reserva"
    assert one(spark, text.decode_entities("s"), s="A &amp; B &#8220;x&#x201D; &zz;") == "A & B “x” &zz;"
    assert one(spark, text.format_money(F.col("n")), n=1234567.4) == "$ 1.234.567"
    assert one(spark, text.format_money(F.col("n")), n=0.0) == "Consultar"
    assert one(spark, text.display_name(F.col("s")), s="CASA DE PIEDRA") == "Casa de Piedra"
    assert one(spark, text.pair_key(F.col("a"), F.col("b")), a=" B", b="a") == one(spark, text.pair_key(F.col("b"), F.col("a")), a=" B", b="a")
    assert one(spark, F.array(*text.split_versus(F.col("s"))), s="a-vs-b-vs-c") == ["a-vs-b", "c"]
    assert one(spark, text.normalize_image_url(F.col("s")), s="https://acdn-us.x.com/a-240-0.jpg?v=1") == "https://cdn-us.x.com/a.jpg"
    assert one(spark, mathx.hamming(F.col("a"), F.col("b")), a="0" * 63 + "3", b="f" + "0" * 63) == 6
    assert one(spark, mathx.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0.0
    assert one(spark, text.peel(F.split("s", " "), ["vino", "el"], 3), s="el vino el vino rojo") == ["vino", "rojo"]
    assert one(spark, F.col("s").rlike(text.EDGE + "ros" + text.EDGE), s="vino rosé")


@pytest.mark.parametrize("slug, junk", [("tipo-tinto", True), ("malbec-categoria-a", True), ("1888", True), ("precio-bajo", False), ("malbec", False)])
def test_junk_slugs(spark, slug, junk):
    assert one(spark, text.is_junk_slug(F.col("s")), s=slug) is junk


def test_wine_names(spark):
    said = lambda f, s, b="": one(spark, f(F.col("s"), F.col("b")), s=s, b=b)
    assert said(lambda s, b: wine.varietals(s), "Cabernet Franc Cabernet Malbec Merlot Syrah") == ["Malbec", "Cabernet Franc", "Merlot"]
    assert said(lambda s, b: wine.varietals(s), "CABERNET reserva") == ["Cabernet"]
    assert said(wine.region, "Tinto de Agrelo", "x") == "Luján de Cuyo"
    assert said(lambda s, b: wine.region(s, b, F.lit("Salta")), "Tinto", "x") == "Salta"
    assert said(lambda s, b: wine.region(s, b), "Maipú", "x") is None  # the mark is no ASCII word character, so no edge follows it
    assert said(lambda s, b: wine.kind(s), "Malbec Extra Brut") == "Espumante"
    assert said(lambda s, b: wine.colour(s), "Rosado joven") == "rose"
    assert said(lambda s, b: wine.colour(s), "Cosecha  Tardía") == "dulce"
    assert said(lambda s, b: wine.colour(s), "Malbec") is None
    assert said(wine.canonical_key, "Zuccardi Emma Bonarda 2012 x 375", "Bodega Zuccardi") == said(wine.canonical_key, "Emma BONARDA Zuccardi 2014 750cc", "Familia Zuccardi") == "bonarda emma zuccardi"
    assert said(wine.canonical_key, "Zucardi Emma", "Zuccardi") == "emma zuccardi zuccardi"  # aliases come last; repeats stay
    assert said(wine.canonical_key, "2014 x 6", "") == ""
    nothing = F.lit(None).cast("string")
    empty = said(lambda s, b: F.struct(wine.canonical_key(nothing, nothing), text.extract_format(nothing), wine.region(nothing, nothing), wine.kind(nothing), wine.colour(nothing), F.size(wine.varietals(nothing)), wine.is_wine(nothing)), "")
    assert list(empty) == ["", None, None, None, None, 0, True]
    assert [said(lambda s, b: wine.is_wine(s), s) for s in ("Malbec", "Ron de la casa", "Ron dorado", "Gin 500", "Malbec 200 ml", "")] == [True, True, False, False, False, True]
    assert one(spark, text.decode_entities("s"), s="&#38;amp; &eacute; &NBSP;x &lt") == "& &eacute;  x &lt"
    assert one(spark, text.normalize_image_url(F.col("s")), s="https://x.com/img/no-photo.png") is None


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (60, 80), (40, 39)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1)] + ([(k, k + 1) for k in range(n - 1)] if n == 40 else [])
        root = {x: x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}
        for _ in range(n):
            for a, b in edges:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == root
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_limiter_counts_accepted_only(spark):
    events = [("a", t, k) for k, t in enumerate([0, 1, 2, 3, 59_999, 60_000, 60_001, 60_002])] + [("b", 5, 99)]
    rows = limiter.limit_batch(spark.createDataFrame(events, "key string, ts long, event_id long"), 3, 60_000).collect()
    assert [r.accepted for r in sorted(rows, key=lambda r: (r.key, r.ts))] == [True, True, True, False, False, True, True, True, True]


def test_stream_is_its_batch_twin(spark, tmp_path):
    events = [(f"k{t % 3}", t * 700, t) for t in range(200)]
    source = spark.createDataFrame(events, "key string, ts long, event_id long")
    source.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).json(str(tmp_path / "in"))
    q = limiter.limit_stream(stream, 5, 60_000).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    got = {r.event_id: r.accepted for r in spark.table("limited").collect()}
    assert got == {r.event_id: r.accepted for r in limiter.limit_batch(source, 5, 60_000).collect()}


def test_pageview_log_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"kind":"pageview","ts":1,"path":"/a"}\n\nnot json\n{"kind":"pageview","ts":86400000,"path":"/a","ref":"x"}\n{"kind":"other","ts":2,"path":"/b"}\n{"kind":"pageview","path":"/c"}\n')
    log = pageviews.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 3
    assert pageviews.validated(log).count() == 2
    q = pageviews.append(pageviews.read_stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 3  # a view without a time is taken as now
    assert {(str(r.day), r.n) for r in pageviews.daily(pageviews.validated(log)).collect()} == {("1970-01-01", 1), ("1970-01-02", 1)}


def test_json_ld(spark):
    html = """<script type="application/ld+json">{broken</script><script type='application/ld+json'>[{"@type":"Product","name":"A","brand":{"name":"B"},"gtin13":"779 1234567890","offers":{"price":"$1500.50","availability":"https://schema.org/InStock"},"@id":"u"},{"@type":"Thing"}]</script>
    <script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":["Product"],"name":"C","brand":"D","sku":"x","image":["i","j"],"offers":[{"price":0}]}}</script>"""
    rows = {r.name: r for r in payloads.json_ld_products(spark.createDataFrame([(html, "s")], ["html", "store_slug"])).collect()}
    assert set(rows) == {"A", "C"}
    assert (rows["A"].brand, rows["A"].external_sku, rows["A"].price_ars, rows["A"].in_stock, rows["A"].external_url) == ("B", "7791234567890", 1500.5, True, "u")
    assert (rows["C"].brand, rows["C"].external_sku, rows["C"].price_ars, rows["C"].image_url) == ("D", "x", None, "i")


def test_shop_payloads(spark):
    frame = lambda payload, **more: spark.createDataFrame([("s", payload, *more.values())], ["store_slug", "payload", *more])
    w = payloads.woocommerce(frame('{"name":"A","permalink":"u","sku":"7791234567890","prices":{"price":"150050","currency_minor_unit":2},"is_in_stock":true,"attributes":[{"taxonomy":"pa_bodega","terms":[{"name":"B"}]}],"short_description":"<p>x  y</p>"}')).first()
    assert (w.brand, w.price_ars, w.in_stock, w.description) == ("B", 1500.5, True, "x y")
    t = payloads.vtex(frame('{"productName":"A","items":[{"ean":"","itemId":"9","sellers":[{"commertialOffer":{"Price":1000,"AvailableQuantity":3}}]}]}')).first()
    assert (t.external_sku, t.price_ars, t.in_stock) == ("9", None, True)
    h = payloads.shopify(frame('{"title":"A","vendor":"Shop","tags":"x, Marca: B","variants":[{"price":"900","available":true,"sku":"7791234567890"}]}', store_name="shop")).first()
    assert (h.brand, h.price_ars, h.in_stock, h.external_sku) == ("B", 900.0, True, "7791234567890")
    c = payloads.cards(spark.createDataFrame([('<li class="item"><img src="i"><a class="product-item-link" href="u?x=1"> A </a><span data-price-amount="1500">', "s")], ["html", "store_slug"]), '<li class="item"', payloads.MAGENTO).first()
    assert (c.name, c.external_url, c.price_ars, c.image_url) == ("A", "u", 1500.0, "i")
    d = payloads.discounted(frame('{"topCat":"Vinos","name":"A","price":"1000","discount":"15","stock":"2"}')).first()
    assert (d.price_ars, d.in_stock) == (850.0, True)
    assert one(spark, payloads.detect_platform(F.col("s")), s="<script src=cdn.shopify.com>") == "shopify"


def test_price_history_edges(spark):
    day = lambda k: f"2024-01-{k:02d}"
    rows = [("six", day(k), 2000.0, 2) for k in range(1, 7)] + [("drop", day(k), 10000.0 if k < 8 else 8500.0, 2) for k in range(1, 9)] + [("small", day(k), 10000.0 if k < 8 else 8600.0, 2) for k in range(1, 9)]
    h = spark.createDataFrame(rows, "slug string, d string, min double, stores long").select("slug", F.to_date("d").alias("date"), "min", "stores")
    h = h.union(spark.createDataFrame([("gin", day(k), 10000.0 if k < 8 else 5000.0, 2) for k in range(1, 9)], "slug string, d string, min double, stores long").select("slug", F.to_date("d"), "min", "stores"))
    g = spark.createDataFrame([(s, "b", "Gin seco" if s == "gin" else "Malbec", 2, 1) for s in ("six", "drop", "small", "gin")], "group_slug string, brand string, name string, store_count long, in_stock_offer_count long")
    assert [(r.slug, r.drop_pct) for r in history.price_drops(h, g).collect()] == [("drop", 0.15)]
    assert {r.slug: r.then for r in history.as_of(h).collect()}["drop"] == 10000.0
    assert history.rolling(h, 3).count() == 12


def test_price_drops_by_the_rounded_share(spark):
    day = lambda k: f"2024-01-{k:02d}"
    last = {"a little over": 2996.0, "at": 3000.0, "far over": 2990.0, "a little under": 8504.0}
    h = spark.createDataFrame([(s, day(k), 10000.0 if k < 8 else p, 2) for s, p in last.items() for k in range(1, 9)], "slug string, d string, min double, stores long").select("slug", F.to_date("d").alias("date"), "min", "stores")
    g = spark.createDataFrame([(s, "b", "Malbec", 2, 1) for s in last], "group_slug string, brand string, name string, store_count long, in_stock_offer_count long")
    assert [(r.slug, r.drop_pct) for r in history.price_drops(h, g, rounded=True).collect()] == [("a little over", 0.7), ("at", 0.7), ("a little under", 0.15)]
    assert [r.slug for r in history.price_drops(h, g).collect()] == ["at"]


def test_near_hashes_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(8)]
    rows = [(f"u{k}", f"{base[k % 8] ^ sum(1 << b for b in rng.sample(range(256), k % 13)):064x}") for k in range(40)]
    rows += [("v0", rows[0][1]), ("v1", rows[9][1])]
    first = {}
    for u, x in sorted(rows):
        first.setdefault(x, u)
    assert len(first) < len(rows)
    want = {tuple(sorted((a, b))) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if (int(x, 16) ^ int(y, 16)).bit_count() <= 10}
    d = spark.createDataFrame(rows, ["url", "hash"])
    assert {tuple(sorted((r.a, r.b))) for r in pairs.near_hashes(d).collect()} == want
    assert {tuple(r) for r in pairs.hash_members(d).collect()} == {(u, first[x], sum(first[x] in p for p in want)) for u, x in rows}


def test_resolution_edges(spark):
    keys = spark.createDataFrame([("a b", 1), ("a b c", 3), ("a b d", 2), ("c x", 1), ("c x y", 5)], "key string, n long")
    assert {(r.key, r.target) for r in resolve.subset_merge(keys).collect()} == {("c x", "c x y")}
    rows = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "slug string, ord string")
    assert sorted(r.slug for r in resolve.unique_slugs(rows).collect()) == ["s", "s-2", "t"]
    prefixes = spark.createDataFrame([("alta", "First", 1), ("alta vista", "Second", 2)], "prefix string, brand string, ord int")
    named = spark.createDataFrame([(1, "Alta Vista x", None), (2, "Altamira", "own")], "id long, name string, brand string")
    assert {r.id: r.brand for r in resolve.prefix_brand(named, prefixes).collect()} == {1: "First", 2: "own"}
    g = spark.createDataFrame([("x", "i", "B ", ["m"], None, None, ["a", "b"], 3, 9), ("y", "i", " b", ["m"], "Tinto", "pack", ["a", "b"], 5, 6), ("v", "i", "b", [], None, None, ["a", "b"], 1, 1), ("w", "i", "b", ["m"], None, "1500ml", ["a", "b"], 1, 1), ("z", "i", "c", ["m"], None, None, ["a", "b"], 1, 1)], "group_slug string, image_url string, brand string, varietals array<string>, type string, format string, tokens array<string>, store_count long, offer_count long")
    links = resolve.image_links(g)
    assert [(r.src, r.dst) for r in links.collect()] == [("x", "y")]
    assert {(r.group_slug, r.merged_into) for r in resolve.merge_groups(g, links).collect()} == {("x", "y"), ("y", "y")}


def test_search_arguments(spark):
    with pytest.raises(ValueError):
        search.order_of("nothing")
    with pytest.raises(ValueError):
        search.filters(price_min=-1)
    assert len({r.slug for r in search.WINE_RANKINGS}) == 21


def test_input_order_does_not_matter(spark):
    rows = [(k % 7, f"n{k % 3}", k) for k in range(60)]
    a = stats.mode_first_seen(spark.createDataFrame(rows, ["g", "name", "ord"]), "g", "name").collect()
    b = stats.mode_first_seen(spark.createDataFrame(rows[::-1], ["g", "name", "ord"]).repartition(5), "g", "name").collect()
    assert sorted(a) == sorted(b)


def test_sitemap_xml(spark):
    g = spark.createDataFrame([(f"a&{k:02d}", k, 1) for k in range(25)], "group_slug string, store_count long, in_stock_offer_count long")
    rows = serving.urlset(serving.sitemap(g, "https://x/", 10)).collect()
    assert {r.bucket: r.xml.count("<url>") for r in rows} == {"vinos-1": 10, "vinos-2": 10, "vinos-3": 5}
    assert "a&amp;00" in next(r.xml for r in rows if r.bucket == "vinos-1")


def test_optional_source(spark, tmp_path):
    assert payloads.read_optional(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_catalogue_columns(spark):
    key = catalogue.secondary_key(F.col("s"), ["vino"], ["casa", "alta"], ["mendoza"])
    assert one(spark, key, s="Vino Casa Alta Gran Malbec Mendoza") == "gran malbec"
    rest = catalogue.suffix_tokens(F.col("n"), F.col("l"), F.col("v"), ["vino"])
    assert one(spark, rest, n="Vino Gran Alta Malbec Roble 2019", l="Gran Alta", v=["Malbec"]) == ["roble"]
    rows = spark.createDataFrame([(1, "Alta Vista x", "BODEGA Alta"), (2, "y", "Malbec")], "id long, name string, brand string")
    mapped = catalogue.map_brand(rows, spark.createDataFrame([("alta", "Alta Vista", 1), ("Alta", "Other", 2)], "from string, to string, ord int"))
    assert {r.id: r.brand for r in catalogue.drop_bad_brands(mapped, spark.createDataFrame([("malbec",)], ["brand"])).collect()} == {1: "Alta Vista", 2: None}
    assert {r.id: r.label for r in catalogue.detect_label(rows, spark.createDataFrame([("Alta",), ("Alta Vista",)], ["label"])).collect()} == {1: "Alta Vista", 2: None}
    scores = spark.createDataFrame([("a", "X", 18.0, 20.0), ("a", "Y", 95.0, 100.0), ("_note", "Z", 1.0, 1.0)], "slug string, critic string, score double, max_score double")
    assert [tuple(r) for r in catalogue.best_scores(scores).collect()] == [("a", 95.0, 92.5, "X, Y")]
    assert one(spark, catalogue.questions(F.col("p"), F.col("s"), F.lit(None).cast("string"), F.array().cast("array<string>")), p=10.0, s=2) == ["price: 10", "stores: 2"]


def test_perceptual_hash(spark):
    rng = random.Random(1)
    image = [float(rng.randrange(256)) for _ in range(1024)]
    d = spark.createDataFrame([(image,), ([x + 9 for x in image],), ([1.0],), (None,)], "p array<double>")
    a, b, c, e = (r.h for r in d.select(catalogue.perceptual_hash("p").alias("h")).collect())
    assert len(a) == 64 and a == b and c is None and e is None


def test_accents_in_any_latin_word(spark):
    assert one(spark, text.strip_accents(F.col("s")), s="Torrontés ő ş Ñ ñ") == "Torrontes o s N n"
    assert one(spark, text.slugify(F.col("s")), s="Gyöngyös & Şile") == "gyongyos-sile"


def test_brand_names(spark):
    rows = [("Bodega Catena Zapata", "catena zapata", "Catena Zapata", "catena-zapata"), ("SALENTEIN", "salentein", "Salentein", "salentein"), ("casa de la uva ii", "casa de la uva ii", "Casa de la Uva II", "casa-de-la-uva-ii"), ("Bodegas  Ñandú", "ñandú", "Bodegas  Ñandú", "nandu"), ("&", "&", "&", None)]
    d = spark.createDataFrame([(r[0],) for r in rows], "b string")
    got = d.select("b", wine.brand_key(F.col("b")), wine.display_brand(F.col("b")), wine.brand_slug(F.col("b"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_brand_agreement(spark):
    cases = [(["catena"], True), (["catena", "catena zapata"], True), (["veuve cliquot", "veuve clicquot"], True), (["otornia", "otronia"], False), (["abcd", "abce"], False), (["norton", "trapiche"], False), (["a b", "a", "a b c"], True)]
    d = spark.createDataFrame(cases, "brands array<string>, want boolean")
    assert all(r.want == r.got for r in d.withColumn("got", resolve.brands_agree(F.col("brands"))).collect())


def test_bucket_merge_of_bad_and_wrapping_brands(spark):
    rows = [("a", "k", "Catena", None, 3), ("b", "k", "catena zapata", None, 5), ("c", "k", "Varios", None, 1), ("d", "m", "Norton", None, 1), ("e", "m", "Trapiche", None, 1)]
    g = spark.createDataFrame(rows, "group_slug string, name string, brand string, vintage int, store_count int")
    bad = spark.createDataFrame([("VARIOS",)], ["brand"])
    assert {(r.group_slug, r.merged_into) for r in resolve.bucket_merge(g, ["name"], bad).collect()} == {(x, "b") for x in "abc"}
    assert resolve.bucket_merge(g, ["name"]).count() == 0


def test_chimeras_and_product_numbers(spark):
    rows = [("g", k, ["Malbec-Reserva Especial"] if k < 4 else ["syrah"] if k < 8 else [], "7790000000001" if k in (0, 1) else "own") for k in range(10)]
    o = lambda rows: spark.createDataFrame(rows, "group_slug string, ord int, tokens array<string>, sku string")
    got = {r["ord"]: r.new_slug for r in resolve.split_chimeras(o(rows)).collect()}
    assert got[0] == "g" and got[4] == "g__syrah" and got[9] == "g__var"  # a SKU that is no product number doesn't tie clusters
    tied = [(g, k, t, "7790000000001" if k in (0, 5) else s) for g, k, t, s in rows]
    assert resolve.split_chimeras(o(tied)).count() == 0


def test_health_says_all_that_is_wrong(spark):
    before = spark.createDataFrame([("a", 100), ("b", 40), ("c", 10), ("e", 900)], "store_slug string, product_count long")
    now = spark.createDataFrame([("a", 0, 0), ("b", 20, 2), ("c", 10, 0), ("d", 0, 0), ("e", 10, 0)], "store_slug string, product_count long, errors int")
    got = {(r.issue, r.store_slug) for r in pairs.health(before, now).collect()}
    assert got == {("error:lost", "a"), ("warn:silent zero", "a"), ("warn:errors", "b"), ("warn:halved", "b"), ("warn:silent zero", "d"), ("warn:halved", "e"), ("error:total", None)}


def test_search_passes_over_what_is_no_wine(spark):
    rows = [("w", "Torrontés Dulce", "Ñandú", ["Torrontés"]), ("x", "Cerveza Torrontés", None, []), ("y", "Malbec", "Otra", ["Malbec"])]
    g = spark.createDataFrame([(*r, 5, 5.0, 9.0, "Blanco", None, 1) for r in rows], "group_slug string, name string, brand string, varietals array<string>, store_count int, min_price double, max_price double, type string, region string, in_stock_offer_count int")
    found = lambda q, **o: {r.group_slug for r in search.search(g, q, **o).collect()}
    assert found("torrontés") == found("torrontes") == found("ñandu TORRONTES") == {"w"}
    assert found("") == {"w", "y"} and found("", varietal="malbec") == {"y"}
    assert search.autocomplete(g, "t").count() == 0 and search.autocomplete(g, "to").count() == 1


def test_ranking_sections_keep_empty_lists(spark):
    ranked = spark.createDataFrame([("top-salta", 1), ("top-bonardas", 1), ("top-salta", 2)], "ranking string, position int")
    got = {r.ranking: (r.section, r["items"]) for r in search.ranking_index(ranked, search.WINE_RANKINGS).collect()}
    assert len(got) == 21 and got["top-salta"] == ("regions", 2) and got["top-bonardas"] == ("others", 1) and got["top-rutini"] == ("producers", 0)


def test_store_counts(spark):
    p = spark.createDataFrame([("a", "u"), ("a", "v")], "store_slug string, external_url string")
    e = spark.createDataFrame([("b", "timeout"), ("b", "404")], "store_slug string, message string")
    assert {tuple(r) for r in payloads.store_counts(p, e).collect()} == {("a", 2, 0), ("b", 0, 2)}


def test_staged_files_go(spark):
    from tallymark import session

    df = session.staged(spark.range(5), "test")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    session.clean()
    assert not os.path.exists(path)


def test_page_helpers(spark, tmp_path):
    assert one(spark, pages.embedding_text(F.col("n"), F.col("b"), F.array(F.lit("Malbec"), F.lit("Merlot"))), n="Gran", b="Catena") == "Gran — Catena — Malbec Merlot"
    assert str(one(spark, pages.valid_until(F.to_date("d")), d="2024-01-31")) == "2024-02-01 00:00:00"
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "slug string, price double")
    assert {tuple(r) for r in pages.payload(rows, "slug").collect()} == {("a", '{"slug":"a","price":1.5}'), ("b", '{"slug":"b","price":null}')}
    likes = spark.createDataFrame([("a",), ("z",)], ["slug"])
    assert [r.slug for r in pages.favourite_drops(likes, rows).collect()] == ["a"]
    assert [r.slug for r in pages.favourites_missing(likes, rows.withColumnRenamed("slug", "group_slug")).collect()] == ["z"]
    pages.write_report(rows, str(tmp_path / "r"), 1, [F.desc("price")], threshold=0.15)
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("slug", "threshold").collect()] == [("a", 0.15)]
    pages.write_snapshot(rows, rows, str(tmp_path / "s"))
    pages.write_snapshot(rows, rows.limit(1), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/offers")).count() == 1
    (tmp_path / "one.json").write_text('[\n {"slug": "a",\n "name": "x"}, {"slug": "b"}]')
    assert pages.read_document(spark, str(tmp_path / "one.json"), "slug string, name string").count() == 2
    with pytest.raises(ValueError):
        pages.brand_index(rows, "nothing")


def test_pack_lanes_streams_its_keys(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    rng = random.Random(9)
    rows = [(None if k % 11 == 0 else f"g{k % 7}", None if k % 29 == 0 else round(rng.random(), 3), k) for k in range(900)]

    def gathered(*_):
        raise AssertionError("a key is gathered")

    monkeypatch.setattr(GroupedData, "applyInPandas", gathered)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r.n: r.lane for r in serving.pack_lanes(spark.createDataFrame(rows, "key string, x double, n long"), "key", "x").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want, ends = {}, {}
    for key, x, n in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        own = ends.setdefault(key, [])
        lane = next((k for k, e in enumerate(own) if x is not None and e is not None and x - e >= 0.04), len(own))
        own[lane : lane + 1] = [x]
        want[n] = lane
    assert got == want


def test_same_brand_pairs_classes_not_groups(spark):
    rng = random.Random(3)
    sets = [[], ["malbec"], ["syrah"], ["malbec", "syrah"], ["syrah", "malbec"], None, ["bonarda", None]]
    rows = [(f"g{k:03d}", rng.choice(["a", "b", None]), rng.choice(sets), rng.randrange(4), rng.choice([None, 10.0, 20.0])) for k in range(300)]
    g = spark.createDataFrame(rows, "group_slug string, brand string, varietals array<string>, store_count long, min_price double")
    got = {(r.base, r["rank"]): r.group_slug for r in search.same_brand(g).collect()}
    want = {}
    for slug, brand, own, _, _ in rows:
        # Overlap is unknown where nothing is shared and one side holds a null, as in SQL.
        apart = lambda v: own is not None and v is not None and not set(own) & set(v) and not (own and v and None in own + v)
        met = [(-n, p is None, p or 0, s) for s, b, v, n, p in rows if brand is not None and b == brand and s != slug and apart(v)]
        want |= {(slug, n + 1): x[3] for n, x in enumerate(sorted(met)[:4])}
    assert got == want
    # 3,000 groups of one brand and two sets: the pairs that are joined are those of classes.
    many = spark.range(3000).select(F.col("id").alias("group_slug"), F.lit("a").alias("brand"), F.array(F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("varietals"), F.lit(1).alias("store_count"), F.lit(1.0).alias("min_price"))
    assert search.same_brand(many).count() == 12_000


def test_related_against_all_pairs_without_making_them(spark, monkeypatch):
    rng = random.Random(17)
    sets = [[], None, ["Malbec"], ["malbec", "Syrah"], ["Syrah", None], ["Bonarda", "Malbec", "Syrah"]]
    rows = [(f"g{k:03d}", rng.choice(sets), rng.choice(["Salta", "salta", "Uco", None]), rng.choice([None, 0.0, 65.0, 100.0, 145.0, 145.1, 1000.0]) if k % 3 else round(10 ** rng.uniform(1, 5), 2), rng.randrange(6), rng.randrange(3)) for k in range(260)]
    g = spark.createDataFrame(rows, "group_slug string, varietals array<string>, region string, min_price double, store_count long, in_stock_offer_count long")
    low = lambda x: x.lower() if x is not None else None
    want = {}
    for base, own, place, price, _, _ in rows:
        mine, met = {low(x) for x in own or []}, []
        for slug, theirs, region, p, n, live in rows:
            if slug != base and (p or 0) > 0 and live and (not own or (mine & {low(x) for x in theirs or []}) - {None}):
                near = price is not None and price * 0.65 <= p <= price * 1.45
                met.append((-((3 if own else 0) + 2 * (place is not None and low(place) == low(region)) + 2 * near + (n >= 3)), -n, slug))
        want |= {(base, k + 1): (x[2], -x[0]) for k, x in enumerate(sorted(met)[:6])}
    assert {(r.base, r["rank"]): (r.group_slug, r.score) for r in search.related(g, g).collect()} == want

    # Of 2,000 groups of one word, region and price no join is made that holds their pairs.
    kind, sizes, join = type(g), [], type(g).join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: sizes.append(out := join(self, *a, **b)) or out)
    many = spark.range(2000).select(F.col("id").alias("group_slug"), F.array(F.lit("a")).alias("varietals"), F.lit("r").alias("region"), F.lit(9.0).alias("min_price"), (F.col("id") % 9).alias("store_count"), F.lit(1).alias("in_stock_offer_count"))
    assert search.related(many, many).count() == 12_000
    assert max(x.count() for x in sizes) <= 10_000


@pytest.mark.parametrize("threshold", [0, 3, 10, 13, 14])
def test_near_hashes_take_a_pair_once(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(256) for _ in range(6)]
    rows = [(f"u{k:02d}", f"{base[k % 6] ^ sum(1 << b for b in rng.sample(range(256), k % 9)):064x}") for k in range(54)]
    first = {}
    for u, x in rows:
        first.setdefault(x, u)
    want = sorted((u, w, n) for (x, u), (y, w) in itertools.combinations(first.items(), 2) if 0 < (n := bin(int(x, 16) ^ int(y, 16)).count("1")) <= threshold)
    found = pairs.near_hashes(spark.createDataFrame(rows, "url string, hash string"), threshold)
    assert sorted(tuple(r) for r in found.collect()) == want
    # No pair is found at each word it shares, to be told apart afterwards.
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
