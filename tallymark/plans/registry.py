"""Every query of the engine by name, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import mathx, text, wine
from tallymark.operators import catalogue, history, pairs, resolve, search, serving, stats
from tallymark.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; `sql` sees the views as common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            tail = sql.strip()
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {v.SQL.strip()}" + (",\n" + tail[5:] if tail.startswith("WITH ") else "\n" + tail)
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT group_slug, offer_count, in_stock_offer_count, store_count, min_price, max_price FROM gstats")
def group_stats(spark, d):
    return stats.group_stats(v.offers(spark, d))


@query("""WITH c AS (SELECT *, price > 0 AND in_stock AND NOT is_collector AS k0, price > 0 AND in_stock AS k1, price > 0 AS k2 FROM offers),
b AS (SELECT group_slug, CASE WHEN bool_or(k0) THEN 0 WHEN bool_or(k1) THEN 1 WHEN bool_or(k2) THEN 2 END AS basis FROM c GROUP BY 1),
u AS (SELECT c.*, b.basis, CASE b.basis WHEN 0 THEN k0 WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE FALSE END AS used FROM c JOIN b USING (group_slug))
SELECT group_slug, any_value(basis) AS basis, min(price) FILTER (used) AS min_price, max(price) FILTER (used) AS max_price, count(DISTINCT store_slug) FILTER (used) AS store_count FROM u GROUP BY 1""")
def group_stats_fallback(spark, d):
    return stats.group_stats_fallback(v.offers(spark, d))


@query("""WITH o AS (SELECT *, name LIKE 'pack %' AS is_case, NOT (name LIKE 'pack %') AND NOT is_collector AND NOT (price > 0 AND price < 1000) AS bottle FROM offers),
a AS (SELECT group_slug, bool_or(is_case) AS has_cases, count(*) FILTER (bottle) AS bottles, min(price) FILTER (bottle AND in_stock AND price > 0) AS lo, max(price) FILTER (bottle AND in_stock AND price > 0) AS hi,
 count(DISTINCT store_slug) FILTER (bottle AND in_stock) AS s, min(price) FILTER (bottle AND price > 0) AS la, max(price) FILTER (bottle AND price > 0) AS ha, count(DISTINCT store_slug) FILTER (bottle) AS sa FROM o GROUP BY 1)
SELECT group_slug, CASE WHEN bottles = 0 THEN min_price WHEN lo IS NOT NULL THEN lo ELSE la END AS min_price, CASE WHEN bottles = 0 THEN max_price WHEN lo IS NOT NULL THEN hi ELSE ha END AS max_price,
 CASE WHEN bottles = 0 THEN store_count WHEN lo IS NOT NULL THEN s WHEN la IS NOT NULL THEN sa ELSE 0 END AS store_count, has_cases FROM a JOIN gstats USING (group_slug)""")
def bottle_stats(spark, d):
    o = v.offers(spark, d)
    return stats.bottle_stats(o, stats.group_stats(o))


@query("SELECT count(*) AS offers, count(*) FILTER (in_stock) AS in_stock, count(*) FILTER (price > 0) AS with_price, count(*) FILTER (brand IS NOT NULL) AS with_brand, count(DISTINCT store_slug) AS stores FROM offers LEFT JOIN products USING (group_slug)")
def snapshot_totals(spark, d):
    return stats.snapshot_totals(v.offers(spark, d), v.products(spark, d))


@query("SELECT in_stock AND price >= 1000 AS in_stock, count(*) AS n FROM offers GROUP BY 1")
def stock_heal(spark, d):
    return stats.heal(v.offers(spark, d)).groupBy("in_stock").agg(F.count("*").alias("n"))


@query("SELECT group_slug, count(*) AS n FROM offers WHERE store_slug IN (SELECT store_slug FROM stores WHERE platform <> 'ASIA') GROUP BY 1")
def active_store_semi(spark, d):
    return stats.active_only(v.offers(spark, d), v.stores(spark, d).where("platform <> 'ASIA'")).groupBy("group_slug").agg(F.count("*").alias("n"))


@query("SELECT type AS value, count(*) AS n FROM cat GROUP BY 1")
def facet_type(spark, d):
    return stats.facet_counts(v.groups(spark, d), "type")


@query("SELECT region AS value, count(*) AS n FROM cat WHERE region IS NOT NULL GROUP BY 1")
def facet_region(spark, d):
    return stats.facet_counts(v.groups(spark, d), "region")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(varietals) AS value FROM cat) GROUP BY 1")
def facet_varietal(spark, d):
    return stats.facet_counts(v.groups(spark, d), "varietals")


@query("SELECT brand, count(*) AS offer_count, count(DISTINCT store_slug) AS store_count FROM offers JOIN products USING (group_slug) GROUP BY 1 ORDER BY store_count DESC, offer_count DESC, brand LIMIT 12")
def top_brands(spark, d):
    return stats.top_brands(v.products(spark, d), v.offers(spark, d))


@query("""WITH s AS (SELECT brand, count(DISTINCT store_slug) AS store_count FROM offers JOIN cat USING (group_slug) GROUP BY 1)
SELECT replace(lower(brand), '#', '-') AS slug, brand AS name, count(*) AS group_count, sum(offer_count)::BIGINT AS offer_count, count(DISTINCT region) AS regions, any_value(s.store_count) AS store_count
FROM cat JOIN s USING (brand) GROUP BY brand HAVING count(*) >= 3""")
def brand_pages(spark, d):
    return stats.brand_pages(v.groups(spark, d), v.offers(spark, d))


@query("""WITH r AS (SELECT type AS page, group_slug, store_count, min_price, row_number() OVER (PARTITION BY type ORDER BY store_count DESC, min_price ASC NULLS LAST, group_slug)::INTEGER AS rank FROM cat)
SELECT * FROM r WHERE rank <= 48""")
def facet_pages(spark, d):
    return stats.page_items(v.groups(spark, d), "type", 48)


def _market_sql(column: str) -> str:
    return f"""SELECT {column} AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM cat WHERE min_price > 0), 4) AS share, round(median(min_price)) AS median_price FROM cat WHERE min_price > 0 AND {column} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"""


@query(_market_sql("type"))
def market_types(spark, d):
    return stats.market_distribution(v.groups(spark, d), "type", 3)


@query(_market_sql("region"))
def market_regions(spark, d):
    return stats.market_distribution(v.groups(spark, d), "region", 3)


@query(_market_sql("varietals[1]").replace("varietals[1] AS value", "varietals[1] AS value"))
def market_varietals(spark, d):
    return stats.market_distribution(v.groups(spark, d).withColumn("first", F.get("varietals", F.lit(0))), "first", 3)


BANDS = [0, 1000, 2000, 5000, 10000, 200000]


@query("""WITH b AS (SELECT unnest([0,1,2,3,4,5])::INTEGER AS band, unnest([0,1000,2000,5000,10000,200000])::DOUBLE AS low, unnest([1000,2000,5000,10000,200000,NULL])::DOUBLE AS high)
SELECT band, low, high, count(group_slug) AS n FROM b LEFT JOIN cat ON min_price > 0 AND min_price >= low AND (high IS NULL OR min_price < high) GROUP BY 1, 2, 3""")
def price_bands(spark, d):
    return stats.price_bands(v.groups(spark, d), BANDS)


@query("""WITH c AS (SELECT group_slug, flag, count(*) AS n, min(ord) AS first FROM offers GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY group_slug ORDER BY n DESC, first, flag) AS k FROM c)
SELECT group_slug, flag, n, k::INTEGER AS rank FROM r WHERE k = 1""")
def mode_flag(spark, d):
    return stats.mode_first_seen(v.offers(spark, d), "group_slug", "flag")


@query("SELECT group_slug, arg_min(store_slug, ord) FILTER (in_stock) AS store_slug, arg_min(flag, ord) AS flag FROM offers GROUP BY 1")
def first_non_null(spark, d):
    o = v.offers(spark, d).withColumn("store_slug", F.when(F.col("in_stock"), F.col("store_slug")))
    return stats.first_present(o, "group_slug", ["store_slug", "flag"])


@query("SELECT group_slug, arg_min(name, (length(name), ord)) AS name FROM offers GROUP BY 1")
def shortest_name(spark, d):
    return stats.shortest(v.offers(spark, d), "group_slug", "name")


@query("SELECT token, min(brand) AS brand, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(name || ' s' || size::VARCHAR || brand[7:], ' '))) AS token, brand FROM products) GROUP BY 1 HAVING count(DISTINCT brand) = 1 AND count(*) >= 3")
def token_distinctive(spark, d):
    p = v.products(spark, d)
    words = F.array_distinct(F.split(F.concat("name", F.lit(" s"), F.col("size").cast("string"), F.expr("substring(brand, 7)")), " "))
    return stats.distinctive_tokens(p.withColumn("tokens", words), "tokens", "brand")


@query("""WITH o AS (SELECT group_slug, [flag, (vintage % 4)::VARCHAR] AS t FROM offers), n AS (SELECT group_slug, count(*) AS size FROM o GROUP BY 1), h AS (SELECT group_slug, token, count(*) AS n FROM (SELECT group_slug, unnest(t) AS token FROM o) GROUP BY 1, 2)
SELECT group_slug, token, n, size FROM h JOIN n USING (group_slug) WHERE n >= greatest(3, ceil(0.1::DOUBLE * size)) AND n <= floor(0.75::DOUBLE * size)""")
def splitter_tokens(spark, d):
    o = v.offers(spark, d).withColumn("tokens", F.array("flag", (F.col("vintage") % 4).cast("string")))
    return stats.splitter_tokens(o, "group_slug", "tokens")


@query("SELECT path, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM views GROUP BY 1")
def views_by_path(spark, d):
    return serving.traffic(v.views(spark, d), "path")


@query("SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM views GROUP BY 1")
def views_by_day(spark, d):
    return serving.traffic(v.views(spark, d), "day")


@query("SELECT host AS ref, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM views GROUP BY 1")
def views_by_ref(spark, d):
    return serving.traffic(v.views(spark, d), "ref")


@query("""WITH c AS (SELECT store_slug, count(*) AS product_count FROM offers GROUP BY 1)
SELECT platform, count(*) AS stores, sum(coalesce(product_count, 0))::BIGINT AS products FROM stores LEFT JOIN c USING (store_slug) GROUP BY 1""")
def platform_breakdown(spark, d):
    counts = v.offers(spark, d).groupBy("store_slug").agg(F.count("*").alias("product_count"))
    return serving.platform_breakdown(v.stores(spark, d), counts, "platform")


@query("""WITH r AS (SELECT brand, min_price, row_number() OVER (PARTITION BY brand ORDER BY store_count DESC, min_price NULLS LAST, group_slug) AS k FROM cat)
SELECT brand, round(avg(min_price), 2) AS avg_price FROM r WHERE k <= 24 GROUP BY 1""")
def avg_brand_price(spark, d):
    return stats.page_items(v.groups(spark, d), "brand", 24).groupBy(F.col("page").alias("brand")).agg(F.round(F.avg("min_price"), 2).alias("avg_price"))


@query("SELECT n AS size, count(*) AS groups FROM (SELECT key, count(*) AS n FROM listings GROUP BY 1) GROUP BY 1")
def cluster_sizes(spark, d):
    return v.listings(spark, d).groupBy("key").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query("SELECT group_slug, array_to_string(list_sort(list_distinct(list(vintage)), 'DESC'), ',') AS vintages FROM offers GROUP BY 1")
def group_vintages(spark, d):
    return v.offers(spark, d).groupBy("group_slug").agg(F.array_join(F.sort_array(F.collect_set("vintage"), False).cast("array<string>"), ",").alias("vintages"))


# -- search and rankings -----------------------------------------------------------------------------------------------

_SEARCH = "group_slug, store_count, min_price"


#: What search takes for a wine, in SQL; names here need no look-ahead.
_NOT_WINE = wine.NOT_WINE.replace(r"(?!\s+(de\s+)?(la|los|las))", "")
_WINE = f"NOT (regexp_matches(name, '(?i){_NOT_WINE}') OR regexp_matches(name, '(?i){wine.NOT_WINE_SIZE}'))"


@query(f"SELECT {_SEARCH} FROM cat WHERE {_WINE} AND store_count >= 2 AND lower(type) = 'promo' AND min_price BETWEEN 1000 AND 3000 AND contains(lower(brand || ' ' || name), 'red') ORDER BY min_price, store_count DESC, group_slug LIMIT 48")
def search_filters(spark, d):
    return search.search(v.groups(spark, d), "red", "price-asc", multi=True, in_stock=True, type="Promo", price_min=1000, price_max=3000).select("group_slug", "store_count", "min_price")


@query("""WITH s AS (SELECT group_slug, (CASE WHEN starts_with(lower(name), 'red w') THEN 300 WHEN starts_with(lower(brand || ' ' || name), 'red w') THEN 240 WHEN contains(lower(name), 'red w') THEN 180 WHEN contains(lower(brand || ' ' || name), 'red w') THEN 130 ELSE 0 END
 + CASE WHEN starts_with(lower(brand), 'red w') THEN 120 WHEN contains(lower(brand), 'red w') THEN 60 ELSE 0 END
 + CASE WHEN regexp_matches(lower(brand || ' ' || name), '\\bred\\b') THEN 30 ELSE 8 END + CASE WHEN regexp_matches(lower(brand || ' ' || name), '\\bw\\b') THEN 30 ELSE 8 END
 + least(store_count, 25) * 5 - greatest(length(name) - 30, 0) * 0.6::DOUBLE + CASE WHEN min_price > 0 THEN 10 ELSE 0 END)::DOUBLE AS score, min_price FROM cat WHERE contains(lower(brand || ' ' || name), 'red') AND contains(lower(brand || ' ' || name), 'w'))
SELECT group_slug, round(score, 4) AS score FROM s ORDER BY score DESC, min_price NULLS LAST, group_slug LIMIT 48""".replace("\\\\b", "\\b"))
def search_relevance(spark, d):
    return search.search(v.groups(spark, d), "red w").select("group_slug", F.round(search.relevance("red w"), 4).alias("score"))


def _sorted_sql(order: str) -> str:
    return f"SELECT {_SEARCH} FROM cat WHERE {_WINE} ORDER BY {order} LIMIT 100"


@query(_sorted_sql("CASE WHEN min_price > 0 THEN min_price END DESC NULLS LAST, store_count DESC, group_slug"))
def sort_price_desc(spark, d):
    return search.search(v.groups(spark, d), sort="price-desc", limit=100).select("group_slug", "store_count", "min_price")


@query(_sorted_sql("store_count DESC, CASE WHEN min_price > 0 THEN min_price END NULLS LAST, group_slug"))
def sort_stores_desc(spark, d):
    return search.search(v.groups(spark, d), sort="stores-desc", limit=100).select("group_slug", "store_count", "min_price")


@query(_sorted_sql("name, group_slug"))
def sort_name(spark, d):
    return search.search(v.groups(spark, d), sort="name-asc", limit=100).select("group_slug", "store_count", "min_price")


#: The same shapes as the wine rankings, over the driver's values.
RANKINGS = [
    search.Ranking("cheap-red", {"varietal": "red"}, "price"), search.Ranking("fine-red", {"varietal": "red", "low": 2000}), search.Ranking("under-1500", {"high": 1500}, "price", 30),
    search.Ranking("under-2000", {"high": 2000}, "price", 30), search.Ranking("promo", {"type": "Promo"}), search.Ranking("blends", {"blend": "(?i)ring"}), search.Ranking("roast", {"type": "Large", "low": 1000, "high": 2000}),
    search.Ranking("gifts", {"low": 1500, "high": 3000}), search.Ranking("named", {"name": "(?i)bolt|widget"}), search.Ranking("brand-1", {"brands": ["Brand#1", "Brand#2"]}), search.Ranking("asia", {"region": "ASIA"}), search.Ranking("europe", {"region": "EUROPE"}, multi=False),
]


def _rankings_sql() -> str:
    parts = []
    for r in RANKINGS:
        w, c = r.where, ["length(brand) >= 2", "min_price > 0", "store_count >= 1"]
        c += ["store_count >= 2"] * r.multi
        c += [f"list_contains(varietals, '{w['varietal']}')"] if "varietal" in w else []
        c += [f"{k} = '{w[k]}'" for k in ("type", "region") if k in w]
        c += [f"brand IN ({', '.join(repr(b) for b in w['brands'])})"] if "brands" in w else []
        c += [f"regexp_matches(name, '{w['name']}')"] if "name" in w else []
        c += [f"(len(varietals) >= 2 OR regexp_matches(name, '{w['blend']}'))"] if "blend" in w else []
        c += [f"min_price >= {w['low']}"] if "low" in w else []
        c += [f"min_price <= {w['high']}"] if "high" in w else []
        order = "min_price, group_slug" if r.order == "price" else "store_count DESC, min_price, group_slug"
        parts.append(f"(SELECT '{r.slug}' AS ranking, row_number() OVER (ORDER BY {order})::INTEGER AS position, group_slug, min_price, store_count FROM cat WHERE {' AND '.join(c)} ORDER BY position LIMIT {r.limit})")
    return "\nUNION ALL ".join(parts)


@query(_rankings_sql())
def rankings_all(spark, d):
    return search.rankings(v.groups(spark, d), RANKINGS)


@query("WITH r AS (" + _rankings_sql() + ") SELECT ranking, count(*) AS items FROM r GROUP BY 1")
def ranking_index(spark, d):
    return search.rankings(v.groups(spark, d), RANKINGS).groupBy("ranking").agg(F.count("*").alias("items"))


@query("""WITH s AS (SELECT group_slug, store_count, (max_price - 60000 - min_price) / (max_price - 60000) AS savings FROM cat WHERE store_count >= 3 AND min_price >= 2000 AND max_price - 60000 > min_price AND group_slug % 5 > 0)
SELECT group_slug, store_count, round(savings, 4) AS savings FROM s WHERE savings BETWEEN 0.25::DOUBLE AND 0.7::DOUBLE ORDER BY floor(savings * 100) DESC, store_count DESC, s.savings DESC, group_slug LIMIT 24""")
def top_deals(spark, d):
    image = F.when(F.col("group_slug") % 5 == 1, "/a.png").when(F.col("group_slug") % 5 > 1, "/b.png").when(F.col("group_slug") % 10 == 0, "")
    g = v.groups(spark, d).withColumn("max_price", F.col("max_price") - 60000).withColumn("image_url", image)
    return search.top_deals(g, 24).select("group_slug", "store_count", F.round("savings", 4).alias("savings"))


@query("""WITH b AS (SELECT group_slug AS base, varietals AS bv, region AS br, min_price AS bp FROM cat),
s AS (SELECT base, group_slug, store_count, 3 + CASE WHEN lower(br) = lower(region) THEN 2 ELSE 0 END + CASE WHEN min_price >= bp * 0.65::DOUBLE AND min_price <= bp * 1.45::DOUBLE THEN 2 ELSE 0 END + CASE WHEN store_count >= 3 THEN 1 ELSE 0 END AS score
 FROM b JOIN cat ON list_has_any(bv, varietals) AND base <> group_slug AND min_price > 0 AND in_stock_offer_count > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, store_count DESC, group_slug)::INTEGER AS rank FROM s)
SELECT base, rank, group_slug, score::INTEGER AS score FROM r WHERE rank <= 6""")
def related_groups(spark, d):
    g = v.groups(spark, d)
    return search.related(g, g)


@query("""WITH r AS (SELECT b.group_slug AS base, c.group_slug AS group_slug, row_number() OVER (PARTITION BY b.group_slug ORDER BY c.store_count DESC, c.min_price NULLS LAST, c.group_slug)::INTEGER AS rank
 FROM cat b JOIN cat c ON b.brand = c.brand AND b.group_slug <> c.group_slug AND NOT list_has_any(b.varietals, c.varietals))
SELECT base, rank, group_slug FROM r WHERE rank <= 4""")
def same_brand_fill(spark, d):
    return search.same_brand(v.groups(spark, d))


# -- serving ---------------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_slug ORDER BY price, ord) AS k FROM offers WHERE in_stock AND NOT is_collector AND price > 0)
SELECT group_slug, store_slug, price, coalesce(store_name, store_slug::VARCHAR) AS store_name FROM r LEFT JOIN stores USING (store_slug) WHERE k = 1""")
def best_offer(spark, d):
    return serving.best_offer(v.offers(spark, d), v.stores(spark, d))


@query("""WITH l AS (SELECT min(event_id) AS pos, (event_id * 7) % 3000 AS slug FROM events GROUP BY 2), t AS (SELECT * FROM l ORDER BY pos LIMIT 200)
SELECT pos, group_slug, name, min_price FROM t JOIN cat ON slug = group_slug""")
def list_order_join(spark, d):
    e = v.read(spark, d, "events").groupBy(((F.col("event_id") * 7) % 3000).alias("slug")).agg(F.min("event_id").alias("pos"))
    return serving.in_list_order(v.groups(spark, d), e)


@query("""WITH l AS (SELECT "user", path AS slug, max(ts) AS ts FROM views GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, slug)::INTEGER AS pos FROM l) SELECT * FROM r WHERE pos <= 3""")
def recently_viewed(spark, d):
    return serving.last_seen(v.views(spark, d).select("user", F.col("path").alias("slug"), "ts"), 3)


@query("""SELECT 'https://example.com/vino/' || group_slug::VARCHAR AS loc, 'vinos-' || ((floor((row_number() OVER (ORDER BY group_slug) - 1) / 500) + 1)::BIGINT)::VARCHAR AS bucket,
 CASE WHEN in_stock_offer_count = 0 THEN 0.2 WHEN store_count >= 10 THEN 0.9 WHEN store_count >= 5 THEN 0.8 WHEN store_count >= 3 THEN 0.7 WHEN store_count >= 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS priority FROM cat""")
def sitemap_chunks(spark, d):
    return serving.sitemap(v.groups(spark, d), "https://example.com/vino/", 500)


@query("""WITH p AS (SELECT group_slug AS slug_a, group_slug + 1 AS slug_b FROM cat)
SELECT slug_a, slug_b, CASE WHEN a.min_price < b.min_price THEN 'a' WHEN b.min_price < a.min_price THEN 'b' ELSE 'tie' END AS cheaper, CASE WHEN b.store_count < a.store_count THEN 'a' WHEN a.store_count < b.store_count THEN 'b' ELSE 'tie' END AS wider
FROM p JOIN cat a ON slug_a = a.group_slug JOIN cat b ON slug_b = b.group_slug""")
def compare_pairs(spark, d):
    g = v.groups(spark, d)
    return serving.compare(g.select(F.col("group_slug").alias("slug_a"), (F.col("group_slug") + 1).alias("slug_b")), g)


@query("""WITH r AS (SELECT min(min_price) AS lo, max(min_price) AS hi FROM cat)
SELECT group_slug, round((ln(min_price) - ln(lo)) / (ln(hi) - ln(lo)), 6) AS x, round(sqrt(store_count), 6) AS radius FROM cat, r WHERE min_price > 0""")
def compass_points(spark, d):
    g = v.groups(spark, d).where("min_price > 0")
    lohi = g.agg(F.min("min_price").alias("lo"), F.max("min_price").alias("hi"))  # one row
    return g.crossJoin(F.broadcast(lohi)).select("group_slug", F.round(mathx.log_position(F.col("min_price"), F.col("lo"), F.col("hi")), 6).alias("x"), F.round(F.sqrt("store_count"), 6).alias("radius"))


@query("""WITH q AS (SELECT group_slug, (size - 25) * (size - 25) + (store_count - 20) * (store_count - 20) AS d2 FROM cat) SELECT group_slug, d2::BIGINT AS d2 FROM q WHERE d2 <= 80 * 80 ORDER BY d2, group_slug LIMIT 3""")
def nearest3(spark, d):
    d2 = ((F.col("size") - 25) * (F.col("size") - 25) + (F.col("store_count") - 20) * (F.col("store_count") - 20)).cast("long")
    return v.groups(spark, d).select("group_slug", d2.alias("d2")).where("d2 <= 6400").orderBy("d2", "group_slug").limit(3)


# -- history ---------------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC) AS rn FROM hist),
m AS (SELECT slug, count(*) AS n, max(min) FILTER (rn = 1) AS current_price, max(date) AS last_date, median(min) FILTER (rn > 1) AS median_price FROM r WHERE rn <= 8 GROUP BY 1),
f AS (SELECT *, round((median_price - current_price) / median_price, 3) AS drop_pct FROM m WHERE n >= 7 AND median_price > 0)
SELECT slug, brand, current_price, median_price, drop_pct, store_count, last_date FROM f JOIN cat ON slug = group_slug WHERE drop_pct BETWEEN 0.15::DOUBLE AND 0.7::DOUBLE AND current_price >= 1500 AND store_count >= 2 AND in_stock_offer_count > 0 ORDER BY drop_pct DESC, slug LIMIT 50""")
def price_drops(spark, d):
    return history.price_drops(v.history(spark, d), v.groups(spark, d), rounded=True)


@query("SELECT slug, date, min, stores FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC) AS rn FROM hist) WHERE rn <= 10")
def track_prices_rolling(spark, d):
    return history.rolling(v.history(spark, d), 10)


@query("""WITH t AS (SELECT slug, date, CASE WHEN min > 2000 THEN min / 2 ELSE min END AS min, CASE WHEN min > 2000 THEN 1 ELSE stores END AS stores, max(date) OVER (PARTITION BY slug) AS last, max(date) OVER () AS newest FROM hist),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC) AS rn FROM t) SELECT slug, date, min, stores FROM r WHERE rn <= 30 AND last >= newest - 31""")
def price_upsert(spark, d):
    h = v.history(spark, d)
    return history.upsert_today(h, h.where("min > 2000").select("slug", "date", (F.col("min") / 2).alias("min"), F.lit(1).cast("long").alias("stores")))


@query("""WITH l AS (SELECT *, max(date) OVER (PARTITION BY slug) AS last FROM hist),
a AS (SELECT slug, count(*) AS n, arg_max(min, date) AS now, coalesce(arg_max(min, date) FILTER (date <= last - 7), arg_min(min, date)) AS "then" FROM l GROUP BY 1)
SELECT slug, now, "then", round((now - "then") / "then" * 100, 4) AS change_pct FROM a WHERE n >= 2 AND "then" > 0""")
def asof_delta(spark, d):
    return history.as_of(v.history(spark, d))


@query("SELECT slug, count(*) AS n FROM hist WHERE slug IN (SELECT group_slug FROM cat WHERE type = 'Promo') GROUP BY 1")
def orphan_prune(spark, d):
    return history.prune(v.history(spark, d), v.groups(spark, d).where("type = 'Promo'")).groupBy("slug").agg(F.count("*").alias("n"))


# -- pairs and diagnostics ---------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT varietals[1] AS varietal, group_slug, brand, min_price, store_count, row_number() OVER (PARTITION BY varietals[1] ORDER BY store_count DESC, group_slug) AS k FROM cat WHERE store_count >= 3 AND min_price > 0), t AS (SELECT * FROM g WHERE k <= 25)
SELECT a.group_slug AS slug_a, b.group_slug AS slug_b, a.varietal, a.store_count + b.store_count AS total_store_count FROM t a JOIN t b ON a.varietal = b.varietal AND a.group_slug < b.group_slug AND a.brand <> b.brand
WHERE greatest(a.min_price, b.min_price) <= 3 * least(a.min_price, b.min_price) ORDER BY total_store_count DESC, slug_a, slug_b LIMIT 400""")
def vs_pairs(spark, d):
    return pairs.versus_pairs(v.groups(spark, d))


@query("""WITH w AS (SELECT doc_id, lang, list_distinct(string_split(text, ' ')) AS t, string_split(text, ' ')[1] AS block FROM documents),
n AS (SELECT block FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), x AS (SELECT * FROM w WHERE block IN (SELECT block FROM n)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS s FROM x a JOIN x b ON a.block = b.block AND a.doc_id < b.doc_id AND a.lang IS NOT DISTINCT FROM b.lang)
SELECT a, b, round(i / (s - i), 6) AS similarity FROM p WHERE i / (s - i) >= 0.75::DOUBLE""")
def dup_jaccard(spark, d):
    # Blocks of the first word that hold 2 to 60 rows are what this report looks into.
    docs = v.read(spark, d, "documents").select("doc_id", "lang", F.array_distinct(F.split("text", " ")).alias("tokens"))
    return _rounded(pairs.similar_names(docs, "doc_id", "tokens", ["lang"]), "similarity", digits=6)


@query("""WITH t AS (SELECT id, CASE WHEN id % 6 = 5 THEN NULL ELSE brand END AS brand, size, CASE WHEN id % 4 = 0 THEN 2000 + id % 2 ELSE 1999 END AS vintage, CASE WHEN id % 9 = 0 THEN 'x6' END AS format, list_sort(list_distinct([x FOR x IN string_split(key, ' ') IF length(x) > 1])) || ['n' || size::VARCHAR, 'r' || (id % 7)::VARCHAR] AS w FROM listings),
u AS (SELECT * REPLACE (list_sort(list_distinct(w)) AS w) FROM t),
p AS (SELECT id, brand, size, vintage, coalesce(format, '-') AS format, x.word AS x, y.word AS y FROM u, unnest(w) AS x(word), unnest(w) AS y(word) WHERE x.word < y.word),
q AS (SELECT x || ' ' || y AS pair, list_sort(list(id)) AS members, sum(size)::BIGINT AS weight FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6 AND count(DISTINCT vintage) = 1 AND count(DISTINCT format) = 1),
c AS (SELECT DISTINCT a.x || ' ' || a.y AS pair FROM p a JOIN p b ON a.x = b.x AND a.y = b.y AND NOT contains(lower(a.brand), lower(b.brand)) AND NOT contains(lower(b.brand), lower(a.brand)))
SELECT array_to_string(members, ',') AS members, min(pair) AS pair, max(weight) AS weight FROM q WHERE pair IN (SELECT pair FROM c) GROUP BY members ORDER BY weight DESC, min(pair) LIMIT 80""")
def dup_token_pairs(spark, d):
    rows = v.listings(spark, d).withColumns({"brand": F.when(F.col("id") % 6 != 5, F.col("brand")), "vintage": F.when(F.col("id") % 4 == 0, 2000 + F.col("id") % 2).otherwise(1999), "format": F.when(F.col("id") % 9 == 0, "x6")})
    words = F.array_distinct(F.concat(F.split("key", " "), F.array(F.concat(F.lit("n"), F.col("size").cast("string")), F.concat(F.lit("r"), (F.col("id") % 7).cast("string")))))
    out = pairs.token_pair_clusters(rows.withColumn("words", F.filter(words, lambda w: F.length(w) > 1)), "id", "words", "size")
    return out.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "pair", "weight")


@query("SELECT sku AS image, count(DISTINCT id) AS n, count(DISTINCT brand) AS brands, min(id) AS first FROM listings WHERE sku IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def image_clusters(spark, d):
    return pairs.shared_values(v.listings(spark, d).withColumnRenamed("sku", "image"), "image", "id")


@query("""WITH c AS (SELECT store_slug, vintage, count(*) AS n FROM offers GROUP BY 1, 2), s AS (SELECT store_slug FROM stores),
b AS (SELECT s.store_slug, coalesce(p.n, 0) AS before, CASE WHEN s.store_slug % 10 = 0 THEN 0 WHEN s.store_slug % 10 = 1 THEN coalesce(p.n, 0) // 2 ELSE coalesce(c.n, 0) END AS now, s.store_slug % 20 AS e FROM s LEFT JOIN c p ON p.store_slug = s.store_slug AND p.vintage = 1996 LEFT JOIN c ON c.store_slug = s.store_slug AND c.vintage = 1997),
i AS (SELECT unnest([CASE WHEN before >= 50 AND now = 0 THEN 'error:lost' END, CASE WHEN before >= 30 AND now > 0 AND now <= 0.5::DOUBLE * before THEN 'warn:halved' END, CASE WHEN now = 0 AND e <> 0 THEN 'warn:silent zero' END, CASE WHEN e = 0 THEN 'warn:errors' END]) AS issue, store_slug, before, now FROM b),
t AS (SELECT sum(before)::BIGINT AS before, sum(now)::BIGINT AS now FROM b)
SELECT issue, store_slug, before, now FROM i WHERE issue IS NOT NULL UNION ALL SELECT 'error:total', NULL, before, now FROM t WHERE before >= 1000 AND now <= 0.8::DOUBLE * before""")
def healthcheck(spark, d):
    counts = v.offers(spark, d).groupBy("store_slug", "vintage").agg(F.count("*").alias("n"))
    base = v.stores(spark, d).select("store_slug")
    at = lambda year: base.join(counts.where(F.col("vintage") == year).select("store_slug", "n"), "store_slug", "left").select("store_slug", F.coalesce("n", F.lit(0)).alias("product_count"))
    before = at(1996)
    now = at(1997).join(before.withColumnRenamed("product_count", "b"), "store_slug")
    now = now.select("store_slug", F.when(F.col("store_slug") % 10 == 0, 0).when(F.col("store_slug") % 10 == 1, F.floor(F.col("b") / 2)).otherwise(F.col("product_count")).cast("long").alias("product_count"), F.when(F.col("store_slug") % 20 == 0, 1).otherwise(0).alias("errors"))
    return pairs.health(before, now)


@query("""WITH a AS (SELECT doc_id AS key, CASE WHEN quality = 1 OR doc_id % 20 = 0 THEN 'good' ELSE 'bad' END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'alta' ELSE 'baja' END AS confidence, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth FROM labels)
SELECT key, answer, round((SELECT avg(CASE WHEN answer = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM a), 6) AS accuracy FROM a WHERE confidence = 'alta' AND (SELECT avg(CASE WHEN answer = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM a) >= 0.9""")
def golden_gate(spark, d):
    rows = v.read(spark, d, "labels").select(F.col("doc_id").alias("key"), F.when((F.col("quality") == 1) | (F.col("doc_id") % 20 == 0), "good").otherwise("bad").alias("answer"), F.when(F.col("doc_id") % 3 == 0, "alta").otherwise("baja").alias("confidence"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"))
    return _rounded(pairs.golden_gate(rows.drop("truth"), rows.select("key", "truth"), ["good", "bad"]), "accuracy", digits=6)


# -- resolution ----------------------------------------------------------------------------------------------------------------


@query("SELECT key, count(*) AS n, min(id) AS first FROM listings WHERE key <> '' GROUP BY 1")
def key_groups(spark, d):
    return v.listings(spark, d).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""WITH k AS (SELECT DISTINCT key, sku FROM listings WHERE key <> '' AND regexp_full_match(sku, '[0-9]{12,14}')),
e AS (SELECT DISTINCT a.key AS x, b.key AS y FROM k a JOIN k b USING (sku)),
r AS (SELECT DISTINCT key AS node, key AS reach FROM listings WHERE key <> '' UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT node AS key, min(reach) AS component FROM r GROUP BY 1), n AS (SELECT key, count(*) AS n FROM listings WHERE key <> '' GROUP BY 1),
l AS (SELECT component, arg_min(key, (-n, key)) AS merged FROM c JOIN n USING (key) GROUP BY 1)
SELECT key, merged, n FROM c JOIN n USING (key) JOIN l USING (component)""")
def ean_components(spark, d):
    return resolve.ean_components(v.listings(spark, d))


_SHORT = "CASE WHEN id % 2 = 0 THEN key ELSE array_to_string(list_sort(string_split(name, ' ')), ' ') END"


@query(f"""WITH k AS (SELECT k AS key, count(*) AS n FROM (SELECT {_SHORT} AS k FROM listings) GROUP BY 1), s AS (SELECT key, list_distinct(string_split(key, ' ')) AS t FROM k WHERE n = 1), l AS (SELECT key AS target, string_split(key, ' ') AS u FROM k WHERE n > 1),
m AS (SELECT key, target FROM s JOIN l ON len(t) >= 2 AND list_has_all(u, t))
SELECT key, min(target) AS target FROM m GROUP BY 1 HAVING count(*) = 1""")
def subset_merge(spark, d):
    short = F.when(F.col("id") % 2 == 0, F.col("key")).otherwise(F.array_join(F.array_sort(F.split("name", " ")), " "))
    return resolve.subset_merge(v.listings(spark, d).groupBy(short.alias("key")).agg(F.count("*").alias("n")))


@query("SELECT id, CASE WHEN k > 1 THEN slug || '-' || k::VARCHAR ELSE slug END AS slug FROM (SELECT id, replace(name, ' ', '-') AS slug, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM listings)")
def slug_suffix(spark, d):
    rows = v.listings(spark, d).select("id", text.group_slug(F.col("name")).alias("slug"))
    return resolve.unique_slugs(rows, order="id")


_SIM = """WITH n AS (SELECT vec_id, label, [x::DOUBLE / sqrt(list_dot_product([y::DOUBLE FOR y IN embedding], [y::DOUBLE FOR y IN embedding])) FOR x IN embedding] AS u FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS sim FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query(_SIM + " SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.25::DOUBLE")
def cosine_pairs(spark, d):
    return _rounded(resolve.vector_pairs(v.read(spark, d, "embeddings"), "label", 0.25), "sim", digits=6)


@query(_SIM + ", g AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM p WHERE sim >= 0.25::DOUBLE AND sim < 0.35::DOUBLE) SELECT a, b, round(sim, 6) AS sim FROM g WHERE k <= 3")
def cosine_gray(spark, d):
    return _rounded(resolve.vector_merge(v.read(spark, d, "embeddings"), "label", 0.35, 0.25)[1], "sim", digits=6)


@query(_SIM + """, l AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM p WHERE sim >= 0.3::DOUBLE) WHERE k <= 5), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def cosine_components(spark, d):
    from tallymark.operators.graph import connected_components

    return connected_components(resolve.vector_merge(v.read(spark, d, "embeddings"), "label", 0.3, 0.2)[0])


@query("""WITH g AS (SELECT name, brand, size % 4 AS s, group_slug, store_count, CASE WHEN size % 3 = 0 THEN 2000 + size % 2 END AS vintage FROM cat),
b AS (SELECT name, brand, s, count(*) AS n, count(DISTINCT vintage) AS vs, arg_min(group_slug, (-store_count, group_slug)) AS merged_into FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(DISTINCT vintage) <= 1)
SELECT group_slug, merged_into FROM g JOIN b USING (name, brand, s)""")
def bucket_merge(spark, d):
    g = v.groups(spark, d).withColumn("s", F.col("size") % 4).withColumn("vintage", F.when(F.col("size") % 3 == 0, 2000 + F.col("size") % 2))
    return resolve.bucket_merge(g, ["name", "brand", "s"])


@query("""WITH o AS (SELECT group_slug, ord, lower(flag) AS token FROM offers), n AS (SELECT group_slug, count(*) AS size FROM o GROUP BY 1 HAVING count(*) >= 8),
t AS (SELECT group_slug, token, count(*) AS n FROM o GROUP BY 1, 2), s AS (SELECT group_slug, token, n FROM t JOIN n USING (group_slug) WHERE t.n >= greatest(3, ceil(0.1::DOUBLE * size)) AND t.n <= floor(0.75::DOUBLE * size)),
g AS (SELECT group_slug FROM s GROUP BY 1 HAVING count(*) >= 2), m AS (SELECT o.group_slug, ord, coalesce(s.token, 'var') AS cluster FROM o JOIN g USING (group_slug) LEFT JOIN s ON s.group_slug = o.group_slug AND s.token = o.token),
z AS (SELECT group_slug, cluster, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT group_slug FROM z WHERE n >= 3 GROUP BY 1 HAVING count(*) >= 2), l AS (SELECT group_slug, arg_min(cluster, (-n, cluster)) AS lead FROM z GROUP BY 1)
SELECT CASE WHEN cluster = lead THEN group_slug::VARCHAR ELSE group_slug::VARCHAR || '__' || cluster END AS new_slug, count(*) AS n FROM m JOIN k USING (group_slug) JOIN l USING (group_slug) GROUP BY 1""")
def chimera_split(spark, d):
    o = v.offers(spark, d).withColumn("tokens", F.array(F.lower("flag"))).withColumn("sku", F.lit(None).cast("string"))
    return resolve.split_chimeras(o).groupBy("new_slug").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT id, name, brand FROM listings WHERE size <= 30), b AS (SELECT id, name, 'x' AS brand FROM listings WHERE size >= 20) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def union_first_wins(spark, d):
    rows = v.listings(spark, d).select("id", "name", "brand", "size")
    return stats.union_first_wins([rows.where("size <= 30").drop("size"), rows.where("size >= 20").drop("size").withColumn("brand", F.lit("x"))], "id")


@query("""WITH r AS (SELECT group_slug, store_slug, price, ord, first_value(price) OVER (PARTITION BY group_slug, store_slug ORDER BY ord) AS fp FROM offers), k AS (SELECT *, row_number() OVER (PARTITION BY group_slug, store_slug ORDER BY CASE WHEN fp IS NOT NULL THEN price END NULLS LAST, ord) AS k FROM r)
SELECT group_slug, store_slug, price FROM k WHERE k = 1""")
def cheapest_wins(spark, d):
    return stats.cheapest_wins(v.offers(spark, d), ["group_slug", "store_slug"]).select("group_slug", "store_slug", "price")


@query("""WITH b AS (SELECT DISTINCT brand FROM listings) SELECT a.brand AS a, b.brand AS b, levenshtein(a.brand, b.brand)::INTEGER AS distance FROM b a JOIN b ON a.brand < b.brand WHERE length(a.brand) >= 5 AND length(b.brand) >= 5 AND levenshtein(a.brand, b.brand) <= greatest(1, greatest(length(a.brand), length(b.brand)) // 10)""")
def levenshtein_brands(spark, d):
    # Lengths differ by as much as there may be edits, which is one in ten characters of the longer brand; the list of brands is a dimension.
    b = v.listings(spark, d).select("brand").distinct().where(F.length("brand") >= 5)
    x = b.select(F.col("brand").alias("a"), F.explode(F.sequence(F.floor(F.length("brand") * 0.9) - 1, F.ceil(F.length("brand") / 0.9) + 1)).alias("n"))
    met = x.join(b.select(F.col("brand").alias("b"), F.length("brand").alias("n")), "n").where("a < b")
    limit = F.greatest(F.lit(1), F.floor(F.greatest(F.length("a"), F.length("b")) / 10))
    return met.select("a", "b", F.levenshtein("a", "b").alias("distance")).where(F.col("distance") <= limit)


# -- text ------------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify_text(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark, d):
    return v.read(spark, d, "documents").select("doc_id", text.strip_accents_full("text").alias("plain"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def normalize_url(spark, d):
    return v.read(spark, d, "pages").select("page_id", text.normalize_image_url(F.col("url")).alias("url"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(spark, d):
    return v.read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT event_id, (SELECT count(*) FROM views b WHERE b."user" = a."user" AND b.ts > a.ts - 3600000 AND b.ts <= a.ts) AS n FROM views a""")
def sliding_count(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user").orderBy("ts").rangeBetween(-3599999, 0)
    return v.views(spark, d).select("event_id", F.count("*").over(w).alias("n"))


# -- catalogue -----------------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT key, id, name, brand, type, id % 90 AS store_slug, 100.0::DOUBLE + size AS price, size > 5 AS in_stock FROM listings WHERE key <> ''),
t AS (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(id), type) AS k FROM l GROUP BY key, type),
g AS (SELECT key, count(*) AS offer_count, arg_min(name, (length(name), id)) AS name, arg_min(brand, id) AS brand, min(price) AS all_lo, max(price) AS all_hi, count(DISTINCT store_slug) AS all_s, min(price) FILTER (in_stock) AS lo, max(price) FILTER (in_stock) AS hi, count(DISTINCT store_slug) FILTER (in_stock) AS s FROM l GROUP BY 1)
SELECT g.key, replace(g.key, ' ', '-') AS slug, name, brand, t.type, offer_count, coalesce(lo, all_lo) AS min_price, coalesce(hi, all_hi) AS max_price, CASE WHEN lo IS NULL THEN all_s ELSE s END AS store_count FROM g JOIN t ON g.key = t.key AND k = 1""")
def build_groups(spark, d):
    rows = v.listings(spark, d).withColumns({"ord": F.col("id"), "store_slug": F.col("id") % 90, "price": 100.0 + F.col("size"), "in_stock": F.col("size") > 5, "is_collector": F.lit(False), "region": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    return catalogue.build_groups(rows).select("key", "slug", "name", "brand", "type", "offer_count", "min_price", "max_price", "store_count")


@query("SELECT host, count(*) AS n FROM (SELECT CASE WHEN ends_with(h, '.example.com') THEN '*.example.com' ELSE h END AS host FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages)) GROUP BY 1")
def image_hosts(spark, d):
    return catalogue.image_hosts(v.read(spark, d, "pages"), "url", ["example.com"])


@query("""WITH k AS (SELECT DISTINCT lower(replace(brand, '#', ' ')) AS brand_key FROM products WHERE size > 49)
SELECT lower(replace(brand, '#', ' ')) AS brand_key, count(*) AS n FROM products WHERE region IS DISTINCT FROM 'ASIA' AND lower(replace(brand, '#', ' ')) NOT IN (SELECT brand_key FROM k) GROUP BY 1 HAVING count(*) >= 5""")
def region_candidates(spark, d):
    p = v.products(spark, d)
    known = p.where("size > 49").select(text.brand_alias_key(F.col("brand")).alias("brand_key")).distinct()
    return catalogue.region_candidates(p.where("region is distinct from 'ASIA'").withColumn("region", F.lit(None).cast("string")), known)


# -- what a wine's name says ----------------------------------------------------------------------------------------------------------

_SAID = [
    "Malbec 2019", "Cabernet Sauvignon Franc x 6", "Torrontés Cafayate 750 ml", "Rosé Brut Nature 375 cc", "Tupungato Pinot Noir 1,5 l", "MAIPÚ Syrah x 375", "Cabernet Agrelo Caja", "Semillón Cosecha Tardía Media",
    "Shiraz Merlot Bonarda Tannat 1999", "Luján de Cuyo Blanco Magnum", "Catena Zapata Malbec Mendoza", "San Juan Criolla 187", "Las Moras Espumante Extra Brut", "Ron Dorado 200 ml", "Gewürztraminer Río Negro 3000", "Cerveza Roja 473 ml pack",
]
_NAMED = f"SELECT p_partkey AS id, p_name || ' ' || {_SAID!r}[p_partkey % {len(_SAID)} + 1] AS name, CASE p_partkey % 5 WHEN 0 THEN 'Bodega Familia Zuccardi' WHEN 1 THEN 'Luigi Bosca' WHEN 2 THEN 'Bodegas El Esteco' WHEN 3 THEN p_brand END AS brand FROM part"


def _named(spark, d):
    p = v.read(spark, d, "part")
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % len(_SAID) + 1).cast("int"))
    n = F.col("p_partkey") % 5
    brand = F.when(n == 0, "Bodega Familia Zuccardi").when(n == 1, "Luigi Bosca").when(n == 2, "Bodegas El Esteco").when(n == 3, F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", said).alias("name"), brand.alias("brand"))


def _cases(rules: list[tuple[str, str]], on: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({on}, '(?i){p}') THEN '{label}'" for label, p in rules) + " END"


_GRAPES = ", ".join(f"CASE WHEN regexp_matches(name, '(?i){p}') THEN '{label}' END" for label, p in wine.VARIETALS)


@query(rf"""WITH n AS ({_NAMED}), g AS (SELECT *, [x FOR x IN [{_GRAPES}] IF x IS NOT NULL] AS all_grapes FROM n)
SELECT id, array_to_string((CASE WHEN list_has_any(all_grapes, ['Cabernet Sauvignon', 'Cabernet Franc']) THEN list_filter(all_grapes, lambda x: x <> 'Cabernet') ELSE all_grapes END)[1:3], ', ') AS varietals,
 {_cases(wine.REGIONS, "name || ' ' || coalesce(brand, '')")} AS region, {_cases(wine.TYPES, "name")} AS type, nullif(regexp_extract(name, '\b(19\d\d|20[0-2]\d)\b', 1), '')::INTEGER AS vintage FROM g""")
def wine_attributes(spark, d):
    name = F.col("name")
    return _named(spark, d).select("id", F.array_join(wine.varietals(name), ", ").alias("varietals"), wine.region(name, F.col("brand")).alias("region"), wine.kind(name).alias("type"), text.extract_vintage(name).alias("vintage"))


_ANY_VOLUME = "|".join(text.BARE_VOLUMES)


@query(rf"""WITH n AS ({_NAMED}), e AS (SELECT id, regexp_extract(l, '\b({text.PACK_WORDS})\b', 1) AS pack, regexp_extract(l, '\bx\s*(\d+)\b', 1) AS cnt, l LIKE '%magnum%' AS magnum, regexp_matches(l, '\b(media|half)\b') AS half,
 replace(regexp_extract(l, '\b(\d+([.,]\d+)?)\s*l\b', 1), ',', '.') AS litres, regexp_extract(l, '\b(\d{{3,4}})\s*(ml|cc|cm3|cm³)(\s|$|[^a-z0-9])', 1) AS ml, regexp_extract(l, '\b(x\s*)?({_ANY_VOLUME})(\s|$|[^a-z0-9.,])', 2) AS bare FROM (SELECT id, lower(name) AS l FROM n))
SELECT id, nullif(array_to_string(list_sort([x FOR x IN [nullif(pack, ''), CASE WHEN cnt <> '' AND NOT (ml = '' AND cnt IN ('{_ANY_VOLUME.replace("|", "', '")}')) THEN 'x' || cnt END, CASE WHEN magnum THEN 'magnum' END, CASE WHEN half THEN 'half' END,
 CASE WHEN litres <> '' THEN litres || 'l' END, CASE WHEN ml NOT IN ('', '750') THEN ml || 'ml' END, CASE WHEN ml = '' AND bare <> '' THEN bare || 'ml' END] IF x IS NOT NULL]), '-'), '') AS format FROM e""")
def wine_formats(spark, d):
    return _named(spark, d).select("id", text.extract_format(F.col("name")).alias("format"))


_NOISE = "'" + "', '".join(wine.NOISE) + "'"
_ALIASED = "c"
for _said, _meant in wine.ALIASES:
    _ALIASED = rf"regexp_replace({_ALIASED}, '\b{_said}\b', '{_meant}', 'g')"


@query(rf"""WITH n AS ({_NAMED}), s AS (SELECT id, brand, strip_accents(lower(name)) AS s FROM n), p AS (SELECT id, brand, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
 '\b(19\d\d|20[0-2]\d)\b', ' ', 'g'), '\b\d+\s*(ml|cc|cm3|cm³)(\s|$|[^a-z0-9])', ' ', 'g'), '\b\d+([.,]\d+)?\s*l\b', ' ', 'g'), '\b(x\s*)?({_ANY_VOLUME})(\s|$|[^a-z0-9.,])', ' ', 'g'), '\bx\s*\d+\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g') AS s FROM s),
w AS (SELECT id, [t FOR t IN string_split_regex(s, '\s+') IF length(t) > 1 AND t NOT IN ({_NOISE})] AS own,
 trim(regexp_replace(regexp_replace(lower(brand), '^bodegas?\s+', ''), '[^a-z0-9\s]', ' ', 'g')) AS b FROM p),
h AS (SELECT id, own, [t FOR t IN string_split(coalesce(CASE b {" ".join(f"WHEN '{x}' THEN '{y}'" for x, y in wine.ALIASES)} ELSE b END, ''), ' ') IF t <> '' AND t NOT IN ({_NOISE}) AND NOT list_contains(own, t)] AS house FROM w)
SELECT id, array_to_string(list_sort(string_split({_ALIASED}, ' ')), ' ') AS key FROM (SELECT id, array_to_string(list_concat(own, house), ' ') AS c FROM h)""")
def wine_keys(spark, d):
    return _named(spark, d).select("id", wine.canonical_key(F.col("name"), F.col("brand")).alias("key"))


@query(rf"""WITH n AS ({_NAMED}) SELECT id, NOT (regexp_matches(name, '(?i){_NOT_WINE}') OR regexp_matches(name, '(?i){wine.NOT_WINE_SIZE}')) AS is_wine FROM n""")
def wine_or_not(spark, d):
    return _named(spark, d).select("id", wine.is_wine(F.col("name")).alias("is_wine"))


# -- steps in order, by recursion in SQL ---------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT group_slug, ord, (ln(price) - ln(900)) / (ln(110000) - ln(900)) AS x FROM offers WHERE price > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY group_slug ORDER BY x, ord) AS k FROM x),
r AS (SELECT group_slug, ord, k, 0::BIGINT AS lane, [x] AS ends FROM n WHERE k = 1 UNION ALL
 SELECT group_slug, ord, k, lane, CASE WHEN lane = len(ends) THEN list_append(ends, x) ELSE list_concat(ends[1:lane], [x], ends[lane + 2:]) END FROM (
  SELECT n.group_slug, n.ord, n.k, n.x, r.ends, coalesce(list_position([n.x - e >= 0.04::DOUBLE FOR e IN r.ends], true) - 1, len(r.ends))::BIGINT AS lane FROM r JOIN n ON n.group_slug = r.group_slug AND n.k = r.k + 1))
SELECT group_slug, lane, count(*) AS n FROM r GROUP BY 1, 2""")
def price_lanes(spark, d):
    # Marks at one place take the same lanes in any order, so their counts need no `ord`.
    rows = v.offers(spark, d).where("price > 0").select("group_slug", mathx.log_position(F.col("price"), F.lit(900.0), F.lit(110000.0)).alias("x"))
    return serving.pack_lanes(rows, "group_slug", "x").groupBy("group_slug", "lane").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT "user", ts, event_id, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS k FROM views),
r AS (SELECT "user", event_id, k, true AS accepted, [ts] AS times FROM n WHERE k = 1 UNION ALL
 SELECT "user", event_id, k, len(held) < 3, CASE WHEN len(held) < 3 THEN list_append(held, ts) ELSE held END FROM (
  SELECT n."user", n.event_id, n.k, n.ts, [t FOR t IN r.times IF t > n.ts - 21600000] AS held FROM r JOIN n ON n."user" = r."user" AND n.k = r.k + 1))
SELECT event_id, accepted FROM r""")
def rate_limiter(spark, d):
    from tallymark.streaming.limiter import limit_batch

    return limit_batch(v.views(spark, d).select(F.col("user").cast("string").alias("key"), "ts", "event_id"), most=3, span_ms=6 * 3_600_000).select("event_id", "accepted")


# -- hashes and pages ------------------------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT doc_id::VARCHAR AS url, sha256(text)[1:63] AS stem, to_hex(doc_id % 16) AS last FROM documents WHERE text IS NOT NULL),
f AS (SELECT stem, last, min(url) AS first FROM h GROUP BY 1, 2), n AS (SELECT stem, count(*) - 1 AS links FROM f GROUP BY 1)
SELECT url, first, links FROM h JOIN f USING (stem, last) JOIN n USING (stem)""")
def hash_neighbours(spark, d):
    # Equal texts differ in the last digit alone, by four bits at most.
    docs = v.read(spark, d, "documents").where("text is not null")
    h = docs.select(F.col("doc_id").cast("string").alias("url"), F.concat(F.substring(F.sha2("text", 256), 1, 63), F.hex(F.col("doc_id") % 16)).alias("hash"))
    return pairs.hash_members(h, 10)


@query("""SELECT 's' AS store_slug, 'p' || page_id::VARCHAR AS name, '1' AS external_sku, CASE WHEN page_id % 3 = 0 THEN 1200.5::DOUBLE ELSE 900.0::DOUBLE END AS price_ars, page_id % 3 = 0 AS in_stock, 'ARS' AS currency FROM pages WHERE page_id % 7 <> 0""")
def jsonld_products(spark, d):
    from tallymark.sources.payloads import json_ld_products

    n = F.col("page_id").cast("string")
    one = F.concat(F.lit('{"@type":"Product","name":"p'), n, F.lit('","sku":"1","offers":{"price":"$ 1200.5","availability":"http://schema.org/InStock"}}'))
    listed = F.concat(F.lit('[{"@type":"Thing"},{"mainEntity":{"@type":["Product","Thing"],"name":"p'), n, F.lit('","sku":"1","offers":[{"lowPrice":900}]}}]'))
    doc = F.when(F.col("page_id") % 7 == 0, F.lit("{broken")).when(F.col("page_id") % 3 == 0, one).otherwise(listed)
    pages = v.read(spark, d, "pages").select(F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"), "html").alias("html"), F.lit("s").alias("store_slug"))
    return json_ld_products(pages).select("store_slug", "name", "external_sku", "price_ars", "in_stock", "currency")
