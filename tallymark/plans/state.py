"""Queries over what is kept between runs: answers that are asked once, and versions of the shops' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import offer_label
from tallymark.operators import pairs, resolve, serving, sitemap
from tallymark.plans import views as v
from tallymark.plans.registry import query
from tallymark.session import new_path, staged
from tallymark.sources.paging import page_verdicts
from tallymark.sources.versions import KeyedCache, Versions

_LINE = "trim(lower(coalesce({0}.p_name, '') || '|' || coalesce({0}.p_brand, '') || '|' || coalesce(CASE WHEN {0}.p_size % 3 = 0 THEN (2000 + {0}.p_size)::VARCHAR END, '')))"


def _judge(asked: DataFrame) -> DataFrame:
    """Stands for whoever decides: yes, no, or no answer, by the length of the key."""
    return asked.select("key", F.when(F.length("key") % 3 == 0, "yes").when(F.length("key") % 3 == 1, "no").alias("answer"))


@query(f"""WITH q AS (SELECT a.p_partkey AS a, b.p_partkey AS b, least({_LINE.format("a")}, {_LINE.format("b")}) AS x, greatest({_LINE.format("a")}, {_LINE.format("b")}) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7),
k AS (SELECT *, x || '||' || y AS key, CASE length(x || '||' || y) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS answer FROM q),
r AS (SELECT key, min(CASE WHEN a % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS run FROM k GROUP BY 1)
SELECT a, b, answer, run FROM k JOIN r USING (key)""")
def decision_cache(spark, d):
    """Pairs decided over two runs: the second asks only what the first has not, answers that say nothing included."""
    p = v.read(spark, d, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 == 0, 2000 + F.col("p_size")).alias("vintage")).alias("g"))
    x, y = p.select(F.col("p_partkey").alias("a_id"), F.col("g").alias("a")), p.select((F.col("p_partkey") - 7).alias("a_id"), F.col("p_partkey").alias("b_id"), F.col("g").alias("b"))
    asked = staged(x.join(y, "a_id").withColumn("key", resolve.decision_key()), "decisions").select("a_id", "b_id", "key")
    cache = KeyedCache(spark, new_path(spark, "decisions"))
    cache.fill(asked.where("a_id % 2 = 0"), _judge, per_commit=1 << 30)
    cache.fill(asked, _judge, per_commit=1 << 30)
    return cache.answers(asked).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "answer", "run")


@query("""WITH c AS (SELECT store_slug, vintage, count(*) AS n FROM offers GROUP BY 1, 2), p AS (SELECT store_slug, n FROM c WHERE vintage = 1996 AND store_slug % 11 <> 3),
q AS (SELECT store_slug, CASE WHEN store_slug % 10 = 0 THEN 0 WHEN store_slug % 10 = 1 THEN n // 2 ELSE n END AS n, store_slug % 20 = 0 AS errors FROM c WHERE vintage = 1997 AND store_slug % 3 > 0),
b AS (SELECT q.store_slug, p.n AS before, q.n AS now, errors FROM q LEFT JOIN p USING (store_slug)),
i AS (SELECT unnest([CASE WHEN errors THEN 'warn:errors' END, CASE WHEN now = 0 AND NOT errors THEN 'warn:silent zero' END, CASE WHEN before >= 50 AND now = 0 THEN 'error:lost' END, CASE WHEN before >= 30 AND now > 0 AND now <= 0.5::DOUBLE * before THEN 'warn:halved' END]) AS issue, store_slug, coalesce(before, 0) AS before, now FROM b),
t AS (SELECT (SELECT sum(n) FROM p)::BIGINT AS before, (SELECT sum(n) FROM q)::BIGINT AS now)
SELECT * FROM i WHERE issue IS NOT NULL UNION ALL SELECT 'error:total', NULL, before, now FROM t WHERE before >= 1000 AND now <= 0.8::DOUBLE * before""")
def health_versions(spark, d):
    """The newest version of the shops' counts against the one before; a third of the shops has gone between them, some are new."""
    counts = v.offers(spark, d).groupBy("store_slug", "vintage").agg(F.count("*").alias("n"))
    before = counts.where("vintage = 1996 and store_slug % 11 <> 3").select("store_slug", F.col("n").alias("product_count"), F.lit(0).alias("errors"))
    said = F.when(F.col("store_slug") % 10 == 0, 0).when(F.col("store_slug") % 10 == 1, F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    now = counts.where("vintage = 1997 and store_slug % 3 > 0").select("store_slug", said.cast("long").alias("product_count"), (F.col("store_slug") % 20 == 0).cast("int").alias("errors"))
    kept = Versions(spark, new_path(spark, "versions"))
    for rows in (before, now):
        kept.commit({"stores": rows})
    return pairs.health(kept.read("stores", back=1), kept.read("stores"))


_CRAWL = """SELECT p_partkey AS id, p_partkey % 13 AS store_slug, CAST(floor(p_partkey / 78) AS INT) + 1 AS page, CAST(floor(p_partkey / 13) AS INT) % 6 AS spot,
 CASE WHEN p_partkey % 13 % 4 = 1 AND floor(p_partkey / 78) >= 2 THEN concat('u', CAST(p_partkey % 78 AS {0})) ELSE concat('u', CAST(p_partkey AS {0})) END AS external_url FROM {1}"""
#: Some shops repeat their first page from the third on, some have a short second one, some an empty one, some a page that failed or was not fetched.
_GONE = "(store_slug % 4 = 2 AND page = 2 AND spot > 3) OR (store_slug % 8 = 3 AND page = 2)"
_PAGES = "SELECT DISTINCT store_slug, page, NOT (store_slug = 7 AND page = 2) AS ok FROM {} WHERE NOT (store_slug = 0 AND page = 2)"


@query(f"""WITH all_items AS ({_CRAWL.format("VARCHAR", "part")}), items AS (SELECT * FROM all_items WHERE NOT ({_GONE})), fetched AS ({_PAGES.format("all_items")}),
f AS (SELECT store_slug, page, count(*) AS new FROM (SELECT store_slug, external_url, min(page) AS page FROM items GROUP BY 1, 2) GROUP BY 1, 2), c AS (SELECT store_slug, page, count(DISTINCT external_url) AS items FROM items GROUP BY 1, 2),
r AS (SELECT store_slug, page, ok, coalesce(items, 0) AS items, coalesce(new, 0) AS new, row_number() OVER (PARTITION BY store_slug ORDER BY page) AS n FROM fetched LEFT JOIN c USING (store_slug, page) LEFT JOIN f USING (store_slug, page)),
s AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN items = 0 THEN 'empty' WHEN new = 0 THEN 'nothing new' WHEN items < 6 THEN 'short' END AS stop FROM r),
e AS (SELECT *, coalesce(bool_or(stop IS NOT NULL) OVER (PARTITION BY store_slug ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM s),
z AS (SELECT *, CASE WHEN ended THEN 'after end' WHEN n <> page THEN 'gap' WHEN page > 20 THEN 'beyond last' ELSE stop END AS reason FROM e)
SELECT store_slug, page, items, new, reason IS NULL OR reason = 'short' AS counts, reason FROM z""")
def crawl_pages(spark, d):
    """Pages of shops that end in different ways."""
    part = v.read(spark, d, "part")
    every = spark.sql(_CRAWL.format("STRING", "{part}"), part=part)
    return page_verdicts(spark.sql(_PAGES.format("{every}"), every=every), every.where(f"NOT ({_GONE})"), full=6, last_page=20)


_MAPPED = """SELECT group_slug AS id, CASE WHEN group_slug % 50 = 0 THEN concat('tipo-', CAST(group_slug AS {0})) ELSE concat('w', CAST(group_slug AS {0})) END AS group_slug, CASE WHEN group_slug % 9 > 0 THEN 'i' END AS image_url,
 CASE WHEN group_slug % 7 = 0 THEN group_slug % 13 ELSE store_count END AS store_count, CASE WHEN group_slug % 11 = 0 THEN 0 ELSE in_stock_offer_count END AS in_stock_offer_count, brand FROM {1}"""
_HOUSES = "SELECT lower(replace(brand, '#', '-')) AS slug, max(store_count) - 2 AS store_count FROM {} GROUP BY 1"


@query(f"""WITH m AS ({_MAPPED.format("VARCHAR", "cat")}), h AS ({_HOUSES.format("m")}),
e AS (SELECT 'vinos' AS bucket, '/vino/' || group_slug AS path, CASE WHEN in_stock_offer_count = 0 THEN 'weekly' ELSE 'daily' END AS change, CASE WHEN in_stock_offer_count = 0 THEN 0.2 WHEN store_count >= 10 THEN 0.9 WHEN store_count >= 5 THEN 0.8 WHEN store_count >= 3 THEN 0.7 WHEN store_count >= 2 THEN 0.6 ELSE 0.4 END AS priority
  FROM m WHERE image_url IS NOT NULL AND NOT starts_with(group_slug, 'tipo-')
 UNION ALL SELECT 'bodegas', '/bodega/' || slug, 'daily', CASE WHEN store_count >= 10 THEN 0.9 WHEN store_count >= 5 THEN 0.8 WHEN store_count >= 3 THEN 0.7 ELSE 0.5 END FROM h WHERE store_count >= 2),
n AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY path) - 1) // 300 + 1 AS part FROM e)
SELECT CASE WHEN part = 1 AND bucket <> 'vinos' THEN bucket ELSE bucket || '-' || part::VARCHAR END AS bucket, path, change, priority::DOUBLE AS priority FROM n""")
def site_map(spark, d):
    """Entries of the site map in buckets of 300."""
    cat = v.groups(spark, d)
    mapped = staged(spark.sql(_MAPPED.format("STRING", "{cat}"), cat=cat), "site-groups")
    houses = spark.sql(_HOUSES.format("{mapped}"), mapped=mapped)
    return sitemap.bucketed(sitemap.wine_entries(mapped).unionByName(sitemap.page_entries(houses, "bodegas")), 300)


_PLATFORMS = ", ".join(f"'{x}'" for x in serving.PLATFORM_ORDER)


@query("""WITH c AS (SELECT store_slug, count(*) AS n FROM offers WHERE store_slug % 7 > 0 GROUP BY 1), s AS (SELECT store_slug, store_name, coalesce(n // 40, 0)::BIGINT AS product_count,
 CASE WHEN store_slug % 5 > 0 THEN 'day ' || (store_slug % 30)::VARCHAR END AS last_scrape_at, (CASE WHEN store_slug % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS errors FROM stores LEFT JOIN c USING (store_slug))
SELECT *, row_number() OVER (ORDER BY product_count DESC, store_slug)::BIGINT - 1 AS place FROM s""")
def store_list(spark, d):
    """The stores by their products; counts, dates and lists of errors are missing for some, and many counts are equal."""
    counts = v.offers(spark, d).where("store_slug % 7 > 0").groupBy("store_slug").agg(F.floor(F.count("*") / 40).alias("product_count"))
    errors = F.when(F.col("store_slug") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("store_slug") % 4 == 1, F.array().cast("array<string>"))
    started = F.when(F.col("store_slug") % 5 > 0, F.concat(F.lit("day "), (F.col("store_slug") % 30).cast("string")))
    return serving.store_list(v.stores(spark, d).join(counts, "store_slug", "left").withColumns({"errors": errors, "started_at": started}))


@query(f"""WITH s AS (SELECT store_slug, store_name, ([{_PLATFORMS}, 'another', NULL])[store_slug % 11 + 1] AS platform FROM stores),
r AS (SELECT *, coalesce(nullif(list_position([{_PLATFORMS}], platform), 0), 99)::INTEGER AS platform_rank FROM s)
SELECT *, row_number() OVER (ORDER BY platform_rank, store_slug)::BIGINT - 1 AS place FROM r""")
def store_table(spark, d):
    """The stores by platform; some platforms have no rank, some stores no platform."""
    platforms = F.array(*map(F.lit, [*serving.PLATFORM_ORDER, "another", None]))
    return serving.store_table(v.stores(spark, d).withColumn("platform", F.get(platforms, (F.col("store_slug") % 11).cast("int"))))


@query(r"""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 5 THEN p_brand END AS brand, CASE WHEN p_partkey % 6 = 0 THEN lower(p_brand) || ' rosa' ELSE 'Vino ' || p_name || ' ' || p_brand || ' TINTO ' || (1960 + p_partkey % 90)::VARCHAR || ' x 750 ml' END AS name FROM part),
p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\b(19\d{2}|20[0-2]\d)\b', ' ', 'g'), '(?i)\s*\d+\s*(ml|cc)\b', ' ', 'g'), '(?i)\b(Vino|Tinto|Blanco)\b', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM n),
b AS (SELECT *, trim(regexp_replace(regexp_replace(plain, '(?i)\b\Q' || brand || '\E\b', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM p)
SELECT id, CASE WHEN brand <> '' AND length(bare) > 5 THEN bare ELSE plain END AS label FROM b""")
def offer_labels(spark, d):
    """Offer names for people, of names with and without vintages in range, volumes, and brands; some would be too short without their brand."""
    p = v.read(spark, d, "part")
    vintage = (1960 + F.col("p_partkey") % 90).cast("string")
    name = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lower("p_brand"), F.lit(" rosa"))).otherwise(F.concat(F.lit("Vino "), "p_name", F.lit(" "), "p_brand", F.lit(" TINTO "), vintage, F.lit(" x 750 ml")))
    return p.select(F.col("p_partkey").alias("id"), offer_label(name, F.when(F.col("p_partkey") % 6 < 5, F.col("p_brand"))).alias("label"))
