"""The driver's tables as the engine's: stores, offers, groups, price history, listings and page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import stats


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(F.col("s_suppkey").alias("store_slug"), F.col("s_name").alias("store_name"), F.col("n_name").alias("nation"), F.col("r_name").alias("platform"))


def offers(spark: SparkSession, d: str) -> DataFrame:
    """`ord` is a line's full tuple, which is unique."""
    x = read(spark, d, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return x.select(
        F.col("l_partkey").alias("group_slug"), F.col("l_suppkey").alias("store_slug"), F.col("l_extendedprice").alias("price"),
        (F.col("l_linestatus") == "O").alias("in_stock"), (F.year("l_shipdate") <= 1996).alias("is_collector"), F.year("l_shipdate").alias("vintage"),
        F.to_date("l_shipdate").alias("day"), F.concat(F.when(F.col("l_quantity") >= 45, "pack ").otherwise(""), F.col("l_returnflag")).alias("name"), order.alias("ord"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("orderkey"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    regions = read(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    out = p.join(regions, F.col("p_size") % 5 == F.col("r_regionkey"), "left")
    return out.select(F.col("p_partkey").alias("group_slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.initcap("p_type").alias("type"), "region", F.split("p_name", " ").alias("varietals"), F.col("p_size").alias("size"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).join(stats.group_stats(offers(spark, d)), "group_slug").select("*")


def history(spark: SparkSession, d: str) -> DataFrame:
    x = offers(spark, d).where("price > 0")
    return x.groupBy(F.col("group_slug").alias("slug"), F.col("day").alias("date")).agg(F.min("price").alias("min"), F.countDistinct("store_slug").alias("stores"))


def views(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.lit("pageview").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("/"), "event_type").alias("path"), F.concat(F.lit("https://host"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"), F.lit(".example/x")).alias("ref"), F.col("user_id").alias("user"), "event_id")


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Products as listings: a key of sorted tokens and, for one in three, a product number that some share."""
    p = read(spark, d, "part")
    from tallymark.functions.text import token_key

    sku = F.when(F.col("p_partkey") % 3 == 0, F.lpad((F.col("p_partkey") % 400).cast("string"), 13, "7"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), sku.alias("sku"), token_key(F.col("p_name"), F.col("p_brand")).alias("key"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))


#: The same views in SQL.
SQL = r"""
stores AS (SELECT s_suppkey AS store_slug, s_name AS store_name, n_name AS nation, r_name AS platform
  FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey),
offers AS (SELECT l_partkey AS group_slug, l_suppkey AS store_slug, l_extendedprice AS price, l_linestatus = 'O' AS in_stock, year(l_shipdate) <= 1996 AS is_collector,
  year(l_shipdate)::INTEGER AS vintage, l_shipdate::DATE AS day, CASE WHEN l_quantity >= 45 THEN 'pack ' ELSE '' END || l_returnflag AS name, l_returnflag AS flag, l_quantity AS quantity,
  (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_orderkey AS orderkey FROM lineitem),
products AS (SELECT p_partkey AS group_slug, p_name AS name, p_brand AS brand, upper(p_type[1]) || lower(p_type[2:]) AS type, r_name AS region, string_split(p_name, ' ') AS varietals, p_size AS size
  FROM part LEFT JOIN region ON p_size % 5 = r_regionkey),
gstats AS (SELECT group_slug, count(*) AS offer_count, count(*) FILTER (in_stock AND price > 0) AS in_stock_offer_count, count(DISTINCT store_slug) FILTER (in_stock AND price > 0) AS store_count,
  min(price) FILTER (in_stock AND price > 0) AS min_price, max(price) FILTER (in_stock AND price > 0) AS max_price FROM offers GROUP BY 1),
cat AS (SELECT * FROM products JOIN gstats USING (group_slug)),
hist AS (SELECT group_slug AS slug, day AS date, min(price) AS min, count(DISTINCT store_slug) AS stores FROM offers WHERE price > 0 GROUP BY 1, 2),
views AS (SELECT (epoch_us(ts) // 1000)::BIGINT AS ts, '/' || event_type AS path, 'https://host' || ((json_extract_string(props, '$.k')::INTEGER % 10)::VARCHAR) || '.example/x' AS ref, 'host' || ((json_extract_string(props, '$.k')::INTEGER % 10)::VARCHAR) || '.example' AS host, user_id AS "user", event_id FROM events),
listings AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN lpad((p_partkey % 400)::VARCHAR, 13, '7') END AS sku, p_size AS size, p_type AS type,
  array_to_string(list_sort(list_distinct([t FOR t IN string_split(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' ') IF length(t) > 1])), ' ') AS key FROM part)
"""
