"""What the read paths return: best offers, ordered lists, traffic, site maps and comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import host, utc_day, xml_escape
from tallymark.operators.ranking import numbered


def offer_order() -> list[Column]:
    """In stock first, then no collector's item, then the lowest price."""
    return [F.desc("in_stock"), F.coalesce("is_collector", F.lit(False)), F.col("price").asc_nulls_last(), F.col("ord")]


def best_offer(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """The first in-stock, non-collector offer of each group, with its store's name (its slug where there is none)."""
    rows = offers.where(F.col("in_stock") & ~F.coalesce("is_collector", F.lit(False)) & (F.col("price") > 0))
    best = rows.groupBy("group_slug").agg(F.min(F.struct("price", "ord", "store_slug")).alias("o")).select("group_slug", "o.price", "o.store_slug")
    return best.join(stores.select("store_slug", "store_name"), "store_slug", "left").select("group_slug", "store_slug", "price", F.coalesce("store_name", F.col("store_slug").cast("string")).alias("store_name"))


def detail_offers(slugs: DataFrame, offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Every offer of the groups asked for (group_slug), in the order of a product page, with the store's name and what it costs over the best price in stock."""
    rows = offers.join(slugs.select("group_slug").distinct(), "group_slug", "left_semi")
    own = Window.partitionBy("group_slug")  # one product's offers
    best = F.min(F.when(F.col("in_stock") & (F.col("price") > 0), F.col("price"))).over(own)
    rows = rows.select("*", F.row_number().over(own.orderBy(*offer_order())).alias("place"), (F.col("price") - best).alias("over_best"))
    named = rows.join(stores.select("store_slug", "store_name"), "store_slug", "left")
    return named.select("group_slug", "place", "store_slug", F.coalesce("store_name", F.col("store_slug").cast("string")).alias("store_name"), "price", "in_stock", "is_collector", "over_best")


#: The platforms in the order of the stores table; others come after them.
PLATFORM_ORDER = ["tiendanube", "woocommerce", "shopify", "vtex", "magento", "prestashop", "mercadolibre", "bigcommerce", "custom"]


def store_list(stores: DataFrame) -> DataFrame:
    """The stores (store_slug, store_name, product_count, started_at, errors) with place, from 0: those of most products first, equal ones by slug. A missing count or list of errors is 0."""
    count = F.coalesce(F.col("product_count").cast("long"), F.lit(0).cast("long"))
    errors = F.greatest(F.coalesce(F.size("errors"), F.lit(0)), F.lit(0)).cast("long")
    rows = stores.select("store_slug", "store_name", count.alias("product_count"), F.col("started_at").alias("last_scrape_at"), errors.alias("errors"))
    return numbered(rows, [F.desc("product_count"), F.col("store_slug")], "place")


def store_table(stores: DataFrame) -> DataFrame:
    """The stores (store_slug, store_name, platform) with place, from 0: by the rank of their platform, then by slug."""
    at = F.array_position(F.array(*map(F.lit, PLATFORM_ORDER)), F.col("platform"))
    rows = stores.select("store_slug", "store_name", "platform", F.when(at > 0, at).otherwise(99).cast("int").alias("platform_rank"))
    return numbered(rows, [F.col("platform_rank"), F.col("store_slug")], "place")


def in_list_order(groups: DataFrame, slugs: DataFrame, limit: int = 200) -> DataFrame:
    """Groups of a list (slug, pos) in the list's order; unknown slugs are left out."""
    return slugs.orderBy("pos").limit(limit).join(groups, slugs["slug"] == groups["group_slug"]).select("pos", "group_slug", "name", "min_price")


def last_seen(views: DataFrame, keep: int = 20) -> DataFrame:
    """The last `keep` distinct slugs of each user, the latest first."""
    latest = views.groupBy("user", "slug").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user").orderBy(F.desc("ts"), "slug")
    return latest.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= keep)


def link_if_page(rows: DataFrame, pages: DataFrame, slug: str) -> DataFrame:
    """The slug where such a page exists, else null."""
    known = pages.select(F.col("slug").alias("__tm_slug")).distinct()
    return rows.join(known, F.col(slug) == F.col("__tm_slug"), "left").withColumn(slug, F.col("__tm_slug")).drop("__tm_slug")


def traffic(views: DataFrame, by: str) -> DataFrame:
    """Views by `path`, `day` (UTC) or `ref` (host)."""
    value = {"path": F.col("path"), "day": utc_day(F.col("ts")).cast("string"), "ref": host(F.col("ref"))}[by]
    return views.select(value.alias(by), "ts").where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def platform_breakdown(stores: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """Stores and products per platform; stores without products count."""
    return stores.join(counts, "store_slug", "left").groupBy(column).agg(F.count("*").alias("stores"), F.sum(F.coalesce("product_count", F.lit(0))).alias("products"))


def sitemap(groups: DataFrame, base: str, chunk: int = 10_000) -> DataFrame:
    """loc, bucket and priority of each group's page, in chunks of slug order.

    Ranks come from a range partitioning: each partition numbers its rows and adds the sizes of those before it, so no task sees all slugs.
    """
    n = max(1, groups.sparkSession.sparkContext.defaultParallelism)
    from tallymark.session import staged

    rows = staged(groups.select("group_slug", "store_count", "in_stock_offer_count").repartitionByRange(n, "group_slug").withColumn("part", F.spark_partition_id()), "slugs")
    sizes = rows.groupBy("part").agg(F.count("*").alias("m"))
    before = sizes.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # one row a partition
    ranked = rows.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("group_slug")) - 1)
    s = F.col("store_count")
    priority = F.when(F.col("in_stock_offer_count") == 0, 0.2).when(s >= 10, 0.9).when(s >= 5, 0.8).when(s >= 3, 0.7).when(s >= 2, 0.6).otherwise(0.4)
    return ranked.select(F.concat(F.lit(base), F.col("group_slug").cast("string")).alias("loc"), F.concat(F.lit("vinos-"), (F.floor(F.col("at") / chunk) + 1).cast("string")).alias("bucket"), priority.alias("priority"))


def urlset(entries: DataFrame) -> DataFrame:
    """One XML document a bucket."""
    tag = F.concat(F.lit("<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc><priority>"), F.format_number("priority", 1), F.lit("</priority></url>"))
    body = entries.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list(tag)), "\n").alias("urls"))
    return body.select("bucket", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'), "urls", F.lit("\n</urlset>")).alias("xml"))


def compare(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Both sides of each pair, and which one wins by price and by stores."""
    g = groups.select("group_slug", "min_price", "store_count")
    a = g.select(*[F.col(c).alias(f"a_{c}") for c in g.columns])
    b = g.select(*[F.col(c).alias(f"b_{c}") for c in g.columns])
    rows = pairs.join(a, F.col("slug_a") == F.col("a_group_slug")).join(b, F.col("slug_b") == F.col("b_group_slug"))
    win = lambda x, y: F.when(x < y, F.lit("a")).when(y < x, F.lit("b")).otherwise(F.lit("tie"))
    return rows.select("slug_a", "slug_b", win(F.col("a_min_price"), F.col("b_min_price")).alias("cheaper"), win(F.col("b_store_count"), F.col("a_store_count")).alias("wider"))


def pack_lanes(rows: DataFrame, key: str, position: str, gap: float = 0.04) -> DataFrame:
    """Greedy lanes per key: a mark takes the first lane whose last mark is at least `gap` before it. Marks without a position come last, each in a lane of its own.

    Rows are dealt by key and sorted, and pass by in one stream; a task holds a batch and the lanes' ends of one key.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("lane", T.IntegerType())])
    columns, at = rows.columns, F.coalesce(F.col(position).cast("double"), F.lit(float("nan")))

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = (), []  # no key is a tuple
        for batch in batches:
            out = []
            for name, x in zip(batch.column("__tm_key").to_pylist(), batch.column("__tm_at").to_pylist()):
                if name != last:
                    last, ends = name, []
                lane = 0
                for end in ends:
                    if x - end >= gap:
                        ends[lane] = x
                        break
                    lane += 1
                else:
                    ends.append(x)
                out.append(lane)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.int32())], [*columns, "lane"])

    # NaN keys are one key, as in groupBy.
    name = F.col(key).cast("string") if isinstance(rows.schema[key].dataType, T.FractionalType) else F.col(key)
    order = ["__tm_key", "__tm_at", *[F.col(c).asc_nulls_last() for c in rows.columns if c not in (key, position)]]
    return rows.select("*", name.alias("__tm_key"), at.alias("__tm_at")).repartition("__tm_key").sortWithinPartitions(*order).mapInArrow(lanes, schema)
