"""The site map: entries in bounded buckets, one XML document a bucket, and an index of what was committed.

Entries of a bucket beyond `chunk` go to further buckets of the same name with a number, so no document and no task that makes one grows with the catalogue. Places come
from a global numbering by (bucket, address), so a page stays in its bucket while the catalogue around it does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.text import is_junk_slug, xml_escape
from tallymark.operators.ranking import numbered

#: Pages that are always there, with how often they change and what they weigh.
STATIC = [
    ("/", "daily", 1.0), ("/buscar", "daily", 0.9), ("/buscar?multi=1", "daily", 0.9), ("/sobre", "monthly", 0.5), ("/como-funciona", "monthly", 0.5), ("/preguntas", "monthly", 0.6), ("/sumate", "monthly", 0.4),
    ("/contacto", "monthly", 0.4), ("/blog", "weekly", 0.7), ("/ranking", "daily", 0.8), ("/bodegas", "daily", 0.7), ("/data", "daily", 0.7), ("/developers", "monthly", 0.5),
]
XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def _tier(n: Column, tiers: Sequence[tuple[int, float]], least: float) -> Column:
    out = None
    for at, weight in tiers:
        out = F.when(n >= at, weight) if out is None else out.when(n >= at, weight)
    return out.otherwise(least)


def wine_entries(groups: DataFrame) -> DataFrame:
    """bucket, path, change, priority of groups (group_slug, image_url, store_count, in_stock_offer_count) with an image and no junk slug; what is out of stock everywhere weighs little."""
    slug, out = F.col("group_slug").cast("string"), F.coalesce(F.col("in_stock_offer_count"), F.lit(0)) == 0
    weight = F.when(out, 0.2).otherwise(_tier(F.col("store_count"), [(10, 0.9), (5, 0.8), (3, 0.7), (2, 0.6)], 0.4))
    return groups.where(F.col("image_url").isNotNull() & ~is_junk_slug(slug)).select(F.lit("vinos").alias("bucket"), F.concat(F.lit("/vino/"), slug).alias("path"), F.when(out, "weekly").otherwise("daily").alias("change"), weight.alias("priority"))


def page_entries(pages: DataFrame, kind: str) -> DataFrame:
    """The same of facet pages: "varietals" and "regions" (slug, group_count), "bodegas" (slug, store_count; of two shops or more), "rankings", "vs" and "blog" (slug)."""
    folder = {"varietals": "varietal", "regions": "region", "bodegas": "bodega", "rankings": "ranking", "vs": "vs", "blog": "blog"}[kind]
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    weight = {
        "varietals": lambda: _tier(n("group_count"), [(50, 0.9)], 0.7), "regions": lambda: _tier(n("group_count"), [(50, 0.8)], 0.6), "bodegas": lambda: _tier(n("store_count"), [(10, 0.9), (5, 0.8), (3, 0.7)], 0.5),
        "rankings": lambda: F.lit(0.85), "vs": lambda: F.lit(0.4), "blog": lambda: F.lit(0.7),
    }[kind]()
    rows = pages.where("store_count >= 2") if kind == "bodegas" else pages
    change = {"vs": "weekly", "blog": "monthly"}.get(kind, "daily")
    return rows.where(F.col("slug").isNotNull()).select(F.lit(kind).alias("bucket"), F.concat(F.lit(f"/{folder}/"), F.col("slug").cast("string")).alias("path"), F.lit(change).alias("change"), weight.cast("double").alias("priority"))


def static_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("static", *x) for x in STATIC], "bucket string, path string, change string, priority double")


def bucketed(entries: DataFrame, chunk: int = 10_000) -> DataFrame:
    """The entries, distinct, with their final bucket: wines in vinos-1, vinos-2, ..., others in one named as they are and then name-2, name-3, ... of `chunk` entries each."""
    placed = numbered(entries.dropDuplicates(["bucket", "path"]), [F.col("bucket"), F.col("path")], "__tm_at")
    first = placed.groupBy("bucket").agg(F.min("__tm_at").alias("__tm_first"))  # one row a bucket
    part = F.floor((F.col("__tm_at") - F.col("__tm_first")) / chunk) + 1
    name = F.when((part == 1) & (F.col("bucket") != "vinos"), F.col("bucket")).otherwise(F.concat_ws("-", "bucket", part.cast("string")))
    return placed.join(first, "bucket").select(name.alias("bucket"), "path", "change", "priority")


def documents(entries: DataFrame, base: str, made: str) -> DataFrame:
    """bucket, entries, xml: a document a bucket of `bucketed` entries, in order of address; `made` is the time of the catalogue, as it is shown."""
    said = F.concat(
        F.lit("  <url>\n    <loc>"), xml_escape(F.concat(F.lit(base), F.col("path"))), F.lit(f"</loc>\n    <lastmod>{made}</lastmod>\n    <changefreq>"), F.col("change"),
        F.lit("</changefreq>\n    <priority>"), F.format_string("%.2f", F.col("priority")), F.lit("</priority>\n  </url>"),
    )
    body = entries.groupBy("bucket").agg(F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", said.alias("xml")))), lambda x: x["xml"]), "\n").alias("body"))
    return body.select("bucket", "entries", F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{XMLNS}">\n'), "body", F.lit("\n</urlset>\n")).alias("xml"))


def index(buckets: DataFrame, base: str, made: str) -> DataFrame:
    """xml: the document that names the buckets' documents, in order; one row, a bucket is ten thousand pages."""
    said = F.concat(F.lit(f"  <sitemap>\n    <loc>{base}/sitemap/"), xml_escape(F.col("bucket")), F.lit(f".xml</loc>\n    <lastmod>{made}</lastmod>\n  </sitemap>"))
    body = buckets.select("bucket").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", said.alias("xml")))), lambda x: x["xml"]), "\n").alias("body"))
    return body.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{XMLNS}">\n'), "body", F.lit("\n</sitemapindex>\n")).alias("xml"))


def write(entries: DataFrame, path: str, base: str, made: str, chunk: int = 10_000) -> None:
    """A folder a bucket with one document under `path`/pages, then `path`/index, made from the buckets that are there."""
    spark = entries.sparkSession
    documents(bucketed(entries, chunk), base, made).select("bucket", F.col("xml").alias("value")).write.partitionBy("bucket").option("lineSep", "\n").text(f"{path}/pages")
    there = spark.read.text(f"{path}/pages").select(F.col("bucket").cast("string").alias("bucket")).distinct()
    index(there, base, made).select(F.col("xml").alias("value")).coalesce(1).write.text(f"{path}/index")
