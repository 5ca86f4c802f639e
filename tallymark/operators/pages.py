"""What the catalogue's pages put together: facet pages, brand indexes, popular pairs, favourites, charts and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.wine import brand_slug, display_brand
from tallymark.operators.stats import page_items, top_k


def facet_brands(groups: DataFrame, pages: DataFrame, column: str, first: int = 48, most: int = 8) -> DataFrame:
    """page, rank, brand, slug, n: the brands that occur most among the first groups of each facet page, those with a page (slug) of their own only."""
    items = page_items(groups, column, first).select("page", "group_slug")
    named = items.join(groups.select("group_slug", "brand").where("brand is not null"), "group_slug").groupBy("page", "brand").agg(F.count("*").alias("n"))
    linked = named.withColumn("slug", brand_slug(F.col("brand"))).join(pages.select("slug").distinct(), "slug", "left_semi")
    return top_k(linked, ["page"], [F.desc("n"), F.col("brand")], most).select("page", "rank", "brand", "slug", "n")


def facet_lists(groups: DataFrame, column: str, first: int = 48, several: int = 30, single: int = 16) -> DataFrame:
    """page, list (several or single), place, group_slug: a facet page's first groups, parted into those of several stores and of one."""
    items = page_items(groups, column, first)
    kind = F.when(F.col("store_count") >= 2, "several").when(F.col("store_count") == 1, "single")
    parted = items.withColumn("list", kind).where("list is not null")
    place = F.row_number().over(Window.partitionBy("page", "list").orderBy("rank"))
    return parted.withColumn("place", place).where(F.col("place") <= F.when(F.col("list") == "several", several).otherwise(single)).select("page", "list", "place", "group_slug")


def brand_index(pages: DataFrame, sort: str = "stores", least_stores: int = 2) -> DataFrame:
    """Brand pages (slug, name, group_count, store_count) of `least_stores` stores or more, by stores, groups or name."""
    orders = {"stores": [F.desc("store_count"), F.desc("group_count")], "groups": [F.desc("group_count"), F.desc("store_count")], "name": [F.expr("name collate es")]}
    if sort not in orders:
        raise ValueError(f"sort must be one of {tuple(orders)}")
    return pages.where(F.col("store_count") >= least_stores).orderBy(*orders[sort], "slug")


def popular_pairs(pairs: DataFrame, groups: DataFrame, most: int = 8) -> DataFrame:
    """The first pairs (slug_a, slug_b, total_store_count) with both names; a pair with a side that is gone is left out."""
    top = pairs.orderBy(F.desc("total_store_count"), "slug_a", "slug_b").limit(most)
    side = lambda x: groups.select(F.col("group_slug").alias(f"slug_{x}"), F.col("name").alias(f"name_{x}"))
    return top.join(side("a"), "slug_a").join(side("b"), "slug_b").select("slug_a", "slug_b", "name_a", "name_b", "total_store_count")


def favourite_drops(favourites: DataFrame, drops: DataFrame) -> DataFrame:
    """The drops (slug, ...) of groups that are somebody's favourites (slug)."""
    return drops.join(favourites.select("slug").distinct(), "slug", "left_semi")


def favourites_missing(favourites: DataFrame, groups: DataFrame) -> DataFrame:
    """Favourites (slug) that the catalogue no longer has."""
    return favourites.join(groups.select(F.col("group_slug").alias("slug")), "slug", "left_anti")


def first_values(rows: DataFrame, key: str, column: str, order: str, most: int = 3) -> DataFrame:
    """key and `column`: the distinct values of an array column over a key's rows, in order of first occurrence, `most` at most."""
    seen = rows.select(key, order, F.posexplode(column).alias("at", "value")).groupBy(key, "value").agg(F.min(F.struct(order, "at")).alias("first"))
    kept = top_k(seen, [key], [F.col("first"), F.col("value")], most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v")).select(key, F.col("v.value").alias(column))


def chart_points(history: DataFrame, width: float = 600, height: float = 100, padding: float = 8) -> DataFrame:
    """slug, date, x, y: a slug's prices scaled into a box, the dearest on top; one price lies in the middle."""
    own = Window.partitionBy("slug")
    rows = history.select("slug", "date", "min", (F.row_number().over(own.orderBy("date")) - 1).alias("i"), F.count("*").over(own).alias("n"), F.min("min").over(own).alias("low"), F.max("min").over(own).alias("high"))
    x = F.when(F.col("n") == 1, F.lit(width / 2)).otherwise(padding + F.try_divide(F.col("i") * (width - 2 * padding), F.col("n") - 1))
    y = height - padding - (F.col("min") - F.col("low")) / F.greatest(F.lit(1.0), F.col("high") - F.col("low")) * (height - 2 * padding)
    return rows.select("slug", "date", x.alias("x"), y.alias("y"))


def valid_until(day: Column, hours: int = 24) -> Column:
    """Until when a price of a day (or moment) counts."""
    return day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))


def embedding_text(name: Column, brand: Column, varietals: Column) -> Column:
    """What stands for a group in a vector space: name, brand and varietals, whichever there are."""
    return F.concat_ws(" — ", name, F.nullif(brand, F.lit("")), F.when(F.size(varietals) > 0, F.array_join(varietals, " ")))


def payload(rows: DataFrame, key: str) -> DataFrame:
    """key and json of each row, as an export or an answer carries it; nulls are kept."""
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(key, F.to_json(columns, {"ignoreNullFields": "false"}).alias("json"))


def shown(groups: DataFrame) -> DataFrame:
    """group_slug, name, brand (as shown) and price range: the projection that lists and cards use."""
    return groups.select("group_slug", "name", display_brand(F.col("brand")).alias("brand"), "min_price", "max_price", "store_count")


def write_snapshot(groups: DataFrame, offers: DataFrame, path: str) -> None:
    """The whole catalogue, over what lay there before; raw products aren't kept, since offers hold what is asked for."""
    for name, rows in (("groups", groups), ("offers", offers)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(rows: DataFrame, path: str, most: int, order: list[Column], **facts) -> None:
    """A report as JSON lines: the first `most` rows in order, each with the facts (time, thresholds) that it was made with."""
    capped = rows.orderBy(*order).limit(most)
    capped.select(*[F.lit(v).alias(k) for k, v in facts.items()], *[F.col(f"`{c}`") for c in capped.columns]).write.mode("overwrite").json(path)


def read_document(spark, path: str, schema: str) -> DataFrame:
    """A JSON file that is one document or one array (snapshot, stores, scores, regions)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
