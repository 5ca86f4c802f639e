"""Aggregates over offers and groups.

Offers have group_slug, store_slug, name, price, in_stock, is_collector, image_url, sku, ord; groups have group_slug, name,
brand, type, region, varietals, store_count, offer_count, min_price, max_price. `ord` is a deterministic
order within a group, which stands for "first seen".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import edged
from tallymark.operators.quantiles import medians
from tallymark.functions.wine import brand_key, brand_slug, display_brand

# Offers of several bottles, and brands that are no wine.
CASE_WORDS = "(?iu)" + edged(r"\b(estuche|caja\b|cajas\b|caj[ìí]n|pack|gift\s*box|6\s*pack|six\s*pack|x\s*[2-9][0-9]*\b|x[2-9][0-9]*\b)")
SPIRITS = r"(?i)smirnoff|absolut|glen|johnnie|chivas|jack\s+daniels|ballantine|jameson|bombay|gordon|tanqueray|beefeater|bacardi|captain\s+morgan|malibu|baileys|campari|aperol|fernet|martini|cinzano|red\s+bull"


def priced() -> Column:
    return F.coalesce(F.col("price") > 0, F.lit(False))


def live() -> Column:
    return F.col("in_stock") & priced()


def plain() -> Column:
    return live() & ~F.coalesce("is_collector", F.lit(False))


def heal(offers: DataFrame, least: float = 1000) -> DataFrame:
    """Offers without a price, or with one below `least`, are not in stock."""
    return offers.withColumn("in_stock", F.col("in_stock") & F.coalesce(F.col("price") >= least, F.lit(False)))


def active_only(offers: DataFrame, stores: DataFrame) -> DataFrame:
    return offers.join(stores.select("store_slug").distinct(), "store_slug", "left_semi")


def _by_store(offers: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """A row a group and store: `all` offers, and by kind how many (n_), the lowest (lo_) and the highest price (hi_).

    Stores are then counted as rows that have some of a kind, where several distinct counts would expand each offer.
    """
    marks = [x for k, c in kinds.items() for x in (F.count_if(c).alias(f"n_{k}"), F.min(F.when(c & priced(), F.col("price"))).alias(f"lo_{k}"), F.max(F.when(c & priced(), F.col("price"))).alias(f"hi_{k}"))]
    return offers.groupBy("group_slug", "store_slug").agg(F.count("*").alias("all"), *marks)


def _of_kind(k: str, store: Column) -> list[Column]:
    return [F.sum(f"n_{k}").alias(f"n_{k}"), F.min(f"lo_{k}").alias(f"lo_{k}"), F.max(f"hi_{k}").alias(f"hi_{k}"), F.count_if((F.col(f"n_{k}") > 0) & store.isNotNull()).alias(f"s_{k}")]


def group_stats(offers: DataFrame) -> DataFrame:
    """Per group: offers, offers in stock, stores and price range over those in stock with a price."""
    rows = _by_store(offers, {"live": live()}).groupBy("group_slug").agg(F.sum("all").alias("offer_count"), *_of_kind("live", F.col("store_slug")))
    return rows.select("group_slug", "offer_count", F.col("n_live").alias("in_stock_offer_count"), F.col("s_live").alias("store_count"), F.col("lo_live").alias("min_price"), F.col("hi_live").alias("max_price"))


def group_stats_fallback(offers: DataFrame, bases: Sequence[Column] | None = None) -> DataFrame:
    """Price range over the first of `bases` that holds an offer: in stock and no collector's item, else in stock, else priced."""
    kinds = {f"k{k}": c for k, c in enumerate(bases or (plain(), live(), priced()))}
    rows = _by_store(offers, kinds).groupBy("group_slug").agg(*[x for k in kinds for x in _of_kind(k, F.col("store_slug"))])

    def first(prefix: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.col(f"{prefix}_{k}")) for k in kinds])

    basis = F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.lit(n)) for n, k in enumerate(kinds)])
    return rows.select("group_slug", basis.alias("basis"), first("lo").alias("min_price"), first("hi").alias("max_price"), F.coalesce(first("s"), F.lit(0)).alias("store_count"))


def bottle_stats(offers: DataFrame, stats: DataFrame, least: float = 1000) -> DataFrame:
    """Range and stores over single bottles: those in stock, else all priced ones; the group's own where there is no bottle."""
    is_case = F.coalesce(F.col("name").rlike(CASE_WORDS), F.lit(False))
    bottle = ~is_case & ~F.coalesce("is_collector", F.lit(False)) & ~(priced() & (F.col("price") < least))
    rows = _by_store(offers, {"case": is_case, "any": bottle, "on": bottle & F.col("in_stock")})
    rows = rows.groupBy("group_slug").agg(F.max(F.col("n_case") > 0).alias("has_cases"), *_of_kind("any", F.col("store_slug")), *_of_kind("on", F.col("store_slug")))
    rows = rows.join(stats.select("group_slug", "min_price", "max_price", "store_count"), "group_slug")
    pick = lambda own, on, any_, none: F.when(F.col("n_any") == 0, F.col(own)).when(F.col("lo_on").isNotNull(), F.col(on)).when(F.col("lo_any").isNotNull(), F.col(any_)).otherwise(none)
    return rows.select("group_slug", pick("min_price", "lo_on", "lo_any", None).alias("min_price"), pick("max_price", "hi_on", "hi_any", None).alias("max_price"), pick("store_count", "s_on", "s_any", 0).alias("store_count"), "has_cases")


def snapshot_totals(offers: DataFrame, groups: DataFrame) -> DataFrame:
    branded = offers.join(groups.select("group_slug", "brand"), "group_slug", "left")
    return branded.agg(F.count("*").alias("offers"), F.count_if(F.col("in_stock")).alias("in_stock"), F.count_if(priced()).alias("with_price"), F.count_if(F.col("brand").isNotNull()).alias("with_brand"), F.countDistinct("store_slug").alias("stores"))


# -- facets --------------------------------------------------------------------------------------------------------------


def facet_counts(groups: DataFrame, column: str, alias: str = "value") -> DataFrame:
    """Groups per value; array columns count once per element."""
    value = F.explode(column) if groups.schema[column].dataType.typeName() == "array" else F.col(column)
    return groups.select(value.alias(alias)).where(F.col(alias).isNotNull()).groupBy(alias).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each partition; Spark keeps k a task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_brands(groups: DataFrame, offers: DataFrame, limit: int = 12, share: float = 0.4, banned: str = SPIRITS) -> DataFrame:
    """Brands by stores, then offers, then name: those whose offers mostly belong to groups with a varietal or a table type. Spellings of a brand are one."""
    tagged = groups.where(F.col("brand").isNotNull() & (F.trim("brand") != "") & ~F.col("brand").rlike(banned))
    tagged = tagged.select("group_slug", brand_key(F.col("brand")).alias("key"), ((F.size("varietals") > 0) | F.coalesce(F.col("type").isin("Tinto", "Blanco"), F.lit(False))).alias("good"))
    # Offers are summed by (group, store) first, so the wide shuffle carries a row a pair and stores are counted without expanding offers.
    pairs = offers.groupBy("group_slug", "store_slug").agg(F.count("*").alias("n"))
    rows = pairs.join(tagged, "group_slug").groupBy("key", "store_slug").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"))
    rows = rows.groupBy("key").agg(F.sum("n").alias("offer_count"), F.count("*").alias("store_count"), F.sum("good").alias("good"))
    rows = rows.where(F.col("good") >= share * F.col("offer_count")).select(display_brand(F.col("key")).alias("brand"), "offer_count", "store_count")
    return rows.orderBy(F.desc("store_count"), F.desc("offer_count"), "brand").limit(limit)


def brand_pages(groups: DataFrame, offers: DataFrame, least: int = 3) -> DataFrame:
    """One page a brand with at least `least` groups, by slug, under its longest shown name; spirits have no page."""
    own = groups.where(F.col("brand").isNotNull() & ~F.col("brand").rlike(SPIRITS)).withColumn("slug", brand_slug(F.col("brand"))).where("slug is not null").withColumn("shown", display_brand(F.col("brand")))
    base = own.groupBy("slug").agg(F.count("*").alias("group_count"), F.sum("offer_count").alias("offer_count"), F.countDistinct("region").alias("regions"), F.max_by("shown", F.struct(F.length("shown"), "shown")).alias("name")).where(F.col("group_count") >= least)
    stores = offers.select("group_slug", "store_slug").distinct().join(own.select("group_slug", "slug"), "group_slug").groupBy("slug").agg(F.countDistinct("store_slug").alias("store_count"))
    return base.join(stores, "slug", "left").withColumn("store_count", F.coalesce("store_count", F.lit(0)))


def page_items(groups: DataFrame, column: str, k: int) -> DataFrame:
    """The k groups of each facet value with most stores, then the lowest price."""
    rows = groups.where(F.col(column).isNotNull()).select(F.col(column).alias("page"), "group_slug", "store_count", "min_price")
    return top_k(rows, ["page"], [F.desc("store_count"), F.col("min_price").asc_nulls_last(), F.col("group_slug")], k)


def market_distribution(groups: DataFrame, column: str, least: int = 1, limit: int | None = None) -> DataFrame:
    """Groups, share of all and median of the lowest price per value."""
    rows = groups.where(F.col("min_price") > 0).select(F.col(column).alias("value"), "min_price")
    total = rows.agg(F.count("*").alias("total"))
    out = medians(rows.where("value is not null"), "value", "min_price").where(F.col("n") >= least)
    out = out.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), F.round("median").alias("median_price"))  # one row
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


#: What the public statistics leave out: a grape's name that two grapes share.
AMBIGUOUS = ["Cabernet"]


def market_slices(groups: DataFrame, kind: str) -> DataFrame:
    """name, count, pct, median_price of groups with a price and two stores or more, by first "varietal" (the 12 largest, ambiguous ones aside), "region" (three or more) or "type" (no median).

    pct is of all such groups; an even number of prices has the rounded mean of its middle two. Ties of counts go by name.
    """
    real = groups.where((F.col("min_price") > 0) & (F.col("store_count") >= 2))
    value = F.get("varietals", F.lit(0)) if kind == "varietal" else F.col(kind)
    rows = real.select(value.alias("name"), "min_price").where(F.coalesce(F.col("name"), F.lit("")) != "")
    if kind == "varietal":
        rows = rows.where(~F.col("name").isin(AMBIGUOUS))
    total = real.agg(F.count("*").alias("total"))  # one row
    counted = rows.groupBy("name").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("median")) if kind == "type" else medians(rows, "name", "min_price", whole_even=True)
    out = counted.where(F.col("n") >= (3 if kind == "region" else 1)).crossJoin(F.broadcast(total)).select("name", F.col("n").alias("count"), (F.col("n") / F.col("total")).alias("pct"), F.col("median").alias("median_price"))
    return out.orderBy(F.desc("count"), "name").limit(12) if kind == "varietal" else out


def price_bands(groups: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Groups per half-open price band; empty bands stay."""
    spark = groups.sparkSession
    bands = spark.createDataFrame([(k, float(a), float(b) if b is not None else None) for k, (a, b) in enumerate(zip(edges, [*edges[1:], None]))], "band int, low double, high double")
    inside = F.lit(None).cast("int")
    for k, edge in enumerate(edges):
        inside = F.when(F.col("min_price") >= edge, F.lit(k)).otherwise(inside)
    counted = groups.where(F.col("min_price") > 0).groupBy(inside.alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counted, "band", "left").select("band", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


# -- first seen --------------------------------------------------------------------------------------------------------------


def mode_first_seen(rows: DataFrame, key: str, value: str, order: str = "ord", k: int = 1) -> DataFrame:
    """The k most frequent values of a key; ties go to the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return top_k(counted, [key], [F.desc("n"), F.col("first"), F.col(value)], k).drop("first")


def first_present(rows: DataFrame, key: str, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """The first non-null value of each column, and the shortest name."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def shortest(rows: DataFrame, key: str, column: str, order: str = "ord") -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(column, F.struct(F.length(column), order)).alias(column))


def distinctive_tokens(rows: DataFrame, tokens: str, brand: str, least: int = 3) -> DataFrame:
    """Tokens that occur in `least` rows or more, all of one brand."""
    return rows.select(F.explode(tokens).alias("token"), brand).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct(brand).alias("brands"), F.min(brand).alias("brand")).where((F.col("brands") == 1) & (F.col("n") >= least)).select("token", "brand", "n")


def splitter_tokens(rows: DataFrame, key: str, tokens: str, low: float = 0.1, high: float = 0.75, least: int = 3) -> DataFrame:
    """Tokens held by more than a few but not most of a group's offers."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    held = rows.select(key, F.explode(F.array_distinct(F.col(tokens))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return held.join(sizes, key).where((F.col("n") >= F.greatest(F.lit(least), F.ceil(low * F.col("size")))) & (F.col("n") <= F.floor(high * F.col("size"))))


def union_first_wins(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All tables one after the other; of equal keys the row of the earliest table, and there of the smallest row, stays."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("__tm_table", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    columns = [c for c in out.columns if c != "__tm_table"]
    w = Window.partitionBy(key).orderBy("__tm_table", *columns)
    return out.withColumn("__tm_n", F.row_number().over(w)).where("__tm_n = 1").drop("__tm_n", "__tm_table")


def cheapest_wins(rows: DataFrame, by: Sequence[str], order: str = "ord") -> DataFrame:
    """One row of equal (store, url, name): the first, unless it has a price and a strictly lower one follows."""
    w = Window.partitionBy(*by)
    first_price = F.min_by("price", order).over(w)
    rank = F.row_number().over(w.orderBy(F.when(first_price.isNotNull(), F.col("price")).asc_nulls_last(), F.col(order)))
    return rows.withColumn("__tm_n", rank).where("__tm_n = 1").drop("__tm_n")
