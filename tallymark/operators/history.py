"""Price history: upserts, rolling buffers, drops and as-of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.wine import may_drop


def upsert_today(history: DataFrame, today: DataFrame, keep: int = 30, max_age: int = 31) -> DataFrame:
    """slug, date, min, stores: a slug's row of a day is replaced by the newest run; the last `keep` days of slugs seen within `max_age` days stay."""
    rows = history.withColumn("run", F.lit(0)).unionByName(today.withColumn("run", F.lit(1)))
    latest = rows.groupBy("slug", "date").agg(F.max_by(F.struct("min", "stores"), F.struct("run", "min")).alias("r")).select("slug", "date", "r.*")
    return rolling(latest, keep, max_age)


def rolling(history: DataFrame, keep: int = 30, max_age: int | None = None) -> DataFrame:
    """The last `keep` entries of each slug."""
    w = Window.partitionBy("slug").orderBy(F.desc("date"))
    out = history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    if max_age is not None:
        newest = history.agg(F.max("date").alias("newest"))  # one row
        last = F.max("date").over(Window.partitionBy("slug"))
        out = out.withColumn("last", last).crossJoin(F.broadcast(newest)).where(F.col("last") >= F.date_sub("newest", max_age)).drop("last", "newest")
    return out.drop("rn")


def prune(history: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of slugs that are still in the catalogue."""
    return history.join(groups.select(F.col("group_slug").alias("slug")), "slug", "left_semi")


def price_drops(history: DataFrame, groups: DataFrame, low: float = 0.15, high: float = 0.70, least_price: float = 1500, entries: int = 7, limit: int | None = 50, offers: DataFrame | None = None, rounded: bool = False) -> DataFrame:
    """Last price against the median of the priced ones among the `entries` entries before it, for groups of two stores or more whose name holds no word of other drinks.

    With `offers`, only groups that have an offer in stock that is no collector's item. `rounded` holds the drop as it is shown, to a tenth of a percent, against `low` and `high`: 70.04 % then is a drop of 70 %.
    """
    w = Window.partitionBy("slug").orderBy(F.desc("date"))
    rows = history.select("slug", "date", "min", F.row_number().over(w).alias("rn"))
    found = rows.where(F.col("rn") <= entries + 1).groupBy("slug").agg(F.count("*").alias("n"), F.max(F.when(F.col("rn") == 1, F.col("min"))).alias("current_price"), F.max("date").alias("last_date"), F.median(F.when((F.col("rn") > 1) & (F.col("min") > 0), F.col("min"))).alias("median_price"))
    found = found.where((F.col("n") >= entries) & (F.col("median_price") > 0)).withColumn("raw", (F.col("median_price") - F.col("current_price")) / F.col("median_price"))
    found = found.withColumn("drop_pct", F.round(F.col("raw") * 1000) / 1000)
    found = found.where(F.col("drop_pct" if rounded else "raw").between(low, high) & (F.col("current_price") >= least_price))
    fit = groups.where((F.col("store_count") >= 2) & (F.col("in_stock_offer_count") > 0) & may_drop(F.col("name")))
    out = found.join(fit.select(F.col("group_slug").alias("slug"), "brand", "store_count"), "slug")
    if offers is not None:
        plain = offers.where(F.col("in_stock") & ~F.coalesce("is_collector", F.lit(False))).select(F.col("group_slug").alias("slug"))
        out = out.join(plain, "slug", "left_semi")
    out = out.select("slug", "brand", "current_price", "median_price", "drop_pct", "store_count", "last_date")
    return out.orderBy(F.desc("drop_pct"), "slug").limit(limit) if limit else out


def as_of(history: DataFrame, days: int = 7) -> DataFrame:
    """Change of the last price against the last entry `days` days or more before it, else the first; slugs with two entries or more."""
    last = F.max("date").over(Window.partitionBy("slug"))
    rows = history.withColumn("last", last).withColumn("early", F.col("date") <= F.date_sub("last", days))
    out = rows.groupBy("slug").agg(F.count("*").alias("n"), F.max_by("min", "date").alias("now"), F.coalesce(F.max_by("min", F.when(F.col("early"), F.col("date"))), F.min_by("min", "date")).alias("then"))
    return out.where((F.col("n") >= 2) & (F.col("then") > 0)).select("slug", "now", "then", F.round((F.col("now") - F.col("then")) / F.col("then") * 100, 4).alias("change_pct"))
