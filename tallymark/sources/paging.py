"""Which pages of a shop's listing count: a crawl reads on until a page says that nothing follows.

Pages of a shop are few (a crawler has a last page), its items many: items meet by (shop, address) and by (shop, page) as counts, and only counts of pages
stand in a shop's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_verdicts(pages: DataFrame, items: DataFrame, full: int | None = None, last_page: int | None = None) -> DataFrame:
    """store_slug, page, items, new, counts, reason of each page (store_slug, page, ok) with its items (store_slug, page, external_url).

    `new` is the number of addresses no earlier page has. A page ends its shop's list if it failed ("failed"), has no item ("empty"), none that is new ("nothing new"), or, with `full`,
    fewer than so many ("short"; its items count). What follows has reason "after end" and does not count, nor does what lies behind a page that
    was not fetched ("gap") or beyond `last_page`. Items without an address are left out; a page that comes twice is one, and failed if either was.
    """
    own = items.where(F.col("external_url").isNotNull()).select("store_slug", "page", "external_url").distinct()
    first = own.groupBy("store_slug", "external_url").agg(F.min("page").alias("page")).groupBy("store_slug", "page").agg(F.count("*").alias("new"))
    counts = own.groupBy("store_slug", "page").agg(F.count("*").alias("items"))
    known = pages.groupBy("store_slug", "page").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    rows = known.join(counts, ["store_slug", "page"], "left").join(first, ["store_slug", "page"], "left").fillna(0, ["items", "new"])
    stop = F.when(~F.col("ok"), "failed").when(F.col("items") == 0, "empty").when(F.col("new") == 0, "nothing new")
    if full is not None:
        stop = stop.when(F.col("items") < full, "short")
    order = Window.partitionBy("store_slug").orderBy("page")
    before = F.max(F.col("stop").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("stop", stop).withColumn("ended", F.coalesce(before, F.lit(False))).withColumn("gap", F.row_number().over(order) != F.col("page"))
    late = F.lit(False) if last_page is None else F.col("page") > last_page
    reason = F.when(F.col("ended"), "after end").when(F.col("gap"), "gap").when(late, "beyond last").otherwise(F.col("stop"))
    return rows.select("store_slug", "page", "items", "new", (reason.isNull() | (reason == "short")).alias("counts"), reason.alias("reason"))


def listed(items: DataFrame, verdicts: DataFrame, order: str = "ord") -> DataFrame:
    """The items of pages that count, one an address: that of the earliest page, and there of the least `order`; with their columns as they were."""
    good = items.where(F.col("external_url").isNotNull()).join(verdicts.where("counts").select("store_slug", "page"), ["store_slug", "page"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("store_slug", "external_url").orderBy("page", order))
    return good.withColumn("__tm_n", rank).where("__tm_n = 1").drop("__tm_n").select(items.columns)
