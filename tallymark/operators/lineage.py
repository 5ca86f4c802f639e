"""Where groups went: slugs change as stages and later runs merge and split groups; what refers to an old slug follows it.

An event (t, stage, old, new) says that at time t what `old` named is named `new` from then on; t grows over stages and runs. A slug
leaves at most once at one time, but may come back later and leave again, so an event leads on to the next departure of its new slug after its own
time. Times only grow along that relation, which rules out cycles; pointer doubling follows it in as many rounds as
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import staged


def compress(events: DataFrame) -> DataFrame:
    """The events with `final`, the slug at the end of each one's chain, and `hops`, the events on it.

    Of several events of one old slug at one time the smallest (stage, new) counts; those that name a null slug or lead to their own slug are left out.
    """
    own = events.where(F.col("old").isNotNull() & F.col("new").isNotNull() & F.col("t").isNotNull() & (F.col("old") != F.col("new")))
    own = own.groupBy("t", "old").agg(F.min(F.struct("stage", "new")).alias("to")).select("t", F.col("to.stage").alias("stage"), "old", F.col("to.new").alias("new"))
    own = staged(own, "lineage")
    # Arrivals at a slug and departures from it, by slug: an arrival leads to the next later departure.
    both = own.select(F.col("new").alias("slug"), "t", F.lit(False).alias("leaves"), F.col("old").alias("from")).unionByName(own.select(F.col("old").alias("slug"), "t", F.lit(True).alias("leaves"), F.lit(None).cast(own.schema["old"].dataType).alias("from")))
    ahead = Window.partitionBy("slug").orderBy("t").rangeBetween(1, Window.unboundedFollowing)
    upcoming = both.withColumn("next_t", F.min(F.when(F.col("leaves"), F.col("t"))).over(ahead)).where(~F.col("leaves"))
    links = upcoming.select(F.col("from").alias("old"), "t", F.when(F.col("next_t").isNotNull(), F.col("slug")).alias("next_old"), "next_t")
    state = staged(own.join(links, ["old", "t"]).withColumn("final", F.col("new")).withColumn("hops", F.lit(1).cast("long")), "lineage")
    while not state.where(F.col("next_t").isNotNull()).isEmpty():
        far = state.select(F.col("old").alias("next_old"), F.col("t").alias("next_t"), F.col("final").alias("far_final"), F.col("hops").alias("far_hops"), F.col("next_old").alias("far_old"), F.col("next_t").alias("far_t"))
        open_rows = state.where(F.col("next_t").isNotNull()).join(far, ["next_old", "next_t"])
        open_rows = open_rows.select("old", "t", "stage", "new", F.col("far_old").alias("next_old"), F.col("far_t").alias("next_t"), F.col("far_final").alias("final"), (F.col("hops") + F.col("far_hops")).alias("hops"))
        state = staged(state.where(F.col("next_t").isNull()).select(open_rows.columns).unionByName(open_rows), "lineage")
    return state.select("t", "stage", "old", "new", "final", "hops")


def follow(rows: DataFrame, compressed: DataFrame, slug: str = "slug", at: Column | None = None, into: str | None = None) -> DataFrame:
    """`rows` with the present slug of each one's `slug`, which it bore at time `at` (null: before all events), in place of it or as `into`.

    A slug's departures, one a run at most, come as one array; rows of a slug that never left keep it, and no row is dropped or repeated.
    """
    left = compressed.groupBy(F.col("old").alias("__tm_old")).agg(F.array_sort(F.collect_list(F.struct("t", "final"))).alias("__tm_left"))
    joined = rows.join(left, F.col(slug) == F.col("__tm_old"), "left")
    when = F.coalesce(at if at is not None else F.lit(None), F.lit(-(1 << 62))).cast("long")
    later = F.get(F.filter("__tm_left", lambda x: x["t"] > when), F.lit(0))["final"]
    return joined.withColumn(into or slug, F.coalesce(later, F.col(slug))).drop("__tm_old", "__tm_left")


def follow_history(history: DataFrame, compressed: DataFrame, at: Column | None = None) -> DataFrame:
    """Price history (slug, date, min, stores) under present slugs; days that meet keep the lowest price and the larger number of stores."""
    return follow(history, compressed, at=at).groupBy("slug", "date").agg(F.min("min").alias("min"), F.max("stores").alias("stores"))


def follow_favourites(lists: DataFrame, compressed: DataFrame, at: Column | None = None) -> DataFrame:
    """Favourites (user, pos, slug) under present slugs; of several that became one the first place stays, and places are numbered anew."""
    rows = follow(lists, compressed, at=at).groupBy("user", "slug").agg(F.min("pos").alias("pos"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("user").orderBy("pos", "slug")))
