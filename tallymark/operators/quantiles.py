"""Exact order statistics per key by refinement: no task ever holds a key's values.

A round cuts the range of each key in which the wanted rank lies into bins, counts them, and keeps the bin that holds the rank, with the least and
largest value in it as the next range. Bins are equal parts of the range, so it shrinks by their number each round (the order of values and of
bins agree, since subtracting, dividing and rounding down keep order), until the bin holds one distinct value. Counts are added up before they are
shuffled: a round moves at most `bins` rows a key and task, however many values there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import staged


def at_ranks(rows: DataFrame, key: str, value: str, ranks: Sequence[Column], bins: int = 2_048) -> DataFrame:
    """key, n (values) and at, an array of the values at `ranks` (columns over n, from 0; null or outside: null), of each key.

    Null and NaN values are left out and a key without others has no row; a null key is one of its own; infinities have their places.
    """
    own = staged(rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"), "ranks-values")
    sizes = staged(own.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "ranks-sizes")
    wanted = F.transform(F.array(*ranks), lambda r: r.cast("long"))
    state = sizes.select("k", "lo", "hi", "n", F.posexplode(wanted).alias("place", "rank")).where("rank between 0 and n - 1").drop("n")
    state = staged(state.withColumn("open", F.col("lo") < F.col("hi")), "ranks")
    while not state.where("open").isEmpty():
        ask = state.where("open").select(F.col("k").alias("__k"), "place", "rank", "lo", "hi")
        met = own.join(ask, F.col("k").eqNullSafe(F.col("__k"))).where("x between lo and hi")
        # Halves where the difference itself would be infinite; infinite ends are bins of their own. Both ends of a range always part, so each round gains.
        low, high = F.greatest("lo", F.lit(-1.7976931348623157e308)), F.least("hi", F.lit(1.7976931348623157e308))
        share = F.when(high - low == float("inf"), (F.col("x") / 2 - low / 2) / (high / 2 - low / 2)).otherwise((F.col("x") - low) / F.nullif(high - low, F.lit(0.0)))
        part = F.floor(share * (bins - 3)).cast("long") + 1
        bin_ = F.when(F.col("x") == float("-inf"), 0).when(F.col("x") == float("inf"), bins - 1).otherwise(F.coalesce(part, F.lit(1)))
        counted = met.groupBy("__k", "place", "rank", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("__k", "place").orderBy("bin"))
        kept = counted.withColumn("upto", upto).where("rank < upto and rank >= upto - n")
        kept = kept.select(F.col("__k").alias("k"), "lo", "hi", "place", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.col("lo") < F.col("hi")).alias("open"))
        state = staged(state.where("not open").select(kept.columns).unionByName(kept), "ranks")
    found = state.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("lo").alias("x")))).alias("found"))  # one entry a wanted rank
    out = sizes.select("k", "n").join(found.withColumnRenamed("k", "__k"), F.col("k").eqNullSafe(F.col("__k")), "left")
    values = F.array(*[F.try_element_at("found", F.lit(i)) for i in range(len(ranks))])
    return out.select(F.col("k").alias(key), "n", values.alias("at"))


def medians(rows: DataFrame, key: str, value: str, whole_even: bool = False) -> DataFrame:
    """key, n, median: the middle value, or the mean of the middle two; with `whole_even` that mean is rounded to a whole number, halves up."""
    n = F.col("n")
    out = at_ranks(rows, key, value, [F.floor((n - 1) / 2), F.floor(n / 2)])
    low, high = F.get("at", F.lit(0)), F.get("at", F.lit(1))
    mean = F.when(low == high, low).otherwise((low + high) / 2)
    return out.select(key, "n", (F.when(n % 2 == 0, F.floor((low + high) / 2 + 0.5).cast("double")).otherwise(low) if whole_even else mean).alias("median"))
