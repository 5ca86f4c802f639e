"""Brands of listings that have none: first from brands named in the name, then from line words that only one brand uses.

The second pass learns from what the first has filled. Neither builds a dictionary in one place: brands are joined to names on the word of theirs
that the fewest names hold, and line words are counted by (word, brand) before they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import wine
from tallymark.functions.text import EDGE, strip_accents

#: Columns of listings that are read: id, ord (orderable, the order in which listings are seen), name, brand.


def _runs(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("([a-z0-9_]+)"), F.lit(1)))


def known_brands(listings: DataFrame, generic: Sequence[str] = (), shortest: int = 3) -> DataFrame:
    """label (lower case), shown (the spelling seen first), first: brands of `shortest` characters or more, without single generic words."""
    shown = F.trim("brand")
    label = F.lower(shown)
    rows = listings.where(F.length(shown) >= shortest).groupBy(label.alias("label")).agg(F.min_by(shown, "ord").alias("shown"), F.min("ord").alias("first"))
    return rows.where(~F.col("label").isin(list(generic) or [""]))


def brand_in_name(listings: DataFrame, known: DataFrame) -> DataFrame:
    """id, found: for each listing without a brand the longest known one (of equals the one seen first) that its name holds between word edges.

    Where a brand stands between word edges each of its runs of letters and digits is one of the name's, so the run that fewest names hold finds
    every candidate; what it finds is compared as a whole. A brand without such a run is never found.
    """
    name = F.lower("name")
    named = listings.where(F.col("brand").isNull() & (F.coalesce("name", F.lit("")) != "")).select("id", name.alias("__tm_name"), F.explode(_runs(name)).alias("__tm_run"))
    held = named.groupBy("__tm_run").agg(F.count("*").alias("__tm_n"))
    posted = known.select("label", "shown", "first", F.explode(_runs(F.col("label"))).alias("__tm_run"))
    # A run that no open name holds rules its brand out: it is posted under it and meets nothing.
    posted = posted.join(held, "__tm_run", "left").groupBy("label", "shown", "first").agg(F.min_by("__tm_run", F.struct(F.coalesce("__tm_n", F.lit(0)), "__tm_run")).alias("__tm_run"))
    pattern = F.concat(F.lit(EDGE + r"\Q"), F.replace(F.col("label"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E" + EDGE))
    met = named.join(posted, "__tm_run").where(F.contains("__tm_name", F.col("label")) & F.rlike("__tm_name", pattern))
    best = F.min_by("shown", F.struct(F.negative(F.length("label")), "first", "label"))
    return met.groupBy("id").agg(best.alias("found"))


def line_words(listings: DataFrame, words: Callable[[Column], Column] = wine.words, least: int = 3, shortest: int = 4) -> DataFrame:
    """word, found: words of `shortest` letters or more that `least` listings of exactly one brand hold, the brand's own words aside."""
    label = F.lower(F.trim("brand"))
    rows = listings.where(F.length(label) >= 3).select("ord", label.alias("label"), F.trim("brand").alias("shown"), F.array_distinct(words(F.col("name"))).alias("words"))
    shown = rows.groupBy("label").agg(F.min_by("shown", "ord").alias("shown"))
    own = F.filter(F.split("label", r"\s+"), lambda w: F.length(w) >= 3)
    counted = rows.select("label", F.explode(F.array_except("words", own)).alias("word")).where(F.length("word") >= shortest).groupBy("word", "label").agg(F.count("*").alias("n"))
    alone = counted.groupBy("word").agg(F.count("*").alias("brands"), F.max("n").alias("n"), F.min("label").alias("label")).where((F.col("brands") == 1) & (F.col("n") >= least))
    return alone.join(shown, "label").select("word", F.col("shown").alias("found"))


def brand_of_line(listings: DataFrame, lines: DataFrame, words: Callable[[Column], Column] = wine.words) -> DataFrame:
    """id, found: the brand of the first line word in the name of each listing without a brand."""
    own = listings.where(F.col("brand").isNull()).select("id", F.posexplode(words(F.col("name"))).alias("__tm_at", "word"))
    return own.join(lines, "word").groupBy("id").agg(F.min_by("found", "__tm_at").alias("found"))


def infer_brands(listings: DataFrame, generic: Sequence[str] = (), words: Callable[[Column], Column] = wine.words) -> DataFrame:
    """The listings with brands filled in by both passes, and brand_from: own, name, line or null.

    Edge cases: an empty brand counts as none; a null or empty name gets none; an empty table stays empty; repeated ids share what is found for any of them.
    """
    rows = listings.withColumn("brand", F.nullif(F.trim("brand"), F.lit(""))).withColumn("brand_from", F.when(F.col("brand").isNotNull(), F.lit("own")))

    def fill(rows: DataFrame, found: DataFrame, origin: str) -> DataFrame:
        out = rows.join(found, "id", "left")
        take = F.col("brand").isNull() & F.col("found").isNotNull()
        return out.withColumn("brand_from", F.when(take, F.lit(origin)).otherwise(F.col("brand_from"))).withColumn("brand", F.coalesce("brand", "found")).drop("found")

    rows = fill(rows, brand_in_name(rows, known_brands(rows, generic)), "name")
    return fill(rows, brand_of_line(rows, line_words(rows, words), words), "line")


def forced_brand(name: Column, leading: Sequence[str] = ()) -> Column:
    """What a name is compared with prefixes as: plain, without up to two leading words of `leading`."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(name)), r"[^a-z0-9\s.]", " "), r"\s+", " "))
    for _ in range(2 if leading else 0):
        plain = F.regexp_replace(plain, rf"^(?:{'|'.join(leading)})\s+", "")
    return plain
