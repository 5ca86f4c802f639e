"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, -ln(u) / quality, from a hash of its doc_id, so reruns agree and documents of
higher quality tend to come first. Sources in code point order (null last) weigh `weights`, repeating, and share as
many words as the input has; a target stops at `most` times its source's size and the excess is shared anew by weight. A
source's target is met by complete epochs of all its documents, then by the documents of smallest key until the next one
would move the sum away from the target.

Documents are ordered by key, doc_id (null first) and size; rows equal in all three are interchangeable, and as many of them enter as fit.
No task sees a whole source: keys are counted in 65,536 bins, prefix sums over a source's bins find the one in which
its budget ends, and only that bin is sorted. What comes back to the documents is one row a source.

Edge cases: a null or empty text has size 0 and takes 0 words. Null is a source like any other, and a null doc_id draws the key of an
id of its own. Rows that share a doc_id and the quality of their text share a key; each counts for itself. A source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import staged

from .base import WORD, packed, unpacked

BINS = 65_536


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """1 for plain prose, falling with the share of symbol characters; never 0."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return F.coalesce(1 / (1 + 20 * F.try_divide(symbols, F.length(text))), F.lit(1.0))


def key_of(doc_id: Column, quality: Column, seed: str = "mix") -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return -F.ln((F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))) / quality


def _bin(key: Column) -> Column:
    return F.least(F.floor(BINS * (1 - F.exp(-key))), F.lit(BINS - 1)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target of each source, from rows with source and size."""
    # One row a source from here on; the windows without a partition order sources, not documents.
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("w").over(everything).alias("all_w"), F.sum("source_size").over(everything).alias("all_size"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"))
    rows = rows.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all_size") - F.col("cap_before")))
    rows = rows.select("*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything).alias("full_cap"), F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(everything).alias("full_w"))
    share = F.try_divide((F.col("w") * (F.col("all_size") - F.col("full_cap"))).cast("double"), (F.col("all_w") - F.col("full_w")).cast("double"))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source: source_size, target, epochs, and last_key/last_id, the last document of the fractional part.

    `sizes` has doc_id, source, size, key.
    """
    goal = targets(sizes, weights, most).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = staged(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    bins = sizes.groupBy("source", _bin(F.col("key")).alias("bin")).agg(F.sum("size").alias("in_bin"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("in_bin").over(upto) - F.col("in_bin"))
    other = goal.select(F.col("source").alias("__tm_source"), "rest")
    cut = bins.join(other, F.col("source").eqNullSafe(F.col("__tm_source"))).where((F.col("rest") > 0) & (F.col("before") < F.col("rest")))
    cut = staged(cut.groupBy(F.col("__tm_source").alias("cut_source")).agg(F.max("bin").alias("cut_bin"), F.max_by("before", "bin").alias("before"), F.max("rest").alias("rest")), "mix-cut")
    edge = sizes.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (_bin(F.col("key")) == F.col("cut_bin")))
    edge = edge.groupBy("cut_source", "before", "rest", "key", "doc_id", "size").agg(F.count("*").alias("equal"))
    run = Window.partitionBy("cut_source").orderBy("key", "doc_id", "size")
    room = 2 * F.col("rest") - 2 * F.col("at") - F.col("size")
    fitting = F.when(room <= 0, 0).when(F.col("size") == 0, F.col("equal")).otherwise(F.least(F.col("equal"), F.ceil(room / (2 * F.col("size")))))
    edge = edge.withColumn("at", F.col("before") + F.sum(F.col("size") * F.col("equal")).over(run) - F.col("size") * F.col("equal")).withColumn("fitting", fitting.cast("long")).where("fitting > 0")
    last = F.struct("key", "doc_id", "size", "fitting", "equal")
    edge = edge.groupBy("cut_source").agg(F.max_by(last, F.struct("key", "doc_id", "size")).alias("last"))
    edge = edge.select(F.col("cut_source").alias("edge_source"), *[F.col(f"last.{c}").alias(f"last_{n}") for c, n in (("key", "key"), ("doc_id", "id"), ("size", "size"), ("fitting", "fitting"), ("equal", "equal"))])
    marks = cut.select("cut_source", "cut_bin").join(edge, F.col("cut_source").eqNullSafe(F.col("edge_source")), "left")
    out = goal.join(marks, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return staged(out.select("source", "source_size", "target", "epochs", "cut_bin", *_LAST), "mix-plan")


_LAST = ["last_key", "last_id", "last_size", "last_fitting", "last_equal"]


def _copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (with source, doc_id, __tm_key and __tm_size) and how often the mix takes each: __tm_copies.

    Where more rows equal a source's last one than fit, those rows alone are numbered; no others are shuffled.
    """
    at = found.withColumnRenamed("source", "__tm_source").withColumnsRenamed({c: f"__tm_{c}" for c in ("source_size", "target", "epochs", "cut_bin", *_LAST)})
    key, own, place = F.col("__tm_key"), _bin(F.col("__tm_key")), lambda x: F.struct(x("key"), x("id"), x("size"))
    here = place(lambda c: F.col("doc_id").cast("long") if c == "id" else F.col(f"__tm_{c}"))
    last = place(lambda c: F.col(f"__tm_last_{c}"))
    in_bin = (own == F.col("__tm_cut_bin")) & F.col("__tm_last_key").isNotNull()
    joined = rows.join(at, F.col("source").cast("string").eqNullSafe(F.col("__tm_source")))
    within = F.coalesce((own < F.col("__tm_cut_bin")) | (in_bin & (here <= last)), F.lit(False))
    if found.where("last_fitting < last_equal").isEmpty():
        return joined.withColumn("__tm_copies", F.col("__tm_epochs") + within.cast("long"))
    tied = F.coalesce(in_bin & (here == last) & (F.col("__tm_last_fitting") < F.col("__tm_last_equal")), F.lit(False))
    number = F.row_number().over(Window.partitionBy("__tm_source").orderBy("__tm_key"))
    some = joined.where(tied).withColumn("__tm_number", number)
    some = some.withColumn("__tm_copies", F.col("__tm_epochs") + (F.col("__tm_number") <= F.col("__tm_last_fitting")).cast("long")).drop("__tm_number")
    return joined.where(~tied).withColumn("__tm_copies", F.col("__tm_epochs") + within.cast("long")).unionByName(some)


def _measured(documents: DataFrame) -> DataFrame:
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), quality_of(text).alias("quality"))
    return staged(rows.select("doc_id", "source", "size", key_of(F.col("doc_id"), F.col("quality")).alias("key")), "mix-sizes")


def taken(documents: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    sizes = _measured(documents)
    rows = _copies(sizes.withColumn("__tm_size", F.col("size")).withColumnRenamed("key", "__tm_key"), plan(sizes, weights, most))
    return rows.select("doc_id", "size", F.col("__tm_source_size").alias("source_size"), F.col("__tm_target").alias("target"), (F.col("size") * F.col("__tm_copies")).alias("taken"))


def mix(documents: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with their columns as they were; no shuffle of texts."""
    found = plan(_measured(documents), weights, most)
    keyed = packed(documents).withColumn("__tm_size", size_of(F.col("text"))).withColumn("__tm_key", key_of(F.col("doc_id"), quality_of(F.col("text"))))
    rows = _copies(keyed, found).where(F.col("__tm_copies") > 0)
    return unpacked(rows.withColumn("__tm_copy", F.explode(F.sequence(F.lit(1), F.col("__tm_copies").cast("int")))))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         coalesce(1 / (1 + 20 * ((length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::DOUBLE / nullif(length(text), 0))), 1.0) AS quality
  FROM documents),
keyed AS (
  SELECT doc_id, source, size::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key
  FROM sized),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM by_source),
poured AS (
  SELECT *, sum(w) OVER () AS all_w, sum(source_size) OVER () AS all_size,
         coalesce(sum(w) OVER b, 0) AS w_before, coalesce(sum(cap) OVER b, 0) AS cap_before
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, cap * (all_w - w_before) <= w * (all_size - cap_before) AS full_up FROM poured),
goal AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN cap::DOUBLE
              ELSE (w * (all_size - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()))::DOUBLE
                   / nullif((all_w - sum(CASE WHEN full_up THEN w ELSE 0 END) OVER ())::DOUBLE, 0) END AS target
  FROM filled),
split AS (
  SELECT source, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM goal),
placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS ahead
  FROM keyed k JOIN split s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND 2 * ahead + size < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
