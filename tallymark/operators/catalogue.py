"""From cleaned listings to the catalogue: brands, keys, groups, regions, scores and image hashes.

Dictionaries are tables (from, to, ord): the caller brings its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallymark.functions.text import brand_alias_key, group_slug, host, normalize_name, peel, squeeze, tokens
from tallymark.operators.resolve import unique_slugs
from tallymark.operators.stats import first_present, group_stats_fallback, mode_first_seen, shortest


def map_brand(listings: DataFrame, mapping: DataFrame, column: str = "brand") -> DataFrame:
    """Brands by an exact dictionary on the normalised label; of several entries the first by `ord` counts."""
    known = mapping.groupBy(brand_alias_key(F.col("from")).alias("__tm_key")).agg(F.min_by("to", "ord").alias("__tm_to"))
    rows = listings.withColumn("__tm_label", brand_alias_key(F.col(column))).join(known, F.col("__tm_label") == F.col("__tm_key"), "left")
    return rows.withColumn(column, F.coalesce("__tm_to", column)).drop("__tm_label", "__tm_key", "__tm_to")


def drop_bad_brands(listings: DataFrame, bad: DataFrame) -> DataFrame:
    """Brands that are no brands (varietals, placeholders) become null; labels are compared as plain names, a leading house word included."""
    known = bad.select(normalize_name(F.col("brand")).alias("__tm_bad")).distinct()
    rows = listings.join(known, normalize_name(F.col("brand")) == F.col("__tm_bad"), "left")
    return rows.withColumn("brand", F.when(F.col("__tm_bad").isNull(), F.col("brand"))).drop("__tm_bad")


def secondary_key(name: Column, noise: Sequence[str], producers: Sequence[str], drop: Sequence[str]) -> Column:
    """Tokens of a name without up to three leading noise words, up to four leading producer words and all of `drop`, sorted."""
    words = peel(peel(F.split(normalize_name(name), " "), noise, 3), producers, 4)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(list(drop) or [""])))), " ")


def detect_label(rows: DataFrame, labels: DataFrame, longest: int = 4) -> DataFrame:
    """The longest label (of up to `longest` words) that a name holds as whole words; an equi-join on the name's word runs."""
    words = F.split(normalize_name(F.col("name")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))
    met = rows.select("id", F.explode(F.array_distinct(runs)).alias("run")).join(labels.select(normalize_name(F.col("label")).alias("run"), "label").distinct(), "run")
    best = met.groupBy("id").agg(F.max_by("label", F.struct(F.length("run"), "label")).alias("label"))
    return rows.join(best, "id", "left")


def suffix_tokens(name: Column, label: Column, varietals: Column, noise: Sequence[str]) -> Column:
    """What a name says besides its label, varietals and noise."""
    rest = F.array_except(tokens(name, noise), F.coalesce(tokens(label), F.array().cast("array<string>")))
    return F.array_sort(F.array_except(rest, F.flatten(F.transform(F.coalesce(varietals, F.array().cast("array<string>")), lambda v: F.split(normalize_name(v), " ")))))


def build_groups(listings: DataFrame) -> DataFrame:
    """One row per key of listings (key, ord, name, brand, type, region, image_url, store_slug, price, in_stock, is_collector).

    The shortest name, the most frequent type, the first brand, region and image, the price range by the fallback rule, and a slug
    that is unique by a suffix.
    """
    rows = listings.where(F.col("key") != "").withColumn("group_slug", F.col("key"))
    out = shortest(rows, "key", "name").join(first_present(rows, "key", ["brand", "region", "image_url"]), "key")
    out = out.join(mode_first_seen(rows, "key", "type").select("key", "type"), "key", "left")
    out = out.join(group_stats_fallback(rows).withColumnRenamed("group_slug", "key").drop("basis"), "key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("offer_count"))
    return unique_slugs(out.join(sizes, "key").withColumn("slug", group_slug(F.col("key"))), "slug", "key")


def region_candidates(groups: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """Brands of `least` groups without a region or more that the brand dictionary doesn't know."""
    rows = groups.where(F.col("region").isNull() & F.col("brand").isNotNull()).groupBy(brand_alias_key(F.col("brand")).alias("brand_key")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(known.select("brand_key"), "brand_key", "left_anti")


def image_hosts(rows: DataFrame, url: str, shared: Sequence[str] = ()) -> DataFrame:
    """Distinct hosts; hosts below a shared suffix count as one wildcard."""
    name = host(F.col(url))
    for suffix in shared:
        name = F.when(name.endswith("." + suffix), F.lit(f"*.{suffix}")).otherwise(name)
    return rows.select(name.alias("host")).where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"))


def best_scores(scores: DataFrame) -> DataFrame:
    """Best and average critic score per slug, out of 100; keys that begin with `_` are notes, not wines."""
    value = F.try_divide("score", "max_score") * 100
    return scores.where(~F.col("slug").startswith("_")).groupBy("slug").agg(F.max(value).alias("critic_score"), F.round(F.avg(value), 1).alias("average"), F.array_join(F.array_sort(F.collect_set("critic")), ", ").alias("critics"))


def questions(price: Column, stores: Column, region: Column, varietals: Column) -> Column:
    """Question and answer lines for which the data is there; null below two."""
    said = F.array_compact(F.array(
        F.when(price > 0, F.concat(F.lit("price: "), F.format_number(price, 0))), F.when(stores >= 1, F.concat(F.lit("stores: "), stores.cast("string"))),
        F.when(region.isNotNull(), F.concat(F.lit("region: "), region)), F.when(F.size(varietals) > 0, F.concat(F.lit("varietals: "), F.array_join(varietals, ", "))),
    ))
    return F.when(F.size(said) >= 2, said)


@F.pandas_udf(StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """64 hex digits of a 32 x 32 grey image (1,024 numbers in rows): signs of the low 16 x 16 cosine coefficients against their upper median, the constant one aside."""
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))

    def one(x) -> str | None:
        if x is None or len(x) != n * n:
            return None
        low = (basis @ np.asarray(x, float).reshape(n, n) @ basis.T)[:16, :16].ravel()
        middle = np.sort(low[1:])[len(low[1:]) // 2]
        bits = np.append(False, low[1:] > middle)
        return np.packbits(bits).tobytes().hex()

    return pixels.map(one)


def name_line(name: Column, brand: Column, vintage: Column) -> Column:
    """One product in a line, for an adjudicator's prompt."""
    return squeeze(F.concat_ws(" · ", name, brand, vintage.cast("string")))
