"""Pairs within blocks, duplicate diagnostics, and data-quality checks.

Every pair join is an equi-join on a blocking key with `a < b`; block size limits are part of the reports' meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.mathx import hamming_longs, hash_longs, jaccard
from tallymark.functions.text import strip_accents
from tallymark.operators.stats import top_k
from tallymark.session import staged


def versus_pairs(groups: DataFrame, least_stores: int = 3, per_class: int = 25, ratio: float = 3, limit: int = 400) -> DataFrame:
    """Comparable groups of one first varietal: different brands, prices within `ratio`, ordered by their stores together."""
    rows = groups.where((F.col("store_count") >= least_stores) & (F.col("min_price") > 0) & F.col("brand").isNotNull() & (F.size("varietals") > 0))
    rows = rows.select(F.get("varietals", F.lit(0)).alias("varietal"), "group_slug", "brand", "min_price", "store_count")
    rows = top_k(rows, ["varietal"], [F.desc("store_count"), F.col("group_slug")], per_class).drop("rank")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.varietal") == F.col("b.varietal")) & (F.col("a.group_slug") < F.col("b.group_slug")) & (F.col("a.brand") != F.col("b.brand")))
    met = met.where(F.greatest("a.min_price", "b.min_price") <= ratio * F.least("a.min_price", "b.min_price"))
    met = met.select(F.col("a.group_slug").alias("slug_a"), F.col("b.group_slug").alias("slug_b"), F.col("a.varietal").alias("varietal"), (F.col("a.store_count") + F.col("b.store_count")).alias("total_store_count"))
    return met.orderBy(F.desc("total_store_count"), "slug_a", "slug_b").limit(limit)


def similar_names(rows: DataFrame, key: str, tokens: str, same: list[str], threshold: float = 0.75, most: int = 60) -> DataFrame:
    """Pairs in blocks of the first token (2 to `most` rows) whose token sets reach the Jaccard threshold and whose `same` columns agree, null with null."""
    blocked = rows.withColumn("block", F.get(tokens, F.lit(0))).where(F.col("block").isNotNull())
    sizes = blocked.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    rows = blocked.join(sizes.select("block"), "block", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.block") == F.col("b.block")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    for c in same:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = a.join(b, on).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), jaccard(F.col(f"a.{tokens}"), F.col(f"b.{tokens}")).alias("similarity"))
    return met.where(F.col("similarity") >= threshold)


def conflicting(a: Column, b: Column) -> Column:
    """Whether two brands can't be one: both are there and neither holds the other, as plain lower-case text."""
    plain = lambda x: F.trim(F.lower(strip_accents(x)))
    x, y = plain(a), plain(b)
    return F.coalesce((x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x), F.lit(False))


def token_pair_clusters(rows: DataFrame, key: str, tokens: str, weight: str, same: Sequence[str] = ("vintage", "format"), most: int = 6, limit: int = 80) -> DataFrame:
    """Sets of rows with two of their distinctive `tokens` in common that agree in the columns `same` (null is a value) though some two of their brands conflict; equal sets count once, the heaviest first.

    Rows with fewer than two tokens take no part.
    """
    words = F.array_sort(F.array_distinct(F.col(tokens)))
    pairs = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y > x), lambda y: F.concat_ws(" ", x, y))))
    own = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in same])) if same else F.lit("")
    met = rows.select(key, "brand", weight, own.alias("__tm_own"), F.explode(pairs).alias("pair"))
    # Blocks beyond `most` rows are no duplicates by this report's rule; counts come first, so none is gathered.
    small = met.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    sets = met.join(small, "pair").groupBy("pair").agg(F.array_sort(F.collect_set(key)).alias("members"), F.collect_set("brand").alias("brands"), F.countDistinct("__tm_own").alias("kinds"), F.sum(weight).alias("weight"))
    sets = sets.where((F.col("kinds") == 1) & F.exists("brands", lambda x: F.exists("brands", lambda y: conflicting(x, y))))
    sets = sets.groupBy("members").agg(F.min("pair").alias("pair"), F.max("weight").alias("weight"))
    return sets.orderBy(F.desc("weight"), "pair").limit(limit)


def shared_values(rows: DataFrame, value: str, key: str, least: int = 2) -> DataFrame:
    """Values (image URLs, hashes) that several groups hold."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(key).alias("n"), F.countDistinct("brand").alias("brands"), F.min(key).alias("first")).where(F.col("n") >= least)


def near_hashes(hashes: DataFrame, threshold: int = 10, hot: int = 200) -> DataFrame:
    """Pairs (a, b, distance) of different 256-bit hashes within `threshold` (14 at most) bits, each named by the least url that has it.

    Hashes are cut into threshold + 3 words (16 at most) of whole hex digits; close ones agree in two or three of them at least, so an equi-join on a word finds all, and the fewer
    the words, the fewer strangers share one. A pair is taken at the first word in which it agrees. A word that more than `hot` hashes hold
    (flat pictures share many) finds its pairs in company: a close pair that agrees in hot words only agrees in several, so such
    words are joined by two, and those twos that are still hot by three. Rows of one hash are one member, see `hash_members`.
    """
    if threshold > 14:
        raise ValueError("two words in common need a distance of at most 14")
    n = min(16, threshold + 3)
    cuts = [64 * k // n for k in range(n + 1)]
    width = max(y - x for x, y in zip(cuts, cuts[1:]))
    rows = hashes.where(F.length("hash") == 64).groupBy(F.lower("hash").alias("hash")).agg(F.min("url").alias("url"))
    words = F.array(*[F.concat(F.lit(f"{k:02d}"), F.lpad(F.substring("hash", x + 1, y - x), width, "0")) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))])
    keyed = staged(rows.select("url", hash_longs(F.col("hash")).alias("bits"), words.alias("words")), "hash-words").select("url", "bits", F.posexplode("words").alias("k", "key"))
    levels = min(3, n - threshold)
    found = None
    for level in range(1, levels + 1):
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
        # The next level's keys: hot ones and one more hot word of a later band.
        warm = staged(keyed.join(sizes.where(F.col("n") > hot).select("key"), "key"), "hash-hot") if level < levels else None
        last = warm is None or warm.isEmpty()
        cold = keyed.join(sizes.where(F.col("n").between(2, hot)).select("key"), "key") if not last else keyed
        a, b = cold.alias("a"), cold.alias("b")
        distance = hamming_longs(F.col("a.bits"), F.col("b.bits"))
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.url") < F.col("b.url")) & (distance <= threshold))
        if level == 1 and last:
            for k, (x, y) in enumerate(zip(cuts, cuts[1:-1])):
                met = met.where((F.col("a.k") <= k) | _apart(F.col("a.bits"), F.col("b.bits"), x, y))
            return met.select(F.col("a.url").alias("a"), F.col("b.url").alias("b"), distance.alias("distance"))
        met = met.select(F.col("a.url").alias("a"), F.col("b.url").alias("b"), distance.alias("distance"))
        found = met if found is None else found.unionByName(met)
        if last:
            break
        if level == 1:
            single = warm.groupBy("url").agg(F.collect_list("key").alias("hot_words"))  # 16 at most
        more = warm.join(single, "url")
        keyed = staged(more.select("url", "bits", "k", F.explode(F.transform(F.filter("hot_words", lambda w: w > F.substring(F.col("key"), -width - 2, width + 2)), lambda w: F.concat_ws("+", "key", w))).alias("key")), "hash-words")
    return found.distinct()


def _apart(a: Column, b: Column, start: int, end: int) -> Column:
    """Whether the hex digits from `start` to `end` of two hashes (as `hash_longs`) differ."""
    out = None
    for k in range(start // 16, (end - 1) // 16 + 1):
        mask = sum(15 << 4 * (15 - (d - 16 * k)) for d in range(max(start, 16 * k), min(end, 16 * k + 16)))
        one = a[k].bitwiseXOR(b[k]).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) != 0
        out = one if out is None else out | one
    return out


def placeholder_suspects(rows: DataFrame, value: str = "hash", key: str = "group_slug", most_groups: int = 5, most_brands: int = 3) -> DataFrame:
    """Values of `value` (a hash or address) that `most_groups` groups and `most_brands` brands or more share: pictures that stand for none. Empty brands don't count."""
    brand = F.nullif(F.trim(F.lower("brand")), F.lit(""))
    out = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(key).alias("n"), F.countDistinct(brand).alias("brands"), F.min(key).alias("first"))
    return out.where((F.col("n") >= most_groups) & (F.col("brands") >= most_brands))


def hash_members(hashes: DataFrame, threshold: int = 10) -> DataFrame:
    """url, first (the least url of its hash) and links (other hashes within `threshold` bits) of every row with a hash."""
    rows = hashes.where(F.length("hash") == 64).select("url", F.lower("hash").alias("hash"))
    first = rows.groupBy("hash").agg(F.min("url").alias("first"))
    pairs = near_hashes(hashes, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("links"))
    return rows.join(first, "hash").join(links, "first", "left").select("url", "first", F.coalesce("links", F.lit(0)).alias("links"))


def health(previous: DataFrame, current: DataFrame, strict: bool = False) -> DataFrame:
    """All issues of a run (store_slug, product_count, errors as a count) against the one before; a store may have several, new ones none by comparison.

    A store that lost everything isn't said to have halved as well. With `strict`, errors of a store are errors of the run.
    """
    now = current.withColumnsRenamed({"product_count": "now", "errors": "errors_now"}).withColumn("now", F.coalesce("now", F.lit(0)))
    both = now.join(previous.select("store_slug", F.col("product_count").alias("before")), "store_slug", "left")
    kinds = [
        F.when(F.col("errors_now") > 0, F.lit("error:errors" if strict else "warn:errors")),
        F.when((F.col("now") == 0) & (F.col("errors_now") == 0), F.lit("warn:silent zero")),
        F.when((F.col("before") >= 50) & (F.col("now") == 0), F.lit("error:lost")),
        F.when((F.col("before") >= 30) & (F.col("now") > 0) & (F.col("now") <= 0.5 * F.col("before")), F.lit("warn:halved")),
    ]
    issues = both.select(F.explode(F.array_compact(F.array(*kinds))).alias("issue"), "store_slug", F.coalesce("before", F.lit(0)).alias("before"), "now")
    # Whole runs: stores that are gone count before, new ones now. One row a side.
    total = previous.agg(F.sum("product_count").alias("before")).crossJoin(now.agg(F.coalesce(F.sum("now"), F.lit(0)).alias("now"))).where((F.col("before") >= 1000) & (F.col("now") <= 0.8 * F.col("before")))
    return issues.unionByName(total.select(F.lit("error:total").alias("issue"), F.lit(None).cast(issues.schema["store_slug"].dataType).alias("store_slug"), "before", "now"))


def golden_gate(answers: DataFrame, golden: DataFrame, allowed: list[str], least: float = 0.9) -> DataFrame:
    """Confident answers from the closed list, if enough of the golden set is right; none otherwise (key, answer, accuracy)."""
    hit = answers.join(golden, "key").agg(F.avg((F.col("answer") == F.col("truth")).cast("double")).alias("accuracy"))  # one row
    good = answers.where((F.col("confidence") == "alta") & F.col("answer").isin(allowed)).select("key", "answer")
    return good.crossJoin(F.broadcast(hit)).where(F.col("accuracy") >= least)
