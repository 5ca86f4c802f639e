"""Entity resolution: from product listings to groups of the same product.

Each stage maps listings (id, key, brand, ...) to groups; merges are edges for connected components, and the survivor of a component is chosen
by an explicit order, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.mathx import jaccard
from tallymark.functions.text import squeeze, strip_accents
from tallymark.operators.graph import connected_components
from tallymark.operators.stats import top_k
from tallymark.operators.vectors import classes, cosine_join
from tallymark.session import staged


def prefix_brand(listings: DataFrame, prefixes: DataFrame, longest: int = 5) -> DataFrame:
    """The first entry, by `ord`, whose prefix is the name or begins it before a space."""
    words = F.split(squeeze(F.lower("name")), " ")
    heads = listings.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("prefix"))
    found = heads.join(prefixes.select(F.lower("prefix").alias("prefix"), "brand", "ord"), "prefix").groupBy("id").agg(F.min_by("brand", "ord").alias("forced"))
    return listings.join(found, "id", "left").withColumn("brand", F.coalesce("forced", "brand")).drop("forced")


def valid_ean(sku: Column) -> Column:
    return F.when(F.trim(sku).rlike("^[0-9]{12,14}$"), F.trim(sku))


def ean_components(listings: DataFrame) -> DataFrame:
    """key and merged key: keys that share a product number are one; the key of most listings survives, then the smallest. Empty keys are dropped."""
    rows = listings.where(F.col("key") != "").select("key", valid_ean(F.col("sku")).alias("ean"))
    hub = rows.where(F.col("ean").isNotNull()).groupBy("ean").agg(F.min("key").alias("hub"))
    edges = rows.join(hub, "ean").select(F.col("key").alias("src"), F.col("hub").alias("dst"))
    parts = connected_components(edges).withColumnRenamed("node", "key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    named = sizes.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    label = named.groupBy("component").agg(F.min_by("key", F.struct(F.negative("n"), "key")).alias("merged"))
    return named.join(label, "component").select("key", "merged", "n")


def subset_merge(keys: DataFrame, least: int = 2) -> DataFrame:
    """key (of one listing) and its only multi-listing target whose tokens hold all of its own."""
    small = keys.where("n = 1").select("key", F.array_distinct(F.split("key", " ")).alias("t")).where(F.size("t") >= least)
    large = keys.where("n > 1").select(F.col("key").alias("target"), F.explode(F.array_distinct(F.split("key", " "))).alias("token"))
    # Only the rarest token of a small key looks for targets; the whole set is checked on what it finds.
    df = large.groupBy("token").agg(F.count("*").alias("df"))
    probe = small.select("key", "t", F.explode("t").alias("token")).join(df, "token", "left")
    probe = probe.groupBy("key", "t").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    met = probe.join(large, "token").where(F.size(F.array_except("t", F.split("target", " "))) == 0)
    return met.groupBy("key").agg(F.count("*").alias("targets"), F.min("target").alias("target")).where("targets = 1").select("key", "target")


def unique_slugs(rows: DataFrame, slug: str = "slug", order: str = "ord") -> DataFrame:
    """Repeated slugs get -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn(slug, F.when(n > 1, F.concat_ws("-", F.col(slug), n.cast("string"))).otherwise(F.col(slug)))


def merge_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """group_slug and merged_into for linked groups; the one of most stores, then most offers, then the smallest slug survives."""
    parts = connected_components(links).withColumnRenamed("node", "group_slug")
    rows = groups.join(parts, "group_slug")
    lead = rows.groupBy("component").agg(F.min_by("group_slug", F.struct(F.negative("store_count"), F.negative("offer_count"), "group_slug")).alias("merged_into"))
    return rows.join(lead, "component").select("group_slug", "merged_into")


def agree(column: str) -> Column:
    """Neither side contradicts the other: equal, or one is null."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return a.isNull() | b.isNull() | (a == b)


def share(column: str) -> Column:
    """Sets overlap, or both are empty."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return ((F.coalesce(F.size(a), F.lit(0)) <= 0) & (F.coalesce(F.size(b), F.lit(0)) <= 0)) | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same_volume(column: str = "format") -> Column:
    """Formats don't contradict: both given and equal, or one is missing and the other is no volume (ml or l)."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    volume = lambda x: F.coalesce(x.rlike("^[0-9]+(?:ml|l)$"), F.lit(False))
    return agree(column) & (volume(a) == volume(b))


def image_links(groups: DataFrame, threshold: float = 0.7, most_groups: int = 5, most_brands: int = 3) -> DataFrame:
    """Groups with one image and brand that share a varietal (or have none), whose type and volume don't contradict, with similar names.

    An image of `most_groups` groups and `most_brands` brands or more is a placeholder. Pairs meet on image and brand.
    """
    brand = F.trim(F.regexp_replace(F.lower("brand"), r"\s+", " "))
    held = groups.where(F.col("image_url").isNotNull()).withColumn("__tm_brand", brand)
    stats = held.groupBy("image_url").agg(F.count("*").alias("n"), F.countDistinct(F.nullif("__tm_brand", F.lit(""))).alias("brands")).where((F.col("n") > 1) & ~((F.col("n") >= most_groups) & (F.col("brands") >= most_brands)))
    rows = held.where("__tm_brand <> ''").join(stats.select("image_url"), "image_url", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.image_url") == F.col("b.image_url")) & (F.col("a.__tm_brand") == F.col("b.__tm_brand")) & (F.col("a.group_slug") < F.col("b.group_slug"))
    met = a.join(b, on & agree("type") & same_volume() & share("varietals"))
    return met.where(jaccard(F.col("a.tokens"), F.col("b.tokens"), 1.0) >= threshold).select(F.col("a.group_slug").alias("src"), F.col("b.group_slug").alias("dst"))


def vector_pairs(vectors: DataFrame, block: str, low: float, bands: Sequence[tuple[float, int]] | None = None) -> DataFrame:
    """Pairs (a, b, sim) of vec_id in one block whose cosine is at least `low`; exact copies of a vector in a block stand as the one of least vec_id. With `bands`, the best of each a and some more."""
    first = vectors.join(classes(vectors, "vec_id", "embedding", [block]).where("vec_id = class").select("vec_id"), "vec_id", "left_semi")
    return cosine_join(first, "vec_id", "embedding", low, block, bands=bands)


def vector_merge(vectors: DataFrame, block: str, high: float, low: float, merges: int = 5, candidates: int = 3) -> tuple[DataFrame, DataFrame]:
    """Links (sim at least `high`, the best `merges` of each left row) and grey pairs (below, the best `candidates`)."""
    pairs = vector_pairs(vectors, block, low, bands=[(high, merges), (low, candidates)])
    return best_links(pairs, high, merges, candidates)


def best_links(pairs: DataFrame, high: float, merges: int = 5, candidates: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a, b, sim): links of at least `high`, the best `merges` of each a, and grey pairs below, the best `candidates`."""
    pairs = staged(pairs, "pairs")
    order = [F.desc("sim"), F.col("b")]
    links = top_k(pairs.where(F.col("sim") >= high), ["a"], order, merges)
    grey = top_k(pairs.where(F.col("sim") < high), ["a"], order, candidates)
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim"), grey.select("a", "b", "sim")


def decision_key(a: str = "a", b: str = "b") -> Column:
    """What a decision on two groups (structs with name, brand and vintage) is kept under: both as plain lines, the smaller first."""
    line = lambda x: F.trim(F.lower(F.concat_ws("|", F.coalesce(F.col(f"{x}.name"), F.lit("")), F.coalesce(F.col(f"{x}.brand"), F.lit("")), F.coalesce(F.col(f"{x}.vintage").cast("string"), F.lit("")))))
    return F.concat_ws("||", F.least(line(a), line(b)), F.greatest(line(a), line(b)))


def decided_links(grey: DataFrame, decisions: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Grey pairs (a, b) that the decisions (key, answer) confirm, and those still to ask: without any decision, since one that says nothing is one too."""
    known = decisions.select(F.col("key").alias("__tm_key"), "answer", F.lit(True).alias("__tm_known"))
    done = grey.withColumn("key", key).join(known, F.col("key") == F.col("__tm_key"), "left")
    return done.where("answer = 'yes'").select(F.col("a").alias("src"), F.col("b").alias("dst")), done.where("__tm_known is null").select("a", "b", "key")


def brands_agree(brands: Column) -> Column:
    """Whether plain labels (distinct, without bad brands) may be one brand: one at most, one that holds all others, or all within a typo of each other.

    A typo is one edit, or one in ten characters of the longer label; labels under five characters allow none.
    """
    holds_all = F.exists(brands, lambda x: F.forall(brands, lambda y: x.contains(y)))
    near = lambda x, y: (x == y) | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.levenshtein(x, y) <= F.greatest(F.lit(1), F.floor(F.greatest(F.length(x), F.length(y)) / 10))))
    return (F.size(brands) <= 1) | holds_all | F.forall(brands, lambda x: F.forall(brands, lambda y: near(x, y)))


def bucket_merge(groups: DataFrame, bucket: Sequence[str], bad: DataFrame | None = None) -> DataFrame:
    """Groups of one strict bucket are one, unless their vintages or brands contradict each other; the one of most stores survives.

    Brands of the table `bad` (brand) are none. A bucket's brands come together as distinct labels, which are few, or it wouldn't be one product.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if c != "varietals" else F.array_join(F.array_sort(c), ","), F.lit("")) for c in bucket])
    label = F.trim(F.lower(strip_accents(F.col("brand"))))
    rows = groups.withColumn("bucket", key).withColumn("label", label)
    if bad is not None:
        known = bad.select(F.trim(F.lower(strip_accents(F.col("brand")))).alias("label"), F.lit(True).alias("is_bad")).distinct()
        rows = rows.join(known, "label", "left").withColumn("label", F.when(F.col("is_bad").isNull(), F.col("label"))).drop("is_bad")
    fit = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("vintage").alias("vintages"), F.min_by("group_slug", F.struct(F.negative("store_count"), "group_slug")).alias("merged_into"))
    labels = rows.where("label is not null and label <> ''").select("bucket", "label").distinct().groupBy("bucket").agg(F.collect_list("label").alias("labels"))
    fit = fit.where("n > 1 and vintages <= 1").join(labels, "bucket", "left").where(F.col("labels").isNull() | brands_agree(F.col("labels")))
    return rows.join(fit, "bucket").select("group_slug", "merged_into")


def split_chimeras(offers: DataFrame, least_offers: int = 8, least_cluster: int = 3) -> DataFrame:
    """group_slug, ord and new_slug of the offers of groups that hold several products.

    Splitter tokens are held by 10 to 75 % of a group's offers; each offer may hold one at most. The largest cluster keeps the slug; others add the token's first ten letters a-z
    and digits, offers without one add `var`. A group of which a valid product number spans clusters stays whole.
    """
    from tallymark.operators.stats import splitter_tokens

    sized = offers.groupBy("group_slug").agg(F.count("*").alias("n")).where(F.col("n") >= least_offers).select("group_slug")
    big = offers.join(sized, "group_slug", "left_semi")
    marks = splitter_tokens(big, "group_slug", "tokens", least=least_cluster).groupBy("group_slug").agg(F.collect_set("token").alias("splitters"))
    rows = big.join(marks.where(F.size("splitters") >= 2), "group_slug").withColumn("held", F.array_intersect("tokens", "splitters"))
    rows = rows.withColumn("cluster", F.coalesce(F.get("held", F.lit(0)), F.lit(""))).withColumn("ean", valid_ean(F.col("sku")))
    # One row a cluster and product number, then one a cluster, then one a group: each sum is taken from the one before.
    by_ean = rows.groupBy("group_slug", "cluster", "ean").agg(F.count("*").alias("n"), F.max(F.size("held")).alias("most"))
    spans = by_ean.where("ean is not null").groupBy("group_slug", "ean").agg(F.count("*").alias("clusters")).where("clusters > 1").select("group_slug").distinct()
    sizes = by_ean.groupBy("group_slug", "cluster").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    fit = sizes.groupBy("group_slug").agg(F.max("most").alias("most"), F.count_if(F.col("n") >= least_cluster).alias("clusters"), F.min_by("cluster", F.struct(F.negative("n"), "cluster")).alias("lead"))
    fit = fit.where("most <= 1 and clusters >= 2").join(spans, "group_slug", "left_anti").select("group_slug", "lead")
    suffix = F.when(F.col("cluster") == "", F.lit("var")).otherwise(F.substring(F.regexp_replace("cluster", "[^a-z0-9]", ""), 1, 10))
    slug = F.when(F.col("cluster") == F.col("lead"), F.col("group_slug").cast("string")).otherwise(F.concat_ws("__", F.col("group_slug").cast("string"), suffix))
    return rows.join(fit, "group_slug").select("group_slug", "ord", slug.alias("new_slug"))


def repair_images(groups: DataFrame, offers: DataFrame) -> DataFrame:
    """Groups whose image none of their offers has get the first offer's."""
    own = offers.where(F.col("image_url").isNotNull()).groupBy("group_slug").agg(F.collect_set("image_url").alias("images"), F.min_by("image_url", "ord").alias("first_image"))
    rows = groups.join(own, "group_slug", "left")
    keep = F.coalesce(F.array_contains("images", F.col("image_url")), F.lit(False)) | F.col("images").isNull()
    return rows.withColumn("image_url", F.when(keep, F.col("image_url")).otherwise(F.col("first_image"))).drop("images", "first_image")
