"""The resolution chain: from shop listings to final groups, stage by stage, with a lineage of every slug.

    clean -> brands (two passes) -> key -> product numbers -> subsets -> links (images, vectors, decisions) -> strict buckets -> empty varietals -> split

A state is two tables: offers (a listing and the slug of its group) and groups (one row a slug). A stage finds a table of (group_slug, merged_into) or of split offers; `merge` and
`split` turn that into the next state and into lineage events. Each state is staged in the shared folder, so plans stay short and a lost executor
repeats one stage at most. Nothing is gathered by group: descriptions are aggregates, and what is collected per group are its distinct varietals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import wine
from tallymark.functions.text import decode_entities, extract_format, extract_vintage, normalize_name, peel, strip_accents
from tallymark.functions.text import group_slug as slug_of
from tallymark.operators import brands, catalogue, resolve
from tallymark.operators.stats import cheapest_wins
from tallymark.session import staged

LISTING = ["id", "ord", "store_slug", "url", "sku", "name", "brand", "image_url", "price", "in_stock"]
GROUP = ["slug", "name", "brand", "vintage", "format", "image_url", "varietals", "region", "type", "store_count", "offer_count", "min_price", "max_price"]


@dataclass(frozen=True)
class Rules:
    """Dictionaries of a catalogue. Tables: prefixes (prefix, brand, ord), bad (brand), aliases (from, to, ord), regions (brand_key, region) or None.

    `leading` are words before a name proper, `producers` what names begin with, `noise` what a secondary key leaves out, `pure_noise` what tells no
    two lines of a label apart. `collector` is the last vintage that counts as a collector's.
    """

    prefixes: DataFrame
    bad: DataFrame
    aliases: DataFrame
    leading: Sequence[str] = ()
    producers: Sequence[str] = ()
    noise: Sequence[str] = ()
    pure_noise: Sequence[str] = ()
    generic: Sequence[str] = ()
    collector: int = 2020
    split_stop: Sequence[str] = ()


@dataclass(frozen=True)
class State:
    offers: DataFrame
    groups: DataFrame
    events: list[DataFrame] = field(default_factory=list)
    t: int = 0


# -- listings ----------------------------------------------------------------------------------------------------------


def clean(listings: DataFrame, rules: Rules) -> DataFrame:
    """Entities decoded, brands forced by name prefixes, bad ones dropped, labels mapped to their house, missing ones inferred in two passes."""
    rows = listings.withColumns({c: decode_entities(c) for c in ("name", "brand")})
    rows = resolve.prefix_brand(rows.withColumn("__tm_name", F.col("name")).withColumn("name", brands.forced_brand(F.col("name"), rules.leading)), rules.prefixes)
    rows = rows.withColumn("name", F.col("__tm_name")).drop("__tm_name")
    rows = catalogue.map_brand(catalogue.drop_bad_brands(rows, rules.bad), rules.aliases)
    return brands.infer_brands(staged(rows, "chain-clean"), rules.generic)


def keyed(listings: DataFrame) -> DataFrame:
    """The listings with their canonical key, without those whose key is empty."""
    return listings.withColumn("key", wine.canonical_key(F.col("name"), F.col("brand"))).where("key <> ''")


def attributes(rows: DataFrame, collector: int) -> DataFrame:
    """What the names say: vintage, format, varietals, type, region, and whether a vintage up to `collector` makes an offer a collector's."""
    name = F.col("name")
    out = rows.withColumns({"vintage": extract_vintage(name), "format": extract_format(name), "varietals": wine.varietals(name), "type": wine.kind(name), "region": wine.region(name, F.col("brand"))})
    return out.withColumn("is_collector", F.coalesce(F.col("vintage") <= collector, F.lit(False))).withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))


def first_slugs(rows: DataFrame) -> DataFrame:
    """key, slug: keys that share a product number are one, then keys of one listing that one larger key alone holds join it; slugs are unique."""
    numbers = staged(resolve.ean_components(rows), "chain-numbers")
    keys = numbers.groupBy(F.col("merged").alias("key")).agg(F.sum("n").alias("n"))
    subset = resolve.subset_merge(keys).withColumnsRenamed({"key": "merged", "target": "held_by"})
    out = numbers.join(subset, "merged", "left").select("key", F.coalesce("held_by", "merged").alias("last"), F.when(F.col("held_by").isNotNull(), "subset").when(F.col("key") != F.col("merged"), "number").alias("by"))
    named = resolve.unique_slugs(out.select("last").distinct().withColumn("slug", F.coalesce(F.nullif(slug_of(F.col("last")), F.lit("")), F.lit("wine"))), "slug", "last")
    return out.join(named, "last").select("key", "slug", "by")


# -- descriptions ------------------------------------------------------------------------------------------------------


def stock(offers: DataFrame, basis: str) -> DataFrame:
    """slug, store_count, offer_count, min_price, max_price.

    `basis`: "current" takes offers in stock that are no collector's, or all in stock where there is none; "in_stock" all in stock; "all" every offer. offer_count counts
    the offers in stock of the first, all of the others.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    now, fine = F.col("in_stock"), F.col("in_stock") & ~F.col("is_collector")
    sums = lambda name, when: [F.min(F.when(when, price)).alias(f"low_{name}"), F.max(F.when(when, price)).alias(f"high_{name}"), F.count_if(when).alias(f"n_{name}")]
    stores = offers.groupBy("slug", "store_slug").agg(*sums("fine", fine), *sums("now", now), *sums("all", F.lit(True)))
    total = lambda name: [F.min(f"low_{name}").alias(f"low_{name}"), F.max(f"high_{name}").alias(f"high_{name}"), F.sum(f"n_{name}").alias(f"n_{name}"), F.count_if(F.col(f"n_{name}") > 0).alias(f"stores_{name}")]
    out = stores.groupBy("slug").agg(*total("fine"), *total("now"), *total("all"))
    kind = F.when(F.col("n_fine") > 0, F.lit("fine")).otherwise("now") if basis == "current" else F.lit("now" if basis == "in_stock" else "all")
    choose = lambda what: F.when(kind == "fine", F.col(f"{what}_fine")).when(kind == "now", F.col(f"{what}_now")).otherwise(F.col(f"{what}_all"))
    return out.select("slug", choose("stores").alias("store_count"), F.col("n_now" if basis == "current" else "n_all").alias("offer_count"), choose("low").alias("min_price"), choose("high").alias("max_price"))


def describe(offers: DataFrame, basis: str = "current") -> DataFrame:
    """Groups from their offers: the shortest name, the first brand, image and region, the first listing's vintage and format, the three most frequent varietals, the most frequent type."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    base = offers.groupBy("slug").agg(
        F.min_by("name", F.struct(F.length("name"), "ord")).alias("name"), F.regexp_replace(first("brand"), r"(?i)^bodegas?\s+", "").alias("brand"),
        F.min_by("vintage", "ord").alias("vintage"), F.min_by("format", "ord").alias("format"), first("image_url").alias("image_url"), first("region").alias("region"),
    )
    said = offers.select("slug", "ord", F.posexplode("varietals").alias("at", "value")).withColumn("kind", F.lit("v"))
    said = said.unionByName(offers.where("type is not null").select("slug", "ord", F.lit(0).alias("at"), F.col("type").alias("value"), F.lit("t").alias("kind")))
    # The values of a group are few (the rules know so many varietals and types), its offers may be many.
    counted = said.groupBy("slug", "kind", "value").agg(F.count("*").alias("n"), F.min(F.struct("ord", "at")).alias("first"))
    ranked = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.negative("n").alias("n"), "first", "value"))))
    values = counted.groupBy("slug").agg(F.slice(ranked("v"), 1, 3)["value"].alias("varietals"), F.get(ranked("t"), F.lit(0))["value"].alias("type"))
    out = base.join(values, "slug", "left").join(stock(offers, basis), "slug")
    return out.withColumn("varietals", F.coalesce("varietals", F.array().cast("array<string>"))).select(GROUP)


# -- merging and splitting ---------------------------------------------------------------------------------------------


def merge(state: State, mapping: DataFrame, stage: str, basis: str, donate: bool, once: str) -> State:
    """The state after groups of `mapping` (group_slug, merged_into) are one.

    The survivor keeps its slug and name. With `donate` it takes what it lacks (brand, image, varietals, region, type, vintage) from the others, most stores first;
    else only varietals are pooled, three at most. Of its offers with one `once` ("url": address; "offer": store, address and name) the first, or the
    cheapest, stays.
    """
    moves = staged(mapping.where(F.col("group_slug").isNotNull()).select(F.col("group_slug").alias("slug"), F.col("merged_into").alias("into")).distinct(), f"chain-{stage}")
    moves = moves.join(moves.where("slug <> into").select("into").distinct(), "into", "left_semi")
    rows = state.groups.join(moves, "slug")
    place = F.struct((F.col("slug") != F.col("into")), F.negative("store_count"), F.col("slug"))
    own = lambda c: F.max(F.when(F.col("slug") == F.col("into"), F.col(c)))
    given = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place))
    full = rows.withColumn("varietals", F.when(F.size("varietals") > 0, F.col("varietals")))
    kept = full.groupBy("into").agg(own("name").alias("name"), own("format").alias("format"), *[(given(c) if donate else own(c)).alias(c) for c in ("brand", "image_url", "region", "type", "vintage", "varietals")])
    if not donate:
        pool = rows.select("into", place.alias("place"), F.posexplode("varietals").alias("at", "value")).groupBy("into", "value").agg(F.min(F.struct("place", "at")).alias("first"))
        pool = pool.groupBy("into").agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "value"))), 1, 3)["value"].alias("pooled"))
        kept = kept.join(pool, "into", "left").withColumn("varietals", F.col("pooled"))
    kept = kept.withColumn("varietals", F.coalesce("varietals", F.array().cast("array<string>")))
    spots = rows.select("slug", "into", place.alias("place"))
    moved = state.offers.join(spots, "slug").withColumn("slug", F.col("into")).withColumn("ord", F.struct("place", "ord")).drop("into", "place")
    if once == "offer":
        moved = cheapest_wins(moved.withColumn("__tm_url", F.coalesce("url", F.lit(""))), ["slug", "store_slug", "__tm_url", "name"]).drop("__tm_url")
    else:
        # Offers without an address count as one of theirs, as they share the empty one.
        firsts = moved.groupBy("slug", "url").agg(F.min(F.struct("ord", "id")).alias("first"))
        firsts = firsts.select(F.col("slug").alias("s"), F.col("first.ord").alias("o"), F.col("first.id").alias("i"))
        moved = moved.join(firsts, (F.col("slug") == F.col("s")) & (F.col("ord") == F.col("o")) & (F.col("id") == F.col("i")), "left_semi")
    moved = moved.withColumn("ord", F.col("ord.ord"))
    offers = staged(state.offers.join(spots.select("slug"), "slug", "left_anti").unionByName(moved.select(state.offers.columns)), f"chain-{stage}-offers")
    lead = kept.withColumnRenamed("into", "slug")
    lead = lead.join(stock(offers.join(lead.select("slug"), "slug", "left_semi"), basis), "slug", "left").select(GROUP)
    groups = staged(state.groups.join(spots.select("slug"), "slug", "left_anti").unionByName(lead), f"chain-{stage}-groups")
    event = moves.where("slug <> into").select(F.lit(state.t + 1).cast("long").alias("t"), F.lit(stage).alias("stage"), F.col("slug").alias("old"), F.col("into").alias("new"))
    return State(offers, groups, [*state.events, event], state.t + 1)


def link_stage(state: State, links: DataFrame, stage: str) -> State:
    """Groups joined by `links` (src, dst) become one: the one of most stores, then most offers, survives."""
    named = state.groups.withColumnRenamed("slug", "group_slug")
    return merge(state, resolve.merge_groups(named, links), stage, "current" if stage == "image" else "all", False, "url")


def secondary(name: Column, rules: Rules) -> Column:
    """What a name says besides its producer, varietals and noise; `producers` may have several words."""
    plain = brands.forced_brand(name)
    words = peel(F.split(plain, " "), rules.leading or [""], 3)
    rest = F.array_join(words, " ")
    for _ in range(4 if rules.producers else 0):
        rest = F.trim(F.regexp_replace(F.concat(rest, F.lit(" ")), rf"^(?:{'|'.join(sorted(rules.producers, key=lambda x: (-len(x), x)))}) ", ""))
    return F.array_join(F.filter(F.split(rest, " "), lambda w: (w != "") & ~w.isin(list(rules.noise) or [""])), " ")


def resolved(groups: DataFrame, rules: Rules) -> DataFrame:
    """The groups with `resolved`, the brand that a prefix of their name forces or else their own, and `label_brand`, whether a prefix stands for it."""
    rows = groups.withColumn("__tm_id", F.col("slug")).withColumn("__tm_name", F.col("name")).withColumn("__tm_brand", F.col("brand"))
    forced = resolve.prefix_brand(rows.select(F.col("__tm_id").alias("id"), brands.forced_brand(F.col("name"), rules.leading).alias("name"), "brand"), rules.prefixes).select(F.col("id").alias("slug"), F.col("brand").alias("resolved"))
    houses = rules.prefixes.select(F.col("brand").alias("resolved"), F.lit(True).alias("label_brand")).distinct()
    return groups.join(forced, "slug", "left").join(houses, "resolved", "left").withColumn("label_brand", F.coalesce("label_brand", F.lit(False)))


def strict_buckets(groups: DataFrame, rules: Rules) -> DataFrame:
    """group_slug, merged_into of groups that agree in resolved brand, varietals, format, type and secondary key and name one vintage at most.

    Groups with neither a brand nor a varietal take no part.
    """
    rows = resolved(groups, rules).where(F.col("resolved").isNotNull() | (F.size("varietals") > 0))
    rows = rows.withColumn("brand", F.col("resolved")).withColumn("b", F.trim(F.lower(strip_accents(F.col("resolved"))))).withColumn("y", F.trim(F.lower(strip_accents(F.col("type"))))).withColumn("rest", secondary(F.col("name"), rules))
    return resolve.bucket_merge(rows.withColumnRenamed("slug", "group_slug"), ["b", "varietals", "format", "y", "rest"])


def labelled(groups: DataFrame, rules: Rules) -> DataFrame:
    """The groups with `label`, the longest prefix that stands anywhere in their name as whole words; null without."""
    name = brands.forced_brand(F.col("name"))
    words = F.split(name, " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))
    met = groups.select("slug", F.explode(F.array_distinct(runs)).alias("label")).join(rules.prefixes.select(F.lower("prefix").alias("label")).distinct(), "label")
    return groups.join(met.groupBy("slug").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label")), "slug", "left")


def inherit_gates(groups: DataFrame, rules: Rules) -> DataFrame:
    """Buckets of one label in which groups without a varietal stand beside such with one, and why each may not merge.

    bucket columns b, format, label; n, varietal, merged_into and `reason`: null for those that merge, else the first of varietals, types, colours,
    vintages, suffixes that disagrees. Groups whose name says more than producer and noise take no part.
    """
    rows = labelled(resolved(groups, rules), rules).where(F.col("label_brand") & F.col("label").isNotNull() & (secondary(F.col("name"), rules) == ""))
    rows = rows.select("slug", "name", F.lower(strip_accents(F.col("resolved"))).alias("b"), F.coalesce("format", F.lit("")).alias("f"), "label", "varietals", "type", wine.colour(F.col("name")).alias("colour"), "vintage", "store_count")
    rows = staged(rows, "chain-labels")
    bare, filled = F.size("varietals") == 0, F.size("varietals") > 0
    fit = rows.groupBy("b", "f", "label").agg(
        F.count("*").alias("n"), F.count_if(bare).alias("bare"), F.count_if(filled).alias("filled"),
        F.min(F.array_min("varietals")).alias("varietal"), F.max(F.array_max("varietals")).alias("other_varietal"),
        F.min("type").alias("type"), F.max("type").alias("other_type"), F.min("colour").alias("colour"), F.max("colour").alias("other_colour"),
        F.bool_or(F.when(bare, F.col("colour").isNotNull())).alias("bare_colour"), F.bool_or(F.when(filled, F.col("colour").isNotNull())).alias("filled_colour"),
        F.min("vintage").alias("vintage"), F.max("vintage").alias("other_vintage"), F.min_by("slug", F.struct(F.negative("store_count"), "slug")).alias("merged_into"),
    ).where("n > 1 and bare > 0 and filled > 0")
    said = rows.join(fit.select("b", "f", "label", "varietal"), ["b", "f", "label"])
    words = F.split(normalize_name(F.regexp_replace(brands.forced_brand(F.col("name")), r"\.", "")), " ")
    gone = F.concat(F.split("label", " "), F.split(normalize_name(F.col("varietal")), " "))
    rest = F.filter(F.array_except(words, gone), lambda w: (w != "") & ~w.isin([*rules.pure_noise, ""]) & ~w.rlike("^[0-9]{4}$"))
    suffix = F.array_join(F.array_sort(F.array_distinct(rest)), " ")
    suffixes = said.groupBy("b", "f", "label").agg(F.min(suffix).alias("suffix"), F.max(suffix).alias("other_suffix"))
    out = fit.join(suffixes, ["b", "f", "label"])
    colours = (F.col("colour") != F.col("other_colour")) | (F.col("bare_colour") != F.col("filled_colour"))
    reason = F.when(F.col("varietal") != F.col("other_varietal"), "varietals").when(F.col("type") != F.col("other_type"), "types").when(F.coalesce(colours, F.lit(False)), "colours")
    reason = reason.when(F.col("vintage") != F.col("other_vintage"), "vintages").when(F.col("suffix") != F.col("other_suffix"), "suffixes")
    return out.select("b", "f", "label", "n", "varietal", "merged_into", reason.alias("reason"))


def inherit(groups: DataFrame, rules: Rules) -> DataFrame:
    """group_slug, merged_into of the label buckets that pass every gate of `inherit_gates`."""
    fit = inherit_gates(groups, rules).where("reason is null").select("b", "f", "label", "merged_into")
    rows = labelled(resolved(groups, rules), rules).where(F.col("label_brand") & F.col("label").isNotNull() & (secondary(F.col("name"), rules) == ""))
    rows = rows.select("slug", F.lower(strip_accents(F.col("resolved"))).alias("b"), F.coalesce("format", F.lit("")).alias("f"), "label")
    return rows.join(fit, ["b", "f", "label"]).select(F.col("slug").alias("group_slug"), "merged_into")


def split_tokens(name: Column, stop: Sequence[str]) -> Column:
    plain = F.regexp_replace(F.lower(strip_accents(name)), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(list(stop) or [""])))


def split(state: State, rules: Rules) -> State:
    """Groups that hold several products are parted and all parts described anew from their own offers; the largest keeps the slug."""
    own = state.offers.select(F.col("slug").alias("group_slug"), F.struct("ord", "id").alias("ord"), "sku", split_tokens(F.col("name"), rules.split_stop).alias("tokens"))
    parts = resolve.split_chimeras(own)
    parts = staged(parts.select(F.col("group_slug").alias("slug"), F.col("ord.ord").alias("ord"), F.col("ord.id").alias("id"), "new_slug").distinct(), "chain-split")
    moved = state.offers.join(parts, ["slug", "ord", "id"]).withColumn("slug", F.col("new_slug")).select(state.offers.columns)
    offers = staged(state.offers.join(parts.select("slug").distinct(), "slug", "left_anti").unionByName(moved), "chain-split-offers")
    anew = describe(offers.join(parts.select(F.col("new_slug").alias("slug")).distinct(), "slug", "left_semi"), "in_stock")
    groups = staged(state.groups.join(parts.select("slug").distinct(), "slug", "left_anti").unionByName(anew), "chain-split-groups")
    return replace(state, offers=offers, groups=groups, t=state.t + 1)


def branches(before: State, after: State) -> DataFrame:
    """old, new: slugs that a split has made, and the group each came from. A reference to the old slug stays with it."""
    own = before.offers.select("id", F.col("slug").alias("old"))
    return own.join(after.offers.select("id", F.col("slug").alias("new")), "id").where("old <> new").select("old", "new").distinct()


# -- the whole chain ---------------------------------------------------------------------------------------------------


Links = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Result:
    offers: DataFrame
    groups: DataFrame
    events: DataFrame
    branches: DataFrame


def resolve_listings(listings: DataFrame, rules: Rules, links: Sequence[tuple[str, Links]] = ()) -> Result:
    """Run all stages over listings (id, ord, store_slug, url, sku, name, brand, image_url, price, in_stock).

    `links`: named functions from groups to (src, dst), one stage each, such as images, vectors or decided pairs. `id` is unique. events has (t, stage, old, new);
    the keys' own slugs leave at t = 0, by product number or as subsets.

    Edge cases: listings with an empty key (null, empty or all-noise names) are in no group; a null price, image, brand, product number or address is none; an
    empty table gives empty tables.
    """
    rows = staged(attributes(keyed(clean(listings.select(LISTING), rules)), rules.collector), "chain-keyed")
    slugs = staged(first_slugs(rows), "chain-slugs")
    offers = staged(rows.join(slugs.select("key", "slug"), "key"), "chain-offers")
    zero = slugs.where("by is not null").select(F.lit(0).cast("long").alias("t"), F.col("by").alias("stage"), slug_of(F.col("key")).alias("old"), F.col("slug").alias("new"))
    state = State(offers, staged(describe(offers), "chain-groups"), [zero])
    for stage, found in links:
        state = link_stage(state, found(state.groups), stage)
    state = merge(state, strict_buckets(state.groups, rules), "bucket", "in_stock", True, "offer")
    state = merge(state, inherit(state.groups, rules), "inherit", "in_stock", True, "offer")
    last = split(state, rules)
    events = last.events[0]
    for x in last.events[1:]:
        events = events.unionByName(x)
    return Result(last.offers, last.groups, staged(events, "chain-events"), branches(state, last))
