"""Queries over the resolution chain.

The driver's parts become shop listings in families of fifty, in which each stage has something to do and each of its gates something to refuse: words in another
order, shared product numbers, names that are part of others, missing, bad and mapped brands, brands that a prefix or a line word gives away, shared
pictures, lines that differ in noise only, labels with and without a grape, and groups that hold two products.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import wine
from tallymark.operators import chain, lineage, resolve, vectors
from tallymark.plans import views as v
from tallymark.plans import wines
from tallymark.plans.registry import _cases, query
from tallymark.session import staged

#: Of each place in a family: name, brand (null: none), image and whether it has a product number. `{f}` is the family's word, `{year}` one of two years.
PLACES = [
    ("{f} Malbec Reserva", "Casa {f}", None, False), ("Reserva {f} MALBEC", "Casa {f}", None, False),
    ("{f} Oro Gran", "Casa {f}", None, True), ("{f} Oro Especial", "Casa {f}", None, True), ("{f} Oro Gran", "Casa {f}", None, False),
    ("{f} Corte Uno", "Casa {f}", None, False), ("{f} Corte Uno", "Casa {f}", None, False), ("{f} Corte", None, None, False),
    ("{f} Gran", None, None, False), ("{f} Gran Dos", "Casa {f}", None, False), ("{f} Gran Dos", "Casa {f}", None, False),
    ("Casa {f} Blanco Joven", None, None, False), ("{f} Blanco Joven", "Casa {f}", None, False),
    ("{f} Torrontes", "Casa {f} Alta", None, False), ("Casa {f} Alta Torrontes", None, None, False),
    ("linea{f} Rosado", "Casa {f}", None, False), ("linea{f} Blanco", "Casa {f}", None, False), ("linea{f} Dulce", "Casa {f}", None, False), ("linea{f} Rosado", None, None, False),
    ("mezcla{f} Uno", "Casa {f}", None, False), ("mezcla{f} Dos", "Casa {f}", None, False), ("mezcla{f} Tres", "Otra {f}", None, False), ("mezcla{f} Cuatro", "Otra {f}", None, False), ("mezcla{f} Cinco", None, None, False),
    ("Sello {f} Syrah{syrah}", "Casa {f}", None, False), ("Sello {f}{bare}", None, None, False), ("{extra}", "Casa {f}", None, False),
    ("{f} Tannat Premium{first}", "Casa {f}", None, False), ("{f} Tannat{second}", "Casa {f}", None, False), ("{f} Semillon", "Reserva", None, False),
    *[("{f} Merlot Roble", "Casa {f}", None, False)] * 4, *[("{f} Merlot Clasico", "Casa {f}", None, False)] * 5, ("{f} Reserva Semillon", None, None, False),
    ("{f} Bonarda Alta Parcela", "Casa {f}", "p", False), ("{f} Bonarda Alta Parcela Baja", "Casa {f}", "p", False), ("{f} Bonarda Alta Parcela", "Otra {f}", "p", False), ("{f} Alta Parcela Bonita", "Casa {f}", "p", False),
    ("{f} Bonarda Alta Parcela 1500 ml", "Casa {f}", "p", False), ("{f} Viognier", "Sin Marca", None, False), ("{f} Viognier", "La Casa {f}", None, False), ("{f} Viognier", "Casa {f}", None, False), ("Vino Tinto 750 ml", None, None, False), ("{f} Uno", None, None, False),
]
#: What differs by family, so that each gate of the label stage refuses somewhere: nothing, types, varietals, vintages, suffixes, colours.
SYRAH, BARE = ["", "", "", " 2018", "", " Tardio"], ["", " Blanco", "", " 2019", " Reserva", ""]
FIRST, SECOND = ["", " 2015", " 2015"], ["", " 2016", ""]
FAMILY = len(PLACES)
LEADING, NOISE = ["vino", "espumante"], ["vino", "malbec", "tannat", "syrah", "merlot", "bonarda", "semillon", "viognier", "premium", "roble", "clasico", "reserva", "blanco", "tardio", "tinto", "2015", "2016", "2018", "2019"]
PURE = ["vino", "tinto", "blanco", "rosado", "premium"]
STOP = ["merlot", "casa", "reserva"]
GENERIC = ["reserva"]


def _filled(said: str) -> str:
    """A place's text as SQL over word (the family's) and f (its number), for Spark and DuckDB alike."""
    pick = lambda values: f"CASE f % {len(values)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(values)) + " END"
    parts = {"{f}": "word", "{syrah}": pick(SYRAH), "{bare}": pick(BARE), "{first}": pick(FIRST), "{second}": pick(SECOND), "{extra}": "CASE WHEN f % 6 = 2 THEN concat('Sello ', word, ' Malbec') ELSE concat(word, ' Cinsault') END"}
    out, rest = [], said
    while rest:
        at = min((rest.find(k) for k in parts if k in rest), default=-1)
        if at < 0:
            out.append(f"'{rest}'")
            break
        if at:
            out.append(f"'{rest[:at]}'")
        name = rest[at : rest.index("}", at) + 1]
        out.append(parts[name])
        rest = rest[at + len(name) :]
    return f"concat({', '.join(out)})"


def _case(column: int) -> str:
    return f"CASE p_partkey % {FAMILY} " + " ".join(f"WHEN {k} THEN {_filled(x[column])}" for k, x in enumerate(PLACES) if x[column]) + " END"


def _shelf_sql(integer: str) -> str:
    """Listings of the parts, in SQL that both engines run. The last two of the same wine at one shop share shop and address."""
    numbered = ", ".join(str(k) for k, x in enumerate(PLACES) if x[3])
    return f"""SELECT p_partkey AS id, p_partkey AS ord, p_partkey % {FAMILY} AS place, CASE WHEN p_partkey % {FAMILY} = 38 THEN 37 ELSE p_partkey % {FAMILY} END % 7 AS store_slug,
 CASE WHEN p_partkey % 50 = 38 THEN concat('u', CAST(p_partkey - 1 AS {integer})) ELSE concat('u', CAST(p_partkey AS {integer})) END AS url,
 CASE WHEN p_partkey % {FAMILY} IN ({numbered}) THEN lpad(CAST(f AS {integer}), 13, '7') END AS sku,
 {_case(0)} AS name, {_case(1)} AS brand, CASE WHEN p_partkey % {FAMILY} IN ({", ".join(str(k) for k, x in enumerate(PLACES) if x[2])}) THEN concat('img/', word, '.jpg') END AS image_url,
 p_retailprice - CASE WHEN p_partkey % {FAMILY} = 38 THEN 50 ELSE 0 END AS price, p_size % 5 > 0 AS in_stock
 FROM (SELECT *, CAST(floor(p_partkey / {FAMILY}) AS INT) AS f, concat('casona', CAST(CAST(floor(p_partkey / {FAMILY}) AS INT) AS {integer})) AS word FROM part)"""


def shelf(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_shelf_sql("STRING").replace("FROM part)", "FROM {part})"), part=v.read(spark, d, "part"))


def rules(spark: SparkSession, d: str) -> chain.Rules:
    families = v.read(spark, d, "part").select(F.floor(F.col("p_partkey") / FAMILY).cast("int").alias("f")).distinct().withColumn("word", F.concat(F.lit("casona"), F.col("f").cast("string")))
    prefixes = families.select(F.concat(F.lit("sello "), "word").alias("prefix"), F.concat(F.lit("Sello "), "word").alias("brand"), F.col("f").alias("ord"))
    aliases = families.select(F.concat(F.lit("la casa "), "word").alias("from"), F.concat(F.lit("Casa "), "word").alias("to"), F.col("f").alias("ord"))
    bad = spark.createDataFrame([("sin marca",)], ["brand"])
    # Producers are patterns: one covers every family's label.
    return chain.Rules(prefixes, bad, aliases, LEADING, ["sello casona[0-9]+", "casa casona[0-9]+"], NOISE, PURE, GENERIC, 2016, STOP)


def image_stage(groups: DataFrame) -> DataFrame:
    named = groups.select(F.col("slug").alias("group_slug"), "image_url", "brand", "varietals", "type", "format", F.split(F.lower("name"), " ").alias("tokens"))
    return resolve.image_links(named)


# -- the same chain in SQL ---------------------------------------------------------------------------------------------

_quoted = lambda values: ", ".join(f"'{x}'" for x in values)
_PLAIN = "regexp_replace(regexp_replace(lower(name), '^(vino|espumante)\\s+', ''), '^(vino|espumante)\\s+', '')"
_WORDS = rf"[w FOR w IN string_split(trim(regexp_replace(lower(name), '[0-9]+ ml', '')), ' ') IF length(w) > 1 AND w NOT IN ({_quoted(wine.NOISE)}) AND NOT regexp_full_match(w, '19[0-9][0-9]|20[0-2][0-9]')]"
_GRAPES_OF = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(name, '(?i){p}') THEN '{label}' END" for label, p in wine.VARIETALS) + "] IF x IS NOT NULL][1:3]"

_CLEAN = rf"""shelf AS ({_shelf_sql("VARCHAR")}),
prefixes AS (SELECT DISTINCT 'sello casona' || (p_partkey // {FAMILY})::VARCHAR AS prefix, 'Sello casona' || (p_partkey // {FAMILY})::VARCHAR AS house FROM part),
forced AS (SELECT s.*, coalesce(house, brand) AS brand1 FROM (SELECT *, {_PLAIN} AS plain FROM shelf) s LEFT JOIN prefixes ON plain = prefix OR starts_with(plain, prefix || ' ')),
clean AS (SELECT * REPLACE (CASE WHEN lower(brand1) = 'sin marca' THEN NULL WHEN regexp_matches(lower(brand1), '^la casa casona[0-9]+$') THEN 'Casa ' || split_part(brand1, ' ', 3) ELSE brand1 END AS brand) FROM forced),
known AS (SELECT lower(brand) AS label, arg_min(brand, ord) AS shown, min(ord) AS first FROM clean WHERE length(brand) >= 3 AND lower(brand) NOT IN ({_quoted(GENERIC)}) GROUP BY 1),
by_name AS (SELECT id, arg_min(shown, (-length(label), first)) AS found FROM clean JOIN known ON contains(' ' || lower(name) || ' ', ' ' || label || ' ') WHERE brand IS NULL GROUP BY 1),
pass1 AS (SELECT c.* REPLACE (coalesce(c.brand, found) AS brand), CASE WHEN c.brand IS NOT NULL THEN 'own' WHEN found IS NOT NULL THEN 'name' END AS brand_from, {_WORDS.replace("name", "c.name")} AS words FROM clean c LEFT JOIN by_name USING (id)),
line_counts AS (SELECT label, word, count(*) AS n FROM (SELECT lower(brand) AS label, unnest(list_distinct(words)) AS word FROM pass1 WHERE length(brand) >= 3) WHERE length(word) >= 4 AND NOT list_contains([x FOR x IN string_split(label, ' ') IF length(x) >= 3], word) GROUP BY 1, 2),
shown AS (SELECT lower(brand) AS label, arg_min(brand, ord) AS shown FROM pass1 WHERE length(brand) >= 3 GROUP BY 1),
lines AS (SELECT word, shown FROM (SELECT word, min(label) AS label FROM line_counts GROUP BY 1 HAVING count(*) = 1 AND max(n) >= 3) JOIN shown USING (label)),
by_line AS (SELECT id, arg_min(shown, spot) AS found FROM (SELECT id, generate_subscripts(words, 1) AS spot, unnest(words) AS word FROM pass1 WHERE brand IS NULL) JOIN lines USING (word) GROUP BY 1),
branded AS (SELECT p.* REPLACE (coalesce(brand, found) AS brand, CASE WHEN brand IS NULL AND found IS NOT NULL THEN 'line' ELSE brand_from END AS brand_from) FROM pass1 p LEFT JOIN by_line USING (id))"""


def _stock_sql(offers: str, basis: str) -> str:
    fine, now = "in_stock AND NOT is_collector", "in_stock"
    part = lambda when: (f"count(DISTINCT store_slug) FILTER ({when})", f"min(price) FILTER ({when} AND price > 0)", f"max(price) FILTER ({when} AND price > 0)")
    a, b = part(fine), part(now if basis != "all" else "true")
    stores, low, high = (f"CASE WHEN count(*) FILTER ({fine}) > 0 THEN {x} ELSE {y} END" if basis == "current" else y for x, y in zip(a, b))
    count = "count(*) FILTER (in_stock)" if basis == "current" else "count(*)"
    return f"SELECT slug, {stores} AS store_count, {count} AS offer_count, {low} AS min_price, {high} AS max_price FROM {offers} GROUP BY slug"


def _describe_sql(name: str, offers: str, basis: str) -> str:
    return rf"""{name}_v AS (SELECT slug, list(v ORDER BY n DESC, first)[1:3] AS varietals FROM (SELECT slug, v, count(*) AS n, min((ord, spot)) AS first FROM (SELECT slug, ord, generate_subscripts(varietals, 1) AS spot, unnest(varietals) AS v FROM {offers}) GROUP BY 1, 2) GROUP BY 1),
{name}_t AS (SELECT slug, arg_min(type, (-n, first)) AS type FROM (SELECT slug, type, count(*) AS n, min(ord) AS first FROM {offers} WHERE type IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
{name}_s AS ({_stock_sql(offers, basis)}),
{name} AS (SELECT slug, name, brand, vintage, format, image_url, coalesce(varietals, []) AS varietals, type, store_count, offer_count, min_price, max_price
 FROM (SELECT slug, arg_min(name, (length(name), ord)) AS name, regexp_replace(arg_min(brand, ord), '(?i)^bodegas?\s+', '') AS brand, first(vintage ORDER BY ord) AS vintage, first(format ORDER BY ord) AS format, arg_min(image_url, ord) AS image_url FROM {offers} GROUP BY 1)
 LEFT JOIN {name}_v USING (slug) LEFT JOIN {name}_t USING (slug) JOIN {name}_s USING (slug))"""


def _merge_sql(k: int, mapping: str, basis: str, donate: bool, once: str) -> str:
    """Tables o{k}, g{k} after the groups of `mapping` (slug, into) are one; events in m{k}."""
    o, g = f"o{k - 1}", f"g{k - 1}"
    place = "(slug <> into_slug, -store_count, slug)"
    columns = ["brand", "image_url", "type", "vintage"]
    took = ", ".join(f"arg_min({c}, {place}) AS {c}" if donate else f"max({c}) FILTER (slug = into_slug) AS {c}" for c in columns)
    varietals = f"coalesce(arg_min(CASE WHEN len(varietals) > 0 THEN varietals END, {place}), []) AS varietals" if donate else "[] AS varietals"
    pooled = "k.varietals" if donate else "coalesce(p.pooled, [])"
    keep = "ranked AS (SELECT *, row_number() OVER (PARTITION BY into_slug, url ORDER BY place, ord, id) AS n FROM moved)" if once == "url" else "ranked AS (SELECT *, row_number() OVER (PARTITION BY into_slug, store_slug, url, name ORDER BY CASE WHEN fp IS NOT NULL THEN price END NULLS LAST, place, ord) AS n FROM (SELECT *, first_value(price) OVER (PARTITION BY into_slug, store_slug, url, name ORDER BY place, ord) AS fp FROM moved))"
    return rf"""m{k} AS (SELECT DISTINCT slug, into_slug FROM ({mapping}) WHERE into_slug IN (SELECT into_slug FROM ({mapping}) WHERE slug <> into_slug)),
r{k} AS (SELECT g.*, into_slug FROM {g} g JOIN m{k} USING (slug)),
k{k} AS (SELECT into_slug, max(name) FILTER (slug = into_slug) AS name, max(format) FILTER (slug = into_slug) AS format, {took}, {varietals} FROM r{k} GROUP BY 1),
p{k} AS (SELECT into_slug, list(v ORDER BY first)[1:3] AS pooled FROM (SELECT into_slug, v, min((place, spot)) AS first FROM (SELECT into_slug, {place} AS place, generate_subscripts(varietals, 1) AS spot, unnest(varietals) AS v FROM r{k}) GROUP BY 1, 2) GROUP BY 1),
moved{k} AS (SELECT o.*, into_slug, {place.replace("slug <>", "r.slug <>").replace(", slug)", ", r.slug)")} AS place FROM {o} o JOIN r{k} r USING (slug)),
{keep.replace("ranked", f"ranked{k}").replace("FROM moved", f"FROM moved{k}")},
n{k} AS (SELECT * EXCLUDE (into_slug, place, n{", fp" if once != "url" else ""}) REPLACE (into_slug AS slug) FROM ranked{k} WHERE n = 1),
s{k} AS ({_stock_sql(f"n{k}", basis)}),
o{k} AS (SELECT * FROM {o} WHERE slug NOT IN (SELECT slug FROM m{k}) UNION ALL BY NAME SELECT * FROM n{k}),
g{k} AS (SELECT * FROM {g} WHERE slug NOT IN (SELECT slug FROM m{k}) UNION ALL BY NAME SELECT k.into_slug AS slug, k.name, k.brand, k.vintage, k.format, k.image_url, {pooled} AS varietals, k.type, s.store_count, s.offer_count, s.min_price, s.max_price FROM k{k} k LEFT JOIN p{k} p USING (into_slug) LEFT JOIN s{k} s ON s.slug = k.into_slug)"""


def _resolved_sql(name: str, groups: str) -> str:
    rest = "trim(regexp_replace(regexp_replace(x, '^(vino|espumante)\\s+', ''), '^(vino|espumante)\\s+', '')) || ' '"
    for _ in range(4):
        rest = f"regexp_replace({rest}, '^(sello casona[0-9]+|casa casona[0-9]+) ', '')"
    return rf"""{name} AS (SELECT g.*, coalesce(p.house, brand) AS resolved, array_to_string([w FOR w IN string_split(trim({rest.replace("(x,", "(lower(name),")}), ' ') IF w <> '' AND w NOT IN ({_quoted(NOISE)})], ' ') AS rest
 FROM {groups} g LEFT JOIN prefixes p ON {_PLAIN} = p.prefix OR starts_with({_PLAIN}, p.prefix || ' '))"""


_COLOUR = "CASE regexp_replace(regexp_extract(lower(name), '" + wine.COLOURS.replace("(?:", "(") + r"', 1), '\s', '', 'g') WHEN '' THEN NULL WHEN 'tardio' THEN 'dulce' ELSE regexp_replace(regexp_extract(lower(name), '" + wine.COLOURS.replace("(?:", "(") + "', 1), '\\s', '', 'g') END"


def _gates_sql(groups: str) -> str:
    return rf"""{_resolved_sql("lr", groups)},
lab AS (SELECT lr.*, l.prefix AS label, strip_accents(lower(resolved)) AS b, coalesce(format, '') AS f, {_COLOUR} AS colour FROM lr JOIN prefixes l ON contains(' ' || lower(name) || ' ', ' ' || l.prefix || ' ') WHERE rest = '' AND resolved IN (SELECT house FROM prefixes)),
fit AS (SELECT b, f, label, count(*) AS n, count(*) FILTER (len(varietals) = 0) AS bare, count(*) FILTER (len(varietals) > 0) AS filled, min(list_min(varietals)) AS varietal, max(list_max(varietals)) AS v2, min(type) AS type, max(type) AS t2,
 min(colour) AS colour, max(colour) AS c2, coalesce(bool_or(colour IS NOT NULL) FILTER (len(varietals) = 0), false) AS bc, coalesce(bool_or(colour IS NOT NULL) FILTER (len(varietals) > 0), false) AS fc, min(vintage) AS vintage, max(vintage) AS y2, arg_min(slug, (-store_count, slug)) AS merged_into FROM lab GROUP BY 1, 2, 3 HAVING count(*) > 1 AND bare > 0 AND filled > 0),
suf AS (SELECT b, f, label, array_to_string(list_sort(list_distinct([w FOR w IN string_split(lower(name), ' ') IF w <> '' AND NOT list_contains(string_split(label, ' '), w) AND w <> lower(fit.varietal) AND w NOT IN ({_quoted(PURE)}) AND NOT regexp_full_match(w, '[0-9]{{4}}')])), ' ') AS s FROM lab JOIN fit USING (b, f, label)),
gates AS (SELECT b, f, label, n, varietal, merged_into, CASE WHEN varietal <> v2 THEN 'varietals' WHEN type <> t2 THEN 'types' WHEN coalesce(colour <> c2, false) OR bc <> fc THEN 'colours' WHEN vintage <> y2 THEN 'vintages' WHEN u.s1 <> u.s2 THEN 'suffixes' END AS reason
 FROM fit JOIN (SELECT b, f, label, min(s) AS s1, max(s) AS s2 FROM suf GROUP BY 1, 2, 3) u USING (b, f, label))"""


def _keyed_sql() -> str:
    return rf"""{_CLEAN},
keyed AS (SELECT *, array_to_string(list_sort(list_concat(words, house)), ' ') AS key FROM (SELECT *, [t FOR t IN string_split(coalesce(regexp_replace(lower(brand), '^bodegas?\s+', ''), ''), ' ') IF t <> '' AND t NOT IN ({_quoted(wine.NOISE)}) AND NOT list_contains(words, t)] AS house FROM branded)),
rows0 AS (SELECT id, ord, store_slug, url, sku, name, brand, image_url, price, in_stock, key, CAST(nullif(regexp_extract(name, '\b(19[0-9][0-9]|20[0-2][0-9])\b', 1), '') AS INTEGER) AS vintage, CASE WHEN contains(name, '1500 ml') THEN '1500ml' END AS format, {_GRAPES_OF} AS varietals, {_cases(wine.TYPES, "name")} AS type FROM keyed WHERE key <> ''),
listed AS (SELECT *, coalesce(vintage <= 2016, false) AS is_collector FROM rows0),
ks AS (SELECT DISTINCT key, sku FROM listed WHERE regexp_full_match(sku, '[0-9]{{12,14}}')), ke AS (SELECT DISTINCT a.key AS x, b.key AS y FROM ks a JOIN ks b USING (sku)),
kr AS (SELECT DISTINCT key AS node, key AS reach FROM listed UNION SELECT kr.node, ke.y FROM kr JOIN ke ON kr.reach = ke.x), kc AS (SELECT node AS key, min(reach) AS component FROM kr GROUP BY 1),
kn AS (SELECT key, count(*) AS n FROM listed GROUP BY 1), kl AS (SELECT component, arg_min(key, (-n, key)) AS merged FROM kc JOIN kn USING (key) GROUP BY 1),
numbers AS (SELECT key, merged, n FROM kc JOIN kn USING (key) JOIN kl USING (component)), sized AS (SELECT merged, sum(n) AS n FROM numbers GROUP BY 1),
subsets AS (SELECT a.merged, min(b.merged) AS target FROM sized a JOIN sized b ON a.n = 1 AND b.n > 1 AND len(list_distinct(string_split(a.merged, ' '))) >= 2 AND list_has_all(string_split(b.merged, ' '), string_split(a.merged, ' ')) GROUP BY 1 HAVING count(*) = 1),
slugs AS (SELECT key, replace(coalesce(target, merged), ' ', '-') AS slug, CASE WHEN target IS NOT NULL THEN 'subset' WHEN key <> merged THEN 'number' END AS by_what FROM numbers LEFT JOIN subsets USING (merged)),
o0 AS (SELECT l.*, slug FROM listed l JOIN slugs USING (key)),
{_describe_sql("g0", "o0", "current")}"""


def _chain_sql() -> str:
    jaccard = "len(list_intersect(x.tk, y.tk))::DOUBLE / len(list_distinct(list_concat(x.tk, y.tk)))"
    return rf"""{_keyed_sql()},
held AS (SELECT *, lower(brand) AS bk, string_split(lower(name), ' ') AS tk FROM g0 WHERE image_url IN (SELECT image_url FROM g0 GROUP BY 1 HAVING count(*) > 1 AND NOT (count(*) >= 5 AND count(DISTINCT lower(brand)) >= 3))),
links AS (SELECT x.slug AS src, y.slug AS dst FROM held x JOIN held y ON x.image_url = y.image_url AND x.bk = y.bk AND x.slug < y.slug AND (x.type IS NULL OR y.type IS NULL OR x.type = y.type) AND (x.format IS NULL OR y.format IS NULL OR x.format = y.format) AND (x.format IS NULL) = (y.format IS NULL)
 AND (len(x.varietals) + len(y.varietals) = 0 OR list_has_any(x.varietals, y.varietals)) AND {jaccard} >= 0.7::DOUBLE),
le AS (SELECT src AS x, dst AS y FROM links UNION SELECT dst, src FROM links), lr0 AS (SELECT x AS node, x AS reach FROM le UNION SELECT lr0.node, le.y FROM lr0 JOIN le ON lr0.reach = le.x),
lc AS (SELECT node AS slug, min(reach) AS component FROM lr0 GROUP BY 1), ll AS (SELECT component, arg_min(slug, (-store_count, -offer_count, slug)) AS into_slug FROM lc JOIN g0 USING (slug) GROUP BY 1),
{_merge_sql(1, "SELECT slug, into_slug FROM lc JOIN ll USING (component)", "current", False, "url")},
{_resolved_sql("br", "g1")},
bk AS (SELECT slug, store_count, vintage, concat_ws('|', coalesce(strip_accents(lower(resolved)), ''), array_to_string(list_sort(varietals), ','), coalesce(format, ''), coalesce(strip_accents(lower(type)), ''), rest) AS bucket FROM br WHERE resolved IS NOT NULL OR len(varietals) > 0),
bb AS (SELECT bucket, arg_min(slug, (-store_count, slug)) AS into_slug FROM bk GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT vintage) <= 1),
{_merge_sql(2, "SELECT slug, into_slug FROM bk JOIN bb USING (bucket)", "in_stock", True, "offer")},
{_gates_sql("g2")},
{_merge_sql(3, "SELECT lab.slug, gates.merged_into AS into_slug FROM lab JOIN gates USING (b, f, label) WHERE reason IS NULL", "in_stock", True, "offer")},
st AS (SELECT slug, id, sku, list_distinct([w FOR w IN string_split(lower(name), ' ') IF NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_quoted(STOP)})]) AS tk FROM o3 WHERE slug IN (SELECT slug FROM o3 GROUP BY 1 HAVING count(*) >= 8)),
sz AS (SELECT slug, count(*) AS size FROM st GROUP BY 1), sc AS (SELECT slug, w, count(*) AS n FROM (SELECT slug, unnest(tk) AS w FROM st) GROUP BY 1, 2),
sp AS (SELECT slug, list(w) AS splitters FROM sc JOIN sz USING (slug) WHERE n >= greatest(3, ceil(0.1::DOUBLE * size)) AND n <= floor(0.75::DOUBLE * size) GROUP BY 1 HAVING count(*) >= 2),
sh AS (SELECT slug, id, sku, coalesce(list_filter(tk, lambda w: list_contains(splitters, w))[1], '') AS cluster, len(list_filter(tk, lambda w: list_contains(splitters, w))) AS held FROM st JOIN sp USING (slug)),
sn AS (SELECT slug, cluster, count(*) AS n, max(held) AS held FROM sh GROUP BY 1, 2),
sf AS (SELECT slug, arg_min(cluster, (-n, cluster)) AS lead FROM sn WHERE slug NOT IN (SELECT slug FROM sh WHERE sku IS NOT NULL GROUP BY slug, sku HAVING count(DISTINCT cluster) > 1) GROUP BY 1 HAVING max(held) <= 1 AND count(*) FILTER (n >= 3) >= 2),
so AS (SELECT id, slug AS old, CASE WHEN cluster = lead THEN slug ELSE slug || '__' || CASE WHEN cluster = '' THEN 'var' ELSE cluster[1:10] END END AS slug FROM sh JOIN sf USING (slug)),
o4 AS (SELECT o.* REPLACE (so.slug AS slug) FROM o3 o JOIN so USING (id)),
{_describe_sql("g4", "o4", "in_stock")},
final_groups AS (SELECT * FROM g3 WHERE slug NOT IN (SELECT old FROM so) UNION ALL BY NAME SELECT * FROM g4)"""


# -- queries -----------------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, d: str) -> chain.Result:
    return chain.resolve_listings(shelf(spark, d), rules(spark, d), [("image", image_stage)])


@query(f"WITH {_CLEAN}\nSELECT id, brand, brand_from FROM branded")
def two_pass_brands(spark, d):
    return chain.clean(shelf(spark, d), rules(spark, d)).select("id", "brand", "brand_from")


@query(f"WITH {_keyed_sql()},\n{_gates_sql('g0')}\nSELECT label, n, varietal, merged_into, reason FROM gates")
def inherit_gates(spark, d):
    rows = staged(chain.attributes(chain.keyed(chain.clean(shelf(spark, d), rules(spark, d))), 2016), "gates-listings")
    offers = staged(rows.join(chain.first_slugs(rows).select("key", "slug"), "key"), "gates-offers")
    return chain.inherit_gates(chain.describe(offers), rules(spark, d)).select("label", "n", "varietal", "merged_into", "reason")


@query(f"WITH {_chain_sql()}\nSELECT slug, name, brand, vintage, format, image_url, array_to_string(varietals, ',') AS varietals, type, store_count, offer_count, min_price, max_price FROM final_groups")
def chain_groups(spark, d):
    return _run(spark, d).groups.withColumn("varietals", F.array_join("varietals", ",")).drop("region")


@query(f"""WITH {_chain_sql()},
ev AS (SELECT 0 AS t, by_what AS stage, replace(key, ' ', '-') AS old, slug AS new FROM slugs WHERE by_what IS NOT NULL UNION ALL SELECT 1, 'image', slug, into_slug FROM m1 WHERE slug <> into_slug
 UNION ALL SELECT 2, 'bucket', slug, into_slug FROM m2 WHERE slug <> into_slug UNION ALL SELECT 3, 'inherit', slug, into_slug FROM m3 WHERE slug <> into_slug),
fw AS (SELECT t, old, new AS final, t AS reached, 1 AS hops FROM ev UNION ALL SELECT fw.t, fw.old, e.new, e.t, hops + 1 FROM fw JOIN ev e ON e.old = fw.final AND e.t > fw.reached)
SELECT t::BIGINT AS t, stage, old, new, final, hops::BIGINT AS hops FROM ev JOIN (SELECT t, old, arg_max(final, reached) AS final, max(hops) AS hops FROM fw GROUP BY 1, 2) USING (t, old)
UNION ALL SELECT 4, 'split', old, slug, slug, 1 FROM (SELECT DISTINCT old, slug FROM so WHERE old <> slug)""")
def chain_lineage(spark, d):
    out = _run(spark, d)
    split = out.branches.select(F.lit(4).cast("long").alias("t"), F.lit("split").alias("stage"), "old", "new", F.col("new").alias("final"), F.lit(1).cast("long").alias("hops"))
    return lineage.compress(out.events).unionByName(split)


# -- close vectors under gates -----------------------------------------------------------------------------------------

#: Signals that a name adds, by group, so that each gate refuses somewhere.
SIGNALS = ["", " tinto", " blanco", " dulce", " extra brut", " extra-brut", " demi sec", " expo 13", " expo 24 bot", " 750", " rosado rose", "", ""]
FORMATS = [None, "1500ml", "caja", None, "1l", None, None]


def _signalled(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("group_slug") % len(values) + 1).cast("int"))
    rows = wines.wines(spark, d).select("group_slug", F.concat("name", pick(SIGNALS)).alias("name"), "varietals", "type", pick(FORMATS).alias("format"))
    return rows.join(v.read(spark, d, "embeddings").select(F.col("vec_id").alias("group_slug"), "embedding"), "group_slug")


def _words_sql(words: list[str]) -> str:
    pattern = lambda w: re.sub(r"[-\s]", r"[-\\s]?", w)
    return "[x FOR x IN [" + ", ".join(rf"CASE WHEN regexp_matches(lower(name), '\b{pattern(w)}\b') THEN '{w}' END" for w in words) + "] IF x IS NOT NULL]"


_EDITION = r"nullif(regexp_extract(lower(name), '\b([0-9]{1,3})\s*(bot|un|unid|edicion|n\.?)?\b', 1), '')"


@query(rf"""WITH {wines.WINES},
s AS (SELECT group_slug, name || {SIGNALS!r}[group_slug % {len(SIGNALS)} + 1] AS name, varietals, type, [{", ".join("NULL" if x is None else f"'{x}'" for x in FORMATS)}][group_slug % {len(FORMATS)} + 1] AS format FROM wines),
g AS (SELECT s.*, {_words_sql(vectors.COLOUR_WORDS)} AS colours, {_words_sql(vectors.SWEETNESS_WORDS)} AS sweet, {_EDITION} AS edition, coalesce(regexp_full_match(format, '[0-9]+(ml|l)'), false) AS volume,
 [x::DOUBLE / sqrt(list_dot_product([y::DOUBLE FOR y IN embedding], [y::DOUBLE FOR y IN embedding])) FOR x IN embedding] AS u FROM s JOIN embeddings ON vec_id = group_slug),
p AS (SELECT a.group_slug AS a, b.group_slug AS b, list_dot_product(a.u, b.u) AS sim FROM g a JOIN g b ON a.group_slug < b.group_slug AND (len(a.varietals) = 0 OR len(b.varietals) = 0 OR list_has_any(a.varietals, b.varietals)) AND (a.type IS NULL OR b.type IS NULL OR a.type = b.type)
 AND (a.format IS NULL OR b.format IS NULL OR a.format = b.format) AND a.volume = b.volume AND (len(a.colours) = 0 OR len(b.colours) = 0 OR a.colours = b.colours) AND (len(a.sweet) = 0 OR len(b.sweet) = 0 OR a.sweet = b.sweet)
 AND (a.edition IS NULL OR b.edition IS NULL OR a.edition = b.edition OR a.edition IN ('750', '375', '187', '1500') OR b.edition IN ('750', '375', '187', '1500'))),
r AS (SELECT *, sim >= 0.32::DOUBLE AS high, row_number() OVER (PARTITION BY a, sim >= 0.32::DOUBLE ORDER BY sim DESC, b) AS k FROM p WHERE sim >= 0.2::DOUBLE)
SELECT a, b, round(sim, 6) AS sim, CASE WHEN high THEN 'merge' ELSE 'ask' END AS verdict FROM r WHERE k <= CASE WHEN high THEN 5 ELSE 3 END""")
def vector_candidates(spark, d):
    pairs = vectors.gated_pairs(_signalled(spark, d), "group_slug", "embedding", 0.2, bands=[(0.32, 5), (0.2, 3)])
    links, grey = resolve.best_links(pairs, 0.32)
    named = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "sim", F.lit("merge").alias("verdict"))
    return named.unionByName(grey.withColumn("verdict", F.lit("ask"))).withColumn("sim", F.round("sim", 6))
