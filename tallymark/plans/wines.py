"""Queries over a catalogue of wines, made of the driver's parts: names with accents, spirits among them, brands of several spellings, groups without a grape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import wine
from tallymark.operators import history, pages, search, serving, stats
from tallymark.plans import registry
from tallymark.plans import views as v
from tallymark.plans.registry import _GRAPES, _WINE, _cases, query

_NAMES = [
    "Malbec Reserva", "Torrontés Cafayate", "Blend de Tintos", "Cabernet Sauvignon Luján de Cuyo", "Fernet Branca", "Espumante Extra Brut", "Bonarda Orgánico", "Malbec Patagonia", "Corte Valle de Uco",
    "Chardonnay Natural", "Vermouth Rosso", "Gran Reserva", "Pinot Noir Río Negro", "Syrah Salta", "Rosé Malbec", "Malbec Tupungato", "Cerveza Roja 473 ml", "Semillón Torrontés", "Cosecha Especial", "Cabernet Franc Maipú",
]
_BRANDS = ["Catena", "Bodega Catena Zapata", "SALENTEIN", "Bodegas Salentein", "Rutini", "familia zuccardi", "Zuccardi", "Trapiche", "bodega trapiche", "Smirnoff", "Finca Las Moras", "Álamos", "Bodega Álamos", "gran enemigo", "DV Catena"]

WINES = rf"""named AS (SELECT p_partkey AS group_slug, split_part(p_name, ' ', 1) || ' ' || {_NAMES!r}[p_partkey % {len(_NAMES)} + 1] AS name, CASE WHEN p_partkey % 17 > 0 THEN {_BRANDS!r}[p_partkey % {len(_BRANDS)} + 1] END AS brand FROM part),
grapes AS (SELECT *, [x FOR x IN [{_GRAPES}] IF x IS NOT NULL] AS g FROM named),
wines AS (SELECT group_slug, name, brand, (CASE WHEN list_has_any(g, ['Cabernet Sauvignon', 'Cabernet Franc']) THEN list_filter(g, lambda x: x <> 'Cabernet') ELSE g END)[1:3] AS varietals,
 {_cases(wine.REGIONS, "name || ' ' || coalesce(brand, '')")} AS region, {_cases(wine.TYPES, "name")} AS type, offer_count, in_stock_offer_count, store_count, min_price * 6 AS min_price, max_price * 6 AS max_price FROM grapes JOIN gstats USING (group_slug))"""


def wines(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    rows = v.read(spark, d, "part").select(F.col("p_partkey").alias("group_slug"), F.concat_ws(" ", F.split("p_name", " ")[0], pick(_NAMES)).alias("name"), F.when(F.col("p_partkey") % 17 > 0, pick(_BRANDS)).alias("brand"))
    name = F.col("name")
    rows = rows.select("*", wine.varietals(name).alias("varietals"), wine.region(name, F.col("brand")).alias("region"), wine.kind(name).alias("type"))
    return rows.join(stats.group_stats(v.offers(spark, d)), "group_slug").withColumns({c: F.col(c) * 6 for c in ("min_price", "max_price")})


def _of_wines(sql: str):
    tail = sql.strip()
    return query(f"WITH {WINES}" + (",\n" + tail[5:] if tail.startswith("WITH ") else "\n" + tail))


_TEXT = "strip_accents(lower(name || ' ' || coalesce(brand, '')))"


@_of_wines(f"SELECT group_slug, store_count, min_price FROM wines WHERE {_WINE} AND contains({_TEXT}, 'torrontes') AND contains({_TEXT}, 'cafay') AND store_count >= 1 ORDER BY min_price NULLS LAST, store_count DESC, group_slug LIMIT 48")
def wine_search(spark, d):
    return search.search(wines(spark, d), " Torrontés CAFAY ", "price-asc", in_stock=True).select("group_slug", "store_count", "min_price")


@_of_wines(f"""WITH f AS (SELECT * FROM wines WHERE {_WINE} AND contains({_TEXT}, 'malbec')), r AS (SELECT 'varietal' AS facet, unnest(varietals) AS value FROM f UNION ALL SELECT 'type', type FROM f UNION ALL SELECT 'region', region FROM f)
SELECT facet, value, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY 1, 2""")
def wine_search_facets(spark, d):
    return search.facets(wines(spark, d), "málbec")


@_of_wines(f"""WITH f AS (SELECT * FROM wines WHERE {_WINE} AND lower(type) = 'blanco' AND store_count >= 2), t AS (SELECT *, row_number() OVER (ORDER BY store_count DESC, min_price NULLS LAST, group_slug)::INTEGER AS position FROM f),
b AS (SELECT group_slug, arg_min(store_slug, ord) AS best_store_slug FROM offers WHERE in_stock AND NOT is_collector GROUP BY 1)
SELECT position, group_slug, name, brand, region, type, min_price, max_price, store_count, best_store_slug, coalesce(store_name, best_store_slug::VARCHAR) AS best_store_name, 'https://example.com/vino/' || group_slug::VARCHAR AS permalink
FROM t LEFT JOIN b USING (group_slug) LEFT JOIN stores ON best_store_slug = store_slug WHERE position <= 24""")
def wine_search_page(spark, d):
    return search.page(wines(spark, d), v.offers(spark, d), v.stores(spark, d), sort="stores-desc", base="https://example.com/vino/", type="Blanco", multi=True)


_BOTH = "trim(coalesce(strip_accents(lower(brand)), '') || ' ' || strip_accents(lower(name)))"
_B, _N = "coalesce(strip_accents(lower(brand)), '')", "strip_accents(lower(name))"


@_of_wines(rf"""WITH s AS (SELECT group_slug, min_price, CASE WHEN {_B} <> '' AND {_B} = 'trapiche' THEN 100 + least(store_count, 30) * 10 ELSE 0 END
 + CASE WHEN starts_with({_N}, 'trapiche') THEN 300 WHEN starts_with({_BOTH}, 'trapiche') THEN 240 WHEN contains({_N}, 'trapiche') THEN 180 WHEN contains({_BOTH}, 'trapiche') THEN 130 ELSE 0 END
 + CASE WHEN starts_with({_B}, 'trapiche') THEN 120 WHEN contains({_B}, 'trapiche') THEN 60 ELSE 0 END + CASE WHEN regexp_matches({_BOTH}, '\btrapiche\b') THEN 30 WHEN contains({_BOTH}, 'trapiche') THEN 8 ELSE 0 END
 + least(store_count, 25) * 5 - greatest(length(name) - 30, 0) * 0.6::DOUBLE + CASE WHEN min_price > 0 THEN 10 ELSE 0 END AS score FROM wines WHERE {_WINE} AND contains({_TEXT}, 'trapiche'))
SELECT group_slug, round(score::DOUBLE, 4) AS score FROM s ORDER BY s.score DESC, min_price NULLS LAST, group_slug LIMIT 20""")
def wine_autocomplete(spark, d):
    return search.autocomplete(wines(spark, d), "Trapiche").select("group_slug", F.round(search.relevance("Trapiche"), 4).alias("score"))


def _curated_sql() -> str:
    parts = []
    for r in search.WINE_RANKINGS:
        w = r.where
        c = ["length(brand) >= 2", "min_price > 0", "store_count >= 1", "NOT regexp_matches(name, '(?i)jack daniels|fernet|cynar|aperol|smirnoff|gin |whisky|whisk[eí]|cerveza')"] + ["store_count >= 2"] * r.multi
        c += [f"list_contains(varietals, '{w['varietal']}')"] if "varietal" in w else []
        c += [f"lower({k}) = lower('{w[k]}')" for k in ("type", "region") if k in w]
        c += [f"lower(brand) IN ({', '.join(repr(b.lower()) for b in w['brands'])})"] if "brands" in w else []
        c += [r"regexp_matches(name, '(?i)org[aá]nico|biodin[aá]mico|natural\b')"] if "name" in w else []
        c += [r"(len(varietals) >= 2 OR regexp_matches(name, '(?i)\b(blend|corte)\b'))"] if "blend" in w else []
        c += [f"min_price >= {w['low']}"] if "low" in w else []
        c += [f"min_price <= {w['high']}"] if "high" in w else []
        order = "min_price, group_slug" if r.order == "price" else "store_count DESC, min_price, group_slug"
        parts.append(f"(SELECT '{r.slug}' AS ranking, row_number() OVER (ORDER BY {order})::INTEGER AS position, group_slug, min_price, store_count FROM wines WHERE {' AND '.join(c)} ORDER BY position LIMIT {r.limit})")
    return "\nUNION ALL ".join(parts)


@_of_wines(_curated_sql())
def wine_rankings(spark, d):
    return search.rankings(wines(spark, d), search.WINE_RANKINGS)


def _index_sql() -> str:
    of = {slug: name for name, slugs in search.RANKING_SECTIONS for slug in slugs}
    listed = ", ".join(f"('{of.get(r.slug, 'others')}', '{r.slug}', {k})" for k, r in enumerate(search.WINE_RANKINGS))
    return f"WITH r AS ({_curated_sql()}), l AS (SELECT * FROM (VALUES {listed}) AS t(section, ranking, place)) SELECT section, l.ranking, place, count(group_slug) AS items FROM l LEFT JOIN r ON l.ranking = r.ranking GROUP BY 1, 2, 3"


@_of_wines(_index_sql())
def wine_ranking_sections(spark, d):
    return search.ranking_index(search.rankings(wines(spark, d), search.WINE_RANKINGS), search.WINE_RANKINGS)


@_of_wines("""WITH s AS (SELECT b.group_slug AS base, c.group_slug, c.store_count, CASE WHEN list_has_any(b.varietals, c.varietals) THEN 3 ELSE 0 END + CASE WHEN lower(b.region) = lower(c.region) THEN 2 ELSE 0 END
 + CASE WHEN c.min_price >= b.min_price * 0.65::DOUBLE AND c.min_price <= b.min_price * 1.45::DOUBLE THEN 2 ELSE 0 END + CASE WHEN c.store_count >= 3 THEN 1 ELSE 0 END AS score
 FROM wines b JOIN wines c ON b.group_slug <> c.group_slug AND (len(b.varietals) = 0 OR list_has_any(b.varietals, c.varietals)) AND c.min_price > 0 AND c.in_stock_offer_count > 0 WHERE b.group_slug % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, store_count DESC, group_slug)::INTEGER AS rank FROM s)
SELECT base, rank, group_slug, score::INTEGER AS score FROM r WHERE rank <= 6""")
def wine_related(spark, d):
    g = wines(spark, d)
    return search.related(g, g.where("group_slug % 3 = 0"))  # the pages asked for


def _shown_sql(x: str) -> str:
    names = " ".join(f"WHEN '{said}' THEN '{shown}'" for said, shown in wine.BRAND_NAMES)
    word = "CASE WHEN w IN ('" + "', '".join(wine.SMALL_WORDS) + "') THEN w WHEN w IN ('" + "', '".join(wine.CAPITAL_WORDS) + "') THEN upper(w) ELSE upper(w[1]) || w[2:] END"
    return rf"""CASE regexp_replace(lower({x}), '^(bodegas?|familia)\s+', '') {names} ELSE CASE WHEN regexp_matches({x}, '[a-z]') AND regexp_matches({x}, '[A-Z]') THEN {x} ELSE array_to_string([{word} FOR w IN string_split(lower({x}), ' ')], ' ') END END"""


_KEY = r"(CASE regexp_replace(lower(brand), '^(bodegas?|familia)\s+', '') " + " ".join(f"WHEN '{said}' THEN '{shown.lower()}'" for said, shown in wine.BRAND_NAMES) + r" ELSE regexp_replace(lower(brand), '^(bodegas?|familia)\s+', '') END)"


@_of_wines(f"""WITH k AS (SELECT group_slug, {_KEY} AS key, len(varietals) > 0 OR coalesce(type IN ('Tinto', 'Blanco'), false) AS good FROM wines WHERE brand IS NOT NULL AND lower(brand) <> 'smirnoff'),
b AS (SELECT key, count(*) AS offer_count, count(DISTINCT store_slug) AS store_count, count(*) FILTER (good) AS good FROM offers JOIN k USING (group_slug) GROUP BY 1)
SELECT {_shown_sql("key")} AS brand, offer_count, store_count FROM b WHERE good >= 0.4::DOUBLE * offer_count ORDER BY store_count DESC, offer_count DESC, brand LIMIT 12""")
def wine_top_brands(spark, d):
    return stats.top_brands(wines(spark, d), v.offers(spark, d))


@_of_wines(rf"""WITH k AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(brand)), '^bodegas?\s+', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_shown_sql("brand")} AS shown FROM wines WHERE brand IS NOT NULL AND lower(brand) <> 'smirnoff'),
s AS (SELECT slug, count(DISTINCT store_slug) AS store_count FROM offers JOIN k USING (group_slug) GROUP BY 1)
SELECT slug, arg_max(shown, (length(shown), shown)) AS name, count(*) AS group_count, sum(offer_count)::BIGINT AS offer_count, count(DISTINCT region) AS regions, any_value(s.store_count) AS store_count FROM k JOIN s USING (slug) GROUP BY slug HAVING count(*) >= 3""")
def wine_brand_pages(spark, d):
    return stats.brand_pages(wines(spark, d), v.offers(spark, d))


@_of_wines("""WITH w AS (SELECT group_slug FROM wines WHERE group_slug % 100 = 7), o AS (SELECT o.*, row_number() OVER (PARTITION BY group_slug ORDER BY in_stock DESC, is_collector, price NULLS LAST, ord)::INTEGER AS place FROM offers o JOIN w USING (group_slug))
SELECT group_slug, place, store_slug, coalesce(store_name, store_slug::VARCHAR) AS store_name, price, in_stock, is_collector, round(price - min(price) FILTER (in_stock AND price > 0) OVER (PARTITION BY group_slug), 4) AS over_best FROM o LEFT JOIN stores USING (store_slug)""")
def wine_detail_offers(spark, d):
    slugs = wines(spark, d).where("group_slug % 100 = 7").select("group_slug")  # the pages asked for
    return serving.detail_offers(slugs, v.offers(spark, d), v.stores(spark, d)).withColumn("over_best", F.round("over_best", 4))


@_of_wines(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC) AS rn FROM hist), g AS (SELECT slug, count(*) AS n, max(CASE WHEN rn = 1 THEN min END) AS current_price, median(CASE WHEN rn > 1 AND min > 0 THEN min END) AS median_price FROM h WHERE rn <= 8 GROUP BY 1),
d AS (SELECT *, (median_price - current_price) / median_price AS raw FROM g WHERE n >= 7 AND median_price > 0),
b AS (SELECT DISTINCT group_slug FROM offers WHERE in_stock AND NOT is_collector)
SELECT slug, round(raw, 3) AS drop_pct, store_count FROM d JOIN wines ON slug = group_slug WHERE raw BETWEEN 0.15::DOUBLE AND 0.7::DOUBLE AND current_price >= 1500 AND store_count >= 2 AND slug IN (SELECT group_slug FROM b) AND NOT regexp_matches(name, '(?i){wine.NOT_IN_DROPS}')
ORDER BY round(raw, 3) DESC, slug LIMIT 50""")
def wine_price_drops(spark, d):
    return history.price_drops(v.history(spark, d), wines(spark, d), offers=v.offers(spark, d)).select("slug", "drop_pct", "store_count")



_REAL = "real AS (SELECT * FROM wines WHERE min_price > 0 AND store_count >= 2)"
_MIDDLE = "CASE WHEN count(*) % 2 = 0 THEN floor(median(min_price) + 0.5) ELSE median(min_price) END"


@_of_wines(f"""WITH {_REAL} SELECT varietals[1] AS name, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM real) AS pct, {_MIDDLE} AS median_price FROM real WHERE len(varietals) > 0 AND varietals[1] <> 'Cabernet' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def market_slices_varietal(spark, d):
    return stats.market_slices(wines(spark, d), "varietal")


@_of_wines(f"""WITH {_REAL} SELECT region AS name, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM real) AS pct, {_MIDDLE} AS median_price FROM real WHERE region <> '' GROUP BY 1 HAVING count(*) >= 3""")
def market_slices_region(spark, d):
    return stats.market_slices(wines(spark, d), "region")


@_of_wines(f"""WITH {_REAL} SELECT type AS name, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM real) AS pct, NULL::DOUBLE AS median_price FROM real WHERE type <> '' GROUP BY 1""")
def market_slices_type(spark, d):
    return stats.market_slices(wines(spark, d), "type")


# -- pages ---------------------------------------------------------------------------------------------------------------------------------

_PAGES = rf"""k AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(brand)), '^bodegas?\s+', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_shown_sql("brand")} AS shown FROM wines WHERE brand IS NOT NULL AND lower(brand) <> 'smirnoff'),
sc AS (SELECT slug, count(DISTINCT store_slug) AS store_count FROM offers JOIN k USING (group_slug) GROUP BY 1),
pages AS (SELECT slug, arg_max(shown, (length(shown), shown)) AS name, count(*) AS group_count, any_value(sc.store_count) AS store_count FROM k JOIN sc USING (slug) GROUP BY slug HAVING count(*) >= 3)"""
_ITEMS = "items AS (SELECT * FROM (SELECT type AS page, group_slug, brand, store_count, row_number() OVER (PARTITION BY type ORDER BY store_count DESC, min_price NULLS LAST, group_slug) AS rank FROM wines WHERE type IS NOT NULL) WHERE rank <= 48)"


@_of_wines(rf"""WITH {_PAGES}, {_ITEMS}, n AS (SELECT page, brand, trim(regexp_replace(regexp_replace(strip_accents(lower(brand)), '^bodegas?\s+', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM items WHERE brand IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, brand)::INTEGER AS rank FROM n WHERE slug IN (SELECT slug FROM pages))
SELECT page, rank, brand, slug, n FROM r WHERE rank <= 8""")
def wine_facet_brands(spark, d):
    g = wines(spark, d)
    return pages.facet_brands(g, stats.brand_pages(g, v.offers(spark, d)), "type")


@_of_wines(f"""WITH {_ITEMS}, l AS (SELECT page, CASE WHEN store_count >= 2 THEN 'several' WHEN store_count = 1 THEN 'single' END AS list, group_slug, rank FROM items),
p AS (SELECT page, list, group_slug, row_number() OVER (PARTITION BY page, list ORDER BY rank)::INTEGER AS place FROM l WHERE list IS NOT NULL)
SELECT page, list, place, group_slug FROM p WHERE place <= CASE WHEN list = 'several' THEN 30 ELSE 16 END""")
def wine_facet_lists(spark, d):
    return pages.facet_lists(wines(spark, d), "type")


@_of_wines(f"WITH {_PAGES} SELECT slug, name, group_count, store_count FROM pages WHERE store_count >= 2")
def wine_brand_index(spark, d):
    return pages.brand_index(stats.brand_pages(wines(spark, d), v.offers(spark, d)), "groups").select("slug", "name", "group_count", "store_count")


@_of_wines("""WITH p AS (SELECT group_slug AS slug_a, group_slug + 11 AS slug_b, store_count AS total_store_count FROM wines ORDER BY store_count DESC, slug_a, slug_b LIMIT 8)
SELECT slug_a, slug_b, a.name AS name_a, b.name AS name_b, total_store_count FROM p JOIN wines a ON slug_a = a.group_slug JOIN wines b ON slug_b = b.group_slug""")
def wine_popular_pairs(spark, d):
    g = wines(spark, d)
    return pages.popular_pairs(g.select(F.col("group_slug").alias("slug_a"), (F.col("group_slug") + 11).alias("slug_b"), F.col("store_count").alias("total_store_count")), g)


@_of_wines("""WITH e AS (SELECT type, group_slug, generate_subscripts(varietals, 1) AS spot, unnest(varietals) AS value FROM wines WHERE type IS NOT NULL), f AS (SELECT type, value, min((group_slug, spot)) AS first FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY first, value) AS k FROM f)
SELECT type, array_to_string(list(value ORDER BY k), ', ') AS varietals FROM r WHERE k <= 3 GROUP BY 1""")
def wine_first_varietals(spark, d):
    out = pages.first_values(wines(spark, d).where("type is not null"), "type", "varietals", "group_slug")
    return out.select("type", F.array_join("varietals", ", ").alias("varietals"))


@query("""WITH h AS (SELECT slug, date, min, row_number() OVER (PARTITION BY slug ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY slug) AS n, min(min) OVER (PARTITION BY slug) AS low, max(min) OVER (PARTITION BY slug) AS high FROM hist)
SELECT slug, date, round(CASE WHEN n = 1 THEN 300 ELSE 8 + i * 584::DOUBLE / nullif(n - 1, 0) END, 4) AS x, round(92 - (min - low) / greatest(1, high - low) * 84, 4) AS y FROM h""")
def price_chart(spark, d):
    return pages.chart_points(v.history(spark, d)).select("slug", "date", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
