"""What a wine's name says: grapes, region, type, colour, words and the key that groups its listings. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import BARE_VOLUMES, EDGE, brand_alias_key, edged, first_match, first_matches, squeeze, strip_accents

# Labels, patterns and word lists of the wine domain, in the order in which they are tried. `\b` is an edge of ASCII words.
VARIETALS = [
    ("Malbec", r"\bmalbec\b"),
    ("Cabernet Sauvignon", r"\bcabernet\s+sauvignon\b"),
    ("Cabernet Franc", r"\bcabernet\s+franc\b"),
    ("Cabernet", r"\bcabernet\b"),
    ("Chardonnay", r"\bchardonnay\b"),
    ("Sauvignon Blanc", r"\bsauvignon\s+blanc\b"),
    ("Merlot", r"\bmerlot\b"),
    ("Bonarda", r"\bbonarda\b"),
    ("Pinot Noir", r"\bpinot\s+noir\b"),
    ("Pinot Grigio", r"\bpinot\s+grigio\b"),
    ("Torrontés", r"\btorront[eé]s\b"),
    ("Syrah", r"\b(syrah|shiraz)\b"),
    ("Tempranillo", r"\btempranillo\b"),
    ("Petit Verdot", r"\bpetit\s+verdot\b"),
    ("Riesling", r"\briesling\b"),
    ("Viognier", r"\bviognier\b"),
    ("Semillón", r"\bsemill[oó]n\b"),
    ("Tannat", r"\btannat\b"),
    ("Barbera", r"\bbarbera\b"),
    ("Sangiovese", r"\bsangiovese\b"),
    ("Nebbiolo", r"\bnebbiolo\b"),
    ("Criolla", r"\bcriolla\b"),
    ("Moscatel", r"\bmoscatel\b"),
    ("Gewürztraminer", r"\bgew[uü]rztraminer\b"),
]
REGIONS = [
    ("Mendoza", r"\bmendoza\b"),
    ("Valle de Uco", r"\b(valle\s+de\s+uco|uco\s+valley|tupungato|vista\s+flores|gualtallary|tunuyan|altamira)\b"),
    ("Luján de Cuyo", r"\b(luj[aá]n\s+de\s+cuyo|agrelo|vistalba|perdriel)\b"),
    ("Maipú", r"\bmaip[uú]\b"),
    ("San Juan", r"\bsan\s+juan\b"),
    ("Salta", r"\b(salta|cafayate|valles\s+calchaqu|molinos|colom[eé])\b"),
    ("Patagonia", r"\b(patagonia|r[ií]o\s+negro|neuqu[eé]n|chubut)\b"),
    ("La Rioja", r"\bla\s+rioja\b"),
    ("Catamarca", r"\bcatamarca\b"),
]
TYPES = [
    ("Espumante", r"\b(espumante|extra\s*brut|nature|champagne|champaña|brut|champenois|prosecco|cava)\b"),
    ("Rosado", r"\b(rosado|ros[eé]|ros[eé]\s+de|blush)\b"),
    ("Blanco", r"\b(blanco|white|chardonnay|sauvignon\s+blanc|torront[eé]s|viognier|riesling|semill[oó]n|pinot\s+grigio)\b"),
    ("Dulce", r"\b(dulce|cosecha\s+tard[ií]a|late\s+harvest|tard[ií]o|malamado|fortificado|oporto|jerez)\b"),
    ("Tinto", r"\b(tinto|red|malbec|cabernet|merlot|bonarda|syrah|shiraz|petit\s+verdot|tempranillo|pinot\s+noir)\b"),
]
COLOURS = r"\b(rosado|rose|blush|blanco|white|espumante|extra\s*brut|brut\s*nature|nature|dulce|tardio|tardia|cosecha\s+tardia|late\s+harvest)\b"
NOT_WINE = (
    r"\b(sidra|gin|whisk[ey]+|vodka|ron(?!\s+(de\s+)?(la|los|las))|tequila|mezcal|vermut|vermouth|aperitivo|aperol|campari|fernet|gancia|cinzano|martini"
    r"|cerveza|beer|ipa|lager|ale|stout|porter|pilsen|weiss|jugo|licor|bailey|baileys|absolut|smirnoff|johnnie|chivas|jack\s+daniels|ballantine|jameson"
    r"|bombay|gordon|tanqueray|beefeater|bacardi|malibu|red\s+bull|coca|pepsi|agua\b|juice|chocolate|cacao|grana\s+padano|parmes[aá]no|queso|salame"
    r"|jam[oó]n|fiamb|conserva|aceite|vinagre|caf[eé]\b|t[eé]\b|miel|aceitunas|kombucha|sangr[ií]a)\b"
)
#: What price drops leave out; another list than that of search.
NOT_IN_DROPS = (
    r"\b(whisk[eí]y?|gin|vodka|ron|tequila|mezcal|licor|vermut|fern|granadina|aperol|campari|cinzano|martini|cynar|amaretto|bitter|chartreuse|absent|jagermeister"
    r"|jack[\s-]?daniels|smirnoff|absolut|cerveza|beer|glenlivet|hendricks|bombay|tanqueray|bushmills|chivas|johnny[\s-]?walker|jameson|macallan|aberlour)\b"
)
NOT_WINE_SIZE = r"\b(33|35|473)\s*cl\b|\b(?:100|150|200|250|330|355|473)\s*ml\b|\b200\s*gr\b"
NOISE = [
    "vino", "cosecha", "anada", "ano", "lata", "botella", "unidad", "unidades", "unid", "caja", "estuche", "pack", "box", "magnum", "media", "half",
    "750", "750cc", "cc", "ml", "tinto", "rojo", "red", "white", "x1", "x2", "x3", "x4", "x6", "x12", "de", "la", "el", "los", "las", "del", "y", "e",
    "o", "u", "x", "a",
]
ALIASES = [
    ("zucardi", "zuccardi"),
    ("familia zuccardi", "zuccardi"),
    ("familia zucardi", "zuccardi"),
    ("cheval des andes", "cheval"),
    ("bodega catena zapata", "catena"),
    ("catena zapata", "catena"),
    ("bodega norton", "norton"),
    ("bodegas norton", "norton"),
    ("bodega trapiche", "trapiche"),
    ("bodega salentein", "salentein"),
    ("bodegas salentein", "salentein"),
    ("luigi bosca", "luigibosca"),
    ("el esteco", "elesteco"),
    ("finca las moras", "lasmoras"),
    ("las moras", "lasmoras"),
    ("don david", "dondavid"),
    ("kaiken", "kaiken"),
    ("chandon", "chandon"),
    ("baron b", "baronb"),
]
#: Brands of several spellings, and the one they are shown by.
BRAND_NAMES = [
    ("bodega catena zapata", "Catena Zapata"),
    ("catena zapata", "Catena Zapata"),
    ("catena", "Catena Zapata"),
    ("familia zuccardi", "Zuccardi"),
    ("zucardi", "Zuccardi"),
    ("bodegas zuccardi", "Zuccardi"),
    ("bodega norton", "Norton"),
    ("bodegas norton", "Norton"),
    ("bodega trapiche", "Trapiche"),
    ("bodegas trapiche", "Trapiche"),
    ("bodega salentein", "Salentein"),
    ("bodegas salentein", "Salentein"),
    ("bodega luigi bosca", "Luigi Bosca"),
    ("luigi bosca", "Luigi Bosca"),
    ("cheval des andes", "Cheval des Andes"),
    ("el esteco", "El Esteco"),
    ("finca las moras", "Las Moras"),
    ("las moras", "Las Moras"),
    ("don david", "Don David"),
]
# Words that stay small or all in capitals in a shown brand, and the regions of one province.
SMALL_WORDS = ["de", "del", "la", "el", "las", "los", "y", "&"]
CAPITAL_WORDS = ["dv", "doc", "ii", "iii", "iv", "vi", "vii", "viii", "ix"]
MENDOZA = ["Mendoza", "Valle de Uco", "Luján de Cuyo", "Maipú"]


def _any_case(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(label, "(?iu)" + edged(p)) for label, p in rules]


def varietals(name: Column, most: int = 3) -> Column:
    """The grapes a name holds, in rule order; the bare Cabernet gives way to its two kinds."""
    met = first_matches(name, _any_case(VARIETALS), len(VARIETALS))
    kinds = F.array(F.lit("Cabernet Sauvignon"), F.lit("Cabernet Franc"))
    return F.slice(F.when(F.arrays_overlap(met, kinds), F.array_remove(met, "Cabernet")).otherwise(met), 1, most)


def region(name: Column, brand: Column, of_brand: Column | None = None) -> Column:
    """The first region that name or brand hold, else what a dictionary says of the brand."""
    said = first_match(F.concat_ws(" ", name, brand), _any_case(REGIONS))
    return said if of_brand is None else F.coalesce(said, of_brand)


def kind(name: Column) -> Column:
    """Espumante, Rosado, Blanco, Dulce or Tinto: the first whose words occur."""
    return first_match(name, _any_case(TYPES))


def colour(name: Column) -> Column:
    """The first colour or sweetness word of a name, like ones under one word; null without."""
    word = F.regexp_replace(F.regexp_extract(F.lower(strip_accents(name)), edged(COLOURS), 1), r"\s+", "")
    like = F.when(word.isin("rosado", "blush"), "rose").when(word == "white", "blanco").when(word.rlike("^brut|^nature$|^espumante$"), "espumante").when(word.rlike("^tardio$|tardia|harvest"), "dulce")
    return F.nullif(F.coalesce(like, word), F.lit(""))


def _bare_brand(brand: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(brand), r"^\s*(bodegas?|familia)\s+", ""))


def _known_brand(bare: Column) -> Column:
    return F.coalesce(*[F.when(bare == said, F.lit(shown)) for said, shown in BRAND_NAMES])


def brand_key(brand: Column) -> Column:
    """What brands are grouped by: lower case, without a leading house word, spellings of one brand under one."""
    bare = _bare_brand(brand)
    return F.coalesce(F.lower(_known_brand(bare)), bare)


def display_brand(brand: Column) -> Column:
    """A brand as it is shown: its known name, else itself if it mixes cases, else with capitals but for small words."""
    own = F.trim(brand)
    word = lambda w: F.when(w.isin(SMALL_WORDS), w).when(w.isin(CAPITAL_WORDS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    capitals = F.array_join(F.transform(F.split(F.lower(own), r"\s+"), word), " ")
    return F.coalesce(_known_brand(_bare_brand(own)), F.when(own.rlike("[a-z]") & own.rlike("[A-Z]"), own).otherwise(capitals), F.lit(""))


def brand_slug(brand: Column) -> Column:
    """What a brand's page is addressed by; null where nothing is left."""
    plain = F.regexp_replace(F.lower(strip_accents(brand)), r"^bodegas?\s+", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def is_wine(name: Column) -> Column:
    """No word and no bottle size of something else."""
    return ~F.coalesce(name.rlike("(?iu)" + edged(NOT_WINE)) | name.rlike("(?iu)" + edged(NOT_WINE_SIZE)), F.lit(False))


def may_drop(name: Column) -> Column:
    """No word of those that price drops leave out; a null name has none."""
    return ~F.coalesce(name.rlike("(?i)" + edged(NOT_IN_DROPS)), F.lit(False))


def province(place: Column) -> Column:
    """Regions inside Mendoza count as Mendoza."""
    return F.when(place.isin(MENDOZA), F.lit("Mendoza")).otherwise(place)


def words(name: Column) -> Column:
    """The words that tell a wine apart: no years, volumes, counts, single characters or `NOISE`; repeats stay."""
    end = r"(?=\s|$|[^a-z0-9])"
    bare = rf"{EDGE}(?:x\s*)?(?:{'|'.join(BARE_VOLUMES)})(?=\s|$|[^a-z0-9.,])"
    out = F.lower(strip_accents(name))
    for gone in (rf"{EDGE}(?:19[0-9]{{2}}|20[0-2][0-9]){EDGE}", rf"{EDGE}[0-9]+\s*(?:ml|cc|cm3|cm³){end}", rf"{EDGE}[0-9]+(?:[.,][0-9]+)?\s*l{EDGE}", bare, rf"{EDGE}x\s*[0-9]+{EDGE}", r"[^a-z0-9\s]"):
        out = F.regexp_replace(out, gone, " ")
    return F.filter(F.split(squeeze(out), " "), lambda w: (F.length(w) > 1) & ~w.isin(NOISE))


def brand_alias(brand: Column) -> Column:
    plain = brand_alias_key(brand)
    return F.coalesce(*[F.when(plain == said, F.lit(meant)) for said, meant in ALIASES], plain)


def canonical_key(name: Column, brand: Column) -> Column:
    """Sorted words of name and brand under their aliases: equal for listings of the same wine, whatever the order."""
    own = F.coalesce(words(name), F.array().cast("array<string>"))
    house = F.coalesce(F.filter(F.split(brand_alias(brand), " "), lambda w: (w != "") & ~w.isin(NOISE)), F.array().cast("array<string>"))
    joined = F.array_join(F.concat(own, F.array_except(house, own)), " ")
    for said, meant in ALIASES:
        if said != meant:
            joined = F.regexp_replace(joined, EDGE + said + EDGE, meant)
    return F.array_join(F.array_sort(F.filter(F.split(joined, " "), lambda w: w != "")), " ")
