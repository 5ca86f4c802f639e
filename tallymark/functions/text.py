"""Text columns: normalising, slugs, extraction. JVM-side wherever Spark has the pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin, Greek and Cyrillic letters with marks, and what is left without them, by Unicode's own decomposition.
_BARE = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not "\u0300" <= x <= "\u036f") for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]}
_MARKED = "".join(c for c, plain in _BARE.items() if len(plain) == 1 and plain != c)
_PLAIN = "".join(_BARE[c] for c in _MARKED)
#: Word edge by ASCII letters, so that `rosé` ends at `s`.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Volumes that need no unit, named references, and patterns of pack words, slugs and images that stand for nothing.
BARE_VOLUMES = ["187", "250", "375", "500", "1000", "1500", "3000", "5000"]
PACK_WORDS = "caja|pack|box|estuche"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# Slugs of shop facets, and bare numbers.
JUNK_SLUGS = [
    r"^(atributo|categoria|sin|alcohol|coleccion|color|tipo|cuerpo|grado|temperatura|variedad|filtro|estilo|crianza|cepa)-",
    r"-(atributo|categoria)-",
    r"^[0-9]+$",
]
PLACEHOLDERS = [
    r"/no-?photo\b",
    r"/no-?image\b",
    r"/placeholder",
    r"/default[-_]?(big|image|photo|thumb)?\.(jpg|jpeg|png|webp|gif)$",
    r"/blank\.(jpg|jpeg|png|webp|gif)$",
    r"/woocommerce-placeholder",
    r"/captura-de-pantalla",
    r"/screenshot[-_]",
    r"/(gift[-_]?card|gcv-|tarjeta[-_]?regalo)",
]


def edged(pattern: str) -> str:
    r"""The pattern with `\b` as an edge of ASCII words."""
    return pattern.replace(r"\b", EDGE)


def strip_accents(x: Column) -> Column:
    """Without marks, composed or combining (U+0300 to U+036F); `strip_accents_full` also covers the remaining scripts."""
    return F.regexp_replace(F.translate(x, _MARKED, _PLAIN), "[\u0300-\u036f]", "")


@F.pandas_udf(StringType())
def strip_accents_full(x: pd.Series) -> pd.Series:
    """Decompose and drop combining marks U+0300 to U+036F."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ"))


@F.pandas_udf(StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """Decimal, then hexadecimal references (16 bits), then the six names of `ENTITIES`; unknown ones stay."""
    rounds = [
        (re.compile(r"&#([0-9]+);"), lambda m: chr(int(m[1]) & 0xFFFF)),
        (re.compile(r"&#x([0-9a-fA-F]+);"), lambda m: chr(int(m[1], 16) & 0xFFFF)),
        (re.compile(r"&([A-Za-z]+);"), lambda m: ENTITIES.get(m[1].lower(), m[0])),
    ]

    def plain(s: str) -> str:
        for pattern, char in rounds:
            s = pattern.sub(char, s)
        # Two halves of a pair become one character; a half alone cannot be stored.
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return x.map(lambda s: None if s is None else plain(s) if "&" in s else s)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_name(x: Column) -> Column:
    return squeeze(F.lower(strip_accents(x)))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def brand_page_key(x: Column, prefix: str = "bodegas?") -> Column:
    """Slug of a brand without its leading house word."""
    return slugify(F.regexp_replace(F.trim(F.lower(strip_accents(x))), rf"^{prefix}\s+", ""))


def brand_alias_key(x: Column, prefix: str = "bodegas?") -> Column:
    plain = F.regexp_replace(F.trim(F.lower(strip_accents(x))), rf"^{prefix}\s+", "")
    return squeeze(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))


def title_case(x: Column, keep_lower: Iterable[str] = ("de", "del", "la", "las", "los", "y", "e"), keep_upper: Iterable[str] = ("ii", "iii", "iv", "vi", "xo", "vs")) -> Column:
    """Each word capitalised, but small words (not the first) and acronyms."""
    low, up = F.array(*map(F.lit, keep_lower)), F.array(*map(F.lit, keep_upper))

    def word(w: Column, i: Column) -> Column:
        return F.when(F.array_contains(up, w), F.upper(w)).when((i > 0) & F.array_contains(low, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))

    return F.array_join(F.transform(F.split(F.lower(x), " "), word), " ")


def display_name(x: Column) -> Column:
    """Names that shout (70 % of their letters in upper case) come in title case, others as they are."""
    letters, upper = F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(r"\p{Lu}"))
    return F.when((letters > 0) & (upper * 10 >= letters * 7), title_case(x)).otherwise(x)


def extract_vintage(x: Column) -> Column:
    """The first year from 1900 to 2029 that stands alone."""
    return F.try_to_number(F.nullif(F.regexp_extract(x, rf"{EDGE}(19[0-9]{{2}}|20[0-2][0-9]){EDGE}", 1), F.lit("")), F.lit("9999")).cast("int")


def extract_format(x: Column) -> Column:
    """Pack, count, size and volume marks, sorted and joined by `-`; null for a plain bottle.

    A count that is a volume (`x 375`) is one, unless a volume with a unit stands beside it.
    """
    low = F.lower(x)
    first = lambda pattern: F.regexp_extract(low, pattern, 1)
    pack = first(rf"{EDGE}({PACK_WORDS}){EDGE}")
    count = first(rf"{EDGE}x\s*([0-9]+){EDGE}")
    litres = first(rf"{EDGE}([0-9]+(?:[.,][0-9]+)?)\s*l{EDGE}")
    ml = first(rf"{EDGE}([0-9]{{3,4}})\s*(?:ml|cc|cm3|cm³)(?=\s|$|[^a-z0-9])")
    bare = first(rf"{EDGE}(?:x\s*)?({'|'.join(BARE_VOLUMES)})(?=\s|$|[^a-z0-9.,])")
    parts = F.array(
        F.nullif(pack, F.lit("")),
        F.when((count != "") & ~(count.isin(BARE_VOLUMES) & (ml == "")), F.concat(F.lit("x"), count)),
        F.when(low.rlike(rf"{EDGE}magnum{EDGE}"), F.lit("magnum")),
        F.when(low.rlike(rf"{EDGE}(?:media|half){EDGE}"), F.lit("half")),
        F.when(litres != "", F.concat(F.replace(litres, F.lit(","), F.lit(".")), F.lit("l"))),
        F.when((ml != "") & (ml != "750"), F.concat(ml, F.lit("ml"))),
        F.when((ml == "") & (bare != ""), F.concat(bare, F.lit("ml"))),
    )
    return F.nullif(F.array_join(F.array_sort(F.array_compact(parts)), "-"), F.lit(""))


def tokens(x: Column, noise: Sequence[str] = ()) -> Column:
    """Distinct words longer than one character, without years, volumes, counts and `noise`."""
    plain = F.regexp_replace(F.lower(strip_accents(x)), r"(?<![0-9])(?:19[0-9]{2}|20[0-2][0-9])(?![0-9])|[0-9]+\s*(?:ml|cc|cl|lts?|l)(?![a-z])|(?<![a-z0-9])x\s*[0-9]+", " ")
    words = F.split(squeeze(F.regexp_replace(plain, r"[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(noise) or [""])))


def token_key(*columns: Column, noise: Sequence[str] = ()) -> Column:
    """Sorted distinct tokens of all columns, in one string: equal for names that differ in order only."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(tokens(c, noise), F.array().cast("array<string>")) for c in columns]))), " ")


def group_slug(key: Column, longest: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring(F.regexp_replace(key, r"\s+", "-"), 1, longest), "-+", "-"), "^-|-$", "")


def first_matches(x: Column, rules: Sequence[tuple[str, str]], most: int) -> Column:
    """Labels of the rules whose pattern occurs, in rule order, `most` at most."""
    return F.slice(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(label)) for label, p in rules])), 1, most)


def first_match(x: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern occurs."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(label)) for label, p in rules])


def format_money(x: Column, unknown: str = "Consultar") -> Column:
    return F.when(x.isNull() | (x <= 0), F.lit(unknown)).otherwise(F.concat(F.lit("$ "), F.translate(F.format_number(F.round(x).cast("decimal(20,0)"), 0), ",", ".")))


def xml_escape(x: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        x = F.replace(x, F.lit(char), F.lit(f"&{name};"))
    return x


def strip_tags(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, "<[^>]*>", " "))


def initials(x: Column, most: int = 2) -> Column:
    return F.array_join(F.transform(F.slice(F.split(squeeze(x), " "), 1, most), lambda w: F.upper(F.substring(w, 1, 1))), "")


def palette_index(x: Column, size: int) -> Column:
    """A 31-multiplier string hash in unsigned 32 bits, modulo the palette."""
    codes = F.transform(F.split(x, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32))) % size).cast("int")


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def split_versus(x: Column) -> tuple[Column, Column]:
    """Both sides of a slug at its last `-vs-`."""
    return F.regexp_extract(x, "^(.*)-vs-(.*)$", 1), F.regexp_extract(x, "^(.*)-vs-(.*)$", 2)


def is_junk_slug(x: Column) -> Column:
    """Slugs of shop facets and bare numbers."""
    return x.rlike("(?i)" + "|".join(JUNK_SLUGS))


def peel(words: Column, noise: Sequence[str], most: int) -> Column:
    """The words without up to `most` leading noise words."""
    bad = F.array(*map(F.lit, noise))
    out = words
    for _ in range(most):
        out = F.when((F.size(out) > 0) & F.array_contains(bad, F.get(out, F.lit(0))), F.slice(out, 2, 1000)).otherwise(out)
    return out


# -- addresses ---------------------------------------------------------------------------------------------------------


def host(x: Column) -> Column:
    """Host of a URL, the text itself if it is none."""
    return F.coalesce(F.try_parse_url(x, F.lit("HOST")), x)


def normalize_image_url(x: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """Without query, fragment and size suffix, CDN shards folded; null for placeholders."""
    bare = F.regexp_replace(F.trim(x), r"[?#].*$", "")
    folded = F.regexp_replace(F.regexp_replace(bare, r"://[ad]cdn-us\.", "://cdn-us."), r"-[0-9]+-[0-9]+(\.[a-z]+)$", "$1")
    return F.when(x.isNull() | (F.trim(x) == "") | x.rlike("(?i)" + edged("|".join(placeholders))), None).otherwise(folded)


def utc_day(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def offer_label(name: Column, brand: Column) -> Column:
    """An offer's name for people: without vintage, volume and the words that say nothing, and without the brand where more than five characters stay."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    # The vintages, volumes and words that go.
    plain = F.regexp_replace(name, r"\b(19\d{2}|20[0-2]\d)\b", " ")
    plain = F.regexp_replace(plain, r"(?i)\s*\d+\s*(ml|cc)\b", " ")
    plain = tidy(F.regexp_replace(plain, r"(?i)\b(Vino|Tinto|Blanco)\b", " "))
    bare = tidy(F.regexp_replace(plain, F.concat(F.lit(r"(?i)\b\Q"), brand, F.lit(r"\E\b")), F.lit(" ")))
    return F.when((brand != "") & (F.length(bare) > 5), bare).otherwise(plain)
