"""Personal data: format rules, and boosted trees over high-recall candidates, in DataFrame operations only.

The base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers, leftmost and
non-overlapping by kind. Beside them generators propose further spans: every run of one to seven groups of
digits at every start in a cluster of digits, addresses plain or written out, IPv6 addresses, and strings that may be keys or passwords. Proposals
overlap. Boosted trees score each by its format and by the text on both sides; what touches a base span goes, and of overlapping ones the best scored counts, if it reaches the
threshold of its kind, which is calibrated for precision on examples held out. Such spans are added; kinds are those of the base and `secret`.

The trees are fitted on the driver from two bounded sets of examples, both measured by the same columns as the candidates: made-up sentences from a fixed seed,
whose spans are known, and candidates of at most `SAMPLE` documents (smallest hash of id and text) labelled weakly by the base rules: what lies in a base span
to its end is personal data, with the decisive part (the plus sign, Luhn's sum) masked; other numbers and addresses are not. They are applied as CASE
expressions, so the texts are only ever read by the JVM.

Offsets are code points, the end exclusive. Edge cases: a null or empty text has no spans. Texts of any length are searched whole: no pattern
recurses, spans are collected chunk by chunk, and candidates window by window. Repeated rows are answered each for itself. The guarded patterns match what the
plain ones do, without retrying inside a run of one character class.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import staged

from .base import pick

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the added spans, in the order of `spans`.
ALL_KINDS = (*KINDS, "secret")
SAMPLE = 2000
CHUNK = 64
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What a generator looks at.
GENERATORS = {
    "number": r"(?<![0-9])[(]?[0-9][0-9\x20()./-]*+",
    "address": r"(?i)(?<![a-z0-9._+-])[a-z0-9._+-]{2,64}(?:\x20?(?:@|[\[({]at[\])}])\x20?|\x20at\x20)[a-z0-9-]{2,63}(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[a-z0-9-]{2,63}){1,8}+",
    "address6": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,39}+(?![0-9A-Za-z:])",
    "secret": r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,512}+",
    "keyed": r"(?i)(?<=(?:token|secret|passwd|password|pwd|key)\x20{0,2}[=:]\x20{0,2}[\"']{0,1})[^\s\"'=:,;]{6,256}+",
}


def _may_hold(name: str, text: Column) -> Column:
    """Whether a text can hold a candidate of a generator; the cheap tests come first."""
    if name == "number":
        return text.rlike(r"[0-9][0-9\x20()./-]{5}")
    if name == "address":
        written = F.lower(text).contains(" at ") & text.rlike(r"(?i)\x20at\x20[a-z0-9-]{2,63}(?:\.|\x20?[\[({]dot|\x20dot\x20)")
        return text.contains("@") | written | (text.rlike(r"[\])}]") & text.rlike(r"(?i)[\[({]at[\])}]"))
    if name == "address6":
        return text.contains(":") & text.rlike(r"[0-9A-Fa-f:]:[0-9A-Fa-f]{0,4}:")
    if name == "secret":
        return text.rlike(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20}")
    return (text.contains("=") | text.contains(":")) & text.rlike(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)\x20{0,2}[=:]")


_OF_CODE = ("phone", "email", "ip", "secret", "secret")
_GROUPS, _BEFORE, _AFTER = 7, 24, 12
#: Long texts are searched in windows of so many characters, which see so many more on either side; a candidate belongs to the window that it begins in.
WINDOW, LEAD, TAIL = 4000, 100, 1000
_FOUND = "array<struct<code:int,first:int,end:int,f:array<double>>>"
_SPAN = "array<struct<first:int,end:int,said:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All matches in a row with their offsets and the characters on both sides, up to the neighbouring matches.

    Running offsets are kept by chunk: appending to one long array would take time with the square of the matches.
    """
    rough = F.arrays_zip(F.split(text, pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.from_json(F.lit("[]"), _SPAN)
    length = lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["b"])
        end = first + F.length(x["m"])
        found = F.struct(first.alias("first"), end.alias("end"), x["m"].alias("said"), F.right(x["b"], F.lit(_BEFORE)).alias("before"), x["after"].alias("after"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], found).alias("out")))

    def within(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda k: F.slice(parts, k * CHUNK + 1, F.lit(CHUNK)))
        sums = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + length(x))
        starts = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + sums(c)))
        inside = lambda cs: let(starts(cs), lambda at: F.transform(cs, lambda c, k: F.aggregate(c, F.struct(F.get(at, k).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))
        return F.flatten(let(chunks, inside))

    sided = let(rough, lambda r: F.transform(r, lambda x, i: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.substring(F.coalesce(F.get(r, i + 1)["b"], F.lit("")), 1, _AFTER).alias("after"))))
    return let(sided, within)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    said = x["said"]
    if kind == "ip":
        return said.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(said))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(said))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x)


def _labelled(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["first"].alias("first"), x["end"].alias("end"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the spans that the rules find."""
    gate = {"email": text.contains("@"), "phone": text.contains("+")}
    out = {}
    for kind in KINDS:
        found = F.filter(matches(text, PATTERNS[kind]), _validator(kind))
        out[kind] = F.when(gate.get(kind, text.rlike("[0-9]")), found).otherwise(F.from_json(F.lit("[]"), _SPAN))
    return out


# -- candidates --------------------------------------------------------------------------------------------------------

_BEFORE_WORDS = (
    r"(?i)(?:tel|phone|call|mobile|fax|cell|whatsapp|ring)\W*$",
    r"(?i)(?:card|visa|credit|mastercard|iban|account)\W*$",
    r"(?i)(?:order|invoice|ref|id|nr|no|version|isbn|build|sku|page|pages|article|lot)\W*$|[=#$]\W*$",
    r"(?i)(?:mail|contact|write to|reach me|e-mail)\W*$",
    r"(?i)(?:token|secret|passwd|password|pwd|key|bearer|auth)\W*$",
)
_AFTER_WORDS = r"(?i)^\W{0,2}(?:eur|usd|kg|km|cm|pages|words|miles|units|percent|%|€)"


def _subruns(cluster: Column) -> Column:
    """Every run of one to seven digit groups of a cluster, with 7 to 19 digits."""

    def runs(groups: Column) -> Column:
        def run(i: Column, n: Column) -> Column:
            a, z = F.get(groups, i), F.get(groups, i + n)
            opened = F.substring(cluster["said"], a["first"], F.lit(1)) == "("
            first = a["first"] - F.when((a["first"] > 0) & opened, 1).otherwise(0)
            before = F.right(F.concat(cluster["before"], F.substring(cluster["said"], F.greatest(first - _BEFORE, F.lit(0)) + 1, F.least(first, F.lit(_BEFORE)))), F.lit(_BEFORE))
            after = F.substring(F.concat(F.substring(cluster["said"], z["end"] + 1, F.lit(_AFTER)), cluster["after"]), 1, _AFTER)
            said = F.substring(cluster["said"], first + 1, z["end"] - first)
            return F.struct((cluster["first"] + first).alias("first"), (cluster["first"] + z["end"]).alias("end"), said.alias("said"), before.alias("before"), after.alias("after"))

        each = lambda g, i: F.transform(F.sequence(F.lit(0), F.least(F.lit(_GROUPS), F.size(groups) - i) - 1), lambda n: run(i, n))
        # \\(? [0-9]+ (separators [0-9]+)*, which is said of groups next to each other
        return F.filter(F.flatten(F.transform(groups, each)), lambda x: F.length(_digits(x["said"])).between(7, 19) & x["said"].rlike(r"^\(?[0-9]++(?:[\x20()./-]{1,3}[0-9]++){0,6}+$"))

    return let(matches(cluster["said"], "[0-9]+"), runs)


def candidates(text: Column) -> Column:
    """Overlapping candidates: array of code, first, end, said, before, after."""
    out = []
    for code, (name, pattern) in enumerate(GENERATORS.items()):
        found = matches(text, pattern)
        if name == "number":
            found = F.flatten(F.transform(found, _subruns))
        elif name == "address6":
            found = F.filter(found, lambda x: F.length(x["said"]) - F.length(F.replace(x["said"], F.lit(":"), F.lit(""))) >= 3)
        elif name == "secret":
            found = F.filter(found, lambda x: x["said"].rlike("[0-9]") & x["said"].rlike("[A-Za-z]"))
        found = F.when(_may_hold(name, text), found).otherwise(F.from_json(F.lit("[]"), _SPAN))
        out.append(F.transform(found, _coded(code)))
    return F.concat(*out)


def _coded(code: int):
    return lambda x: F.struct(F.lit(code).alias("code"), x["first"].alias("first"), x["end"].alias("end"), x["said"].alias("said"), x["before"].alias("before"), x["after"].alias("after"))


def feature_columns(x: Column) -> list[Column]:
    """What the trees see of a candidate."""
    said, before, after = x["said"], x["before"], x["after"]
    runs = F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0))
    count = lambda c: F.length(said) - F.length(F.replace(said, F.lit(c), F.lit("")))
    one = lambda c: F.when(c, 1).otherwise(0)
    size = lambda k: F.coalesce(F.length(F.get(runs, k)), F.lit(0))
    digits = _digits(said)
    classes = one(said.rlike("[0-9]")) + one(said.rlike("[a-z]")) + one(said.rlike("[A-Z]"))
    return [
        F.length(said), F.length(digits), F.size(runs), F.aggregate(runs, F.lit(0), lambda a, r: F.greatest(a, F.length(r))),
        size(F.lit(0)), size(F.lit(1)), size(F.size(runs) - 1), count("("), count("."), count("-"), count(" "), count("/"),
        x["code"], F.when(said.contains("@"), 1).when(said.rlike(r"(?i)[\[({]at"), 2).when(said.rlike(r"(?i)\x20at\x20"), 3).otherwise(0),
        F.length(F.regexp_replace(said, "(?i)[^a-z]", "")), classes, one(said.rlike("^[0-9a-fA-F]+$")), one(said.rlike(r"(?i)dot")),
        *[one(before.rlike(w)) for w in _BEFORE_WORDS], one(after.rlike(_AFTER_WORDS)),
        one(before.rlike(r"[A-Za-z0-9@_]$")), one(before.rlike(r"[0-9][)./\x20-]{1,2}\(?$")), one(after.rlike("^[A-Za-z0-9@_]")), one(after.rlike(r"^[)./\x20-]{1,3}[0-9]")),
        one(F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)), one(said.rlike(r"^\(?(?:19|20)[0-9]{2}(?![0-9])")),
    ]


#: Places of the features that the base rules decide by, and how many there are.
_LUHN, _FEATURES = 28, 30
_MASKED = (_LUHN,)


def measured(found: Column) -> Column:
    """The candidates' code, first, end and features, computed once."""
    return F.transform(found, lambda x: F.struct(x["code"].alias("code"), x["first"].alias("first"), x["end"].alias("end"), F.array(*[c.cast("double") for c in feature_columns(x)]).alias("f")))


def found(text: Column, base: Column) -> Column:
    """The measured candidates of a whole text that touch no span of `base`."""

    def inside(w: Column) -> Column:
        own = F.filter(measured(candidates(w["part"])), lambda x: (x["first"] >= w["own"]) & (x["first"] < w["own"] + WINDOW) & ~F.exists(w["near"], lambda b: (b["first"] < w["at"] + x["end"]) & (w["at"] + x["first"] < b["end"])))
        return F.transform(own, lambda x: F.struct(x["code"].alias("code"), (w["at"] + x["first"]).alias("first"), (w["at"] + x["end"]).alias("end"), x["f"].alias("f")))

    def window(k: Column) -> Column:
        at = F.greatest(k * WINDOW - LEAD, F.lit(0))
        near = F.filter(base, lambda b: (b["first"] < (k + 1) * WINDOW + TAIL) & (b["end"] > k * WINDOW - LEAD))
        return F.struct(at.alias("at"), (k * WINDOW - at).alias("own"), F.substring(text, at + 1, F.lit(WINDOW + LEAD + TAIL)).alias("part"), near.alias("near"))

    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / WINDOW).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), window)
    return F.flatten(F.transform(windows, inside))


# -- examples and trees ------------------------------------------------------------------------------------------------


def _digit_groups(r: random.Random, sizes: list[int], sep: str) -> str:
    return sep.join("".join(r.choice("0123456789") for _ in range(n)) for n in sizes)


def made_up(n: int = 4000, seed: int = 7) -> list[tuple[str, int, int]]:
    """Sentences with the place of the personal data in them; nothing for sentences without."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuw") for _ in range(r.randint(2, 8)))
    some = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    pick_ = r.choice

    def number(ok: bool) -> str:
        while True:
            x = pick_("3456") + _digit_groups(r, [15], "")
            if (sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, x[::-1]))) % 10 == 0) == ok:
                return x

    def positive() -> tuple[str, str]:
        sep = pick_(["-", ".", " ", "/"])
        kind = r.randrange(10)
        other = pick_([str(r.randint(1, 99)), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"])
        if kind in (0, 9):
            return pick_([some(), "call me at", "tel:", f"{some()} {other}", f"{some()} {other}"]), f"({_digit_groups(r, [3], '')}) {_digit_groups(r, [3, 4], '-')}"
        if kind == 1:
            return pick_(["tel", "phone:", "call", "my mobile is", "fax", "Phone number:", "whatsapp"]), _digit_groups(r, pick_([[3, 3, 4], [1, 3, 3, 4], [2, 4, 4], [4, 3, 3], [10], [11], [5, 6]]), sep)
        if kind == 2:
            c = number(True)
            return pick_([some(), "card", "visa", "card number:"]), pick_([".", "/", "  "]).join([c[:4], c[4:8], c[8:12], c[12:]])
        if kind == 3:
            return pick_([some(), "mail", "contact:"]), f"{word()}{r.randint(1, 99)}@{word()}.{word()[:3]}"
        if kind in (4, 5):
            at, dot = pick_([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "."), (" @ ", "."), ("(at)", ".")])
            return pick_([some(), "mail", "contact:", "write to"]), f"{word()}.{word()}{at}{word()}{dot}{pick_(['com', 'org', 'net', 'de'])}"
        if kind == 6:
            return pick_([some(), "from", "host"]), ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))
        alphabet = pick_(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        secret = "".join(r.choice(alphabet) for _ in range(r.randint(20, 48))) + "7a"
        return pick_([f'{some()} {pick_(["token", "api_key", "secret", "key"])} {pick_(["=", ":"])} "'.rstrip(), "password:", "token ="]), pick_([secret, secret[:9] if kind == 8 else secret])

    def negative() -> tuple[str, str]:
        sep = pick_(["-", ".", "/", " "])
        kind = r.randrange(11)
        if kind == 0:
            return some(), _digit_groups(r, [4, 2, 2], sep).replace(sep, sep)
        if kind == 1:
            return pick_([some(), "on"]), sep.join([f"{r.randint(1, 28):02d}", f"{r.randint(1, 12):02d}", f"{r.randint(1900, 2030)}"])
        if kind == 2:
            return pick_(["version", "build", some()]), ".".join(str(r.randint(0, 99)) for _ in range(r.randint(4, 6)))
        if kind == 3:
            return pick_(["order", "invoice no", "ref", "isbn", "id =", "lot", "article no."]), _digit_groups(r, pick_([[3, 3, 4], [10], [13], [3, 1, 4, 4, 1], [8]]), sep)
        if kind == 4:
            return some(), f"{_digit_groups(r, [2, 3, 3], ' ')} {pick_(['units', 'kg', 'EUR', 'pages', 'words'])}"
        if kind == 5:
            return some(), _digit_groups(r, [r.randint(2, 5) for _ in range(r.randint(3, 12))], pick_([" ", "  "]))
        if kind == 6:
            return pick_(["pages", some()]), _digit_groups(r, [4, 4], "-")
        if kind == 7:
            return pick_(["card", some()]), number(False)
        if kind == 8:
            return f"{word()} {word()}", f"at {word()}.{word().title()} {word()}"
        if kind == 9:
            return some(), pick_(["-" * 30 + "a1", f"{'/'.join(word() for _ in range(6))}/page1", f"{'_'.join(word() for _ in range(6))}2", f"https//www.{word()}.com/{word()}/{word()}/{word()}1"])
        return some(), _digit_groups(r, [r.randint(7, 19)], "")

    out = []
    for k in range(n):
        before, said = positive() if k % 2 else negative()
        # Other numbers may stand on both sides.
        near = lambda: pick_([_digit_groups(r, [2], ""), _digit_groups(r, [2, 2], "/"), _digit_groups(r, [4, 2, 2], "-"), _digit_groups(r, [1], "")]) if r.random() < 0.3 else some()
        lead = f"{some()} {near() + ' ' if r.random() < 0.3 else ''}{before}{'' if before.endswith(chr(34)) else ' '}"
        out.append((f"{lead}{said}{pick_([' ', ', ', '. '])}{near()}", len(lead) if k % 2 else -1, len(lead) + len(said) if k % 2 else -1))
    return out


def _labelled_candidates(rows: DataFrame, found: Column, label: Callable[[Column], Column], masked: Callable[[Column], Column]) -> DataFrame:
    """kind code, features and label of candidates; `masked` of them lose what the base rules decide by."""
    x = F.col("x")
    f = F.transform(x["f"], lambda v, i: F.when(i.isin(*_MASKED) & masked(x), 0.0).otherwise(v))
    return rows.select("*", F.explode(measured(found)).alias("x")).select(x["code"].alias("code"), f.alias("f"), label(x).cast("int").alias("y"), F.xxhash64(x["first"], f).alias("h"))


def examples(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the made-up and the weakly labelled candidates; at most `sample` documents come together in one task."""
    spark: SparkSession = documents.sparkSession
    texts = spark.createDataFrame(made_up(), "text string, a int, z int")
    first = _labelled_candidates(texts, candidates(F.col("text")), lambda x: (x["first"] == F.col("a")) & (x["end"] == F.col("z")), lambda x: F.lit(False))
    real = pick(documents, "doc_id", "text").where(F.col("text").rlike(r"[0-9][0-9\x20()./-]{5}|@"))
    real = real.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample)
    real = real.select("text", F.concat(*[F.transform(c, _labelled(k)) for k, c in base_spans(F.col("text")).items()]).alias("base"))
    touched = lambda x: F.exists("base", lambda b: (b["first"] < x["end"]) & (x["first"] < b["end"]))
    ends = lambda x: F.exists("base", lambda b: (b["end"] == x["end"]) & (b["first"] <= x["first"])) & ((x["code"] != 0) | (F.get(x["f"], F.lit(1)) >= 10))
    # Base rules know nothing of secrets or IPv6, so they label numbers and addresses only.
    second = _labelled_candidates(staged(real, "pii-sample").where(F.size("base") < 200), candidates(F.col("text")), ends, touched)
    got = first.union(second.where("code < 2")).groupBy("code", "f", "y").agg(F.count("*").alias("n")).orderBy("code", "f", "y").collect()
    x, y, n = np.array([r.f for r in got], float).reshape(-1, _FEATURES), np.array([r.y for r in got]), np.minimum([r.n for r in got], 20)
    return np.repeat(x, n, axis=0), np.repeat(y, n)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 4, rate: float = 0.3, precision: float = 0.97) -> tuple[list, dict[str, float]]:
    """Boosted trees on two thirds of the examples; by kind, the least score above which the rest has the wanted precision."""
    held = np.arange(len(y)) % 3 == 0
    cuts = [np.unique(np.quantile(x[~held, f], np.linspace(0, 1, 17)))[:-1] for f in range(x.shape[1])]
    score, out = np.zeros(len(y)), []

    def grow(rows: np.ndarray, inside: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        used = rows[inside[rows]]
        leaf = float(-g[used].sum() / (h[used].sum() + 1.0))
        if not left or len(used) < 20:
            return leaf
        whole, best = g[used].sum() ** 2 / (h[used].sum() + 1), (1e-3, None, None)
        for f, marks in enumerate(cuts):
            if not len(marks):
                continue
            at = np.searchsorted(marks, x[used, f], side="left")
            ga, ha = (np.cumsum(np.bincount(at, weights=w[used], minlength=len(marks) + 1))[:-1] for w in (g, h))
            gain = ga**2 / (ha + 1) + (g[used].sum() - ga) ** 2 / (h[used].sum() - ha + 1) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float(marks[k]))
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], inside, g, h, left - 1), grow(rows[~low], inside, g, h, left - 1)

    def put(tree, rows: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            score[rows] += rate * tree
            return
        low = x[rows, tree[0]] <= tree[1]
        put(tree[2], rows[low])
        put(tree[3], rows[~low])

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(y)), ~held, p - y, p * (1 - p), depth))
        put(out[-1], np.arange(len(y)))
    kinds = np.array(_OF_CODE)[x[:, 12].astype(int)]
    kinds[(x[:, 12] == 0) & (x[:, 1] >= 14)] = "card"
    thresholds = {}
    for kind in ALL_KINDS:
        mine = held & (kinds == kind)
        steps = np.unique(score[mine & (y == 1)])
        thresholds[kind] = next((max(float(c), 0.0) for c in steps if y[mine & (score >= c)].mean() >= precision), float("inf"))
    return [(rate, t) for t in out], thresholds


def tree_sql(tree) -> str:
    """A tree over the array x.f as a CASE expression."""
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    return f"CASE WHEN x.f[{tree[0]}] <= {tree[1]}D THEN {tree_sql(tree[2])} ELSE {tree_sql(tree[3])} END"


def scored_sql(column: str, model: tuple[list, dict[str, float]]) -> str:
    """The measured candidates of `column` that reach the threshold of their kind: array of first, back, end, kind, score, code."""
    trees, thresholds = model
    total = " + ".join(f"{rate}D * {tree_sql(tree)}" for rate, tree in trees)
    kind = "CASE WHEN x.code = 0 AND x.f[1] >= 14 THEN 'card' ELSE array(" + ", ".join(f"'{k}'" for k in _OF_CODE) + ")[x.code] END"
    rows = f"transform({column}, x -> named_struct('first', x.first, 'back', -x.end, 'end', x.end, 'kind', {kind}, 'score', {total}, 'code', x.code))"
    reached = " OR ".join(f"y.kind = '{k}' AND y.score >= {c}D" for k, c in thresholds.items() if np.isfinite(c)) or "false"
    return f"array_sort(filter({rows}, y -> {reached}))"


def best_spans(chosen: Column) -> Column:
    """Of overlapping candidates, in order of place, those that no better scored one overlaps (then the longer, then the first): array of kind, first, end."""

    def best(rows: Column) -> Column:
        # What overlaps a candidate of a cluster is among its 49 neighbours on either side.
        near = lambda i: F.slice(rows, F.greatest(i - _GROUPS**2, F.lit(0)) + 1, F.lit(2 * _GROUPS**2 + 1))
        rank = lambda x: F.struct(x["score"], x["end"] - x["first"], -x["first"], -x["code"])
        beats = lambda y, x: (y["first"] < x["end"]) & (x["first"] < y["end"]) & (rank(y) > rank(x))
        return F.filter(rows, lambda x, i: ~F.exists(near(i), lambda y: beats(y, x)))

    return F.transform(let(chosen, best), lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["end"].alias("end")))


def _say(spans: Column) -> Column:
    """kind:first:end by place and then kind, joined."""
    order = lambda x: F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"])
    rows = F.transform(spans, lambda x: F.struct(x["first"].alias("first"), order(x).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["end"].cast("string"))), ",")


def find(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, base and added (arrays of kind, first, end) of each document; no shuffle but for the bounded sample that the trees are fitted on."""
    model = fit(*examples(documents, sample))
    rows = pick(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    base = F.concat(*[F.transform(F.col(k), _labelled(k)) for k in KINDS])
    rows = rows.select("doc_id", "text", base.alias("base"))
    some = F.lit(False)
    for name in GENERATORS:
        some = some | _may_hold(name, F.col("text"))
    rows = rows.select("doc_id", "text", "base", F.when(some, found(F.col("text"), F.col("base"))).otherwise(F.from_json(F.lit("[]"), _FOUND)).alias("found"))
    rows = rows.select("doc_id", "text", "base", F.expr(scored_sql("found", model)).alias("chosen"))
    return rows.select("doc_id", "text", "base", F.when(F.size("chosen") > 0, best_spans(F.col("chosen"))).otherwise(F.from_json(F.lit("[]"), "array<struct<kind:string,first:int,end:int>>")).alias("added"))


def report(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (all, joined), n_spans (of all)."""
    rows = find(documents, sample)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.size("base") + F.size("added")
    return rows.select("doc_id", *counts, F.sha2(_say(F.col("base")), 256).alias("base_sha256"), _say(F.concat("base", "added")).alias("spans"), every.cast("long").alias("n_spans"))


def redact(documents: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; where spans overlap, the first one counts."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["first"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["first"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), put.alias("out")))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return find(documents).withColumn("spans", spans).select("doc_id", done.alias("text"))
