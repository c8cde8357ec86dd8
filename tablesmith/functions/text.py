"""Scalar text functions as Column expressions: cleaning, numbers, entity keys, URLs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing. Operators differ on purpose, so the sets stay apart.
MISSING = {
    "validator": ("", "na", "n/a", "none", "null", "unknown"),
    "pruner": ("", "unknown", "n/a", "na", "none", "null"),
    "coalesce": ("", "nan", "none", "null", "n/a", "na"),
    "empty_row": ("", "nan", "none", "null"),
    "merge": ("", "unknown", "n/a", "na", "none", "null"),
    "target": ("", "unknown", "n/a", "na", "none", "null", "not disclosed", "undisclosed"),
    "cell": ("", "nan", "none", "n/a"),
}
#: Words that a canonical entity key drops.
CORPORATE = ("inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "llc", "plc", "group", "holdings")
#: Second-level labels that belong to the suffix of a host.
SUFFIX_LABELS = ("co", "com", "org", "gov", "ac")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often use refers to it; otherwise each mention copies the expression."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """White space, no-break spaces included, off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def missing(c: Column, kind: str, is_text: bool = True) -> Column:
    """Null, or for text one of the tokens that mean missing for this kind of operator."""
    return (c.isNull() | F.lower(strip(c)).isin(*MISSING[kind])) if is_text else c.isNull()


def strict_double(c: Column) -> Column:
    """A plain decimal or exponent literal as a double; anything else is null, `inf`, `1d` and `1_000` too."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def to_float(c: Column) -> Column:
    """Number of a text without commas, dollar and percent signs."""
    return strict_double(strip(F.regexp_replace(c, "[,$%]", "")))


def clean_price(c: Column) -> Column:
    """First number of a price in either locale: the later of comma and point is the decimal mark."""
    found = F.regexp_extract(F.regexp_replace(strip(c), " ", " "), r"[-+]?\d[\d.,\s]*", 0)
    found = F.regexp_replace(found, r"\s+", "")
    return let(found, _price)


def _price(found: Column) -> Column:
    without = lambda x, chars: F.translate(x, chars, "")
    has_comma, has_point = F.instr(found, ",") > 0, F.instr(found, ".") > 0
    comma_last = F.instr(F.reverse(found), ",") < F.instr(F.reverse(found), ".")
    commas = F.length(found) - F.length(without(found, ","))
    tail = F.length(F.substring_index(found, ",", -1))
    both = F.when(comma_last, F.translate(without(found, "."), ",", ".")).otherwise(without(found, ","))
    only_comma = F.when((commas == 1) & (tail <= 2), F.translate(found, ",", ".")).otherwise(without(found, ","))
    plain = F.when(has_comma & has_point, both).when(has_comma, only_comma).otherwise(found)

    def one_point(parts: Column) -> Column:
        several = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ""), F.lit("."), F.element_at(parts, -1))
        return strict_double(F.when(F.size(parts) > 2, several).otherwise(F.array_join(parts, ".")))

    return let(F.split(plain, r"\."), one_point)


def _scaled(text: Column, scales: tuple[tuple[str, float], ...], number: Callable[[Column], Column]) -> Column:
    """number(text without its suffix) times what the first suffix that fits says; text and number are evaluated once."""

    def split(t: Column) -> Column:
        n, factor = F.lit(0), F.lit(1.0)
        for suffix, times in reversed(scales):
            fits = F.lower(t).endswith(suffix)
            n, factor = F.when(fits, len(suffix)).otherwise(n), F.when(fits, times).otherwise(factor)
        return number(F.left(t, F.length(t) - n)) * factor

    return let(text, split)


#: Scale suffixes of each parser.
NUMERIC_SCALES = (("k", 1e3), ("m", 1e6), ("b", 1e9), ("t", 1e12))
LIKE_ZEROS = (("bn", 9), ("b", 9), ("m", 6), ("k", 3))
MONEY_SCALES = (("bn", 1e9), ("m", 1e6), ("k", 1e3))
UNITS = r"(?i)( gb|gb| tb|tb| kg|kg| lbs|lb| inch| inches| in| hz| wh)$"


def parse_numeric(c: Column) -> Column:
    """First number of a cell after one unit, a percent sign and one scale suffix (k, m, b, t)."""
    t = F.regexp_replace(F.regexp_replace(strip(c), "−", "-"), "[,$€£]", "")
    t = F.regexp_replace(F.regexp_replace(t, UNITS, ""), "%$", "")
    return _scaled(t, NUMERIC_SCALES, lambda x: strict_double(F.nullif(F.regexp_extract(x, r"-?\d+(?:\.\d+)?", 0), F.lit(""))))


def numeric_like(c: Column) -> Column:
    """Number of a text whose leading non-numeric part and scale suffix (bn, b, m, k) are taken off; null for other text."""
    t = F.regexp_replace(F.regexp_replace(strip(c), "[,$%]", ""), r"^[^\d\-.]+", "")

    def scaled(t: Column) -> Column:
        n, exponent = F.lit(0), F.lit("")
        for suffix, zeros in reversed(LIKE_ZEROS):  # an exponent scales exactly
            fits = F.lower(t).endswith(suffix)
            n, exponent = F.when(fits, len(suffix)).otherwise(n), F.when(fits, f"e{zeros}").otherwise(exponent)
        return strict_double(F.concat(strip(F.left(t, F.length(t) - n)), exponent))

    return let(t, scaled)


def parse_money(c: Column) -> Column:
    """Amount of money with currency signs, codes, `loan fee` and suffixes (bn, m, k); what isn't one is 0."""
    t = F.regexp_replace(strip(c), "[,€$£]", "")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"(?i)\b(?:eur|usd|gbp)\b", ""), r"(?i)loan fee:?", ""))
    return F.coalesce(_scaled(t, MONEY_SCALES, lambda x: strict_double(strip(x))), F.lit(0.0))


def is_numeric_like(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(strip(c), "[,$%]", ""), "^P+", "")
    return F.coalesce(t.rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def clean_cell(c: Column) -> Column:
    """Text of a table cell: footnotes in brackets gone, white space collapsed, missing tokens null."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(c), r"\[[^\]]*\]", ""), r"(?U)\s+", " "))
    return F.when(~missing(t, "cell"), t)


#: Patterns of hardware descriptions.
RAM = r"(?i)(\d+(?:\.\d+)?)\s*GB\s+(?:RAM|Memory)\b"
STORAGE = r"(?i)(\d+(?:\.\d+)?)\s*(TB|GB)\s+(?:SSD|HDD|Storage)\b"
GPU = (
    r"(?i)(NVIDIA\s+GeForce\s+[A-Za-z0-9\- ]+)",
    r"(?i)(AMD\s+Radeon\s+[A-Za-z0-9\- ]+)",
    r"(?i)(Intel\s+(?:Arc|Iris\s+Xe|UHD)\s+[A-Za-z0-9\- ]+)",
    r"(?i)(RTX\s+\d{3,4}(?:\s*Ti)?)",
    r"(?i)(GTX\s+\d{3,4}(?:\s*Ti)?)",
)


def extract_specs(c: Column) -> Column:
    """Struct of ram_gb, storage_gb (terabytes count 1024) and gpu_model of a hardware description; null where not given."""
    group = lambda p, i=1: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    storage = strict_double(group(STORAGE)) * F.when(F.upper(group(STORAGE, 2)) == "TB", 1024).otherwise(1)
    gpu = F.regexp_replace(F.coalesce(*map(group, GPU)), r"^[ ,]+|[ ,]+$", "")
    return F.struct(strict_double(group(RAM)).cast("long").alias("ram_gb"), storage.cast("long").alias("storage_gb"), gpu.alias("gpu_model"))


#: Processors, graphics and sizes in a laptop's name, what parts the name, and the sizes that a display has.
LAPTOP_CPU = r"(?i)(Intel\s+Core(?:\s+Ultra)?\s+[A-Za-z0-9\- ]+|AMD\s+Ryzen\s+[A-Za-z0-9\- ]+|Apple\s+M\d(?:\s+(?:Pro|Max|Ultra))?|Snapdragon\s+[A-Za-z0-9\- ]+)"
LAPTOP_GPU = r"(?i)(NVIDIA\s+GeForce\s+[A-Za-z0-9\- ]+|AMD\s+Radeon\s+[A-Za-z0-9\- ]+|Intel\s+(?:Arc|Iris\s+Xe|UHD)\s+[A-Za-z0-9\- ]*i?GPU?[A-Za-z0-9\- ]*)"
LAPTOP_PARTS, LAPTOP_DISPLAY, DISPLAYS = r"\s+[⎘|]\s+", r"\b(\d{2}(?:\.\d)?)\b", (10.0, 20.0)
#: Mascots that follow a school's name, of two words and of one.
MASCOTS = ("blue devils", "tar heels", "wolf pack", "golden eagles", "crimson tide", "fighting irish", "red raiders", "hill toppers", "scarlet knights")
MASCOT_WORDS = (
    "tigers", "eagles", "bulldogs", "wildcats", "hawks", "bears", "lions", "bruins", "spartans", "crimson", "gators", "heels", "devils",
    "seminoles", "cardinals", "owls", "wolves", "pirates", "terriers", "chargers",
)
#: Sports that a page's address names.
SPORTS = ("basketball", "football", "soccer")


def laptop_fields(c: Column) -> Column:
    """Struct of name, cpu_model, gpu_model, ram_gb and display_size_inches of a laptop's full name; null where not given."""
    text = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(text, LAPTOP_PARTS), lambda x: F.regexp_replace(x, r"^[ ,|]+|[ ,|]+$", "")), lambda x: x != "")
    first = lambda p: F.get(F.filter(F.transform(parts, lambda x: F.regexp_replace(F.regexp_extract(x, p, 1), "^[ ,]+|[ ,]+$", "")), lambda x: x != ""), F.lit(0))
    display = strict_double(F.nullif(F.regexp_extract(text, LAPTOP_DISPLAY, 1), F.lit("")))
    return F.struct(
        F.get(parts, F.lit(0)).alias("name"), first(LAPTOP_CPU).alias("cpu_model"), first(LAPTOP_GPU).alias("gpu_model"), strict_double(first(RAM)).alias("ram_gb"),
        F.when(display.between(*DISPLAYS), display).alias("display_size_inches"),
    )


def school_name(c: Column) -> Column:
    """A team's name without its mascot, if more than two words are there."""
    many = F.size(F.split(c, r"\s+")) > 2
    two, one = rf"(?i)\s+(?:{'|'.join(MASCOTS)})$", rf"(?i)\s+(?:{'|'.join(MASCOT_WORDS)})$"
    return F.when(~many, c).when(c.rlike(two), F.regexp_replace(c, two, "")).otherwise(F.regexp_replace(c, one, ""))


def sport_of(url: Column) -> Column:
    """The sport that an address names, if any."""
    return F.coalesce(*[F.when(F.contains(F.lower(url), F.lit(s)), s) for s in SPORTS])


def category_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("wikipedia")), "list_entry").otherwise("directory_entry")


def coerce_number(c: Column, field: str, whole: bool) -> Column:
    """Number of a text for a field: a price, else what a hardware description gives for such a field; halves round to even."""
    specs = extract_specs(c)
    found = F.coalesce(clean_price(c), specs[field].cast("double")) if field in ("ram_gb", "storage_gb") else clean_price(c)
    return F.bround(found, 0).cast("long") if whole else found


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and outer dots; empty where there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(h, r"^\.+|\.+$", ""), F.lit(""))


def root_domain(url: Column) -> Column:
    """Last two labels of the host, or three where the second last belongs to the suffix."""
    parts = F.split(host(url), r"\.")
    second = F.get(parts, F.size(parts) - 2)
    n = F.when(F.size(parts) <= 2, F.size(parts)).when(second.isin(*SUFFIX_LABELS), 3).otherwise(2)
    return F.array_join(F.slice(parts, -n, n), ".")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, the rest as it is; empty unless http or https."""
    u = strip(url)
    form = r"(?s)^((?i:https?))://([^/?#]*)(.*)$"
    return F.when(u.rlike(form), F.concat(F.lower(F.regexp_extract(u, form, 1)), F.lit("://"), F.lower(F.regexp_extract(u, form, 2)), F.regexp_extract(u, form, 3))).otherwise("")


def metric_slug(url: Column) -> Column:
    """Last segment of the path as a column prefix."""
    tail = F.regexp_extract(url, r"^[^?#]*?/([^/?#]+)/?(?:[?#]|$)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(tail), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def season_year(goal: Column) -> Column:
    """Last year from 1900 to 2199 that a goal names; else 2025 for college sports, 2026 otherwise."""
    g = F.lower(goal)
    years = F.regexp_extract_all(g, F.lit(r"\b(19\d{2}|20\d{2}|21\d{2})\b"), F.lit(1))
    college = g.contains("ncaa") | (g.contains("college") & g.contains("basketball"))
    return F.coalesce(F.try_element_at(years, F.lit(-1)).cast("int"), F.when(college, 2025).otherwise(2026))


def middle_truncate(c: Column, most: int, mark: str = "\n...\n") -> Column:
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(half)))).otherwise(c)


def join_sources(*columns: Column) -> Column:
    """Distinct parts of ` | `-joined source lists, in order of appearance."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), r"\|") for c in columns]))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), " | ")


#: Names that end in a ticker; where words are parted before and what is taken out or put in after lower-casing.
TICKERS = (r"[a-z][A-Z]{2,}$", r"\d{3,5}\.[A-Z]{1,3}$", r"[A-Za-z]+\d{2,5}$")
PARTED = (("([a-z])([A-Z][a-z])", "$1 $2"), (r"([A-Za-z])(\d)", "$1 $2"), (r"(\d)([A-Za-z])", "$1 $2"))
CLEANED = ((r"\[[^\]]+\]", ""), ("&", " and "), (r"[^a-z0-9\s]", " "))


def canonical_key(c: Column) -> Column:
    """Entity key: words of letters and digits, split at case and digit changes, without corporate words and short tails."""

    def ticker(v: Column) -> Column:
        return reduce(lambda a, b: a | b, [v.rlike(p) for p in TICKERS])

    def words_of(v: Column) -> Column:
        t = reduce(lambda x, p: F.regexp_replace(x, *p), PARTED, v)
        t = reduce(lambda x, p: F.regexp_replace(x, *p), CLEANED, F.lower(t))
        return F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(*CORPORATE))

    def cut(words: Column, kind: str, most: int, also: Column | None = None) -> Column:
        def shorter(w: Column) -> Column:
            last = F.try_element_at(w, F.lit(-1))
            fits = (F.size(w) >= 2) & last.rlike(kind) & (F.length(last) <= most)
            return F.when(fits if also is None else fits & also, F.slice(w, 1, F.size(w) - 1)).otherwise(w)

        return let(words, shorter)

    def key(v: Column) -> Column:
        words = cut(words_of(v), "^[a-z]+$", 2)
        for kind, most in (("^[a-z]+$", 5), ("^[0-9]+$", 5), ("^[a-z]+$", 3)):
            words = cut(words, kind, most, ticker(v))
        return F.when(v.isNull() | F.lower(v).isin("", "nan", "none"), F.lit("")).otherwise(F.array_join(words, " "))

    return let(strip(c), key)


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text contains one of the phrases, as they are."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases], F.lit(False))
