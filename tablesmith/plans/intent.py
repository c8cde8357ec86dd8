"""What a goal in words asks for: entity, domain, row count, target, features, time. Driver-side, and as Columns for tables of goals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of precedence: words that show an entity or a domain; all groups of a rule must be met.
ENTITY_RULES = (
    ("school", (("program", "programs"), ("ncaa", "college", "basketball"))),
    ("player", (("player", "players"),)),
    ("team", (("team", "teams"),)),
    ("club", (("club", "clubs"),)),
    ("company", (("company", "companies", "startup", "startups"),)),
    ("bank", (("bank", "banks"),)),
    ("school", (("school", "schools"),)),
    ("state", (("state", "states"),)),
)
DOMAIN_RULES = (
    ("nba", (("nba",),)),
    ("ncaa-basketball", (("ncaa", "college"), ("basketball",))),
    ("soccer", (("soccer", "football"),)),
    ("startup", (("startup", "startups", "unicorn", "unicorns"),)),
    ("bank", (("bank", "banks"),)),
    ("laptop", (("laptop", "laptops", "notebook", "notebooks", "pc"),)),
    ("public-data", (("population", "gdp", "state", "states", "territory", "territories"),)),
)
TARGET_HINTS = (
    ("salary", r"\bsalar(?:y|ies)\b|\bpaid\b|\bpay\b"),
    ("valuation", r"\bvalu(?:ation|ations)\b|\bunicorn\b"),
    ("population_growth", r"\bpopulation growth\b|\bgrowth rate\b"),
    ("revenue", r"\brevenue\b|\bsales\b"),
    ("price", r"\bprice\b|\bcost\b"),
    ("gdp", r"\bgdp\b|\bgross domestic product\b"),
    ("market_cap", r"\bmarket cap\b|\bmarket value\b"),
    ("wins", r"\bwins?\b|\bwinning percentage\b"),
)
FEATURE_HINTS = (
    ("performance_stats", r"\bperformance\b|\bstats?\b|\badvanced\b|\bon-court\b"),
    ("funding", r"\bfunding\b|\bventure\b|\braised\b"),
    ("gdp", r"\bgdp\b|\beconomic\b"),
    ("population", r"\bpopulation\b|\bdemographic\b"),
    ("hardware_specs", r"\bspecs?\b|\bcpu\b|\bgpu\b|\bram\b|\bdisplay\b"),
    ("efficiency", r"\befficiency\b|\bmargin\b|\brating\b"),
    ("geography", r"\bstate\b|\bregion\b|\blocation\b"),
)
MODIFIERS = (
    ("official", r"\bofficial\b"),
    ("historical", r"\bhistorical\b|\bhistory\b|\barchive\b"),
    ("current", r"\bcurrent\b|\bmodern\b|\blatest\b|\bthis season\b"),
    ("top_n", r"\btop\s+\d+\b|\blargest\s+\d+\b"),
)
KINDS = "teams|players|clubs|companies|banks|schools|states"
COUNTS = (r"\btop\s+(\d{1,4})\b", r"\blargest\s+(\d{1,4})\b", r"\bfirst\s+(\d{1,4})\b", rf"\bfor\s+(\d{{1,4}})\s+(?:{KINDS})\b", rf"\b(\d{{1,4}})\s+(?:{KINDS})\b")
SEASONS = ("historical", "history", "season", "seasons", "yearly", "multi", "multiseason")
NCAA_PHRASES = ("division i", "programs", "teams", "team statistics")


def tokens(goal: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(goal), F.lit("([a-z0-9]+)"), F.lit(1)))


def has(words: Column, any_of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in any_of]))


def _first_rule(words: Column, rules: tuple, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for label, groups in reversed(rules):
        fits = F.lit(True)
        for g in groups:
            fits = fits & has(words, g)
        out = F.when(fits, label).otherwise(out)
    return out


def entity_intent(goal: Column) -> Column:
    return _first_rule(tokens(goal), ENTITY_RULES, "entity")


def domain_intent(goal: Column) -> Column:
    return _first_rule(tokens(goal), DOMAIN_RULES, "generic")


def cardinality(goal: Column) -> Column:
    """Struct of count and exact: rows that the goal implies, null if it implies none. A number in words from 1 to 5000 comes first."""
    low, words = F.lower(goal), tokens(goal)
    count = F.lit(None).cast("int")
    for p in reversed(COUNTS):
        n = F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("int")
        count = F.when(n.between(1, 5000), n).otherwise(count)
    entity, domain = entity_intent(goal), domain_intent(goal)
    exact = lambda n: F.struct(F.lit(n).alias("count"), F.lit(True).alias("exact"))
    phrase = F.lit(False)
    for p in NCAA_PHRASES:
        phrase = phrase | low.contains(p)
    all_teams = (domain == "nba") & (entity == "team")
    return (
        F.when(count.isNotNull(), F.struct(count.alias("count"), F.lit(True).alias("exact")))
        .when(all_teams & has(words, SEASONS), F.lit(None))
        .when(all_teams, exact(30))
        .when((entity == "state") & (has(words, ("u", "s", "us")) | low.contains("u.s.")), exact(50))
        .when(low.contains("fortune 500"), exact(500))
        .when(low.contains("ncaa") & low.contains("basketball") & phrase, F.struct(F.lit(365).alias("count"), F.lit(False).alias("exact")))
    )


def hints(goal: Column, patterns: tuple) -> Column:
    """Labels of the patterns that a goal matches, in their order."""
    low = F.lower(F.regexp_replace(F.trim(goal), r"\s+", " "))
    return F.array_compact(F.array(*[F.when(low.rlike(p), label) for label, p in patterns]))


def decompose(goal: Column) -> Column:
    """Struct of domain_intent, entity_intent, target_hint, feature_hints, modifiers, temporal_scope and row_count_hint."""
    modifiers = hints(goal, MODIFIERS)
    dated = F.lower(goal).rlike(r"\b(19\d{2}|20\d{2}|21\d{2})\b") | F.array_contains(modifiers, "historical")
    scope = F.when(dated, "historical").when(F.array_contains(modifiers, "current"), "current").otherwise("recent")
    return F.struct(
        domain_intent(goal).alias("domain_intent"), entity_intent(goal).alias("entity_intent"), F.get(hints(goal, TARGET_HINTS), F.lit(0)).alias("target_hint"),
        hints(goal, FEATURE_HINTS).alias("feature_hints"), modifiers.alias("modifiers"), scope.alias("temporal_scope"), cardinality(goal)["count"].alias("row_count_hint"),
    )


@dataclass(frozen=True)
class Goal:
    """A goal read on the driver, by the same rules."""

    text: str
    entity: str
    domain: str
    target: str | None
    features: tuple[str, ...]


def read_goal(text: str) -> Goal:
    words = set(re.findall(r"[a-z0-9]+", text.lower()))
    first = lambda rules, otherwise: next((label for label, groups in rules if all(words & set(g) for g in groups)), otherwise)
    low = re.sub(r"\s+", " ", text.strip()).lower()
    found = lambda patterns: tuple(label for label, p in patterns if re.search(p, low))
    return Goal(text, first(ENTITY_RULES, "entity"), first(DOMAIN_RULES, "generic"), next(iter(found(TARGET_HINTS)), None), found(FEATURE_HINTS))


def row_count_fits(rows: int, count: int | None, exact: bool, minimum: int = 20) -> bool:
    """Whether a table's length suits the implied count: from half of it (0.4 if approximate), or `minimum` if that is less,
    to one and a half times (twice) it, or a few rows more."""
    if not count or count <= 0:
        return rows >= minimum
    share, times, more = (0.5, 1.5, 2) if exact else (0.4, 2.0, 5)
    return min(minimum, max(3, int(share * count))) <= rows <= max(count + more, int(times * count))
