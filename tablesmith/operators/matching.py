"""Columns of scraped tables against the fields of a schema, and tables against a goal.

Inputs are names, shares and samples of a few values, so all of this is driver-side; `head_samples` and `coverage`
bring them from the data in one job each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from tablesmith.functions.text import missing
from tablesmith.operators.columns import normalize
from tablesmith.operators.quality import numeric_columns
from tablesmith.operators.tables import is_text
from tablesmith.session import ship

# --- Fixed values ---------------------------------------------------------------------------------------------------
#: Words of a column, by field, of which one group has to be there as a whole: those of the table builder.
BUILDER_ALIASES = {
    "state": (("state",), ("territory",), ("district",), ("federal", "district"), ("name",)),
    "bank": (("bank",), ("name",)),
    "company": (("company",), ("name",)),
    "company_name": (("company",), ("name",)),
    "population": (("population",), ("pop",), ("census", "population")),
    "population_growth_rate": (("population", "growth"), ("population", "change"), ("pop", "change"), ("growth", "rate"), ("percent", "change"), ("change",)),
    "gdp": (("gdp",), ("gross", "domestic", "product"), ("nominal", "gdp")),
    "gdp_growth_rate": (("gdp", "growth"), ("gdp", "percent", "change"), ("economic", "growth", "rate"), ("real", "gdp", "growth", "rate")),
    "rank": (("rank",), ("fortune", "rank")),
    "revenue_usd_millions": (("revenue",), ("revenues",)),
    "revenue_growth": (("revenue", "growth"), ("growth",)),
    "employees": (("employees",),),
    "headquarters": (("headquarters",), ("hq",)),
    "industry": (("industry",), ("sector",)),
    "price_usd": (("price",), ("msrp",), ("cost",)),
    "salary": (("salary",), ("2025", "26"), ("2026", "27")),
    "player": (("player",), ("name",)),
    "points_per_game": (("points",), ("pts",), ("ppg",)),
    "assists_per_game": (("assists",), ("ast",), ("apg",)),
    "rebounds_per_game": (("rebounds",), ("reb",), ("rpg",), ("trb",)),
    "minutes_per_game": (("minutes",), ("min",), ("mpg",), ("mp",)),
}
#: The same for the extractor of typed rows.
EXTRACTOR_ALIASES = {
    "state": (("state",), ("territory",), ("district",), ("federal", "district")),
    "population": (("population",), ("pop",), ("census", "population")),
    "population_growth_rate": (("population", "growth"), ("population", "change"), ("pop", "change"), ("growth", "rate"), ("percent", "change"), ("change",)),
    "gdp": (("gdp",), ("gross", "domestic", "product"), ("nominal", "gdp")),
    "gdp_growth_rate": (("gdp", "growth"), ("gdp", "percent", "change"), ("economic", "growth", "rate"), ("real", "gdp", "growth", "rate")),
    "name": (("name",), ("team",), ("organization",), ("company",), ("model",), ("device",), ("laptop",)),
    "price_usd": (("price",), ("lowest", "price"), ("msrp",), ("cost",)),
    "cpu_model": (("cpu",), ("processor",), ("chip",)),
    "gpu_model": (("gpu",), ("graphics",), ("graphics", "adapter")),
    "ram_gb": (("ram",), ("memory",), ("system", "memory")),
    "storage_gb": (("ssd",), ("storage",), ("drive",)),
    "display_size_inches": (("display",), ("screen",), ("size",)),
    "weight_kg": (("weight",),),
}
#: What words do to a field's score besides, in order: groups of which one word each is there, and "zero" (no match at all),
#: "floor" or "cap" with points; "plus" adds to a score that isn't zero. "=name" asks for that very column.
BUILDER_RULES = {
    "population_growth_rate": (((("gdp",),), "zero", 0), ((("population",), ("growth", "change")), "floor", 9), ((("change",),), "floor", 5)),
    "gdp": (((("growth", "change", "percent", "rate"),), "zero", 0), ((("gdp",),), "floor", 8)),
    "gdp_growth_rate": (((("gdp",), ("growth", "change")), "floor", 9),),
    "bank": (((("=name",),), "floor", 6),),
    "company": (((("=name",),), "floor", 6),),
    "company_name": (((("=name",),), "floor", 6),),
    "state": (((("=name",),), "floor", 6),),
    "rank": (((("revenue",),), "zero", 0),),
    "revenue_usd_millions": (((("growth",),), "zero", 0),),
    "salary": (((("rk", "rank"),), "cap", 2), ((("salary",),), "floor", 8), ((("2025",), ("26",)), "floor", 9)),
    "points_per_game": (((("pts", "points"),), "floor", 8),),
    "assists_per_game": (((("ast", "assists"),), "floor", 8),),
    "rebounds_per_game": (((("reb", "rebounds", "trb"),), "floor", 8),),
    "minutes_per_game": (((("min", "minutes", "mp"),), "floor", 8),),
}
_YEARS = ("2025", "2024", "2023", "2022", "2021", "2020")
EXTRACTOR_RULES = {
    "population_growth_rate": (((("gdp",),), "zero", 0), ((("population",), ("growth", "change")), "floor", 9), ((("change",),), "floor", 5)),
    "population": (((("population", "pop"),), "floor", 8), ((_YEARS,), "plus", 1)),
    "gdp": (((("growth", "change", "percent", "rate"),), "zero", 0), ((("gdp",),), "floor", 8), ((_YEARS,), "plus", 1)),
    "gdp_growth_rate": (((("gdp",), ("growth", "change")), "floor", 9),),
    "state": (((("state",),), "floor", 8), ((("territory", "district"),), "floor", 6)),
    "name": (((("model", "laptop", "device"),), "floor", 6),),
}
#: Columns that match nothing, points of equal names and of one name within the other, and the least score of a match.
BUILDER_NEVER, EXTRACTOR_NEVER = ("", "rank", "geo_sort", "source"), ("", "rank", "geosort")
BUILDER_EXACT, EXTRACTOR_EXACT, PART, LEAST = 7, 6, 4, 4
#: Headers that have a field of their own, and the fields they go to: the first that the schema has.
HEADERS = (
    (("school", "college", "university"), ("school",)),
    (("nickname", "teamname", "mascot"), ("nickname", "team_name", "name")),
    (("conference", "league"), ("conference",)),
    (("homearena", "arena"), ("home_arena",)),
    (("homestadium", "stadium"), ("stadium",)),
    (("tournamentappearances", "appearances"), ("tournament_appearances",)),
    (("finalfourappearances", "finalfour"), ("final_four_appearances",)),
    (("championshipwins", "championships"), ("championship_wins",)),
)
NAME_HEADERS, NAME_FIELDS = ("team", "name", "program"), ("team_name", "name", "entity_name", "organization_name")
#: Columns that name entities: in order, and what comes first for a kind of entity.
ENTITY_COLUMNS = ("bank", "club", "club_name", "company", "team", "school", "name", "player", "organization", "school_name", "team_name", "entity_name", "title")
ENTITY_FIRST = {
    "player": ("player", "name", "player_name", "entity_name", "team", "company", "organization", "title"),
    "company": ("company", "organization", "name", "entity_name", "title"),
    "bank": ("bank", "name", "organization", "company", "entity_name", "title"),
    "team": ("team", "school", "name", "entity_name", "title"),
    "club": ("team", "school", "name", "entity_name", "title"),
}
#: Points of words in a column's name as an entity's, the first that fits; of words against it; and of its values.
ENTITY_POINTS = ((("bank",), 7), (("company",), 6), (("school",), 5), (("team",), 4), (("name",), 3), (("player", "company", "organization", "title"), 2))
ENTITY_AGAINST, ENTITY_AGAINST_POINTS, NUMBERS_POINTS, LETTERS_POINTS = ("rank", "rk", "no", "number", "position"), -5, -6, 2
#: Fields of a schema that hold an entity's name, and columns that are no features.
ENTITY_FIELDS = ("bank", "club", "company", "company_name", "player", "school", "state", "team")
IDENTITY = ("name", "entity_name", "raw_entity_name", "source_url")
#: Parts of names that tell a target, by who asks.
VALIDATOR_TARGETS = ("target", "label", "outcome", "result", "winner", "salary", "price", "valuation", "revenue", "income", "profit", "score")
SYNTHESIZER_TARGETS = ("target", "label", "outcome", "destination", "status", "result", "winner", "transfer", "price", "salary", "churn", "default")
FINAL_TARGETS = ("target", "label", "outcome", "salary", "valuation", "revenue", "income", "gdp", "growth")
#: Names of columns that say little.
LOW_SIGNAL, RANKS = ("column", "unnamed", "unnamed_0", "unnamed_1"), ("rk", "rank")
#: How well a table suits a goal. By intent (or a word of the goal): its entity column, parts of its source, points.
ALIGNMENT = (
    (("team",), ("team",), ("team",), (), 8),
    (("team",), ("team",), (), ("team", "/teams/"), 4),
    (("team",), ("team",), (), ("season",), -5),
    (("club",), (), ("club", "team", "name"), (), 8),
    (("club",), (), (), ("transfermarkt", "club"), 4),
    (("player",), (), ("player", "name"), (), 8),
    (("player",), (), (), ("player", "/players"), 4),
    (("player",), (), (), ("salary",), 4),
    (("player",), (), (), ("teamrankings.com/nba/stat/",), -12),
    ((), ("company",), ("company",), (), 8),
    ((), ("company",), ("name",), (), 4),
    ((), ("bank",), ("bank",), (), 8),
    ((), ("school",), ("school",), (), 8),
    ((), ("fortune",), (), ("fortune_500", "fortune500", "list_of_fortune_500_companies"), 12),
    ((), ("fortune",), (), ("companiesmarketcap",), -8),
)
YEARS_AS_NAMES = -6
TARGET_MARKERS = ("salary", "valuation", "revenue", "income", "spend", "transfer", "outcome", "label")
FORTUNE = ("fortune_500", "fortune500", "list_of_fortune_500_companies")
# --------------------------------------------------------------------------------------------------------------------

SAMPLE = 25


def words_of(label: str) -> set[str]:
    return {w for w in re.split(r"[^a-z0-9]+", label.lower()) if w}


def letters(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", label.lower())


def _score(field: str, column: str, form: Callable[[str], str], aliases: dict, rules: dict, never: tuple, exact: int, part: Callable[[str, str], bool]) -> int:
    own, wanted = form(column), form(field)
    if own in never:
        return 0
    have = words_of(f"{column} {own}")
    points = [3 * len(group) for group in aliases.get(field, ((wanted,),)) if have.issuperset(group)]
    points.append(exact if own == wanted else PART if wanted and part(own, wanted) else 0)
    score = max(points)
    for groups, effect, n in rules.get(field, ()):
        if not all(have.intersection(g) or (g[0] == f"={own}") for g in groups):
            continue
        if effect == "zero":
            return 0
        score = {"floor": max(score, n), "cap": min(score, n), "plus": score + n * (score > 0)}[effect]
    return score


def builder_score(field: str, column: str) -> int:
    """How well a column of a prepared table fits a schema field."""
    return _score(field, column, normalize, BUILDER_ALIASES, BUILDER_RULES, BUILDER_NEVER, BUILDER_EXACT, lambda own, wanted: wanted in own)


def extractor_score(field: str, header: str) -> int:
    """How well a header of a page's table fits a field of a typed row."""
    return _score(field, header, letters, EXTRACTOR_ALIASES, EXTRACTOR_RULES, EXTRACTOR_NEVER, EXTRACTOR_EXACT, lambda own, wanted: own.startswith(wanted) or wanted.startswith(own))


def match_column(columns: list[str], field: str, coverage: dict[str, float]) -> str | None:
    """The column with the best score of LEAST or more, the better filled one among equals, then the first."""
    scored = [(builder_score(field, c), coverage.get(c, 0.0), -i, c) for i, c in enumerate(columns) if c not in ("entity_name", "source")]
    best = max(scored, default=(0, 0.0, 0, ""))
    return best[3] if best[0] >= LEAST else None


def map_headers(headers: list[str], fields: list[str]) -> dict[str, str]:
    """field → header: headers with a field of their own first, then the best score of LEAST or more; a header may serve several fields."""
    out: dict[str, str] = {}
    for h in headers:
        own = letters(h)
        for labels, targets in HEADERS:
            goal = next((t for t in targets if t in fields), None)
            if own in labels and goal:
                out[goal] = h
        if own in NAME_HEADERS and (goal := next((t for t in NAME_FIELDS if t in fields), None)):
            out.setdefault(goal, h)
    for f in fields:
        best = max(headers, key=lambda h: extractor_score(f, h), default=None)
        if f not in out and best is not None and extractor_score(f, best) >= LEAST:
            out[f] = best
    return out


def quality_column(columns: list[str], fields: list[str], coverage: dict[str, float] | None = None) -> str | None:
    """The column that quality rules mean by a field: by name, then (with coverage, for the builder) by score, then by part of the name."""
    wanted = [f for f in fields if f]
    for f in wanted:
        if f in columns:
            return f
    if coverage is not None:
        matched = (match_column(columns, f, coverage) for f in wanted)
        if found := next((m for m in matched if m), None):
            return found
    for f in wanted:
        goal = normalize(f)
        for fits in (lambda n, g=goal: n == g, lambda n, g=goal: g in n):
            if found := next((c for c in columns if fits(normalize(c))), None):
                return found
    return None


def target_field(fields: list[str], keywords: tuple[str, ...], roles: dict[str, str] | None = None) -> str | None:
    """The field whose role is target, else the first whose name holds a keyword."""
    by_role = (f for f in fields if (roles or {}).get(f) == "target")
    return next(by_role, next((f for f in fields if any(k in f.lower() for k in keywords)), None))


def entity_column(columns: list[str], intent: str, samples: dict[str, list[str]]) -> str | None:
    """The column that names the entities: a known name in the intent's order, else the best by name and first values."""
    first = ENTITY_FIRST.get(intent, ())
    for c in (*first, *ENTITY_COLUMNS):
        if c in columns:
            return c
    best, most = None, -1
    for c in columns:
        parts = [p for p in c.split("_") if p not in ("unnamed", "level") and not p.isdigit()]
        if not any(parts):
            continue
        score = next((n for words, n in ENTITY_POINTS if set(words) & set(parts)), 0)
        score += ENTITY_AGAINST_POINTS * bool(set(parts) & set(ENTITY_AGAINST))
        values = [v.strip() for v in samples.get(c, [])[:20] if v.strip()]
        enough = max(1, 0.7 * len(values))
        if values:
            score += NUMBERS_POINTS * (sum(bool(re.fullmatch(r"[\d,.]+", v)) for v in values) >= enough)
            score += LETTERS_POINTS * (sum(bool(re.search("[A-Za-z]", v)) for v in values) >= enough)
        if score > most:
            best, most = c, score
    return best


def entity_like(values: list[str]) -> bool:
    """Whether the first values (not missing) look like names: half of them have letters, and fewer are plain numbers."""
    some = [v.strip() for v in values[:SAMPLE]]
    named = sum(bool(re.search("[A-Za-z]", v)) for v in some)
    return bool(some) and named >= max(1, len(some) // 2) and sum(bool(re.fullmatch(r"[-+]?\d+(\.\d+)?", v)) for v in some) < named


def head_samples(df: DataFrame, columns: list[str], pos: str, n: int = SAMPLE) -> dict[str, list[str]]:
    """The first n values of each column, by position, that aren't missing, as text.

    One scan for all columns: each batch keeps n values of each column, so does each task of those, and what is left
    (n values a column and task) is merged in as many places as there are columns.
    """
    if not columns:
        return {}
    values = [F.when(~missing(F.col(c), "coalesce", is_text(df, c)), F.struct(F.col(pos).alias("p"), F.col(c).cast("string").alias("v"))) for c in columns]
    rows = _heads(df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]), n)
    out: dict[str, list[str]] = {c: [] for c in columns}
    first = rows.groupBy("c").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "v"))), 1, n).alias("x"))  # n values a task
    for r in first.collect():
        out[columns[r["c"]]] = [x["v"] for x in r["x"]]
    return out


def _heads(values: DataFrame, n: int) -> DataFrame:
    """(c, p, v): of each column of structs (p, v) the n rows with the lowest p of each task; c is the column's number."""
    ship(values.sparkSession)
    place = values.schema[0].dataType["p"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for c in range(batch.num_columns):
                some = batch.column(c).drop_null()
                if not len(some):
                    continue
                here = pa.table({"p": some.field("p"), "v": some.field("v")})
                both = pa.concat_tables([best[c], here]) if c in best else here
                best[c] = both.take(pc.select_k_unstable(both, min(n, len(both)), [("p", "ascending")])).combine_chunks()
        for c, rows in best.items():
            yield from rows.append_column("c", pa.array([c] * len(rows), pa.int32())).select(["c", "p", "v"]).to_batches()

    return values.mapInArrow(run, StructType().add("c", IntegerType()).add("p", place).add("v", StringType()))


def coverage(df: DataFrame) -> dict[str, float]:
    """Share of each column that isn't null; one job."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"c{i}"] / row["n"] if row["n"] else 0.0 for i, c in enumerate(df.columns)}


def alias_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with a copy of the best matching column for each schema field that it lacks."""
    filled = coverage(df)
    for f in fields:
        found = match_column(df.columns, f, filled) if f not in df.columns else None
        if found:
            df = df.withColumn(f, F.col(found))
            filled[f] = filled[found]
    return df


def repair_entities(df: DataFrame, fields: list[str], pos: str) -> DataFrame:
    """Schema fields for an entity's name that don't hold names get the column `name`, if that does."""
    own = [f for f in fields if f in ENTITY_FIELDS and f in df.columns]
    if "name" not in df.columns or not own:
        return df
    texts = [c for c in dict.fromkeys(["name", *own]) if is_text(df, c)]
    samples = head_samples(df, texts, pos)
    looks = {c: c in texts and entity_like(samples[c]) for c in ("name", *own)}
    return df.withColumns({f: F.col("name") for f in own if not looks[f]}) if looks["name"] else df


def low_signal_name(column: str) -> bool:
    """Whether a column's name says nothing: digits, unnamed, ranks."""
    name = column.strip().lower()
    return name.isdigit() or name in (*LOW_SIGNAL, *RANKS) or "unnamed" in name.split("_") and not re.search(r"unnamed_[^_]*[^_\d]", name) or name.endswith("_rk") or "_rank" in name or name.startswith("unnamed")


def low_signal_columns(df: DataFrame, pos: str) -> list[str]:
    """Columns whose names say nothing, and numbers that only count 1, 2, 3 on (five of the first SAMPLE at least)."""
    named = [c for c in df.columns if c != pos and low_signal_name(c)]
    numbers = [c for c in numeric_columns(df) if c != pos and c not in named]
    samples = head_samples(df, numbers, pos)
    counting = [c for c in numbers if len(samples[c]) >= 5 and [float(v) for v in samples[c]] == list(range(1, len(samples[c]) + 1))]
    return [c for c in df.columns if c in named or c in counting]


def final_score(column: str, filled: float, numeric: bool, distinct: int) -> tuple:
    """What decides which columns stay in a final table, the best last: a target's word, coverage, numbers, variety, name."""
    return (any(w in column.lower() for w in FINAL_TARGETS), filled, numeric, distinct, column)


def trim(columns: list[str], protected: list[str], scores: dict[str, tuple], most: int) -> list[str]:
    """At most so many columns, in their order: protected ones first (also if the table lacks them), then by score."""
    if len(columns) <= most:
        return columns
    rest = sorted((c for c in columns if c not in protected), key=lambda c: scores[c], reverse=True)
    keep = set([*dict.fromkeys(protected), *rest][:most])
    return [c for c in columns if c in keep]


@dataclass
class Frame:
    """What is known of a table when it is chosen: names, source, rows, coverage and the first raw names of entities."""

    columns: list[str]
    source: str
    entity: str
    rows: int
    numbers: int
    coverage: dict[str, float]
    names: list[str]


def frame_of(df: DataFrame, source: str, entity: str, pos: str) -> Frame:
    names = head_samples(df, ["raw_entity_name"], pos, 10)["raw_entity_name"] if "raw_entity_name" in df.columns else []
    return Frame(df.columns, source, entity, df.count(), len([c for c in numeric_columns(df) if c not in IDENTITY]), coverage(df), names)


def alignment(frame: Frame, goal: str, intent: str) -> int:
    """How well a table's entity and source suit a goal; names that are years speak against it."""
    asked, source = words_of(goal), frame.source.lower()
    score = 0
    for intents, words, entities, parts, points in ALIGNMENT:
        meant = intent in intents or asked.intersection(words)
        if meant and (not entities or frame.entity.lower() in entities) and (not parts or any(p in source for p in parts)):
            score += points
    names = [n.strip().lower() for n in frame.names if n.strip()]
    years = sum(bool(re.fullmatch(r"(19|20|21)\d{2}(?:[–-]\d{2,4})?", n)) for n in names)
    return score + YEARS_AS_NAMES * (bool(names) and years >= max(1, len(names) // 2))


def row_count_score(rows: int, count: int | None, exact: bool) -> float:
    """Distance from the implied number of rows, as a share of it if that is approximate; 0 without one."""
    if not count or count <= 0:
        return 0.0
    return -float(abs(rows - count)) if exact else -abs(rows - count) / count


def target_signal(frame: Frame, goal: str) -> bool:
    """Whether a table's columns or its source speak of the goal's target."""
    markers = words_of(goal).intersection(TARGET_MARKERS)
    named = lambda *parts: any(p in c.lower() for c in frame.columns for p in parts)
    by_name = ("salary" in markers and named("salary")) or ("valuation" in markers and named("valuation")) or (markers.intersection({"transfer", "spend"}) and named("fee", "spend", "transfer"))
    return bool(by_name) or any(m in frame.source.lower() for m in markers)


def best_frame(frames: list[Frame], goal: str, intent: str, target: str | None, count: int | None, exact: bool) -> int | None:
    """Place of the table to start from: it has the target, then its length, alignment, numbers, columns and rows; the first among equals."""

    def rank(f: Frame) -> tuple:
        found = quality_column(f.columns, [target], f.coverage) if target else None
        return ((1, f.coverage[found]) if found else (0, 0.0), row_count_score(f.rows, count, exact), alignment(f, goal, intent), f.numbers, len(f.columns), f.rows)

    return max(range(len(frames)), key=lambda i: (rank(frames[i]), -i), default=None)


def goal_subset(frames: list[Frame], goal: str) -> list[int]:
    """Places of the tables that a goal is about: for Fortune lists those of such a source, if there are any; else all."""
    meant = [i for i, f in enumerate(frames) if any(p in f.source.lower() for p in FORTUNE)]
    return meant if "fortune" in words_of(goal) and meant else list(range(len(frames)))
