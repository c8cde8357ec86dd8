"""From pages to a finished table: extract, prepare, merge wide, finalize, prune, check, validate, profile, impute."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.text import numeric_like, strip
from tablesmith.operators import columns, matching, profiling, quality, records, resolve, tables
from tablesmith.plans.blueprint import Blueprint
from tablesmith.plans.intent import read_goal, row_count_fits
from tablesmith.session import materialise
from tablesmith.sources import html

#: Tables as rich in numbers as this push out those that are poorer, unless they suit the goal as well as that.
RICH, SUITS = 3, 8
#: A final column has values in this share of the rows, or in this many.
FILLED, FILLED_ROWS = 0.10, 25
KEYS = ("entity_name", "raw_entity_name", "source_url")


class QualityError(ValueError):
    """A table that isn't good enough."""


@dataclass
class Result:
    """The table, where its columns come from, and reports."""

    table: DataFrame
    provenance: dict[str, str]
    target: str | None
    reports: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Prepared:
    """A table keyed by entity_name, what is known of it, and where its columns come from."""

    df: DataFrame
    frame: matching.Frame
    provenance: dict[str, str]


def numeric_columns(df: DataFrame, texts: list[str], minimum_rows: int = 20) -> DataFrame:
    """Text columns of which 70 per cent of all rows are numbers (half of minimum_rows at least) become numbers; one pass decides for all."""
    if not texts:
        return df
    share = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(numeric_like(F.col(c))).alias(f"k{i}") for i, c in enumerate(texts)]).first()
    least = max(0.7 * share["n"], minimum_rows // 2)
    return df.withColumns({c: numeric_like(F.col(c)) for i, c in enumerate(texts) if share[f"k{i}"] >= least})


def prepare(frame: DataFrame, url: str, goal: str, fields: list[str], minimum_rows: int = 20) -> Prepared | None:
    """A page's table keyed by entity: one row for each, metric columns named after their page, numbers where most values are.

    None if nothing names an entity, or if fewer than minimum_rows entities are left without aggregates.
    """
    own = [c for c in frame.columns if not c.startswith("_")]
    renamed = columns.prefixed_by_number(own, url) if "ncaa.com/stats" in url else columns.prefixed(own, columns.metric_of(url))
    frame = frame.withColumnsRenamed(renamed)
    own = [renamed.get(c, c) for c in own]
    intent = read_goal(goal).entity
    known = any(c in own for c in (*matching.ENTITY_FIRST.get(intent, ()), *matching.ENTITY_COLUMNS))
    entity = matching.entity_column(own, intent, {} if known else matching.head_samples(frame, own, "_pos", 20))
    if entity is None:
        return None
    rows = frame.withColumn(entity, strip(F.col(entity))).filter(F.col(entity).isNotNull() & ~F.col(entity).isin("", entity))
    rows = records.without_aggregates(rows, entity) if "state" in fields else rows
    rows = resolve.resolve_fuzzy(rows, entity, "_pos").withColumnRenamed("_source_url", "source_url")
    if entity not in ("entity_name", "raw_entity_name"):
        rows = rows.withColumnRenamed(entity, "raw_entity_name")
    rows = tables.coalesce_groups(rows.filter("entity_name <> ''").drop(*(c for c in matching.RANKS if c not in fields)), "entity_name", "_pos")
    rows = numeric_columns(materialise(rows, "build-rows"), [c for c, t in rows.dtypes if t == "string" and c not in KEYS], minimum_rows)
    poor = quality.low_value_columns(rows, minimum_rows, (*KEYS, "_pos", *fields))
    rows = materialise(rows.drop(*poor), "build-frame")
    known_frame = matching.frame_of(rows, url, entity, "_pos")
    if known_frame.rows < minimum_rows:
        return None
    return Prepared(rows, known_frame, {c: url for c in rows.columns if c not in ("entity_name", "raw_entity_name", "_pos")})


def joined_provenance(left: dict[str, str], right: dict[str, str], names: list[str]) -> dict[str, str]:
    """Where the columns of a merged table come from: both sources if they differ, `derived` if there is none."""
    both = lambda c: list(dict.fromkeys(s for s in (left.get(c), right.get(c)) if s))
    return {c: " | ".join(both(c)) or "derived" for c in names if c not in ("entity_name", "_pos")}


def merge_all(found: list[Prepared], first: int) -> tuple[DataFrame, dict[str, str]]:
    """One table with the others, in their order, merged on the left where keys overlap, or put below where they are more of the same."""
    out, provenance = found[first].df, dict(found[first].provenance)
    for i, other in enumerate(found):
        if i == first:
            continue
        if tables.key_coverage(out, other.df, "entity_name").first()["eligible"]:
            out = materialise(tables.coalescing_join(out, other.df.drop("_pos")), "build-merged")
        elif tables.row_compatible(out, other.df, "entity_name", (*KEYS, "name", "_pos")):
            after = out.agg(F.coalesce(F.max("_pos"), F.lit(0))).first()[0] + 1
            below = tables.union_by_name(out, other.df.withColumn("_pos", F.col("_pos") + after))
            out = materialise(tables.coalesce_groups(below, "entity_name", "_pos"), "build-merged")
        else:
            continue
        provenance = joined_provenance(provenance, other.provenance, out.columns)
    return out, provenance


def finalize(df: DataFrame, fields: list[str], goal: str = "", minimum_columns: int = 8) -> DataFrame:
    """Final labels, aliases for schema fields, repaired names, no repeated values, schema fields first, poor columns out, and
    no more columns than the table's length allows. Keeps `_pos`."""
    out = df.withColumnRenamed("raw_entity_name", "name")
    own = [c for c in out.columns if c != "_pos"]
    out = out.withColumnsRenamed(dict(zip(own, columns.final_labels(own), strict=True)))
    out = matching.repair_entities(matching.alias_columns(out, fields), fields, "_pos")
    protected = ["name", "entity_name", *fields]
    out = materialise(out.drop(*tables.duplicate_columns(out, "_pos", tuple(protected))), "build-final")
    rows = out.count()
    numbers = quality.numeric_columns(out)
    ordered = columns.column_order([c for c in out.columns if c != "_pos"], fields, numbers, goal)
    least = max(1, min(int(FILLED * rows), FILLED_ROWS))
    poor = matching.low_signal_columns(out.select("_pos", *[c for c in ordered if c not in protected]), "_pos")
    known = matching.coverage(out)
    kept = [c for c in ordered if c in protected or (known[c] * rows >= least and c not in poor)]
    most = columns.width(minimum_columns, rows)
    if len(kept) > most:
        kinds = {r["column"]: r["distinct"] for r in profiling.profile(out.select(*kept)).collect()}
        kept = matching.trim(kept, protected, {c: matching.final_score(c, known[c], c in numbers, kinds[c]) for c in kept}, most)
    return out.select("_pos", *kept)


def check_fill(df: DataFrame, target: str | None, core: list[str], required: list[str] = ()) -> None:
    """Raise QualityError if the target lacks over 10 per cent of its values, or a core feature over 40."""
    filled = matching.coverage(df)
    goal = matching.quality_column(df.columns, [target] if target else [], filled)
    named = lambda fields: list(dict.fromkeys(c for f in fields if (c := matching.quality_column(df.columns, [f], filled))))
    features = named(required) or named(core) or quality.core_features(df, goal or "")
    rates = {r["column"]: r["missing_rate"] for r in quality.missing_rates(df, list(dict.fromkeys([*([goal] if goal else []), *features]))).collect()} if goal or features else {}
    if goal and rates[goal] > 0.10:
        raise QualityError(f"the target {goal} is missing in {rates[goal]:.1%} of rows")
    low = sorted(c for c in features if c != goal and rates[c] > 0.40)
    if low:
        raise QualityError(f"too many values are missing: {', '.join(low)}")


def validate(df: DataFrame, entity: str | None, target: str | None, raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are valid, the issues, and a summary: bounds, ranges, outliers, and entities whose sources conflict.

    raw (entity, source_url and fields) has a row for each source of an entity. Raises QualityError if no row is left,
    or if over 35 per cent of ten rows or more go.
    """
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "build-numbered")
    found = quality.issues(rows, "_row", entity)
    left = rows.join(found.filter("severity = 'error'").select(F.col("row_index").alias("_row")).distinct(), "_row", "left_anti")
    numbers = [c for c in quality.numeric_columns(df) if c not in ("_pos",)]
    if numbers and rows.limit(12).count() == 12:
        flags, scores = quality.outlier_flags(rows, numbers)
        number = sum((f.cast("int") for f in flags.values()), F.lit(0))
        far = F.coalesce(scores[target] > 12, F.lit(False)) if target in scores else F.lit(False)
        bad = rows.filter((number >= 2) | far).select("_row")
        left = left.join(bad, "_row", "left_anti")
        name = (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity")
        warned = [rows.filter(f).select(F.lit("warning").alias("severity"), F.lit("outlier").alias("category"), F.lit(c).alias("field"), F.col("_row").alias("row_index"), name, F.lit(f"{c} is far from the others").alias("message")) for c, f in flags.items()]
        for w in warned:
            found = found.unionByName(w)
    if raw is not None and entity:
        texts = [c for c, t in raw.dtypes if t == "string" and c not in (entity, "source_url")]
        apart = quality.conflicting_entities(raw, entity, "source_url", quality.numeric_columns(raw), texts, target)
        key = lambda c: F.lower(strip(F.col(c)))
        left = left.join(apart.select(key(entity).alias("__entity")), key(entity) == F.col("__entity"), "left_anti")
    left = materialise(left.drop("_row"), "build-valid")
    total = quality.summary(found, rows.count(), left.count())
    if not total.first()["passed"]:
        raise QualityError("too many rows are invalid")
    return left, found, total


def build(
    pages: DataFrame, blueprint: Blueprint, goal: str = "", minimum_rows: int = 20, minimum_columns: int = 8, count: int | None = None, exact: bool = True,
    repair: Callable[[DataFrame], DataFrame] | None = None, raw: DataFrame | None = None,
) -> Result:
    """Table of pages (url, html) for a blueprint. `repair` is the seam for a model-backed step; without it nothing is asked of one.

    If the merged table isn't good enough, the best single one is tried. Raises QualityError if no table names
    entities, and if the result has too few rows or columns for the goal, too many missing values, or too many invalid
    rows. Pages are parsed once; their tables differ in their columns, so each is a plan of its own, however many rows
    it has.
    """
    fields = [f.name for f in blueprint.schema]
    rows = materialise(html.table_rows(pages), "build-pages")
    found = [(r["url"], r["table_idx"]) for r in rows.groupBy("url", "table_idx").count().orderBy("url", "table_idx").collect()]
    frames = [p for url, table_idx in found if (p := prepare(html.table_frame(rows, url, table_idx), url, goal, fields, minimum_rows))]
    frames = [frames[i] for i in matching.goal_subset([p.frame for p in frames], goal)]
    intent = read_goal(goal).entity
    if any(p.frame.numbers >= RICH for p in frames):
        frames = [p for p in frames if p.frame.numbers >= RICH or matching.target_signal(p.frame, goal) or matching.alignment(p.frame, goal, intent) >= SUITS]
    first = matching.best_frame([p.frame for p in frames], goal, intent, blueprint.target, count, exact)
    if first is None:
        raise QualityError("no table names entities")
    wide, provenance = merge_all(frames, first)
    error = None
    for df, source in ((repair(wide) if repair else wide, provenance), (frames[first].df, frames[first].provenance)):
        table = finalize(df, fields, goal, minimum_columns)
        target = matching.quality_column(table.columns, [blueprint.target] if blueprint.target else [], matching.coverage(table)) or profiling.infer_target(table.drop("_pos"), goal)
        pruned = quality.prune(table.drop("_pos"), target, protected=tuple(fields))
        kept = materialise(pruned.df, "build-pruned")
        try:
            check_fill(kept, target, [f for f in fields if f != blueprint.target])
            if not row_count_fits(pruned.rows[1], count, exact, minimum_rows) or len(kept.columns) < minimum_columns:
                raise QualityError(f"{pruned.rows[1]} rows and {len(kept.columns)} columns don't suit the goal")
        except QualityError as e:
            error = error or e
            continue
        entity = next((c for c in ("entity_name", "name") if c in kept.columns), None)
        valid, issues, summary = validate(kept, entity, target, raw)
        reports = {"issues": issues, "summary": summary, "profile": profiling.profile(valid)}
        if target in quality.numeric_columns(valid):
            reports["leakage"] = profiling.leakage(valid, target)
        done = profiling.impute(valid)
        named = dict(zip(columns.final_labels([("name" if c == "raw_entity_name" else c) for c in source]), source.values(), strict=True))
        return Result(done, {c: named.get(c, "derived") for c in done.columns}, target, reports)
    raise error


