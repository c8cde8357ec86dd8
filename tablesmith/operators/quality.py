"""Missing values, pruning, outliers, bounds, conflicts between sources, and the validator's report.

Whatever depends on data over all columns comes from one aggregation; the driver decides, and a lazy plan follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.text import missing, root_domain, strip, to_float
from tablesmith.operators.stats import exact_quantiles
from tablesmith.operators.tables import is_text
from tablesmith.session import materialise

#: Columns that identify a row and are no features.
IDENTITY_FIELDS = ("source_url", "reference_url", "entity_name", "raw_entity_name", "name", "team_name", "school", "state")
#: Words in a column's name that bound its values.
NON_NEGATIVE = (
    "age", "asset", "attendance", "block", "count", "display", "fee", "funding", "gdp", "height", "income", "loss", "market_cap",
    "payroll", "points", "population", "price", "profit", "ram", "rank", "rating", "rebound", "revenue", "salary", "score", "size",
    "steal", "turnover", "valuation", "weight", "win",
)
PERCENT, RATE, GROWTH = ("pct", "percent", "percentage", "share"), ("rate",), ("growth", "change", "delta")
LOW_SUFFIXES, HIGH_SUFFIXES = ("_min", "_minimum", "_low"), ("_max", "_maximum", "_high")

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def absent(df: DataFrame, c: str) -> Column:
    """Missing in the pruner's sense; NaN counts as null."""
    if dict(df.dtypes)[c] in ("float", "double"):
        return F.col(c).isNull() | F.isnan(c)
    return missing(F.col(c), "pruner", is_text(df, c))


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, missing_rate: one pass; a column of an empty table counts as all missing."""
    columns = columns or df.columns
    rates = df.agg(*[F.coalesce(F.avg(absent(df, c).cast("int")), F.lit(1.0)).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "missing_rate")


def _shown(df: DataFrame, c: str) -> Column:
    """A column's value where it isn't missing, texts trimmed and without case."""
    return F.when(~absent(df, c), F.lower(strip(F.col(c))) if is_text(df, c) else F.col(c))


#: Distinct values of a column, as sketched, up to which each task holds them in a set.
FEW = 1024


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """name, rows, non_null, distinct for columns of df: exact, and no row is copied for each column.

    A first pass sketches how many distinct values there are. Columns of few are counted together in one pass, by sets
    that tasks merge; each of the others by itself, in a scan of that column alone whose tasks drop repeats first.
    """
    plain = {c: (v + F.lit(0.0)).cast("string") if t in ("float", "double") else v for (c, v), (_, t) in zip(values.items(), df.select(*[v.alias(f"c{i}") for i, v in enumerate(values.values())]).dtypes, strict=True)}  # one zero, one NaN
    sketch = df.agg(*[F.approx_count_distinct(v).alias(f"a{i}") for i, v in enumerate(plain.values())]).first() if plain else ()
    many = {c for c, n in zip(plain, sketch, strict=True) if n > FEW}
    aggs = [x for i, (c, v) in enumerate(plain.items()) for x in (F.count(v).alias(f"n{i}"), (F.lit(None) if c in many else F.size(F.collect_set(v))).cast("long").alias(f"d{i}"))]
    each = [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(plain)]
    out = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select("rows", F.explode(F.array(*each)).alias("x")).select("x.name", "rows", "x.non_null", "x.distinct")
    if not many:
        return out
    alone = [df.select(plain[c].alias("v")).distinct().agg(F.count("v").alias("more")).select(F.lit(c).alias("name"), "more") for c in plain if c in many]
    more = reduce(lambda a, b: a.unionByName(b), alone)
    return out.join(F.broadcast(more), "name", "left").select("name", "rows", "non_null", F.coalesce("more", "distinct").alias("distinct"))  # a row a column


def column_stats(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[int, int, float]]:
    """(non-missing, distinct, missing rate) of each column, texts compared trimmed and without case."""
    columns = columns or df.columns
    found = {r["name"]: r for r in distinct_counts(df, {c: _shown(df, c) for c in columns}).collect()}
    return {c: (r["non_null"], r["distinct"], 1 - r["non_null"] / r["rows"] if r["rows"] else 1.0) for c in columns for r in [found[c]]}


def fill_stats(df: DataFrame, also: Column | None = None, columns: list[str] | None = None) -> tuple[int, int, dict[str, tuple[int, bool]]]:
    """Rows, those of them that `also` holds for, and of each column among these: values that aren't missing, and whether it is constant.

    Least and greatest value tell whether a column is constant, so a row is aggregated once whatever the number of columns.
    """
    columns = columns or df.columns
    keep = F.lit(True) if also is None else F.coalesce(also, F.lit(False))
    own = lambda c: F.when(keep, _shown(df, c))
    aggs = [x for i, c in enumerate(columns) for x in (F.count(own(c)).alias(f"n{i}"), F.min(own(c)).eqNullSafe(F.max(own(c))).alias(f"c{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("all"), F.count_if(keep).alias("kept"), *aggs).first()
    return row["all"], row["kept"], {c: (row[f"n{i}"], row[f"c{i}"]) for i, c in enumerate(columns)}


def low_value_columns(df: DataFrame, minimum_rows: int, protected: tuple[str, ...] = ()) -> list[str]:
    """Columns with fewer values than half of minimum_rows, or no more than one distinct value (null tokens of texts count as values)."""
    aggs = [x for i, c in enumerate(df.columns) for x in (F.count(c).alias(f"n{i}"), F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}"))]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if c not in protected and (row[f"n{i}"] < minimum_rows // 2 or row[f"c{i}"])]


@dataclass
class Pruned:
    """A pruned table and what was dropped."""

    df: DataFrame
    rows: tuple[int, int]
    sparse: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)


def dense(df: DataFrame, target: str | None, features: list[str], most: float = 0.5) -> Column:
    """Whether a row has the target and lacks no more than a share of the features."""
    lacking = sum((absent(df, c).cast("int") for c in features), F.lit(0))
    has = ~absent(df, target) if target else F.lit(True)
    return has & (lacking / len(features) <= most) if features else has


def sparse_rows(df: DataFrame, target: str | None, features: list[str], most: float = 0.5) -> DataFrame:
    """Rows that have the target and lack no more than a share of the features."""
    return df.filter(dense(df, target, features, most))


def prune(df: DataFrame, target: str | None, protected: tuple[str, ...] = (), rows: float = 0.5, columns: float = 0.4) -> Pruned:
    """Rows without target, rows with too many missing features, then sparse columns and constant ones, in this order.

    Rows of more than `rows` missing features go, columns with more than `columns` missing values too. Protected
    columns and identity columns stay. One aggregation decides.
    """
    keep = {*protected, *IDENTITY_FIELDS, *([target] if target else [])}
    features = [c for c in df.columns if c not in IDENTITY_FIELDS and c != target]
    stays = dense(df, target, features, rows)
    before, after, stats = fill_stats(df, stays)
    sparse = [c for c in df.columns if c not in keep and (1 - stats[c][0] / after if after else 1.0) > columns]
    constant = [c for c in df.columns if c not in keep and c not in sparse and stats[c][1]]
    return Pruned(df.filter(stays).drop(*sparse, *constant), (before, after), sparse, constant)


def fill_rates(df: DataFrame, target: str, core: list[str], target_most: float = 0.1, core_most: float = 0.4) -> DataFrame:
    """column, missing_rate, accepted: whether target and core features are filled well enough."""
    rates = missing_rates(df, [target, *core])
    return rates.withColumn("accepted", F.col("missing_rate") <= F.when(F.col("column") == target, target_most).otherwise(core_most))


def core_features(df: DataFrame, target: str, most: int = 4) -> list[str]:
    """The features with the best coverage, numbers before texts, then by distinct values and name."""
    stats, numbers = column_stats(df), set(numeric_columns(df))
    names = [c for c in df.columns if c not in IDENTITY_FIELDS and c != target]
    return sorted(names, key=lambda c: (stats[c][2], c not in numbers, -stats[c][1], c))[:most]


def robust_stats(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """For each column n, median, q1, q3 and mad (median distance from the median), all exact."""
    own = exact_quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    far = exact_quantiles(df, {c: F.abs(F.col(c).cast("double") - F.lit(own[c][1][1])) for c in columns}, (0.5,))
    return {c: {"column": c, "n": own[c][0], "median": own[c][1][1], "q1": own[c][1][0], "q3": own[c][1][2], "mad": far[c][1][0]} for c in columns}


def outlier_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, median, q1, q3 and mad."""
    return df.sparkSession.createDataFrame(list(robust_stats(df, columns).values()), "column string, n long, median double, q1 double, q3 double, mad double")


def outlier_flags(df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """For each column that has enough values: whether a row is an outlier in it, and its robust score (null with no spread).

    A value is one if 0.6745 times its distance from the median is over 8 median distances, or if it lies five
    quartile ranges outside the quartiles. Tables under 12 rows and columns under 8 values have none.
    """
    if stats is None:
        stats = robust_stats(df, columns)
    flags, scores = {}, {}
    for c in columns:
        s = stats[c]
        if s["n"] < 8:
            continue
        x = F.col(c).cast("double")
        score = F.abs(F.lit(0.6745) * (x - s["median"]) / s["mad"]) if s["mad"] else F.lit(None).cast("double")
        iqr = s["q3"] - s["q1"]
        outside = ((x < s["q1"] - 5 * iqr) | (x > s["q3"] + 5 * iqr)) if iqr else F.lit(False)
        flags[c], scores[c] = F.coalesce(score > 8, F.lit(False)) | F.coalesce(outside, F.lit(False)), score
    return flags, scores


def drop_outliers(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Rows without two flagged columns, and whose target isn't beyond 12; with a column `outliers`, the number flagged."""
    if df.limit(12).count() < 12:
        return df.withColumn("outliers", F.lit(0))
    flags, scores = outlier_flags(df, columns)
    number = sum((f.cast("int") for f in flags.values()), F.lit(0))
    out = df.withColumn("outliers", number).filter("outliers < 2")
    return out.filter(F.coalesce(scores[target] <= 12, F.lit(True))) if target in scores else out


def bounds(name: str) -> tuple[float | None, float | None] | None:
    """(lowest, highest) value that a column's name allows.

    Years have limits of their own. Otherwise words that can't be negative give a lower limit of 0, and percentages
    and rates their limits besides: the stricter ones count. A rate of growth has none.
    """
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    has = lambda xs: any(x in words for x in xs)
    if "year" in words:
        return 1800.0, 2100.0
    low, high = (0.0 if has(NON_NEGATIVE) else None), None
    if has(PERCENT) or (has(RATE) and not has(GROWTH)):
        least, high = (-100.0, 500.0) if has(GROWTH) else (0.0, 100.0)
        low = least if low is None else max(low, least)
    return None if low is None and high is None else (low, high)


def bound_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Columns that hold the low and high end of one range."""
    out = []
    for low in names:
        for a, b in zip(LOW_SUFFIXES, HIGH_SUFFIXES, strict=True):
            if low.endswith(a) and low.removesuffix(a) + b in names:
                out.append((low, low.removesuffix(a) + b))
    return out


def issues(df: DataFrame, row: str, entity: str | None = None, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """severity, category, field, row_index, entity, message: values out of bounds or enums, and ranges upside down."""
    found = []
    issue = lambda bad, category, field, text: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit("error").alias("severity"), F.lit(category).alias("category"), F.lit(field).alias("field"), text.alias("message")))
    for c in numeric_columns(df):
        limits = bounds(c) if c != row else None
        if limits:
            low, high = limits
            bad = (F.col(c) < low if low is not None else F.lit(False)) | (F.col(c) > high if high is not None else F.lit(False))
            found.append(issue(bad, "bounds", c, F.concat(F.lit(f"{c} is out of bounds: "), F.col(c).cast("string"))))
    for low, high in bound_pairs(df.columns):
        found.append(issue(to_float(F.col(low).cast("string")) > to_float(F.col(high).cast("string")), "range", low, F.lit(f"{low} is above {high}")))
    for c, allowed in (enums or {}).items():
        found.append(issue(~missing(F.col(c), "validator") & ~strip(F.col(c)).isin(*allowed), "enum", c, F.concat(F.lit(f"{c} is not allowed: "), F.col(c))))
    if not found:
        found = [issue(F.lit(False), "", "", F.lit(""))]
    e = F.explode(F.array_compact(F.array(*found))).alias("issue")
    name = (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity")
    return df.select(F.col(row).alias("row_index"), name, e).select("issue.severity", "issue.category", "issue.field", "row_index", "entity", "issue.message")


def numeric_conflicts(df: DataFrame, key: str, value: str, domain: str, most: float = 0.35) -> DataFrame:
    """Per key that two sources or more report: domains, lowest, middle and highest value, spread, conflict.

    The middle is the upper of the two middle values. Its aggregate keeps distinct values with their counts and merges
    them map-side, so a key with many equal reports stays small.
    """
    known = df.filter(F.col(value).isNotNull())
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    out = known.groupBy(key).agg(F.count_distinct(domain).alias("domains"), F.min(value).alias("low"), F.max(value).alias("high"), middle.alias("middle"))
    out = out.filter("domains >= 2").withColumn("spread", (F.col("high") - F.col("low")) / F.greatest(F.abs("middle"), F.lit(1.0)))
    return out.withColumn("conflict", F.col("spread") > most)


def text_conflicts(df: DataFrame, key: str, value: str, domain: str) -> DataFrame:
    """Per key that two sources or more report: domains, distinct values without case and outer space, conflict."""
    known = df.filter(~missing(F.col(value), "validator"))
    shown = F.lower(strip(F.regexp_replace(F.col(value), r"\s+", " ")))
    out = known.groupBy(key).agg(F.count_distinct(domain).alias("domains"), F.count_distinct(shown).alias("versions")).filter("domains >= 2")
    return out.withColumn("conflict", F.col("versions") > 1)


def source_facts(df: DataFrame, key: str, url: str, numbers: dict[str, float], texts: list[str]) -> DataFrame:
    """Per key, what its sources say of each field: c0, c1, ... whether they conflict, null where the middle value has to tell.

    One aggregation of all fields. Two sources differ if the least and the greatest domain do, so do two versions of a
    text; a spread conflicts if it does against the value farthest from zero, and doesn't if it doesn't against the
    nearest one. No value is kept but these, however many reports a key has. numbers: fields and the spread they may have.
    """
    rows = df.withColumn("__domain", root_domain(F.col(url)))
    aggs, told = [], []
    for i, (c, most) in enumerate(numbers.items()):
        v = F.col(c)
        one = F.when(v.isNotNull(), F.col("__domain"))
        aggs += [F.min(one).alias(f"a{i}"), F.max(one).alias(f"b{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.min(F.abs(v)).alias(f"near{i}"), F.max(F.abs(v)).alias(f"far{i}")]
        against = lambda x, i=i, most=most: _apart(F.col(f"low{i}"), F.col(f"high{i}"), F.col(x), most)
        apart = F.coalesce(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(False))
        told.append(F.when(~apart, False).when(against(f"far{i}"), True).when(~against(f"near{i}"), False).alias(f"c{i}"))
    for i, c in enumerate(texts, len(numbers)):
        there = ~missing(F.col(c), "validator")
        shown = F.when(there, F.lower(strip(F.regexp_replace(F.col(c), r"\s+", " "))))
        one = F.when(there, F.col("__domain"))
        aggs += [F.min(one).alias(f"a{i}"), F.max(one).alias(f"b{i}"), F.min(shown).alias(f"low{i}"), F.max(shown).alias(f"high{i}")]
        told.append(F.coalesce((F.col(f"a{i}") != F.col(f"b{i}")) & (F.col(f"low{i}") != F.col(f"high{i}")), F.lit(False)).alias(f"c{i}"))
    facts = rows.groupBy(F.col(key).alias("__key")).agg(*aggs)
    return facts.select("__key", *[f"{x}{i}" for i in range(len(numbers)) for x in ("low", "high")], *told)


def _apart(low: Column, high: Column, value: Column, most: float) -> Column:
    """Whether a spread is too wide against a value; if it is, it is too against every value that is nearer to zero."""
    return (high - low) / F.greatest(F.abs(value), F.lit(1.0)) > most


def _settled(df: DataFrame, facts: DataFrame, key: str, numbers: dict[str, float]) -> DataFrame:
    """The keys of facts whose c0, c1, ... are open, with those told by the middle value (the upper of two).

    It is too near to zero if, of the key's values in order, those below all such end before the middle and they
    themselves don't: a matter of counts, which tasks add up before the shuffle.
    """
    open_ = facts.filter(F.exists(F.array(*[F.col(f"c{i}") for i in range(len(numbers))]), lambda x: x.isNull()))
    aggs, told = [], []
    for i, (c, most) in enumerate(numbers.items()):
        v = F.col(c)
        hit = v.isNotNull() & _apart(F.col(f"low{i}"), F.col(f"high{i}"), v, most)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(hit).alias(f"hit{i}"), F.count_if((v < 0) & ~hit).alias(f"below{i}")]
        at = F.floor(F.col(f"n{i}") / 2)
        told.append(F.coalesce(F.col(f"c{i}"), (F.col(f"below{i}") <= at) & (at < F.col(f"below{i}") + F.col(f"hit{i}"))).alias(f"c{i}"))
    counts = df.join(open_.select("__key", *[f"{x}{i}" for i in range(len(numbers)) for x in ("low", "high")]), df[key] == F.col("__key")).groupBy("__key").agg(*aggs)
    return open_.join(counts, "__key").select("__key", *told, *[c for c in facts.columns if c.startswith("c") and int(c[1:]) >= len(numbers)])


def conflicting_entities(df: DataFrame, key: str, url: str, numbers: list[str], texts: list[str], target: str | None) -> DataFrame:
    """Keys to reject: sources differ on the target, or on two fields at least: key, fields, on_target. Percentages may differ by less (0.20).

    All fields are settled by one aggregation; only keys for which the middle of a field's values decides are
    looked at once more. A null key is a key whose fields are settled as far as that goes without.
    """
    limits = {c: 0.2 if any(w in PERCENT for w in c.lower().split("_")) else 0.35 for c in numbers}
    facts = materialise(source_facts(df, key, url, limits, texts), "source-facts")
    names = [*numbers, *texts]
    flags = [f"c{i}" for i in range(len(names))]
    unsure = F.exists(F.array(*[F.col(c) for c in flags]), lambda x: x.isNull())
    found = facts.select("__key", *flags)
    if not facts.filter(unsure).isEmpty():
        found = facts.filter(~unsure).select("__key", *flags).unionByName(_settled(df, facts, key, limits).select("__key", *flags))
    fields = sum((F.col(c).cast("long") for c in flags), F.lit(0).cast("long"))
    on_target = F.col(flags[names.index(target)]) if target in names else F.lit(False)
    return found.select(F.col("__key").alias(key), fields.alias("fields"), on_target.alias("on_target")).filter("on_target or fields >= 2")


def summary(found: DataFrame, rows: int, kept: int) -> DataFrame:
    """One row: rows before and after, issues by severity, and whether the table may pass.

    It may not if no row is left, or if ten rows or more came in and over 35 per cent went.
    """
    out = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    passed = kept > 0 and not (rows >= 10 and (rows - kept) / rows > 0.35)
    return out.select(F.lit(rows).alias("input_rows"), F.lit(kept).alias("kept_rows"), "errors", "warnings", F.lit(passed).alias("passed"))


def numeric_share(df: DataFrame, columns: list[str], parsed: dict[str, Column]) -> DataFrame:
    """column, share (of its values that parse as numbers), numeric (share at least 0.7)."""
    share = df.agg(*[F.coalesce(F.count(parsed[c]) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0)).alias(c) for c in columns])
    return share.unpivot([], columns, "column", "share").withColumn("numeric", F.col("share") >= 0.7)
