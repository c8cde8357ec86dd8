"""Profiles, target inference, leakage, imputation and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.quality import distinct_counts, numeric_columns
from tablesmith.operators.stats import exact_quantiles
from tablesmith.operators.tables import is_text

#: Parts of names that speak against a target (as substrings, so `id` also fits `width`), and for one.
NO_TARGET = ("source", "url", "name", "entity_name", "id", "uuid")
PRIORITY = ("salary", "valuation", "price", "revenue", "income", "margin", "growth", "pct")
REGRESSION = ("pct", "ratio", "price", "revenue", "assets", "salary", "margin")
DROPPED = ("id", "uuid", "url", "source", "name", "entity_name")


def profile(df: DataFrame) -> DataFrame:
    """column, dtype, rows, non_null, null_fraction (4 places), distinct; null_fraction of an empty table is 0."""
    found = distinct_counts(df, {c: F.col(f"`{c}`") for c in df.columns})
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    share = F.when(F.col("rows") > 0, F.round(1 - F.col("non_null") / F.col("rows"), 4)).otherwise(0.0)
    return found.select(F.col("name").alias("column"), kinds[F.col("name")].alias("dtype"), "rows", "non_null", share.alias("null_fraction"), "distinct")


#: Points of a column's name as a target, in order: phrases of which the goal holds one (all groups; none: any
#: goal), words of the column (one of each group), and points. Of rules that share a letter only the first that fits counts.
TARGET_POINTS = (
    ((), (("target", "label", "outcome"),), 30, ""),
    ((("salary",),), (("salary",),), 40, ""),
    ((("valuation", "market value"),), (("valuation",),), 40, ""),
    ((("price", "pricing", "cost"),), (("price",),), 40, ""),
    ((("revenue growth",),), (("revenue",), ("growth",)), 40, "a"),
    ((("revenue",),), (("revenue",),), 35, "a"),
    ((("population",), ("growth", "change")), (("population",), ("growth",), ("rate",)), 50, "b"),
    ((("population",), ("growth", "change")), (("population",), ("change",)), 50, "b"),
    ((("population",), ("growth", "change")), (("gdp",), ("growth", "change")), -20, ""),
    ((("gdp",), ("growth", "change")), (("gdp",), ("growth", "change", "rate")), 35, ""),
    ((("win", "winning"),), (("winning", "wins", "pct"),), 25, ""),
    ((("points",),), (("points",),), 20, ""),
)
#: Points of parts of the name wherever they stand (the first list counts once), and of a number.
NO_TARGET_POINTS, PRIORITY_POINTS, NUMERIC_POINTS = -50, 10, 8


def name_score(goal: str, column: str, numeric: bool) -> int:
    """How well a column's name fits a goal as its target."""
    low, goal = column.lower(), goal.lower()
    words = set(low.replace("/", "_").split("_"))
    score = NO_TARGET_POINTS * any(x in low for x in NO_TARGET) + NUMERIC_POINTS * numeric + PRIORITY_POINTS * any(x in low for x in PRIORITY)
    met: set[str] = set()
    for asked, named, points, rank in TARGET_POINTS:
        if rank in met or not all(any(p in goal for p in group) for group in asked) or not all(words & set(group) for group in named):
            continue
        score += points
        met |= {rank} - {""}
    return score


def target_ranking(df: DataFrame, goal: str = "") -> DataFrame:
    """column, score, non_null, compactness, distinct, rank: candidates for the target, the first column first among equals."""
    numbers = set(numeric_columns(df)) | {c for c, t in df.dtypes if t == "boolean"}
    stats = profile(df)
    scores = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(name_score(goal, c, c in numbers)))])
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    words = {c: len({w for w in c.lower().replace("/", "_").split("_") if w}) for c in df.columns}
    compact = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(max(0, 12 - min(words[c], 12))))])
    out = stats.select("column", scores[F.col("column")].alias("score"), "non_null", compact[F.col("column")].alias("compactness"), "distinct", place[F.col("column")].alias("place"))
    order = F.array_sort(F.collect_list(F.struct(-F.col("score"), -F.col("non_null"), -F.col("compactness"), -F.col("distinct"), "place", "column")))
    ranked = out.agg(order.alias("o")).select(F.posexplode("o").alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.column")  # one row per column
    return out.drop("place").join(ranked, "column")


def infer_target(df: DataFrame, goal: str = "") -> str | None:
    """The best candidate; if no name speaks for one, the last numeric column."""
    if df.isEmpty():
        return None
    best = target_ranking(df, goal).filter("rank = 1").first()
    if best["score"] > 0:
        return best["column"]
    numbers = [c for c, t in df.dtypes if c in numeric_columns(df) or t == "boolean"]
    return numbers[-1] if numbers else None


def best_candidate(df: DataFrame, goal: str, candidates: list[str]) -> str | None:
    """The candidate that ranks highest as the target; the first among equals."""
    chosen = [c for c in dict.fromkeys(candidates) if c in df.columns]
    if len(chosen) < 2:
        return chosen[0] if chosen else None
    return target_ranking(df.select(*chosen), goal).filter("rank = 1").first()["column"]


def task_type(df: DataFrame, target: str | None) -> str:
    if target and any(w in target.lower() for w in REGRESSION):
        return "regression"
    if target and df.agg(F.count_distinct(target)).first()[0] <= 2:
        return "binary classification"
    return "regression"


def dropped_features(columns: list[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in DROPPED)]


def correlation(a: Column, b: Column) -> Column:
    """Pearson over the rows where both are known; null for a constant, a single row or none."""
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def leakage(df: DataFrame, target: str, least: float = 0.995) -> DataFrame:
    """column, correlation (with the target), leaks: for all other numeric columns, in one pass."""
    others = [c for c in numeric_columns(df) if c != target]
    wide = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in others])
    out = wide.unpivot([], others, "column", "correlation")
    return out.withColumn("leaks", F.coalesce(F.abs("correlation") >= least, F.lit(False)))


def impute(df: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Numbers get the column's exact median, null and empty texts `Unknown`; all medians come from the same passes."""
    numbers = numeric_columns(df)
    medians = {c: q[0] for c, (_, q) in exact_quantiles(df, {c: F.col(c) for c in numbers}, (0.5,)).items()} if numbers else {}
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")) for c in numbers}
    fill |= {c: F.when(F.col(c).isNull() | (F.col(c) == ""), unknown).otherwise(F.col(c)) for c in df.columns if is_text(df, c)}
    return df.withColumns(fill)


#: Most columns that one text column may become.
KINDS = 2000


def one_hot(df: DataFrame, *columns: str) -> DataFrame:
    """A boolean column for each value of the given text columns (none: of all), named column_value; null has none.

    A column of more than KINDS values is an error: it would be no table any more.
    """
    chosen = list(columns) or [c for c in df.columns if is_text(df, c)]
    made = []
    for c in chosen:
        values = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(KINDS + 1).collect()]
        if len(values) > KINDS:
            raise ValueError(f"{c} has more than {KINDS} values")
        made += [F.coalesce(F.col(c) == v, F.lit(False)).alias(f"{c}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c not in chosen], *made)
