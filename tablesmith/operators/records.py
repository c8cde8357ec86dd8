"""Records from several sources: filters, merging by preference, and how clean they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.text import any_of, coerce_number, extract_specs, missing, strip
from tablesmith.operators.tables import distinct_first, is_text

#: Fields that identify a record, in order of preference, and fields that carry no information.
IDENTITY_ORDER = ("name", "entity_name", "team_name", "school", "state", "organization_name", "company_name", "title")
NO_CONTENT = ("source_url", "reference_url", "entity_name", "raw_entity_name", "name", "state", "school", "team_name")
#: What pages say around their content.
CHROME = (
    "jump to content", "main menu", "search wikipedia", "create account", "log in", "donate", "help", "navigation", "button",
    "searchbox", "radio", "appearance", "page tools", "personal tools", "views", "site", "tools", "thumbnail for",
    "request that a redirect be created",
)


#: One phrase more, where single records are judged; and names of what sums others up, for the builder, for the
#: extractor, and parts of such names.
RECORD_CHROME = (*CHROME, "create a draft and submit it for review")
AGGREGATES = (
    "united states", "district of columbia", "puerto rico", "guam", "american samoa", "northern mariana islands", "u.s. virgin islands",
    "virgin islands", "50 states and district of columbia", "new england", "east north central", "west north central", "south atlantic",
    "east south central", "west south central", "mountain", "pacific", "northeast", "midwest", "south", "west",
)
BUILDER_AGGREGATES = (*AGGREGATES, "island areas", "island areas territories", "mid atlantic", "unknown")
EXTRACTOR_AGGREGATES = (*AGGREGATES, "island areas (territories)", "mid-atlantic")
AGGREGATE_WORDS = ("division", "region", "total")


def is_aggregate(c: Column, names: tuple[str, ...] = BUILDER_AGGREGATES) -> Column:
    """Whether a name stands for a sum of others."""
    low = F.lower(strip(c))
    return F.coalesce(low.isin(*names) | any_of(low, AGGREGATE_WORDS), F.lit(False))


def without_aggregates(df: DataFrame, column: str, names: tuple[str, ...] = BUILDER_AGGREGATES) -> DataFrame:
    """Rows whose name doesn't stand for a sum of others; null names stay."""
    return df.filter(~is_aggregate(F.col(column), names))


def usable(df: DataFrame) -> Column:
    """Whether a record has two filled fields and no text of a page's furniture."""
    texts = [c for c in df.columns if is_text(df, c)]
    chrome = F.exists(F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in texts]), lambda x: any_of(x, RECORD_CHROME)) if texts else F.lit(False)
    return (populated(df, ()) >= 2) & ~chrome


def looks_like_chrome(df: DataFrame) -> Column:
    """Whether any text column contains a phrase of a page's furniture; as substrings, so `help` also fits `helpful`."""
    texts = [c for c in df.columns if is_text(df, c)]
    return F.coalesce(F.exists(F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in texts]), lambda x: any_of(x, CHROME)), F.lit(False)) if texts else F.lit(False)


def chrome_gate(df: DataFrame, pos: str) -> DataFrame:
    """One row: of the first 20 records, how many look like page furniture, and whether that is too many."""
    first = df.orderBy(pos).limit(20)
    out = first.agg(F.count(F.lit(1)).alias("n"), F.count_if(looks_like_chrome(df.drop(pos))).alias("suspicious"))
    return out.withColumn("rejected", F.col("suspicious") >= F.greatest(F.lit(1), F.floor(F.least("n", F.lit(5)) / 2)))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have the target; all rows if none has it."""
    has = ~missing(F.col(target), "target", is_text(df, target))
    any_has = df.agg(F.coalesce(F.max(has), F.lit(False)).alias("__any"))
    return df.join(F.broadcast(any_has)).filter(has | ~F.col("__any")).drop("__any")  # one row


def identity_key(df: DataFrame) -> Column:
    """field:value of the first identity field that isn't blank, without case."""
    fields = [c for c in IDENTITY_ORDER if c in df.columns]
    return F.coalesce(*[F.when(strip(F.col(c)) != "", F.concat(F.lit(f"{c}:"), F.lower(strip(F.col(c))))) for c in fields], F.lit(None).cast("string"))


def prefer(df: DataFrame, column: str, pos: str) -> Column:
    """Value that a fold in order of position keeps: a missing one yields to any, a numeric zero to a later non-zero.

    In closed form: the first value that isn't missing; if that is zero, the first non-zero one, if there is any.
    """
    c = F.col(column)
    known = ~missing(c, "merge", is_text(df, column))
    first = F.min_by(F.when(known, c), F.when(known, F.col(pos)))
    if is_text(df, column):
        return first
    more = known & (c != 0)
    return F.coalesce(F.min_by(F.when(more, c), F.when(more, F.col(pos))), first)


def merge_records(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Exact repeats go, then each key's records become one, field by field by preference."""
    values = [c for c in df.columns if c not in (key, pos)]
    rows = distinct_first(df, [key, *values], pos)
    return rows.groupBy(key).agg(F.min(pos).alias(pos), *[prefer(df, c, pos).alias(c) for c in values])


def populated(df: DataFrame, ignored: tuple[str, ...] = NO_CONTENT) -> Column:
    """Number of informative fields that hold something."""
    names = [c for c in df.columns if c not in ignored]
    holds = [((F.col(c).isNotNull() & (strip(F.col(c)) != "")) if is_text(df, c) else F.col(c).isNotNull()).cast("int") for c in names]
    return sum(holds, F.lit(0))


def cleanliness(df: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """One row: records, average share of filled fields, share of repeated keys, and whether that is clean enough."""
    fields = len([c for c in df.columns if c not in ignored])
    out = df.agg(F.count(F.lit(1)).alias("records"), (F.avg(populated(df, ignored)) / fields).alias("filled"), F.count_distinct(key).alias("keys"), F.count(key).alias("keyed"))
    repeated = F.coalesce(F.try_divide(F.col("keyed") - F.col("keys"), F.col("keyed")), F.lit(0.0))
    return out.select("records", "filled", repeated.alias("repeated")).withColumn("clean", (F.col("filled") >= 0.6) & (F.col("repeated") <= 0.1))


def schema_coverage(df: DataFrame, wanted: int) -> DataFrame:
    """One row: records, average informative fields, and whether the goal is met (enough records, two fields each)."""
    out = df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.avg(populated(df)), F.lit(0.0)).alias("coverage"))
    return out.withColumn("satisfied", (F.col("records") >= wanted) & (F.col("coverage") >= 2.0))


def enrich(df: DataFrame, source_url: str, season_year: int | None = None) -> DataFrame:
    """Fill source_url and season_year where they are missing."""
    given = {"source_url": F.lit(source_url)} | ({"season_year": F.lit(season_year)} if season_year else {})
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in given.items()})


def derive_names(df: DataFrame) -> DataFrame:
    """team_name from nickname or school, name from team_name, school or nickname, where they are missing."""
    def fill(df: DataFrame, name: str, others: tuple[str, ...]) -> DataFrame:
        have = [F.col(c) for c in (name, *others) if c in df.columns]
        return df.withColumn(name, F.coalesce(*have)) if have else df

    return fill(fill(df, "team_name", ("nickname", "school")), "name", ("team_name", "school", "nickname"))


def identified(df: DataFrame, fields: tuple[str, ...] = ("name", "team_name", "school", "entity_name", "organization_name", "state")) -> DataFrame:
    """Records that have at least one primary identity."""
    have = [F.nullif(strip(F.col(c)), F.lit("")) for c in fields if c in df.columns]
    return df.filter(F.coalesce(*have).isNotNull()) if have else df.limit(0)


def latest_positions(df: DataFrame, key: list[str], pos: str, most: int) -> DataFrame:
    """The last `most` rows of each key by position."""
    w = Window.partitionBy(*key).orderBy(F.desc(pos))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def clean_payload(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Text records made to fit a schema (name → string, integer or number): missing hardware fields read from all texts
    together, outer white space off, blanks null, numbers read from their texts."""
    texts = [c for c in df.columns if is_text(df, c)]
    shown = F.concat_ws(", ", *[F.nullif(strip(F.col(c)), F.lit("")) for c in texts])
    specs = extract_specs(shown)
    out = {}
    for f, kind in fields.items():
        own = F.col(f) if f in df.columns else F.lit(None).cast("string")
        if f in ("ram_gb", "storage_gb", "gpu_model"):
            own = F.when(missing(own, "merge"), specs[f].cast("string")).otherwise(own) if f not in df.columns or is_text(df, f) else F.coalesce(own, specs[f].cast(dict(df.dtypes)[f]))
        if f not in df.columns or is_text(df, f):
            own = F.nullif(strip(own), F.lit(""))
            own = coerce_number(own, f, kind == "integer") if kind in ("integer", "number") else own
        out[f] = own
    return df.withColumns(out)
