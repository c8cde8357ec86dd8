"""Merging, uniting and coalescing tables; distinct rows by first appearance.

Row order is part of the meaning of these operators, so each takes the column that holds a row's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.text import join_sources, missing, strip

IDENTITY = ("entity_name", "raw_entity_name")


def is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def coalescing_join(left: DataFrame, right: DataFrame, key: str = "entity_name", how: str = "left", source: str = "source_url") -> DataFrame:
    """Equi join in which the left value of a shared column wins and the right one fills in; source lists are united.

    The right side's other identity columns are dropped. Null keys join nothing, and stay in a left or full join.
    """
    right = right.drop(*[c for c in IDENTITY if c != key])
    renamed = {c: f"__right_{c}" for c in right.columns}
    joined = left.join(right.withColumnsRenamed(renamed), F.col(key) == F.col(f"__right_{key}"), how)
    out = []
    for c in [*left.columns, *(c for c in right.columns if c not in left.columns)]:
        if c not in left.columns:
            out.append(F.col(f"__right_{c}").alias(c))
        elif c not in right.columns:
            out.append(F.col(c))
        elif c == source:
            out.append(F.nullif(join_sources(F.col(c), F.col(f"__right_{c}")), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.col(f"__right_{c}")).alias(c))
    return joined.select(out)


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on either side, those shared, and whether that is enough to merge.

    Five keys or fewer on a side need one in common, otherwise a thirtieth of the smaller side and three at least.
    """
    l_keys, r_keys = (d.select(key).filter(F.col(key).isNotNull()).distinct() for d in (left, right))
    both = l_keys.join(r_keys, key, "left_semi")
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((l_keys, "left_keys"), (r_keys, "right_keys"), (both, "overlap"))]
    out = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # three tables of one row
    smaller = F.least("left_keys", "right_keys")
    needed = F.when(smaller <= 5, 1).otherwise(F.greatest(F.lit(3), F.floor(smaller / 30)))
    return out.withColumn("eligible", F.col("overlap") >= needed)


def row_compatible(left: DataFrame, right: DataFrame, key: str, identity: tuple[str, ...] = (*IDENTITY, "source_url")) -> bool:
    """Whether two tables are parts of one: no key in common, and half of the smaller side's other columns shared."""
    own = [{c for c in d.columns if c not in identity} for d in (left, right)]
    if len(own[0] & own[1]) < max(1, min(map(len, own)) // 2):
        return False
    return left.select(key).join(right.select(key), key, "left_semi").isEmpty()


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows; columns in order of appearance, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def first_value(value: Column, pos: str, usable: Column) -> Column:
    return F.min_by(F.when(usable, value), F.when(usable, F.col(pos)))


def longest_text(value: Column, pos: str, usable: Column) -> Column:
    """Longest usable text, the first one among equals."""
    return F.max_by(F.when(usable, value), F.when(usable, F.struct(F.length(strip(value)), -F.col(pos))))


def coalesce_groups(df: DataFrame, key: str, pos: str, source: str = "source_url") -> DataFrame:
    """One row per key: the first number and the longest text that isn't missing, and all sources in order of appearance.

    A null key is a group. Sources are reduced to distinct ones per key before they are put in order, so a key with
    many rows never gathers more than its sources.
    """
    values = [c for c in df.columns if c not in (key, pos, source)]
    picked = []
    for c in values:
        usable = ~missing(F.col(c), "coalesce", is_text(df, c))
        picked.append((longest_text if is_text(df, c) else first_value)(F.col(c), pos, usable).alias(c))
    out = df.groupBy(key).agg(F.min(pos).alias(pos), *picked)
    if source not in df.columns:
        return out
    return out.join(group_sources(df, key, pos, source).withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def group_sources(df: DataFrame, key: str, pos: str, source: str) -> DataFrame:
    """key, source: the distinct parts of its source lists, in order of appearance."""
    parts = df.select(key, pos, F.posexplode(F.split(F.coalesce(source, F.lit("")), r"\|")).alias("__n", "__part"))
    parts = parts.withColumn("__part", strip(F.col("__part"))).filter("__part <> ''").groupBy(key, "__part").agg(F.min(F.struct(pos, "__n")).alias("__at"))
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__part")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["__part"]), " | ").alias(source))


def distinct_first(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each combination of keys; partial aggregation does most of the work before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("__row")).select(*keys, "__row.*").select(df.columns)


def fingerprint(columns: list[str], keep_nulls: bool = True) -> Column:
    """SHA-256 of a record's canonical JSON, columns sorted by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": str(not keep_nulls).lower()}), 256)


def append_distinct(known: DataFrame, new: DataFrame, columns: list[str], pos: str) -> DataFrame:
    """known and those rows of new whose fingerprint it lacks, each once."""
    mark = lambda d: d.withColumn("__mark", fingerprint(columns))
    fresh = distinct_first(mark(new), ["__mark"], pos).join(mark(known).select("__mark"), "__mark", "left_anti")
    return known.unionByName(fresh.drop("__mark"))


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(key), key, "left_anti")


def collapse_duplicates(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Each group of columns becomes one: the first value from the left that isn't null."""
    drop = [c for cols in groups.values() for c in cols]
    return df.select(*[c for c in df.columns if c not in drop], *[F.coalesce(*cols).alias(n) for n, cols in groups.items()])


def duplicate_columns(df: DataFrame, pos: str, protected: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold the same trimmed texts, row by row, as a column before them; protected ones are never named.

    One pass adds up a digest per column; pairs whose digests agree are then compared row by row, in a second pass.
    """
    names = [c for c in df.columns if c != pos]
    shown = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit(""))
    digests = df.agg(*[F.bit_xor(F.xxhash64(F.col(pos), shown(c))).alias(c) for c in names]).first()
    pairs, kept = [], {}
    for c in names:
        if digests[c] in kept and c not in protected:
            pairs.append((kept[digests[c]], c))
        else:
            kept.setdefault(digests[c], c)
    if not pairs:
        return []
    apart = df.agg(*[F.count_if(shown(a) != shown(b)).alias(b) for a, b in pairs]).first()
    return [b for _, b in pairs if apart[b] == 0]
