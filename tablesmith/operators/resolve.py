"""Entity resolution: canonical keys, and a greedy fuzzy match to the first earlier key that is alike enough.

A key goes to the first earlier canonical key with a sequence ratio of 0.94 or more. Such a pair differs by few edits
(at most 0.06 of both lengths together), so of more disjoint pieces of a key than edits, one is whole in the other,
or nearly so in place: candidates are found by an equi join on a key's rarest pieces, never by comparing all pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.text import canonical_key
from tablesmith.session import materialise, ship

RATIO = 0.94
#: Characters to a piece; keys of eight characters or more, shorter ones have no edits, can be cut by the first two often enough.
SIZES = (2, 3, 4, 6)
#: A second piece is asked for if that makes so many times the meetings at most.
MORE = 4


def resolve_exact(df: DataFrame, column: str, into: str = "entity_name") -> DataFrame:
    """df with the canonical key of a column; rows without one get an empty key."""
    return df.withColumn(into, canonical_key(F.col(column)))


def _reach(n: Column) -> Column:
    """No partner of a key of n characters is longer by more."""
    return F.floor(n * 2 * (1 - RATIO) / RATIO + 1).cast("int")


def _edits(n: Column) -> Column:
    return F.floor((2 * n + _reach(n)) * (1 - RATIO)).cast("int")


def rare_pieces(keys: DataFrame) -> DataFrame:
    """(key, pos, edits, need, size, at, piece) for keys (key, pos): the pieces of a key that the fewest keys share; `need` of them are in any match.

    A key is cut into pieces of each of SIZES in turn. Of any edits + 1 pieces of one size a match holds one, of any
    edits + 2 two, so the rarest are kept, the second number if that makes few more meetings. Of the sizes, the one whose
    kept pieces are shared least: what thousands of keys begin with is in no kept piece as long as the rest of the key
    can be cut often enough.
    """
    sizes = F.array(*[F.lit(s) for s in SIZES])
    k = keys.select("key", "pos", _edits(F.length("key")).alias("edits"), F.explode(sizes).alias("size")).filter(F.floor(F.length("key") / F.col("size")) > F.col("edits"))
    cut = k.withColumn("at", F.explode(F.expr("sequence(1, length(key) - size + 1, size)"))).withColumn("piece", F.expr("substring(key, at, size)"))
    shared = substrings(keys).groupBy("size", "piece").agg(F.count(F.lit(1)).alias("n"))
    per = cut.join(shared, ["size", "piece"]).groupBy("key", "pos", "edits", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at", "piece"))).alias("all"))  # the pieces of a key
    total = lambda pieces: F.aggregate(pieces, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])
    one, two = (F.slice("all", F.lit(1), F.col("edits") + n) for n in (1, 2))
    per = per.withColumns({"one": total(one), "two": total(two)}).withColumn("need", F.when((F.size("all") >= F.col("edits") + 2) & (F.col("two") <= MORE * F.col("one")), 2).otherwise(1))
    # of two sizes the one that brings fewer pairs together: those that must meet twice are a small part of those that do once
    cost = F.when(F.col("need") == 2, F.col("two") / MORE**2).otherwise(F.col("one"))
    kept = per.withColumn("all", F.when(F.col("need") == 2, two).otherwise(one))
    best = kept.groupBy("key", "pos", "edits").agg(F.min(F.struct(cost.alias("cost"), (-F.col("size")).alias("less"), "size", "need", "all")).alias("best"))
    return best.select("key", "pos", "edits", "best.need", "best.size", F.explode("best.all").alias("x")).select("key", "pos", "edits", "need", "size", "x.at", "x.piece")


def substrings(keys: DataFrame) -> DataFrame:
    """(other, other_pos, size, from, piece): every substring of a key that has one of SIZES."""
    sizes = F.array(*[F.lit(s) for s in SIZES])
    near = keys.select(F.col("key").alias("other"), F.col("pos").alias("other_pos"), F.explode(sizes).alias("size")).filter("length(other) >= size")
    near = near.withColumn("from", F.explode(F.expr("sequence(1, length(other) - size + 1)")))
    return near.withColumn("piece", F.expr("substring(other, `from`, size)"))


def met_pairs(keys: DataFrame) -> DataFrame:
    """(a, b, a_pos, b_pos) for keys (key, pos): b comes before a, and one holds as many rare pieces of the other as it must, each near its place."""
    long = keys.filter(_edits(F.length("key")) >= 1)  # below that, only equal keys match
    cut = rare_pieces(long).withColumn("from", F.explode(F.sequence(F.greatest(F.col("at") - F.col("edits"), F.lit(1)), F.col("at") + F.col("edits"))))
    before = F.abs(F.col("from") - F.col("at"))  # edits that move the piece, and those that move the end against it
    near = before + F.abs(F.length("other") - F.col("from") - F.length("key") + F.col("at")) <= (F.length("key") + F.length("other")) * (1 - RATIO) + 1e-9
    met = cut.join(substrings(long), ["piece", "size", "from"]).filter((F.col("pos") != F.col("other_pos")) & near)
    met = met.groupBy("key", "pos", "other", "other_pos", "need").agg(F.size(F.collect_set("at")).alias("pieces")).filter("pieces >= need")
    met = met.select(*[F.when(F.col("pos") > F.col("other_pos"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("key", "other", "a"), ("other", "key", "b"), ("pos", "other_pos", "a_pos"), ("other_pos", "pos", "b_pos"))])
    return met.distinct()


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """The pairs that met and differ by few enough edits."""
    most = (F.length("a") + F.length("b")) * (1 - RATIO) + 1e-9
    return met_pairs(keys).filter(F.levenshtein("a", "b") <= most)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


@cache
def sequence_ratio():
    return F.pandas_udf(_ratios, "double")


def resolve_fuzzy(df: DataFrame, column: str, pos: str, into: str = "entity_name") -> DataFrame:
    """df with the canonical key of a column after fuzzy matching, in order of position.

    Distinct keys with their first positions are enough. A key takes the earliest of its matches that is canonical
    itself; matches settle in rounds along the order, as many as the longest chain of them.
    """
    ship(df.sparkSession)
    keyed = resolve_exact(df, column, "__key")
    keys = materialise(keyed.groupBy(F.col("__key").alias("key")).agg(F.min(pos).alias("pos")), "fuzzy-keys")
    edges = candidate_pairs(keys).filter(sequence_ratio()("a", "b") >= RATIO).select("a", "a_pos", "b", "b_pos")
    edges = materialise(edges, "fuzzy-edges")
    settled = keys.join(edges.select(F.col("a").alias("key")).distinct(), "key", "left_anti").select("key", F.col("key").alias("to"))
    open_ = edges
    while not open_.isEmpty():
        state = open_.join(settled.select(F.col("key").alias("b"), (F.col("key") == F.col("to")).alias("canonical")), "b", "left")
        per = state.groupBy("a").agg(
            F.min(F.when(F.col("canonical"), F.struct("b_pos", "b"))).alias("hit"), F.min(F.when(F.col("canonical").isNull(), F.col("b_pos"))).alias("unknown")
        )
        known = F.coalesce((F.col("hit.b_pos") < F.col("unknown")) | F.col("unknown").isNull(), F.lit(False))
        done = per.filter(known).select(F.col("a").alias("key"), F.coalesce("hit.b", "a").alias("to"))
        done = materialise(done, "fuzzy-done")
        settled = materialise(settled.unionByName(done), "fuzzy-settled")
        open_ = materialise(open_.join(done.select(F.col("key").alias("a")), "a", "left_anti"), "fuzzy-open")
    out = keyed.join(settled.withColumnRenamed("key", "__key"), "__key", "left")
    return out.withColumn(into, F.coalesce("to", "__key")).drop("__key", "to")
