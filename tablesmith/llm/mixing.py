"""Mixing sources to target weights by capped water-filling.

Every source gets its share of all words by weight; a source whose share would take more than `max_epochs`
repetitions is clamped there, and what is left over goes to the others by weight until none is above its clamp.
A source then takes each of its documents a whole number of times, and a seeded choice of them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, bucketed_rank_base, materialise, table

#: A place is 60 bits of a digest; its first bits are the bucket in which a source's documents are added up.
PLACE_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """Where a document stands in its source's seeded order, as a digest of its id: rows that repeat an id stand together, and at the
    same place in the order of each source that they are of; rows without an id stand where their texts put them."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, PLACE_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    """Bits of a bucket: so many that one has some 25,000 to 50,000 of all rows, whatever the input."""
    return max(6, min(PLACE_BITS, (rows // 50_000).bit_length()))


def water_fill(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Targets for a table (source, source_size): adds weight and target.

    There is a row for each source, and all of them meet in one window. Sources in the order of their code points, null
    last, take the weights in turn. Clamps bind in the order of clamp / weight: going up this order, the level (what is
    left / the weights left) only rises, so a source is clamped exactly if its clamp is at or below the level that
    holds when its turn comes.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    s = s.withColumn("clamp", F.col("source_size") * max_epochs)
    up = everything.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("clamp").over(before), F.lit(0))
    weight_left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", left / weight_left).withColumn("clamped", F.col("clamp") / F.col("weight") <= F.col("level"))
    # once one source is free, all later ones are, and share the level of the first free one
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("clamp") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("clamped"), F.col("clamp").cast("double")).otherwise(F.col("weight") * level)
    return s.withColumn("target", target).select("source", "weight", "source_size", "target")


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per source: source, weight, source_size, target, whole, last_place.

    A document is taken `whole` times, and once more if its place is at most last_place. The extra documents are
    the first in the seeded order whose middle word is within what `whole` repetitions leave of the target, so a
    source misses its target by half a document at most. Words are added up by bucket before any window, and only
    the bucket where the target is reached is sorted: no task sees more of a source than that.
    """
    slim = docs.select("source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place"))
    slim = materialise(slim, "mix-sizes")
    bits = bucket_bits(slim.count())
    slim = slim.withColumn("bucket", F.shiftright("place", PLACE_BITS - bits))
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")
    at = bucketed_rank_base(buckets, ["source"], "bucket", "words", "before")
    at = at.join(targets.select("source", "rest").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = at.filter("before <= rest and before + words >= rest").select("source", "bucket", "before", "rest")
    places = slim.alias("x").join(at.alias("y"), F.expr("x.source <=> y.source and x.bucket = y.bucket")).select("x.source", "x.bucket", "place", "size", "before", "rest")
    places = places.groupBy("source", "bucket", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    taken = places.withColumn("mid", start + F.col("size") / 2).filter("mid <= rest").groupBy("source").agg(F.max("place").alias("reached"))
    # where the target falls before the first middle of its bucket, all earlier buckets are taken
    floor = at.groupBy("source").agg(F.min("bucket").alias("bucket")).select("source", (F.shiftleft("bucket", PLACE_BITS - bits) - 1).alias("below"))
    out = targets.join(taken.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left")
    out = out.join(floor.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    last = F.greatest("reached", "below")
    return out.select("source", "weight", "source_size", "target", "whole", F.coalesce(last, F.lit(-1)).alias("last_place"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, into: str = "mix") -> DataFrame:
    """docs with a struct column `into` (in place of one of that name): source_size, target, copies (how often the mix takes the row).

    Null sources are a source of their own, last in order; null texts have no words; documents without words come
    as often as their place in the order says, and take no words. Rows that repeat an id are taken or left
    together; rows without an id go by their text. No row comes more than max_epochs times. An empty table gives
    an empty result, and other columns pass through.
    """
    p = mixing_plan(docs, weights, max_epochs, seed)
    p = materialise(p, "mix-plan").select(F.col("source").alias("__source"), F.struct("source_size", "target", "whole", "last_place").alias("__plan"))
    copies = F.col("__plan.whole") + (place(F.col("text_row.doc_id"), F.col("text_row.text"), seed) <= F.col("__plan.last_place")).cast("int")
    rows = docs.drop(into).select(F.struct("*").alias("text_row"))
    rows = rows.join(p, F.col("text_row.source").eqNullSafe(F.col("__source")))
    mixed = F.struct(F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"), F.least(copies, F.lit(max_epochs)).alias("copies"))
    return rows.select("text_row.*", mixed.alias(into))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = word_count(F.col("text"))
    mixed = mix(docs)
    return mixed.select("doc_id", size.alias("size"), "mix.source_size", "mix.target", (size * F.col("mix.copies")).alias("taken"))


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS clamp FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), free AS (
  SELECT arg_min(level, clamp / weight) AS level FROM l WHERE clamp / weight > level
), t AS (
  SELECT l.source, source_size, CASE WHEN clamp / weight <= l.level THEN clamp::DOUBLE ELSE weight * free.level END AS target FROM l, free
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), p AS (
  SELECT source, place, sum(size) AS size FROM d GROUP BY source, place
), m AS (
  SELECT p.source, place, coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= target - whole * source_size AS more
  FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT d.doc_id, d.size, e.source_size, e.target, (d.size * least(e.whole + m.more::INT, 3))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.place = m.place
"""
}
