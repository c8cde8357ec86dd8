"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import drop_path, materialise, new_path, shared_dir, ship  # noqa: F401  for the operators

#: One word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """Unsigned CRC-32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


#: A key is hot if it has more than this share of all rows: fewer than a thousand keys can be, whatever the input. Its rows are dealt to so many places.
HOT, PLACES = 0.001, 64


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts: one row for each key, with n, the number of rows that have it, of `total` in all.

    The rows of a hot key are dealt to several places, each of which gets a copy of what is known of it.
    """
    hot = F.col("n") > max(1, HOT * total)
    known = facts.filter(hot).select(key, F.lit(True).alias("__hot"))
    spread = rows.join(F.broadcast(known), key, "left")  # fewer than 1 / HOT keys
    spread = spread.withColumn("__place", F.when(F.col("__hot"), F.monotonically_increasing_id() % PLACES).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return spread.join(facts.withColumn("__place", F.explode(copies)).drop("n"), [key, "__place"]).drop("__hot", "__place")


def bucketed_rank_base(counts: DataFrame, parts: list[str], bucket: str, n: str, out: str) -> DataFrame:
    """Running total of n before each bucket, within parts.

    counts has one row per (parts, bucket), so what meets in one window is the number of buckets, never the rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    w = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))
