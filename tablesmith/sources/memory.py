"""What worked before, kept between sessions: a store of goals and the sources that served them.

Each version is a whole snapshot of at most MOST entries, so compaction is part of every write; sessions that write at
the same time do so one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.operators import ranking
from tablesmith.session import drop_path
from tablesmith.sources import commits

#: Fixed value: entries that stay.
MOST = 50
#: Snapshots that are kept for readers that began before the last ones.
KEPT = 10
ENTRY = "goal string, domain_intent string, entity_intent string, target_hint string, feature_hints array<string>, urls array<string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries, with pos, their order; none if nothing was kept."""
    parts = commits.committed(spark, path)
    return _read(spark, path, parts)


def _read(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    schema = f"{ENTRY}, pos long"
    return commits.read_parts(spark, path, parts[-1:], lambda paths: spark.read.schema(schema).parquet(*paths), spark.createDataFrame([], schema))


def record(spark: SparkSession, path: str, goal: str, urls: list[str], intents: dict) -> None:
    """Keep the URLs that served a goal, in the place of the goal's earlier entry or at the end; nothing if there are none.

    intents: domain_intent, entity_intent, target_hint and feature_hints of the goal.
    """
    urls = list(dict.fromkeys(u.strip() for u in urls if u.strip()))
    if not urls:
        return
    row = (goal.strip(), intents["domain_intent"], intents["entity_intent"], intents["target_hint"], list(intents["feature_hints"]), urls)
    entry = spark.createDataFrame([row], ENTRY)

    def write(parts: list[str], to: str) -> None:
        ranking.remember(_read(spark, path, parts), entry, "pos", MOST).withColumn("pos", F.col("pos").cast("long")).coalesce(1).write.parquet(to)

    for old in commits.add(spark, path, write)[:-KEPT]:
        drop_path(spark, f"{path}/{old}")


def similar(spark: SparkSession, path: str, intents: dict, limit: int = 6) -> DataFrame:
    """place, url: URLs that served goals like this one (see ranking.similar_sources)."""
    return ranking.similar_sources(load(spark, path), intents, limit)
