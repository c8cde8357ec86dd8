"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, sharding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next one's
docs. All but the last return the columns of documents. The last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import materialise, ship, table
from tablesmith.llm.decontaminate import find_items
from tablesmith.llm.language_id import fit, identify
from tablesmith.llm.mixing import mix
from tablesmith.llm.near_dedup import keep_one
from tablesmith.llm.sharding import shard

#: A text goes if no language was told, or if the best dictionary saves less than this share (of 64 KB at most) over the second best.
MIN_MARGIN = 0.001
SHARDS = 8

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is undecided; all labelled documents teach the dictionaries."""
    model = fit(docs)
    return identify(docs, model, MIN_MARGIN, into="__language").filter("not __language.rejected").drop("__language")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item."""
    items = table(spark, sf_dir, "benchmark")
    return find_items(docs, items, into="__hits").filter("size(__hits) = 0").drop("__hits")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    mixed = mix(docs, into="__mix").filter("__mix.copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mix.copies")))).drop("__mix", "__copy")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard and slot (in place of columns of these names)."""
    placed = shard(docs.drop("shard", "slot"), SHARDS, into="__placed")
    return placed.withColumns({"shard": F.col("__placed.shard"), "slot": F.col("__placed.slot")}).drop("__placed")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
