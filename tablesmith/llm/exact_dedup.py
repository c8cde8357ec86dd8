"""Exact duplicates by skew-safe combining: local, salted, then global, with full content compared at every stage.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of more than this share of all rows are hot: there are fewer than a thousand of them, whatever the input.
HOT = 0.001


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() is used where it comes to the same, as it is much faster.

    It does for pure ASCII, and where it leaves everything beyond ASCII as it is, by the very tables that it uses.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    cased = F.exists(F.array(beyond), lambda x: F.lower(x) != x)
    return F.when((F.octet_length(text) == F.length(text)) | ~cased, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salt_of(df: DataFrame, salts: int) -> Column:
    """A salt that spreads equal texts whatever their ids: rows that repeat an id differ in their partition."""
    return F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).cast("int")


def exact_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: text_sha256, content, keep_id, group_size.

    1. Each task merges its own equal texts (the partial aggregate groups on digest, salt and full content).
    2. One shuffle merges the salted groups, so a text that a third of all rows share meets in `salts` places.
    3. A second shuffle merges the winners of the salts: at most `salts` rows for each text.
    """
    rows = _normalised(docs)
    rows = rows.withColumn("salt", salt_of(rows, salts))
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("text_sha256", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Decide for each document whether it stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one
    group. Of a group, the row with the largest doc_id stays; null ids stay only where a group has no other. Rows
    that repeat an id share its decision. An empty table gives an empty result; other columns are ignored.

    The groups compare whole contents. Rows find their group by its SHA-256, those of a hot group in `salts` places;
    should two contents ever share a digest, the rows concerned are joined on their whole contents instead.
    """
    groups = exact_groups(docs, salts).groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    groups = materialise(groups, "exact-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > max(1, HOT * total)
    rows = _normalised(docs)
    marked = groups.filter(hot).select("text_sha256", F.lit(True).alias("hot"))  # under 1 / HOT rows
    spread = rows.select("doc_id", "text_sha256").join(F.broadcast(marked), "text_sha256", "left")
    spread = spread.withColumn("salt", F.when(F.col("hot"), salt_of(rows, salts)).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    single = groups.filter("contents = 1").withColumn("salt", F.explode(copies)).drop("contents")
    out = spread.join(single, ["text_sha256", "salt"])
    shared = groups.filter("contents > 1").select("text_sha256")
    if not shared.isEmpty():
        apart = exact_groups(docs, salts).join(shared, "text_sha256", "left_semi")
        out = out.unionByName(rows.join(apart, ["text_sha256", "content"]).select("doc_id", "text_sha256", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _normalised(docs: DataFrame) -> DataFrame:
    content = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", content.alias("content")).withColumn("text_sha256", F.sha2("content", 256))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLES = {
    "op7_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content
  FROM documents
), g AS (
  SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (content)
"""
}
