"""Sinks and sources of results: CSV, Parquet, JSON reports, checkpoints of records, previews, job manifests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablesmith.operators.columns import slug
from tablesmith.operators.tables import append_distinct, fingerprint
from tablesmith.sources import commits

#: Most rows of a JSON report.
REPORT = 10_000
#: Where the text of a row that can't be read stands, and how records are written.
BROKEN, JSON = "__broken", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: States of a job, and those from which it may move on.
STATES = {"queued": ("running", "failed"), "running": ("completed", "failed", "partial_success"), "completed": (), "failed": (), "partial_success": ()}


def write_table(df: DataFrame, folder: str, name: str, single: bool = False) -> tuple[str, str]:
    """Write df as CSV with a header and as Parquet; returns both paths. `single` puts a small table into one file."""
    out = df.coalesce(1) if single else df
    paths = f"{folder}/{slug(name)}_csv", f"{folder}/{slug(name)}_parquet"
    out.write.mode("overwrite").option("header", True).csv(paths[0])
    out.write.mode("overwrite").parquet(paths[1])
    return paths


def write_records(df: DataFrame, schema: StructType, path: str) -> None:
    """CSV of records in the order of a schema's fields; no records is an error."""
    if df.isEmpty():
        raise ValueError("there are no records to write")
    df.select(*[f.name for f in schema]).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame) -> str:
    """JSON with sorted keys of a report: one object for one row, else a list. A report of over REPORT rows is an error; write it as a table."""
    rows = [r.asDict(recursive=True) for r in df.limit(REPORT + 1).collect()]
    if len(rows) > REPORT:
        raise ValueError(f"a report of over {REPORT} rows")
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, sort_keys=True, default=str)


def run_key(goal: str, dataset: str, schema: StructType) -> str:
    """What a checkpoint must agree on to be resumed: goal, dataset and schema."""
    import hashlib

    return hashlib.sha256(json.dumps([goal, dataset, schema.jsonValue()], sort_keys=True).encode()).hexdigest()[:16]


def save_checkpoint(new: DataFrame, path: str, key: str, pos: str) -> None:
    """Append the records that the run's checkpoint lacks, each once; earlier files are never rewritten.

    Several writers may do so at a time: one that another was faster than leaves out what that one has added.
    """
    spark, columns = new.sparkSession, [c for c in new.columns if c != pos]
    mark = lambda d: d.withColumn("__mark", fingerprint(columns))

    def write(parts: list[str], to: str) -> None:
        known = _records(spark, f"{path}/run={key}", parts, new.schema).filter(f"{BROKEN} is null")
        fresh = append_distinct(known.drop(BROKEN).limit(0), new, columns, pos)
        fresh = mark(fresh).join(mark(known).select("__mark"), "__mark", "left_anti").drop("__mark")
        fresh.write.options(**JSON).json(to, compression="gzip")

    commits.add(spark, f"{path}/run={key}", write)


def _records(spark: SparkSession, root: str, parts: list[str], schema: StructType) -> DataFrame:
    whole = StructType([*(StructField(f.name, f.dataType, True) for f in schema), StructField(BROKEN, StringType())])
    told = F.from_json("value", whole, JSON | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    read = lambda paths: spark.read.text(paths).select(told.alias("r")).select("r.*")
    return commits.read_parts(spark, root, parts, read, spark.createDataFrame([], whole))


def load_checkpoint(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """Records of a run; none if nothing was saved for exactly this run. Rows that can't be read are left aside (`broken_records`)."""
    root = f"{path}/run={key}"
    return _records(spark, root, commits.committed(spark, root), schema).filter(f"{BROKEN} is null").drop(BROKEN)


def broken_records(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """The text of a run's rows that don't fit the schema or are no JSON: column text."""
    root = f"{path}/run={key}"
    return _records(spark, root, commits.committed(spark, root), schema).filter(f"{BROKEN} is not null").select(F.col(BROKEN).alias("text"))


def write_steps(steps: DataFrame, path: str, run: str) -> None:
    """Keep what was seen at each step (column step) of a run, in folders by run and step."""
    steps.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "step").parquet(path)


def read_steps(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run") == run).drop("run")


def preview(spark: SparkSession, csv_path: str, n: int = 20) -> DataFrame:
    """First rows of an exported CSV, 1 to 50 of them."""
    return spark.read.option("header", True).csv(csv_path).limit(max(1, min(n, 50)))


def new_job(job_id: str, goal: str) -> dict:
    return {"job_id": job_id, "goal": goal, "state": "queued", "stage": "", "error": None, "artifacts": {}, "updated": datetime.now(UTC).isoformat()}


def move_job(job: dict, state: str, **more) -> dict:
    """The job in its next state; a step that the states don't allow is an error."""
    if state != job["state"] and state not in STATES[job["state"]]:
        raise ValueError(f"a {job['state']} job can't become {state}")
    return job | more | {"state": state, "updated": datetime.now(UTC).isoformat()}
