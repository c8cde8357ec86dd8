"""Structured Streaming forms of the engine's incremental operators (an extension: the batch forms are the reference ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablesmith.operators.tables import fingerprint
from tablesmith.session import ship
from tablesmith.sources import commits

#: The state store that processors of a key's state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distinct_records(stream: DataFrame, columns: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Records of a stream, each fingerprint once within the watermark; state is dropped as the watermark passes."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("mark", fingerprint(columns))
    return marked.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["mark"])


class RunProcessor(StatefulProcessor):
    """A key's rejections in a row up to now, and the most there were."""

    def __init__(self, key: str, threshold: int):
        self.key, self.threshold = key, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", StructType([StructField("run", LongType()), StructField("longest", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        run, longest = self.state.get() if self.state.exists() else (0, 0)
        for bad in pd.concat(rows).sort_values("pos", kind="stable")["bad"]:
            run = run + 1 if bad else 0
            longest = max(longest, run)
        self.state.update((int(run), int(longest)))
        yield pd.DataFrame({self.key: [key[0]], "run": [int(run)], "longest": [int(longest)], "abort": [bool(longest >= self.threshold)]})

    def close(self) -> None:
        pass


def rejection_runs(stream: DataFrame, key: str, pos: str, rejected: Column, threshold: int = 3) -> DataFrame:
    """Per key of a stream, as it goes: run (rejections in a row up to now), longest, and abort, whether that reached the threshold.

    A batch's rows of a key are taken in the order of pos, and batches in the order in which they come; the state of a
    key is two numbers. For the update mode; the session's state store has to be STORE.
    """
    ship(stream.sparkSession)
    rows = stream.select(key, F.col(pos).alias("pos"), F.coalesce(rejected, F.lit(False)).cast(IntegerType()).alias("bad"))
    out = f"{key} {dict(stream.dtypes)[key]}, run long, longest long, abort boolean"
    return rows.groupBy(key).transformWithStateInPandas(RunProcessor(key, threshold), out, "Update", "None")


def append_batches(stream: DataFrame, path: str, run: str) -> DataStreamWriter:
    """Append a stream's batches to a table of parts, each once: a batch that is given again after a restart is there already.

    run: what the parts of this query are called, the same after a restart, as is the query's checkpointLocation.
    """

    def once(batch: DataFrame, number: int) -> None:
        commits.add_once(batch.sparkSession, path, f"{run}-{number:09d}", lambda to: batch.write.mode("overwrite").parquet(to))

    return stream.writeStream.foreachBatch(once)


def appended(stream: DataFrame, path: str) -> DataFrame:
    """What has been appended so far, as a table; `stream` tells its columns."""
    spark = stream.sparkSession
    parts = commits.committed(spark, path)
    return commits.read_parts(spark, path, parts, lambda paths: spark.read.schema(stream.schema).parquet(*paths), spark.createDataFrame([], stream.schema))
