"""What a session shares with its executors: the package, and a folder for intermediate tables."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, so that their Python workers can import it; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tablesmith_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tablesmith-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/tablesmith.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._tablesmith_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tablesmith-")
        spark.sparkContext.setCheckpointDir(_local_dir)
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it goes when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that new_path gave; one that is gone, or a session that has ended, is no error."""
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
