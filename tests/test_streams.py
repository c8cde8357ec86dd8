"""Streams that are stopped in the middle give what the batch gives."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tablesmith.operators import ranking
from tablesmith.streaming import incremental

SCHEMA = "source string, pos long, ok boolean"


@pytest.fixture
def log(spark, tmp_path):
    """Three files, one a batch."""
    rows = [(f"s{i % 3}" if i % 11 else None, i, (i * i + i // 7) % 3 == 0 if i % 13 else None) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.createDataFrame(rows, SCHEMA), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_a_stopped_append_goes_on_where_it_was(spark, log, tmp_path, monkeypatch):
    whole, stream = log
    path, calls = str(tmp_path / "out"), []
    real = incremental.commits.add_once

    def breaks(*args):
        made = real(*args)
        calls.append(made)
        if len(calls) == 2:
            raise RuntimeError("stopped after the commit, before the batch was done")
        return made

    monkeypatch.setattr(incremental.commits, "add_once", breaks)
    start = lambda: incremental.append_batches(stream, path, "q").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    assert incremental.appended(stream, path).count() == 60
    start().awaitTermination(120)
    assert calls == [True, True, False, True]  # the second batch came again
    got = incremental.appended(stream, path).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect()))


def test_runs_of_rejections_after_a_restart(spark, log, tmp_path):
    whole, stream = log
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.STORE)
    seen, fail = {}, [True]

    def keep(batch, number):
        if number == 2 and fail.pop():
            raise RuntimeError("stopped")
        for r in batch.collect():
            seen[r.source] = (r.longest, r.abort)

    try:
        runs = incremental.rejection_runs(stream, "source", "pos", ~F.col("ok"), threshold=4)
        start = lambda: runs.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        with pytest.raises(StreamingQueryException):
            start().awaitTermination(120)
        fail.append(False)
        start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    # the files come in the order in which they were written, which is that of pos
    want = {r.source: (r.longest, r.abort) for r in ranking.rejection_runs(whole, "source", "pos", ~F.col("ok"), threshold=4).collect()}
    assert seen == want and len(set(want.values())) > 1
