"""Streams that are stopped, started again and replayed."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliate.streaming import edits as ed
from foliate.streaming import log as sl

EDITS = "key string, value string, at timestamp, place long, flush boolean"
OUT = "key string, value string, edits long, at timestamp, flushed boolean"
T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def feed(spark, folder, number, *edits):
    made = [(k, v, T0 + timedelta(seconds=s), i, v is None) for i, (k, v, s) in enumerate(edits, 100 * number)]
    spark.createDataFrame(made, EDITS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # the source reads files in order of their times


def started(spark, tmp_path, by_event_time, quiet, **trigger):
    source = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in")
    found = ed.resting(source, quiet, by_event_time, "0 seconds")
    return found.writeStream.foreachBatch(sl.appended(f"file:{tmp_path}/log")).option("checkpointLocation", f"file:{tmp_path}/checkpoint").trigger(**trigger).start()


def log(spark, tmp_path):
    return [(r.key, r.value, r.edits, r.flushed) for r in sl.logged(spark, f"file:{tmp_path}/log", OUT).orderBy("at", "key").collect()]


def test_a_stopped_stream_goes_on_and_writes_each_edit_once(spark, tmp_path):
    """By event time: state outlives the stop, each edit is written once, a flush writes its key at once."""
    folder = f"file:{tmp_path}/in"
    feed(spark, folder, 1, ("a", "1", 0), ("a", "2", 5), ("b", "x", 3), ("b", None, 4), ("c", "late", 9))
    started(spark, tmp_path, True, 10_000, availableNow=True).awaitTermination()
    assert log(spark, tmp_path) == [("b", "x", 1, True)]
    feed(spark, folder, 2, ("a", "3", 12), ("b", "y", 13), ("c", None, 14))
    started(spark, tmp_path, True, 10_000, availableNow=True).awaitTermination()
    feed(spark, folder, 3, ("z", "end", 60), ("a", "4", 60))
    started(spark, tmp_path, True, 10_000, availableNow=True).awaitTermination()
    want = [("b", "x", 1, True), ("c", "late", 1, True), ("a", "3", 3, False), ("b", "y", 1, False)]
    assert log(spark, tmp_path) == want
    started(spark, tmp_path, True, 10_000, availableNow=True).awaitTermination()
    assert log(spark, tmp_path) == want


def test_timers_by_the_clock(spark, tmp_path):
    folder = f"file:{tmp_path}/in"
    feed(spark, folder, 1, ("a", "1", 0), ("b", "x", 0))
    query = started(spark, tmp_path, False, 2_000, processingTime="200 milliseconds")
    try:
        deadline = time.time() + 90
        while len(log(spark, tmp_path)) < 2 and time.time() < deadline:
            time.sleep(0.5)
        feed(spark, folder, 2, ("a", "2", 5), ("a", None, 6))
        while len(log(spark, tmp_path)) < 3 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert log(spark, tmp_path) == [("a", "1", 1, False), ("b", "x", 1, False), ("a", "2", 1, True)]


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    folder = f"file:{tmp_path}/log"
    add = sl.appended(folder)
    batch = spark.range(5)
    assert sl.logged(spark, folder, "id long").count() == 0
    add(batch, 0)
    add(batch, 0)
    add(batch.limit(0), 1)
    with pytest.raises(Exception, match="broken"):
        add(batch.select(F.raise_error(F.lit("broken")).alias("id")), 2)
    assert rows(sl.logged(spark, folder, "id long")) == [(i, 0) for i in range(5)]
    add(batch.where("id > 3"), 2)
    assert rows(sl.logged(spark, folder, "id long")) == sorted([(i, 0) for i in range(5)] + [(4, 2)], key=str)
