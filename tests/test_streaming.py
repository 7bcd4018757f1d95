"""Streams give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdtape.operators.buckets import bucket_sums
from crowdtape.sources.staging import new_path
from crowdtape.streaming import posts as streams


@pytest.fixture()
def deliveries(spark):
    """Two overlapping deliveries of posts, as two files."""
    first = dt.datetime(2023, 7, 3)
    rows = [(i, first + dt.timedelta(minutes=13 * i), f"u{i % 3}", float(i)) for i in range(200)]
    path = new_path(spark, "deliveries")
    schema = "id long, created_at timestamp_ntz, user string, value double"
    for part in (rows[:120], rows[100:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream_of(spark, path):
    return streams.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def written(spark, stream, name):
    path = new_path(spark, name)
    streams.write_stream(stream, path, f"{path}-progress").awaitTermination()
    return spark.read.parquet(path)


def test_repeats_across_batches_are_dropped(spark, deliveries):
    path, rows = deliveries
    distinct = written(spark, streams.distinct_posts(stream_of(spark, path)), "distinct")
    assert sorted(r.id for r in distinct.collect()) == [r[0] for r in rows]


def test_closed_buckets_equal_the_batch_sums(spark, deliveries):
    path, rows = deliveries
    stream = streams.distinct_posts(stream_of(spark, path), delay="1 hour")
    sums = stream.withColumn("value", F.col("value"))
    summed = written(spark, streams.streamed_bucket_sums(
        stream_of(spark, path), ["value"], "1 hour", offset="30 minutes", delay="40 hours"), "sums")
    batch = bucket_sums(spark.read.parquet(path), ["value"], "1 hour", "30 minutes")
    closed = max(r[1] for r in rows) - dt.timedelta(hours=40)
    expected = {(r.user, r.created_at): r.value for r in batch.collect() if r.created_at + dt.timedelta(hours=1) <= closed}
    assert sums.isStreaming
    assert {(r.user, r.created_at): r.value for r in summed.collect()} == expected and expected


def test_history_keeps_the_last_arrival(spark, deliveries):
    path, rows = deliveries
    log = new_path(spark, "log")
    for _ in range(2):  # the second start finds nothing new
        streams.log_arrivals(stream_of(spark, path), log, f"{log}-progress").awaitTermination()
    history = streams.read_history(spark, log)
    assert sorted(r.id for r in history.collect()) == [r[0] for r in rows]
    assert spark.read.parquet(log).select("arrival").distinct().count() == 2
    assert "arrival" not in history.columns
