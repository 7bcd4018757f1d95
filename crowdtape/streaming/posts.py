"""Posts that arrive as files: duplicate removal, history upkeep and bucket sums."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crowdtape.operators.dedupe import keep_last
from crowdtape.sources.history import History


def read_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "created_at",
                files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files under a path. Watermarks need a timestamp with zone, so ``ts`` becomes one."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def distinct_posts(stream: DataFrame, key: str = "id", ts: str = "created_at",
                   delay: str = "1 day") -> DataFrame:
    """One row per id; a repeat is recognised for at least ``delay`` after the first.

    Rows older than the watermark, the latest ``ts`` seen less ``delay``, are dropped, first arrivals among
    them: state cannot be kept for ever. Where late posts have to be kept use the arrival log, which loses none.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def streamed_bucket_sums(stream: DataFrame, measures: Sequence[str], width: str, slide: str | None = None,
                         offset: str | None = None, keys: Sequence[str] = ("user",), ts: str = "created_at",
                         delay: str = "1 hour") -> DataFrame:
    """Sums per key and bucket, sent out once the watermark has passed the bucket's end.

    Rows that arrive after that are not counted; ``bucket_sums`` over the arrival log counts them.
    """
    window = F.window(ts, width, slide, offset)
    sums = stream.withWatermark(ts, delay).groupBy(*keys, window).agg(*[F.sum(m).alias(m) for m in measures])
    return sums.select(*keys, F.col("window.start").alias(ts), *measures)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, processing what is there now; files are committed exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", checkpoint).start()
    )


def log_arrivals(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every batch to a log of arrivals, as a folder named by the batch.

    A batch that is run again after a failure overwrites its own folder, so nothing is stored twice.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/arrival={number}")

    return (
        stream.writeStream.foreachBatch(store).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )


def keep_history(stream: DataFrame, history: History, checkpoint: str, compact_every: int = 8) -> StreamingQuery:
    """Store every batch as an arrival, and fold what waits into the stored ranges after so many batches.

    A batch that is run again after a failure replaces its own arrival, or changes nothing where that is folded in.
    """
    def store(batch: DataFrame, number: int) -> None:
        if number > history.pointer()[1]:
            history.append(batch, number)
        if (number + 1) % compact_every == 0:
            history.compact()

    return (
        stream.writeStream.foreachBatch(store).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )


def read_history(spark: SparkSession, log: str, key: str = "id", order: Sequence = ()) -> DataFrame:
    """The last arrival of every id; ``order`` decides among rows of one batch."""
    return keep_last(spark.read.parquet(log), key, F.desc("arrival"), *order).drop("arrival")
