"""Bucket sums of a stream of which no row is lost: late rows go to a table of their own, open buckets can be read.

Structured Streaming's own windowed sums drop what comes after the watermark and keep the last windows to themselves.
Here every micro-batch is handled as a table: rows of buckets that have been closed are late, the others are added
to the open buckets that the batch before has left, and the buckets that the new watermark has passed are closed.
"""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crowdtape.sources.staging import delete_folder, staged


class BucketStore:
    """Sums per key and time bucket, below a folder that all executors share.

    ``schema`` is that of the stream's rows. A bucket is closed for good once the watermark, the latest time seen less
    ``delay``, has passed its end; a row whose bucket is closed by then, or that has no time, is late. What is kept
    from batch to batch is the open buckets' sums. Batches are numbered upwards; one that is done again after a
    failure does over what it had left, and one that is done again after its progress is written changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, measures: Sequence[str], width: str,
                 offset: str | None = None, keys: Sequence[str] = ("user",), ts: str = "created_at",
                 delay: str = "1 hour") -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.measures, self.keys, self.ts, self.delay = list(measures), list(keys), ts, delay
        self.window = F.window(F.col(f"`{ts}`"), width, None, offset)
        empty = spark.createDataFrame([], schema)
        self._mark_type = schema[ts].dataType.simpleString()
        empty.write.mode("ignore").parquet(f"{self.root}/late/batch=-1")
        for name in ("open", "closed"):
            self._sums(empty).write.mode("ignore").parquet(f"{self.root}/{name}/batch=-1")
        self._progress(-1, None, "ignore")

    # --- what is there ---

    def progress(self) -> tuple[int, datetime | None]:
        """The last batch that is done, and the watermark after it."""
        found = self.spark.read.parquet(f"{self.root}/progress")
        return tuple(found.agg(F.max(F.struct("batch", "mark")).alias("p")).select("p.*").first())

    def late(self) -> DataFrame:
        """The rows that came too late, whole, with the ``batch`` they came in."""
        return self._done("late")

    def closed(self) -> DataFrame:
        """Keys, bucket start in the time column, sums and ``rows`` of the buckets that are final."""
        return self._result(self._done("closed"))

    def sums(self) -> DataFrame:
        """All buckets: the closed ones and, as they stand, those still open, told apart by ``closed``.

        Over all of them ``rows`` adds up to the rows that came in and are not in ``late``.
        """
        last = self.progress()[0]
        open_ = self._result(self.spark.read.parquet(f"{self.root}/open/batch={last}"))
        return self.closed().withColumn("closed", F.lit(True)).unionByName(open_.withColumn("closed", F.lit(False)))

    def _done(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch").between(0, self.progress()[0]))

    def _result(self, sums: DataFrame) -> DataFrame:
        return sums.select(*self.keys, F.col("_start").alias(self.ts), *self.measures, "rows")

    # --- what changes it ---

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of rows with the stream's columns."""
        last, mark = self.progress()
        if number <= last:
            return
        batch = batch.select(*self.schema.names).persist()
        try:
            latest = batch.agg(F.max(self.ts) - F.expr(f"INTERVAL {self.delay}")).first()[0]
            after = max((m for m in (mark, latest) if m is not None), default=None)
            # Rows without a time get no window, not even an empty one.
            bucketed = batch.withColumn("_window", self.window)
            on_time = F.lit(True) if mark is None else F.col("_window.end") > self._time(mark)
            late = bucketed.where(~on_time).drop("_window").unionByName(batch.where(F.col(self.ts).isNull()))
            late.write.mode("overwrite").parquet(f"{self.root}/late/batch={number}")
            before = self.spark.read.parquet(f"{self.root}/open/batch={last}")
            sums = before.unionByName(self._sums(bucketed.where(on_time).drop("_window"))).groupBy(*self.keys, "_start", "_end").agg(
                *[F.sum(m).alias(m) for m in self.measures], F.sum("rows").alias("rows"))
            sums = staged(sums, "bucket-sums")
            ended = F.lit(False) if after is None else F.col("_end") <= self._time(after)
            for name, which in (("closed", ended), ("open", ~ended)):
                sums.where(which).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
        finally:
            batch.unpersist()
        self._progress(number, after, "append")

    def write(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what the stream has now, batch by batch."""
        return (
            stream.writeStream.foreachBatch(self.add).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )

    def clean(self) -> None:
        """Delete the open buckets of earlier batches."""
        last = self.progress()[0]
        for row in self.spark.read.parquet(f"{self.root}/progress").select("batch").distinct().collect():
            if row[0] < last:
                delete_folder(self.spark, f"{self.root}/open/batch={row[0]}")

    def _sums(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*self.keys, self.window.alias("_window")).agg(
            *[F.sum(m).alias(m) for m in self.measures], F.count(F.lit(1)).alias("rows"))
        return sums.select(*self.keys, F.col("_window.start").alias("_start"), F.col("_window.end").alias("_end"), *self.measures, "rows")

    def _time(self, mark: datetime) -> Column:
        return F.lit(mark).cast(self._mark_type)

    def _progress(self, number: int, mark: datetime | None, mode: str) -> None:
        row = self.spark.createDataFrame([(number, mark)], f"batch long, mark {self._mark_type}")
        row.coalesce(1).write.mode(mode).parquet(f"{self.root}/progress")
