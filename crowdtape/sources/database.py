"""Database tables over JDBC. Rows travel between executors and database, never through the driver."""

from pyspark.sql import DataFrame, SparkSession

# Fixed value: rows per insert batch.
BATCH_ROWS = 10_000


def append_to_database(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
                       batch_rows: int = BATCH_ROWS) -> None:
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_rows))
    writer.options(**(properties or {})).mode("append").save()


def read_from_database(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
                       partition_column: str | None = None, bounds: tuple[int, int] | None = None,
                       partitions: int | None = None) -> DataFrame:
    """Read a table; with a partition column and its bounds, over several connections."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column and bounds and partitions:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()
