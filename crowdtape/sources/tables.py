"""Parquet and CSV tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a freshly read table out over the cluster if it has fewer files than cores.

    For steps that cost much more than moving their input, such as cleaning text. A table of many files
    is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write Parquet, creating the folder; ``partition_by`` columns become folders that reads can skip.

    Rows are first brought together by folder. That is a rebalance and not a plain repartition: AQE splits
    a folder that holds much of the table over several tasks and merges small ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
