"""Post tables stored as one Parquet file or folder per user, in one folder per group."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crowdtape.schemas import POST, POST_API, cast_to

# group/user.parquet, where user.parquet may itself be a folder of part files.
_LAST_PARTS = r"([^/]+)/([^/]+)\.parquet(?:/[^/]+)?$"


def read_users(spark: SparkSession, *paths: str, schema: StructType | None = None) -> DataFrame:
    """Read post files with ``user`` and ``group`` taken from where each file lies."""
    reader = spark.read.option("recursiveFileLookup", True)
    files = (reader.schema(schema) if schema else reader).parquet(*paths)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        "*",
        F.regexp_extract(path, _LAST_PARTS, 2).alias("user"),
        F.regexp_extract(path, _LAST_PARTS, 1).alias("group"),
    )


def read_group(spark: SparkSession, folder: str, group: str) -> DataFrame:
    """All posts of one group."""
    return cast_to(read_users(spark, f"{folder}/{group}", schema=POST_API), POST)


def read_groups(spark: SparkSession, folder: str, groups: Sequence[str]) -> DataFrame:
    """All posts of several groups, read as one scan."""
    paths = [f"{folder}/{group}" for group in groups]
    return cast_to(read_users(spark, *paths, schema=POST_API), POST)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Union by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
