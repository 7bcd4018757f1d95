"""Tables written part-way through a job and read back.

A written table cuts the lineage, survives the loss of executors and lets every later step read only
the columns it needs.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_folder(spark: SparkSession) -> str:
    """This application's folder on storage that all executors share.

    It lies below ``spark.checkpoint.dir``, or below the warehouse where that is not set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write the table and read it back. What was shuffled for it goes as soon as it is written.

    Otherwise shuffle files stay until the driver happens to collect its garbage, and those of all steps of a job add up.
    """
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back."""
    return _written(df, new_path(df.sparkSession, name))


def release(spark: SparkSession) -> None:
    """Delete every table this application has staged; frames that still read them end with it."""
    delete_folder(spark, staging_folder(spark))


class Scope:
    """What is staged through a scope goes when the scope ends.

    ``with Scope(spark) as scope: scope.staged(df, "tokens")`` suits jobs that write their result
    before they leave the block.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = new_path(spark, "scope")

    def __enter__(self) -> "Scope":
        return self

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self._root}/{name}-{uuid.uuid4().hex}")

    def __exit__(self, *_: object) -> None:
        delete_folder(self._spark, self._root)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all below it, if it is there, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
