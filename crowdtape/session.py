"""Session settings the library is written for."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers on other machines find it there if it is installed at the same place; otherwise send it
    with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


def build_session(app_name: str = "crowdtape", master: str | None = None,
                  shuffle_partitions: int | None = None, shared_folder: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution on.

    Nothing that depends on the cluster's size is set unless the caller asks for it: on a cluster
    the initial shuffle partition count comes from its own configuration and AQE coalesces it.
    ``shared_folder`` is where tables are written part-way; a cluster names it in its own configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("CROWDTAPE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared_folder:
        builder = builder.config("spark.checkpoint.dir", shared_folder)
    return builder.getOrCreate()
