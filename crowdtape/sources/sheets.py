"""Small input sheets: user handles by group, and ticker labels."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header, every cell a string."""
    return spark.read.option("header", True).csv(path)


def handles_long(sheet: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """``group, user`` of a sheet with one column per group; empty cells are left out."""
    groups = list(groups or sheet.columns)
    return sheet.unpivot([], groups, "group", "user").where(F.coalesce("user", F.lit("")) != "")


def ticker_labels(sheet: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Ticker name -> label for the given names, such as a table's columns; no more rows than names are fetched.

    Of several labels for one name the first in order counts.
    """
    labels = sheet.where(F.col("ticker_name").isin(list(names))).groupBy("ticker_name").agg(
        F.min("ticker_label").alias("ticker_label")).where(F.col("ticker_label").isNotNull())
    return {row["ticker_name"]: row["ticker_label"] for row in labels.collect()}


def label_columns(prices: DataFrame, labels: dict[str, str], time_names: dict[str, str] | None = None) -> DataFrame:
    """Rename ticker columns to their labels and the time column to its name here."""
    names = {"Date": "date", "Datetime": "timestamp"} if time_names is None else time_names
    return prices.withColumnsRenamed({**names, **labels})


def label_rows(prices: DataFrame, sheet: DataFrame, ticker: str = "ticker_name") -> DataFrame:
    """Add the label to long prices; Spark broadcasts the sheet if its size allows."""
    return prices.join(sheet, ticker, "left")
