"""Joining prices with post features on time."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from crowdtape.operators.ordered import latest_row
from crowdtape.operators.scaling import min_max


# Fixed value: what the names of post features hold.
POST_FEATURES = "bigram_|unigram_|trigram_"


def columns_like(df: DataFrame, pattern: str = POST_FEATURES) -> list[str]:
    """The table's columns whose name holds a match of the pattern."""
    return [c for c in df.columns if re.search(pattern, c)]


def join_on_time(prices: DataFrame, posts: DataFrame, on: str | Sequence[str] = "timestamp",
                 fill: float | None = 0) -> DataFrame:
    """Rows with both prices and posts; NULL numbers become ``fill``."""
    joined = prices.join(posts, on, "inner")
    if fill is None:
        return joined
    numeric = [f.name for f in joined.schema.fields if isinstance(f.dataType, NumericType)]
    return joined.fillna(fill, numeric)


def on_day(df: DataFrame, day: Column, ts: str = "timestamp") -> DataFrame:
    return df.where(F.to_date(ts) == day)


def except_day(df: DataFrame, day: Column, ts: str = "timestamp") -> DataFrame:
    """Training rows: label and features are filtered together, so they cannot drift apart."""
    return df.where(F.to_date(ts) != day)


def last_day(df: DataFrame, ts: str = "timestamp") -> Column:
    """The table's last date, as a scalar."""
    return df.agg(F.max(F.to_date(ts))).scalar()


def prices_in_training(prices: DataFrame, training: DataFrame, label: str,
                       ts: str = "timestamp") -> DataFrame:
    """Unscaled prices of the times that are in the training table."""
    return prices.join(training.select(ts), ts, "left_semi").select(ts, label)


def latest_test_row(prices: DataFrame, features: DataFrame, original: DataFrame, columns: Sequence[str],
                    ts: str = "timestamp") -> DataFrame:
    """The latest prices with that date's features, scaled by the original table's limits."""
    current = latest_row(prices, ts).withColumn("date", F.to_date(ts)).drop(ts)
    joined = features.join(F.broadcast(current), "date")  # one row
    return min_max(joined, columns, reference=original)
