"""From price series to scaled prices joined with post features."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdtape.functions.times import last_trading_day
from crowdtape.operators.dedupe import bounded_history
from crowdtape.operators.price_joins import join_on_time, on_day
from crowdtape.operators.scaling import min_max


def historical_prices(prices: DataFrame, daily_posts: DataFrame | None, today,
                      columns: Sequence[str], ts: str = "date") -> DataFrame:
    """Prices from the first post up to today, absent prices 0, scaled to 0..1."""
    known = bounded_history(prices, daily_posts, today, ts).fillna(0, list(columns))
    return min_max(known, columns)


def todays_prices(prices: DataFrame, daily_prices: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Today's prices scaled by the limits of the daily history."""
    return min_max(prices.fillna(0, list(columns)), columns, reference=daily_prices)


def merged_history(prices: DataFrame, posts: DataFrame, on: str = "timestamp") -> DataFrame:
    return join_on_time(prices, posts, on)


def merged_today(prices: DataFrame, posts: DataFrame, today, ts: str = "timestamp") -> DataFrame:
    """Post features of the last trading day joined with that day's prices."""
    day = last_trading_day(F.to_date(F.lit(today)))
    return join_on_time(on_day(posts, day, ts), prices, ts, fill=None)
