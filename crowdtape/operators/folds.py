"""Moving weekend and out-of-hours activity into market time.

Every fold rewrites the time key of each row and sums once per key, so a chain of folds needs a single
sum at its end.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.functions import times as t
from crowdtape.operators.buckets import bucket_sums

# Fixed value: the market opens at 13:30 UTC while daylight saving time is in force.
OPEN_HOUR_UTC, OPEN_MINUTE_UTC = 13, 30


def weekend_day_key(day: Column, days: Sequence[int] = (t.SATURDAY, t.SUNDAY, t.MONDAY)) -> Column:
    """The day itself, or the Monday that ends its week for the given days."""
    return F.when(t.on_days(day, days), t.monday_label(day)).otherwise(F.to_date(day))


def weekend_open_key(ts: Column, days: Sequence[int] = t.WEEKEND, hour: int = OPEN_HOUR_UTC,
                     minute: int = OPEN_MINUTE_UTC) -> Column:
    """The timestamp itself, or Monday at opening time for the given days."""
    monday_open = t.at_time(t.monday_label(ts), hour, minute)
    return F.when(t.on_days(ts, days), monday_open).otherwise(ts.cast("timestamp_ntz"))


def market_keys(local: Column, day_start: str = "00:00:00", work_start: str = t.MARKET_OPEN,
                work_end: str = t.MARKET_CLOSE, day_end: str | None = None, boundary: str = "both",
                next_trading_day: bool = False) -> Column:
    """Array of the market times a local timestamp counts towards.

    Within working hours that is the time itself, before them the day's opening, after them the next
    day's opening. The first and last working time lie on both sides of their boundary and count twice;
    ``boundary="once"`` counts them as working hours only. ``next_trading_day`` moves openings on a
    weekend to the Monday after.
    """
    hour, minute = (int(part) for part in work_start.split(":")[:2])
    working = t.between_times(local, work_start, work_end)
    early = t.between_times(local, day_start, work_start)
    # To midnight unless the day ends earlier, so that no time of day is lost.
    late = t.between_times(local, work_end, day_end or "24:00:00")
    if boundary == "once":
        early, late = early & ~working, late & ~working
    next_open = t.at_time(t.next_day_same_time(local), hour, minute)
    if next_trading_day:
        next_open = t.at_time(t.next_weekday(next_open), hour, minute)
    return F.array_compact(F.array(
        F.when(working, local),
        F.when(early, t.at_time(local, hour, minute)),
        F.when(late, next_open),
    ))


def _sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def _with_empty_weeks(df: DataFrame, index: str, folded: Column, keys: Sequence[str],
                      measures: Sequence[str], label) -> DataFrame:
    """Add a zero row for every week between a key's first and last folded one."""
    mondays = (
        df.where(folded).groupBy(*keys)
        .agg(F.min(t.monday_label(F.col(index))).alias("lo"), F.max(t.monday_label(F.col(index))).alias("hi"))
        .where(F.col("lo").isNotNull())
        .select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAY"))).alias("monday"))
        .select(*keys, label(F.col("monday")).cast(df.schema[index].dataType).alias(index))
    )
    zeros = [F.lit(0).cast(df.schema[m].dataType).alias(m) for m in measures]
    return df.unionByName(mondays.select(*keys, index, *zeros))


def _with_empty_days(df: DataFrame, keys: Sequence[str], measures: Sequence[str], work_start: str) -> DataFrame:
    """Add a zero row at every opening between a key's first and last one."""
    hour, minute = (int(part) for part in work_start.split(":")[:2])
    day = F.to_date("timestamp")
    openings = (
        df.where(F.col("timestamp") == t.at_time(day, hour, minute)).groupBy(*keys)
        .agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where(F.col("lo").isNotNull())
        .select(*keys, F.explode(F.sequence("lo", "hi")).alias("day"))
        .select(*keys, t.at_time(F.col("day"), hour, minute).cast(df.schema["timestamp"].dataType).alias("timestamp"))
    )
    return df.unionByName(openings.select(
        "*", *[F.lit(0).cast(df.schema[m].dataType).alias(m) for m in measures]))


def fold_weekend_by_day(df: DataFrame, measures: Sequence[str], index: str = "date",
                        keys: Sequence[str] = (), days: Sequence[int] = (t.SATURDAY, t.SUNDAY, t.MONDAY),
                        emit_empty: bool = False) -> DataFrame:
    """Daily rows with Saturday and Sunday summed into Monday."""
    df = df.select(*keys, index, *measures)
    if emit_empty:
        df = _with_empty_weeks(df, index, t.on_days(F.col(index), days), keys, measures, lambda m: m)
    return _sum_by(df.withColumn(index, weekend_day_key(F.col(index), days)), [*keys, index], measures)


def fold_weekend_by_time(df: DataFrame, measures: Sequence[str], index: str = "created_at",
                         keys: Sequence[str] = (), days: Sequence[int] = t.WEEKEND,
                         hour: int = OPEN_HOUR_UTC, minute: int = OPEN_MINUTE_UTC,
                         emit_empty: bool = False) -> DataFrame:
    """Intraday rows with Saturday and Sunday summed into Monday's opening."""
    df = df.select(*keys, index, *measures)
    if emit_empty:
        df = _with_empty_weeks(df, index, t.on_days(F.col(index), days), keys, measures,
                               lambda m: t.at_time(m, hour, minute))
    folded = df.withColumn(index, weekend_open_key(F.col(index), days, hour, minute))
    return _sum_by(folded, [*keys, index], measures)


def fold_market_hours(df: DataFrame, measures: Sequence[str], index: str = "created_at",
                      keys: Sequence[str] = (), zone: str = t.MARKET_ZONE, emit_empty: bool = False,
                      work_start: str = t.MARKET_OPEN, **hours) -> DataFrame:
    """Rows in UTC summed into market hours; ``timestamp`` is local wall-clock time.

    ``emit_empty`` adds a zero row at the opening of every day between a key's first and last opening that
    has rows. The other ``hours`` are the options of ``market_keys``.
    """
    local = df.select(*keys, t.to_zone(F.col(index), zone).alias("_local"), *measures)
    keyed = local.select(
        *keys, F.explode(market_keys(F.col("_local"), work_start=work_start, **hours)).alias("timestamp"), *measures)
    if emit_empty:
        keyed = _with_empty_days(keyed, keys, measures, work_start)
    return _sum_by(keyed, [*keys, "timestamp"], measures)


def posts_to_market_time(posts: DataFrame, measures: Sequence[str], width: str, offset: str | None = None,
                         index: str = "created_at", keys: Sequence[str] = ("user",),
                         **hours) -> DataFrame:
    """Raw rows to bucket sums, and those through both folds in one further sum.

    Zones and folds are worked out per bucket rather than per post.
    """
    sums = bucket_sums(posts, measures, width, offset, index, keys)
    return fold_market_hours(sums.withColumn(index, weekend_open_key(F.col(index))), measures, index, keys, **hours)
