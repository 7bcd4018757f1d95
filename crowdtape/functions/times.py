"""Column functions on timestamps.

Timestamps without zone hold UTC unless a function says that it returns local wall-clock time.
"""

from pyspark.sql import Column, DataFrame, functions as F

# The market's zone and hours.
UTC = "UTC"
MARKET_ZONE = "America/New_York"
MARKET_OPEN = "09:30:00"
MARKET_CLOSE = "15:30:00"

SATURDAY, SUNDAY, MONDAY, FRIDAY = 7, 1, 2, 6  # as dayofweek() numbers them
WEEKEND = (SATURDAY, SUNDAY)


def time_bucket(ts: Column, width: str, offset: str | None = None) -> Column:
    """Left edge of the bucket that holds ``ts``; buckets start ``offset`` after the full width."""
    return F.window(ts, width, None, offset)["start"]


def to_zone(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """UTC to local wall clock."""
    return F.convert_timezone(F.lit(UTC), F.lit(zone), ts.cast("timestamp_ntz"))


def from_zone(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """Local wall clock to UTC."""
    return F.convert_timezone(F.lit(zone), F.lit(UTC), ts.cast("timestamp_ntz"))


def at_time(ts: Column, hour: int, minute: int = 0) -> Column:
    """The same day at a given time of day."""
    midnight = F.to_date(ts).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))


def next_day_same_time(ts: Column) -> Column:
    """One calendar day later, whatever the clock did overnight."""
    return ts.cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))


def monday_label(ts: Column) -> Column:
    """The Monday that ends the week of ``ts``: weeks run Tuesday to Monday."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "MON")


def on_days(ts: Column, days: tuple[int, ...]) -> Column:
    return F.dayofweek(ts).isin(*days)


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def between_times(ts: Column, start: str, end: str) -> Column:
    """Time of day within a range of ``HH:mm:ss`` values, both ends included."""
    def since_midnight(clock: str) -> Column:
        return F.make_dt_interval(F.lit(0), *[F.lit(int(part)) for part in clock.split(":")])

    elapsed = ts.cast("timestamp_ntz") - F.to_date(ts).cast("timestamp_ntz")
    return elapsed.between(since_midnight(start), since_midnight(end))


def last_trading_day(day: Column) -> Column:
    """Saturday and Sunday give the Friday before; other days themselves."""
    weekday = F.dayofweek(day)
    back = F.when(weekday == SATURDAY, 1).when(weekday == SUNDAY, 2).otherwise(0)
    return F.date_sub(F.to_date(day), back)


def next_weekday(day: Column) -> Column:
    """Saturday and Sunday give the Monday after; other days themselves."""
    weekday = F.dayofweek(day)
    ahead = F.when(weekday == SATURDAY, 2).when(weekday == SUNDAY, 1).otherwise(0)
    return F.date_add(F.to_date(day), ahead)


def split_timestamp(df: DataFrame, ts: str = "timestamp", zone: str = UTC) -> DataFrame:
    """Add the calendar parts of a timestamp as columns."""
    at = F.col(ts)
    return df.withColumns({
        "timezone": F.lit(zone),
        "date": F.to_date(at),
        "time": time_of_day(at),
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
        "minute": F.minute(at),
        "second": F.second(at),
    })
