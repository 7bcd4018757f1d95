"""Regular time grids, and tables filled up to them."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from crowdtape.functions import times as t

_STRIDE = 10_000


def _numeric(df: DataFrame, index: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != index and isinstance(f.dataType, NumericType)]


def regular_grid(df: DataFrame, step_seconds: int, index: str = "created_at") -> DataFrame:
    """Every step from the table's first to its last time.

    Only the two ends come from the table. The grid is numbered in strides, and the strides are spread
    over the cluster before they are unrolled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    ends = df.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).where(F.col("lo").isNotNull())
    steps = F.floor(F.timestamp_diff("SECOND", "lo", "hi") / step_seconds)
    strides = ends.select(
        "lo", steps.alias("steps"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), steps, F.lit(_STRIDE).cast("bigint"))).alias("first"),
    )
    numbers = F.sequence("first", F.least(F.col("first") + (_STRIDE - 1), F.col("steps")))
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step_seconds))
    return (
        strides.repartition(tasks, "first")
        .select("lo", F.explode(numbers).alias("number"))
        .select((F.col("lo") + width * F.col("number")).alias(index))
    )


def fill_steps(df: DataFrame, step_seconds: int, fill: float = 0, index: str = "created_at") -> DataFrame:
    """Put a time-keyed table on its regular grid; only rows the table lacks get the fill value."""
    numeric = _numeric(df, index)
    grid = regular_grid(df, step_seconds, index)
    joined = grid.join(df.withColumn("_present", F.lit(True)), index, "left")

    def filled(name: str) -> Column:
        value = F.lit(fill).cast(df.schema[name].dataType)
        return F.when(F.col("_present"), F.col(f"`{name}`")).otherwise(value).alias(name)

    return joined.select(*[filled(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])


def fill_openings(df: DataFrame, hour: int = 13, minute: int = 30, fill: float = 0,
                  index: str = "created_at") -> DataFrame:
    """Add a row at the opening time of every day between the first and the last, and fill all NULLs.

    The opening times present, at most one per day, are broadcast; the table itself is not shuffled.
    """
    ends = df.agg(F.min(F.to_date(index)).alias("lo"), F.max(F.to_date(index)).alias("hi"))
    days = ends.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    openings = days.select(t.at_time(F.col("day"), hour, minute).cast(df.schema[index].dataType).alias(index))
    present = df.where(F.col(index) == t.at_time(F.col(index), hour, minute)).select(index).distinct()
    missing = openings.join(F.broadcast(present), index, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True).fillna(fill, _numeric(df, index))


def trading_calendar(df: DataFrame, index: str = "timestamp", days: int | None = 7,
                     months: int | None = None, start: str = t.MARKET_OPEN, end: str = t.MARKET_CLOSE,
                     offset_minutes: int = 30, weekdays_only: bool = False) -> DataFrame:
    """Hourly market times that follow the table's last day, which is included.

    Covers that day and ``days`` more, or the days before the same date ``months`` later.
    """
    first = df.agg(F.max(F.to_date(index)).alias("first")).where(F.col("first").isNotNull())
    after = F.add_months("first", F.lit(months)) if months else F.date_add("first", days + 1)
    listed = first.select(F.explode(F.sequence("first", F.date_sub(after, 1))).alias("day"))
    if weekdays_only:
        listed = listed.where(~t.on_days(F.col("day"), t.WEEKEND))
    hours = listed.select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.col("hour"), F.lit(offset_minutes)
    )
    return hours.select(at.alias("timestamp")).where(t.between_times(F.col("timestamp"), start, end))
