"""Scaling columns by figures of the whole column.

Each function measures all its columns in one aggregation. Its one row is a struct that every row of
the table gets as a scalar, in a single column that is dropped at the end.
A column without spread scales to NULL.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.operators.quantiles import approximate_quantiles, exact_quantiles


_FIGURES = "_figures"


def _replace(df: DataFrame, columns: Sequence[str], figures: DataFrame, scaled) -> DataFrame:
    """Replace columns by ``scaled(value, figures of the column)``."""
    measured = df.withColumn(_FIGURES, figures.scalar())
    return measured.withColumns({
        c: scaled(F.col(f"`{c}`"), F.col(f"{_FIGURES}.`{c}`")) for c in columns
    }).drop(_FIGURES)


def _as_struct(figures: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Turn one row per column into one row with a struct per column."""
    def of(c: str, name: str) -> Column:
        return F.max(F.when(F.col("column") == c, F.col(name))).alias(name)

    return figures.agg(F.struct(*[F.struct(*[of(c, name) for name in names]).alias(c) for c in columns]))


def to_unit_sum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by their sums."""
    sums = df.agg(F.struct(*[F.sum(f"`{c}`").alias(c) for c in columns]))
    return _replace(df, columns, sums, F.try_divide)


def logs_to_unit_sum(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """For each new column, the exponentials of a column of logarithms, divided by their sum.

    The largest logarithm is taken off first, which changes no ratio and keeps every exponential finite and
    the largest at 1, however large or small the values themselves are. A NULL logarithm stands for 0.
    """
    figures = "_largest"
    largest = df.agg(F.struct(*[F.max(f"`{log}`").alias(log) for log in columns.values()]))
    shifted = df.withColumn(figures, largest.scalar()).withColumns({
        new: F.coalesce(F.exp(F.col(f"`{log}`") - F.col(f"{figures}.`{log}`")), F.lit(0.0))
        for new, log in columns.items()
    }).drop(figures)
    return to_unit_sum(shifted, list(columns))


def min_max(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None,
            skip_zero: bool = False) -> DataFrame:
    """Columns scaled so that the smallest value of ``reference`` is 0 and its largest is 1.

    The reference is the table itself unless another one is given. ``skip_zero`` leaves zeros, which
    stand for missing prices, out of the limits.
    """
    def measured(c: str) -> Column:
        return F.nullif(F.col(f"`{c}`"), F.lit(0)) if skip_zero else F.col(f"`{c}`")

    limits = (df if reference is None else reference).agg(F.struct(*[
        F.struct(F.min(measured(c)).alias("lo"), F.max(measured(c)).alias("hi")).alias(c) for c in columns
    ]))
    return _replace(df, columns, limits, lambda x, of: F.try_divide(x - of["lo"], of["hi"] - of["lo"]))


def robust_limits(df: DataFrame, columns: Sequence[str], upper: float = 0.75,
                  lower: float = 0.25, exact: bool = True) -> DataFrame:
    """``column, median, upper_bound, lower_bound`` of the unscaled columns.

    Without ``exact`` they come from one scan and sketches, whose ranks are off by ``quantiles.RANK_ERROR`` at most.
    """
    found = exact_quantiles if exact else approximate_quantiles
    return found(df, columns, [0.5, upper, lower]).select(
        "column", F.col("q0").alias("median"), F.col("q1").alias("upper_bound"),
        F.col("q2").alias("lower_bound"),
    )


def robust_scale(df: DataFrame, columns: Sequence[str], limits: DataFrame | None = None,
                 upper: float = 0.75, lower: float = 0.25, exact: bool = True) -> DataFrame:
    """(x - median) / (upper quantile - lower quantile), by the table's own limits or by given ones."""
    limits = robust_limits(df, columns, upper, lower, exact) if limits is None else limits

    figures = _as_struct(limits, columns, ["median", "upper_bound", "lower_bound"])
    return _replace(
        df, columns, figures,
        lambda x, of: F.try_divide(x - of["median"], of["upper_bound"] - of["lower_bound"]),
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mean, std`` (sample standard deviation), one row per column."""
    def measured(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return F.struct(F.lit(c).alias("column"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))

    return df.agg(F.array(*[measured(c) for c in columns]).alias("all")).select(F.inline("all"))


def trim_quantiles(df: DataFrame, columns: Sequence[str], lower: float = 0.05,
                   upper: float = 0.95, exact: bool = True) -> DataFrame:
    """Rows whose columns all lie between their lower and upper quantile, both included.

    Without ``exact`` the quantiles come from sketches, as in ``robust_limits``.
    """
    found = exact_quantiles if exact else approximate_quantiles
    limits = _as_struct(found(df, columns, [lower, upper]), columns, ["q0", "q1"])
    kept = [F.col(f"`{c}`").between(F.col(f"{_FIGURES}.`{c}`.q0"), F.col(f"{_FIGURES}.`{c}`.q1")) for c in columns]
    return df.withColumn(_FIGURES, limits.scalar()).where(reduce(lambda a, b: a & b, kept)).drop(_FIGURES)
