"""Quantiles of whole columns, exact or from sketches, without sorting a column or bringing it into one task."""

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdtape.sources.staging import staged

# Each pass narrows the interval that holds a wanted rank to one of so many parts.
_PARTS = 1 << 12
# Places that the sketch before the exact passes may be off, as a share of the rows.
_ACCURACY = 10_000
_FINITE = 1.7976931348623157e308


def _part(value: Column, low: float, high: float) -> Column:
    """Which part of an interval a value lies in; the ends are always in different parts, infinities in their own."""
    low, high = (min(max(end, -_FINITE), _FINITE) for end in (low, high))
    # Halves, so that no difference of two finite numbers overflows.
    width = high / 2 - low / 2
    if width == 0:
        return (value >= F.lit(high)).cast("long")
    inside = F.floor((value / 2 - F.lit(low / 2)) / F.lit(width) * F.lit(float(_PARTS)))
    return F.when(value < F.lit(low), F.lit(-1)).when(value > F.lit(high), F.lit(_PARTS + 1)).otherwise(inside)


def _values_at(values: DataFrame, open_: list[tuple[str, float, float, int, set[int]]]) -> dict[tuple[str, int], float]:
    """The values at the given places, counted from 0, of columns in ascending order.

    ``open_`` names intervals: a column, its ends, how many values lie below it, and the places wanted in it. Values
    are counted by the part of the interval they lie in, at most ``_PARTS`` + 3 of them whatever the table's size;
    the part that holds a place is the next pass's interval, until it holds one value only.
    """
    found: dict[tuple[str, int], float] = {}
    while open_:
        tagged = []
        for i, (c, low, high, _, _) in enumerate(open_):
            value = F.col(f"`{c}`")
            tagged.append(F.when(value.between(low, high), F.struct(
                F.lit(i).alias("i"), _part(value, low, high).alias("part"), value.alias("value"))))
        parts = values.select(F.inline(F.array_compact(F.array(*tagged)))).groupBy("i", "part").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        smaller = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        wanted = F.lit(False)
        for i, (_, _, _, below, places) in enumerate(open_):
            for place in places:
                wanted |= (F.col("i") == i) & (F.col("before") <= place - below) & (F.col("before") + F.col("n") > place - below)
        narrower = []
        # One row per wanted rank at most.
        for row in placed.where(wanted).collect():
            c, _, _, below, places = open_[row["i"]]
            start = below + row["before"]
            here = {place for place in places if start <= place < start + row["n"]}
            if row["low"] == row["high"]:
                found |= {(c, place): row["low"] for place in here}
            else:
                narrower.append((c, row["low"], row["high"], start, here))
        open_ = narrower
    return found


def _brackets(values: DataFrame, rows: dict[str, int], ranks: dict[str, set[int]]) -> list[tuple[str, float, float, int, set[int]]]:
    """Narrow intervals that hold the wanted places: two values of a sketch around each, and a count of what lies below.

    A sketch is off by rows / _ACCURACY places at most, so the interval holds about 4 / _ACCURACY of the rows. Its
    ends are values of the column, and the counts say for certain which places lie in it.
    """
    def around(c: str, place: int) -> list[float]:
        share, slack = place / max(1, rows[c] - 1), 2 / _ACCURACY
        return [max(0.0, share - slack), min(1.0, share + slack)]

    wanted = [(c, place) for c in ranks for place in sorted(ranks[c])]
    sketched = values.agg(*[
        F.percentile_approx(f"`{c}`", [s for place in sorted(ranks[c]) for s in around(c, place)], _ACCURACY) for c in ranks]).first()
    ends = {c: list(sketched[i]) for i, c in enumerate(ranks)}
    intervals: dict[tuple[str, float, float], set[int]] = {}
    for c, place in wanted:
        at = 2 * sorted(ranks[c]).index(place)
        intervals.setdefault((c, ends[c][at], ends[c][at + 1]), set()).add(place)
    counts = values.agg(*[
        F.struct(F.count_if(F.col(f"`{c}`") < low), F.count_if(F.col(f"`{c}`") <= high)) for c, low, high in intervals]).first()
    return [(c, low, high, counts[i][0], {p for p in places if counts[i][0] <= p < counts[i][1]})
            for i, ((c, low, high), places) in enumerate(intervals.items())]


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, NaN as NULL."""
    return df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``column, rows, q0, q1, ...``: linearly interpolated quantiles of each column, NULL and NaN ignored.

    The quantiles are found when the function is called. The columns are written once and read from there: once to
    count, once for a sketch that says where to look, then by ever smaller parts of what it leaves. A column
    without values has no row.
    """
    values = staged(_numbers(df, columns), "quantile-columns")
    counted = values.agg(*[F.count(f"`{c}`") for c in columns]).first()
    rows = {c: n for c, n in zip(columns, counted) if n}
    ranks = {c: {place(share * (n - 1)) for share in shares for place in (floor, ceil)} for c, n in rows.items()}
    found = _values_at(values, _brackets(values, rows, ranks)) if rows else {}

    def quantile(c: str, share: float) -> float:
        position = share * (rows[c] - 1)
        low, high = found[c, floor(position)], found[c, ceil(position)]
        return low if low == high else low + (position - floor(position)) * (high - low)

    schema = "column string, rows bigint" + "".join(f", q{i} double" for i in range(len(shares)))
    return df.sparkSession.createDataFrame(
        [(c, n, *[quantile(c, share) for share in shares]) for c, n in rows.items()], schema)


# --- sketches ---

# The size of a sketch: k of 4,096 keeps it below 50 KB and its ranks within RANK_ERROR of all rows.
SKETCH_SIZE, RANK_ERROR = 4096, 0.002


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """``by``, ``column`` and ``sketch``: what is needed to tell any quantile of a column, in one scan.

    Sketches are small whatever they stand for and can be stored, so days can be sketched as they arrive and merged
    when a longer time is asked for. NULL and NaN are left out; a column without values has no sketch.
    """
    numbers = df.select(*by, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    made = numbers.groupBy(*by).agg(*[F.kll_sketch_agg_double(f"`{c}`", F.lit(size)).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("sketch")) for c in columns])
    long = made.select(*by, F.inline(each))
    return long.where(F.kll_sketch_get_n_double("sketch") > 0)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per ``by`` and column, of all rows that the merged ones stand for."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``rows``, ``q0``, ``q1``, ...: stored values whose rank is off by RANK_ERROR of the rows at most.

    The error is that of the sketch's size (99 % confidence, for all quantiles of a sketch of SKETCH_SIZE together).
    """
    return sketches.select(*by, "column", F.kll_sketch_get_n_double("sketch").alias("rows"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias(f"q{i}") for i, share in enumerate(shares)])


def approximate_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], size: int = SKETCH_SIZE) -> DataFrame:
    """As ``exact_quantiles``, from one scan and to within the sketch's rank error."""
    return sketched_quantiles(quantile_sketches(df, columns, size=size), shares)
