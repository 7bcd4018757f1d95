"""Operators that depend on row order: numbering, sliding frames, targets, latest row, forward fill.

A series may hold most of the table, so no window spans a whole series. Rows are ordered within slots, and only
one figure per slot is carried along the series. A slot is an hour; where an hour of one series holds too many
rows for one task, slots are ranges of rows of about equal size instead.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import MapType, VariantType

from crowdtape.functions.times import time_bucket
from crowdtape.sources.staging import staged


# Rows of one series and hour that one task may sort.
SLOT_ROWS = 1_000_000


def in_slots(df: DataFrame, keys: Sequence[str], ts: str, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``_slot``, which rises with time within each series and holds no more than about ``slot_rows`` of it.

    Hours serve while they are small enough, which one count decides. Otherwise the rows are dealt into ranges of
    (keys, time) and written; a range is what Spark makes a shuffle partition, or smaller. Rows of one time that
    are more than a range holds are told apart by a hash of the row.
    """
    hour = time_bucket(F.col(ts), "1 hour")
    largest = df.groupBy(*keys, hour.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (largest[0] or 0) <= slot_rows:
        return df.withColumn("_slot", hour)
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    ranged = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(
        -(-largest[1] // slot_rows), *[F.col(f"`{k}`") for k in keys], F.col(f"`{ts}`"), F.col("_tie"))
    return staged(ranged.drop("_tie").withColumn("_slot", F.spark_partition_id()), "slots")


def number_rows(slotted: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in the given order.

    ``slotted`` has ``_slot``, a coarse, order-preserving value of the order, as ``in_slots`` adds it, and loses it.
    Rows are numbered within (key, slot); the earlier slots' row counts are added.
    """
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_slot").orderBy(*order)
    return (
        slotted.withColumn(name, F.row_number().over(within))
        .join(starts, [*keys, "_slot"])
        .withColumn(name, F.col("_start") + F.col(name))
        .drop("_slot", "_start")
    )


def sliding_blocks(numbered: DataFrame, before: int, after: int, size: int = 100_000,
                   position: str = "position") -> DataFrame:
    """Cut numbered series into blocks, with the neighbours' edge rows copied in.

    Adds ``block`` and ``own``: a frame of ``before`` rows back and ``after`` rows ahead, ordered by
    position within (key, block), is complete for every row whose ``own`` is true.
    """
    at = F.col(position) - 1
    first = F.greatest(F.floor((at - after) / size), F.lit(0).cast("bigint"))
    last = F.floor((at + before) / size)
    copies = numbered.withColumn("block", F.explode(F.sequence(first, last)))
    return copies.withColumn("own", F.col("block") == F.floor(at / size))


def binary_target(prices: DataFrame, key: str = "ticker", ts: str = "ts", price: str = "price",
                  day: int = 5, shift: int = -1, incomplete: int | None = 0,
                  block_size: int = 100_000, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``window_mean`` and ``y``: 1 where the price exceeds the mean of a ``day``-row window.

    The window ends ``shift`` rows back; the default -1 ends it one row ahead, so the label uses the next
    price, and ``shift=1`` uses past rows only. Rows without a full window get ``incomplete``, and so do
    rows without key or time, which are in no series.
    """
    back, ahead = shift + day - 1, -shift
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    numbered = number_rows(in_slots(prices.where(placed), [key], ts, slot_rows), [key], [ts])
    blocks = sliding_blocks(numbered, max(back, 0), max(ahead, 0), block_size)
    frame = Window.partitionBy(key, "block").orderBy("position").rowsBetween(-back, ahead)
    full = (F.col("position") >= day) & (F.count(price).over(frame) == day)
    means = blocks.withColumn("window_mean", F.when(full, F.avg(price).over(frame))).where("own")
    y = F.when(F.col("window_mean").isNull(), F.lit(incomplete)).otherwise(
        (F.col(price) > F.col("window_mean")).cast("int")
    )
    outside = prices.where(~placed).withColumns(
        {"window_mean": F.lit(None).cast("double"), "y": F.lit(incomplete).cast("int")})
    return means.withColumn("y", y.cast("int")).drop("block", "own", "position").unionByName(outside)


def latest_row(df: DataFrame, ts: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the latest time; the largest ``ties`` columns decide among equals."""
    order = F.struct(ts, *ties)
    return df.agg(F.max_by(F.struct("*"), order).alias("row")).select("row.*")


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str,
                 slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Replace NULLs by the last value before them in the key's series.

    Rows without a key or time are in no series and stay as they are.
    """
    keys = list(keys)
    placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, ts]])
    slotted = in_slots(df.where(placed), keys, ts, slot_rows)
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slotted.groupBy(*keys, "_slot").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_{c}") for c in columns
    ]).select(*keys, "_slot", *[F.last(f"_{c}", True).over(earlier).alias(f"_{c}") for c in columns])
    so_far = Window.partitionBy(*keys, "_slot").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slotted.withColumns({c: F.last(c, True).over(so_far) for c in columns})
        .join(carried, [*keys, "_slot"])
        .withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
        .select(*df.columns)
        .unionByName(df.where(~placed))
    )


def dense_ids(df: DataFrame, order: Sequence[str], name: str = "ID") -> DataFrame:
    """Number the rows 1, 2, 3, ... in the given order.

    The table is range-partitioned and sorted, numbered within its partitions and written once, so that
    the partition sizes added to the numbers belong to the very same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = staged(ranged.withColumn("_mark", F.monotonically_increasing_id()), "dense-ids")
    # The mark holds the partition above bit 33 and the row within it below.
    part, row = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumns({"_part": part, "_row": row})
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )  # one row per partition
    return marked.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_row") + 1).alias(name), *df.columns
    )
