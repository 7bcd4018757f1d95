"""Joining rows to one value per key when a few keys hold most of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A key is frequent when it holds at least 1/FREQUENT_LIMIT of all rows, so there are at most this many
# frequent keys whatever the data looks like, and every other key holds less than that share.
FREQUENT_LIMIT = 200_000


def _on(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def most_frequent(table: DataFrame, key: str, weight: str, most: int = FREQUENT_LIMIT) -> DataFrame:
    """The ``most`` keys of largest weight, the largest first, of a ``table`` that has been written."""
    whole = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    # Keys far rarer than any of them need not be sorted.
    few = table.where(F.col(weight) * F.lit(16 * most) >= F.lit(whole))
    return few.orderBy(F.desc(weight), key).limit(most).select(key)


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], weight: str,
           limit: int = FREQUENT_LIMIT, hot: Column | None = None) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row per key and its row count in ``weight``.

    The entries of frequent keys, at most ``limit`` of them, are broadcast, so rows of frequent keys are
    never shuffled and no partition of the remaining join can be dominated by one key. That join is
    asked to merge, since a table made by unrolling arrays can be far larger than Spark's estimate of it. ``hot`` says
    which keys are frequent where that is known otherwise.
    """
    on = _on(keys)
    # A join drops NULL keys; doing it up front keeps the table's plan the same in all three uses.
    table = table.where(_all_known(on))
    frequent = F.col(weight) * F.lit(limit) >= table.agg(F.sum(weight)).scalar() if hot is None else hot
    known = table.where(frequent)
    rare_rows = rows.join(F.broadcast(known.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(known), on).unionByName(
        rare_rows.join(table.where(~frequent).hint("merge"), on)
    )


def left_lookup(rows: DataFrame, table: DataFrame, keys: str | list[str],
                limit: int = FREQUENT_LIMIT) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has one row per key; unmatched rows keep NULLs.

    Frequent keys are found by counting the rows per key first, which combines before the shuffle. Rows
    with a NULL key match nothing and take no part in the join.
    """
    on = _on(keys)
    known = _all_known(on)
    counts = rows.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot_keys = counts.where(
        F.col("_rows") * F.lit(limit) >= counts.agg(F.sum("_rows")).scalar()
    ).select(*on)
    hot = table.join(F.broadcast(hot_keys), on, "left_semi")
    # A frequent key without a table entry still has to leave the shuffled side.
    marked = hot_keys.join(hot, on, "left")
    values = [c for c in table.columns if c not in on]
    unkeyed = rows.where(~known).select(
        "*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values]
    )
    return (
        rows.join(F.broadcast(marked), on)
        .unionByName(rows.where(known).join(F.broadcast(hot_keys), on, "left_anti").join(table, on, "left"))
        .unionByName(unkeyed)
    )


def _all_known(on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{key}`").isNotNull() for key in on])
