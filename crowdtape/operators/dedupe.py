"""Loading new rows next to stored ones: high watermarks, upserts, bounds and cuts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# Fixed value: the start of history when nothing is stored yet.
FIRST_DATE = "2000-01-01"


def keep_last(df: DataFrame, keys: str | Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key: the first in the given order. Each task drops all but one before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranks = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranks)).where("_rank = 1").drop("_rank")


def assemble_posts(posts: DataFrame, key: str = "id", arrival: str = "arrival",
                   ts: str = "created_at") -> DataFrame:
    """Distinct posts, the last arrival of each, newest first."""
    return keep_last(posts, key, F.desc(arrival)).orderBy(F.desc(ts), F.desc(key))


def newer_rows(landed: DataFrame, history: DataFrame, key: str = "id", owner: str = "user") -> DataFrame:
    """Landed rows whose id exceeds the owner's largest stored id; owners without history keep all."""
    marks = history.groupBy(owner).agg(F.max(key).alias("_mark"))
    newer = landed.join(marks, owner, "left").where(F.col("_mark").isNull() | (F.col(key) > F.col("_mark")))
    return newer.select(*landed.columns)


def append_newer(history: DataFrame, landed: DataFrame, order: Sequence[Column], key: str = "id",
                 owner: str = "user") -> DataFrame:
    """History and the newer landed rows, one row per id: the first in ``order``, such as the last arrival."""
    newer = keep_last(newer_rows(landed, history, key, owner), key, *order)
    return history.unionByName(newer, allowMissingColumns=True)


def upsert(history: DataFrame, new: DataFrame, order: Sequence[Column], key: str = "id",
           distinct_history: bool = False) -> DataFrame:
    """History and new rows, one row per key; new rows win, and among them the first in ``order``.

    ``distinct_history`` says that the history already has one row per key, as the result of an upsert
    has. Then only the stored rows whose key arrived again are taken out, and if the new keys are few
    enough for Spark to broadcast, the history is not shuffled.
    """
    if distinct_history:
        latest = keep_last(new, key, *order)
        kept = history.join(latest.select(key), key, "left_anti")
        return kept.unionByName(latest, allowMissingColumns=True)
    both = history.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, key, F.desc("_batch"), *order).drop("_batch")


def load_counts(history: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys are new, and how many there are in total."""
    flags = history.select(key, F.lit(True).alias("old")).unionByName(new.select(key, F.lit(False).alias("old")))
    seen = flags.groupBy(key).agg(F.max("old").alias("old"))
    return seen.agg(F.count_if(~F.col("old")).alias("new_rows"), F.count(F.lit(1)).alias("total_rows"))


def key_range(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.min(key).alias("oldest"), F.max(key).alias("newest"))


def bounded_history(prices: DataFrame, posts: DataFrame | None, upto, ts: str = "date",
                    post_date: str = "date") -> DataFrame:
    """Prices from the first post's date on, and before ``upto``."""
    first = F.to_date(F.lit(FIRST_DATE))
    if posts is not None:
        first = F.coalesce(F.to_date(posts.agg(F.min(post_date)).scalar()), first)
    return prices.where((F.to_date(ts) >= first) & (F.to_date(ts) < F.to_date(F.lit(upto))))


def since(df: DataFrame, howfar: str, ts: str = "created_at") -> DataFrame:
    """Rows after a date. The bound has the column's own type, so it reaches the Parquet reader."""
    return df.where(F.col(ts) > F.lit(howfar).cast(df.schema[ts].dataType))
