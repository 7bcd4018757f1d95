"""Sums per user and time bucket, and wide tables with one column per user."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdtape.functions.times import time_bucket

# Stands for "all users" among the pivoted values.
_EVERYONE = "\u0000all"


def bucket_sums(df: DataFrame, measures: Sequence[str], width: str, offset: str | None = None,
                index: str = "created_at", keys: Sequence[str] = ("user",)) -> DataFrame:
    """Sum of each measure per key and bucket, labelled by the bucket's left edge.

    Only buckets with rows appear. Sums combine before the shuffle, so a key that holds most rows costs
    no more than one partial sum per task and bucket.
    """
    return (
        df.withColumn(index, time_bucket(F.col(index), width, offset))
        .groupBy(*keys, index)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def user_names(df: DataFrame, user: str = "user") -> list[str]:
    """The distinct users, sorted. A pivot makes a column for each, so the list has to be short."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = [row[0] for row in df.select(user).distinct().orderBy(user).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} users to pivot; pass the users to make columns for")
    return names


def pivot_users(df: DataFrame, index: str, probabilities: Sequence[str],
                totals: Sequence[str] = (), users: Sequence[str] | None = None,
                user: str = "user") -> DataFrame:
    """One row per index value: a column per probability and user, and the totals over all users.

    ``unigram_probability`` of user CNN becomes ``unigram_CNN``; absent combinations are 0. Users and
    totals come out of the same aggregation: each summed row also counts towards "all users".
    """
    users = list(users) if users is not None else user_names(df, user)
    measures = list(dict.fromkeys([*probabilities, *totals]))
    summed = df.groupBy(index, user).agg(*[F.sum(m).alias(m) for m in measures])
    if totals:
        doubled = F.explode(F.array(F.col(user), F.lit(_EVERYONE)))
        summed = summed.withColumn(user, doubled)
    wide = (
        summed.groupBy(index)
        .pivot(user, users + ([_EVERYONE] if totals else []))
        .agg(*[F.sum(m).alias(m) for m in measures])
    )

    def pivoted(name: str, measure: str):
        # With a single measure the pivot names its columns by the value alone.
        return F.col(f"`{name}_{measure}`" if len(measures) > 1 else f"`{name}`")

    columns = [
        F.coalesce(pivoted(name, p), F.lit(0)).alias(f"{p.replace('probability', '').strip('_')}_{name}")
        for p in probabilities for name in users
    ]
    columns += [F.coalesce(pivoted(_EVERYONE, t), F.lit(0)).alias(t) for t in totals]
    return wide.select(index, *columns)
