"""The star schema load after load: users with their past, facts and dates merged into the days they belong to.

A load has a number and a time. It writes folders of its own for what it adds to users and mentions, replaces the
days its posts fall on, and takes effect with a marker written last. Sent again, it changes nothing; begun again after
a failure, it does over what it had left, with the same result.
"""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crowdtape.operators.dedupe import keep_last
from crowdtape.operators.ordered import dense_ids
from crowdtape.plans.star_schema import date_dim, fact_posts, user_mentions
from crowdtape.sources.staging import delete_folder, staged

_USER = ["twitter_user", "twitter_group"]
_VERSIONS = ("ID long, twitter_user string, twitter_group string, version long, n_mentions long, "
             "valid_from timestamp, load long")
_MENTIONS = "twitter_user string, twitter_group string, mentioned_users string, seen timestamp, load long"
# Rows of a day that one task writes.
ROWS_PER_SLOT = 1 << 16


# --- merging into days ---

def merge_days(spark: SparkSession, path: str, new: DataFrame, keys: str | Sequence[str], day: str = "date",
               days_fixed: bool = False) -> list:
    """Merge rows into a table with a folder per day: one row per key, and the new row wins. Returns the days written.

    ``new`` has one row per key and is read several times, mostly its keys, so it should come from written rows. Only
    the days that new rows fall on are read whole and written, and days that hold an old row of a key which has moved to
    another day; to find these, the stored keys are read, which ``days_fixed`` saves where a key's day never changes.
    Rows pass from the old days to the new ones without being written between: folders are replaced when all are read.
    Old rows move once, by day and slot; the keys that replace some come to them, in no more than the rows of a slot.
    A merge that broke off is made good by doing it again.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    days = _by_day(new, day)
    filled, rows = set(days), new.hint("rebalance", day)
    days = set(days)
    if _exists(spark, path):
        stored = spark.read.schema(new.schema).parquet(path).select(*new.columns)
        replaced, lost = new.select(*keys, day), {}
        if not days_fixed:
            replaced = stored.select(*keys, day).join(new.select(*keys), keys, "left_semi")
            lost = _by_day(replaced, day)
            days |= set(lost)
        touched = stored.where(_in_days(day, days))
        held = _by_day(touched, day)
        filled |= {d for d, n in held.items() if n > lost.get(d, 0)}
        slots = max(1, -(-max(held.values(), default=0) // ROWS_PER_SLOT))

        def dealt(df: DataFrame) -> DataFrame:
            named = df.withColumns({"_day": F.coalesce(F.col(day).cast("string"), F.lit("")),
                                    "_slot": F.pmod(F.xxhash64(*keys), F.lit(slots))})
            return named.repartition(max(1, len(held) * slots), "_day", "_slot")

        gone = dealt(replaced).select("_day", "_slot", *keys).hint("shuffle_hash")
        kept = dealt(touched).join(gone, ["_day", "_slot", *keys], "left_anti").select(*new.columns)
        rows = kept.unionByName(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    # Overwriting by folder leaves alone a day that has lost its last row.
    for gone in days - filled:
        delete_folder(spark, f"{path}/{day}={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone}")
    return sorted(days, key=str)


def _by_day(rows: DataFrame, day: str) -> dict:
    return dict(tuple(row) for row in rows.groupBy(day).agg(F.count(F.lit(1))).collect())


def _in_days(day: str, days: set) -> Column:
    inside = F.col(day).isin([d for d in days if d is not None])
    return inside | F.col(day).isNull() if None in days else inside


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def _single(posts: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row per id, written. Where no id comes twice, which its ids alone tell, whole posts are not sorted for it."""
    posts = staged(posts, "loaded-posts")
    twice = staged(posts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    if twice.isEmpty():
        return posts
    again = keep_last(posts.join(twice, "id", "left_semi").select(*posts.columns), "id", *order)
    return staged(posts.join(twice, "id", "left_anti").select(*posts.columns).unionByName(again), "single-posts")


# --- the store ---

class StarStore:
    """User versions, mentions, dates and facts below a folder that all executors share.

    A user's row gets a new version whenever a load brings mentions that were not known; the key stays, so facts
    never change their user. Mentions are rows of their own, so neither a user's posts nor their mentions are ever
    gathered. One load at a time, numbered upwards.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in (("users", _VERSIONS), ("mentions", _MENTIONS)):
            empty = spark.createDataFrame([], schema).drop("load")
            empty.write.mode("ignore").parquet(f"{self.root}/{name}/load=-1")
        spark.createDataFrame([], "load long").write.mode("ignore").parquet(f"{self.root}/loads")

    def last_load(self) -> int:
        return self.spark.read.schema("load long").parquet(f"{self.root}/loads").agg(F.coalesce(F.max("load"), F.lit(-1))).first()[0]

    def _rows(self, name: str, schema: str, upto: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("load") <= upto)

    def mentions(self) -> DataFrame:
        """``twitter_user, twitter_group, mentioned_users, seen``: each mention once, with the time of its first load."""
        return self._rows("mentions", _MENTIONS, self.last_load()).drop("load")

    def user_versions(self) -> DataFrame:
        """``ID, twitter_user, twitter_group, version, n_mentions, valid_from, valid_to``; the current one is open."""
        return self._versions(self.last_load()).drop("load")

    def _versions(self, upto: int) -> DataFrame:
        after = Window.partitionBy("ID").orderBy("version")
        return self._rows("users", _VERSIONS, upto).withColumn("valid_to", F.lead("valid_from").over(after))

    def users(self) -> DataFrame:
        """``ID, twitter_user, twitter_group``, one row per user."""
        return self._rows("users", _VERSIONS, self.last_load()).where("version = 1").select("ID", *_USER)

    def mentions_of_versions(self) -> DataFrame:
        """``ID, version, mentioned_users``: what each version of a user knew, a row per mention."""
        last = self.last_load()
        versions = self._rows("users", _VERSIONS, last).select("ID", *_USER, "version", F.col("load").alias("_load"))
        known = versions.join(self._rows("mentions", _MENTIONS, last), _USER).where("load <= _load")
        return known.select("ID", "version", "mentioned_users")

    def facts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/facts")

    def dates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dates")

    def load(self, posts: DataFrame, number: int, at: datetime, order: Sequence[Column],
             days_fixed: bool = False, many_users: bool = False) -> bool:
        """Add a load of posts; False if it has been added before, an error if a later one has.

        ``order`` decides among rows of one post in this load; posts without id are left out. A post that was loaded
        before is replaced, in the folder of its day, and the days of no post are not touched.
        """
        last = self.last_load()
        if number == last:
            return False
        if number < last:
            raise ValueError(f"load {number} comes after load {last}")
        posts = _single(posts.where("id IS NOT NULL"), order)
        self._load_users(posts, number, last, at)
        users = self._rows("users", _VERSIONS, number).where("version = 1").select("ID", *_USER)
        facts = fact_posts(posts.withColumn("date", F.to_date("created_at")), users, many_users, extra=["date"])
        merge_days(self.spark, f"{self.root}/facts", facts, "twitter_id", days_fixed=days_fixed)
        merge_days(self.spark, f"{self.root}/dates", date_dim(posts), "twitter_id", days_fixed=days_fixed)
        self.spark.createDataFrame([(number,)], "load long").coalesce(1).write.mode("append").parquet(f"{self.root}/loads")
        return True

    def _load_users(self, posts: DataFrame, number: int, last: int, at: datetime) -> None:
        time = F.lit(at).cast("timestamp")
        found = staged(user_mentions(posts), "found-mentions")
        known = self._rows("mentions", _MENTIONS, last).select(*_USER, "mentioned_users")
        fresh = found.where("mentioned_users <> ''").join(known, [*_USER, "mentioned_users"], "left_anti")
        fresh.withColumn("seen", time).write.mode("overwrite").parquet(f"{self.root}/mentions/load={number}")
        fresh = self.spark.read.schema(_MENTIONS).parquet(f"{self.root}/mentions/load={number}")

        gained = found.select(*_USER).distinct().join(
            fresh.groupBy(*_USER).agg(F.count(F.lit(1)).alias("gained")), _USER, "left").fillna(0, ["gained"])
        current = self._rows("users", _VERSIONS, last).groupBy("ID", *_USER).agg(
            F.max(F.struct("version", "n_mentions")).alias("now"))
        placed = gained.join(current, _USER, "left")
        changed = placed.where("ID IS NOT NULL AND gained > 0").select(
            "ID", *_USER, (F.col("now.version") + 1).alias("version"), (F.col("now.n_mentions") + F.col("gained")).alias("n_mentions"))
        taken = F.coalesce(current.agg(F.max("ID")).scalar(), F.lit(0))
        added = dense_ids(placed.where("ID IS NULL").select(*_USER, "gained"), _USER).select(
            (F.col("ID") + taken).alias("ID"), *_USER, F.lit(1).cast("long").alias("version"), F.col("gained").alias("n_mentions"))
        changed.unionByName(added).withColumn("valid_from", time).write.mode("overwrite").parquet(
            f"{self.root}/users/load={number}")
