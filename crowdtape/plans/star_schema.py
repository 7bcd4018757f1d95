"""Posts as a star schema: a user dimension, a date dimension and a fact table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdtape.functions.times import split_timestamp
from crowdtape.operators.lookup import left_lookup
from crowdtape.operators.ordered import dense_ids

# Post column -> column of the star schema.
STAR_NAMES = {
    "id": "twitter_id", "user": "twitter_user", "group": "twitter_group", "url": "tweet_url",
    "links": "all_urls", "text": "raw_text", "usernames": "mentioned_users",
}
# The fact table's columns after its keys.
FACT_COLUMNS = [
    "twitter_id", "raw_text", "tweet_url", "favorite_count", "retweet_count", "hashtags", "emojis",
    "emoji_text", "all_urls",
]


def star_names(posts: DataFrame) -> DataFrame:
    return posts.withColumnsRenamed(STAR_NAMES)


def first_rows(posts: DataFrame, rows: int = 100, order: str = "id") -> DataFrame:
    """The first rows by id, for trial loads."""
    return posts.orderBy(order).limit(rows)


def user_mentions(posts: DataFrame) -> DataFrame:
    """``twitter_user, twitter_group, mentioned_users``: the distinct mentions, one per row."""
    columns = ["twitter_user", "twitter_group", "mentioned_users"]
    return star_names(posts).select(*columns).fillna("").distinct()


def user_dim(posts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per user and group with its distinct mentions joined in order, and a key.

    Rows of an ``existing`` dimension stay as they are, so stored facts keep their users; only users it lacks
    are added, with keys that go on from its largest. Mentions are made distinct before they are gathered, so
    what is gathered is the cell itself and not the user's posts.
    """
    on = ["twitter_user", "twitter_group"]
    mentions = F.array_join(F.array_sort(F.collect_list("mentioned_users")), " ")
    found = user_mentions(posts)
    if existing is None:
        return dense_ids(found.groupBy(*on).agg(mentions.alias("mentioned_users")), on)
    unknown = found.join(existing.select(*on), on, "left_anti")
    added = dense_ids(unknown.groupBy(*on).agg(mentions.alias("mentioned_users")), on)
    taken = F.coalesce(existing.agg(F.max("ID")).scalar(), F.lit(0))
    return existing.select("ID", *on, "mentioned_users").unionByName(added.withColumn("ID", F.col("ID") + taken))


def date_dim(posts: DataFrame) -> DataFrame:
    """The post time in parts, keyed by the post id."""
    dated = split_timestamp(posts.select(F.col("id").alias("twitter_id"), F.col("created_at").alias("timestamp")))
    return dated.select(F.xxhash64("twitter_id").alias("ID"), *dated.columns)


def fact_posts(posts: DataFrame, users: DataFrame, many_users: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Posts with the key of their user; the post key is a hash of its id, which needs no order.

    ``extra`` columns of the posts, such as a day to store them by, come after the fact's own.

    Spark broadcasts the users if their size allows. ``many_users`` says that it does not: then the posts of
    frequent users are counted first and kept out of the shuffle, for which the posts are read four times.
    """
    keys = users.select("twitter_user", "twitter_group", F.col("ID").alias("UserID_FK"))
    named, on = star_names(posts).select("twitter_user", "twitter_group", *FACT_COLUMNS, *extra), ["twitter_user", "twitter_group"]
    facts = left_lookup(named, keys, on) if many_users else named.join(keys, on, "left")
    return facts.select(F.xxhash64("twitter_id").alias("ID"), "UserID_FK", *FACT_COLUMNS, *extra)
