"""Declared schemas of the tables that enter and leave the library."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Post columns as the API path delivers them.
POST_API = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("url", T.StringType()),
    T.StructField("favorite_count", T.LongType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("hashtags", T.StringType()),
    T.StructField("emojis", T.StringType()),
    T.StructField("emoji_text", T.StringType()),
    T.StructField("usernames", T.StringType()),
    T.StructField("links", T.StringType()),
    T.StructField("text", T.StringType()),
])

# Post columns as the crawl path delivers them.
POST_CRAWL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("likes", T.LongType()),
    T.StructField("retweets", T.LongType()),
    T.StructField("replies", T.LongType()),
    T.StructField("views", T.LongType()),
    T.StructField("emojis", T.StringType()),
    T.StructField("hashtags", T.StringType()),
    T.StructField("websites", T.StringType()),
    T.StructField("usernames", T.StringType()),
    T.StructField("emoji_text", T.StringType()),
])

# Merged posts: the API columns plus who posted and in which group.
POST = T.StructType(
    POST_API.fields[:2]
    + [T.StructField("user", T.StringType()), T.StructField("group", T.StringType())]
    + POST_API.fields[2:]
)

# Crawl column name -> API column name.
CRAWL_TO_API = {"likes": "favorite_count", "retweets": "retweet_count", "websites": "links"}


def cast_to(df: DataFrame, schema: T.StructType, rename: dict[str, str] | None = None) -> DataFrame:
    """Rename, then keep exactly the schema's columns, cast and in its order.

    Columns the input lacks become NULL; columns the schema lacks are dropped.
    """
    df = df.withColumnsRenamed(rename or {})
    present = set(df.columns)

    def column(field: T.StructField) -> Column:
        source = F.col(f"`{field.name}`") if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select([column(field) for field in schema.fields])


def crawl_as_api(df: DataFrame) -> DataFrame:
    """Crawled posts under the API column names, so that both kinds union."""
    return cast_to(df, POST_API, CRAWL_TO_API)
