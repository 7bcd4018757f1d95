"""Queries on tables that grow load by load: star schema, post history, stream buckets with late rows, sketches."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.operators import quantiles
from crowdtape.plans.star_loads import StarStore
from crowdtape.sources.history import History
from crowdtape.sources.staging import new_path
from crowdtape.streaming.buckets import BucketStore
from workload.loads import STAR, star_posts
from workload.market import rounded
from workload.views import POSTS, TAGGED, Query, table, with_ctes

# --- star schema in three loads: early posts, the next ones, the last ones; with each, earlier posts come again ---

_CUTS = ["2024-01-12", "2024-01-22"]


def _loads(spark: SparkSession, folder: str) -> list[DataFrame]:
    posts = star_posts(spark, folder)
    first, second = (F.col("created_at") < F.lit(cut).cast("timestamp_ntz") for cut in _CUTS)
    again = second & (~first | (F.col("id") % 4 == 0))
    recounted = posts.withColumn("favorite_count", F.col("favorite_count") + 1)
    return [posts.where(first), posts.where(again), recounted.where(~second | (F.col("id") % 3 != 0))]


def _star(spark: SparkSession, folder: str) -> StarStore:
    store = StarStore(spark, new_path(spark, "star"))
    loads = _loads(spark, folder)
    for number, posts in enumerate(loads):
        store.load(posts, number, datetime(2024, 2, 1 + number, tzinfo=timezone.utc), [F.desc("favorite_count")])
    store.load(loads[-1], len(loads) - 1, datetime(2024, 3, 1, tzinfo=timezone.utc), [F.desc("favorite_count")])
    return store


_LOADED = f"""loaded AS (
    SELECT *, 0 AS load FROM star WHERE created_at < TIMESTAMP '{_CUTS[0]}'
    UNION ALL SELECT *, 1 FROM star WHERE created_at < TIMESTAMP '{_CUTS[1]}' AND (created_at >= TIMESTAMP '{_CUTS[0]}' OR id % 4 = 0)
    UNION ALL SELECT * REPLACE (favorite_count + 1 AS favorite_count), 2 FROM star WHERE created_at >= TIMESTAMP '{_CUTS[1]}' OR id % 3 <> 0)"""
_FIRST_SEEN = """seen AS (SELECT coalesce("user", '') AS u, coalesce("group", '') AS g, coalesce(usernames, '') AS m, min(load) AS load
    FROM loaded GROUP BY ALL)"""
_NUMBERED = """numbered AS (SELECT u, g, min(load) AS load, row_number() OVER (ORDER BY min(load), u, g) AS ID FROM seen GROUP BY u, g)"""
_VERSIONED = """versioned AS (SELECT ID, u, g, load, row_number() OVER (PARTITION BY ID ORDER BY load) AS version,
        sum(gained) OVER (PARTITION BY ID ORDER BY load) AS n_mentions,
        lead(load) OVER (PARTITION BY ID ORDER BY load) AS next_load
    FROM (SELECT ID, n.u, n.g, l.load, count(s.m) FILTER (s.m <> '') AS gained
        FROM numbered n JOIN (SELECT DISTINCT u, g, load FROM seen WHERE m <> '' UNION SELECT u, g, load FROM numbered) l USING (u, g)
            LEFT JOIN seen s ON s.u = n.u AND s.g = n.g AND s.load = l.load GROUP BY ALL))"""


def _user_versions(spark: SparkSession, folder: str) -> DataFrame:
    found = _star(spark, folder).user_versions()
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


_USER_VERSIONS_SQL = with_ctes("""
    SELECT CAST(ID AS BIGINT) AS ID, u AS twitter_user, g AS twitter_group, CAST(version AS BIGINT) AS version,
        CAST(n_mentions AS BIGINT) AS n_mentions, TIMESTAMP '2024-02-01' + to_days(load) AS valid_from,
        TIMESTAMP '2024-02-01' + to_days(next_load) AS valid_to FROM versioned
    """, POSTS, TAGGED, STAR, _LOADED, _FIRST_SEEN, _NUMBERED, _VERSIONED)


def _version_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _star(spark, folder).mentions_of_versions()


_VERSION_MENTIONS_SQL = with_ctes("""
    SELECT CAST(ID AS BIGINT) AS ID, CAST(version AS BIGINT) AS version, s.m AS mentioned_users
    FROM versioned v JOIN seen s ON s.u = v.u AND s.g = v.g AND s.load <= v.load AND s.m <> ''
    """, POSTS, TAGGED, STAR, _LOADED, _FIRST_SEEN, _NUMBERED, _VERSIONED)


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return _star(spark, folder).facts().drop("ID")


_FACTS_SQL = with_ctes("""
    SELECT n.ID AS UserID_FK, l.id AS twitter_id, l.text AS raw_text, l.url AS tweet_url, l.favorite_count, l.retweet_count,
        l.hashtags, '' AS emojis, '' AS emoji_text, l.links AS all_urls, CAST(l.created_at AS DATE) AS date
    FROM (SELECT * FROM loaded QUALIFY row_number() OVER (PARTITION BY id ORDER BY load DESC) = 1) l
        LEFT JOIN numbered n ON n.u = l."user" AND n.g = l."group"
    """, POSTS, TAGGED, STAR, _LOADED, _FIRST_SEEN, _NUMBERED)


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    return _star(spark, folder).dates().groupBy("date").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("twitter_id").alias("ids"))


_DATES_SQL = with_ctes("""
    SELECT CAST(created_at AS DATE) AS date, count(*) AS posts, count(*) AS ids
    FROM (SELECT DISTINCT id, created_at FROM loaded) GROUP BY 1""", POSTS, TAGGED, STAR, _LOADED)


# --- history: events in deliveries by day of the month, every seventh sent again two deliveries later ---

_DELIVERIES = 5


def _deliveries(spark: SparkSession, folder: str) -> list[DataFrame]:
    events = table(spark, folder, "events")
    number = F.least(F.floor(F.dayofmonth("ts") / 7), F.lit(_DELIVERIES - 1))
    first = events.withColumn("_n", number)
    again = first.where(F.col("event_id") % 7 == 0).withColumns({"_n": F.col("_n") + 2, "value": F.col("value") * 2})
    both = first.unionByName(again)
    return [both.where(F.col("_n") == n).drop("_n") for n in range(_DELIVERIES)]


def _history(spark: SparkSession, folder: str) -> History:
    """The third delivery is sent twice; what it and those before bring is compacted, the rest waits."""
    deliveries = _deliveries(spark, folder)
    history = History(spark, new_path(spark, "history"), deliveries[0].schema, "event_id", span=1000, owner="event_type")
    for number, rows in enumerate(deliveries):
        history.append(rows, number)
        if number == 2:
            history.append(rows, number)
        if number in (1, 3):
            history.compact()
    history.clean()
    return history


_DELIVERED = f"""delivered AS (SELECT * FROM (
    SELECT *, least(day(ts) // 7, {_DELIVERIES - 1}) AS n FROM events
    UNION ALL SELECT * REPLACE (value * 2 AS value), least(day(ts) // 7, {_DELIVERIES - 1}) + 2 FROM events WHERE event_id % 7 = 0)
    WHERE n < {_DELIVERIES})"""


def _history_read(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).read()


_HISTORY_SQL = with_ctes("""
    SELECT * EXCLUDE (n) FROM delivered QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1""", _DELIVERED)


def _history_newer(spark: SparkSession, folder: str) -> DataFrame:
    """What a further delivery of all events, numbered on by half, has beyond each type's largest stored number."""
    events = table(spark, folder, "events")
    landed = events.withColumn("event_id", F.col("event_id") + F.floor(F.col("event_id") / 2))
    return _history(spark, folder).newer(landed).select("event_id", "event_type", "ts")


_HISTORY_NEWER_SQL = with_ctes("""
    SELECT e.event_id + e.event_id // 2 AS event_id, event_type, ts
    FROM events e JOIN (SELECT event_type, max(event_id) AS mark FROM delivered GROUP BY 1) USING (event_type)
    WHERE e.event_id + e.event_id // 2 > mark""", _DELIVERED)


# --- stream buckets: batches by day, a tenth of the events two days late ---

def _bucket_store(spark: SparkSession, folder: str) -> BucketStore:
    events = table(spark, folder, "events")
    store = BucketStore(spark, new_path(spark, "buckets"), events.schema, ["value"], "1 hour", "30 minutes",
                        ["event_type"], "ts", "1 hour")
    late = F.when(F.col("event_id") % 10 == 0, F.lit(2)).otherwise(F.lit(0))
    numbered = events.withColumn("_n", F.floor((F.dayofmonth("ts") + late) / 8))
    for number in range(5):
        store.add(numbered.where(F.col("_n") == number), number)
    return store


_BATCHED = """batched AS (SELECT *, (day(ts) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) // 8 AS n,
    time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes') AS b FROM events),
marks AS (SELECT n, max(max(ts)) OVER (ORDER BY n) - INTERVAL '1 hour' AS mark FROM batched GROUP BY n),
judged AS (SELECT t.*, coalesce(b + INTERVAL '1 hour' <= (SELECT max(mark) FROM marks m WHERE m.n < t.n), false) AS late FROM batched t)"""


def _buckets_whole(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_bucket_store(spark, folder).sums(), "value")


_BUCKETS_WHOLE_SQL = with_ctes("""
    SELECT event_type, b AS ts, round(sum(value), 4) AS value, count(*) AS rows,
        b + INTERVAL '1 hour' <= (SELECT max(mark) FROM marks) AS closed FROM judged WHERE NOT late GROUP BY event_type, b
    """, _BATCHED)


def _late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _bucket_store(spark, folder).late().select("event_id", "event_type", "ts", F.col("batch").cast("long").alias("batch"))


_LATE_ROWS_SQL = with_ctes("SELECT event_id, event_type, ts, n AS batch FROM judged WHERE late", _BATCHED)


# --- quantiles from sketches ---

_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches per day merged into one: every quantile's true rank, and whether it is as near as it should be."""
    events = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "value")
    daily = quantiles.quantile_sketches(events, ["value"], by=["day"])
    found = quantiles.sketched_quantiles(quantiles.merge_sketches(daily), _SHARES)
    each = F.posexplode(F.array(*[F.col(f"q{i}") for i in range(len(_SHARES))])).alias("i", "q")
    asked = found.select("rows", each).withColumn("share", F.get(F.array(*map(F.lit, _SHARES)), F.col("i")))
    counted = events.where("value IS NOT NULL").join(F.broadcast(asked)).groupBy("share", "rows").agg(
        F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    slack = F.col("rows") * quantiles.RANK_ERROR + 1
    target = F.col("rows") * F.col("share")
    return counted.select("share", "rows", ((F.col("below") <= target + slack) & (F.col("upto") >= target - slack)).alias("near"))


_SKETCHES_SQL = f"""SELECT CAST(unnest({_SHARES}) AS DOUBLE) AS share, count(value) AS rows, true AS near FROM events"""

QUERIES = {
    "user_versions": Query(_user_versions, _USER_VERSIONS_SQL),
    "user_version_mentions": Query(_version_mentions, _VERSION_MENTIONS_SQL),
    "facts_three_loads": Query(_facts, _FACTS_SQL),
    "dates_three_loads": Query(_dates, _DATES_SQL),
    "history_compacted": Query(_history_read, _HISTORY_SQL),
    "history_newer": Query(_history_newer, _HISTORY_NEWER_SQL),
    "stream_buckets_whole": Query(_buckets_whole, _BUCKETS_WHOLE_SQL),
    "stream_late_rows": Query(_late_rows, _LATE_ROWS_SQL),
    "quantile_sketches": Query(_sketches, _SKETCHES_SQL),
}
