"""Queries on time buckets, pivots, folds, calendars, prices and scaling."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtape.functions import times
from crowdtape.operators import buckets, calendars, folds, ordered, price_joins, quantiles, scaling, summaries
from crowdtape.plans import price_features, text_features
from workload.views import POSTS, USERS, Query, grams_sql, posts, table, with_ctes, words_ctes


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as posts: the event type is the user, its value a measure."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("user"),
        "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS = """ev AS (SELECT event_id AS id, ts AS created_at, event_type AS "user", value,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""

_MEASURES = ["value", "k"]


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- buckets ---

_BUCKETS = {
    "hour": ("1 hour", "30 minutes"), "30m": ("30 minutes", None),
    "5m": ("5 minutes", None), "1m": ("1 minute", None),
}


def _bucket(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(buckets.bucket_sums(_events(spark, folder), _MEASURES, *_BUCKETS[name]), "value")
    return run


def bucket_cte(name: str, keys: str = '"user", ', cte: str = "b", source: str = "ev") -> str:
    width, offset = _BUCKETS[name]
    return f"""{cte} AS (SELECT {keys}time_bucket(INTERVAL '{width}', created_at, INTERVAL '{offset or "0 minutes"}') AS created_at,
        sum(value) AS value, CAST(sum(k) AS BIGINT) AS k FROM {source} GROUP BY ALL)"""


def _bucket_sql(name: str) -> str:
    return with_ctes('SELECT "user", created_at, round(value, 4) AS value, k FROM b', EVENTS, bucket_cte(name))


# --- pivots ---

_COUNTS = ["favorite_count", "retweet_count"]


def _pivot_day(spark: SparkSession, folder: str) -> DataFrame:
    dated = posts(spark, folder).withColumn("date", F.to_date("created_at"))
    return buckets.pivot_users(dated, "date", _COUNTS, _COUNTS, USERS)


def _pivot_hour(spark: SparkSession, folder: str) -> DataFrame:
    sums = buckets.bucket_sums(posts(spark, folder), _COUNTS, "1 hour", "30 minutes")
    # The users are found in the table here.
    return buckets.pivot_users(sums, "created_at", ["favorite_count"], ["retweet_count"])


def _pivot_columns(measures: list[str]) -> str:
    return ", ".join(
        f"""coalesce(CAST(sum({m}) FILTER ("user" = '{u}') AS BIGINT), 0) AS {m}_{u}"""
        for m in measures for u in USERS
    )


_PIVOT_DAY_SQL = with_ctes(f"""
    SELECT CAST(created_at AS DATE) AS date, {_pivot_columns(_COUNTS)},
        CAST(sum(favorite_count) AS BIGINT) AS favorite_count, CAST(sum(retweet_count) AS BIGINT) AS retweet_count
    FROM posts GROUP BY 1""", POSTS)
_PIVOT_HOUR_SQL = with_ctes(f"""
    SELECT time_bucket(INTERVAL '1 hour', created_at, INTERVAL '30 minutes') AS created_at,
        {_pivot_columns(_COUNTS[:1])}, CAST(sum(retweet_count) AS BIGINT) AS retweet_count
    FROM posts GROUP BY 1""", POSTS)


# --- gap filling ---

def _fill_minutes(spark: SparkSession, folder: str) -> DataFrame:
    sums = buckets.bucket_sums(_events(spark, folder), _MEASURES, "1 minute", keys=())
    return rounded(calendars.fill_steps(sums, 60), "value")


_FILL_MINUTES_SQL = with_ctes("""
    SELECT g.created_at, round(coalesce(b.value, 0.0), 4) AS value, coalesce(b.k, 0) AS k
    FROM (SELECT unnest(generate_series(lo, hi, INTERVAL '1 minute')) AS created_at
          FROM (SELECT min(created_at) AS lo, max(created_at) AS hi FROM b)) g
    LEFT JOIN b USING (created_at)""", EVENTS, bucket_cte("1m", keys=""))


def _fill_openings(spark: SparkSession, folder: str) -> DataFrame:
    sums = buckets.bucket_sums(_events(spark, folder), _MEASURES, "30 minutes", keys=())
    return rounded(calendars.fill_openings(sums), "value")


_FILL_OPENINGS_SQL = with_ctes("""
    SELECT created_at, round(coalesce(b.value, 0.0), 4) AS value, coalesce(b.k, 0) AS k
    FROM b FULL JOIN (
        SELECT unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL '1 day'))
            + INTERVAL '13 hours 30 minutes' AS created_at
        FROM (SELECT CAST(min(created_at) AS TIMESTAMP) AS lo, CAST(max(created_at) AS TIMESTAMP) AS hi FROM b)
    ) o USING (created_at)""", EVENTS, bucket_cte("30m", keys=""))


# --- folds ---

def _monday(ts: str) -> str:
    """Monday after a weekend day."""
    return (f"CAST({ts} AS DATE) + CAST(CASE dayofweek({ts}) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER)")


def _fold_day(spark: SparkSession, folder: str) -> DataFrame:
    dated = _events(spark, folder).withColumn("date", F.to_date("created_at"))
    return rounded(folds.fold_weekend_by_day(dated, _MEASURES, keys=["user"]), "value")


_FOLD_DAY_SQL = with_ctes(f"""
    SELECT "user", CAST({_monday('created_at')} AS DATE) AS date, round(sum(value), 4) AS value,
        CAST(sum(k) AS BIGINT) AS k
    FROM ev GROUP BY ALL""", EVENTS)


def _fold_hour(spark: SparkSession, folder: str) -> DataFrame:
    sums = buckets.bucket_sums(_events(spark, folder), _MEASURES, "1 hour", "30 minutes")
    return rounded(folds.fold_weekend_by_time(sums, _MEASURES, keys=["user"]), "value")


def _open_key(ts: str) -> str:
    return (f"CASE WHEN dayofweek({ts}) IN (0, 6) THEN CAST({_monday(ts)} AS TIMESTAMP) "
            f"+ INTERVAL '13 hours 30 minutes' ELSE {ts} END")


_FOLD_HOUR_SQL = with_ctes(f"""
    SELECT "user", {_open_key('created_at')} AS created_at, round(sum(value), 4) AS value,
        CAST(sum(k) AS BIGINT) AS k
    FROM b GROUP BY ALL""", EVENTS, bucket_cte("hour"))


def _market(width: str, **hours):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        folded = folds.posts_to_market_time(_events(spark, folder), _MEASURES, *_BUCKETS[width], **hours)
        return rounded(folded, "value")
    return run


def _fold_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of the larger events, with zero rows at openings that nothing moved to."""
    rare = _events(spark, folder).where(F.col("value") > 150)
    sums = buckets.bucket_sums(rare, _MEASURES, *_BUCKETS["hour"])
    return rounded(folds.fold_market_hours(sums, _MEASURES, keys=["user"], emit_empty=True), "value")


def market_ctes(keys: str = '"user", ', measures: str = "sum(value) AS value, CAST(sum(k) AS BIGINT) AS k",
                source: str = "b", columns: str = "value, k", once: bool = False, trading: bool = False) -> list[str]:
    early, late = ("<", ">") if once else ("<=", ">=")
    next_open = "CAST(t AS DATE) + 1"
    if trading:
        next_open = f"CAST({_monday('(CAST(t AS DATE) + 1)')} AS DATE)"
    return [
        f"""f AS (SELECT {keys}timezone('America/New_York', timezone('UTC', {_open_key('created_at')})) AS t, {columns}
            FROM {source})""",
        f"""m AS (
            SELECT {keys}t AS timestamp, {columns} FROM f WHERE CAST(t AS TIME) BETWEEN '09:30:00' AND '15:30:00'
            UNION ALL SELECT {keys}CAST(t AS DATE) + INTERVAL '9 hours 30 minutes', {columns} FROM f
                WHERE CAST(t AS TIME) {early} '09:30:00'
            UNION ALL SELECT {keys}CAST({next_open} AS TIMESTAMP) + INTERVAL '9 hours 30 minutes', {columns} FROM f
                WHERE CAST(t AS TIME) {late} '15:30:00' AND CAST(t AS TIME) <= '23:59:00')""",
        f"market AS (SELECT {keys}timestamp, {measures} FROM m GROUP BY ALL)",
    ]


def _market_sql(width: str, **options: bool) -> str:
    return with_ctes('SELECT "user", timestamp, round(value, 4) AS value, k FROM market',
                     EVENTS, bucket_cte(width), *market_ctes(**options))


def _fold_empty_sql() -> str:
    local, moved, _ = market_ctes()
    return with_ctes("""
        SELECT "user", timestamp, round(sum(value), 4) AS value, CAST(sum(k) AS BIGINT) AS k FROM (
            SELECT "user", timestamp, value, k FROM m UNION ALL
            SELECT "user", unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '1 day')), 0.0, 0
            FROM m WHERE CAST(timestamp AS TIME) = '09:30:00' GROUP BY 1)
        GROUP BY ALL""", EVENTS, "large AS (SELECT * FROM ev WHERE value > 150)", bucket_cte("hour", source="large"),
        local.replace(_open_key("created_at"), "created_at"), moved)


# --- end to end: posts to scored, scaled, pivoted and folded features ---

def scaled_posts(spark: SparkSession, folder: str, stem: bool = False) -> DataFrame:
    scored = text_features.scored_posts(posts(spark, folder), stem=stem)
    return text_features.scaled_posts(scored)


def _features_day(spark: SparkSession, folder: str) -> DataFrame:
    wide = text_features.daily_features(scaled_posts(spark, folder), USERS)
    return rounded(wide, *wide.columns[1:], digits=6)


def _features(width: str, stem: bool = False):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        wide = text_features.intraday_features(scaled_posts(spark, folder, stem), USERS, width)
        return rounded(wide, *wide.columns[1:], digits=6)
    return run


_SCORED = [
    f"c1 AS (SELECT gram, count(*) AS c FROM ({grams_sql(1)}) GROUP BY gram)",
    f"g2 AS ({grams_sql(2)})", "c2 AS (SELECT gram, count(*) AS c FROM g2 GROUP BY gram)",
    "cf AS (SELECT words[1] AS word, count(*) AS c FROM words GROUP BY 1)",
    "cl AS (SELECT words[len(words)] AS word, count(*) AS c FROM words GROUP BY 1)",
    """u AS (SELECT g.id, sum(ln(c1.c / CAST((SELECT count(*) FROM c1) AS DOUBLE))) AS lp
        FROM (SELECT id, unnest(words) AS gram FROM words) g JOIN c1 USING (gram) GROUP BY g.id)""",
    """bi AS (SELECT id, sum(term) + any_value(edge) AS lp FROM (
        SELECT g2.id, ln(c2.c / CAST(c1.c AS DOUBLE)) AS term,
            ln(cf.c / CAST(n.n AS DOUBLE)) + ln(cl.c / CAST(n.n AS DOUBLE)) AS edge
        FROM g2 JOIN words w ON w.id = g2.id JOIN c2 ON c2.gram = g2.gram
        JOIN c1 ON c1.gram = split_part(g2.gram, ' ', 1) JOIN cf ON cf.word = w.words[1]
        JOIN cl ON cl.word = w.words[len(w.words)] CROSS JOIN (SELECT count(*) AS n FROM posts) n)
        GROUP BY id)""",
    """scored AS (SELECT posts.* EXCLUDE (text), coalesce(u.lp, 0.0) AS lu, bi.lp AS lb FROM posts LEFT JOIN u USING (id) LEFT JOIN bi USING (id))""",
    """shifted AS (SELECT *, exp(lu - (SELECT max(lu) FROM scored)) AS unigram_probability,
            coalesce(exp(lb - (SELECT max(lb) FROM scored)), 0.0) AS bigram_probability FROM scored)""",
    """scaled AS (SELECT s.* REPLACE (
            unigram_probability / (SELECT sum(unigram_probability) FROM shifted) AS unigram_probability,
            bigram_probability / (SELECT sum(bigram_probability) FROM shifted) AS bigram_probability,
            (favorite_count - lo1) / CAST(hi1 - lo1 AS DOUBLE) AS favorite_count,
            (retweet_count - lo2) / CAST(hi2 - lo2 AS DOUBLE) AS retweet_count)
        FROM shifted s CROSS JOIN (SELECT min(favorite_count) AS lo1, max(favorite_count) AS hi1,
            min(retweet_count) AS lo2, max(retweet_count) AS hi2 FROM scored) l)""",
]
_SCALED = [POSTS, *words_ctes(), *_SCORED]
_FEATURES = [f"{p}_{u}" for p in ("unigram", "bigram") for u in USERS] + _COUNTS
_WIDE = ", ".join(
    f"""coalesce(sum({p}_probability) FILTER ("user" = '{u}'), 0.0) AS {p}_{u}"""
    for p in ("unigram", "bigram") for u in USERS
) + ", " + ", ".join(f"sum({c}) AS {c}" for c in _COUNTS)
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES)
_FEATURES_DAY_SQL = with_ctes(
    f"SELECT date, {_ROUNDED} FROM folded", *_SCALED,
    f"folded AS (SELECT CAST({_monday('created_at')} AS DATE) AS date, {_WIDE} FROM scaled GROUP BY 1)")


def _features_sql(width: str, stem: bool = False) -> str:
    step, offset = _BUCKETS[width]
    wide = f"""wide AS (SELECT time_bucket(INTERVAL '{step}', created_at, INTERVAL '{offset or "0 minutes"}')
        AS created_at, {_WIDE} FROM scaled GROUP BY 1)"""
    ends = "(SELECT CAST(min(created_at) AS TIMESTAMP) AS lo, CAST(max(created_at) AS TIMESTAMP) AS hi FROM wide)"
    if width == "1m":
        extra = f"SELECT unnest(generate_series(lo, hi, INTERVAL '1 minute')) AS created_at FROM {ends}"
    else:
        extra = f"""SELECT unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL '1 day'))
            + INTERVAL '13 hours 30 minutes' AS created_at FROM {ends}"""
    columns = ", ".join(_FEATURES)
    filled = f"filled AS (SELECT created_at, " + ", ".join(
        f"coalesce({c}, 0.0) AS {c}" for c in _FEATURES) + f" FROM wide FULL JOIN ({extra}) USING (created_at))"
    return with_ctes(f"SELECT timestamp, {_ROUNDED} FROM market", POSTS, *words_ctes(stem), *_SCORED, wide, filled, *market_ctes(
        keys="", measures=", ".join(f"sum({c}) AS {c}" for c in _FEATURES), source="filled", columns=columns))


# --- calendars ---

def _calendar(days: int | None, months: int | None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return calendars.trading_calendar(table(spark, folder, "events"), "ts", days, months)
    return run


def _calendar_sql(after: str) -> str:
    return f"""
        SELECT t AS timestamp FROM (
            SELECT unnest(generate_series(CAST(d AS TIMESTAMP) + INTERVAL '30 minutes',
                CAST({after} AS TIMESTAMP) - INTERVAL '1 minute', INTERVAL '1 hour')) AS t
            FROM (SELECT CAST(max(ts) AS DATE) AS d FROM events))
        WHERE CAST(t AS TIME) BETWEEN '09:30:00' AND '15:30:00'"""


def _zones(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    local = times.to_zone(ts)
    return table(spark, folder, "events").select(
        "event_id", local.alias("local"), times.from_zone(local).alias("back"),
        times.last_trading_day(ts).alias("last_trading_day"), times.monday_label(ts).alias("monday_label"),
        times.at_time(ts, 13, 30).alias("opening"), times.next_day_same_time(ts).alias("next_day"),
        times.between_times(local, "09:30:00", "15:30:00").alias("open"),
    )


_ZONES_SQL = """
    SELECT event_id, l AS local, ts AS back,
        CAST(ts AS DATE) - CAST(CASE dayofweek(ts) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS last_trading_day,
        CAST(ts AS DATE) + CAST((8 - dayofweek(ts)) % 7 AS INTEGER) AS monday_label,
        CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '13 hours 30 minutes' AS opening,
        ts + INTERVAL '1 day' AS next_day, CAST(l AS TIME) BETWEEN '09:30:00' AND '15:30:00' AS open
    FROM (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)"""


# --- prices: the mean event value per type and bucket ---

def _prices(spark: SparkSession, folder: str, key: Column, name: str) -> DataFrame:
    """Wide prices, one column per ticker."""
    events = table(spark, folder, "events").select(key.alias(name), "event_type", "value")
    return events.groupBy(name).pivot("event_type", USERS).agg(F.avg("value"))


def hourly_prices(spark: SparkSession, folder: str) -> DataFrame:
    key = times.to_zone(times.time_bucket(F.col("ts"), "1 hour", "30 minutes"))
    return _prices(spark, folder, key, "timestamp")


def _daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _prices(spark, folder, F.to_date("ts"), "date")


def long_prices(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    key = times.time_bucket(F.col("ts"), "1 hour", "30 minutes")
    # Sums of cents, rounded to cents, so that comparing prices does not depend on the order of summation.
    return events.groupBy(F.col("event_type").alias("ticker"), key.alias("ts")).agg(
        F.round(F.sum("value"), 2).alias("price"))


def _price_columns() -> str:
    return ", ".join(f"avg(value) FILTER (event_type = '{u}') AS {u}" for u in USERS)


_LOCAL_HOUR = ("timezone('America/New_York', timezone('UTC', "
               "time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes')))")
HOURLY = f"hourly AS (SELECT {_LOCAL_HOUR} AS timestamp, {_price_columns()} FROM events GROUP BY 1)"
DAILY = f"daily AS (SELECT CAST(ts AS DATE) AS date, {_price_columns()} FROM events GROUP BY 1)"
LONG = """prices AS (SELECT event_type AS ticker, time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes') AS ts,
    round(sum(value), 2) AS price FROM events GROUP BY ALL)"""
_ROUNDED_PRICES = ", ".join(f"round(coalesce({u}, 0.0), 9) AS {u}" for u in USERS)


def market_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Sums in market time, over all users."""
    sums = folds.posts_to_market_time(_events(spark, folder), _MEASURES, "1 hour", "30 minutes", keys=())
    return rounded(sums, "value")


_POST_SUMS = "CAST(sum(favorite_count) AS BIGINT) AS favorite_count, CAST(sum(retweet_count) AS BIGINT) AS retweet_count"
_EVENT_SUMS = "round(sum(value), 4) AS value, CAST(sum(k) AS BIGINT) AS k"
MARKET_POSTS = [EVENTS, bucket_cte("hour", keys=""), *market_ctes(keys="", measures=_EVENT_SUMS)]


def _join_day(spark: SparkSession, folder: str) -> DataFrame:
    dated = posts(spark, folder).withColumn("date", F.to_date("created_at"))
    features = folds.fold_weekend_by_day(dated, _COUNTS)
    return rounded(price_joins.join_on_time(_daily_prices(spark, folder), features, "date"), *USERS, digits=9)


_JOIN_DAY_SQL = with_ctes(f"""
    SELECT date, {_ROUNDED_PRICES}, favorite_count, retweet_count
    FROM daily JOIN (SELECT CAST({_monday('created_at')} AS DATE) AS date, {_POST_SUMS} FROM posts GROUP BY 1) USING (date)
    """, POSTS, DAILY)


def _join_hour(spark: SparkSession, folder: str) -> DataFrame:
    joined = price_joins.join_on_time(hourly_prices(spark, folder), market_posts(spark, folder))
    return rounded(joined, *USERS, digits=9)


_JOIN_HOUR_SQL = with_ctes(f"SELECT timestamp, {_ROUNDED_PRICES}, value, k "
                           "FROM hourly JOIN market USING (timestamp)", HOURLY, *MARKET_POSTS)


def _join_today(spark: SparkSession, folder: str) -> DataFrame:
    features = market_posts(spark, folder)
    prices = hourly_prices(spark, folder)
    today = times.last_trading_day(price_joins.last_day(prices))
    joined = price_joins.join_on_time(price_joins.on_day(features, today), prices)
    return rounded(joined, *USERS, digits=9)


_TODAY = ("(SELECT d - CAST(CASE dayofweek(d) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) "
          "FROM (SELECT CAST(max(timestamp) AS DATE) AS d FROM hourly))")
_JOIN_TODAY_SQL = with_ctes(f"""
    SELECT timestamp, {_ROUNDED_PRICES}, value, k FROM hourly JOIN market USING (timestamp)
    WHERE CAST(timestamp AS DATE) = {_TODAY}""", HOURLY, *MARKET_POSTS)


def _join_minute(spark: SparkSession, folder: str) -> DataFrame:
    """Each minute of the last trading day that has both posts and prices."""
    features = folds.posts_to_market_time(_events(spark, folder), _MEASURES, "1 minute", keys=())
    prices = _prices(spark, folder, times.to_zone(times.time_bucket(F.col("ts"), "1 minute")), "timestamp")
    joined = price_features.merged_today(prices, features, price_joins.last_day(prices))
    return rounded(joined, "value", *USERS, digits=4)


_MINUTELY = f"""hourly AS (SELECT timezone('America/New_York', timezone('UTC', time_bucket(INTERVAL '1 minute', ts)))
    AS timestamp, {_price_columns()} FROM events GROUP BY 1)"""
_JOIN_MINUTE_SQL = with_ctes(f"""
    SELECT timestamp, {", ".join(f"round({u}, 4) AS {u}" for u in USERS)}, value, k FROM hourly JOIN market USING (timestamp)
    WHERE CAST(timestamp AS DATE) = {_TODAY}""", _MINUTELY, EVENTS, bucket_cte("1m", keys=""),
    *market_ctes(keys="", measures=_EVENT_SUMS))


def _semi(spark: SparkSession, folder: str) -> DataFrame:
    prices = hourly_prices(spark, folder)
    training = price_joins.except_day(market_posts(spark, folder), price_joins.last_day(prices))
    return rounded(price_joins.prices_in_training(prices, training, "view"), "view", digits=9)


_SEMI_SQL = with_ctes("""
    SELECT timestamp, round(view, 9) AS view FROM hourly WHERE timestamp IN (
        SELECT timestamp FROM market
        WHERE CAST(timestamp AS DATE) <> (SELECT CAST(max(timestamp) AS DATE) FROM hourly))""",
    HOURLY, *MARKET_POSTS)


def _latest_test(spark: SparkSession, folder: str) -> DataFrame:
    dated = _events(spark, folder).groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("value").alias("value"), F.sum("k").alias("k"))
    prices = hourly_prices(spark, folder).fillna(0)
    daily = _daily_prices(spark, folder).join(dated, "date", "left")
    scaled = price_joins.latest_test_row(prices, dated, daily, [*USERS, *_MEASURES])
    return rounded(scaled, *USERS, *_MEASURES, digits=6)


_LATEST_SQL = with_ctes(
    "SELECT date, " + ", ".join(
        f"round(({c} - lo_{c}) / nullif(CAST(hi_{c} - lo_{c} AS DOUBLE), 0), 6) AS {c}" for c in [*USERS, *_MEASURES])
    + f"""
    FROM (SELECT CAST(timestamp AS DATE) AS date, {", ".join(f"coalesce({u}, 0.0) AS {u}" for u in USERS)} FROM hourly
          ORDER BY timestamp DESC LIMIT 1)
    JOIN dated USING (date)
    CROSS JOIN (SELECT """
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in [*USERS, *_MEASURES])
    + " FROM daily LEFT JOIN dated USING (date))",
    EVENTS, HOURLY, DAILY,
    "dated AS (SELECT CAST(created_at AS DATE) AS date, sum(value) AS value, CAST(sum(k) AS BIGINT) AS k FROM ev GROUP BY 1)")


# --- order-dependent ---

def _target(shift: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        labelled = ordered.binary_target(long_prices(spark, folder), shift=shift)
        return rounded(labelled, "window_mean")
    return run


def _target_sql(back: int, ahead: str, needed: int) -> str:
    frame = f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {back} PRECEDING AND {ahead})"
    return with_ctes(f"""
        SELECT ticker, ts, price, CASE WHEN full_frame THEN round(mean, 4) END AS window_mean,
            CASE WHEN full_frame AND price > mean THEN 1 ELSE 0 END AS y
        FROM (SELECT *, avg(price) OVER {frame} AS mean,
            count(*) OVER {frame} = 5 AND row_number() OVER (PARTITION BY ticker ORDER BY ts) >= {needed} AS full_frame
            FROM prices)""", LONG)


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.latest_row(table(spark, folder, "events"), "ts", ["event_id"])


def _forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    gappy = long_prices(spark, folder).withColumn("price", F.when(F.col("price") > 50, F.col("price")))
    return ordered.forward_fill(gappy, ["price"], ["ticker"], "ts")


_FORWARD_SQL = with_ctes("""
    SELECT ticker, ts, last_value(CASE WHEN price > 50 THEN price END IGNORE NULLS) OVER (
        PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
    FROM prices""", LONG)


# --- scaling ---

def _minmax(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scaling.min_max(_events(spark, folder), _MEASURES).select("id", *_MEASURES)
    return rounded(scaled, *_MEASURES, digits=9)


_MINMAX_SQL = with_ctes("""
    SELECT id, round((value - lo) / nullif(hi - lo, 0), 9) AS value,
        round((k - klo) / nullif(CAST(khi - klo AS DOUBLE), 0), 9) AS k
    FROM ev CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi, min(k) AS klo, max(k) AS khi FROM ev)""", EVENTS)


def _minmax_reference(spark: SparkSession, folder: str) -> DataFrame:
    hourly, daily = hourly_prices(spark, folder), _daily_prices(spark, folder)
    return rounded(scaling.min_max(hourly.fillna(0), USERS, daily, skip_zero=True), *USERS, digits=6)


_MINMAX_REFERENCE_SQL = with_ctes(
    "SELECT timestamp, " + ", ".join(
        f"round((coalesce({u}, 0.0) - lo_{u}) / nullif(hi_{u} - lo_{u}, 0), 6) AS {u}" for u in USERS)
    + " FROM hourly CROSS JOIN (SELECT "
    + ", ".join(f"min(nullif({u}, 0)) AS lo_{u}, max(nullif({u}, 0)) AS hi_{u}" for u in USERS) + " FROM daily)",
    HOURLY, DAILY)


def _unit_sum(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scaling.to_unit_sum(_events(spark, folder), _MEASURES).select("id", *_MEASURES)
    return rounded(scaled, *_MEASURES, digits=12)


_UNIT_SUM_SQL = with_ctes("""
    SELECT id, round(value / (SELECT sum(value) FROM ev), 12) AS value,
        round(k / CAST((SELECT sum(k) FROM ev) AS DOUBLE), 12) AS k FROM ev""", EVENTS)

_ORDER_COLUMNS = ["o_totalprice", "o_custkey"]


def _robust(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", *_ORDER_COLUMNS)
    scaled = scaling.robust_scale(orders, _ORDER_COLUMNS, upper=0.95, lower=0.05)
    return rounded(scaled, *_ORDER_COLUMNS, digits=8)


_ROBUST_SQL = "SELECT o_orderkey, " + ", ".join(
    f"round(({c} - m_{c}) / nullif(CAST(hi_{c} - lo_{c} AS DOUBLE), 0), 8) AS {c}" for c in _ORDER_COLUMNS
) + " FROM orders CROSS JOIN (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.95) AS hi_{c}, quantile_cont({c}, 0.05) AS lo_{c}"
    for c in _ORDER_COLUMNS) + " FROM orders)"


def _quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = quantiles.exact_quantiles(
        table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return rounded(found, *[f"q{i}" for i in range(5)], digits=6)


_QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS rows, " + ", ".join(
        f"round(quantile_cont({c}, {q}), 6) AS q{i}" for i, q in enumerate([0.05, 0.25, 0.5, 0.75, 0.95]))
    + " FROM lineitem" for c in ["l_extendedprice", "l_quantity", "l_discount"])


def _trim(spark: SparkSession, folder: str) -> DataFrame:
    return scaling.trim_quantiles(table(spark, folder, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice")


_TRIM_SQL = """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN
        (SELECT quantile_cont(o_totalprice, 0.05) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)"""


def _moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scaling.moments(_events(spark, folder), _MEASURES), "mean", "std", digits=6)


_MOMENTS_SQL = with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM ev"
    for c in _MEASURES), EVENTS)


# --- ensemble: every event type is a run that values each hour ---

def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return long_prices(spark, folder).select(
        F.col("ticker").alias("run_id"), F.col("ts").alias("timestamp"), F.col("price").alias("value"))


def _ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.ensemble_by_time(_runs(spark, folder)), "mean_value")


def _ensemble_overall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.ensemble_overall(_runs(spark, folder)), "mean_value", "std_value")


_ENSEMBLE_SQL = with_ctes("SELECT ts AS timestamp, round(avg(price), 4) AS mean_value FROM prices GROUP BY 1", LONG)
_ENSEMBLE_OVERALL_SQL = with_ctes(
    "SELECT round(avg(price), 4) AS mean_value, round(stddev_pop(price), 4) AS std_value FROM prices", LONG)


QUERIES = {
    **{f"bucket_{name}": Query(_bucket(name), _bucket_sql(name)) for name in _BUCKETS},
    "user_pivot_day": Query(_pivot_day, _PIVOT_DAY_SQL),
    "user_pivot_hour": Query(_pivot_hour, _PIVOT_HOUR_SQL),
    "fill_minutes": Query(_fill_minutes, _FILL_MINUTES_SQL),
    "fill_daily_open": Query(_fill_openings, _FILL_OPENINGS_SQL),
    "weekend_fold_day": Query(_fold_day, _FOLD_DAY_SQL),
    "weekend_fold_hour": Query(_fold_hour, _FOLD_HOUR_SQL),
    "market_hours_fold": Query(_market("hour"), _market_sql("hour")),
    "market_30m_fold": Query(_market("30m"), _market_sql("30m")),
    "market_once_fold": Query(
        _market("hour", boundary="once", next_trading_day=True), _market_sql("hour", once=True, trading=True)),
    "market_fold_empty_days": Query(_fold_empty, _fold_empty_sql()),
    "features_by_day": Query(_features_day, _FEATURES_DAY_SQL),
    "features_by_hour": Query(_features("byhour"), _features_sql("hour")),
    "features_by_hour_stemmed": Query(_features("byhour", True), _features_sql("hour", True)),
    "features_by_halfhour": Query(_features("by_halfhour"), _features_sql("30m")),
    "features_by_five_minutes": Query(_features("by_five_minutes"), _features_sql("5m")),
    "features_by_minute": Query(_features("by_minute"), _features_sql("1m")),
    "trading_calendar": Query(_calendar(7, None), _calendar_sql("d + 8")),
    "trading_calendar_month": Query(_calendar(None, 1), _calendar_sql("d + INTERVAL '1 month'")),
    "time_parts": Query(_zones, _ZONES_SQL),
    "price_join_day": Query(_join_day, _JOIN_DAY_SQL),
    "price_join_hour": Query(_join_hour, _JOIN_HOUR_SQL),
    "price_join_today": Query(_join_today, _JOIN_TODAY_SQL),
    "price_join_minute": Query(_join_minute, _JOIN_MINUTE_SQL),
    "price_semi": Query(_semi, _SEMI_SQL),
    "latest_test_row": Query(_latest_test, _LATEST_SQL),
    "binary_target": Query(_target(-1), _target_sql(3, "1 FOLLOWING", 5)),
    "binary_target_past": Query(_target(1), _target_sql(5, "1 PRECEDING", 6)),
    "latest_row": Query(_latest, "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1"),
    "forward_fill": Query(_forward_fill, _FORWARD_SQL),
    "minmax": Query(_minmax, _MINMAX_SQL),
    "minmax_reference": Query(_minmax_reference, _MINMAX_REFERENCE_SQL),
    "unit_sum": Query(_unit_sum, _UNIT_SUM_SQL),
    "robust_scale": Query(_robust, _ROBUST_SQL),
    "quantiles": Query(_quantiles, _QUANTILES_SQL),
    "trim_quantiles": Query(_trim, _TRIM_SQL),
    "column_moments": Query(_moments, _MOMENTS_SQL),
    "ensemble_summary": Query(_ensemble, _ENSEMBLE_SQL),
    "ensemble_overall": Query(_ensemble_overall, _ENSEMBLE_OVERALL_SQL),
}
