"""Queries on sources, sinks, loading, the star schema, models and streams."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape import schemas
from crowdtape.functions import entities, patterns
from crowdtape.operators import dedupe, ordered, price_joins, summaries
from crowdtape.plans import forecast, price_features, star_schema, text_features
from crowdtape.sources import posts as post_files, sheets, tables
from crowdtape.sources.staging import new_path, staged
from crowdtape.streaming import posts as streams
from workload.market import (
    HOURLY, LONG, MARKET_POSTS, hourly_prices, long_prices, market_ctes, market_posts, rounded, scaled_posts,
)
from workload.views import POSTS, TAGGED, USERS, WORDS, Query, posts, table, tagged_posts, with_ctes, word_posts


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


# --- loading: history is what came before a date, and deliveries overlap it ---

_STORED_UNTIL, _DELIVERED_FROM = "2024-01-20", "2024-01-10"


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where(F.col("ts") < F.lit(_STORED_UNTIL).cast("timestamp_ntz"))


def _delivery(spark: SparkSession, folder: str) -> DataFrame:
    late = _events(spark, folder).where(F.col("ts") >= F.lit(_DELIVERED_FROM).cast("timestamp_ntz"))
    # Every event arrives twice with different values; the larger one counts.
    return late.withColumn("value", F.explode(F.array(F.col("value") * 2, F.col("value") * 3)))


def _largest():
    return [F.desc("value")]


_LOADED = [
    f"history AS (SELECT * FROM events WHERE ts < TIMESTAMP '{_STORED_UNTIL}')",
    f"delivery AS (SELECT * REPLACE (greatest(value * 2, value * 3) AS value) FROM events WHERE ts >= TIMESTAMP '{_DELIVERED_FROM}')",
]


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.append_newer(_history(spark, folder), _delivery(spark, folder), _largest(), "event_id", "event_type")


_INCREMENTAL_SQL = with_ctes("""
    SELECT * FROM history UNION ALL
    SELECT d.* FROM delivery d LEFT JOIN (SELECT event_type, max(event_id) AS mark FROM history GROUP BY 1) m
        USING (event_type) WHERE mark IS NULL OR event_id > mark""", *_LOADED)


def _upsert(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.upsert(_history(spark, folder), _delivery(spark, folder), _largest(), "event_id")


_UPSERT_SQL = with_ctes("""
    SELECT * FROM delivery UNION ALL
    SELECT * FROM history WHERE event_id NOT IN (SELECT event_id FROM delivery)""", *_LOADED)


def _upsert_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.upsert(_history(spark, folder), _delivery(spark, folder), _largest(), "event_id", distinct_history=True)


def _load_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.load_counts(_history(spark, folder), _delivery(spark, folder), "event_id")


_LOAD_COUNTS_SQL = with_ctes("""
    SELECT (SELECT count(*) FROM delivery WHERE event_id NOT IN (SELECT event_id FROM history)) AS new_rows,
        (SELECT count(*) FROM (SELECT event_id FROM delivery UNION SELECT event_id FROM history)) AS total_rows
    """, *_LOADED)


def _assemble(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's latest event, taken as repeats of one post."""
    arrivals = _events(spark, folder).select(
        F.col("user_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_id").alias("arrival"), "value")
    return dedupe.assemble_posts(arrivals)


_ASSEMBLE_SQL = """
    SELECT user_id AS id, ts AS created_at, event_id AS arrival, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


def _bounded(spark: SparkSession, folder: str) -> DataFrame:
    prices = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("orders"))
    shipped = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return dedupe.bounded_history(prices, shipped, "1998-01-01")


_BOUNDED_SQL = """
    SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders
    WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem)
        AND o_orderdate < DATE '1998-01-01' GROUP BY 1"""


def _since(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.since(_events(spark, folder), "2024-01-15", "ts")


def _key_range(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.key_range(_events(spark, folder), "event_id")


# --- sources and sinks ---

def _group_union(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "text", "role", "turn")
    return post_files.union_tables(documents, turns)


_GROUP_UNION_SQL = """
    SELECT doc_id AS id, lang, text, NULL::VARCHAR AS role, NULL::BIGINT AS turn FROM documents
    UNION ALL SELECT conv_id, NULL, text, role, turn FROM conversations"""


def _user_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables as the files of two users."""
    paths = [f"{folder}/{name}.parquet" for name in ("customer", "supplier")]
    schema = "c_custkey bigint, s_suppkey bigint, c_name string, s_name string"
    files = post_files.read_users(spark, *paths, schema=schema)
    return files.select(
        "user", F.coalesce("c_custkey", "s_suppkey").alias("id"), F.coalesce("c_name", "s_name").alias("name"),
        (F.col("group") != "").alias("has_group"),
    )


_USER_FILES_SQL = """
    SELECT 'customer' AS user, c_custkey AS id, c_name AS name, true AS has_group FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, true FROM supplier"""


def _schema_align(spark: SparkSession, folder: str) -> DataFrame:
    crawled = posts(spark, folder).select(
        "id", F.col("created_at").cast("timestamp"), "text",
        F.col("favorite_count").cast("string").alias("likes"), F.col("retweet_count").alias("retweets"),
        F.lit(0).alias("replies"), F.col("source").alias("websites"),
    )
    return schemas.crawl_as_api(crawled).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


_SCHEMA_ALIGN_SQL = with_ctes("""
    SELECT id, created_at, NULL::VARCHAR AS url, favorite_count, retweet_count, NULL::VARCHAR AS hashtags,
        NULL::VARCHAR AS emojis, NULL::VARCHAR AS emoji_text, NULL::VARCHAR AS usernames, source AS links, text
    FROM posts""", POSTS)

_GROUPS = ["de", "en", "es", "fr"]


def _handles(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet with a column per language, and in it the sources of its documents."""
    documents = table(spark, folder, "documents")
    cells = [F.when(F.col("lang") == g, F.concat_ws("_", "source", "doc_id")).otherwise(F.lit("")).alias(g)
             for g in _GROUPS]
    return sheets.handles_long(documents.select(*cells))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Prices under ticker names, and a sheet that gives some of them labels."""
    events = _events(spark, folder)
    sheet = events.select(F.col("event_type").alias("ticker_name")).distinct().where("ticker_name <> 'error'")
    sheet = sheet.withColumn("ticker_label", F.upper("ticker_name"))
    labelled = sheets.label_rows(events.select("event_id", F.col("event_type").alias("ticker_name")), sheet)
    renamed = sheets.label_columns(labelled, sheets.ticker_labels(sheet, labelled.columns), {"event_id": "timestamp"})
    return renamed.select("timestamp", "ticker_name", "ticker_label")


_LABELS_SQL = """
    SELECT event_id AS timestamp, event_type AS ticker_name,
        CASE WHEN event_type <> 'error' THEN upper(event_type) END AS ticker_label FROM events"""


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    orders, path = table(spark, folder, "orders"), new_path(spark, "orders-csv")
    tables.write_csv(orders, path)
    return tables.read_csv(spark, path, orders.schema)


def _parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "events-by-date")
    dated = _events(spark, folder).withColumn("date", F.to_date("ts"))
    tables.write_table(dated, path, partition_by=["date"])
    return tables.read_table(spark, path).where(F.col("date") >= F.lit("2024-01-05").cast("date"))


_PARQUET_SQL = "SELECT *, CAST(ts AS DATE) AS date FROM events WHERE ts >= TIMESTAMP '2024-01-05'"


# --- star schema ---

def star_posts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return tagged_posts(spark, folder).withColumns({
        "usernames": entities.joined(entities.usernames(text)),
        "hashtags": entities.joined(entities.hashtags(text)),
        "links": entities.joined(entities.links(text)),
        "url": entities.permalink("https://x.example/status/", F.col("id")),
        "emojis": F.lit(""), "emoji_text": F.lit(""),
    })


def _found(pattern: str) -> str:
    return f"trim(array_to_string(regexp_extract_all(text, '{pattern}'), ' '))"


STAR = f"""star AS (SELECT *, {_found(patterns.USERNAME)} AS usernames, {_found(patterns.HASHTAG)} AS hashtags,
    {_found(patterns.LOOSE_LINK)} AS links, 'https://x.example/status/' || id AS url FROM tagged)"""
_USERS = """users AS (SELECT row_number() OVER (ORDER BY "user", "group") AS ID, "user" AS twitter_user,
    "group" AS twitter_group, mentions AS mentioned_users FROM (
        SELECT "user", "group", array_to_string(list_sort(list(DISTINCT usernames)), ' ') AS mentions
        FROM star GROUP BY 1, 2))"""


def _user_dim(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.user_dim(star_posts(spark, folder))


def _user_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.user_mentions(star_posts(spark, folder))


# The languages whose posts are loaded first; the second load brings all.
_FIRST_LOAD = "\"group\" IN ('de', 'fr')"


def _user_dim_twice(spark: SparkSession, folder: str) -> DataFrame:
    star = star_posts(spark, folder)
    first = star_schema.user_dim(star.where(F.col("group").isin("de", "fr")))
    return star_schema.user_dim(star, existing=staged(first, "first-users")).drop("mentioned_users")


_TWICE_SQL = with_ctes(f"""
    SELECT row_number() OVER (ORDER BY NOT {_FIRST_LOAD}, "user", "group") AS ID, "user" AS twitter_user,
        "group" AS twitter_group FROM (SELECT DISTINCT "user", "group" FROM posts)""", POSTS)


def _date_dim(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.date_dim(posts(spark, folder)).drop("ID")


_DATE_DIM_SQL = with_ctes("""
    SELECT id AS twitter_id, created_at AS timestamp, 'UTC' AS timezone, CAST(created_at AS DATE) AS date,
        strftime(created_at, '%H:%M:%S') AS time, CAST(year(created_at) AS INTEGER) AS year,
        CAST(month(created_at) AS INTEGER) AS month, CAST(day(created_at) AS INTEGER) AS day,
        CAST(hour(created_at) AS INTEGER) AS hour, CAST(minute(created_at) AS INTEGER) AS minute,
        CAST(second(created_at) AS INTEGER) AS second
    FROM posts""", POSTS)


def _fact_posts(spark: SparkSession, folder: str) -> DataFrame:
    star = star_posts(spark, folder)
    return star_schema.fact_posts(star, star_schema.user_dim(star)).drop("ID")


_FACT_SQL = with_ctes("""
    SELECT u.ID AS UserID_FK, s.id AS twitter_id, s.text AS raw_text, s.url AS tweet_url, s.favorite_count,
        s.retweet_count, s.hashtags, '' AS emojis, '' AS emoji_text, s.links AS all_urls
    FROM star s LEFT JOIN users u ON u.twitter_user = s."user" AND u.twitter_group = s."group"
    """, POSTS, TAGGED, STAR, _USERS)


def _first_posts(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.first_rows(posts(spark, folder)).select("id", "user", "text")


# --- models ---

def _ols_one(spark: SparkSession, folder: str) -> DataFrame:
    model = forecast.fit_linear(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"])
    fitted = forecast.coefficient_table(model, ["l_quantity"]).select("term", "coefficient")
    return fitted.withColumns({
        "coefficient": F.round("coefficient", 4), "r2": F.round(F.lit(float(model.summary.r2)), 8)})


_OLS_ONE_SQL = """
    SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient,
        round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem
    UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4),
        round(regr_r2(l_extendedprice, l_quantity), 8) FROM lineitem"""


def _ols_metrics(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "lineitem").withColumn(
        "key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    measured = forecast.holdout_metrics(orders, "key", "l_extendedprice", ["l_quantity"], 0.25)
    return measured.select(F.round("rmse", 4).alias("rmse"), F.round(F.col("mse") / 1000, 3).alias("mse_thousands"), "rows")


_OLS_METRICS_SQL = """
    WITH s AS (SELECT l_extendedprice AS y, l_quantity AS x, CAST('0x' || substr(md5(
            l_orderkey || '-' || l_linenumber || '-' || l_partkey || ':0'), 1, 8) AS BIGINT) / 4294967296.0 AS share
        FROM lineitem),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE share >= 0.25),
    e AS (SELECT power(y - (a * x + b), 2) AS e FROM s CROSS JOIN m WHERE share < 0.25)
    SELECT round(sqrt(avg(e)), 4) AS rmse, round(avg(e) / 1000, 3) AS mse_thousands, count(*) AS rows FROM e"""


def _best_worst(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    model = forecast.fit_linear(items, "l_extendedprice", ["l_quantity"])
    cases = forecast.best_worst_case(model, items, items, ["l_quantity"])
    return rounded(cases.select("l_orderkey", "l_linenumber", "prediction", "best_case", "worst_case"),
                   "prediction", "best_case", "worst_case", digits=3)


_BEST_WORST_SQL = """
    SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 3) AS prediction,
        round(a * (l_quantity + s) + b, 3) AS best_case, round(a * (l_quantity - s) + b, 3) AS worst_case
    FROM lineitem CROSS JOIN (SELECT regr_slope(l_extendedprice, l_quantity) AS a,
        regr_intercept(l_extendedprice, l_quantity) AS b, stddev_samp(l_quantity) AS s FROM lineitem)"""

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The last day's price of one ticker, from the hourly sums of the days before."""
    hourly = staged(market_posts(spark, folder), "market-sums")
    prices = staged(hourly_prices(spark, folder), "hourly-prices")
    day = price_joins.on_day(hourly, price_joins.last_day(prices))
    predicted = forecast.forecast_day(hourly, day, prices, "view", ["value"])
    return rounded(predicted, "prediction", digits=5)


_FORECAST_SQL = with_ctes("""
    SELECT timestamp, round(a * value + b, 5) AS prediction
    FROM market CROSS JOIN (
        SELECT regr_slope(view, value) AS a, regr_intercept(view, value) AS b
        FROM market JOIN hourly USING (timestamp)
        WHERE CAST(timestamp AS DATE) < (SELECT CAST(max(timestamp) AS DATE) FROM hourly))
    WHERE CAST(timestamp AS DATE) = (SELECT CAST(max(timestamp) AS DATE) FROM hourly)""", HOURLY, *MARKET_POSTS)


def _ols_many(spark: SparkSession, folder: str) -> DataFrame:
    model = forecast.fit_linear(table(spark, folder, "lineitem"), "l_extendedprice", _FEATURES)
    fitted = forecast.coefficient_table(model, _FEATURES)
    return rounded(fitted.select("term", "coefficient", "std_error", "t"), "coefficient", "std_error", "t", digits=4)


# Three features less their means: the normal equations by Cramer's rule, errors from the inverse's diagonal.
_OLS_MANY_SQL = """
    WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a,
        CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c FROM lineitem),
    m AS (SELECT avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c, count(*) AS n FROM d),
    s AS (SELECT sum((d.a - m.a) * (d.a - m.a)) AS aa, sum((d.a - m.a) * (d.b - m.b)) AS ab, sum((d.a - m.a) * (d.c - m.c)) AS ac,
        sum((d.b - m.b) * (d.b - m.b)) AS bb, sum((d.b - m.b) * (d.c - m.c)) AS bc, sum((d.c - m.c) * (d.c - m.c)) AS cc,
        sum((d.a - m.a) * (d.y - m.y)) AS ay, sum((d.b - m.b) * (d.y - m.y)) AS by_, sum((d.c - m.c) * (d.y - m.y)) AS cy FROM d CROSS JOIN m),
    e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
    i AS (SELECT (bb * cc - bc * bc) / det AS i11, (ac * bc - ab * cc) / det AS i12, (ab * bc - ac * bb) / det AS i13,
        (aa * cc - ac * ac) / det AS i22, (ab * ac - aa * bc) / det AS i23, (aa * bb - ab * ab) / det AS i33, ay, by_, cy FROM e),
    w AS (SELECT i11 * ay + i12 * by_ + i13 * cy AS wa, i12 * ay + i22 * by_ + i23 * cy AS wb,
        i13 * ay + i23 * by_ + i33 * cy AS wc, i.* FROM i),
    f AS (SELECT w.*, m.y - wa * m.a - wb * m.b - wc * m.c AS w0, m.a AS ma, m.b AS mb, m.c AS mc, m.n FROM w CROSS JOIN m),
    r AS (SELECT sum(power(d.y - (w0 + wa * a + wb * b + wc * c), 2)) / (any_value(n) - 4) AS v FROM d CROSS JOIN f),
    g AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'intercept']) AS term, unnest([wa, wb, wc, w0]) AS coefficient,
        unnest([sqrt(v * i11), sqrt(v * i22), sqrt(v * i33), sqrt(v * (1.0 / n + ma * ma * i11 + mb * mb * i22 + mc * mc * i33
            + 2 * (ma * mb * i12 + ma * mc * i13 + mb * mc * i23)))]) AS std_error FROM f CROSS JOIN r)
    SELECT term, round(coefficient, 4) AS coefficient, round(std_error, 4) AS std_error,
        round(coefficient / std_error, 4) AS t FROM g"""


def _naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the price exceeds its window's mean, told from the two."""
    features = ["price", "window_mean"]
    labelled = staged(ordered.binary_target(long_prices(spark, folder)), "target").where(F.col("window_mean").isNotNull())
    keyed = labelled.select(F.concat_ws("@", "ticker", "ts").alias("key"), *features, F.col("y").alias("label"))
    train, test = forecast.train_test_split(keyed, "key", 0.2)
    return rounded(summaries.confusion_metrics(
        forecast.predict(forecast.fit_naive_bayes(train, "label", features), test, features)),
        "accuracy", "precision", "recall", "f1", digits=9)


# A class's score: its share and, for each feature, the normal density by its mean and variance, in logarithms.
_BAYES = [LONG, """target AS (
    SELECT *, CASE WHEN price > window_mean THEN 1 ELSE 0 END AS y,
        CAST('0x' || substr(md5(key || ':0'), 1, 8) AS BIGINT) / 4294967296.0 AS share FROM (
        SELECT ticker || '@' || ts AS key, price, avg(price) OVER frame AS window_mean, count(*) OVER frame AS n,
            row_number() OVER (PARTITION BY ticker ORDER BY ts) AS number
        FROM prices WINDOW frame AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING))
    WHERE n = 5 AND number >= 5)""", """j AS (
    SELECT label AS y, CASE WHEN max(score) FILTER (class = 1) > max(score) FILTER (class = 0) THEN 1 ELSE 0 END AS p FROM (
        SELECT t.key, t.label, m.y AS class, ln(m.n / CAST(sum(m.n) OVER (PARTITION BY t.key) AS DOUBLE))
            - (ln(m.va) + power(t.price - m.a, 2) / m.va + ln(m.vb) + power(t.window_mean - m.b, 2) / m.vb) / 2 AS score
        FROM (SELECT *, y AS label FROM target WHERE share < 0.2) t CROSS JOIN (
            SELECT y, count(*) AS n, avg(price) AS a, avg(window_mean) AS b,
                var_pop(price) + any_value(least_variance) AS va, var_pop(window_mean) + any_value(least_variance) AS vb
            FROM target CROSS JOIN (SELECT 1e-9 * greatest(var_pop(price), var_pop(window_mean)) AS least_variance
                FROM target WHERE share >= 0.2) WHERE share >= 0.2 GROUP BY y) m)
    GROUP BY key, label)"""]


def _cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    fitted = forecast.cross_validate(table(spark, folder, "lineitem"), "l_extendedprice", _FEATURES,
                                     F.concat_ws(":", "l_orderkey", "l_linenumber"), folds=3)
    return spark.createDataFrame([(round(float(fitted.avgMetrics[0]), 8),)], "mean_r2 double")


# The normal equations of three features less their means, by Cramer's rule, for each ``g`` of the rows in ``d``.
_NORMAL = [
    "centre AS (SELECT g, avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d GROUP BY g)",
    """s AS (SELECT g, sum((d.a - m.a) * (d.a - m.a)) AS aa, sum((d.a - m.a) * (d.b - m.b)) AS ab,
        sum((d.a - m.a) * (d.c - m.c)) AS ac, sum((d.b - m.b) * (d.b - m.b)) AS bb, sum((d.b - m.b) * (d.c - m.c)) AS bc,
        sum((d.c - m.c) * (d.c - m.c)) AS cc, sum((d.a - m.a) * (d.y - m.y)) AS ay, sum((d.b - m.b) * (d.y - m.y)) AS by_,
        sum((d.c - m.c) * (d.y - m.y)) AS cy FROM d JOIN centre m USING (g) GROUP BY g)""",
    """w AS (SELECT *, y - wa * a - wb * b - wc * c AS w0 FROM centre JOIN (
        SELECT g, (ay * (bb * cc - bc * bc) + by_ * (ac * bc - ab * cc) + cy * (ab * bc - ac * bb)) / det AS wa,
            (ay * (ac * bc - ab * cc) + by_ * (aa * cc - ac * ac) + cy * (ab * ac - aa * bc)) / det AS wb,
            (ay * (ab * bc - ac * bb) + by_ * (ab * ac - aa * bc) + cy * (aa * bb - ab * ab)) / det AS wc
        FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)) USING (g))""",
]
_CROSS_SQL = with_ctes("""
    SELECT round(avg(r2), 8) AS mean_r2 FROM (
        SELECT fold, 1 - sum(power(r.y - (w0 + wa * r.a + wb * r.b + wc * r.c), 2))
            / (var_pop(r.y) * count(*)) AS r2 FROM r JOIN w ON g = fold GROUP BY fold)""", """
    r AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b,
        CAST(l_tax AS DOUBLE) AS c, CAST(floor(CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':42'), 1, 8) AS BIGINT)
            / 4294967296.0 * 3) AS INTEGER) AS fold FROM lineitem)""",
    "d AS (SELECT r.*, g FROM r JOIN (SELECT unnest([0, 1, 2]) AS g) ON fold <> g)", *_NORMAL)


def _forecast_many(spark: SparkSession, folder: str) -> DataFrame:
    """The last day's price of one ticker, from another's and the posts' features, one of which is always 0."""
    wide = text_features.intraday_features(scaled_posts(spark, folder), [*USERS, "nobody"], "byhour")
    prices = staged(hourly_prices(spark, folder), "hourly-prices")
    features = ["click", *price_joins.columns_like(wide, "_nobody$|_count$")]
    merged = staged(price_features.merged_history(prices, wide).select("timestamp", *features), "merged")
    day = price_joins.on_day(merged, price_joins.last_day(merged))
    return rounded(forecast.forecast_day(merged, day, prices, "view", features), "prediction", digits=5)


_FORECAST_MANY_SQL = with_ctes("""
    SELECT timestamp, round(w0 + wa * x.a + wb * x.b + wc * x.c, 5) AS prediction
    FROM x CROSS JOIN w WHERE CAST(timestamp AS DATE) = (SELECT CAST(max(timestamp) AS DATE) FROM x)""",
    POSTS, HOURLY, """
    counted AS (SELECT created_at, (favorite_count - lo1) / CAST(hi1 - lo1 AS DOUBLE) AS favorite_count,
        (retweet_count - lo2) / CAST(hi2 - lo2 AS DOUBLE) AS retweet_count
        FROM posts CROSS JOIN (SELECT min(favorite_count) AS lo1, max(favorite_count) AS hi1,
            min(retweet_count) AS lo2, max(retweet_count) AS hi2 FROM posts))""", """
    b AS (SELECT time_bucket(INTERVAL '1 hour', created_at, INTERVAL '30 minutes') AS created_at,
        sum(favorite_count) AS favorite_count, sum(retweet_count) AS retweet_count FROM counted GROUP BY 1)""", """
    filled AS (SELECT created_at, coalesce(favorite_count, 0.0) AS favorite_count, coalesce(retweet_count, 0.0) AS retweet_count
        FROM b FULL JOIN (SELECT unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL '1 day'))
            + INTERVAL '13 hours 30 minutes' AS created_at FROM (SELECT min(created_at) AS lo, max(created_at) AS hi FROM b))
        USING (created_at))""",
    *market_ctes(keys="", measures="sum(favorite_count) AS favorite_count, sum(retweet_count) AS retweet_count",
                 source="filled", columns="favorite_count, retweet_count"),
    """x AS (SELECT timestamp, view AS y, coalesce(click, 0.0) AS a, favorite_count AS b, retweet_count AS c
        FROM hourly JOIN market USING (timestamp))""",
    """d AS (SELECT *, 0 AS g FROM x
        WHERE y IS NOT NULL AND CAST(timestamp AS DATE) < (SELECT CAST(max(timestamp) AS DATE) FROM x))""", *_NORMAL)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The quality label against a rule on the text length."""
    documents = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("prediction"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(documents, "doc_id")


def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.confusion_metrics(_judged(spark, folder)), "accuracy", "precision", "recall", "f1", digits=9)


_JUDGED = """j AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p
    FROM labels JOIN documents USING (doc_id))"""
_CONFUSION = """
    SELECT tn, fp, fn, tp, round((tp + tn) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 9) AS accuracy,
        round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS precision,
        round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall,
        round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 9) AS f1
    FROM (SELECT count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp,
        count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM j)"""


def _class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.class_report(_judged(spark, folder)), "precision", "recall", "f1", digits=9)


_REPORT_SQL = with_ctes("""
    SELECT class, round(hits / nullif(CAST(predicted AS DOUBLE), 0), 9) AS precision,
        round(hits / nullif(CAST(support AS DOUBLE), 0), 9) AS recall,
        round(2 * hits / nullif(CAST(predicted + support AS DOUBLE), 0), 9) AS f1, support
    FROM (SELECT c.class, count(*) FILTER (y = c.class AND p = c.class) AS hits,
            count(*) FILTER (p = c.class) AS predicted, count(*) FILTER (y = c.class) AS support
        FROM j CROSS JOIN (SELECT DISTINCT y AS class FROM j UNION SELECT DISTINCT p FROM j) c GROUP BY c.class)
    """, _JUDGED)


def _word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every word has a vector; SQL knows the words and their length."""
    vectors = forecast.word_vectors(word_posts(spark, folder), size=8)
    return vectors.select("word", F.size("vector").cast("long").alias("size"))


_WORD_VECTORS_SQL = with_ctes("SELECT DISTINCT unnest(words) AS word, 8 AS size FROM words", POSTS, WORDS)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.embedding_clusters(table(spark, folder, "embeddings"), k=8).select("vec_id", "cluster")


def _components(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.embedding_components(table(spark, folder, "embeddings")).select(
        "vec_id", F.col("components").cast("string").alias("components"))


# --- streams ---

def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = _events(spark, folder).schema
    return streams.read_stream(spark, f"{folder}/events.parquet", schema, "ts")


def _written(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = new_path(spark, name)
    streams.write_stream(stream, path, f"{path}-progress").awaitTermination()
    written = spark.read.schema(stream.schema).parquet(path)
    return written.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Every event delivered twice."""
    twice = _stream(spark, folder).union(_stream(spark, folder))
    return _written(streams.distinct_posts(twice, "event_id", "ts"), "distinct-events")


def _stream_buckets(spark: SparkSession, folder: str) -> DataFrame:
    sums = streams.streamed_bucket_sums(
        _stream(spark, folder), ["value"], "1 hour", offset="30 minutes", keys=["event_type"], ts="ts")
    return rounded(_written(sums, "bucket-sums"), "value")


_STREAM_BUCKETS_SQL = """
    SELECT event_type, b AS ts, round(sum(value), 4) AS value
    FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes') AS b FROM events)
    WHERE b + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1, 2"""


def _stream_history(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "arrivals")
    streams.log_arrivals(_stream(spark, folder), path, f"{path}-progress").awaitTermination()
    latest = streams.read_history(spark, path, "user_id", [F.desc("event_id")])
    return latest.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


_STREAM_HISTORY_SQL = """
    SELECT user_id, event_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

QUERIES = {
    "incremental_load": Query(_incremental, _INCREMENTAL_SQL),
    "upsert_latest": Query(_upsert, _UPSERT_SQL),
    "upsert_distinct": Query(_upsert_distinct, _UPSERT_SQL),
    "load_counts": Query(_load_counts, _LOAD_COUNTS_SQL),
    "assemble_posts": Query(_assemble, _ASSEMBLE_SQL),
    "bounded_history": Query(_bounded, _BOUNDED_SQL),
    "since_date": Query(_since, "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15'"),
    "key_range": Query(_key_range, "SELECT min(event_id) AS oldest, max(event_id) AS newest FROM events"),
    "group_union": Query(_group_union, _GROUP_UNION_SQL),
    "user_files": Query(_user_files, _USER_FILES_SQL),
    "schema_align": Query(_schema_align, _SCHEMA_ALIGN_SQL),
    "handles_long": Query(
        _handles, "SELECT lang AS \"group\", source || '_' || doc_id AS \"user\" FROM documents"),
    "ticker_labels": Query(_labels, _LABELS_SQL),
    "csv_round_trip": Query(_csv, "SELECT * FROM orders"),
    "parquet_by_date": Query(_parquet, _PARQUET_SQL),
    "user_dim": Query(_user_dim, with_ctes(
        "SELECT ID, twitter_user, twitter_group, mentioned_users FROM users", POSTS, TAGGED, STAR, _USERS)),
    "user_dim_two_loads": Query(_user_dim_twice, _TWICE_SQL),
    "user_mentions": Query(_user_mentions, with_ctes(
        'SELECT DISTINCT "user" AS twitter_user, "group" AS twitter_group, usernames AS mentioned_users FROM star',
        POSTS, TAGGED, STAR)),
    "date_dim": Query(_date_dim, _DATE_DIM_SQL),
    "fact_posts": Query(_fact_posts, _FACT_SQL),
    "first_posts": Query(_first_posts, with_ctes(
        'SELECT id, "user", text FROM posts ORDER BY id LIMIT 100', POSTS)),
    "ols_one_feature": Query(_ols_one, _OLS_ONE_SQL),
    "ols_metrics": Query(_ols_metrics, _OLS_METRICS_SQL),
    "best_worst_case": Query(_best_worst, _BEST_WORST_SQL),
    "forecast_day": Query(_forecast, _FORECAST_SQL),
    "forecast_many": Query(_forecast_many, _FORECAST_MANY_SQL),
    "ols_many": Query(_ols_many, _OLS_MANY_SQL),
    "naive_bayes": Query(_naive_bayes, with_ctes(_CONFUSION, *_BAYES)),
    "cross_validation": Query(_cross_validation, _CROSS_SQL),
    "confusion_report": Query(_confusion, with_ctes(_CONFUSION, _JUDGED)),
    "class_report": Query(_class_report, _REPORT_SQL),
    "word_vectors": Query(_word_vectors, _WORD_VECTORS_SQL),
    "embedding_clusters": Query(_clusters),
    "embedding_components": Query(_components),
    "stream_dedupe": Query(_stream_dedupe, "SELECT * FROM events"),
    "stream_buckets": Query(_stream_buckets, _STREAM_BUCKETS_SQL),
    "stream_history": Query(_stream_history, _STREAM_HISTORY_SQL),
}
