"""Lookups, quantiles, scaling, ordered operators, loading, the star schema, models and sources."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtape import schemas
from crowdtape.operators import dedupe, lookup, ordered, price_joins, quantiles, scaling, summaries
from crowdtape.plans import forecast, price_features, star_schema
from crowdtape.sources import database, posts as post_files, sheets, tables
from crowdtape.sources.staging import Scope, new_path, staged, staging_folder


def found(df, *columns):
    return sorted(tuple(row[c] for c in columns or df.columns) for row in df.collect())


# --- lookups ---

@pytest.mark.parametrize("limit", [1, 3, 200_000])
def test_left_lookup_is_a_left_join(spark, limit):
    rows = [(i, key) for i, key in enumerate(["hot"] * 20 + ["b", "c", "missing", None, "b"])]
    left = spark.createDataFrame(rows, "id int, key string")
    table = spark.createDataFrame([("hot", 1), ("b", 2), ("c", 3), ("unused", 4)], "key string, v int")
    values = {"hot": 1, "b": 2, "c": 3}
    expected = sorted((i, -1 if values.get(k) is None else values[k]) for i, k in rows)
    joined = lookup.left_lookup(left, table, "key", limit).fillna(-1, ["v"])
    assert found(joined, "id", "v") == expected


def test_left_lookup_of_a_frequent_key_without_entry(spark):
    left = spark.createDataFrame([(i, "gone") for i in range(9)] + [(9, "b")], "id int, key string")
    table = spark.createDataFrame([("b", 2)], "key string, v int")
    joined = lookup.left_lookup(left, table, "key", 2)
    assert [(r.id, r.v) for r in joined.orderBy("id").collect()] == [(i, None) for i in range(9)] + [(9, 2)]


# --- quantiles and scaling ---

@pytest.mark.parametrize("kind", ["distinct", "ties", "skewed", "two values", "one row"])
def test_quantiles_are_exact(spark, kind):
    chance = random.Random(kind)
    values = {
        "distinct": [chance.gauss(0, 1e6) for _ in range(5000)],
        "ties": [float(chance.randrange(7)) for _ in range(5000)],
        "skewed": [3.0] * 3000 + [chance.random() * 1e9 for _ in range(2000)],
        "two values": [1.0] * 500 + [2.0] * 500,
        "one row": [4.5],
    }[kind]
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([(v, -v) for v in values] + [(None, None)], "a double, b double").repartition(5)
    result = {r["column"]: [r[f"q{i}"] for i in range(len(shares))] for r in quantiles.exact_quantiles(df, ["a", "b"], shares).collect()}
    assert result["a"] == pytest.approx(list(np.quantile(values, shares)))
    assert result["b"] == pytest.approx(list(np.quantile([-v for v in values], shares)))


def test_quantiles_of_short_columns(spark):
    chance = random.Random(9)
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    columns = {f"c{n}": [chance.choice([chance.random(), 0.5]) for _ in range(n)] for n in (2, 3, 7, 20, 39, 159)}
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(159)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    for row in quantiles.exact_quantiles(df, list(columns), shares).collect():
        expected = list(np.quantile(columns[row["column"]], shares))
        assert [row[f"q{i}"] for i in range(len(shares))] == pytest.approx(expected), row["column"]


@pytest.mark.parametrize("parts", [1, 2, 50])
def test_quantiles_take_as_many_passes_as_they_need(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "_PARTS", parts)
    values = [random.Random(1).random() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(7)
    row = quantiles.exact_quantiles(df, ["a"], [0.1, 0.5, 0.77]).first()
    assert [row.q0, row.q1, row.q2] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.77])))


def test_quantiles_of_extreme_values(spark):
    least, most, endless = 5e-324, 1.7976931348623157e308, float("inf")
    df = spark.createDataFrame(
        [(v, w) for v, w in zip([-endless, -most, 0.0, least, most, endless, float("nan"), None],
                                [None, None, endless, None, None, None, None, None])], "a double, b double")
    result = {r["column"]: r for r in quantiles.exact_quantiles(df, ["a", "b"], [0.2, 0.4, 0.6, 0.8]).collect()}
    assert [result["a"][f"q{i}"] for i in range(4)] == [-most, 0.0, least, most]
    assert (result["a"]["rows"], result["b"]["rows"], result["b"]["q2"]) == (6, 1, endless)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2), (2.0, 5.0, 0), (5.0, 5.0, 4)], "a double, flat double, n int")
    assert [r.a for r in scaling.min_max(df, ["a"]).orderBy("a").collect()] == [0.0, 0.25, 1.0]
    assert [r.flat for r in scaling.min_max(df, ["flat"]).collect()] == [None] * 3
    assert sorted(r.n for r in scaling.min_max(df, ["n"], skip_zero=True).collect()) == [-1.0, 0.0, 1.0]
    reference = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    assert [r.a for r in scaling.min_max(df, ["a"], reference).orderBy("a").collect()] == [0.1, 0.2, 0.5]
    assert sum(r.a for r in scaling.to_unit_sum(df, ["a", "n"]).collect()) == pytest.approx(1)


def test_robust_scaling_uses_limits_of_the_unscaled_table(spark):
    values = [float(v) for v in (1, 2, 3, 4, 100)]
    df = spark.createDataFrame([(v,) for v in values], "`x.y` double")
    limits = scaling.robust_limits(df, ["x.y"])
    assert found(limits) == [("x.y", 3.0, 4.0, 2.0)]
    assert [r[0] for r in scaling.robust_scale(df, ["x.y"]).collect()] == [(v - 3) / 2 for v in values]
    other = spark.createDataFrame([(5.0,)], "`x.y` double")
    assert scaling.robust_scale(other, ["x.y"], limits).first()[0] == 1.0


def test_trim_and_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert found(scaling.trim_quantiles(df, ["v"])) == [(float(v),) for v in range(5, 96)]
    row = scaling.moments(df, ["v"]).first()
    assert (row["mean"], row["std"]) == pytest.approx((50.0, np.std(range(101), ddof=1)))


# --- ordered ---

def prices(spark, values, ticker="T", start="2023-07-03"):
    first = dt.datetime.fromisoformat(start)
    rows = [(ticker, first + dt.timedelta(hours=7 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double")


def test_target_golden(spark):
    rows = ordered.binary_target(prices(spark, [1, 2, 3, 4, 5, 9, 1])).orderBy("ts").collect()
    assert [r.y for r in rows] == [0, 0, 0, 0, 1, 1, 0]
    assert [r.window_mean for r in rows] == pytest.approx([None] * 4 + [4.6, 4.4, None])
    unknown = ordered.binary_target(prices(spark, [1, 2, 3, 4, 5, 9, 1]), incomplete=None)
    assert [r.y for r in unknown.orderBy("ts").collect()] == [None, None, None, None, 1, 1, None]


@pytest.mark.parametrize("shift, day", [(-1, 5), (1, 5), (0, 3), (-2, 4), (3, 2)])
def test_target_does_not_depend_on_blocks(spark, shift, day):
    chance = random.Random(day)
    series = [chance.randrange(50) for _ in range(40)]
    both = prices(spark, series).union(prices(spark, series[::-1], "U"))
    for block in (2, 3, 1000):
        rows = ordered.binary_target(both, day=day, shift=shift, block_size=block).orderBy("ticker", "ts").collect()
        for ticker, values in (("T", series), ("U", series[::-1])):
            means = []
            for i in range(len(values)):
                window = range(i - shift - day + 1, i - shift + 1)
                full = i + 1 >= day and window[0] >= 0 and window[-1] < len(values)
                means.append(sum(values[j] for j in window) / day if full else None)
            mine = [r for r in rows if r.ticker == ticker]
            assert [r.window_mean for r in mine] == pytest.approx(means)
            assert [r.y for r in mine] == [int(m is not None and v > m) for v, m in zip(values, means)]


def test_forward_fill_carries_over_slots(spark):
    df = prices(spark, [1, 0, 0, 0, 0, 0, 0, 0, 5, 0]).withColumn("price", F.nullif("price", F.lit(0.0)))
    df = df.union(prices(spark, [0, 2], "U").withColumn("price", F.nullif("price", F.lit(0.0))))
    rows = ordered.forward_fill(df, ["price"], ["ticker"], "ts").orderBy("ticker", "ts").collect()
    assert [r.price for r in rows] == [1.0] * 8 + [5.0] * 2 + [None, 2.0]


def test_an_hour_of_one_series_is_divided(spark):
    """All rows within one hour, most of them of one series and some of them at the same time."""
    chance, first = random.Random(9), dt.datetime(2023, 7, 3, 10)
    rows = [("T", first + dt.timedelta(seconds=i), chance.choice([None, float(chance.randrange(9))]), i) for i in range(300)]
    rows += [("U", first + dt.timedelta(seconds=i // 40), float(i), i) for i in range(80)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double, n int").repartition(3)
    slots = ordered.in_slots(df, ["ticker"], "ts", 10)
    sizes = [r["count"] for r in slots.groupBy("ticker", "_slot").count().collect()]
    assert sum(sizes) == 380 and len(sizes) > 20 and max(sizes) < 40
    numbered = ordered.number_rows(slots, ["ticker"], ["ts"]).collect()
    for ticker in "TU":
        mine = sorted((r.position, r.ts) for r in numbered if r.ticker == ticker)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [t for _, t in mine] == sorted(t for _, t in mine)

    def in_order(frame):
        return frame.where("ticker = 'T'").orderBy("n").drop("n").collect()

    filled = ordered.forward_fill(df, ["price"], ["ticker"], "ts", slot_rows=10)
    assert in_order(filled) == in_order(ordered.forward_fill(df, ["price"], ["ticker"], "ts")) and filled.count() == 380
    whole = df.where("price IS NOT NULL")
    few = ordered.binary_target(whole, slot_rows=10, block_size=7)
    assert in_order(few) == in_order(ordered.binary_target(whole))


def test_latest_row(spark):
    assert ordered.latest_row(prices(spark, [3, 1, 2]), "ts").first().price == 2.0


def test_ids_are_dense_and_ordered(spark):
    names = [f"n{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in random.Random(2).sample(names, 200)], "name string").repartition(7)
    assert found(ordered.dense_ids(df, ["name"]), "ID", "name") == [(i + 1, n) for i, n in enumerate(names)]


# --- loading ---

def test_newer_rows_and_append(spark):
    history = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], "id int, user string")
    landed = spark.createDataFrame([(5, "a"), (6, "a"), (6, "a"), (2, "b"), (9, "c")], "id int, user string")
    assert found(dedupe.newer_rows(landed, history)) == [(6, "a"), (6, "a"), (9, "c")]
    appended = dedupe.append_newer(history, landed, [F.desc("user")])
    assert found(appended) == [(1, "a"), (2, "b"), (5, "a"), (6, "a"), (9, "c")]
    assert found(dedupe.append_newer(appended, landed, [F.desc("user")])) == found(appended)


def test_the_order_decides_among_repeats(spark):
    rows = [(1, "early", 1), (1, "late", 2), (2, "only", 1)]
    for arranged in (rows, rows[::-1]):
        new = spark.createDataFrame(arranged, "id int, user string, arrival int").coalesce(1)
        last = [F.desc("arrival")]
        assert found(dedupe.append_newer(new.limit(0), new, last)) == [(1, "late", 2), (2, "only", 1)]
        assert found(dedupe.upsert(new.limit(0), new, last)) == [(1, "late", 2), (2, "only", 1)]
        assert found(dedupe.upsert(new.limit(0), new, last, distinct_history=True)) == [(1, "late", 2), (2, "only", 1)]


def test_logarithms_scale_where_values_cannot(spark):
    for logs in ([-1000.0, -1001.0, None], [900.0, 899.0, 0.0], [-0.5, -1.5]):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "id int, lp double")
        values = [r.p for r in scaling.logs_to_unit_sum(df, {"p": "lp"}).orderBy("id").collect()]
        assert sum(values) == pytest.approx(1) and values[0] / values[1] == pytest.approx(np.e)


def test_rows_without_a_feature_keep_their_place(spark):
    rows = [(i, float(i), None if i % 7 == 3 else float(i % 5), 2.0 * i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    with pytest.warns(UserWarning, match="9 rows"):
        model = forecast.fit_linear(df, "y", ["a", "b"])
    predicted = {r.id: r.prediction for r in forecast.predict(model, df, ["a", "b"]).collect()}
    assert len(predicted) == 60
    assert all(predicted[i] is None if b is None else predicted[i] == pytest.approx(y, abs=1e-6) for i, _, b, y in rows)


def test_rows_in_no_series_stay(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(minutes=i), float(i)) for i in range(8)] + [(None, at, 1.0), ("a", None, None)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, price double")
    target = ordered.binary_target(df, incomplete=None).collect()
    assert len(target) == 10 and all(r.y is None for r in target if r.ticker is None or r.ts is None)
    filled = ordered.forward_fill(df, ["price"], ["ticker"], "ts").collect()
    assert sorted(filled, key=str) == sorted(df.collect(), key=str)


def test_a_flat_feature_leaves_the_forecast(spark):
    at = dt.datetime(2024, 1, 1)
    days = [(at + dt.timedelta(days=i), float(i), 1.0 if i == 4 else 0.0, 3.0 * i) for i in range(41)]
    df = spark.createDataFrame(days, "timestamp timestamp, dense double, sparse double, price double")
    history, day = df.where("dense < 40"), df.where("dense = 40")
    found_price = forecast.forecast_day(history, day.drop("price"), df, "price", ["dense", "sparse"]).first().prediction
    assert found_price == pytest.approx(120.0)
    with pytest.raises(ValueError):
        forecast.forecast_day(history, day.drop("price"), df, "price", ["sparse"])


def test_upsert_keeps_the_new_row_and_is_idempotent(spark):
    history = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "id int, v string")
    merged = dedupe.upsert(history, new, [F.desc("v")])
    assert found(merged) == [(1, "old"), (2, "new"), (3, "new")]
    assert found(dedupe.upsert(merged, new, [F.desc("v")])) == found(merged)
    assert found(dedupe.load_counts(history, new)) == [(1, 3)]
    assert found(dedupe.upsert(history, new.union(new), [F.desc("v")], distinct_history=True)) == found(merged)


def test_assembled_posts_are_newest_first(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 2, 30), (1, 3, 20)], "id int, arrival int, created_at int")
    assert [(r.id, r.created_at) for r in dedupe.assemble_posts(df).collect()] == [(2, 30), (1, 20)]


def test_bounded_history(spark):
    days = spark.createDataFrame([(dt.date(1999, 1, 1),), (dt.date(2020, 1, 1),), (dt.date(2021, 1, 1),)], "date date")
    posts = spark.createDataFrame([(dt.date(2020, 6, 1),)], "date date")
    assert found(dedupe.bounded_history(days, posts, "2021-01-02")) == [(dt.date(2021, 1, 1),)]
    assert found(dedupe.bounded_history(days, None, "2021-01-01")) == [(dt.date(2020, 1, 1),)]
    assert found(dedupe.bounded_history(days, posts.limit(0), "2021-01-01")) == [(dt.date(2020, 1, 1),)]


def test_cut_reaches_the_parquet_reader(spark):
    path = new_path(spark, "cut")
    prices(spark, [1, 2, 3]).write.parquet(path)
    plan = dedupe.since(spark.read.parquet(path), "2023-07-03", "ts")._jdf.queryExecution().toString()
    assert "GreaterThan(ts" in plan


# --- joins ---

def test_price_joins(spark):
    stock = spark.createDataFrame([("2023-07-03", 1.0), ("2023-07-04", None)], "date string, AAPL double")
    posts = spark.createDataFrame([("2023-07-04", 7), ("2023-07-05", 8)], "date string, likes int")
    assert found(price_joins.join_on_time(stock, posts, "date")) == [("2023-07-04", 0.0, 7)]
    training = price_joins.except_day(prices(spark, range(6)), F.to_date(F.lit("2023-07-04")), "ts")
    assert found(price_joins.prices_in_training(prices(spark, range(6)), training, "price", "ts"), "price") == [
        (0.0,), (1.0,), (2.0,), (3.0,)]
    assert len(found(price_joins.on_day(prices(spark, range(6)), price_joins.last_day(prices(spark, range(6)), "ts"), "ts"))) == 2


def test_columns_by_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "unigram_CNN int, likes int, bigram_CNN int, AAPL int")
    assert price_joins.columns_like(df) == ["unigram_CNN", "bigram_CNN"]


def test_price_features(spark):
    stock = spark.createDataFrame([(dt.date(2023, 7, d), v) for d, v in ((3, None), (4, 2.0), (5, 4.0), (6, 9.0))], "date date, A double")
    scaled = price_features.historical_prices(stock, None, "2023-07-06", ["A"])
    assert [r.A for r in scaled.orderBy("date").collect()] == [0.0, 0.5, 1.0]
    today = price_features.todays_prices(spark.createDataFrame([(3.0,)], "A double"), stock.where("date < '2023-07-06'"), ["A"])
    assert today.first().A == 0.5
    posts = prices(spark, range(12), start="2023-07-07").withColumnRenamed("price", "likes").withColumnRenamed("ts", "timestamp")
    hourly = prices(spark, range(12), start="2023-07-07").withColumnRenamed("ts", "timestamp").select("timestamp", "price")
    assert {r.timestamp.date() for r in price_features.merged_today(hourly, posts, "2023-07-09").collect()} == {dt.date(2023, 7, 7)}


# --- summaries and models ---

def test_classification_summary(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    row = summaries.confusion_metrics(df).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 1, 2)
    assert (row.accuracy, row.precision, row.recall, row.f1) == pytest.approx((0.6, 2 / 3, 2 / 3, 2 / 3))
    report = {r["class"]: r for r in summaries.class_report(df).collect()}
    assert (report[0].precision, report[0].recall, report[0].support) == pytest.approx((0.5, 0.5, 2))
    assert report[1].f1 == pytest.approx(2 / 3)


def test_ensemble(spark):
    runs = spark.createDataFrame([(1, "t1", 1.0), (2, "t1", 3.0), (1, "t2", 5.0), (2, "t2", 7.0)], "run_id int, timestamp string, value double")
    assert found(summaries.ensemble_by_time(runs)) == [("t1", 2.0), ("t2", 6.0)]
    assert found(summaries.ensemble_overall(runs)) == [(4.0, pytest.approx(np.std([1, 3, 5, 7])))]


def test_least_squares(spark):
    chance = random.Random(5)
    rows = [(i, chance.random(), chance.random()) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, 2 + 3 * a - 4 * b + chance.gauss(0, 0.01)) for i, a, b in rows], "id int, a double, b double, y double")
    model = forecast.fit_linear(df, "y", ["a", "b"])
    table = {r.term: r for r in forecast.coefficient_table(model, ["a", "b"]).collect()}
    assert [table[t].coefficient for t in ("intercept", "a", "b")] == pytest.approx([2, 3, -4], abs=0.02)
    assert table["a"].p < 1e-6
    metrics = forecast.holdout_metrics(df, "id", "y", ["a", "b"]).first()
    assert metrics.rmse == pytest.approx(metrics.mse ** 0.5) and metrics.rss == pytest.approx(metrics.mse * metrics.rows)
    cases = forecast.best_worst_case(model, df.limit(3), df, ["a", "b"]).collect()
    std = {r["column"]: r["std"] for r in scaling.moments(df, ["a", "b"]).collect()}
    up = sum(table[c].coefficient * std[c] for c in ("a", "b"))
    for r in cases:
        assert (r.best_case - r.prediction, r.prediction - r.worst_case) == pytest.approx((up, up))


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    train, test = forecast.train_test_split(df, "id", 0.25)
    again = forecast.train_test_split(df.repartition(7), "id", 0.25)[1]
    assert found(test) == found(again) and train.count() + test.count() == 1000
    assert 200 < test.count() < 300


def test_naive_bayes_separates_two_clouds(spark):
    chance = random.Random(3)
    df = spark.createDataFrame([(i, i % 2, chance.gauss(6 * (i % 2), 1)) for i in range(200)], "id int, label int, x double")
    predicted = forecast.predict(forecast.fit_naive_bayes(df, "label", ["x"]), df, ["x"])
    assert summaries.confusion_metrics(predicted).first().accuracy > 0.95


def test_clusters_and_components_against_numpy(spark):
    chance = np.random.default_rng(5)
    vectors = np.concatenate([chance.normal(at, 0.1, (40, 3)) for at in ([0, 0, 0], [9, 0, 0], [0, 9, 4])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")
    clusters = np.array([r.cluster for r in forecast.embedding_clusters(df, k=3).orderBy("vec_id").collect()])
    centres = np.array([vectors[clusters == k].mean(axis=0) for k in range(3)])
    assert (np.argmin(((vectors[:, None] - centres) ** 2).sum(axis=2), axis=1) == clusters).all()
    found_ = np.array([r.components.toArray() for r in forecast.embedding_components(df, k=2).orderBy("vec_id").collect()])
    axes = np.linalg.svd(vectors - vectors.mean(axis=0))[2][:2]
    assert np.abs(found_) == pytest.approx(np.abs(vectors @ axes.T), abs=1e-6)


# --- star schema ---

def test_star_schema(spark):
    rows = [(1, "u1", "g1", "@b"), (2, "u1", "g1", "@a"), (3, "u1", "g1", "@b"), (4, "u1", "g2", None), (5, "u0", "g1", "@c")]
    blank = ["url", "hashtags", "emojis", "emoji_text", "links", "text"]
    posts = spark.createDataFrame(rows, "id long, user string, `group` string, usernames string").withColumns({
        **{c: F.lit("") for c in blank}, "favorite_count": F.lit(1), "retweet_count": F.lit(2)})
    users = star_schema.user_dim(posts)
    assert found(users, "ID", "twitter_user", "twitter_group", "mentioned_users") == [
        (1, "u0", "g1", "@c"), (2, "u1", "g1", "@a @b"), (3, "u1", "g2", "")]
    again = star_schema.user_dim(posts, existing=users.where("twitter_user = 'u1'"))
    assert found(again, "ID", "twitter_user", "twitter_group") == [(2, "u1", "g1"), (3, "u1", "g2"), (4, "u0", "g1")]
    assert star_schema.user_dim(posts, existing=users.where("false")).count() == 3
    assert found(star_schema.fact_posts(posts, users)) == found(star_schema.fact_posts(posts, users, many_users=True))
    # The same user in two groups has a key for each, and no post is doubled.
    facts = star_schema.fact_posts(posts, users)
    assert found(facts, "twitter_id", "UserID_FK") == [(1, 2), (2, 2), (3, 2), (4, 3), (5, 1)]
    assert facts.select("ID").distinct().count() == 5
    assert [r.id for r in star_schema.first_rows(posts, 2).collect()] == [1, 2]


# --- sources ---

def test_group_folders(spark):
    root = new_path(spark, "groups")
    for group, user, post in (("news", "CNN", 1), ("news", "A+B", 2), ("tech", "IBM", 3)):
        api = schemas.cast_to(spark.createDataFrame([(post, f"t{post}")], "id int, text string"), schemas.POST_API)
        api.write.parquet(f"{root}/{group}/{user}.parquet")
    merged = post_files.read_groups(spark, root, ["news", "tech"])
    assert merged.columns == schemas.POST.names
    assert found(merged, "id", "user", "group") == [(1, "CNN", "news"), (2, "A+B", "news"), (3, "IBM", "tech")]
    assert found(post_files.read_group(spark, root, "tech"), "id") == [(3,)]


def test_crawled_posts_union_with_api_posts(spark):
    crawled = spark.createDataFrame([(1, "7", 2, "w")], "id int, likes string, retweets int, websites string")
    api = schemas.crawl_as_api(crawled)
    assert api.schema.names == schemas.POST_API.names
    assert found(api, "id", "favorite_count", "retweet_count", "links") == [(1, 7, 2, "w")]
    other = spark.createDataFrame([(2, "x")], "id int, extra string")
    assert found(post_files.union_tables(api, other).fillna("-", ["extra"]), "id", "extra") == [(1, "-"), (2, "x")]


def test_sheets(spark):
    path = new_path(spark, "handles")
    sheet = spark.createDataFrame([("WSJ", "ftworldnews"), ("CNN", "guardian"), (None, "FinancialTimes")], "US_journals string, international_news string")
    tables.write_csv(sheet, path)
    assert found(sheets.handles_long(sheets.read_sheet(spark, path)), "group", "user") == [
        ("US_journals", "CNN"), ("US_journals", "WSJ"), ("international_news", "FinancialTimes"),
        ("international_news", "ftworldnews"), ("international_news", "guardian")]
    tickers = spark.createDataFrame([("AAPL", "APPLE")], "ticker_name string, ticker_label string")
    wide = spark.createDataFrame([("d", 1.0)], "Date string, AAPL double")
    assert sheets.label_columns(wide, sheets.ticker_labels(tickers, wide.columns)).columns == ["date", "APPLE"]
    long = spark.createDataFrame([("AAPL", 1.0), ("X", 2.0)], "ticker_name string, price double")
    assert found(sheets.label_rows(long, tickers).fillna("?"), "ticker_name", "ticker_label") == [("AAPL", "APPLE"), ("X", "?")]


def test_partition_folders_are_skipped(spark):
    path = new_path(spark, "dated")
    df = prices(spark, range(10)).withColumn("date", F.to_date("ts"))
    tables.write_table(df, path, partition_by=["date"])
    wanted = tables.read_table(spark, path).where(F.col("date") == F.lit("2023-07-04").cast("date"))
    assert "PartitionFilters: [isnotnull(date" in wanted._jdf.queryExecution().toString() and wanted.count() == 3


def test_staging_uses_the_shared_folder_and_cleans_up(spark):
    folder = staging_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = staged(spark.range(5).toDF("id"), "numbers")
    assert found(kept) == [(i,) for i in range(5)] and kept.inputFiles()[0].startswith("file://")
    with Scope(spark) as scope:
        inside = scope.staged(spark.range(3).toDF("id"), "numbers")
        file = inside.inputFiles()[0].removeprefix("file://")
        assert inside.count() == 3 and os.path.exists(file)
    assert not os.path.exists(file) and kept.count() == 5


def test_spread_deals_out_small_tables(spark):
    path = new_path(spark, "one-file")
    spark.range(100).coalesce(1).write.parquet(path)
    assert tables.spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_database_options(monkeypatch):
    """No database is started: the writer and reader are stand-ins that record what they are told."""
    told = {}

    class Recorder:
        def __getattr__(self, name):
            def call(*args, **kwargs):
                told.setdefault(name, []).append((args, kwargs))
                return self
            return call

    class Table:
        write = Recorder()

    class Session:
        read = Recorder()

    database.append_to_database(Table(), "jdbc:x", "posts", {"user": "u"})
    assert told["options"] == [((), {"url": "jdbc:x", "dbtable": "posts", "batchsize": "10000"}), ((), {"user": "u"})]
    assert told["mode"] == [(("append",), {})] and "save" in told
    database.read_from_database(Session(), "jdbc:x", "posts", partition_column="id", bounds=(1, 9), partitions=4)
    assert told["options"][-1][1] == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
