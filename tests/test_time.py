"""Time functions, buckets, pivots, folds and calendars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdtape.functions import times
from crowdtape.operators import buckets, calendars, folds


def at(text):
    return dt.datetime.fromisoformat(text)


def series(spark, *rows, columns="created_at string, value double"):
    df = spark.createDataFrame(list(rows), columns)
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def found(df, *columns):
    return sorted(tuple(row[c] for c in columns) for row in df.collect())


def one(spark, text, expression):
    return series(spark, (text, 1.0)).select(expression).first()[0]


def test_bucket_edges(spark):
    edges = [one(spark, t, times.time_bucket(F.col("created_at"), "1 hour", "30 minutes"))
             for t in ("2023-07-11 10:29:59", "2023-07-11 10:30:00", "2023-07-11 00:10:00")]
    assert edges == [at("2023-07-11 09:30"), at("2023-07-11 10:30"), at("2023-07-10 23:30")]


def test_week_labels_and_trading_days(spark):
    labels = [one(spark, f"2023-07-0{d} 12:00:00", times.monday_label(F.col("created_at"))) for d in (8, 9)]
    labels.append(one(spark, "2023-07-10 12:00:00", times.monday_label(F.col("created_at"))))
    assert labels == [dt.date(2023, 7, 10)] * 3
    days = [one(spark, f"2023-07-0{d} 12:00:00", times.last_trading_day(F.col("created_at"))) for d in (1, 2, 3)]
    assert days == [dt.date(2023, 6, 30), dt.date(2023, 6, 30), dt.date(2023, 7, 3)]


def test_zones_follow_daylight_saving(spark):
    local = times.to_zone(F.col("created_at"))
    assert one(spark, "2023-07-03 13:30:00", local) == at("2023-07-03 09:30")
    assert one(spark, "2023-01-03 13:30:00", local) == at("2023-01-03 08:30")
    assert one(spark, "2023-07-03 09:30:00", times.from_zone(F.col("created_at"))) == at("2023-07-03 13:30")


def test_time_ranges_include_both_ends(spark):
    inside = times.between_times(F.col("created_at"), "09:30:00", "15:30:00")
    stamps = ["09:29:59.999999", "09:30:00", "15:30:00", "15:30:00.000001"]
    assert [one(spark, f"2023-07-03 {t}", inside) for t in stamps] == [False, True, True, False]


def test_timestamp_parts(spark):
    row = times.split_timestamp(series(spark, ("2023-02-03 04:05:06", 1.0)), "created_at").first()
    assert (row.timezone, row.date, row.time) == ("UTC", dt.date(2023, 2, 3), "04:05:06")
    assert (row.year, row.month, row.day, row.hour, row.minute, row.second) == (2023, 2, 3, 4, 5, 6)


def test_pivot_names_fill_and_totals(spark):
    df = spark.createDataFrame(
        [("d1", "A", 0.5, 1), ("d1", "A", 0.25, 2), ("d1", "B", 1.0, 4), ("d2", "C", 2.0, 8)],
        "date string, user string, unigram_probability double, likes int")
    wide = buckets.pivot_users(df, "date", ["unigram_probability"], ["likes"], ["A", "B"])
    assert wide.columns == ["date", "unigram_A", "unigram_B", "likes"]
    # Totals count every user, also those without a column.
    assert found(wide, *wide.columns) == [("d1", 0.75, 1.0, 7), ("d2", 0.0, 0.0, 8)]
    assert buckets.pivot_users(df, "date", ["likes"]).columns == ["date", "likes_A", "likes_B", "likes_C"]


def test_bucket_sums_keep_the_total(spark):
    rows = [(f"2023-07-03 {h:02d}:{m:02d}:00", float(h)) for h in range(24) for m in (0, 17, 45)]
    df = series(spark, *rows)
    for width, offset in (("1 hour", "30 minutes"), ("5 minutes", None)):
        sums = buckets.bucket_sums(df, ["value"], width, offset, keys=())
        assert sums.agg(F.sum("value")).first()[0] == pytest.approx(sum(v for _, v in rows))


def test_weekend_by_day(spark):
    df = spark.createDataFrame(
        [(dt.date(2023, 7, d), float(d)) for d in (6, 7, 8, 9, 10, 11)], "date date, value double")
    folded = folds.fold_weekend_by_day(df, ["value"])
    assert found(folded, "date", "value") == [
        (dt.date(2023, 7, 6), 6.0), (dt.date(2023, 7, 7), 7.0), (dt.date(2023, 7, 10), 27.0), (dt.date(2023, 7, 11), 11.0)]


def test_empty_weeks_on_request(spark):
    df = spark.createDataFrame([(dt.date(2023, 7, 8), 1.0), (dt.date(2023, 7, 24), 2.0)], "date date, value double")
    assert len(found(folds.fold_weekend_by_day(df, ["value"]), "date")) == 2
    filled = found(folds.fold_weekend_by_day(df, ["value"], emit_empty=True), "date", "value")
    assert filled == [(dt.date(2023, 7, 10), 1.0), (dt.date(2023, 7, 17), 0.0), (dt.date(2023, 7, 24), 2.0)]


def test_empty_weeks_of_each_key(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2023, 7, 8), 1.0), ("a", dt.date(2023, 7, 24), 2.0), ("b", dt.date(2023, 7, 15), 3.0),
         ("c", dt.date(2023, 7, 12), 4.0)], "user string, date date, value double")
    filled = found(folds.fold_weekend_by_day(df, ["value"], keys=["user"], emit_empty=True), "user", "date", "value")
    assert filled == [
        ("a", dt.date(2023, 7, 10), 1.0), ("a", dt.date(2023, 7, 17), 0.0), ("a", dt.date(2023, 7, 24), 2.0),
        ("b", dt.date(2023, 7, 17), 3.0), ("c", dt.date(2023, 7, 12), 4.0)]


def test_empty_openings_on_request(spark):
    rows = [("2023-02-27 13:00:00", 1.0), ("2023-03-01 16:30:00", 2.0), ("2023-03-01 22:30:00", 4.0)]
    assert market(spark, *rows) == [
        (at("2023-02-27 09:30"), 1.0), (at("2023-03-01 11:30"), 2.0), (at("2023-03-02 09:30"), 4.0)]
    assert market(spark, *rows, emit_empty=True) == [
        (at("2023-02-27 09:30"), 1.0), (at("2023-02-28 09:30"), 0.0), (at("2023-03-01 09:30"), 0.0),
        (at("2023-03-01 11:30"), 2.0), (at("2023-03-02 09:30"), 4.0)]
    assert market(spark, rows[1], emit_empty=True) == [(at("2023-03-01 11:30"), 2.0)]


def test_weekend_by_time_adds_to_mondays_opening(spark):
    df = series(spark, ("2023-07-07 20:00:00", 1.0), ("2023-07-08 01:00:00", 2.0), ("2023-07-09 23:00:00", 4.0),
                ("2023-07-10 13:30:00", 8.0), ("2023-07-10 14:30:00", 16.0))
    assert found(folds.fold_weekend_by_time(df, ["value"]), "created_at", "value") == [
        (at("2023-07-07 20:00"), 1.0), (at("2023-07-10 13:30"), 14.0), (at("2023-07-10 14:30"), 16.0)]


def market(spark, *rows, **options):
    return found(folds.fold_market_hours(series(spark, *rows), ["value"], **options), "timestamp", "value")


def test_market_hours(spark):
    # Winter: New York is five hours behind.
    assert market(spark, ("2023-02-27 13:00:00", 1.0), ("2023-02-27 15:30:00", 2.0), ("2023-02-27 22:30:00", 4.0)) == [
        (at("2023-02-27 09:30"), 1.0), (at("2023-02-27 10:30"), 2.0), (at("2023-02-28 09:30"), 4.0)]


def test_market_boundaries_count_twice_unless_told(spark):
    edges = [("2023-07-03 13:30:00", 1.0), ("2023-07-03 19:30:00", 2.0)]
    assert market(spark, *edges) == [
        (at("2023-07-03 09:30"), 2.0), (at("2023-07-03 15:30"), 2.0), (at("2023-07-04 09:30"), 2.0)]
    assert market(spark, *edges, boundary="once") == [(at("2023-07-03 09:30"), 1.0), (at("2023-07-03 15:30"), 2.0)]


def test_after_hours_before_the_clock_change(spark):
    # Saturday evening before New York moves its clocks: the next opening is a calendar day later.
    assert market(spark, ("2023-03-11 23:00:00", 1.0)) == [(at("2023-03-12 09:30"), 1.0)]


def test_fridays_evening_can_wait_for_monday(spark):
    friday = ("2023-07-07 22:00:00", 1.0)
    assert market(spark, friday) == [(at("2023-07-08 09:30"), 1.0)]
    assert market(spark, friday, next_trading_day=True) == [(at("2023-07-10 09:30"), 1.0)]


def test_one_pass_equals_the_three_steps(spark):
    rows = [(f"2023-03-{d:02d} {h:02d}:{m:02d}:00", float(d * h + m)) for d in range(9, 16) for h in range(0, 24, 2) for m in (5, 40)]
    df = series(spark, *rows)
    steps = folds.fold_market_hours(folds.fold_weekend_by_time(
        buckets.bucket_sums(df, ["value"], "30 minutes", keys=()), ["value"]), ["value"])
    at_once = folds.posts_to_market_time(df, ["value"], "30 minutes", keys=())
    assert found(at_once, "timestamp", "value") == found(steps, "timestamp", "value")


def test_regular_grid_fills_only_missing_rows(spark):
    df = series(spark, ("2023-07-03 00:00:00", 1.0), ("2023-07-03 00:02:00", None), ("2023-07-03 00:04:00", 3.0))
    filled = calendars.fill_steps(df, 60, fill=0)
    assert [r.value for r in filled.orderBy("created_at").collect()] == [1.0, 0.0, None, 0.0, 3.0]


def test_grid_spans_more_than_one_stride(spark):
    df = series(spark, ("2023-01-01 00:00:00", 1.0), ("2023-01-31 00:00:00", 1.0))
    grid = calendars.regular_grid(df, 60)
    assert grid.count() == grid.distinct().count() == 30 * 24 * 60 + 1
    assert calendars.regular_grid(df.limit(0), 60).count() == 0


def test_openings_are_added_and_rows_kept(spark):
    df = series(spark, ("2023-07-03 20:00:00", 1.0), ("2023-07-04 13:30:00", 2.0), ("2023-07-05 01:00:00", None))
    assert found(calendars.fill_openings(df), "created_at", "value") == [
        (at("2023-07-03 13:30"), 0.0), (at("2023-07-03 20:00"), 1.0), (at("2023-07-04 13:30"), 2.0),
        (at("2023-07-05 01:00"), 0.0), (at("2023-07-05 13:30"), 0.0)]


def test_month_calendar_has_the_saved_shape(spark):
    df = series(spark, ("2023-07-11 15:30:00", 1.0))
    rows = found(calendars.trading_calendar(df, "created_at", None, 1), "timestamp")
    assert len(rows) == 217 and rows[0] == (at("2023-07-11 09:30"),) and rows[-1] == (at("2023-08-10 15:30"),)


def test_calendars_cross_month_and_year_ends(spark):
    df = series(spark, ("2023-12-29 15:30:00", 1.0))
    week = found(calendars.trading_calendar(df, "created_at", 7), "timestamp")
    assert len(week) == 8 * 7 and week[-1] == (at("2024-01-05 15:30"),)
    assert len(found(calendars.trading_calendar(df, "created_at", 7, weekdays_only=True), "timestamp")) == 6 * 7
    assert found(calendars.trading_calendar(df, "created_at", None, 1), "timestamp")[-1] == (at("2024-01-28 15:30"),)


def test_the_last_minute_of_the_day_counts(spark):
    late = spark.createDataFrame([("2024-01-02 23:59:30",), ("2024-01-02 12:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    keys = late.select(F.explode(folds.market_keys(F.col("t"), boundary="once")).alias("k")).collect()
    assert sorted(str(r.k) for r in keys) == ["2024-01-02 12:00:00", "2024-01-03 09:30:00"]
