"""Tables that grow load by load: star schema, post history, stream buckets with late rows, quantile sketches."""

import os
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtape.operators import quantiles, scaling
from crowdtape.plans.star_loads import StarStore, merge_days
from crowdtape.sources.history import History
from crowdtape.streaming.buckets import BucketStore
from crowdtape.streaming.posts import keep_history, read_stream

POST = ("id long, created_at timestamp_ntz, user string, `group` string, url string, favorite_count long, retweet_count long, "
        "hashtags string, emojis string, emoji_text string, usernames string, links string, text string")


def post(i, day, user, mention, likes=0):
    return (i, day and datetime(2024, 1, day, 12), user, "news", f"u/{i}", likes, 0, "", "", "", mention, "", f"text {i}")


def files_of(root):
    """Every data file below a folder with the time it was written."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(folder, name)
                found[os.path.relpath(path, root)] = os.stat(path).st_mtime_ns
    return found


# --- star schema ---

def by_load(spark, store, rows, number):
    return store.load(spark.createDataFrame(rows, POST), number, datetime(2024, 3, 1 + number), [F.desc("favorite_count")])


def test_users_gain_mentions_and_facts_stay_single(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    assert by_load(spark, store, [post(1, 1, "ann", "@x"), post(2, 1, "bob", None), post(2, 1, "bob", "", 5), post(3, 2, "ann", "@x")], 0)
    before = files_of(tmp_path / "star" / "facts")
    assert by_load(spark, store, [post(4, 3, "ann", "@y @z"), post(3, 2, "ann", "@x", 9), post(5, 3, "cat", "@x"), post(None, 3, "dan", "@q")], 1)
    after = files_of(tmp_path / "star" / "facts")
    assert {f for f in before if "date=2024-01-01" in f} == {f for f in after if "date=2024-01-01" in f}
    assert all(after[f] == t for f, t in before.items() if "date=2024-01-01" in f)
    assert not {f for f in before if "date=2024-01-02" in f} & set(after)
    # A post of the third day that arrives late, and a known user without news.
    assert by_load(spark, store, [post(6, 1, "bob", "@w"), post(7, 1, "ann", "@y @z")], 2)

    versions = {(r.twitter_user, r.version): (r.ID, r.n_mentions, r.valid_from.day, r.valid_to and r.valid_to.day)
                for r in store.user_versions().collect()}
    assert versions == {("ann", 1): (1, 1, 1, 2), ("ann", 2): (1, 2, 2, None), ("bob", 1): (2, 0, 1, 3), ("bob", 2): (2, 1, 3, None),
                        ("cat", 1): (3, 1, 2, None)}
    known = defaultdict(set)
    for r in store.mentions_of_versions().collect():
        known[r.ID, r.version].add(r.mentioned_users)
    assert known == {(1, 1): {"@x"}, (1, 2): {"@x", "@y @z"}, (2, 2): {"@w"}, (3, 1): {"@x"}}
    facts = {r.twitter_id: (r.UserID_FK, r.favorite_count, r.date.day) for r in store.facts().collect()}
    assert facts == {1: (1, 0, 1), 2: (2, 5, 1), 3: (1, 9, 2), 4: (1, 0, 3), 5: (3, 0, 3), 6: (2, 0, 1), 7: (1, 0, 1)}
    assert store.facts().count() == store.dates().count() == 7


def test_loads_are_done_once_and_in_order(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    rows = [post(1, 1, "ann", "@x")]
    assert by_load(spark, store, rows, 3)
    state = files_of(tmp_path / "star")
    assert not by_load(spark, store, [post(9, 9, "zed", "@z")], 3) and files_of(tmp_path / "star") == state
    with pytest.raises(ValueError):
        by_load(spark, store, rows, 2)

    # A load that breaks off before its marker is not seen in users or mentions, and doing it over gives one of each.
    class Stop(Exception):
        pass

    def stop(*_, **__):
        raise Stop

    broken = StarStore(spark, str(tmp_path / "star"))
    import crowdtape.plans.star_loads as loads
    kept, loads.merge_days = loads.merge_days, stop
    try:
        with pytest.raises(Stop):
            by_load(spark, broken, [post(2, 2, "bob", "@y"), post(3, 2, "ann", "@y")], 4)
    finally:
        loads.merge_days = kept
    assert [r.twitter_user for r in store.user_versions().collect()] == ["ann"] and store.mentions().count() == 1
    assert by_load(spark, store, [post(2, 2, "bob", "@y"), post(3, 2, "ann", "@y")], 4)
    assert sorted((r.twitter_user, r.version) for r in store.user_versions().collect()) == [("ann", 1), ("ann", 2), ("bob", 1)]


def test_a_key_that_moves_leaves_its_old_day(spark, tmp_path):
    path = str(tmp_path / "days")

    def rows(*of):
        return spark.createDataFrame(of, "id long, v string, date date")

    def day(n):
        return datetime(2024, 1, n).date()

    merge_days(spark, path, rows((1, "a", day(1)), (2, "a", day(2)), (3, "a", day(2)), (4, "a", None)), "id")
    assert merge_days(spark, path, rows((1, "b", day(3)), (4, "b", None)), "id") == [day(1), day(3), None]
    found = {(r.id, r.v, r.date) for r in spark.read.parquet(path).collect()}
    assert found == {(1, "b", day(3)), (2, "a", day(2)), (3, "a", day(2)), (4, "b", None)}
    assert not os.path.exists(f"{path}/date=2024-01-01")
    # With days that are taken to be fixed only the new rows' days are looked at.
    assert merge_days(spark, path, rows((2, "c", day(2))), "id", days_fixed=True) == [day(2)]
    assert spark.read.parquet(path).count() == 4
    assert merge_days(spark, path, rows(), "id") == []


# --- history ---

ROW = "id long, user string, v int"


def test_history_reads_and_writes_only_touched_ranges(spark, tmp_path):
    root = str(tmp_path / "history")
    schema = spark.createDataFrame([], ROW).schema
    history = History(spark, root, schema, span=100, order=[F.desc("v")], owner="user")
    assert history.read().count() == 0 and history.compact() == 0 and history.marks().count() == 0
    history.append(spark.createDataFrame([(i, f"u{i % 3}", 0) for i in range(-150, 400)] + [(None, "u0", 7), (5, "u1", 1)], ROW), 0)
    assert history.compact() == 0
    first = files_of(f"{root}/base")
    assert {r.part: (r.low, r.high, r.rows) for r in history.ranges().collect()} == {
        -2: (-150, -101, 50), -1: (-100, -1, 100), **{p: (100 * p, 100 * p + 99, 100) for p in range(4)}}
    # New keys inside one range, beyond the last one, and in a range of their own.
    history.append(spark.createDataFrame([(250, "u9", 2), (399, "u9", 2), (1000, "u9", 2), (1000, "u9", 3)], ROW), 1)
    waiting = history.read()
    assert waiting.count() == 551 and waiting.where("user = 'u9'").count() == 3
    touched = history.touched(history.waiting(), history.ranges())
    assert sorted(r.part for r in touched.collect()) == [2, 3]
    stored = history.stored(touched)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", stored._jdf.queryExecution().toString()).group(1)
    assert re.search(r"gen#\d+L = 1", filters) and re.search(r"part#\d+L IN \(\d,\d\)", filters)
    read = {row[0] for row in stored.select(F.input_file_name()).distinct().collect()}
    assert len(read) >= 2 and all("/part=2/" in f or "/part=3/" in f for f in read)
    assert history.compact() == 200
    second = files_of(f"{root}/base")
    assert all(second[f] == t for f, t in first.items())
    history.append(spark.createDataFrame([(1001, "u8", 4)], ROW), 2)
    # Beyond all stored keys: nothing is read.
    assert history.compact() == 0
    history.clean()
    kept = files_of(f"{root}/base")
    assert not any("gen=1/part=2/" in f or "gen=1/part=3/" in f for f in kept) and any("gen=1/part=0/" in f for f in kept)
    rows = {r.id: (r.user, r.v) for r in history.read().collect()}
    assert len(rows) == 552 and (rows[5], rows[250], rows[1000], rows[1001]) == (("u1", 1), ("u9", 2), ("u9", 3), ("u8", 4))
    landed = spark.createDataFrame([(1000, "u9", 0), (1001, "u9", 0), (398, "u2", 0), (400, "u2", 0), (1, "new", 0), (1, None, 0)], ROW)
    assert sorted((r.id, r.user) for r in history.newer(landed).collect() if r.user) == [(1, "new"), (400, "u2"), (1001, "u9")]
    assert history.newer(landed).where("user IS NULL").count() == 1


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    history = History(spark, str(tmp_path / "history"), schema, span=10)
    state = {}
    rng = random.Random(4)

    def deliver(number):
        rows = [(rng.randint(0, 60), "u", number) for _ in range(15)]
        history.append(spark.createDataFrame(rows, ROW).dropDuplicates(["id"]), number)
        state.update({i: v for i, _, v in rows})

    def as_it_is():
        return {r.id: r.v for r in history.read().collect()}

    deliver(0)
    history.compact()
    deliver(1)

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    history._point, point = stop, history._point
    with pytest.raises(Stop):
        history.compact()
    assert as_it_is() == state and history.pointer() == (1, 0)
    deliver(2)
    history._point = point
    history.compact()
    assert as_it_is() == state and history.pointer() == (2, 2)
    # A batch that a stream runs again after it was folded in.
    history.append(spark.createDataFrame([(1, "u", 99)], ROW), 2)
    assert as_it_is() == state
    deliver(3)
    history.compact()
    history.clean()
    assert as_it_is() == state


def test_history_of_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, created_at timestamp, v int").schema
    rng = random.Random(7)
    state = {}
    for part in range(5):
        rows = [(i, datetime(2024, 1, 1 + part), part) for i in rng.sample(range(40), 12)]
        state.update({i: part for i, _, _ in rows})
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    history = History(spark, str(tmp_path / "history"), schema, span=16)
    stream = read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    keep_history(stream, history, str(tmp_path / "progress"), compact_every=2).awaitTermination()
    assert history.pointer() == (2, 3)
    assert {r.id: r.v for r in history.read().collect()} == state


# --- buckets of a stream ---

@pytest.mark.parametrize("delay", [0, 3])
def test_every_row_is_summed_or_late(spark, tmp_path, delay):
    rng = random.Random(delay)
    schema = spark.createDataFrame([], "user string, created_at timestamp, n long").schema
    start, batches = datetime(2024, 5, 1), []
    for part in range(4):
        rows = [(rng.choice("ab"), start + timedelta(minutes=rng.randint(0, 300) + 120 * part), rng.randint(1, 9)) for _ in range(40)]
        rows += [("a", None, 5), (None, start + timedelta(minutes=130 * part), 1)]
        batches.append(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = BucketStore(spark, str(tmp_path / "out"), schema, ["n"], "1 hour", "30 minutes", delay=f"{delay} hours")
    stream = read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    store.write(stream, str(tmp_path / "progress")).awaitTermination()

    sums, late, mark, closed = defaultdict(lambda: [0, 0]), 0, None, set()
    for rows in batches:
        for user, ts, n in rows:
            bucket = None if ts is None else (ts - timedelta(minutes=30)).replace(minute=30, second=0)
            if ts is None or mark is not None and bucket + timedelta(hours=1) <= mark:
                late += 1
                continue
            sums[user, bucket][0] += n
            sums[user, bucket][1] += 1
        newest = max(ts for _, ts, _ in rows if ts) - timedelta(hours=delay)
        mark = newest if mark is None else max(mark, newest)
    found = store.sums().collect()
    assert {(r.user, r.created_at): [r.n, r.rows] for r in found} == dict(sums) and len(found) == len(sums)
    assert {(r.user, r.created_at) for r in found if r.closed} == {k for k in sums if k[1] + timedelta(hours=1) <= mark}
    assert store.late().count() == late and sum(r.rows for r in found) + late == sum(map(len, batches))
    assert any(not r.closed for r in found) and (late > 4 if delay == 0 else late == 4)
    # A batch that is done again changes nothing, and one without rows closes nothing.
    before = files_of(tmp_path / "out")
    store.add(spark.createDataFrame(batches[3], schema), 3)
    assert files_of(tmp_path / "out") == before
    store.add(spark.createDataFrame([], schema), 4)
    store.clean()
    assert sorted(map(repr, store.sums().collect())) == sorted(map(repr, found))


def test_a_batch_that_breaks_off_is_done_over(spark, tmp_path):
    schema = spark.createDataFrame([], "user string, created_at timestamp, n long").schema
    store = BucketStore(spark, str(tmp_path / "out"), schema, ["n"], "1 hour", delay="0 hours")
    hours = [datetime(2024, 5, 1, h, 10) for h in range(5)]
    store.add(spark.createDataFrame([("a", hours[0], 1), ("a", hours[1], 1)], schema), 0)
    kept, store._progress = store._progress, lambda *_: None
    store.add(spark.createDataFrame([("a", hours[3], 1), ("a", hours[0], 1)], schema), 1)
    assert sum(r.n for r in store.sums().collect()) == 2 and store.late().count() == 0
    store._progress = kept
    store.add(spark.createDataFrame([("a", hours[3], 1), ("a", hours[0], 1)], schema), 1)
    assert sum(r.n for r in store.sums().collect()) == 3 and store.late().count() == 1


# --- quantiles ---

def test_exact_quantiles_of_awkward_columns(spark):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=3000)
    columns = {
        "plain": plain, "ties": np.floor(plain), "one": np.full(3000, 7.0), "far": np.where(plain > 2.9, 1e300, plain),
        "ends": np.where(plain > 1, np.inf, np.where(plain < -1, -np.inf, plain)),
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(3000)] + [(None, float("nan"), None, None, None)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double"))
    shares = [0.0, 0.003, 0.5, 0.97, 1.0]
    found = {r.column: r for r in quantiles.exact_quantiles(frame, [*columns, "none"], shares).collect()}
    assert set(found) == set(columns)
    for c, values in columns.items():
        ordered = np.sort(values)
        for i, share in enumerate(shares):
            at = share * 2999
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low if low == high else low + (at - np.floor(at)) * (high - low)
            assert found[c][f"q{i}"] == pytest.approx(want, rel=1e-12), (c, share)
        assert found[c]["rows"] == 3000


def test_sketches_merge_and_keep_to_their_error(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(size=20_000) * 50])
    frame = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(values)] + [(1, None), (2, float("nan"))], "day int, v double")
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    daily = quantiles.quantile_sketches(frame, ["v"], by=["day"])
    assert daily.count() == 7
    whole = quantiles.sketched_quantiles(quantiles.merge_sketches(daily), shares).first()
    once = quantiles.approximate_quantiles(frame, ["v"], shares).first()
    ordered = np.sort(values)
    for found in (whole, once):
        assert found["rows"] == len(values)
        for i, share in enumerate(shares):
            assert abs(np.searchsorted(ordered, found[f"q{i}"]) / len(values) - share) <= quantiles.RANK_ERROR
    exact, near = scaling.robust_limits(frame, ["v"]).first(), scaling.robust_limits(frame, ["v"], exact=False).first()
    assert near.median == pytest.approx(exact.median, abs=0.1) and exact.column == near.column == "v"
    trimmed = scaling.trim_quantiles(frame, ["v"], exact=False).count()
    assert abs(trimmed - 0.9 * len(values)) <= 4 * quantiles.RANK_ERROR * len(values)
    assert quantiles.approximate_quantiles(frame.limit(0), ["v"], shares).count() == 0


def test_a_merge_writes_its_rows_once(spark):
    from crowdtape.plans.star_loads import merge_days
    from crowdtape.sources.staging import new_path, staging_folder

    def stored():
        folder = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
        found = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return {f.getPath().getName() for f in found.listStatus(folder)} if found.exists(folder) else set()

    path, before = new_path(spark, "days"), stored()
    for rows in ([(1, "x", "d1"), (2, "y", "d1"), (3, "z", "d2")], [(3, "new", "d1"), (4, "w", "d3")]):
        merge_days(spark, path, spark.createDataFrame(rows, "id long, text string, date string"), "id")
    found = {(r.id, r.text, r.date) for r in spark.read.parquet(path).collect()}
    assert found == {(1, "x", "d1"), (2, "y", "d1"), (3, "new", "d1"), (4, "w", "d3")}
    assert stored() - before == {path.rsplit("/", 1)[1]}


def test_whole_rows_move_once_in_a_merge(spark, tmp_path, monkeypatch):
    """Old rows of a day of many slots meet the keys that replace them, whatever their sizes; nothing wide is sorted to join."""
    from crowdtape.plans import star_loads

    monkeypatch.setattr(star_loads, "ROWS_PER_SLOT", 7)
    path, schema = str(tmp_path / "days"), "id long, text string, date string"
    old = {i: (i, f"old {i}", None if i % 5 == 0 else f"2024-01-0{i % 3 + 1}") for i in range(100)}
    star_loads.merge_days(spark, path, spark.createDataFrame(list(old.values()), schema), "id")
    new = {i: (i, f"new {i}", "2024-01-05" if i % 2 else "2024-01-02") for i in range(40, 140)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert star_loads.merge_days(spark, path, spark.createDataFrame(list(new.values()), schema), "id") == [
            "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05", None]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).select("id", "text", "date").collect())
    assert found == sorted((old | new).values())


def test_posts_without_repeats_are_not_ranked(spark):
    from crowdtape.plans.star_loads import _single

    order = [F.desc("favorite_count")]
    single = spark.createDataFrame([post(1, 1, "ann", "@x"), post(2, 1, "bob", "@y")], POST)
    plan = _single(single, order)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    double = single.unionByName(spark.createDataFrame([post(2, 2, "cat", "@z", 5)], POST))
    assert sorted((r.id, r.user) for r in _single(double, order).collect()) == [(1, "ann"), (2, "cat")]


def test_what_was_shuffled_for_a_staged_table_goes_once_it_is_written(spark):
    import time

    from crowdtape.sources.staging import Scope, staged

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(setting, None), shuffled()
    with Scope(spark) as scope:
        for write in (staged, scope.staged):
            kept = write(spark.range(1000).repartition(7, "id"), "numbers")
            for _ in range(50):
                if shuffled() <= before:
                    break
                time.sleep(0.1)
            assert shuffled() <= before and len(kept.collect()) == 1000
    assert spark.conf.get(setting, None) == set_before
