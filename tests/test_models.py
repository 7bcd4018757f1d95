"""Models on tables against NumPy: sparse regression, word vectors, clusters and components."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from crowdtape.plans import forecast, wide_regression, word_space

LONG = "timestamp long, feature string, value double"


# --- sparse regression ---

def test_sparse_fit_equals_the_normal_equations(spark):
    rng = random.Random(1)
    rows, dense, y = [], np.zeros((60, 5)), np.zeros(60)
    for t in range(60):
        for f in range(5):
            if rng.random() < 0.6:
                x = rng.uniform(-2, 2)
                dense[t, f] = x
                rows += [(t, f"f{f}", x / 2), (t, f"f{f}", x / 2)]
        y[t] = 3 + dense[t] @ [1, -2, 0.5, 4, 0] + rng.gauss(0, 0.3)
    rows += [(None, "f0", 9.0), (1, None, 9.0), (2, "f1", None), (1000, "f0", 5.0)]
    long = spark.createDataFrame(rows, LONG)
    labels = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)] + [(2000, None)], "timestamp long, y double")
    fitted = wide_regression.fit_sparse(long, labels, "y")
    found = {r.feature: r.coefficient for r in fitted.collect()}
    want = np.linalg.lstsq(np.column_stack([dense, np.ones(60)]), y, rcond=None)[0]
    assert [found[f"f{i}"] for i in range(5)] + [found["intercept"]] == pytest.approx(want, abs=1e-5)
    predicted = {r.timestamp: r.prediction for r in wide_regression.predict_sparse(fitted, long).collect()}
    filled = [t for t in range(60) if dense[t].any()]
    assert [predicted[t] for t in filled] == pytest.approx((dense @ want[:5] + want[5])[filled], abs=1e-4)
    unseen = spark.createDataFrame([(7, "nobody", 3.0)], LONG)
    assert wide_regression.predict_sparse(fitted, unseen).first().prediction == pytest.approx(found["intercept"])


def test_ten_thousand_features_without_a_column_each(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=10_000)
    rows, labels = [], []
    for t in range(2500):
        chosen = np.concatenate([rng.integers(0, 10_000, 4), [4 * t + i for i in range(4)]])
        values = rng.uniform(0.5, 2, len(chosen))
        rows += [(t, f"user{c:05}", float(v)) for c, v in zip(chosen, values)]
        labels.append((t, float(weights[chosen] @ values)))
    fitted = wide_regression.fit_sparse(
        spark.createDataFrame(rows, LONG), spark.createDataFrame(labels, "timestamp long, y double"), "y", most_passes=60)
    assert fitted.count() == 10_001
    predicted = {r.timestamp: r.prediction for r in wide_regression.predict_sparse(fitted, spark.createDataFrame(rows, LONG)).collect()}
    errors = np.array([predicted[t] - v for t, v in labels])
    assert np.sqrt((errors ** 2).mean()) < 0.02 * np.std([v for _, v in labels])


# --- word vectors ---

def test_pairs_and_information_by_counting(spark):
    rng = random.Random(3)
    posts = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(40)] + [[], ["z"], ["q", "q"]]
    frame = spark.createDataFrame([(p,) for p in posts], "tokens array<string>")
    want = Counter()
    for p in posts:
        for i in range(len(p)):
            for j in range(i + 1, min(len(p), i + 4)):
                want[p[i], p[j]] += 1
                want[p[j], p[i]] += 1
    counts = word_space.pair_counts(frame, window=3)
    assert {(r.word, r.context): r.n for r in counts.collect()} == dict(want)
    total, of, smoothed = sum(want.values()), Counter(), {}
    for (w, _), n in want.items():
        of[w] += n
    smoothed = {w: n ** 0.75 for w, n in of.items()}
    values = {k: math.log(n / total * total / of[k[0]] * sum(smoothed.values()) / smoothed[k[1]]) for k, n in want.items()}
    found = {(r.word, r.context): r.value for r in word_space.ppmi(counts, 0.75).collect()}
    assert found == pytest.approx({k: v for k, v in values.items() if v > 0})


def test_svd_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    basis, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    values = np.array([50, -40, 30, 20, -10, 5, *np.full(54, 0.01)])
    matrix = (basis * values) @ basis.T
    rows = [(f"w{i:02}", f"w{j:02}", float(matrix[i, j])) for i in range(60) for j in range(60)]
    found, vectors = word_space.symmetric_svd(spark.createDataFrame(rows, "word string, context string, value double").repartition(5), 6)
    assert found == pytest.approx(values[:6], abs=1e-4)
    block = np.array([r.x for r in vectors.orderBy("word").collect()])
    assert block.T @ block == pytest.approx(np.eye(6), abs=1e-8)
    assert np.abs(np.einsum("ij,ij->j", block, basis[:, :6])) == pytest.approx(np.ones(6), abs=1e-5)
    assert ((block ** 3).sum(axis=0) > -1e-12).all()
    # A matrix of rank two has no more than two values that are not 0, and an empty one has none.
    low = [("a", "b", 1.0), ("b", "a", 1.0)]
    few, _ = word_space.symmetric_svd(spark.createDataFrame(low, "word string, context string, value double"), 5)
    assert sorted(few) == pytest.approx([-1, 1])
    none, empty = word_space.symmetric_svd(spark.createDataFrame([], "word string, context string, value double"), 5)
    assert len(none) == 0 and empty.count() == 0


def test_words_in_like_company_are_near(spark):
    rng = random.Random(5)
    topics = {"pets": ["cat", "dog", "bird"], "food": ["bread", "soup", "rice"]}
    company = {"pets": ["fur", "tail", "paw", "nest"], "food": ["plate", "spoon", "salt", "oven"]}
    posts = []
    for _ in range(300):
        topic = rng.choice(list(topics))
        posts.append(([rng.choice(topics[topic]), *rng.sample(company[topic], 2), rng.choice(["the", "a"])],))
    vectors = word_space.word_space(spark.createDataFrame(posts, "tokens array<string>"), size=4).persist()
    assert {r.word for r in vectors.collect()} == {w for p, in posts for w in p}
    near = {r.word: [] for r in vectors.collect()}
    for r in word_space.nearest_words(vectors, ["cat", "soup"], 2).collect():
        near[r.word].append(r.near)
        assert -1 <= r.cosine <= 1 + 1e-9
    assert set(near["cat"]) <= {"dog", "bird", *company["pets"]} and set(near["soup"]) <= {"bread", "rice", *company["food"]}
    assert len(near["cat"]) == len(near["soup"]) == 2


# --- clusters and components ---

def test_every_vector_is_in_its_nearest_cluster(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6)) * 10
    rows = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = np.array([r.cluster for r in forecast.embedding_clusters(frame, k=4).orderBy("vec_id").collect()])
    means = np.array([rows[found == c].mean(axis=0) for c in range(4)])
    distances = ((rows[:, None, :] - means[None]) ** 2).sum(axis=2)
    assert (distances.argmin(axis=1) == found).all()
    assert all(len(set(found[40 * i:40 * (i + 1)])) == 1 for i in range(4)) and len(set(found)) == 4


def test_components_are_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = np.array([r.components.toArray() for r in forecast.embedding_components(frame, k=2).orderBy("vec_id").collect()])
    values, vectors = np.linalg.eigh(np.cov(rows.T))
    want = rows @ vectors[:, ::-1][:, :2]
    for i in range(2):
        assert found[:, i] == pytest.approx(want[:, i] * np.sign(found[:, i] @ want[:, i]), abs=1e-8)
    assert found.var(axis=0, ddof=1) == pytest.approx(values[::-1][:2])


def test_rare_and_frequent_words_have_the_same_values_and_products(spark):
    rng = np.random.default_rng(5)
    posts = [([f"w{min(int(i), 40)}" for i in rng.geometric(0.1, 12)],) for _ in range(60)]
    counts = word_space.pair_counts(spark.createDataFrame(posts, "tokens array<string>"), window=2).persist()
    values = [{(r.word, r.context): r.value for r in word_space.ppmi(counts, 0.75, limit).collect()} for limit in (1, 20, 1 << 20)]
    assert len(values[0]) > 100 and values[0].keys() == values[1].keys() == values[2].keys()
    assert all(values[1][k] == pytest.approx(v) and values[2][k] == pytest.approx(v) for k, v in values[0].items())
    found = [word_space.symmetric_svd(word_space.ppmi(counts), 3, limit=limit)[0] for limit in (1, 20, 1 << 20)]
    assert found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])


def test_words_that_the_driver_does_not_train_get_the_mean_around_them(spark):
    posts = spark.createDataFrame([(["a", "b", "rare", "a"],), (["b", "a", "odd"],), (["alone"],), ([],)], "tokens array<string>")
    found = {r.word: r.vector for r in forecast.word_vectors(posts, size=3, most=2, window=1).collect()}
    assert set(found) == {"a", "b", "rare", "odd", "alone"} and all(len(v) == 3 for v in found.values())
    assert found["rare"] == pytest.approx([(x + y) / 2 for x, y in zip(found["a"], found["b"])])
    assert found["odd"] == pytest.approx(found["a"]) and found["alone"] == [0.0, 0.0, 0.0]
    # More words than that share the largest count: all are there, none is trained.
    tied = spark.createDataFrame([(["x", "y"],)], "tokens array<string>")
    assert sorted(map(tuple, forecast.word_vectors(tied, size=2, most=1).collect())) == [("x", [0.0, 0.0]), ("y", [0.0, 0.0])]


def test_few_sparse_features_take_one_pass_and_no_python(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for t in range(40):
        x = {f: rng.uniform(-2, 2) for f in ("a", "b", "c") if rng.random() < 0.7}
        rows += [(t, f, v) for f, v in x.items()]
        labels.append((t, 3.0 + 2 * x.get("a", 0.0) - x.get("b", 0.0) + 0.5 * x.get("c", 0.0)))
    long = spark.createDataFrame(rows, "timestamp long, feature string, value double")
    numbers = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, number long")
    vectors = wide_regression.sparse_vectors(long, numbers, 3)
    assert "Python" not in vectors._jdf.queryExecution().toString()
    assert {r.timestamp: dict(zip(r.features.indices.tolist(), r.features.values)) for r in vectors.collect()} == {
        t: {"abc".index(f): v for u, f, v in rows if u == t} for t in {r[0] for r in rows}}
    # The solver's passes are bounded to one, which the equations of few features need not more than.
    found = wide_regression.fit_sparse(long, spark.createDataFrame(labels, "timestamp long, y double"), "y", most_passes=1)
    assert {r.feature: r.coefficient for r in found.collect()} == pytest.approx({"a": 2.0, "b": -1.0, "c": 0.5, "intercept": 3.0})


def test_words_as_numbers_have_the_same_vectors_and_leave_little(spark):
    import os

    from crowdtape.operators import coded
    from crowdtape.sources.staging import Scope, staging_folder

    def kept():
        return {name for name in os.listdir(staging_folder(spark).removeprefix("file://")) if os.listdir(f"{staging_folder(spark).removeprefix('file://')}/{name}")}

    rng = np.random.default_rng(8)
    posts = spark.createDataFrame([([f"w{min(int(i), 50)}" for i in rng.geometric(0.1, n % 15)],) for n in range(90)] + [(["q", "q"],)], "tokens array<string>")
    values, vectors = word_space.symmetric_svd(word_space.ppmi(word_space.pair_counts(posts, window=2), 0.75), 3, seed=4)
    want = {r.word: np.array(r.x) * np.sqrt(np.abs(values)) for r in vectors.collect()}
    assert len(want) > 20 and "q" in want
    for limit in (1, 5, 200_000):
        before = kept()
        found = word_space.word_space(posts, size=3, window=2, seed=4, limit=limit)
        assert {name.rsplit("-", 1)[0] for name in kept() - before} == {"eigenvectors", "vectors"}
        assert {r.word: r.vector for r in found.collect()} == {w: pytest.approx(x, abs=1e-8) for w, x in want.items()}
    counted = {(r.word, r.context): r.n for r in word_space.pair_counts(posts, window=2).collect()}
    with Scope(spark) as scope:
        pairs, names = coded.numbered_pair_counts(posts, 2, scope, most=5, per_task=100)
        names = {r.number: r.word for r in names.collect()}
        assert len(set(names.values())) == len(names) and sorted(names)[:5] == [0, 1, 2, 3, 4]
        rows = pairs.collect()
        assert all(r.word <= r.context for r in rows) and 2 * len(rows) - sum(r.word == r.context for r in rows) == len(counted)
        assert all(counted[names[r.word], names[r.context]] == r.n * (2 if r.word == r.context else 1) for r in rows)
