"""n-grams and post probabilities."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from crowdtape.operators import ngrams
from crowdtape.operators.probability import relative_probability, score_posts


def posts_of(spark, *sentences, partitions=None):
    rows = [(i, s.split()) for i, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    return df.repartition(partitions) if partitions else df


def by_id(df, column):
    return {row["id"]: row[column] for row in df.collect()}


GOLDEN = ["cat dog cat", "shark cat", "dog lamb"]


def test_grams_of_short_arrays(spark):
    row = posts_of(spark, "a b c").select(*[ngrams.grams_of(F.col("tokens"), n).alias(f"n{n}") for n in range(1, 6)]).first()
    assert list(row) == [["a", "b", "c"], ["a b", "b c"], ["a b c"], [], []]
    empty = posts_of(spark, "").select(ngrams.grams_of(F.col("tokens"), 2), ngrams.skipgrams_of(F.col("tokens"), 1)).first()
    assert list(empty) == [[], []]


def test_skipgrams(spark):
    row = posts_of(spark, "a b c d").select(ngrams.skipgrams_of(F.col("tokens"), 1).alias("g")).first()
    assert sorted(row.g) == ["a b", "a c", "b c", "b d", "c d"]
    assert sorted(posts_of(spark, "a b c").select(ngrams.skipgrams_of(F.col("tokens"), 0).alias("g")).first().g) == ["a b", "b c"]


def test_frequency(spark):
    rows = ngrams.gram_frequency(posts_of(spark, *GOLDEN), [1, 2]).collect()
    found = {(r.n, r.gram): (r["count"], r.rel_freq) for r in rows}
    assert found[1, "cat"] == (3, 3 / 4) and found[1, "lamb"] == (1, 1 / 4)
    assert found[2, "cat dog"] == (1, 1 / 4) and len(found) == 8
    total = {r.gram: r.rel_freq for r in ngrams.gram_frequency(posts_of(spark, *GOLDEN), [1], denominator="total").collect()}
    assert total["cat"] == 3 / 7


def test_edge_words(spark):
    rows = ngrams.edge_word_counts(posts_of(spark, *GOLDEN, "", "cat")).collect()
    assert {(r.word, r.first_count, r.last_count) for r in rows} == {
        ("cat", 2, 3), ("shark", 1, 0), ("dog", 1, 0), ("lamb", 0, 1)}


def test_golden_unigram_and_bigram(spark):
    scores = score_posts(posts_of(spark, *GOLDEN)).collect()
    unigram = {r.id: r.unigram_probability for r in scores}
    bigram = {r.id: r.bigram_probability for r in scores}
    assert unigram == pytest.approx({0: 0.28125, 1: 0.1875, 2: 0.125})
    assert bigram == pytest.approx({0: 1 / 27, 1: 2 / 9, 2: 1 / 18})


def test_golden_relative_probability(spark):
    scores = relative_probability(posts_of(spark, *GOLDEN, ""), denominator="total")
    assert by_id(scores, "relative_probability") == pytest.approx({0: 0.4324324, 1: 0.3243243, 2: 0.2432432, 3: 0.0})


def test_empty_and_short_posts_stay(spark):
    scores = {r.id: r for r in score_posts(posts_of(spark, "", "cat", "cat dog")).collect()}
    assert (scores[0].unigram_probability, scores[0].bigram_probability, scores[0].words) == (1.0, 0.0, 0)
    assert scores[1].bigram_probability == 0.0 and scores[1].bigram_log_prob is None
    assert scores[2].bigram_probability == pytest.approx((1 / 2) * (2 / 3) * (1 / 3))


def test_long_posts_underflow_to_zero_but_keep_their_logs(spark):
    row = score_posts(posts_of(spark, "a b " * 2000, "c"), denominator="total").where("id = 0").first()
    assert row.bigram_probability == pytest.approx(math.exp(row.bigram_log_prob))
    assert math.isfinite(row.unigram_log_prob) and row.unigram_probability == 0.0


def brute_force(sentences, order, smoothing, denominator):
    words = [s.split() for s in sentences]

    def grams(w, n):
        return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]

    c1 = collections.Counter(g for w in words for g in w)
    top = collections.Counter(g for w in words for g in grams(w, order))
    below = collections.Counter(g for w in words for g in grams(w, order - 1))
    first = collections.Counter(w[0] for w in words if w)
    last = collections.Counter(w[-1] for w in words if w)
    whole = len(c1) if denominator == "distinct" else sum(c1.values())
    result = {}
    for i, w in enumerate(words):
        unigram = math.prod(c1[g] / whole for g in w)
        ordered = 0.0
        if len(w) >= order:
            ordered = math.prod((top[g] + smoothing) / (below[g[:-1]] + smoothing * len(c1)) for g in grams(w, order))
            ordered *= (first[w[0]] + smoothing) / len(words) * (last[w[-1]] + smoothing) / len(words)
        result[i] = (unigram, ordered)
    return result


@pytest.mark.parametrize("order, smoothing, denominator, limit", [
    (2, 0.0, "distinct", 200_000), (2, 0.0, "distinct", 1), (2, 0.0, "total", 8), (2, 1.0, "distinct", 8),
    (3, 0.0, "distinct", 8), (4, 0.5, "distinct", 8),
])
def test_scores_agree_with_brute_force_however_rows_are_split(spark, order, smoothing, denominator, limit):
    chance = random.Random(order)
    # One word holds about a third of all rows.
    sentences = [" ".join(chance.choice("hot hot hot b c d e f g".split()) for _ in range(chance.randrange(9))) for _ in range(60)]
    expected = brute_force(sentences, order, smoothing, denominator)
    name = {2: "bigram", 3: "trigram", 4: "quadgram"}[order]
    for partitions in (1, 8):
        posts = posts_of(spark, *sentences, partitions=partitions)
        rows = score_posts(posts, order=order, smoothing=smoothing, denominator=denominator, limit=limit).collect()
        assert len(rows) == len(sentences)
        for row in rows:
            assert (row.unigram_probability, row[f"{name}_probability"]) == pytest.approx(expected[row.id])


def test_unigram_only(spark):
    scores = score_posts(posts_of(spark, *GOLDEN, ""), order=1)
    assert scores.columns == ["id", "words", "unigram_log_prob", "unigram_probability"]
    assert by_id(scores, "unigram_probability") == pytest.approx({0: 0.28125, 1: 0.1875, 2: 0.125, 3: 1.0})


def test_work_of_a_task_does_not_grow_with_the_posts(spark):
    posts = posts_of(spark, *["a b c d e f"] * 50, partitions=1)
    dealt = ngrams.in_tasks(posts, "id", per_task=10)
    assert dealt.rdd.getNumPartitions() == 30 and dealt.count() == 50
    sentences = ["a b c a b c d", "a b", "", "d", "b c d e f g", "a b c a b c d"]
    counted = collections.Counter()
    for s in sentences:
        words = s.split()
        counted.update((n, " ".join(words[i:i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    for sizes in ([1, 2, 3, 4, 5], [3], [2, 4], [1], [2]):
        found = ngrams.gram_counts(posts_of(spark, *sentences), sizes, per_task=3)
        assert sorted((r.n, r.gram, r["count"]) for r in found.collect()) == sorted(
            (n, gram, count) for (n, gram), count in counted.items() if n in sizes)


def test_several_sizes_are_sent_as_one(spark):
    plan = ngrams.gram_counts(posts_of(spark, *GOLDEN), [2, 3, 4, 5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_grams_of_posts_pass_no_join(spark):
    from crowdtape.plans.text_features import cleaned_ngrams

    posts = posts_of(spark, *GOLDEN).select("id", F.array_join("tokens", " ").alias("text"), F.current_timestamp().alias("created_at"))
    plan = cleaned_ngrams(posts, stem=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("arrays_zip") < plan.index("Join")


def test_words_travel_once_to_be_counted(spark):
    """One exchange by words, one back to the posts: no gram is sent, written and sent again to be looked up."""
    posts = posts_of(spark, *["a b c d e f"] * 20, *[f"w{i} x{i} y" for i in range(50)])
    for order in (2, 3):
        plan = score_posts(posts, order=order, limit=1)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
        sent = next(line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line)
        assert "_by" in sent
    scores = {r.id: r for r in score_posts(posts, order=2, limit=4).collect()}
    assert len(scores) == 70 and {scores[i].words for i in range(20)} == {6}
    assert scores[20].bigram_probability == pytest.approx(1 / 70 * 50 / 70)


def test_rows_go_by_the_shortest_beginning_that_is_not_frequent(spark):
    sentences = ["a a a a b"] * 6 + ["c a b", "a c", "c", "", "d a a b a c a d"]
    for order, limit in ((2, 2), (2, 3), (3, 2), (3, 4)):
        expected = brute_force(sentences, order, 0.5, "distinct")
        rows = score_posts(posts_of(spark, *sentences), order=order, smoothing=0.5, limit=limit).collect()
        name = {2: "bigram", 3: "trigram"}[order]
        assert len(rows) == len(sentences)
        for row in rows:
            assert row.words == len(sentences[row.id].split())
            assert (row.unigram_probability, row[f"{name}_probability"]) == pytest.approx(expected[row.id])


def test_words_are_sent_in_lists(spark):
    """No row for each word, neither on its way nor back, and nothing is summed before it is sent back."""
    for order in (1, 2, 3):
        plan = score_posts(posts_of(spark, *GOLDEN), order=order)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        assert plan.index("partial_sum") < plan.index("REPARTITION_BY_COL") < plan.index("REPARTITION_BY_NUM")


def test_slices_of_posts():
    import pyarrow as pa
    from crowdtape.operators.probability import _slices

    posts = [["a", "b"], [], ["c"] * 7, ["a"], [], ["b", None, "a"]]
    batch = pa.record_batch({"key": pa.array(range(6)), "_tokens": pa.array(posts)}).slice(1)
    for most in (1, 3, 100):
        found = list(_slices(iter([batch]), most))
        assert [k for s in found for k in s.keys.to_pylist()] == [1, 2, 3, 4, 5]
        assert [w for s in found for w in s.words.to_pylist()] == sum(posts[1:], [])
        assert [x for s in found for x in (s.at + s.left)] == [7] * 7 + [1] + [3] * 3
        assert all(len(s.words) <= most or len(s.keys) == 1 for s in found)
    alone, among = (next(_slices(iter([pa.record_batch({"key": pa.array([1]), "_tokens": pa.array([words])})])))
                    for words in (["b", "c"], ["x", "b", "c", "y"]))
    import numpy as np
    assert alone.hashes(np.array([0]), 2) == among.hashes(np.array([1]), 2)
    assert among.joined(np.array([1]), 0, 2).to_pylist() == ["b c"]


def test_grams_of_posts_need_one_shuffle_of_the_words_as_text(spark):
    from crowdtape.plans.text_features import cleaned_ngrams

    posts = posts_of(spark, "ant bee cow dog elk fox", "", "ant").select(
        "id", F.array_join("tokens", " ").alias("text"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("created_at"))
    found = cleaned_ngrams(posts, stem=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "array_join" in plan[plan.index("Join"):]
    rows = {r.id: r for r in found.collect()}
    assert rows[0].bigram == ["ant bee", "bee cow", "cow dog", "dog elk", "elk fox"] and len(rows[0].pentagram) == 2
    assert all(rows[i][name] == [] for i in (1, 2) for name in ("bigram", "trigram", "quadgram", "pentagram"))
    assert rows[1].bigram_probability == 0.0 and rows[2].unigram_probability == pytest.approx(2 / 6)


def test_pairs_are_counted_by_numbers_sent_in_lists(spark):
    from crowdtape.operators import coded

    chance = random.Random(8)
    sentences = [" ".join(chance.choice("hot hot hot b c d e f é x".split()) for _ in range(chance.randrange(9))) for _ in range(60)]
    sentences += [f"hot w{i} x{i % 7} w{i + 1}" for i in range(40)]
    want = collections.Counter()
    for s in sentences:
        w = s.split()
        want.update(f"{w[i]} {w[i + by]}" for by in (1, 2, 3) for i in range(len(w) - by))
    posts = posts_of(spark, *sentences, partitions=5)
    for most in (1, 4, 1000):
        rows = coded.skipgram_counts(posts, 2, most=most, per_task=50).collect()
        assert len(rows) == len(want) and {r.gram: r["count"] for r in rows} == want
    plan = coded.skipgram_counts(posts_of(spark, *sentences), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    assert coded.skipgram_counts(posts_of(spark, "", "a"), 2).count() == 0


def test_numbers_of_words_in_lists():
    import numpy as np
    import pyarrow as pa
    from crowdtape.operators.coded import _Receiver, _Sender, _halves, _whole

    assert _whole(*_halves(np.array([0, 1, 65_535, 65_536, 200_000, 1 << 31]))).tolist() == [0, 1, 65_535, 65_536, 200_000, 1 << 31]
    frequent, receiver = pa.array(["the", "of"]), _Receiver(pa.array(["the", "of"]))
    numbers = []
    for words in (["of", "odd", "the", "rare"], ["rare", "new", "of"]):
        sender = _Sender(pa.array(words), frequent)
        task, code = np.array([0] * len(words) + [3]), np.append(np.arange(len(words)), 0)
        found, lists = sender.numbers(task, code, np.array([0, 3]))
        assert lists.to_pylist()[0] == [w for w in words if w not in ("the", "of")]
        mine = task == 0
        numbers.append(receiver.numbers(found[mine], np.zeros(mine.sum(), np.int64), lists.slice(0, 1)))
    words, (first, second) = receiver.distinct(numbers)
    assert words.take(pa.array(first)).to_pylist() == ["of", "odd", "the", "rare"]
    assert words.take(pa.array(second)).to_pylist() == ["rare", "new", "of"] and len(words) == 5


def test_long_grams_go_in_stretches(spark):
    from crowdtape.operators import coded

    chance = random.Random(9)
    sentences = [" ".join(chance.choice("hot hot hot b c d e f é x".split()) for _ in range(chance.randrange(12))) for _ in range(60)]
    sentences += ["the same words stand here again and again and again"] * 7 + [f"hot w{i} x{i % 7} w{i + 1} hot c" for i in range(40)]
    for n in (3, 5):
        want = collections.Counter(" ".join(s.split()[i:i + n]) for s in sentences for i in range(len(s.split()) - n + 1))
        for most, partitions in ((1, 3), (4, 1), (1000, 5)):
            rows = coded.long_gram_counts(posts_of(spark, *sentences, partitions=partitions), n, most=most, per_task=40).collect()
            assert len(rows) == len(want) and {r.gram: r["count"] for r in rows} == want
    assert ngrams.gram_counts(posts_of(spark, "", "a b c d"), [5]).count() == 0
    plan = ngrams.gram_counts(posts_of(spark, *sentences), [5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Aggregate" not in plan and "Generate" not in plan


def test_a_stretch_has_each_gram_once_and_goes_by_its_rarest_word():
    import numpy as np
    import pyarrow as pa
    from crowdtape.operators.coded import _alike, _Sender, _stretches
    from crowdtape.operators.slices import slices

    posts = [["the", "of", "odd", "the", "of", "and"], ["the", "of"], [], ["of", None, "the", "the", "the"], ["the", "of", "odd", "the", "of", "and"]]
    s = next(slices(iter([pa.record_batch({"key": pa.array(range(5)), "_tokens": pa.array(posts, pa.list_(pa.string()))})])))
    rank = _Sender(s.distinct, pa.array(["the", "of", "and"])).rank
    mark = np.arange(1, len(s.distinct) + 1).astype(np.uint64) << np.uint64(40)
    begins, sizes, rarest = _stretches(s, rank, mark, 3)
    words = [s.words.slice(b, k).to_pylist() for b, k in zip(begins, sizes)]
    assert words == [["the", "of", "odd", "the", "of"], ["the", "of", "and"], ["the", "the", "the"], ["the", "of", "odd", "the", "of"], ["the", "of", "and"]]
    assert [s.distinct[int(m >> np.uint64(40)) - 1].as_py() for m in rarest] == ["odd", "and", "the", "odd", "and"]
    some, times = _alike(s.code, mark, begins, sizes)
    assert some.tolist() == [0, 1, 2] and times.tolist() == [2, 2, 1]
    # Stretches that only share a hash are told apart.
    some, times = _alike(s.code, np.zeros(len(mark), np.uint64), begins, sizes)
    assert times.sum() == 5 and all(words[a] != words[b] for a in some for b in some if a < b)
