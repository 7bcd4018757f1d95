"""The line classifier, the byte model, toxicity grades and pieces against plain versions of them."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtape.llm import line_crf, ordinal_toxicity, pieces, ppm
from crowdtape.llm.common import remainder

SPECIAL = [(900, None), (901, ""), (902, " \n \n"), (None, "no id here"), (903, "long " * 30_000), (904, "a\nb"), (904, "a\nb")]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 1.0, "r") for i, t in rows], "doc_id long, text string, _text string, score double, _row string")


# --- line classifier ---

def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    pairs, lines = rng.normal(size=(2, 2)), np.array([3, 1, 5, 2])
    scores = rng.normal(size=lines.sum())
    good, expected = line_crf.chain_marginals(scores, pairs, lines)
    at = 0
    for chain, n in enumerate(lines):
        weight, first, count = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in np.ndindex(*[2] * n):
            p = math.exp(sum(scores[at + i] * y for i, y in enumerate(labels)) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
            weight += p
            first += p * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                count[a, b] += p
        assert np.allclose(good[at:at + n], first / weight) and np.allclose(expected[chain], count / weight)
        at += n


def test_quality_on_held_out_documents_and_edges(spark):
    rng = random.Random(1)
    words = "the river ran over grey stones and under every bridge of that old town".split()
    good = [(i, "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(rng.randint(1, 6)))) for i in range(150)]
    bad = [(i, "\n".join("### " + " ".join(rng.choices(["$$", "||", "BUY"], k=9)) for _ in range(rng.randint(1, 6)))) for i in range(150, 300)]
    docs = frame(spark, good + bad + SPECIAL)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(901, None)], "doc_id long, quality int")
    model = line_crf.train(docs, labels, remainder("doc_id") != 0)
    scored = line_crf.with_quality(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    found = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(found) == 307 and all(0 <= s <= 1 for _, s in found)
    assert all((s >= 0.3) == (i < 150) for i, s in found if i is not None and i < 300)
    assert [s for i, s in found if i in (900, 901)] == [pytest.approx(model.prior)] * 2
    assert line_crf.train(docs, labels.limit(0), remainder("doc_id") != 0) is None
    assert {r.score for r in line_crf.with_quality(docs, None).collect()} == {0.5}
    assert line_crf.with_quality(docs.limit(0), model).count() == 0


# --- byte model ---

def plain_log_probability(counts, share, order, before, byte):
    """log P(byte | before) by the definition, from a table of counts of strings of order + 1 bytes."""
    total = sum(counts.values())
    kept, after = defaultdict(int), defaultdict(int)
    for string, n in counts.items():
        for k in range(1, order + 2):
            kept[string[-k:]] += n
            after[string[-k:-1]] += n
    nodes = {s: n for s, n in kept.items() if n * share >= total}
    seen = defaultdict(dict)
    for s, n in nodes.items():
        seen[s[:-1]][s[-1]] = n
    result, excluded = 0.0, set()
    for k in range(order, -1, -1):
        context = before[len(before) - k:]
        if context not in seen:
            continue
        left = {b: n for b, n in seen[context].items() if b not in excluded}
        unseen = after[context] - sum(seen[context].values())
        everything = 2 * (sum(left.values()) + unseen)
        if byte in left:
            return result + math.log((2 * left[byte] - 1) / everything)
        if everything and len(left) + 2 * unseen:
            result += math.log((len(left) + 2 * unseen) / everything)
        excluded |= set(seen[context])
    return result - math.log(256 - len(excluded))


@pytest.mark.parametrize("share", [1 << 20, 40])
def test_bytes_have_the_probabilities_of_the_definition(spark, share):
    texts = ["the cat sat on the mat", "The dog sat", "a catalogue of cats", "", None, "the the the"]
    order, counts = 3, Counter()
    for text in texts:
        data = b"\n" * order + b" ".join(ppm.tokens_of(text)) + b"\n"
        counts.update(data[i - order:i + 1] for i in range(order, len(data)))
    trie = ppm.build_trie(ppm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), order=order), order, share)
    rng = random.Random(7)
    for before in [b"\n\n\n", b"the", b" ca", b"zzz", b"he ", b"at\xff"] + [bytes(rng.choices(b"aceht \n", k=3)) for _ in range(20)]:
        codes = np.array([int.from_bytes(before + bytes([b]), "big") for b in range(256)], np.uint64)
        found = trie.log_probabilities(codes)
        assert np.exp(found).sum() == pytest.approx(1.0)
        assert np.allclose(found, [plain_log_probability(counts, share, order, before, b) for b in range(256)])


@pytest.mark.parametrize("frequent", [ppm.FREQUENT_WORDS, 3])
def test_scores_of_texts(spark, frequent):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("Red green blue RED\tcyan teal plum".split(" "), k=rng.randint(0, 9)))) for i in range(60)]
    rows += SPECIAL
    docs = frame(spark, rows).withColumn("held_out", remainder("doc_id") == 1)
    found = ppm.score_texts(docs, remainder("doc_id") != 1, order=3, frequent=frequent).collect()
    assert len(found) == len(rows)
    held = {r.doc_id: r.held_out for r in docs.collect()}
    counts = Counter()
    for i, text in rows:
        if not held[i]:
            counts.update([*ppm.tokens_of(text), b"\n"])
    total, size = sum(counts.values()), len(counts)
    want = {}
    for i, text in rows:
        tokens = [*ppm.tokens_of(text), b"\n"]
        want[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), total,
                   sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (size + 1))) for t in tokens))
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])

    # The score of a whole text is the sum over its bytes and its end, each by the definition.
    def data_of(text):
        return b"\n" * 3 + b" ".join(ppm.tokens_of(text)) + b"\n"

    grams, known = Counter(), {}
    for i, text in rows:
        if not held[i]:
            data = data_of(text)
            grams.update(data[at - 3:at + 1] for at in range(3, len(data)))

    def plain(gram):
        if gram not in known:
            known[gram] = plain_log_probability(grams, ppm.SHARE, 3, gram[:3], gram[3])
        return known[gram]

    for r, text in [(r, text) for r in found for i, text in rows if i == r.doc_id and r.doc_id not in (None, 904)]:
        data = data_of(text)
        assert r.score == pytest.approx(sum(plain(data[at - 3:at + 1]) for at in range(3, len(data))) / math.log(10), rel=1e-9)


@pytest.mark.parametrize("order, share", [(3, 40), (5, 1), (2, 40)])
def test_strings_that_are_not_frequent_are_scored_like_all_others(spark, order, share):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices("red green blue r\u00e9d reed bleu".split(), k=rng.randint(0, 6)))) for i in range(30)]
    rows += [(30, "grebe breed\u4e2d reddest"), (31, "zzz zzz")]
    docs = frame(spark, rows)
    found = ppm.score_texts(docs, F.col("doc_id") < 25, order=order, share=share, frequent=3).collect()

    def grams_of(text):
        data = b"\n" * order + b" ".join(ppm.tokens_of(text)) + b"\n"
        return [data[at - order:at + 1] for at in range(order, len(data))]

    grams, known = Counter(g for i, text in rows if i < 25 for g in grams_of(text)), {}
    everything = sum(grams.values())
    for r in found:
        for g in grams_of(rows[r.doc_id][1]):
            known.setdefault(g, plain_log_probability(grams, everything, order, g[:-1], g[-1]))
        assert r.score == pytest.approx(sum(known[g] for g in grams_of(rows[r.doc_id][1])) / math.log(10), rel=1e-9)
    assert len(found) == len(rows)


def test_nothing_to_learn_from(spark):
    found = ppm.score_texts(frame(spark, [(1, "ab c"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert [r.score for r in found] == [pytest.approx(-5 * math.log10(256)), pytest.approx(-math.log10(256))]
    assert ppm.score_texts(frame(spark, []), F.lit(True)).count() == 0


# --- toxicity ---

def test_gradients_reach_grades_in_order():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=6)
    x = (rng.random((3000, 6)) < 0.4).astype(float)
    grades = np.digitize(x @ weights + rng.logistic(size=3000) * 0.3, [0.0, 0.8, 1.6])
    rows, columns = np.nonzero(x)
    found, thresholds = ordinal_toxicity.fit(rows, columns, np.ones(len(rows)), grades, 6, steps=600)
    assert (np.diff(thresholds) > 0).all() and np.corrcoef(found, weights)[0, 1] > 0.98
    guess = np.digitize(x @ found, thresholds)
    assert (np.abs(guess - grades) <= 1).mean() > 0.97


def plain_likelihood(weights, thresholds, rows, columns, values, grades, ridge):
    """Mean log likelihood less the penalty, document by document."""
    total = 0.0
    for i, grade in enumerate(grades):
        score = sum(weights[c] * v for r, c, v in zip(rows, columns, values) if r == i)
        beyond = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
        total += math.log(beyond[grade] - beyond[grade + 1])
    return total / len(grades) - ridge / 2 * sum(w * w for w in weights)


def test_fit_is_where_the_likelihood_is_greatest():
    rng = np.random.default_rng(11)
    grades = rng.integers(0, 3, 90)
    rows, columns = np.nonzero(rng.random((90, 4)) < 0.4)
    columns = np.where(rng.random(len(rows)) < 0.3, np.minimum(grades[rows], 3), columns)
    values = rng.uniform(1, 2, len(rows))
    weights, thresholds = ordinal_toxicity.fit(rows, columns, values, grades, 4, steps=3000, ridge=0.01)
    assert (np.diff(thresholds) > 0).all()
    best = plain_likelihood(weights, thresholds, rows, columns, values, grades, 0.01)
    for i in range(6):
        for step in (-0.05, 0.05):
            moved = np.concatenate((weights, thresholds))
            moved[i] += step
            other = plain_likelihood(moved[:4], moved[4:], rows, columns, values, grades, 0.01)
            assert other < best and best - other < 0.01
    # A weight may be negative: a feature of grade 0 lowers the score.
    low = ordinal_toxicity.fit(np.arange(60), np.arange(60) % 2, np.ones(60), np.arange(60) % 2, 2)[0]
    assert low[0] < 0 < low[1]


def test_severity_by_its_definition(spark):
    """Words, their first four and five letters, counts dampened, and the sum of the chances to reach each grade."""
    rng = random.Random(8)
    names = ["wvile", "4vile", "wviley", "5viley", "wugly", "4ugly", "5uglym", "wmean"]
    model = ordinal_toxicity.Model({n: i for i, n in enumerate(names)}, np.array([rng.uniform(-1, 2) for _ in names]), np.array([0.4, 1.7]))
    stock = ["vile", "Vile,", "viley!", "vileyest", "uglymost", "ugly", "mean", "meant", "fine", "...", "\u00e9"]
    rows = [(i, " ".join(rng.choices(stock, k=rng.randint(0, 12)))) for i in range(50)] + SPECIAL
    for r in ordinal_toxicity.with_severity(frame(spark, rows), model).collect():
        if r.doc_id in (None, 904):
            continue
        counts = Counter()
        for word in (dict(rows)[r.doc_id] or "").lower().split():
            word = word.strip(".,;:!?\"'()[]*#%&$|<>-")
            if word:
                counts.update(["w" + word, *(f"{n}{word[:n]}" for n in (4, 5) if len(word) > n)])
        score = sum(model.weights[i] * (1 + math.log(counts[n]) / 4) for n, i in model.index.items() if counts[n])
        beyond = [1 / (1 + math.exp(t - score)) for t in (0.4, 1.7)]
        chances = [1 - beyond[0], beyond[0] - beyond[1], beyond[1]]
        assert r.severity == pytest.approx(sum(beyond)) and r.p_toxic == pytest.approx(beyond[0])
        assert chances[r.grade] == pytest.approx(max(chances))


def test_severity_on_held_out_documents_and_edges(spark):
    rng = random.Random(3)
    mild, harsh = ["meanword", "meanwords"], ["vilestuff", "vilely", "meanword"]
    plain = "some quite ordinary words about rivers bridges towns and stones".split()

    def text(grade):
        return " ".join(rng.choices(plain, k=20) + (rng.choices(mild, k=1) if grade == 1 else []) + (harsh if grade == 2 else []))

    grades = {i: i % 3 for i in range(300)}
    docs = frame(spark, [(i, text(g)) for i, g in grades.items()] + SPECIAL)
    labels = spark.createDataFrame([(i, g) for i, g in grades.items()] + [(903, None)], "doc_id long, toxic int")
    model = ordinal_toxicity.train(docs, labels, remainder("doc_id") != 0)
    found = ordinal_toxicity.with_severity(docs, model).collect()
    assert len(found) == 307
    for r in found:
        assert 0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1
        assert (r.grade if r.doc_id in grades else r.grade == 0) == grades.get(r.doc_id, True)
    by = [np.mean([r.severity for r in found if grades.get(r.doc_id) == g]) for g in range(3)]
    assert by[0] < by[1] < by[2]
    assert ordinal_toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r.severity for r in ordinal_toxicity.with_severity(docs, None).collect()} == {0.0}
    flags = labels.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    split = ordinal_toxicity.train(docs, flags, F.lit(True), split_flagged=True)
    assert len(split.thresholds) == 2


# --- pieces ---

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def every_segmentation(vocabulary, unit):
    if not unit:
        return [(0.0, [])]
    found, node, spelled = [], 0, False
    for end in range(1, min(len(unit), vocabulary.longest) + 1):
        node = vocabulary.children.get(node << 21 | ord(unit[end - 1]), -1)
        if node < 0:
            break
        if vocabulary.ends[node] >= 0:
            spelled = spelled or end == 1
            found += [(vocabulary.scores[vocabulary.ends[node]] + s, [int(vocabulary.ends[node]), *ids])
                      for s, ids in every_segmentation(vocabulary, unit[end:])]
    if not spelled:
        found += [(vocabulary.scores[-1] + s, vocabulary._spell(unit[0]) + ids) for s, ids in every_segmentation(vocabulary, unit[1:])]
    return found


@pytest.mark.parametrize("text", ["hello there", "a\nb  c", "né 你好🤪", " x", "the the the", "aaaaaa"])
def test_segmentations_in_order(vocabulary, text):
    whole = sorted(every_segmentation(vocabulary, pieces.BLANK + text.replace(" ", pieces.BLANK)), key=lambda x: -x[0])
    ids, score, nbest = vocabulary.encode([text], 6)[0]
    assert [s for s, _ in nbest] == pytest.approx([s for s, _ in whole[:6]])
    spelled = []
    for s, changes in nbest:
        mine = ids.tolist()
        for at, old, new in sorted(changes, reverse=True):
            mine[at:at + old] = new
        spelled.append(tuple(mine))
        assert s == pytest.approx(next(x for x, other in whole if other == mine))
        assert vocabulary.decode(np.array(mine)) == text
    assert len(set(spelled)) == len(spelled) and score == nbest[0][0]
    found = vocabulary.search(pieces.BLANK + text.replace(" ", pieces.BLANK), 6)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in whole[:6]])


def test_round_trip_of_all_texts(spark, vocabulary):
    rows = SPECIAL + [(1, "  two blanks, tab\tand\r\nline end "), (2, "日本語 ünï 🤪 \u0000 x"), (3, "A" * 5000)]
    docs = frame(spark, rows)
    encoded = pieces.with_pieces(docs, vocabulary, count=2)
    decoded = pieces.with_text(encoded, vocabulary)
    found = decoded.collect()
    assert len(found) == len(rows) and all(r.decoded == r.text for r in found)
    assert {(r.doc_id, r.ids is None, r.score) for r in found if r.doc_id in (900, 901)} == {(900, True, None), (901, False, 0.0)}
    assert pieces.with_pieces(docs.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([([-1, 99_999_999, None],)], "ids array<int>")
    assert pieces.with_text(odd, vocabulary).first().decoded == ""
