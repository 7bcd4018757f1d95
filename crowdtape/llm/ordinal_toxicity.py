"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Grades run from 0 (none) upwards. With one weight vector w for all of them and ordered thresholds t1 <= t2 ...,
P(grade >= k) = 1 / (1 + exp(t_k - w x)), and the expected severity of a text is the sum of these over k. Its
features are its words and their first four and five letters, so that inflected forms share what they begin
with; the value grows with how often a feature occurs for the text's length.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crowdtape.llm.common import arrow_map, others, packed, unpacked
from crowdtape.sources.staging import staged

# The model is fitted on at most this many labelled documents, those with the smallest key hashes, and on the
# features that tell grade 0 from the others best: half their G statistic is at least the gain.
SAMPLE, FEATURES, LEAST_GAIN = 16000, 4000, 7.0
STEPS = 300
STEMS = (4, 5)
_EDGES = ".,;:!?\"'()[]*#%&$|<>-"
_REMEMBERED = 1 << 19


def features_of(word: str) -> list[str]:
    """The word and its first letters, each marked with its length so that they stay apart."""
    return [f"w{word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]


def word_counts(text: str | None) -> Counter:
    counts = Counter((text or "").lower().split())
    bare: Counter = Counter()
    for word, n in counts.items():
        bare[word.strip(_EDGES)] += n
    bare.pop("", None)
    return bare


def strength(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count) / 4


@dataclass
class Model:
    """Weights by feature, and the ordered thresholds."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known: dict[str, tuple[int, ...]] = {}
        scores = np.zeros(len(texts))
        for row, text in enumerate(texts):
            counts = word_counts(text)
            found: Counter = Counter()
            for word, n in counts.items():
                at = known.get(word)
                if at is None:
                    if len(known) > _REMEMBERED:
                        known.clear()
                    at = known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
                for i in at:
                    found[i] += n
            if found:
                at = np.fromiter(found, np.int64, len(found))
                times = np.fromiter(found.values(), np.float64, len(found))
                scores[row] = (self.weights[at] * strength(times)).sum()
        return scores


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int,
        steps: int = STEPS, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, by Adam on all rows; distances of thresholds stay positive."""
    levels, count = int(grades.max()), len(grades)
    reached = (grades[:, None] >= np.arange(1, levels + 1)[None, :]).mean(axis=0)
    start = np.log((1 - reached) / reached)
    theta = np.concatenate((np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    own = np.arange(count)
    for step in range(1, steps + 1):
        weights, gaps = theta[:features], np.exp(theta[features + 1:])
        bounds = np.concatenate(([-np.inf], theta[features] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(rows, weights[columns] * values, count)
        # P(grade = k) is the logistic's mass between the bounds around k.
        low, high = (1 / (1 + np.exp(-np.clip(bounds[grades + side] - score, -500, 500))) for side in (0, 1))
        mass = np.maximum(high - low, 1e-12)
        by_low, by_high = low * (1 - low) / mass, -high * (1 - high) / mass  # of -log mass, by each bound
        slope_score = -(by_low + by_high)
        slope_bound = np.bincount(grades, by_low, levels + 2) + np.bincount(grades + 1, by_high, levels + 2)
        slope_bound = slope_bound[1:levels + 1]
        after = np.cumsum(slope_bound[::-1])[::-1]
        slope = np.concatenate((
            np.bincount(columns, slope_score[rows] * values, features), after[:1], after[1:] * gaps)) / count
        slope[:features] += ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[features + 1:])
    return theta[:features], theta[features] + np.concatenate(([0.0], np.cumsum(gaps)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(0).to_pylist():
            mine: Counter = Counter()
            for word, n in word_counts(text).items():
                for feature in features_of(word):
                    mine[feature] += n
            found.append((list(mine), list(mine.values())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([x[0] for x in found], pa.list_(pa.string())),
             pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["grade", "features", "counts"])


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, split_flagged: bool = False) -> Model | None:
    """The model of at most ``sample`` labelled documents, from the rows of ``labels`` where ``learn_from``.

    Grades are whole numbers from 0, each used; NULL teaches nothing. Without a document of a grade above 0 and
    one of grade 0 there is no model. With ``split_flagged`` the labels are flags and become three grades: a
    flagged document is of grade 2 if it has more different features that mark flagged documents than the median
    flagged document, else of grade 1.
    """
    known = labels.where(learn_from & F.col(f"`{grade_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("_id"), F.greatest(F.col(f"`{grade_col}`").cast("int"), F.lit(0)).alias("grade"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id").select("_text", "grade")
    counted = staged(arrow_map(
        joined, _counted, "grade int, features array<string>, counts array<long>"
    ).withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    sizes = counted.select("row", "grade").toArrow()
    grades = sizes.column("grade").to_numpy()
    raised = int((grades > 0).sum())
    if not 0 < raised < len(grades):
        return None
    cells = counted.select("row", "grade", F.explode(F.arrays_zip("features", "counts")).alias("x")).select(
        "row", "grade", F.col("x.features").alias("feature"), F.col("x.counts").alias("n"))
    plain = len(grades) - raised
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(n: Column, of: int) -> Column:
        expected = (a + b) * of / (raised + plain)
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    told = cells.groupBy("feature").agg(
        F.sum((F.col("grade") > 0).cast("int")).alias("a"), F.sum((F.col("grade") == 0).cast("int")).alias("b"))
    # Features that speak for a raised grade, and not by chance among very many.
    telling = told.withColumn("gain", part(a, raised) + part(b, plain)).where(
        (F.col("gain") >= LEAST_GAIN) & (a * plain > b * raised))
    best = telling.orderBy(F.col("gain").desc(), "feature").limit(features)
    vocabulary = best.toArrow()
    names = vocabulary.column("feature").to_pylist()
    if not names:
        return None
    index = {name: i for i, name in enumerate(names)}
    places = docs.sparkSession.createDataFrame(list(index.items()), "feature string, at int")
    found = cells.join(F.broadcast(places), "feature").select("row", "at", "n").toArrow()
    order = {row: i for i, row in enumerate(sizes.column("row").to_pylist())}
    rows = np.fromiter(map(order.__getitem__, found.column("row").to_pylist()), np.int64, len(found))
    columns, n = found.column("at").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.float64)
    if split_flagged:
        with_it, without = vocabulary.column("a").to_numpy(), vocabulary.column("b").to_numpy()
        marks = with_it / raised > 10 * (without + 1) / plain
        held = np.bincount(rows, marks[columns], len(grades))
        flagged = (grades > 0) & (held > 0)
        middle = np.median(held[flagged]) if flagged.any() else 0.0
        grades = (grades > 0).astype(int) + ((grades > 0) & (held > middle))
    _, grades = np.unique(grades, return_inverse=True)
    weights, thresholds = fit(rows, columns, strength(n), grades, len(names))
    return Model(index, weights, thresholds)


def with_severity(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the likeliest) and ``p_toxic`` (of any grade above 0).

    Columns of these names are replaced, all others pass unread. NULL and empty texts have no features, so only
    the thresholds speak; without a model nothing is toxic and all three are 0. Repeated rows each get theirs.
    """
    ours = ["severity", "grade", "p_toxic"]
    passed = others(docs, *ours)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in passed], F.lit(0.0).alias("severity"),
                           F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beyond = shared.value.beyond(shared.value.scores(batch.column(0).to_pylist()))
            bounds = np.column_stack([np.ones(len(beyond)), beyond, np.zeros(len(beyond))])
            grade = (bounds[:, :-1] - bounds[:, 1:]).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(beyond.sum(axis=1)), pa.array(grade), pa.array(beyond[:, 0].copy())],
                names=["_row", *ours])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), packed(passed))
    schema = T.StructType([rows.schema["_row"], *T.StructType.fromDDL("severity double, grade int, p_toxic double")])
    return arrow_map(rows, work, schema).select(*unpacked(passed), *ours)
