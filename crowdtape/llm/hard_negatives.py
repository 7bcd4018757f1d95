"""Hard negatives by coordinate pruning over length buckets, after LEMP.

Rows are laid out by label and length and dealt into groups, one task each. In a task they form buckets of
like length, each with a sorted list of every coordinate of its unit vectors. An anchor that needs a score of
at least t only meets a bucket of greatest length l if t <= |anchor| l, and then only rows at an angle of at
most a with cos a = t / (|anchor| l). If b is the angle between the anchor and a coordinate axis, the angle of
such a row to that axis lies between b - a and b + a: a range of the sorted list. The ranges of the anchor's
largest coordinates, its focus, are intersected, and what is left is scored exactly. Scores already found raise
t from bucket to bucket.
"""

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdtape.llm.common import arrow_map
from crowdtape.sources.staging import staged

POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
# Rows a group is meant to hold; beyond MOST_GROUPS of them groups grow to LARGE_GROUP, then their number does.
GROUP, MOST_GROUPS, LARGE_GROUP = 4096, 1024, 65_536
BUCKET = 2048
FOCUS = 3
# Where there are many groups, every SAMPLE-th is asked first: its answers bound what the others have to give.
SAMPLE = 16
_ANCHORS = 256
_SLACK = 1e-9
_LEAST, _MOST = -(1 << 62), 1 << 62


class _Bucket:
    """Rows of one dimension and like length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, 0)
        self.largest = float(np.abs(vectors).max(initial=0))

    def cosine(self, length: float, floor: float) -> float:
        """The least cosine at which a row could score ``floor``: above 1 for never, -1 for all."""
        reach = length * (self.longest if floor > 0 else self.shortest)
        if reach == 0:
            return 2.0 if floor > 0 else -1.0
        return max(-1.0, floor / reach)

    def candidates(self, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows within the feasible ranges of all focus coordinates; None for a bucket they hardly narrow."""
        if cosine <= 0:
            return None
        reach = math.acos(min(1.0, cosine)) + _SLACK
        ranges = []
        for at in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = math.acos(max(-1.0, min(1.0, float(unit[at]))))
            low = math.cos(angle + reach) if angle + reach < math.pi else -1.0
            high = math.cos(angle - reach) if angle > reach else 1.0
            a = int(np.searchsorted(self.sorted[:, at], low - _SLACK, "left"))
            b = int(np.searchsorted(self.sorted[:, at], high + _SLACK, "right"))
            ranges.append((b - a, a, b, at, low, high))
        ranges.sort()
        size, a, b, at, _, _ = ranges[0]
        if 2 * size > len(self.ids):
            return None
        rows = self.order[a:b, at]
        for _, _, _, at, low, high in ranges[1:]:
            value = self.unit[rows, at]
            rows = rows[(value >= low - _SLACK) & (value <= high + _SLACK)]
        return rows


def _exact(left: np.ndarray, right: np.ndarray, size: float) -> np.ndarray:
    """Integer inner products: in doubles where every sum is exact in them, otherwise in longs."""
    if size < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    if size < 2.0 ** 55:
        return left.astype(np.int64) @ right.astype(np.int64).T
    raise OverflowError("components so large that a hundred times an inner product could pass a long")


class _Best:
    """The best ``keep`` rows of every question, and the score that a further row has to reach."""

    def __init__(self, low: np.ndarray, keep: int) -> None:
        self.keep, self.floor = keep, low.astype(np.int64).copy()
        self.question = self.score = self.id = np.zeros(0, np.int64)

    def add(self, question: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(question):
            return
        question = np.concatenate((self.question, question))
        score, id_ = np.concatenate((self.score, score)), np.concatenate((self.id, id_))
        order = np.lexsort((id_, -score, question))
        question, score, id_ = question[order], score[order], id_[order]
        first = np.searchsorted(question, question)
        rank = np.arange(len(question)) - first
        stay = rank < self.keep
        self.question, self.score, self.id = question[stay], score[stay], id_[stay]
        full = rank == self.keep - 1
        self.floor[question[full]] = np.maximum(self.floor[question[full]], score[full])


class _Group:
    """The rows of one group, then the anchors that stream past them."""

    def __init__(self, keep: int, same: bool) -> None:
        self.keep, self.same = keep, same
        self.held: dict[int, list] = {}
        self.buckets: dict[int, list[_Bucket]] | None = None

    def hold(self, ids: np.ndarray, labels: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        for size, (rows, values) in vectors.items():
            self.held.setdefault(size, []).append((ids[rows], labels[rows], values))

    def close(self) -> None:
        self.buckets = {}
        for size, some in self.held.items():
            ids, labels, vectors = (np.concatenate(x) for x in zip(*some))
            lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            order = np.lexsort((ids, -lengths))
            cuts = [order[at:at + BUCKET] for at in range(0, len(order), BUCKET)]
            self.buckets[size] = [_Bucket(ids[c], labels[c], vectors[c], lengths[c]) for c in cuts]
        self.held = {}

    def ask(self, ids: np.ndarray, labels: np.ndarray, size: int, vectors: np.ndarray, owner: np.ndarray,
            low: np.ndarray, high: np.ndarray) -> _Best:
        """``owner`` says which anchor a question belongs to; its answers score from ``low`` to ``high``."""
        best = _Best(low, self.keep)
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        units = vectors / np.maximum(lengths, 1e-300)[:, None]
        for bucket in self.buckets.get(size, ()):
            need = np.full(len(ids), _MOST)
            np.minimum.at(need, owner, best.floor)
            # A row at the floor may still win by its id, so floors are met and not passed.
            whole, few = [], []
            for i in range(len(ids)):
                cosine = bucket.cosine(lengths[i], float(need[i]))
                if cosine > 1 + _SLACK:
                    continue
                rows = bucket.candidates(units[i], cosine)
                if rows is None:
                    whole.append(i)
                elif len(rows):
                    few.append((i, rows))
            if whole:
                self._verify(best, bucket, np.array(whole), slice(None), ids, labels, vectors, owner, low, high)
            for i, rows in few:
                self._verify(best, bucket, np.array([i]), rows, ids, labels, vectors, owner, low, high)
        return best

    def _verify(self, best: _Best, bucket: _Bucket, asked: np.ndarray, rows, ids: np.ndarray, labels: np.ndarray,
                vectors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        own, held = vectors[asked], bucket.vectors[rows]
        largest = float(np.abs(own).max(initial=0)) * bucket.largest * max(1, vectors.shape[1])
        scores = _exact(own, held, largest)
        alike = labels[asked][:, None] == bucket.labels[rows][None, :]
        fits = alike == self.same
        fits &= ids[asked][:, None] != bucket.ids[rows][None, :]
        place = np.full(len(ids), -1)
        place[asked] = np.arange(len(asked))
        questions = np.flatnonzero(place[owner] >= 0)
        mine = place[owner[questions]]
        found = scores[mine]
        good = fits[mine] & (found >= best.floor[questions][:, None]) & (found <= high[questions][:, None])
        which, column = np.nonzero(good)
        best.add(questions[which], found[which, column], bucket.ids[rows][column])


def _by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their number of components: the rows they are in, and the vectors."""
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    found = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        found[size] = rows, flat[offsets[rows][:, None] + np.arange(size)[None, :]]
    return found


def _answer(keep: int, same: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, current = None, None
        for batch in batches:
            numbers = batch.column("group").to_numpy()
            anchors = batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (anchors[1:] != anchors[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if numbers[a] != current:
                    group, current = _Group(keep, same), numbers[a]
                for at in range(a, b, _ANCHORS if anchors[a] else b - a):
                    piece = batch.slice(at, min(b, at + _ANCHORS) - at if anchors[a] else b - a)
                    ids, labels = piece.column("id").to_numpy(), piece.column("label").to_numpy()
                    vectors = _by_size(piece.column("vector"))
                    if not anchors[a]:
                        group.hold(ids, labels, vectors)
                        continue
                    if group.buckets is None:
                        group.close()
                    yield from _answers(group, piece, ids, labels, vectors)
    return work


def _answers(group: _Group, piece: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: dict) -> Iterator[pa.RecordBatch]:
    asked = piece.column("questions").to_pylist()
    for size, (rows, values) in vectors.items():
        owner = np.array([i for i, row in enumerate(rows) for _ in asked[row]], np.int64)
        every = [q for row in rows for q in asked[row]]
        if not every:
            continue
        low = np.array([q["low"] for q in every], np.int64)
        high = np.array([q["high"] for q in every], np.int64)
        tags = np.array([q["tag"] for q in every], np.int64)
        best = group.ask(ids[rows], labels[rows], size, values, owner, low, high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[rows][owner[best.question]]), pa.array(tags[best.question]), pa.array(best.id), pa.array(best.score)],
            names=["anchor_id", "tag", "id", "score"])


# --- groups ---

def _group_count(rows: int) -> int:
    return max(1, min(MOST_GROUPS, math.ceil(rows / GROUP)), math.ceil(rows / LARGE_GROUP))


class _Groups:
    """What is known of each group: its labels' range and its longest vector."""

    def __init__(self, grouped: DataFrame) -> None:
        #: In the order of their numbers.
        stats = grouped.groupBy("group").agg(F.min("label"), F.max("label"), F.max("length")).orderBy("group").collect()
        self.number = np.array([row[0] for row in stats], np.int64)
        self.low, self.high = np.array([row[1] for row in stats], np.int64), np.array([row[2] for row in stats], np.int64)
        self.longest = np.array([row[3] for row in stats], np.float64)

    def some(self) -> "_Groups":
        """The groups whose number SAMPLE divides."""
        part = copy(self)
        chosen = self.number % SAMPLE == 0
        part.number, part.low, part.high, part.longest = (x[chosen] for x in (self.number, self.low, self.high, self.longest))
        return part

    def deal(self, same: bool):
        """A copy of every anchor for each group that could hold an answer."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in (batch.slice(at, _ANCHORS) for at in range(0, len(batch), _ANCHORS)):
                    label = piece.column("label").to_numpy()[:, None]
                    inside = (label >= self.low) & (label <= self.high)
                    if not same:
                        inside = (label != self.low) | (label != self.high)
                        need = np.array([min([q["low"] for q in some], default=_MOST)
                                         for some in piece.column("questions").to_pylist()], np.float64)[:, None]
                        reach = piece.column("length").to_numpy()[:, None] * self.longest * (1 + _SLACK)
                        inside &= (need <= 0) | (need <= reach)
                    row, group = np.nonzero(inside)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(self.number[group]), pa.array(np.ones(len(row), bool)),
                         *(piece.column(n).take(pa.array(row)) for n in ("id", "label", "vector", "questions"))],
                        names=["group", "anchor", "id", "label", "vector", "questions"])
        return work


_ASKED = "array<struct<tag:bigint,low:bigint,high:bigint>>"
_DEALT = f"group long, anchor boolean, id long, label long, vector array<bigint>, questions {_ASKED}"


def _ask(grouped: DataFrame, groups: _Groups, anchors: DataFrame, keep: int, same: bool) -> DataFrame:
    """``anchor_id, tag, id, score``: each group's best answers to each question of ``anchors``."""
    dealt = arrow_map(anchors.select("id", "label", "vector", "length", "questions"), groups.deal(same), _DEALT)
    held = grouped.select("group", F.lit(False).alias("anchor"), "id", "label", "vector",
                          F.expr(f"CAST(NULL AS {_ASKED})").alias("questions"))
    together = held.unionByName(dealt).repartitionByRange(max(1, len(groups.number)), "group")
    return arrow_map(together.sortWithinPartitions("group", "anchor"), _answer(keep, same),
                     "anchor_id long, tag long, id long, score long")


def _first(found: DataFrame, keep: int) -> DataFrame:
    ranked = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= keep)


def _asking(anchors: DataFrame, questions: DataFrame) -> DataFrame:
    """``anchors`` with their rows of ``questions`` as one list each."""
    asked = questions.groupBy("anchor_id").agg(F.collect_list(F.struct("tag", "low", "high")).alias("questions"))
    return anchors.join(asked, anchors["id"] == asked["anchor_id"]).drop("anchor_id")


def _best(grouped: DataFrame, groups: _Groups, anchors: DataFrame, questions: DataFrame, keep: int, same: bool) -> DataFrame:
    """The best answers to each question (``anchor_id, tag, low, high``) over all groups, ranked.

    A question of which a sample of the groups has ``keep`` answers needs none that scores less than the last of
    them, so the number of answers to merge hardly grows with the number of groups.
    """
    if len(groups.number) >= 2 * SAMPLE:
        sample = grouped.where(F.pmod("group", F.lit(SAMPLE)) == 0)
        early = _first(_ask(sample, groups.some(), _asking(anchors, questions), keep, same), keep)
        bound = early.where(F.col("rank") == keep).select("anchor_id", "tag", F.col("score").alias("bound"))
        questions = staged(questions.join(bound, ["anchor_id", "tag"], "left").select(
            "anchor_id", "tag", F.greatest("low", "bound").alias("low"), "high"), "bounded-questions")
    return _first(_ask(grouped, groups, _asking(anchors, questions), keep, same), keep)


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` holds whole numbers in ``vector_col``, and the score of two rows is their inner product, exactly.
    ``anchors`` says of an id whether its row is an anchor, as a condition on the column ``id``. An anchor's
    positives are the ``positives`` other rows of its label with the largest scores; for each of them follow the
    ``negatives`` rows of other labels with the largest scores s such that low p <= 100 s <= high p, where p is the
    positive's score. Smaller ids come first among equal scores. A positive without such rows has none in the result.

    Rows whose id, label or vector is NULL, or whose vector holds a NULL, take no part. Vectors of different sizes
    never meet. Rows that share an id count as one, the one with the least label and then the least vector. An empty
    table gives no rows. Other columns are not read. Inner products that could pass 2^55 raise an error.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<bigint>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    rows = staged(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"), "mining-rows")
    total = rows.count()
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    laid = rows.withColumn("length", F.sqrt(squares)).repartitionByRange(
        _group_count(total), F.size("vector"), "label", F.desc("length"), "id")
    grouped = staged(laid.withColumn("group", F.spark_partition_id().cast("long")), "mining-groups")
    groups = _Groups(grouped)
    chosen = grouped.where(anchors).select("id", "label", "vector", "length")

    anything = chosen.select(F.col("id").alias("anchor_id"), F.lit(0).cast("long").alias("tag"),
                             F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    alike = _best(grouped, groups, chosen, anything, positives, True)
    alike = staged(alike.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # low p <= 100 s <= high p, in whole numbers: s lies between the ceiling and the floor of these hundredths.
    lows = F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100L)) div 100")
    highs = F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100L)) div 100")
    ranges = alike.select("anchor_id", F.col("positive_id").alias("tag"), lows.alias("low"), highs.alias("high"))
    unlike = _best(grouped, groups, chosen, ranges.where("low <= high"), negatives, False)
    unlike = unlike.select("anchor_id", F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                           F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return unlike.join(alike, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
