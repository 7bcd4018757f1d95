"""Near-duplicate vectors: an exact metric range join over the cells of pivots.

On the unit sphere cosine >= c means distance <= r with r^2 = 2 - 2c. Every vector belongs to the cell of
its nearest pivot. Let y belong to pivot q. A vector of another pivot p's cell lies on p's side of the plane
between p and q, so by the triangle inequality it is farther than r from y unless y is within r of that
plane, that is unless q.y - p.y <= r |p - q|. Only such cells get a copy of y; each cell then joins its own
vectors with themselves and with the copies, independently of all others.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crowdtape.llm.common import arrow_map, components
from crowdtape.sources.staging import staged

THRESHOLD = 0.95
# Vectors a cell is meant to own, and the most that meet in one task: a larger cell is dealt out in parts.
CELL = 4096
# Pivots in memory of each task: at most this many, whatever the table holds.
MOST_PIVOTS = 4096
_SLACK = 1e-9
_BLOCK = 1024
# Rows compared at a time; a pair looked up by itself costs as much as so many in a product of matrices.
_ROWS, _PAIR_COST = 256, 32


def _usable(vector: str):
    """Neither NULL nor zero, and without NULL or non-finite components."""
    return F.col(vector).isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    ) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; a common power of two is taken out first, so no square over- or underflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _radius(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` vectors far from each other, out of four times as many with the smallest key hashes."""
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(4 * count).select("vector").collect()
    rows = _matrix(pa.array([row[0] for row in sample], pa.list_(pa.float64())))
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def _owners(pivots: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = (_matrix(batch.column(0)) @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(owner)], names=["cell"])
    return work


def _deal(pivots: np.ndarray, parts: np.ndarray, threshold: float):
    """Each vector to its own part of its own cell, and to every part that could hold a near one."""
    gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    first = np.concatenate(([0], np.cumsum(parts)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, _BLOCK) for at in range(0, len(batch), _BLOCK)):
                near = _matrix(piece.column("vector")) @ pivots.T
                owner = near.argmax(axis=1)
                own = near[np.arange(len(near)), owner][:, None]
                reaches = own - near <= _radius(threshold) * gaps[owner] + _SLACK
                reaches[np.arange(len(near)), owner] = True
                row, cell = np.nonzero(reaches)
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = piece.column("spread").to_numpy() % parts[owner]
                copied = (cell != owner[row]) | (part != mine[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[cell] + part), pa.array(copied),
                     *(piece.column(name).take(pa.array(row)) for name in ("key", "copies", "vector"))],
                    names=["task", "copied", "key", "copies", "vector"])
    return work


class _Cell:
    """One part of a cell: its own vectors, then the copies that stream past them."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys = None
        self.links: list[np.ndarray] = []

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a given row and an own one that are near. All are compared in single precision, which is
        off by less than the slack, and what may be near in double precision."""
        i, j = np.divmod(np.flatnonzero(rows.astype(np.float32) @ self.single >= self.least), len(self.rows))
        if len(i) * _PAIR_COST > len(rows) * len(self.rows):
            cosine = (rows @ self.rows.T)[i, j]
        else:
            cosine = np.einsum("ij,ij->i", rows[i], self.rows[j])
        found = cosine >= self.threshold
        for at in np.flatnonzero(np.abs(cosine - self.threshold) < 1e-12):
            found[at] = math.fsum(rows[i[at]] * self.rows[j[at]]) >= self.threshold
        return i[found], j[found]

    def close(self) -> None:
        """All own vectors are here: compare them with each other."""
        keys, copies, rows = (np.concatenate(x) for x in zip(*self.held))
        self.keys, self.copies, self.rows, self.held = keys, copies, rows, []
        self.single = np.ascontiguousarray(rows.astype(np.float32).T)
        # A product of n terms of unit vectors, each rounded once more, is off by (n + 2) * 2**-24 at most.
        self.least = np.float32(self.threshold - (rows.shape[1] + 4) * 2.0 ** -23)
        self.counts = np.zeros(len(keys), np.int64)
        self.label = np.arange(len(keys))
        for at in range(0, len(keys), _ROWS):
            i, j = self.near(rows[at:at + _ROWS])
            other = i + at != j
            i, j = i[other], j[other]
            np.add.at(self.counts, i + at, copies[j])
            self._join(i, j, keys[at:at + _ROWS], at)

    def pass_by(self, keys: np.ndarray, copies: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(keys), _ROWS):
            i, j = self.near(rows[at:at + _ROWS])
            np.add.at(self.counts, j, copies[at:at + _ROWS][i])
            self._join(i, j, keys[at:at + _ROWS])

    def _join(self, i: np.ndarray, j: np.ndarray, keys: np.ndarray, own: int | None = None) -> None:
        """One link for each class of own vectors that a row is near to, and these classes become one."""
        row, cuts = np.unique(i, return_index=True)
        for x, near in zip(row, np.split(j, cuts[1:])):
            classes = np.unique(self.label[near])
            if own is not None:
                classes = classes[classes != self.label[own + x]]
                if not len(classes):
                    continue
            self.links.append(np.column_stack((np.full(len(classes), keys[x]), self.keys[classes])))
            into = classes[0] if own is None else self.label[own + x]
            if len(classes) > 1 or own is not None:
                self.label[np.isin(self.label, classes)] = into

    def result(self) -> pa.RecordBatch:
        links = np.concatenate(self.links) if self.links else np.zeros((0, 2), np.int64)
        count = len(self.keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((self.keys, links[:, 0]))),
             pa.array(np.concatenate((np.zeros(count, np.int64), links[:, 1])),
                      mask=np.arange(count + len(links)) < count),
             pa.array(np.concatenate((self.counts, np.zeros(len(links), np.int64))))],
            names=["a", "b", "n"])


def _compare(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, task = None, None
        for batch in batches:
            tasks, copied = batch.column("task").to_numpy(), batch.column("copied").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (copied[1:] != copied[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if tasks[a] != task:
                    if cell is not None and (cell.held or cell.keys is not None):
                        if cell.keys is None:
                            cell.close()
                        yield cell.result()
                    cell, task = _Cell(threshold), tasks[a]
                piece = batch.slice(a, b - a)
                some = (piece.column("key").to_numpy(), piece.column("copies").to_numpy(), _matrix(piece.column("vector")))
                if not copied[a]:
                    cell.held.append(some)
                    continue
                if cell.keys is None:
                    if not cell.held:
                        continue
                    cell.close()
                cell.pass_by(*some)
        if cell is not None and (cell.held or cell.keys is not None):
            if cell.keys is None:
                cell.close()
            yield cell.result()
    return work


def range_join(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Links and link counts of vectors of one dimension.

    ``vectors`` has ``key`` (unique long), ``copies`` (long) and ``vector``. Rows with ``b`` NULL hold in ``n``
    how many copies vector ``a`` is linked to, itself left out; the others are links ``a``, ``b`` that connect
    what all links together connect, at most one for each vector and class it joins in each cell.
    """
    total = vectors.count()
    pivots = choose_pivots(vectors, min(MOST_PIVOTS, max(1, math.ceil(total / cell))))
    sizes = dict(arrow_map(vectors.select("vector"), _owners(pivots), "cell long").groupBy("cell").count().collect())
    parts = np.array([max(1, math.ceil(sizes.get(i, 0) / (2 * cell))) for i in range(len(pivots))])
    kind = vectors.schema["vector"].dataType.simpleString()
    dealt = arrow_map(vectors.withColumn("spread", F.xxhash64("key").bitwiseAND(F.lit((1 << 31) - 1))),
                      _deal(pivots, parts, threshold), f"task long, copied boolean, key long, copies long, vector {kind}")
    together = dealt.repartitionByRange(int(parts.sum()), "task").sortWithinPartitions("task", "copied")
    return arrow_map(together, _compare(threshold), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept``, one row per input row.

    ``n_links`` counts the other rows at cosine >= ``threshold``; ``component_id`` is the smallest id that links
    reach, itself included; ``kept`` says that it is the row's own. Equal vectors are compared once, so a group
    of copies of any size costs one comparison. Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components link with nothing, and so do vectors of different lengths with each other. Repeated ids stay, one
    row each. A row without id takes part; its component's id is NULL where no row of it has one, and it is
    kept only then. Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("vector"))
    usable = rows.where(_usable("vector"))
    classes = staged(
        usable.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first"))
        .withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    lengths = [row[0] for row in classes.select(F.size("vector")).distinct().collect()]
    found = None
    for length in lengths:
        part = range_join(classes.where(F.size("vector") == length).select("key", "copies", "vector"), threshold, cell)
        found = part if found is None else found.unionByName(part)
    alone = rows.where(~_usable("vector")).select(
        F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
        F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = staged(found, "vector-links")
    counts = found.where("b IS NULL").select(F.col("a").alias("key"), "n")
    roots = components(found.where("b IS NOT NULL"), "a", "b")
    placed = classes.drop("vector").join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "copies", "first", F.coalesce("root", "key").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    answers = placed.join(firsts, "root").join(counts, "key").select(
        "key", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id")
    answered = usable.join(classes.select("key", "vector"), "vector").join(answers, "key").select(
        F.col("_id").alias(id_col), "n_links", "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return answered.unionByName(alone)
