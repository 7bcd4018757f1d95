"""Lines that repeat, exactly or up to a few edits: a segment-partition edit join.

A line is split into edits + 1 segments of nearly equal length. If another line is within that many edits, one of
the segments occurs in it unchanged, no farther from its place than the edits and the difference in length allow.
So every line is entered under (length, segment number, segment), and looks up, for every length it may meet, its
own substrings at the few places where such a segment can lie. Lines that meet under a key are verified by banded
bit-parallel edit distance, many pairs at a time: a machine word holds the differences between neighbouring cells
of a column's band, and a column takes a handful of word operations.

Keys are hashes. First only the keys are counted, which combines before the shuffle; just the few under which
different lines meet are then looked at again, with the lines' texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crowdtape.llm.common import arrow_map, components, pieces_of
from crowdtape.sources.staging import staged

EDITS = 2
# Shorter lines are never taken for repeats; those between the two only when they are equal.
LEAST_CHARS, LEAST_NEAR_CHARS = 10, 30
# Lines that meet under one key are compared in blocks of so many.
BLOCK = 256
# Bits of the filters that spare most rows a shuffle: so many flags, 4 MB, go to every task.
FILTER_BITS = 22
_WHITE = " \t\r\f\v"
_CELLS = 1 << 22


# --- edit distance ---

def within(first: list[str], second: list[str], edits: int) -> np.ndarray:
    """For each pair of texts, whether it is within ``edits`` insertions, deletions and substitutions."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(first, second)], np.int64).reshape(-1, 2)
    result = np.zeros(len(sizes), bool)
    todo = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= edits)
    todo = todo[np.argsort(sizes[todo].max(axis=1), kind="stable")]
    while len(todo):
        # Pairs of like length together, as many as fit a work array.
        longest = sizes[todo].max(axis=1)
        count = max(1, int(np.searchsorted(np.arange(1, len(todo) + 1) * (longest + 2 * edits + 2), _CELLS)))
        part, todo = todo[:count], todo[count:]
        result[part] = _distances([first[i] for i in part], [second[i] for i in part], sizes[part], edits) <= edits
    return result


def _characters(texts: list[str], sizes: np.ndarray, width: int, before: int, fill: int) -> np.ndarray:
    rows = np.full((len(texts), width), fill, np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    rows[row, before + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return rows


def _distances(first: list[str], second: list[str], sizes: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances, right up to ``edits`` and greater than that beyond, of pairs whose lengths are that close.

    Bit k of a word stands for the cell k - ``edits`` below the diagonal; vectors are kept shifted along with it.
    The distance is followed down the band's lowest diagonal to the first text's last character, then along
    that character's row to the second text's.
    """
    m, n = sizes[:, 0], sizes[:, 1]
    band, columns = 2 * edits + 1, int(n.max())
    rows = _characters(first, m, max(int(m.max()), columns) + 2 * edits + 1, edits, 0xFFFFFFFF)
    cells = _characters(second, n, columns, 0, 0xFFFFFFFE)
    full = np.uint64((1 << band) - 1)
    one, lowest = np.uint64(1), np.uint64(band - 1)
    rising = np.full(len(m), ((1 << edits + 1) - 1) << edits, np.uint64)
    falling = np.zeros(len(m), np.uint64)
    distance = np.full(len(m), edits, np.int64)
    straight = m - edits  # columns until the lowest diagonal reaches the last row
    turn = np.minimum(straight, 0)
    distance += turn  # a text shorter than the band starts in its last row
    for j in range(columns):
        equal = np.zeros(len(m), np.uint64)
        for k in range(band):
            equal |= (rows[:, j + k] == cells[:, j]).astype(np.uint64) << np.uint64(k)
        diagonal = ((((equal & rising) + rising) ^ rising) | equal | falling) & full
        right_up = (falling | ~(diagonal | rising)) & full
        right_down = diagonal & rising
        down = j < straight
        place = np.clip(lowest.astype(np.int64) - 1 - (j - straight), 0, band - 1).astype(np.uint64)
        step = np.where(down, 1 - ((diagonal >> lowest) & one).astype(np.int64),
                        ((right_up >> place) & one).astype(np.int64) - ((right_down >> place) & one).astype(np.int64))
        distance += np.where(j < n, step, 0)
        shifted = diagonal >> one
        rising = (right_down | ~(shifted | right_up)) & full
        falling = shifted & right_up
    return distance


# --- lines and their keys ---

def _lines(texts: pa.Array) -> Iterator[tuple[int, int, str]]:
    """Row, number and text of every line that can be a repeat, without the white space around it."""
    for row, text in enumerate(texts.to_pylist()):
        for number, line in enumerate(text.split("\n") if text else ()):
            line = line.strip(_WHITE)
            if len(line) >= LEAST_CHARS:
                yield row, number, line


def _hash(line: str, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, 1):
        found = list(_lines(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array([row for row, _, _ in found], pa.int64())),
             pa.array([number for _, number, _ in found], pa.int32()),
             _longs([_hash(line) for _, _, line in found]), _longs([_hash(line, 7) for _, _, line in found])],
            names=["_id", "_no", "_h", "_g"])


def segment(length: np.ndarray, number: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a length's segment begins, and its length: the last ones get what is left over."""
    base, small = length // parts, parts - length % parts
    return base * number + np.maximum(number - small, 0), base + (number >= small)


class Signatures:
    """Keys of lines, by hashes of any of their substrings from sums over prefixes.

    A line enters its own segments, and looks up lines of its own length and up to ``edits`` shorter. Segment
    number i of a line that is shorter by d can lie up to i places from its own place and, counted from the
    end, up to edits - i.
    """

    _BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, edits: int) -> None:
        self.edits = edits
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            inverse = pow(self._BASE, -1, 1 << 64)
            self.powers, self.inverses = (np.multiply.accumulate(np.concatenate(
                (np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (self._BASE, inverse))

    def keys(self, lines: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """One key for each line at a time, and whether it is an entered one."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._grow(len(chars) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * self.powers[:len(chars)])))
        begins = np.cumsum(sizes) - sizes
        for shorter in range(self.edits + 1):
            for number in range(self.edits + 1):
                start, size = segment(sizes - shorter, number, self.edits + 1)
                mark = (sizes - shorter).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(number + 1)
                rest = self.edits - number
                for move in range(max(-number, shorter - rest), min(number, shorter + rest) + 1):
                    a = begins + start + move
                    value = (sums[a + size] - sums[a]) * self.inverses[a] ^ mark
                    value = (value ^ value >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
                    yield value ^ value >> np.uint64(29), shorter == 0 and move == 0


def _keys(edits: int, wanted: np.ndarray | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(edits)
        for batch in pieces_of(batches):
            lines = list(dict.fromkeys(line for _, _, line in _lines(batch.column(0)) if len(line) >= LEAST_NEAR_CHARS))
            ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
            at = 0
            while at < len(lines):
                after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS)))
                part, at = lines[at:after], after
                hashes = np.array([_hash(line) for line in part], np.uint64).view(np.int64)
                for keys, entered in signatures.keys(part):
                    keys, mine = keys.view(np.int64), hashes
                    if wanted is not None:
                        some = wanted[keys & (len(wanted) - 1)]
                        keys, mine = keys[some], mine[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(mine), pa.array(np.full(len(keys), entered))], names=["key", "_h", "entered"])
    return work


def _texts(wanted: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            lines = list(dict.fromkeys(line for _, _, line in _lines(batch.column(0)) if len(line) >= LEAST_NEAR_CHARS))
            hashes = np.array([_hash(line) for line in lines], np.uint64).view(np.int64)
            some = np.flatnonzero(wanted[hashes & (len(wanted) - 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[some]), pa.array([lines[i] for i in some], pa.string())], names=["_h", "_line"])
    return work


def _remainders(df: DataFrame, column: str) -> np.ndarray:
    """Which low bits the values of a column have: 2^FILTER_BITS flags at most, whatever the table holds."""
    low = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long")).cast("int")
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[df.select(low.alias("low")).distinct().toArrow().column("low").to_numpy()] = True
    return flags


def near_links(docs: DataFrame, text_col: str = "text", edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between hashes of different lines that connect exactly what the pairs within ``edits``
    connect.

    Lines under one key are dealt to blocks of about ``block``, and every two blocks meet in a task of their own, so
    a key of any size is compared in bounded memory and yields a spanning forest for each two blocks.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string"))
    kind = "key long, _h long, entered boolean"
    keyed = arrow_map(texts, _keys(edits, None), kind)
    met = keyed.groupBy("key").agg(F.min("_h").alias("low"), F.max("_h").alias("high"), F.max("entered").alias("some"))
    met = staged(met.where("some AND low <> high").select("key"), "met-keys")
    again = arrow_map(texts, _keys(edits, _remainders(met, "key")), kind)
    members = staged(again.join(met, "key", "left_semi").select("key", "_h").distinct(), "met-lines")

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("_mine", F.pmod(F.xxhash64("_h", "key"), F.col("blocks")).cast("int"))
    paired = dealt.select("key", "_h", "_mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    paired = paired.select("_h", F.struct(
        "key", F.least("_mine", "_other").alias("one"), F.greatest("_mine", "_other").alias("two")).alias("task"), "_mine")
    wanted = members.select("_h").distinct()
    lines = arrow_map(texts, _texts(_remainders(wanted, "_h")), "_h long, _line string")
    lines = lines.join(wanted, "_h", "left_semi").groupBy("_h").agg(F.first("_line").alias("_line"))
    tasks = paired.join(lines, "_h").groupBy("task").agg(
        F.collect_list(F.struct("_h", "_line", (F.col("_mine") == F.col("task.one")).alias("first"))).alias("lines"))
    return arrow_map(tasks.select(F.expr("task.one = task.two").alias("alone"), "lines"), _verify(edits), "a long, b long")


def _verify(edits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, owner = [], [], []
            groups = [(alone, [(x["_h"], x["_line"], x["first"]) for x in lines])
                      for alone, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            links: list[tuple[int, int]] = []

            def settle() -> None:
                texts = [(groups[g][1][i][1], groups[g][1][j][1]) for g, i, j in zip(owner, left, right)]
                near = within([a for a, _ in texts], [b for _, b in texts], edits)
                parent: dict[tuple[int, int], int] = {}

                def root(g: int, x: int) -> int:
                    while parent.get((g, x), x) != x:
                        x = parent[g, x]
                    return x

                for at in np.flatnonzero(near):
                    g = owner[at]
                    a, b = root(g, left[at]), root(g, right[at])
                    if a != b:
                        parent[g, max(a, b)] = min(a, b)
                        links.append((groups[g][1][left[at]][0], groups[g][1][right[at]][0]))
                for x in (left, right, owner):
                    x.clear()

            for g, (alone, lines) in enumerate(groups):
                sizes = np.array([len(line) for _, line, _ in lines])
                side = np.array([first for _, _, first in lines], bool)
                close = np.abs(sizes[:, None] - sizes[None, :]) <= edits
                close &= np.triu(np.ones_like(close), 1) if alone else side[:, None] & ~side[None, :]
                i, j = np.nonzero(close)
                left.extend(i.tolist())
                right.extend(j.tolist())
                owner.extend([g] * len(i))
                if len(owner) > 1 << 16:
                    settle()
            settle()
            both = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
    return work


# --- classes and what is left ---

def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                 block: int = BLOCK) -> DataFrame:
    """One row for each line of at least ``LEAST_CHARS``: ``id_col``, ``line_no``, ``line_hash``, ``class_id``,
    ``class_line``, ``near`` and ``kept``.

    A class holds the lines that chains of equal lines, or of lines within ``edits`` of each other if they have
    ``LEAST_NEAR_CHARS``, connect; white space around a line does not count. It is named by its first line, the
    one with the smallest id and number, the only one that is ``kept``; ``near`` says that a line differs from all
    lines kept. Shorter lines are in no class. NULL and empty texts have no lines. A row without id counts as
    behind all ids; rows that share an id are one document, and its lines keep together.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    # Two hashes make it as good as impossible that different lines count as equal.
    placed = staged(arrow_map(rows, _places, f"_id {kind}, _no int, _h long, _g long"), "line-places")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_no").alias("no"))
    classes = placed.groupBy("_h", "_g").agg(F.min(place).alias("first"))
    roots = components(near_links(docs, text_col, edits, block), "a", "b")
    rooted = staged(classes.join(roots, F.col("_h") == F.col("node"), "left").select(
        "_h", "_g", "first", "root"), "line-classes")
    linked = rooted.where("root IS NOT NULL")
    merged = linked.groupBy("root").agg(F.min("first").alias("class"))
    named = linked.join(merged, "root").select(
        "_h", "_g", "class", (F.col("class") != F.col("first")).alias("moved")
    ).unionByName(rooted.where("root IS NULL").select("_h", "_g", F.col("first").alias("class"), F.lit(False).alias("moved")))
    found = placed.join(named, ["_h", "_g"])
    return found.select(
        F.col("_id").alias(id_col), F.col("_no").alias("line_no"), F.col("_h").alias("line_hash"),
        F.col("class.id").alias("class_id"), F.col("class.no").alias("class_line"),
        F.col("moved").alias("near"),
        (F.col("_id").eqNullSafe(F.col("class.id")) & (F.col("_no") == F.col("class.no"))).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                    block: int = BLOCK) -> DataFrame:
    """``docs`` without the lines that are not ``kept``; documents of which only blank lines are left go.

    Documents without any repeat, NULL and empty texts included, stay as they are.
    """
    gone = line_classes(docs, id_col, text_col, edits, block).where("NOT kept")
    marks = gone.groupBy(F.col(f"`{id_col}`").alias("_of")).agg(
        F.collect_set(F.xxhash64("line_no", "line_hash")).alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"))
    joined = rows.join(marks, F.col("_id").eqNullSafe(F.col("_of")), "left")
    lines = F.filter(F.split(F.col(f"_row.`{text_col}`").cast("string"), "\n"), lambda line, i: ~F.array_contains(
        "_gone", F.xxhash64(i, F.xxhash64(F.trim(line, F.lit(_WHITE))))))
    text = F.when(F.col("_gone").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(lines, "\n"))
    left = joined.withColumn("_text", text).where(
        F.col("_gone").isNull() | (F.length(F.trim("_text", F.lit(_WHITE + "\n"))) > 0))
    return left.select(*[
        (F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
