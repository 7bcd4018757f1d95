"""What the operators of this subpackage share."""

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from crowdtape.session import share_package
from crowdtape.sources.staging import staged

# Words are runs of anything but ASCII white space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text, in order; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def remainder(key: str, parts: int = 5) -> Column:
    """crc32 of a key as text, modulo ``parts``; a NULL key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def others(df: DataFrame, *ours: str) -> list[str]:
    """The columns of a table but those named, in upper or lower case: Spark takes such names for the same."""
    taken = {name.lower() for name in ours}
    return [c for c in df.columns if c.lower() not in taken]


def packed(columns: list[str], name: str = "_row") -> Column:
    """Columns as one struct that passes through a step unread; none at all are a struct of a NULL."""
    fields = [F.col(f"`{c}`") for c in columns] or [F.lit(None).cast("boolean").alias("_")]
    return F.struct(*fields).alias(name)


def unpacked(columns: list[str], name: str = "_row") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


# Bytes of an Arrow batch between Spark and a worker. A batch lies in memory on both sides at once, next to what is
# made of it, for every task of an executor.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose workers can import this package; the session's batches have ``BATCH_BYTES`` from then on.

    Workers wait for their next task with what they have allocated, so a task gives back what it has freed.
    """
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    share_package(df.sparkSession)
    df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def _give_back() -> None:
    """Return this process's free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def pieces_of(batches: Iterator[pa.RecordBatch], text: int | str = 0, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices whose texts, in one column, have about ``most`` bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of links between long keys: ``node`` and ``root``, its smallest reachable key.

    Only nodes with a link to another node appear. Alternates two star operations: neighbours above a
    node are linked to the smallest key around it, then neighbours below are. Every step is a grouped
    minimum, which combines before the shuffle, and a join that can be split, so a node with very many
    links needs no task of its own. The links left are written after each round; their number never
    grows, and the rounds needed grow with the logarithm of the longest chain.
    """
    links = staged(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).distinct(),
        "links",
    )
    before = _fingerprint(links)
    while before[0]:
        links = staged(_small_star(_large_star(links)), "links")
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    smallest = both.groupBy("high").agg(F.min("low").alias("_near"))
    smallest = smallest.select("high", F.least("high", "_near").alias("_least"))
    return (
        both.join(smallest, "high").where(F.col("low") > F.col("high"))
        .select(F.col("low").alias("high"), F.col("_least").alias("low")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("high").agg(F.min("low").alias("_least"))
    joined = links.join(smallest, "high")
    moved = joined.where(F.col("low") != F.col("_least")).select(
        F.col("low").alias("high"), F.col("_least").alias("low"))
    kept = smallest.select("high", F.col("_least").alias("low"))
    return moved.unionByName(kept).distinct()


class Lookup:
    """Open addressing from codes to their position in the table they came from."""

    def __init__(self, codes: np.ndarray) -> None:
        bits = max(4, int(len(codes) * 3).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        slots, rest = self._home(codes), np.arange(len(codes))
        while len(rest):
            free = self.keys[slots] == np.iinfo(np.uint64).max
            taken, first = np.unique(slots[free], return_index=True)
            put = rest[free][first]
            self.keys[taken], self.at[taken] = codes[put], put
            open_ = np.ones(len(codes), bool)
            open_[put] = False
            stay = open_[rest]
            slots, rest = (slots[stay] + 1) & self.last, rest[stay]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position of each code, -1 where it is not there."""
        slots = self._home(codes)
        there = self.keys[slots]
        found = np.where(there == codes, self.at[slots], -1)
        rest = np.flatnonzero((there != codes) & (there != np.iinfo(np.uint64).max))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.last
            there = self.keys[slots[rest]]
            hit = there == codes[rest]
            found[rest[hit]] = self.at[slots[rest[hit]]]
            rest = rest[~hit & (there != np.iinfo(np.uint64).max)]
        return found
