"""Stored posts that are added to again and again: one row per key, in ranges of keys, with arrivals beside them.

A delivery is a folder of arrivals and changes nothing else. Compaction folds the arrivals that wait into the
stored ranges. It reads and writes only the ranges whose stored keys lie between keys that arrived; keys beyond
all stored ones, as new posts have, are written without reading anything. A pointer is written last: until then
readers see the former ranges and the arrivals, whatever a compaction that broke off has left.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from crowdtape.operators.dedupe import keep_last
from crowdtape.sources.staging import delete_folder, staged

# Keys that one range spans: the first digits of a post id tell its time, so this is a stretch of time.
SPAN = 1 << 20
_RANGE = "gen long, part long, low long, high long, rows long"
_POINTER = "version long, upto long"


class History:
    """The last arrival of every key, below a folder that all executors share.

    ``schema`` is that of the rows; ``order`` decides among rows of one key in one delivery. Rows without key are
    in no range and are left out. ``owner`` is the column whose largest stored keys ``newer`` compares with. One
    writer at a time: deliveries are numbered upwards from 0, and each is whole before the next one or a compaction
    begins.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str = "id",
                 order: Sequence[Column] = (), span: int = SPAN, owner: str | None = None) -> None:
        self.spark, self.root, self.schema, self.key, self.span = spark, root.rstrip("/"), schema, key, span
        self.order, self.owner = list(order), owner
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/arrivals/arrival=-1")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/base/gen=0/part=0")
        spark.createDataFrame([], _RANGE).write.mode("ignore").parquet(f"{self.root}/ranges/version=0")
        if owner:
            self._marks(spark.createDataFrame([], schema)).write.mode("ignore").parquet(f"{self.root}/marks/version=0")
        spark.createDataFrame([(0, -1)], _POINTER).write.mode("ignore").parquet(f"{self.root}/pointers")

    # --- what is there ---

    def pointer(self) -> tuple[int, int]:
        """The version of the ranges that counts, and the last arrival in it."""
        found = self.spark.read.schema(_POINTER).parquet(f"{self.root}/pointers")
        return tuple(found.agg(F.max(F.struct("version", "upto")).alias("p")).select("p.*").first())

    def ranges(self, version: int | None = None) -> DataFrame:
        """``gen, part, low, high, rows`` of the stored ranges."""
        version = self.pointer()[0] if version is None else version
        return self.spark.read.schema(_RANGE).parquet(f"{self.root}/ranges/version={version}")

    def waiting(self, upto: int | None = None) -> DataFrame:
        """Arrivals that are not in the stored ranges, with ``arrival``."""
        upto = self.pointer()[1] if upto is None else upto
        rows = self._folder("arrivals", ("arrival",))
        return rows.where((F.col("arrival") > upto) & F.col(self.key).isNotNull())

    def stored(self, ranges: DataFrame | None = None) -> DataFrame:
        """The rows of some ranges, or of all that count. Only their folders are read."""
        listed: dict[int, list[int]] = {}
        for gen, part in (self.ranges() if ranges is None else ranges).select("gen", "part").collect():
            listed.setdefault(gen, []).append(part)
        rows = self._folder("base", ("gen", "part"))
        chosen = [(F.col("gen") == gen) & F.col("part").isin(parts) for gen, parts in listed.items()]
        return rows.where(reduce(lambda a, b: a | b, chosen, F.lit(False))).drop("gen", "part")

    def read(self) -> DataFrame:
        """One row per key: the stored ranges, and the arrivals since, which win.

        Only arrivals are ranked. The stored rows are scanned, not shuffled, if the keys that arrived are few enough
        for Spark to broadcast.
        """
        version, upto = self.pointer()
        latest = self._latest(self.waiting(upto))
        return self.stored(self.ranges(version)).join(latest.select(self.key), self.key, "left_anti").unionByName(latest)

    def _folder(self, name: str, parts: tuple[str, ...]) -> DataFrame:
        schema = reduce(lambda s, c: s.add(c, LongType()), parts, StructType(list(self.schema.fields)))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _latest(self, waiting: DataFrame) -> DataFrame:
        return keep_last(waiting, self.key, F.desc("arrival"), *self.order).drop("arrival")

    def marks(self) -> DataFrame:
        """The owners and their largest keys: kept at compaction, so only arrivals are read beside them."""
        version, upto = self.pointer()
        kept = self.spark.read.parquet(f"{self.root}/marks/version={version}")
        return kept.unionByName(self._marks(self.waiting(upto))).groupBy(self.owner).agg(F.max("_mark").alias("_mark"))

    def newer(self, landed: DataFrame) -> DataFrame:
        """Landed rows beyond their owner's largest key; an owner that has none keeps all."""
        marked = landed.join(self.marks(), self.owner, "left")
        return marked.where(F.col("_mark").isNull() | (F.col(self.key) > F.col("_mark"))).select(*landed.columns)

    def _marks(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.owner).agg(F.max(self.key).alias("_mark"))

    # --- what changes it ---

    def append(self, rows: DataFrame, arrival: int) -> None:
        """Store a delivery. Sent again it replaces itself; one that is folded in already changes nothing."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/arrivals/arrival={arrival}")

    def touched(self, latest: DataFrame, ranges: DataFrame) -> DataFrame:
        """Ranges that may hold a key that arrived: their stored keys meet the span of the part's arriving keys."""
        arriving = latest.groupBy(self._part().alias("part")).agg(
            F.min(self.key).alias("_low"), F.max(self.key).alias("_high"))
        return ranges.join(arriving, "part").where("low <= _high AND high >= _low").select(*ranges.columns)

    def compact(self) -> int:
        """Fold the arrivals that wait into the stored ranges; returns how many rows of stored ranges were read."""
        version, upto = self.pointer()
        last = self.waiting(upto).agg(F.max("arrival")).first()[0]
        if last is None:
            return 0
        ranges = self.ranges(version)
        latest = staged(self._latest(self.waiting(upto).where(F.col("arrival") <= last)), "arrived")
        touched = staged(self.touched(latest, ranges), "touched-ranges")
        merged = self.stored(touched).join(latest.select(self.key), self.key, "left_anti").unionByName(latest)
        gen = version + 1
        laid = merged.withColumn("part", self._part()).hint("rebalance", "part").sortWithinPartitions("part", self.key)
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/base/gen={gen}")
        written = self._folder("base", ("gen", "part")).where(F.col("gen") == gen)
        fresh = written.groupBy("gen", "part").agg(
            F.min(self.key).cast("long").alias("low"), F.max(self.key).cast("long").alias("high"), F.count(F.lit(1)).alias("rows"))
        kept = ranges.join(touched.select("gen", "part"), ["gen", "part"], "left_anti")
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{self.root}/ranges/version={gen}")
        if self.owner:
            both = self.spark.read.parquet(f"{self.root}/marks/version={version}").unionByName(self._marks(latest))
            both.groupBy(self.owner).agg(F.max("_mark").alias("_mark")).write.mode("overwrite").parquet(
                f"{self.root}/marks/version={gen}")
        self._point(gen, last)
        return touched.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _point(self, version: int, upto: int) -> None:
        self.spark.createDataFrame([(version, upto)], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")

    def _part(self) -> Column:
        return F.expr(f"(`{self.key}` - pmod(`{self.key}`, {self.span}L)) div {self.span}L")

    def clean(self) -> None:
        """Delete arrivals that are folded in, and ranges that the pointer's version does not name.

        Frames read before a compaction that came since end with them.
        """
        version, upto = self.pointer()
        counted = {tuple(row) for row in self.ranges(version).select("gen", "part").collect()}
        there = self._folder("base", ("gen", "part")).select("gen", "part").distinct().collect()
        for gen, part in there:
            if (gen, part) not in counted and gen > 0:
                delete_folder(self.spark, f"{self.root}/base/gen={gen}/part={part}")
        for (arrival,) in self._folder("arrivals", ("arrival",)).where(F.col("arrival").between(0, upto)).select("arrival").distinct().collect():
            delete_folder(self.spark, f"{self.root}/arrivals/arrival={arrival}")
        for old in range(1, version):
            for name in ("ranges", "marks"):
                delete_folder(self.spark, f"{self.root}/{name}/version={old}")
