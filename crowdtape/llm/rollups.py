"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes inserts, revises or deletes the count of a document under a tokenizer version. Against the
ledger, the last known count of each document and version, every change becomes signed rows: minus the old
count where it was, plus the new one where it goes. Their sums per key are the batch's delta, and the totals are
the sum of all deltas, so a batch costs its own size and a ledger lookup, never a recount.

A batch is written to folders of its own and takes effect with the marker written last. Doing a batch again
after a failure replaces what it had left; doing it again after its marker changes nothing. Batches take effect in
the order of their numbers, so one with a number below the last marker is refused. Compaction folds the ledger and
the deltas of all batches into one folder each, again with a marker written last.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.llm.common import words

KEYS = ["source", "lang", "tokenizer"]
CHANGE = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, change_no long"
_LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{self.root}/commits")

        spark.createDataFrame([], _LEDGER).write.mode("ignore").parquet(f"{self.root}/base-ledger/upto=-1")
        spark.createDataFrame([], _DELTA).write.mode("ignore").parquet(f"{self.root}/base-deltas/upto=-1")
        spark.createDataFrame([(-1,)], "upto long").write.mode("ignore").parquet(f"{self.root}/bases")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("batch long").parquet(f"{self.root}/commits").distinct()

    def last(self) -> int | None:
        """The number of the last batch that has taken effect."""
        return self._commits().agg(F.max("batch")).first()[0]

    def _base(self) -> int:
        """The last batch that is folded into the base, -1 for none."""
        return self.spark.read.schema("upto long").parquet(f"{self.root}/bases").agg(F.max("upto")).first()[0]

    def _since(self, name: str, schema: str, base: int) -> DataFrame | None:
        """The rows of batches after the base that have a marker; folders that a failure has left have none."""
        later = self._commits().where(F.col("batch") > base)
        if not later.take(1):
            return None
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}").where(F.col("batch") > base)
        return rows.join(F.broadcast(later), "batch", "left_semi")

    def _known(self, keys: DataFrame | None = None) -> DataFrame:
        """The last known count, or deletion, of each document and version, or of the given ones only.

        The ledger is cut down to the given documents before anything is grouped.
        """
        base = self._base()
        rows = self.spark.read.schema(_LEDGER).parquet(f"{self.root}/base-ledger/upto={base}").withColumn("batch", F.lit(base).cast("long"))
        since = self._since("ledger", _LEDGER, base)
        rows = rows if since is None else rows.unionByName(since)
        if keys is not None:
            rows = rows.join(keys, ["doc_id", "tokenizer"], "left_semi")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("batch", "live", "source", "lang", "tokens")).alias("x"))
        return last.where("x.live").select("doc_id", "tokenizer", "x.source", "x.lang", "x.tokens")

    def ledger(self) -> DataFrame:
        """The last known count of each document and tokenizer version that still has one."""
        return self._known()

    def compact(self) -> None:
        """Fold all batches into the base, from which then only later ones are read on top."""
        upto, base = self.last(), self._base()
        if upto is None or upto == base:
            return
        self._known().withColumn("live", F.lit(True)).write.mode("overwrite").parquet(f"{self.root}/base-ledger/upto={upto}")
        self._summed().write.mode("overwrite").parquet(f"{self.root}/base-deltas/upto={upto}")
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{self.root}/bases")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch (numbered upwards from 0 in order of effect); False if it had been applied before.

        A batch that has not been applied and whose number is below the last one's raises an error.

        ``changes`` has the columns of ``CHANGE``, others are ignored. ``op`` is ``insert``, ``revise`` or
        ``delete``; the first two both set a document's count and where it belongs, whatever was known. Of
        several changes to one document and version the greatest ``change_no`` counts, among equals the
        greatest row. Deleting what is not there has no effect. Rows without document, version or a known
        ``op`` have none either; NULL tokens count 0 and NULL sources and languages are keys like others.
        """
        last = self.last()
        if self._commits().where(F.col("batch") == batch).count():
            return False
        if batch < 0 or last is not None and batch < last:
            raise ValueError(f"batch {batch} comes after batch {last}")
        wanted = changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
        newest = wanted.groupBy("doc_id", "tokenizer").agg(F.max(F.struct(
            "change_no", (F.col("op") != "delete").alias("live"), "source", "lang",
            F.coalesce("tokens", F.lit(0)).alias("tokens"))).alias("x"))
        new = newest.select("doc_id", "tokenizer", "x.source", "x.lang", "x.tokens", "x.live")
        new.write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        new = self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger/batch={batch}")
        taken = self._known(new.select("doc_id", "tokenizer"))
        signed = taken.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens")).unionByName(
            new.where("live").select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens"))
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``docs``, ``tokens`` of all keys that have documents."""
        return self._summed().where("docs > 0")

    def _summed(self) -> DataFrame:
        base = self._base()
        deltas = self.spark.read.schema(_DELTA).parquet(f"{self.root}/base-deltas/upto={base}")
        since = self._since("deltas", _DELTA, base)
        deltas = deltas if since is None else deltas.unionByName(since.drop("batch"))
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


# Tokenizer versions that plain expressions count: runs between white space, and words, numbers and signs.
WORDS, PIECES = "words-1", "pieces-2"
PIECE = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def counts(text: str) -> dict:
    """Expressions that count the tokens of a text column (NULL: none) under each version."""
    column = F.coalesce(F.col(text), F.lit(""))
    return {WORDS: F.size(words(column)).cast("long"), PIECES: F.regexp_count(column, F.lit(PIECE)).cast("long")}
