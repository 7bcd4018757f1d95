"""Word vectors from counts: co-occurrence, positive pointwise mutual information, a randomized SVD.

Everything as long as the vocabulary is a table. The matrix is one row per pair of words that meet; a product with a
block of vectors is a join and a sum; only matrices as small as the block is wide come to the driver.
"""

from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdtape.operators import coded
from crowdtape.operators.lookup import FREQUENT_LIMIT, lookup, most_frequent
from crowdtape.session import share_package
from crowdtape.sources.staging import Scope, staged

WINDOW = 5
# Columns beyond the wanted ones, and products with the matrix that sharpen them.
_SPARE, _ROUNDS = 8, 4


def pair_counts(posts: DataFrame, tokens: str = "tokens", window: int = WINDOW) -> DataFrame:
    """``word, context, n``: how often two words stand at most ``window`` places apart, in either order.

    Each pair is counted and written once; its two orders are made when it is read. The posts should have been written.
    """
    counted = staged(coded.pair_counts(posts, window, tokens), "pair-counts")
    n = _met("n").alias("n")
    return _both(counted, n, n)


def _met(n: str) -> Column:
    """How often two words meet, in either order: a word that follows itself is met from both sides."""
    return F.when(F.col("word") == F.col("context"), 2 * F.col(n)).otherwise(F.col(n))


def _both(pairs: DataFrame, there: Column, back: Column) -> DataFrame:
    """A row for each order of each pair, one for a word with itself, with ``there`` and ``back`` for the two orders."""
    return pairs.select(F.inline(F.array(
        F.struct("word", "context", there),
        F.struct(F.col("context").alias("word"), F.when(F.col("word") != F.col("context"), F.col("word")).alias("context"), back),
    ))).where(F.col("context").isNotNull())


def ppmi(counts: DataFrame, smoothing: float = 1.0, limit: int = FREQUENT_LIMIT) -> DataFrame:
    """``word, context, value``: ln of how much oftener two words meet than by chance, where that is positive.

    ``counts`` has both orders of a pair, with the same count. ``smoothing`` below 1 raises the chance of rare words,
    which otherwise have the largest values. Only one order is looked up, and only rows of rare words are shuffled.
    """
    of_word = staged(_word_counts(counts), "word-counts")
    return _information(_known(counts.where("word <= context"), of_word, limit), of_word, smoothing)


def _word_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").cast("double").alias("_n"), F.count(F.lit(1)).alias("_rows"))


def _known(half: DataFrame, of_word: DataFrame, limit: int, numbered: bool = False) -> DataFrame:
    """One order of each pair with the counts of both words, ``_n`` and ``_n2``. Numbers below ``limit`` are frequent words."""
    of_context = of_word.select(F.col("word").alias("context"), F.col("_n").alias("_n2"), F.col("_rows").alias("_rows2"))
    hot = [F.col(c) < limit if numbered else None for c in ("word", "context")]
    return lookup(lookup(half, of_word, "word", "_rows", limit, hot[0]), of_context, "context", "_rows2", limit, hot[1])


def _information(known: DataFrame, of_word: DataFrame, smoothing: float) -> DataFrame:
    power = F.pow("_n", F.lit(smoothing))
    total, weight = of_word.agg(F.sum("_n")).scalar(), of_word.agg(F.sum(power)).scalar()
    known = known.withColumns({"_total": total, "_whole": weight})

    def value(first: str, second: str) -> Column:
        share = F.pow(second, F.lit(smoothing)) / F.col("_whole")
        return (F.ln(F.col("n") / F.col("_total")) - F.ln(F.col(first) / F.col("_total")) - F.ln(share)).alias("value")

    return _both(known, value("_n", "_n2"), value("_n2", "_n")).where("value > 0")


# --- blocks of vectors: ``word`` and an array of numbers for each ---

def _start(words: DataFrame, width: int, seed: int, names: DataFrame | None = None) -> DataFrame:
    """Random signs that depend on the word, the column and the seed alone; on the name of the word where there are names."""
    named = words.distinct().withColumn("_name", F.col("word"))
    if names is not None:
        named = words.distinct().join(names.select(F.col("number").alias("word"), F.col("word").alias("_name")), "word")
    signs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda c: F.when(F.xxhash64(F.lit(seed), F.col("_name"), c) % 2 == 0, 1.0).otherwise(-1.0))
    return named.select("word", signs.alias("x"))


class _Matrix:
    """A matrix for many products.

    Vectors of the ``limit`` most frequent contexts are broadcast, so a product shuffles only what has a rare context,
    which meets few words and is written once more, and sums that a task cannot end.
    """

    def __init__(self, matrix: DataFrame, limit: int, scope: Scope) -> None:
        self.matrix = matrix
        self.words = matrix.select("word")
        rows = scope.staged(matrix.groupBy("context").agg(F.count(F.lit(1)).alias("_rows")), "context-rows")
        self.frequent = scope.staged(most_frequent(rows, "context", "_rows", limit), "frequent-contexts")
        self.far = scope.staged(matrix.join(F.broadcast(self.frequent), "context", "left_anti"), "far-matrix")

    def times(self, block: DataFrame, width: int, scope: Scope) -> DataFrame:
        """The matrix times the block."""
        vectors = block.select(F.col("word").alias("context"), "x")
        known = vectors.join(F.broadcast(self.frequent), "context", "left_semi")
        met = self.matrix.join(F.broadcast(known), "context").unionByName(self.far.join(vectors, "context"))
        sums = met.groupBy("word").agg(*[F.sum(F.col("value") * F.get("x", F.lit(c))).alias(f"x{c}") for c in range(width)])
        return scope.staged(sums.select("word", F.array(*[f"x{c}" for c in range(width)]).alias("x")), "block")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gram(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """The sum of left's outer products with right: each task adds up its own, the driver adds those."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if len(batch):
                total = total + _rows(batch.column(0)).T @ _rows(batch.column(1))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    share_package(rows.sparkSession)
    found = rows.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(work, "g array<double>").collect()
    flat = sum((np.array(row[0]) for row in found), np.zeros(1))
    width = int(np.sqrt(len(flat)))
    return flat.reshape(width, width)


def _times(block: DataFrame, small: np.ndarray) -> DataFrame:
    """Every row of the block times a small matrix."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1)) @ small if len(batch) else np.zeros((0, small.shape[1]))
            flat = pa.array(rows.ravel())
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * small.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["word", "x"])

    share_package(block.sparkSession)
    return block.select("word", "x").mapInArrow(work, f"word {block.schema['word'].dataType.simpleString()}, x array<double>")


def _orthonormal(block: DataFrame, scope: Scope) -> DataFrame:
    """A block with the same span whose columns are orthonormal; directions that hold next to nothing go.

    Done twice, since one pass through the products of columns leaves rounding errors.
    """
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(block, "x", "x"))
        keep = values > values.max(initial=0.0) * 1e-12
        block = _times(block, vectors[:, keep] / np.sqrt(values[keep]))
    return scope.staged(block, "basis")


def symmetric_svd(matrix: DataFrame, size: int, seed: int = 0, rounds: int = _ROUNDS, limit: int = FREQUENT_LIMIT,
                  names: DataFrame | None = None) -> tuple[np.ndarray, DataFrame]:
    """The ``size`` eigenvalues of largest magnitude of a symmetric ``word, context, value``, and its eigenvectors.

    Eigenvectors are ``word`` and ``x``. A random block is multiplied by the matrix ``rounds`` times and made
    orthonormal each time; the matrix seen through it is small and is decomposed on the driver. Fewer values come
    where the matrix has fewer. Signs are such that the sums of cubes of the vectors' entries are not negative.
    The matrix should come of what has been written; it is read many times. ``names`` has the ``number, word`` of words
    that are numbers. Of what is written here only the eigenvectors stay.
    """
    spark = matrix.sparkSession
    with ExitStack() as kept:
        laid_out = _Matrix(matrix, limit, kept.enter_context(Scope(spark)))
        width = size + _SPARE
        last = kept.enter_context(ExitStack())
        basis = last.enter_context(Scope(spark)).staged(_start(laid_out.words, width, seed, names), "start")
        for _ in range(rounds):
            # A block goes when its basis is there, and that when it has been multiplied.
            of_basis = ExitStack()
            with Scope(spark) as of_block:
                block = laid_out.times(basis, width, of_block)
                last.close()
                last = kept.enter_context(of_basis)
                basis = _orthonormal(block, of_basis.enter_context(Scope(spark)))
            width = len(basis.first()["x"]) if basis.take(1) else 0
            if not width:
                return np.zeros(0), spark.createDataFrame([], basis.schema)
        products = laid_out.times(basis, width, last.enter_context(Scope(spark)))
        seen = basis.join(products.withColumnRenamed("x", "y"), "word")
        small = _gram(seen, "x", "y")
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:size]
        found = staged(_times(basis, vectors[:, order]), "eigenvectors")
    cubes = found.agg(*[F.sum(F.pow(F.get("x", F.lit(c)), F.lit(3))) for c in range(len(order))]).first()
    signs = np.array([-1.0 if (c or 0.0) < 0 else 1.0 for c in cubes])
    return values[order], _times(found, np.diag(signs))


def word_space(posts: DataFrame, size: int = 100, tokens: str = "tokens", window: int = WINDOW, smoothing: float = 0.75,
               seed: int = 0, limit: int = FREQUENT_LIMIT) -> DataFrame:
    """``word, vector``: words that stand in like company have like vectors. Words that meet no other have none.

    Words are numbers until the end, and a pair is kept once with the counts of both words. What is written on the way
    goes as soon as it has been read last.
    """
    spark = posts.sparkSession
    with Scope(spark) as kept:
        with Scope(spark) as counted:
            pairs, names = coded.numbered_pair_counts(posts, window, counted, tokens, most=limit)
            names = kept.staged(names, "names")
            n = _met("n").alias("n")
            of_word = kept.staged(_word_counts(_both(pairs, n, n)), "word-counts")
            known = kept.staged(_known(pairs.withColumn("n", n), of_word, limit, numbered=True), "known-pairs")
        values, vectors = symmetric_svd(_information(known, of_word, smoothing), size, seed, limit=limit, names=names)
        scaled = _times(vectors, np.diag(np.sqrt(np.abs(values)))) if len(values) else vectors
        return staged(scaled.withColumnRenamed("word", "number").join(names, "number").select("word", F.col("x").alias("vector")), "vectors")


def nearest_words(vectors: DataFrame, words: Sequence[str], count: int = 10) -> DataFrame:
    """``word, near, cosine``: the words with the most similar vectors to each of some words, which are few."""
    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    unit = vectors.select("word", "vector", F.sqrt(dot("vector", "vector")).alias("_size")).where("_size > 0")
    asked = unit.where(F.col("word").isin(list(words))).select(
        F.col("word").alias("_word"), F.col("vector").alias("_vector"), F.col("_size").alias("_own"))
    pairs = unit.join(F.broadcast(asked), F.col("word") != F.col("_word"))
    scored = pairs.select(F.col("_word").alias("word"), F.col("word").alias("near"),
                          (dot("vector", "_vector") / F.col("_size") / F.col("_own")).alias("cosine"))
    ranked = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("cosine"), "near")))
    return ranked.where(F.col("_rank") <= count).drop("_rank")
