"""How probable each post is, given the words of all posts.

A post of words w1..wk scores

* unigram: the product of the relative frequencies of its words; 1 for an empty post;
* order n: the product of count(n-gram) / count(its first n-1 words), times the share of posts that
  begin with w1 and the share that end with wk; 0 for a post shorter than n words.

Products are computed as sums of logarithms, which do not underflow; the plain values are their
exponentials and reach 0 on long posts. Frequencies relative to the number of distinct words may exceed
1, so that unigram value can also reach infinity; relative to all words it cannot.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from crowdtape.operators.lookup import FREQUENT_LIMIT, lookup
from crowdtape.operators.ngrams import WORDS_PER_TASK, gram_at, positions
from crowdtape.operators.slices import slices as _slices
from crowdtape.session import share_package
from crowdtape.sources.staging import staged

# Longer grams are frequent from this share on: a task counts those that are not, so they need not be as rare as words.
GRAM_LIMIT = 2_000
# What the row of a word says of it: first or last in its post, in a post of ``order`` words or more; whether its own count,
# and that of the n-1 words from it on, have yet to be found.
FIRST, LAST, LONG, NO_WORD, NO_START = 1, 2, 4, 8, 16
# What is summed up for each post.
SUMS = {"words": "long", "_unigram": "double", "_order": "double"}


def _frequent_grams(posts: DataFrame, words: DataFrame, sizes: list[int], least: float) -> DataFrame:
    """``gram, count`` of the grams of some sizes that occur ``least`` times or more.

    All words of such a gram do, so only grams of these are counted.
    """
    frequent = words.where(F.col("_of_word") >= least).select("_word").toArrow().column(0).combine_chunks()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            known = s.among(frequent) >= 0
            for n in sizes:
                whole = known & (s.left >= n)
                for i in range(1, n):
                    whole[:-i] &= known[i:]
                found = s.joined(np.flatnonzero(whole), 0, n).value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["gram", "count"])

    counted = posts.mapInArrow(work, "gram string, count long")
    return counted.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def _waiting(shared, order: int, smoothing: float, vocabulary: int, tasks: int, schema: T.StructType):
    """Lists of the words whose counts are not all broadcast, by task, and for each post what the broadcast ones add.

    A word goes by the shortest beginning of its gram that is not frequent, with the words that follow it: of n-1 words
    in all (``_middle``) and of n (``_tail``). A post also gets what its words would add if all of it occurred once; so
    nothing comes back for what does.
    """
    once, once_below = np.log(1.0 + smoothing), np.log(1.0 + smoothing * vocabulary)
    sizes = [n for n in (order - 1, order) if n > 1]
    ends = dict(zip(sizes[::-1], ("_tail", "_middle")))
    fields = {field.name: field.dataType for field in schema.fields[1:]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts, firsts, lasts, grams, gram_counts = shared.value
        for s in _slices(batches):
            word = s.among(hot)
            known, reaching, long = word >= 0, s.left >= order, (s.at + s.left) >= order

            def of(table: np.ndarray, number: np.ndarray, added: float) -> np.ndarray:
                """Logarithm of the count of each number that is there, else 0."""
                with np.errstate(divide="ignore"):
                    return np.append(np.log(table + added), 0.0)[number]

            unigram, total = of(counts, word, 0.0), np.zeros(len(word))
            for edge, table in ((s.at == 0, firsts), (s.left == 1, lasts)):
                edge = np.flatnonzero(edge & long & s.there)
                total[edge] += np.where(known[edge], of(table, word[edge], smoothing), once)
            # The number of the gram of each size, as far as its first word is frequent.
            waits = np.where(s.there & ~known, 1, 0)
            number = {1: word}
            for n in sizes:
                number[n] = np.full(len(word), -1)
                places = np.flatnonzero(known & (s.left >= n))
                number[n][places] = pc.index_in(s.joined(places, 0, n), value_set=grams).fill_null(-1).to_numpy()
                waits[places] = np.where((waits[places] == 0) & (number[n][places] < 0), n, waits[places])
            if order > 1:
                below = number[order - 1]
                added = np.where(number[order] >= 0, of(gram_counts, number[order], smoothing), once)
                start = of(counts if order == 2 else gram_counts, below, smoothing * vocabulary)
                total += np.where(reaching & s.there, added - np.where(below >= 0, start, once_below), 0.0)
            else:
                below = word
            flags = ((s.at == 0) * FIRST + (s.left == 1) * LAST + long * LONG + ~known * NO_WORD + (below < 0) * NO_START).astype(np.int8)

            for n in (1, *sizes):
                places = np.flatnonzero(waits == n)
                if not len(places):
                    continue
                task = (s.hashes(places, n) % np.uint64(tasks)).astype(np.int32)
                # What is alike lies together, so it takes less room on its way.
                last = np.minimum(places + n - 1, len(word) - 1)
                by = np.argsort((task * np.int64(len(s.distinct)) + s.code[places]) * len(s.distinct) + s.code[last])
                places, task = places[by], task[by]
                sent, starts = np.unique(task, return_index=True)
                rest = {name: pc.if_else(pa.array(s.left[places] >= size), s.joined(places, n, size), None)
                        for size, name in ends.items()}
                yield block(sent, np.append(starts, len(places)), {
                    "key": s.keys.take(pa.array(s.owner[places])), "_by": s.joined(places, 0, n), "_flags": pa.array(flags[places]), **rest})
            sums = [np.bincount(s.owner, x, len(s.sizes)) for x in (s.there, unigram, total)]
            yield block(np.array([len(s.words) % tasks], np.int32), np.array([0, len(s.sizes)]), {
                "_post": s.keys, **{c: pa.array(x.astype(np.int64 if kind == "long" else np.float64)) for (c, kind), x in zip(SUMS.items(), sums)}})

    def block(sent: np.ndarray, starts: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        """A row for each task, with lists; what is not given is NULL."""
        lists = {c: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), x) for c, x in columns.items()}
        return pa.RecordBatch.from_arrays(
            [pa.array(sent), *[lists[c] if c in lists else pa.nulls(len(sent), to_arrow_type(kind)) for c, kind in fields.items()]],
            names=["_by_task", *fields])
    return work


def _sums_of_counts(smoothing: float, vocabulary: int):
    """What the counts found in a task add to the sums of each post.

    All rows of a ``_by`` are in one task: a word, or a gram that begins with frequent words.
    """
    def counted(codes: np.ndarray, there: np.ndarray) -> np.ndarray:
        """How often each row's code occurs among the rows that are there."""
        _, at = np.unique(codes, return_inverse=True)
        return np.bincount(at, there)[at]

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each value, and where there is one."""
        found = column.combine_chunks().dictionary_encode()
        return found.indices.fill_null(0).to_numpy().astype(np.int64), found.is_valid().to_numpy(zero_copy_only=False)

    def log(n: np.ndarray, use: np.ndarray, added: float = smoothing) -> np.ndarray:
        """What a count adds beyond a count of one."""
        return np.log(np.where(use, (n + added) / (1.0 + added), 1.0))

    def flat(batch: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(c).flatten() for c in columns], names=columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            whole = flat(batch, ["_post", *SUMS])
            if len(whole):
                yield whole.rename_columns(["key", *SUMS])
            waiting.append(flat(batch, [c for c in batch.schema.names if c not in ("_by_task", "_post", *SUMS)]))
        if not sum(len(b) for b in waiting):
            return
        rows = pa.Table.from_batches(waiting)
        flags = rows.column("_flags").to_numpy()
        by, _ = coded(rows.column("_by"))
        word = np.bincount(by)[by]
        has = {bit: flags & bit != 0 for bit in (FIRST, LAST, LONG, NO_WORD, NO_START)}
        unigram, order = log(word, has[NO_WORD], 0.0), np.zeros(len(by))
        for bit in (FIRST, LAST):
            times = np.bincount(by, has[bit])[by]
            order += log(times, has[bit] & has[LONG] & has[NO_WORD])
        if "_tail" in rows.column_names:
            tail, reaching = coded(rows.column("_tail"))
            order += log(counted(by * (tail.max() + 1) + tail, reaching), reaching)
            start = word
            if "_middle" in rows.column_names:
                middle, whole = coded(rows.column("_middle"))
                start = counted(by * (middle.max() + 1) + middle, whole)
            order -= log(start, reaching & has[NO_START], smoothing * vocabulary)
        more = (unigram != 0) | (order != 0)
        key = rows.column(0).combine_chunks().filter(pa.array(more)).dictionary_encode(null_encoding="encode")
        at, n = key.indices.to_numpy(), len(key.dictionary)
        yield pa.RecordBatch.from_arrays(
            [key.dictionary, pa.array(np.zeros(n, np.int64)), *[pa.array(np.bincount(at, x[more], n).astype(np.float64)) for x in (unigram, order)]],
            names=["key", *SUMS])
    return work


def score_posts(posts: DataFrame, key: str = "id", tokens: str = "tokens", order: int = 2,
                denominator: str = "distinct", smoothing: float = 0.0,
                limit: int = FREQUENT_LIMIT) -> DataFrame:
    """One row per post: ``key``, number of words, and the unigram and order-n scores and their logs.

    With ``order=1`` there are the unigram scores only.

    A row for each word, with the words behind it, goes once to the task where its word is counted; from there posts get
    sums of logarithms. Counts of frequent words and grams are broadcast: a row goes by the shortest beginning of its gram
    that is not frequent, or nowhere, so no task is dominated by one key. The posts should
    have been written; they are read several times. ``smoothing`` adds a constant to every count, and that constant times
    the vocabulary to every denominator.
    """
    name = {2: "bigram", 3: "trigram", 4: "quadgram", 5: "pentagram"}.get(order, f"gram{order}")
    spark = posts.sparkSession
    share_package(spark)
    slim = posts.select(F.col(key).alias("key"), F.col(tokens).alias("_tokens"))
    post_count = slim.agg(F.count(F.lit(1))).scalar()
    # Every post with an array, also one without words.
    slim = slim.where(F.size("_tokens") >= 0)
    word = gram_at(1, "_tokens").alias("_word")
    first, last = F.col("_at") == 0, F.col("_at") == F.size("_tokens") - 1
    counts = positions(slim, tokens="_tokens").groupBy(word).agg(
        F.count(F.lit(1)).alias("_of_word"), F.count_if(first).alias("_firsts"), F.count_if(last).alias("_lasts"))
    words = staged(counts.where(F.col("_word").isNotNull()), "word-counts")
    number, vocabulary = words.agg(F.coalesce(F.sum("_of_word"), F.lit(0)), F.count(F.lit(1))).first()
    whole = vocabulary if denominator == "distinct" else number

    hot = words.where(F.col("_of_word") * F.lit(limit) >= F.lit(number)).toArrow().combine_chunks()
    grams = spark.createDataFrame([], "gram string, count long")
    sizes = [n for n in (order - 1, order) if n > 1]
    if sizes:
        grams = _frequent_grams(slim, words, sizes, number / min(limit, GRAM_LIMIT))
    grams = grams.toArrow()

    def numbers(table: pa.Table, column: str) -> np.ndarray:
        return table.column(column).to_numpy().astype(np.float64)

    shared = spark.sparkContext.broadcast((
        hot.column("_word").combine_chunks(), *[numbers(hot, c) for c in ("_of_word", "_firsts", "_lasts")],
        grams.column("gram").combine_chunks(), numbers(grams, "count")))
    tails = ("_tail", "_middle")[:len(sizes)]
    of_key = slim.schema["key"].dataType.simpleString()
    kinds = {"key": of_key, "_by": "string", "_flags": "byte", **dict.fromkeys(tails, "string"), "_post": of_key, **SUMS}
    lists = T.StructType.fromDDL(", ".join(["_by_task int", *[f"{c} array<{kind}>" for c, kind in kinds.items()]]))
    tasks = max(spark.sparkContext.defaultParallelism, -(-number // WORDS_PER_TASK))
    away = slim.mapInArrow(_waiting(shared, order, float(smoothing), vocabulary, tasks, lists), lists)
    schema = T.StructType([slim.schema["key"], *T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in SUMS.items()))])
    there = away.repartitionById(tasks, F.col("_by_task")).mapInArrow(_sums_of_counts(float(smoothing), vocabulary), schema)
    # A task has summed up what it has of a post, so rows are sent as they are.
    sums = there.withColumnRenamed("key", key).repartition(F.col(f"`{key}`")).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in SUMS])
    of_words = F.col("_unigram") - F.col("words") * F.lit(float(np.log(max(whole, 1))))
    scores = {"unigram_log_prob": F.when(F.col("words") > 0, of_words).otherwise(F.lit(0.0))}
    plain = {"unigram_probability": F.exp("unigram_log_prob")}
    if order > 1:
        edges = 2 * F.ln(post_count.cast("double"))
        scores[f"{name}_log_prob"] = F.when(F.col("words") >= order, F.col("_order") - edges)
        plain[f"{name}_probability"] = F.coalesce(F.exp(f"{name}_log_prob"), F.lit(0.0))
    return sums.select(key, "words", *[score.alias(c) for c, score in scores.items()]).withColumns(plain)


def relative_probability(posts: DataFrame, key: str = "id", tokens: str = "tokens",
                         denominator: str = "distinct", limit: int = FREQUENT_LIMIT) -> DataFrame:
    """Mean relative frequency of each post's words, scaled so that all posts sum to 1."""
    slim = posts.select(F.col(key), F.col(tokens).alias("_tokens"))
    words = slim.select(key, F.explode("_tokens").alias("word")).where(F.col("word").isNotNull())
    words = staged(words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("times")), "post-words")
    counts = words.groupBy("word").agg(F.sum("times").alias("count"))
    whole = F.count_if(F.col("count") > 0) if denominator == "distinct" else F.sum("count")
    means = (
        lookup(words, counts, "word", "count", limit)
        .groupBy(key)
        .agg((F.sum(F.col("times") * F.col("count")) / F.sum("times") / counts.agg(whole).scalar()).alias("mean_rel_freq"))
    )
    empty = slim.where(F.size("_tokens") == 0).select(key, F.lit(0.0).alias("mean_rel_freq"))
    # Empty posts add nothing to the sum.
    whole_sum = means.agg(F.sum("mean_rel_freq")).scalar()
    return means.unionByName(empty).withColumn(
        "relative_probability", F.try_divide(F.col("mean_rel_freq"), whole_sum)
    )
