"""Counts of word pairs and long grams, whose words go as numbers between tasks, and numbers that stand for words throughout a job.

There are more pairs than words, and most of them are new however many posts were read, so rows of several words outgrow the
posts many times. A frequent word goes by its rank, which all tasks know; any other is sent once with each list that has it.
Nothing depends on which words are frequent but the room that lists take.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, functions as F

from crowdtape.operators.lookup import FREQUENT_LIMIT, most_frequent
from crowdtape.operators.slices import WORDS_PER_TASK, Slice, slices
from crowdtape.session import share_package
from crowdtape.sources.staging import Scope

# Pairs that one task counts, and rows of a batch of what it returns.
PAIRS_PER_TASK, _BATCH = 3 << 19, 1 << 16


def frequent_words(posts: DataFrame, tokens: str = "tokens", most: int = FREQUENT_LIMIT) -> tuple[pa.Array, int]:
    """The ``most`` frequent words, the most frequent first, and how many words there are in all."""
    words = posts.select(F.explode(tokens).alias("word")).where(F.col("word").isNotNull())
    with Scope(posts.sparkSession) as scope:
        counts = scope.staged(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
        number = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return most_frequent(counts, "word", "n", most).toArrow().column(0).combine_chunks(), number


# --- lists of numbers: the lower and the upper half of each, since the upper ones are nearly all alike ---

_HALVES = "array<short>"


def _halves(numbers: np.ndarray) -> tuple[pa.Array, pa.Array]:
    both = numbers.astype(np.uint32).view(np.int16).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _whole(low: pa.Array, high: pa.Array) -> np.ndarray:
    both = np.empty((len(low), 2), np.int16)
    both[:, 0], both[:, 1] = low.to_numpy(), high.to_numpy()
    return both.view(np.uint32)[:, 0].astype(np.int64)


class _Sender:
    """Numbers for the words of a slice: the rank of a frequent one, or behind these its place in its task's list."""

    def __init__(self, distinct: pa.Array, frequent: pa.Array) -> None:
        self._distinct, self._frequent = distinct, len(frequent)
        self.rank = pc.index_in(distinct, value_set=frequent).fill_null(-1).to_numpy().astype(np.int64)
        self.rare = self.rank < 0

    def numbers(self, task: np.ndarray, code: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """A number for each word by its code, and the list of other words for each of the tasks in ``sent``."""
        found = self.rank[code]
        rare = np.flatnonzero(self.rare[code])
        of_task, at = np.unique(task[rare].astype(np.int64) * len(self._distinct) + code[rare], return_inverse=True)
        tasks = of_task // max(len(self._distinct), 1)
        found[rare] = self._frequent + (np.arange(len(tasks)) - np.searchsorted(tasks, tasks))[at]
        starts = np.append(np.searchsorted(tasks, sent), len(tasks)).astype(np.int32)
        return found, pa.ListArray.from_arrays(pa.array(starts), self._distinct.take(pa.array(of_task % max(len(self._distinct), 1))))


class _Receiver:
    """The words of a task's lists: what frequent ones and those sent along are."""

    def __init__(self, frequent: pa.Array) -> None:
        self._frequent, self._sent, self._so_far = frequent, [], 0

    def numbers(self, numbers: np.ndarray, row: np.ndarray, words: pa.ListArray) -> np.ndarray:
        """Numbers that are told apart by row no more."""
        starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        moved = np.where(numbers < len(self._frequent), numbers, numbers + (starts[row] + self._so_far))
        self._sent.append(words.flatten())
        self._so_far += starts[-1]
        return moved

    def distinct(self, numbers: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
        """All words, and the numbers of them such that no word has two."""
        sent = pa.chunked_array(self._sent, pa.string()).combine_chunks().dictionary_encode()
        known = len(self._frequent)
        same = np.concatenate([np.arange(known), known + sent.indices.to_numpy().astype(np.int64)])
        return pa.concat_arrays([self._frequent.cast(pa.string()), sent.dictionary]), [same[x] for x in numbers]


# --- pairs ---

def _send_pairs(shared, tasks: int, apart: Sequence[int], ordered: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, WORDS_PER_TASK // 2):
            pa.default_memory_pool().release_unused()
            if not len(s.distinct):
                continue
            sender, many = _Sender(s.distinct, shared.value), len(s.distinct)
            mark = hash_array(s.distinct.to_numpy(zero_copy_only=False), categorize=False)
            keys = []
            for by in apart:
                at = np.flatnonzero(s.left > by)
                at = at[s.there[at] & s.there[at + by]]
                a, b = s.code[at], s.code[at + by]
                keys.append(a * many + b if ordered else np.minimum(a, b) * many + np.maximum(a, b))
            keys = np.concatenate(keys)
            keys, n = np.unique(keys, return_counts=True)
            a, b, n = (keys // many).astype(np.int32), (keys % many).astype(np.int32), n.astype(np.int32)
            del keys, at
            # Pairs of a word that is not frequent go by it, so a list has it but once. The sum, and the larger of two, are
            # the same in both orders, so both reach one task.
            rare_a, rare_b = sender.rare[a], sender.rare[b]
            mixed = np.maximum(np.where(rare_a, mark[a], 0), np.where(rare_b, mark[b], 0))
            mixed = np.where(rare_a | rare_b, mixed, (mark[a] * np.uint64(3) if ordered else mark[a]) + mark[b])
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            task = ((mixed >> np.uint64(20)) % np.uint64(tasks)).astype(np.int32)
            del mixed, rare_a, rare_b
            by = np.argsort(task, kind="stable")
            a, b, n, task = a[by], b[by], n[by], task[by]
            del by
            sent, starts = np.unique(task, return_index=True)
            numbers, words = sender.numbers(np.concatenate([task, task]), np.concatenate([a, b]), sent)
            ends = pa.array(np.append(starts, len(task)).astype(np.int32))
            columns = [*_halves(numbers[:len(a)]), *_halves(numbers[len(a):]), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent), *[pa.ListArray.from_arrays(ends, x) for x in columns], words],
                names=["_by_task", "a", "a_high", "b", "b_high", "n", "words"])
    return work


def _count_pairs(shared, ordered: bool, rows):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receiver, first, second, times = _Receiver(shared.value), [], [], []
        for batch in batches:
            lists = dict(zip(batch.schema.names, batch.columns))
            row = np.repeat(np.arange(len(batch)), np.diff(lists["a"].offsets.to_numpy()))
            flat = {c: x.flatten() for c, x in lists.items() if c not in ("_by_task", "words")}
            both = receiver.numbers(
                np.concatenate([_whole(flat["a"], flat["a_high"]), _whole(flat["b"], flat["b_high"])]), np.tile(row, 2), lists["words"])
            first.append(both[:len(row)])
            second.append(both[len(row):])
            times.append(flat["n"].to_numpy())
        if not sum(len(x) for x in first):
            return
        first, second, times = np.concatenate(first), np.concatenate(second), np.concatenate(times)
        words, (first, second) = receiver.distinct([first, second])
        key = first * len(words) + second if ordered else np.minimum(first, second) * len(words) + np.maximum(first, second)
        del batch, lists, row, flat, both, first, second, receiver
        by = np.argsort(key)
        key, times = key[by], times[by]
        del by
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, n = key[starts], np.add.reduceat(times, starts, dtype=np.int64)
        del times, starts
        yield from rows(words, key // len(words), key % len(words), n)
        del words, key, n
        pa.default_memory_pool().release_unused()
    return work


def _pairs(posts: DataFrame, tokens: str, apart: Sequence[int], ordered: bool, frequent: pa.Array, words: int, rows, schema: str,
           per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """What ``rows`` makes of the words of a task, and the numbers of both words and the count of each of its pairs."""
    spark = posts.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(frequent)
    tasks = max(spark.sparkContext.defaultParallelism, -(-words * len(apart) // per_task))
    slim = posts.where(F.size(tokens) > 1).select(F.lit(0).alias("key"), F.col(tokens).alias("_tokens"))
    lists = ", ".join(f"{c} {_HALVES}" for c in ("a", "a_high", "b", "b_high"))
    sent = slim.mapInArrow(_send_pairs(shared, tasks, apart, ordered), f"_by_task int, {lists}, n array<int>, words array<string>")
    return sent.repartitionById(tasks, F.col("_by_task")).mapInArrow(_count_pairs(shared, ordered, rows), schema)


def skipgram_counts(posts: DataFrame, skip: int, tokens: str = "tokens", most: int = FREQUENT_LIMIT,
                    per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """``gram, count``: pairs of words, joined by a blank, with at most ``skip`` words between them.

    The posts should have been written; they are read twice.
    """
    def rows(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), _BATCH):
            part = slice(at, at + _BATCH)
            gram = pc.binary_join_element_wise(words.take(pa.array(a[part])), words.take(pa.array(b[part])), " ")
            yield pa.RecordBatch.from_arrays([gram, pa.array(n[part])], names=["gram", "count"])

    frequent, number = frequent_words(posts, tokens, most)
    return _pairs(posts, tokens, range(1, skip + 2), True, frequent, number, rows, "gram string, count long", per_task)


# --- grams of three words and more: stretches of posts whose grams have the same rarest word go to one task ---

def _stretches(s: Slice, rank: np.ndarray, mark: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where stretches begin, how many words each has, and the mark of the rarest word of all its grams.

    Each gram of n words is in one stretch. What is rarest depends on the words alone, so a gram has the same wherever it stands.
    """
    begins = np.flatnonzero(s.left >= n)
    for i in range(n):
        begins = begins[s.there[begins + i]]
    if not len(begins):
        return begins, begins, np.zeros(0, np.uint64)
    # Words in one order for all tasks: frequent ones by rank, others behind them by mark; what ties here goes to one task.
    order = np.where(rank < 0, np.uint64(1 << 62) + (mark >> np.uint64(2)), np.maximum(rank, 0).astype(np.uint64))[s.code]
    best, at = order[begins], begins.copy()
    for i in range(1, n):
        later = order[begins + i] >= best
        best, at = np.where(later, order[begins + i], best), np.where(later, begins + i, at)
    new = np.append(True, (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1))
    first = np.flatnonzero(new)
    return begins[first], np.diff(np.append(first, len(begins))) + n - 1, mark[s.code[at[first]]]


def _alike(code: np.ndarray, mark: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of stretch, and how many there are of it."""
    owner, within = _spread(sizes)
    place = begins[owner] + within
    mixed = (mark[code[place]] + within.astype(np.uint64)) * (2 * within.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    hashed = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.cumsum(sizes) - sizes) if len(sizes) else mixed
    _, first, kind = np.unique(hashed, return_index=True, return_inverse=True)
    like = first[kind]
    # A stretch that only shares the hash of another stays as it is.
    same = sizes == sizes[like]
    compared = same[owner]
    differs = np.zeros(len(begins), bool)
    differs[owner[compared][code[place[compared]] != code[(begins[like[owner]] + within)[compared]]]] = True
    like = np.where(same & ~differs, like, np.arange(len(begins)))
    return np.unique(like, return_counts=True)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of stretches one after the other: its stretch and its place there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _send_stretches(shared, tasks: int, n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            pa.default_memory_pool().release_unused()
            if not len(s.distinct):
                continue
            sender = _Sender(s.distinct, shared.value)
            mark = hash_array(s.distinct.to_numpy(zero_copy_only=False), categorize=False)
            begins, sizes, rarest = _stretches(s, sender.rank, mark, n)
            some, times = _alike(s.code, mark, begins, sizes)
            begins, sizes, rarest = begins[some], sizes[some], rarest[some]
            task = ((rarest >> np.uint64(20)) % np.uint64(tasks)).astype(np.int32)
            by = np.argsort(task, kind="stable")
            begins, sizes, times, task = begins[by], sizes[by], times[by], task[by]
            sent, starts = np.unique(task, return_index=True)
            owner, within = _spread(sizes)
            numbers, words = sender.numbers(task[owner], s.code[begins[owner] + within], sent)
            ends = np.append(starts, len(task)).astype(np.int32)
            of_words = pa.array(np.append(0, np.cumsum(sizes))[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent), *[pa.ListArray.from_arrays(of_words, x) for x in _halves(numbers)],
                 *[pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (sizes, times)], words],
                names=["_by_task", "a", "a_high", "size", "n", "words"])
    return work


def _count_stretches(shared, n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receiver, codes, sizes, times = _Receiver(shared.value), [], [], []
        for batch in batches:
            lists = dict(zip(batch.schema.names, batch.columns))
            row = np.repeat(np.arange(len(batch)), np.diff(lists["a"].offsets.to_numpy()))
            codes.append(receiver.numbers(_whole(lists["a"].flatten(), lists["a_high"].flatten()), row, lists["words"]))
            sizes.append(lists["size"].flatten().to_numpy())
            times.append(lists["n"].flatten().to_numpy())
        if not sum(len(x) for x in sizes):
            return
        words, (code,) = receiver.distinct([np.concatenate(codes)])
        sizes, times = np.concatenate(sizes).astype(np.int64), np.concatenate(times).astype(np.int64)
        owner, within = _spread(sizes)
        begins = np.flatnonzero(sizes[owner] - within >= n)
        mixed = np.zeros(len(begins), np.uint64)
        for i in range(n):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[begins + i].astype(np.uint64)
        _, first, gram = np.unique(mixed, return_index=True, return_inverse=True)
        if any((code[begins + i] != code[begins[first[gram]] + i]).any() for i in range(n)):
            # Two grams share a hash: they get dense numbers by one more word at a time instead.
            gram = code[begins]
            for i in range(1, n):
                _, first, gram = np.unique(gram * len(words) + code[begins + i], return_index=True, return_inverse=True)
        count = np.bincount(gram, times[owner[begins]]).astype(np.int64)
        # In the order of the posts neighbours share their words, so they take less room where they are written.
        by = np.argsort(first)
        first, count = first[by], count[by]
        for at in range(0, len(first), _BATCH):
            there = begins[first[at:at + _BATCH]]
            parts = [words.take(pa.array(code[there + i])) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(*parts, " "), pa.array(count[at:at + _BATCH])], names=["gram", "count"])
    return work


def long_gram_counts(posts: DataFrame, n: int, tokens: str = "tokens", most: int = FREQUENT_LIMIT,
                     per_task: int = WORDS_PER_TASK) -> DataFrame:
    """``gram, count`` of the grams of n words, joined by a blank.

    A gram goes to the task of its rarest word. Neighbours mostly share it, so they go as one stretch of words, some two words
    a gram in place of n; stretches that come again in a slice go once. The posts should have been written; they are read
    twice. Words are not NULL.
    """
    spark = posts.sparkSession
    share_package(spark)
    frequent, number = frequent_words(posts, tokens, most)
    shared = spark.sparkContext.broadcast(frequent)
    tasks = max(spark.sparkContext.defaultParallelism, -(-number // per_task))
    slim = posts.where(F.size(tokens) >= n).select(F.lit(0).alias("key"), F.col(tokens).alias("_tokens"))
    sent = slim.mapInArrow(_send_stretches(shared, tasks, n), f"_by_task int, a {_HALVES}, a_high {_HALVES}, size array<int>, n array<int>, words array<string>")
    return sent.repartitionById(tasks, F.col("_by_task")).mapInArrow(_count_stretches(shared, n), "gram string, count long")


# --- numbers that stand for words throughout a job ---

def _marks(words: pa.Array, frequent: pa.Array, salt: int) -> np.ndarray:
    """The rank of a frequent word, a hash of any other."""
    rank = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy().astype(np.int64)
    rare = np.flatnonzero(rank < 0)
    hashed = hash_array(words.take(pa.array(rare)).to_numpy(zero_copy_only=False), hash_key=f"{salt:016d}", categorize=False)
    rank[rare] = len(frequent) + (hashed >> np.uint64(2)).astype(np.int64)
    return rank


def numbered_pair_counts(posts: DataFrame, window: int, scope: Scope, tokens: str = "tokens", most: int = FREQUENT_LIMIT,
                         per_task: int = PAIRS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """``word, context, n`` once for each pair of words at most ``window`` places apart, and ``number, word`` of all words.

    Words are numbers in the first table, ``word`` the lower one; a word is with itself as often as it meets itself.
    A rare word's number is a hash, with another salt where two words of these posts share one. The posts should have been written.
    """
    spark = posts.sparkSession
    frequent, number = frequent_words(posts, tokens, most)
    shared = spark.sparkContext.broadcast(frequent)
    words = posts.select(F.explode(tokens).alias("word")).where(F.col("word").isNotNull()).distinct()

    def numbers(salt: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = pa.array(_marks(batch.column(0), shared.value, salt))
                yield pa.RecordBatch.from_arrays([marks, batch.column(0)], names=["number", "word"])
        return work

    share_package(spark)
    salt, words = 0, scope.staged(words, "words")
    while True:
        numbered = scope.staged(words.mapInArrow(numbers(salt), "number long, word string"), "numbers")
        if not numbered.groupBy("number").agg(F.count(F.lit(1)).alias("words")).where("words > 1").take(1):
            break
        salt += 1

    def rows(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        marks = np.arange(len(words))
        marks[len(frequent):] = _marks(words.slice(len(frequent)), frequent, salt)
        low, high = np.minimum(marks[a], marks[b]), np.maximum(marks[a], marks[b])
        # Sorted, a column of lower numbers takes next to no room where it is written.
        by = np.lexsort((high, low))
        for at in range(0, len(by), _BATCH):
            part = by[at:at + _BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (low, high, n)], names=["word", "context", "n"])

    counted = _pairs(posts, tokens, range(1, window + 1), False, frequent, number, rows, "word long, context long, n long", per_task)
    return scope.staged(counted, "pair-counts"), numbered


def pair_counts(posts: DataFrame, window: int, tokens: str = "tokens", most: int = FREQUENT_LIMIT,
                per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """``word, context, n`` once for each pair of words at most ``window`` places apart."""
    def rows(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), _BATCH):
            part = slice(at, at + _BATCH)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(a[part])), words.take(pa.array(b[part])), pa.array(n[part])], names=["word", "context", "n"])

    frequent, number = frequent_words(posts, tokens, most)
    return _pairs(posts, tokens, range(1, window + 1), False, frequent, number, rows, "word string, context string, n long", per_task)
