"""n-grams of token arrays and how often they occur."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.operators.coded import long_gram_counts
from crowdtape.operators.slices import WORDS_PER_TASK

# From so many words on, grams hardly repeat within a task, so stretches of posts are dealt out instead.
_RARELY_REPEATED = 3


def words_in(posts: DataFrame, tokens: str = "tokens") -> int:
    """How many words all posts have."""
    return posts.agg(F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0))), F.lit(0))).first()[0]


def _tasks_for(posts: DataFrame, words: int, per_task: int) -> int:
    return max(posts.sparkSession.sparkContext.defaultParallelism, -(-words // per_task))


def in_tasks(posts: DataFrame, *by: str, tokens: str = "tokens", words: int | None = None,
             per_task: int = WORDS_PER_TASK) -> DataFrame:
    """The posts dealt out, by a key or in turn, so that a task unrolls about ``per_task`` words however many there are.

    They are read to count their words where ``words`` does not say that, so they should have been written.
    """
    words = words_in(posts, tokens) if words is None else words
    return posts.repartition(_tasks_for(posts, words, per_task), *by)


def positions(posts: DataFrame, *columns: str, tokens: str = "tokens") -> DataFrame:
    """``columns``, ``tokens`` and ``_at``: a row for each word of each post."""
    some = posts.where(F.size(tokens) > 0)
    return some.select(*columns, tokens, F.explode(F.sequence(F.lit(0), F.size(tokens) - 1)).alias("_at"))


def gram_at(n: int, tokens: str = "tokens", ahead: int = 0) -> Column:
    """The n words from ``_at`` on, joined by a blank."""
    if n == 1:
        return F.get(tokens, F.col("_at") + ahead)
    return F.concat_ws(" ", *[F.get(tokens, F.col("_at") + ahead + i) for i in range(n)])


def _shifted(tokens: Column, by: int, length: Column) -> Column:
    return F.slice(tokens, by + 1, length)


def grams_of(tokens: Column, n: int) -> Column:
    """Array of the n-grams of one token array, words joined by a blank; short arrays give none.

    The array is laid beside itself n times, each copy one word further on, so the work is in
    proportion to its length.
    """
    if n == 1:
        return tokens
    length = F.size(tokens) - (n - 1)
    names = [f"w{i}" for i in range(n)]
    beside = F.arrays_zip(*[_shifted(tokens, i, length).alias(names[i]) for i in range(n)])
    grams = F.transform(beside, lambda words: F.concat_ws(" ", *[words[name] for name in names]))
    return F.when(length > 0, grams).otherwise(F.array().cast("array<string>"))


def skipgrams_of(tokens: Column, skip: int) -> Column:
    """Word pairs with at most ``skip`` words between them; ``skip=0`` gives the bigrams."""
    def pairs(apart: int) -> Column:
        length = F.size(tokens) - apart
        both = F.zip_with(
            _shifted(tokens, 0, length), _shifted(tokens, apart, length),
            lambda first, second: F.concat_ws(" ", first, second),
        )
        return F.when(length > 0, both).otherwise(F.array().cast("array<string>"))

    return F.concat(*[pairs(apart) for apart in range(1, skip + 2)])


def with_grams(posts: DataFrame, names: dict[str, int], tokens: str = "tokens") -> DataFrame:
    """Add a column of n-grams for each name -> n."""
    return posts.withColumns({name: grams_of(F.col(tokens), n) for name, n in names.items()})


def gram_counts(posts: DataFrame, sizes: Sequence[int] = (1,), tokens: str = "tokens",
                per_task: int = WORDS_PER_TASK) -> DataFrame:
    """``n, gram, count`` over all posts, which are read more than once; words hold no blanks.

    Single words and pairs are counted within tasks first. Longer grams hardly repeat there: they go in stretches of posts
    to the tasks that count them. Several sizes are sent as one: every word with those that follow it,
    dealt out by its first two words, so that grams of all sizes from 2 on are counted where they are.
    """
    sizes = sorted(set(sizes))
    words = words_in(posts, tokens)
    parts = _tasks_for(posts, words, per_task)

    def grams(n: int, source: DataFrame) -> DataFrame:
        reaching = positions(source, tokens=tokens).where(F.size(tokens) - F.col("_at") >= n)
        return reaching.select(F.lit(n).alias("n"), gram_at(n, tokens).alias("gram"))

    if sizes[0] == 1 or len(sizes) == 1:
        n, sizes = sizes[0], sizes[1:]
        if n < _RARELY_REPEATED:
            dealt = in_tasks(posts.select(tokens), tokens=tokens, words=words, per_task=per_task) if n > 1 else posts
            first = grams(n, dealt).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("count"))
        else:
            first = long_gram_counts(posts, n, tokens, per_task=per_task).select(F.lit(n).alias("n"), "gram", "count")
        return first.unionByName(gram_counts(posts, sizes, tokens, per_task)) if sizes else first

    left = F.size(tokens) - F.col("_at")
    ahead = F.array_join(F.slice(tokens, F.col("_at") + 3, sizes[-1] - 2), " ")
    dealt = positions(posts, tokens=tokens).where(left >= sizes[0]).select(
        gram_at(1, tokens).alias("_a"), gram_at(1, tokens, ahead=1).alias("_b"), ahead.alias("_ahead"),
        F.least(left, F.lit(sizes[-1])).alias("_left")).repartition(parts, "_a", "_b")
    cut = F.array(*[
        F.struct(F.lit(n).alias("n"), F.when(F.col("_left") >= n, F.substring_index("_ahead", " ", n - 2)).alias("_rest"))
        for n in sizes])
    counted = dealt.select("_a", "_b", F.inline(cut)).where(F.col("_rest").isNotNull()).groupBy("_a", "_b", "n", "_rest")
    rest = F.when(F.col("_rest") != "", F.col("_rest"))
    return counted.agg(F.count(F.lit(1)).alias("count")).select("n", F.concat_ws(" ", "_a", "_b", rest).alias("gram"), "count")


def gram_frequency(posts: DataFrame, sizes: Sequence[int] = (1,), tokens: str = "tokens",
                   denominator: str = "distinct") -> DataFrame:
    """``n, gram, count, rel_freq``; relative to the distinct grams of the size, or to all ("total")."""
    counts = gram_counts(posts, sizes, tokens)
    # Both totals read the count, so this branch reuses the shuffle of the counts.
    whole = F.count_if(F.col("count") > 0) if denominator == "distinct" else F.sum("count")
    totals = counts.groupBy("n").agg(whole.alias("_whole"))  # one row per size
    return counts.join(F.broadcast(totals), "n").select(
        "n", "gram", "count", (F.col("count") / F.col("_whole")).alias("rel_freq")
    )


def edge_word_counts(posts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``word, first_count, last_count``: how many posts begin and end with each word."""
    edges = posts.where(F.size(tokens) > 0).select(
        F.inline(F.array(
            F.struct(F.get(F.col(tokens), F.lit(0)).alias("word"), F.lit(1).alias("f"), F.lit(0).alias("l")),
            F.struct(F.element_at(tokens, -1).alias("word"), F.lit(0).alias("f"), F.lit(1).alias("l")),
        ))
    )
    return edges.groupBy("word").agg(F.sum("f").alias("first_count"), F.sum("l").alias("last_count"))
