"""Quality rules: how far a document's characters and common words are from those of its language.

Two histograms of every text, one over classes of characters and one over common words of its language, are
compared with the language's own, summed over all its documents, by Jensen-Shannon distance (0 for equal
histograms, 1 for disjoint ones). A sample of n words from the reference itself has an expected squared distance
of about (bins - 1) / (8 n ln 2), which is taken off before a distance is judged; shorter texts than a least length
are not judged at all.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.llm.common import WHITE_SPACE, others, unpacked, words
from crowdtape.sources.staging import staged

# Runs of characters that are taken out of the text one class after the other; what stays is the last class.
CLASSES = {
    "lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "blank": WHITE_SPACE,
    "mark": r"[.,;:?!'\"()-]+", "sign": "[!-~]+",
}
SYMBOLS = "[#*$%&|<>]+"
# Between common words: white space and sentence marks.
WORD_ENDS = r"[\x20\x09-\x0D.,;:!?]+"
# Frequent function words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and in to a is that for it as with was on be by at this are or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
# A document fails if it is farther than this from its language after what chance alone would bring about is
# taken off; histograms of shorter texts are not judged.
FARTHEST_CLASSES, LEAST_CHARS = 0.22, 200
FARTHEST_WORDS, LEAST_WORDS = 0.24, 50
WINDOW = 8


def with_statistics(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                    common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """``docs`` without its text, with what the rules count in it, all in columns that begin with ``_``."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row")
    text, lang = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{lang_col}`").cast("string")
    out = docs.select(carried, lang.alias("_lang"), text.alias("_0"))
    for i, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"_{i + 1}", F.regexp_replace(f"_{i}", pattern, ""))
    last = len(CLASSES)
    left = {name: F.length(f"_{i}") - F.length(f"_{i + 1}") for i, name in enumerate(CLASSES)}
    lines = F.filter(F.split("_0", "\n"), lambda line: F.length(F.regexp_replace(line, WHITE_SPACE, "")) > 0)
    # The words of the language's list that occur, each time they do.
    spoken = F.filter(F.split(F.lower("_0"), WORD_ENDS), lambda w: w != "")
    out = out.select(
        "_row", "_lang", words(F.col("_0")).alias("_words"), lines.alias("_lines"), spoken.alias("_spoken"),
        F.array(*[n.cast("long") for n in left.values()], F.length(f"_{last}").cast("long")).alias("_classes"),
        (F.length("_0") - left["blank"]).cast("long").alias("_word_chars"),
        (F.length("_5") - F.length(F.regexp_replace("_5", SYMBOLS, ""))).cast("long").alias("_n_symbols"))
    # A list's words that the text holds, every time; first the few that are on the list, then each one's count.
    listed = reduce(lambda rest, lang: F.when(F.col("_lang") == lang, F.filter(
        "_spoken", lambda w: w.isin(common[lang]))).otherwise(rest), common, F.array().cast("array<string>"))
    out = out.withColumn("_listed", listed).withColumn(
        "_hashes", F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))))
    counts = reduce(lambda rest, lang: F.when(F.col("_lang") == lang, F.array(*[
        _count("_listed", w) for w in common[lang]])).otherwise(rest), common, F.array().cast("array<long>"))
    # Windows that occur twice or more, by their hashes: neighbours once these are sorted. Most texts have none.
    # Each array is a column of its own, since what a lambda closes over is computed again for each element.
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, k: (
        F.get("_sorted", k - 1)["h"].eqNullSafe(x["h"]) | F.get("_sorted", k + 1)["h"].eqNullSafe(x["h"]))),
        lambda x: x["i"])))
    return out.select(
        "_row", "_lang", "_classes", "_word_chars", "_n_symbols", F.size("_words").cast("long").alias("_n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.coalesce(_covered("_at"), F.lit(0)).cast("long").alias("_n_repeat_words"),
        F.concat(counts, F.array((F.size("_spoken") - F.size("_listed")).cast("long"))).alias("_common"))


def _count(listed: str, word: str) -> Column:
    return F.size(F.filter(listed, lambda x: x == word)).cast("long")


def _covered(at: str) -> Column:
    """Words in the windows that begin at sorted places."""
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def distance(mine: str, theirs: str, n: str, m: str) -> Column:
    """Jensen-Shannon distance of two histograms, arrays of counts whose sums are ``n`` and ``m``; NULL if one is 0.

    The sums are columns, since what a lambda closes over is computed again for each element.
    """
    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log(p * 2 / (p + q))).otherwise(F.lit(0.0))

    terms = F.zip_with(mine, theirs, lambda x, y: (
        term(x / F.col(n), y / F.col(m)) + term(y / F.col(m), x / F.col(n))))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / (2 * F.log(F.lit(2.0)))
    return F.when((F.col(n) > 0) & (F.col(m) > 0), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def beyond_chance(distance: Column, bins: Column, n: Column) -> Column:
    """A distance less what n words drawn from the reference would have on average."""
    chance = (bins - 1) / (F.lit(8.0) * F.log(F.lit(2.0)) * F.greatest(n, F.lit(1)))
    return F.sqrt(F.greatest(F.lit(0.0), distance * distance - chance))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          common: dict[str, list[str]] = COMMON_WORDS, farthest_classes: float = FARTHEST_CLASSES,
          least_chars: int = LEAST_CHARS, farthest_words: float = FARTHEST_WORDS,
          least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without its text, with the counts, both distances and the verdict of every row.

    Added, replacing columns of these names: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated windows),
    ``class_distance`` and ``word_distance`` (NULL where the text or the language has nothing to compare) and
    ``kept``. NULL and empty texts have no words and fail. Rows without language are compared with each other,
    and a language without a list of words by its characters only. Repeated rows count every time.
    """
    ours = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
            "word_distance", "kept"]
    free = set(others(docs, *ours))
    used = [c for c in docs.columns if c in free or c in (text_col, lang_col)]
    found = staged(with_statistics(docs.select(*[F.col(f"`{c}`") for c in used]), text_col, lang_col, common),
                   "text-statistics")
    longest = max(map(len, common.values()), default=0) + 1
    references = found.groupBy(F.col("_lang").alias("_of")).agg(
        F.array(*[F.sum(F.get("_classes", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("_all_classes"),
        F.filter(F.array(*[F.sum(F.get("_common", F.lit(i))) for i in range(longest)]),
                 lambda n: n.isNotNull()).alias("_all_common"))
    references = references.select("*", total("_all_classes").alias("_m_classes"), total("_all_common").alias("_m_common"))
    joined = found.select("*", total("_classes").alias("_n_classes"), total("_common").alias("_n_common")).join(
        references, F.col("_lang").eqNullSafe(F.col("_of")))
    compared = joined.select(
        "*", distance("_classes", "_all_classes", "_n_classes", "_m_classes").alias("_class_distance"),
        F.when(F.size("_common") > 1, distance("_common", "_all_common", "_n_common", "_m_common")).alias("_word_distance"))
    chars = F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    n = F.col("_n_words")
    far_classes = beyond_chance(F.col("_class_distance"), F.lit(len(CLASSES) + 1), n) > farthest_classes
    far_words = beyond_chance(F.col("_word_distance"), F.size("_common"), n) > farthest_words
    far = ((chars >= least_chars) & F.coalesce(far_classes, F.lit(False))) | (
        (n >= least_words) & F.coalesce(far_words, F.lit(False)))
    carried = unpacked([c for c in used if c != text_col and c in free])
    return compared.select(
        *carried, F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
        F.col("_class_distance").alias("class_distance"), F.col("_word_distance").alias("word_distance"),
        (~failed & ~far).alias("kept"))
