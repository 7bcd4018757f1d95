"""Entities in post text: hashtags, user names, links, emoji, ids and counts."""

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.functions import patterns
from crowdtape.functions.emoji import emoji_names, extract_emoji


def find_all(text: Column, pattern: str) -> Column:
    """All matches as an array; NULL text stays NULL."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def joined(matches: Column) -> Column:
    return F.trim(F.array_join(matches, " "))


def hashtags(text: Column, allow_gap: bool = False) -> Column:
    """Hashtags; with ``allow_gap`` also those with blanks between ``#`` and the word."""
    return find_all(text, patterns.SPACED_HASHTAG if allow_gap else patterns.HASHTAG)


def usernames(text: Column) -> Column:
    return find_all(text, patterns.USERNAME)


def links(text: Column, strict: bool = False) -> Column:
    """Links: anything after ``http`` or ``www``, or with ``strict`` only well-formed addresses."""
    return find_all(text, patterns.STRICT_LINK if strict else patterns.LOOSE_LINK)


def extend_posts(posts: DataFrame, text: str = "text", emoji_source: str | None = None,
                 strict: bool = True, allow_gap: bool = True) -> DataFrame:
    """Add every entity column in one projection and put the text third."""
    source = F.col(text)
    # Found once, in a column of their own, and used twice.
    found = F.col("_emoji")
    extended = posts.withColumn("_emoji", extract_emoji(F.col(emoji_source or text))).withColumns({
        "hashtags": joined(hashtags(source, allow_gap)),
        "links": joined(links(source, strict)),
        "usernames": joined(usernames(source)),
        "emojis": F.array_join(found, " "),
        "emoji_text": F.array_join(emoji_names(found), " "),
    }).drop("_emoji")
    rest = [c for c in extended.columns if c != text]
    return extended.select(*rest[:2], text, *rest[2:])


def permalink(prefix: str, post_id: Column) -> Column:
    return F.concat(F.lit(prefix), post_id.cast("string"))


# Fixed value: the number of digits of a current post id.
POST_ID_LENGTH = 19


def post_id_of(href: Column) -> Column:
    """Id at the end of a permalink, NULL for links that lead elsewhere."""
    tail = F.element_at(F.split(href, "/"), -1)
    return F.when(F.length(tail) >= POST_ID_LENGTH, tail.try_cast("bigint"))


# Metric -> the words that announce it.
METRIC_WORDS = {
    "replies": ("reply", "replies"),
    "retweets": ("Retweets", "Retweet"),
    "likes": ("like", "likes"),
    "views": ("views", "view"),
}


def metric_counts(label: Column) -> dict[str, Column]:
    """Counts named in a label such as ``3 replies, 5 Retweets, 9 likes, 70 views``.

    Numbers and words are paired in order, the last pair of a metric wins, and an absent metric is 0.
    Commas inside a number are grouping marks.
    """
    plain = F.regexp_replace(label, r"(?<=\p{Nd}),(?=\p{Nd})", "")
    pairs = F.arrays_zip(
        F.regexp_extract_all(plain, F.lit(r"\p{Nd}+"), F.lit(0)).alias("number"),
        F.regexp_extract_all(plain, F.lit("[a-zA-Z]+"), F.lit(0)).alias("word"),
    )

    def count_of(words: tuple[str, ...]) -> Column:
        hits = F.filter(pairs, lambda p: p["word"].isin(*words) & p["number"].isNotNull())
        return F.coalesce(F.get(F.reverse(hits), F.lit(0))["number"].cast("bigint"), F.lit(0).cast("bigint"))

    return {metric: count_of(words) for metric, words in METRIC_WORDS.items()}
