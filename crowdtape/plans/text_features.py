"""From merged posts to market-time features per user."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdtape.functions.cleaning import clean_posts
from crowdtape.operators.buckets import bucket_sums, pivot_users
from crowdtape.operators.calendars import fill_openings, fill_steps
from crowdtape.operators.folds import fold_market_hours, fold_weekend_by_day, fold_weekend_by_time
from crowdtape.operators.ngrams import with_grams
from crowdtape.operators.probability import score_posts
from crowdtape.operators.scaling import logs_to_unit_sum, min_max
from crowdtape.sources.staging import staged

# Each probability's logarithm, which stays finite however long a post is.
LOGARITHMS = {"unigram_probability": "unigram_log_prob", "bigram_probability": "bigram_log_prob"}
PROBABILITIES = list(LOGARITHMS)
# The columns of n-grams and their n.
GRAMS = {"bigram": 2, "trigram": 3, "quadgram": 4, "pentagram": 5}
TOTALS = ["favorite_count", "retweet_count"]

# The bucket widths of the feature tables, and the offset of the hourly one.
WIDTHS = {
    "byhour": ("1 hour", "30 minutes"),
    "by_halfhour": ("30 minutes", None),
    "by_five_minutes": ("5 minutes", None),
    "by_minute": ("1 minute", None),
}


def scored_posts(posts: DataFrame, text: str = "text", **cleaning) -> DataFrame:
    """Posts with their date and probabilities.

    The text is cleaned once and the tokens are written; so are the scores, which every feature table
    reads more than once.
    """
    tokens = staged(clean_posts(posts.select("id", text), text, **cleaning).select("id", "tokens"), "tokens")
    scores = score_posts(tokens).select("id", *PROBABILITIES, *LOGARITHMS.values())
    scored = posts.drop(text).join(scores, "id").withColumn("date", F.to_date("created_at"))
    return staged(scored, "scored")


def cleaned_ngrams(posts: DataFrame, text: str = "text", **cleaning) -> DataFrame:
    """Posts with date, probabilities and a column of n-grams for each name in ``GRAMS``."""
    tokens = staged(clean_posts(posts.select("id", text), text, **cleaning).select("id", "tokens"), "tokens")
    # What was shuffled for the scores is gone before the words are shuffled.
    scores = staged(score_posts(tokens).select("id", *PROBABILITIES), "scores")
    # The n-grams are many times as large as the words they are made of, so they are made behind all joins. Words travel as
    # one text, which takes half the room of an array; only posts without words have the empty one.
    text_of = tokens.select("id", F.array_join("tokens", " ").alias("tokens"))
    joined = text_of.join(scores, "id").join(posts.drop(text), "id").withColumn("date", F.to_date("created_at"))
    words = F.when(F.col("tokens") != "", F.split("tokens", " ")).otherwise(F.array().cast("array<string>"))
    return with_grams(joined.withColumn("tokens", words), GRAMS).drop("tokens")


def scaled_posts(scored: DataFrame) -> DataFrame:
    """Probabilities scaled to sum 1, from their logarithms; counts scaled to the range 0..1."""
    return min_max(logs_to_unit_sum(scored, LOGARITHMS), TOTALS)


def daily_features(scaled: DataFrame, users: Sequence[str]) -> DataFrame:
    """Wide daily table, weekends summed into Monday."""
    wide = pivot_users(scaled, "date", PROBABILITIES, TOTALS, users)
    return fold_weekend_by_day(wide, wide.columns[1:], "date")


def intraday_features(scaled: DataFrame, users: Sequence[str], width: str = "byhour") -> DataFrame:
    """Wide table per bucket in New York market time, weekends and closed hours folded in."""
    step, offset = WIDTHS[width]
    sums = bucket_sums(scaled, PROBABILITIES + TOTALS, step, offset)
    wide = staged(pivot_users(sums, "created_at", PROBABILITIES, TOTALS, users), "pivot")
    filled = fill_steps(wide, 60) if width == "by_minute" else fill_openings(wide)
    measures = wide.columns[1:]
    return fold_market_hours(fold_weekend_by_time(filled, measures), measures)
