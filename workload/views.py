"""The test tables in the shapes the library works on, on both sides of the comparison."""

import os
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtape.functions import patterns
from crowdtape.functions.cleaning import clean_posts
from crowdtape.functions.emoji import EMOJI, character_name
from crowdtape.functions.words import stop_words
from crowdtape.sources.staging import staged
from crowdtape.sources.tables import spread
from workload.stems import STEMS


@dataclass(frozen=True)
class Query:
    """A query over the tables of a folder, and the same in SQL where SQL can say it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def with_ctes(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


# --- posts: a document is a post; the event with five times its number says when and by whom ---

def posts(spark: SparkSession, folder: str) -> DataFrame:
    documents, events = spread(table(spark, folder, "documents")), table(spark, folder, "events")
    return documents.join(events, events.event_id == documents.doc_id * 5, "left").select(
        F.col("doc_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("user"),
        F.col("lang").alias("group"),
        F.floor("value").cast("bigint").alias("favorite_count"),
        F.get_json_object("props", "$.k").cast("bigint").alias("retweet_count"),
        "source",
        "text",
    )


POSTS = """posts AS (
    SELECT d.doc_id AS id, e.ts AS created_at, e.event_type AS "user", d.lang AS "group",
        CAST(floor(e.value) AS BIGINT) AS favorite_count,
        CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS BIGINT) AS retweet_count, d.source, d.text
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 5)"""

# The users that become columns.
USERS = ["click", "error", "purchase", "signup", "view"]

# --- posts whose text also carries the entities that the documents lack ---

FACES = [chr(0x1F600 + i) for i in range(80)]


def face_of(number: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(FACES)), " "), F.pmod(number, F.lit(len(FACES))).cast("int"))


def tagged_posts(spark: SparkSession, folder: str) -> DataFrame:
    # Every third post has a gap in its hashtag, every fifth a second mention.
    number = F.col("id")
    gap = F.when(number % 3 == 0, F.lit(" # ")).otherwise(F.lit(" #"))
    second = F.when(number % 5 == 0, F.concat(F.lit(" @"), F.col("group"))).otherwise(F.lit(""))
    return posts(spark, folder).withColumn("text", F.concat(
        "text", gap, "group", F.lit(" @"), "source", second, F.lit(" https://x.example/"), number,
        F.lit(" www.news"), number, F.lit(".example "), face_of(number),
    ))


TAGGED = f"""tagged AS (
    SELECT * REPLACE (text || CASE WHEN id % 3 = 0 THEN ' # ' ELSE ' #' END || "group" || ' @' || source
        || CASE WHEN id % 5 = 0 THEN ' @' || "group" ELSE '' END || ' https://x.example/' || id
        || ' www.news' || id || '.example ' || chr(CAST({0x1F600} + id % {len(FACES)} AS INTEGER)) AS text)
    FROM posts)"""

FACE_NAMES = "[" + ", ".join(f"'{character_name(ord(face))}'" for face in FACES) + "]"

# --- clean words of the posts ---


def word_posts(spark: SparkSession, folder: str, stem: bool = False) -> DataFrame:
    return clean_posts(posts(spark, folder), stem=stem).select("id", "tokens")


def staged_words(spark: SparkSession, folder: str, stem: bool = False) -> DataFrame:
    return staged(word_posts(spark, folder, stem), "words")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(_quoted(word) for word in stop_words()) + "]"
_ASCII_PUNCTUATION = "[" + "".join("\\" + c for c in string.punctuation) + "]"


def words_sql(source: str, stop_list: str = STOP_LIST) -> str:
    """Clean words of a table's ``text``: the same steps, with the stop words taken out piece by piece."""
    return f"""list_filter(string_split_regex(regexp_replace(array_to_string(list_transform(
        regexp_extract_all(strip_accents(replace(replace(regexp_replace(regexp_replace(regexp_replace(
            lower(coalesce({source}.text, '')), {_quoted(patterns.ENTITY)}, '', 'g'),
            {_quoted(EMOJI)}, '', 'g'), {_quoted(_ASCII_PUNCTUATION)}, ' ', 'g'), 'ß', 'ss'), 'œ', 'oe')),
            '[{patterns.WORD}]+|[^{patterns.WORD}]+'),
        lambda piece: CASE WHEN list_contains({stop_list}, piece) THEN ' ' ELSE piece END), ''),
        '{patterns.SYMBOL}+', '', 'g'), '[{patterns.BLANK}]+'), lambda word: word <> '')"""


WORDS = f"words AS MATERIALIZED (SELECT id, {words_sql('posts')} AS words FROM posts)"


def words_ctes(stem: bool = False) -> list[str]:
    """CTEs that end in ``words``: each post's words, or the stems of them."""
    return [WORDS.replace("words AS", "plain AS", 1), *STEMS] if stem else [WORDS]



def grams_sql(n: int, columns: str = "id") -> str:
    return (
        f"SELECT {columns}, unnest(list_transform(range(1, len(words) - {n} + 2), "
        f"lambda i: array_to_string(words[i:i + {n} - 1], ' '))) AS gram FROM words"
    )
