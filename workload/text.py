"""Queries on post text, n-grams and probabilities."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.functions import entities, markup, patterns
from crowdtape.functions.cleaning import chunk_text, clean_posts, with_clean_text, with_words
from crowdtape.functions.emoji import EMOJI, emoji_names, extract_emoji
from crowdtape.operators import coded, ngrams, probability
from crowdtape.plans import text_features
from workload.views import (
    FACE_NAMES, POSTS, STOP_LIST, TAGGED, WORDS, Query, grams_sql, posts, staged_words, table, tagged_posts,
    with_ctes, word_posts, words_ctes, words_sql,
)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_posts(posts(spark, folder), stem=False)
    return with_clean_text(cleaned).select("id", "cleaned_nonstem_text")


def _stop_words(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = with_words(with_words(posts(spark, folder), name="every", words_to_remove=[]), name="kept")
    return cleaned.select("id", F.size("every").alias("all_words"), F.size("kept").alias("kept_words"))


def _stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return with_clean_text(clean_posts(posts(spark, folder))).select(
        "id", "cleaned_stem_text", "cleaned_nonstem_text"
    )


def _glued(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_posts(posts(spark, folder), glue=True, stem=False)
    return with_clean_text(cleaned).select("id", "cleaned_nonstem_text")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    extended = entities.extend_posts(tagged_posts(spark, folder))
    return extended.select(
        "id", "hashtags", "usernames", "links", "emojis",
        entities.joined(entities.hashtags(text)).alias("plain_hashtags"),
        entities.joined(entities.links(text)).alias("loose_links"),
        entities.permalink("https://x.example/status/", F.col("id")).alias("url"),
    )


_SQL_LINK = r"https?://(?:www\.)?[a-zA-Z0-9-]+\.[^\s]{2,}|www\.[a-zA-Z0-9-]+\.[^\s]{2,}"


def _found(pattern: str) -> str:
    return f"trim(array_to_string(regexp_extract_all(text, '{pattern}'), ' '))"


_ENTITIES_SQL = with_ctes(f"""
    SELECT id, {_found(patterns.SPACED_HASHTAG)} AS hashtags, {_found(patterns.USERNAME)} AS usernames,
        {_found(_SQL_LINK)} AS links, {_found(EMOJI)} AS emojis, {_found(patterns.HASHTAG)} AS plain_hashtags,
        {_found(patterns.LOOSE_LINK)} AS loose_links, 'https://x.example/status/' || id AS url
    FROM tagged""", POSTS, TAGGED)


def _emoji_names(spark: SparkSession, folder: str) -> DataFrame:
    names = emoji_names(extract_emoji(F.col("text")))
    return tagged_posts(spark, folder).select("id", F.array_join(names, " ").alias("emoji_text"))


_EMOJI_SQL = with_ctes(f"""
    SELECT id, {FACE_NAMES}[id % 80 + 1] AS emoji_text FROM tagged""", POSTS, TAGGED)


def _metric_labels(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id")
    label = F.concat(
        F.col("user_id"), F.when(F.col("user_id") == 1, " reply, ").otherwise(" replies, "),
        F.when(number % 2 == 0, F.concat(F.floor("value"), F.lit(" Retweets, "))).otherwise(""),
        F.format_number(number * 1000, 0), F.lit(" likes, "), number, F.lit(" views"),
    )
    return table(spark, folder, "events").select("event_id", *[
        count.alias(metric) for metric, count in entities.metric_counts(label).items()
    ])


_METRIC_SQL = """
    SELECT event_id, user_id AS replies,
        CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS retweets,
        event_id * 1000 AS likes, event_id AS views
    FROM events"""

_FIRST_ID = 1681508122635000000


def _permalinks(spark: SparkSession, folder: str) -> DataFrame:
    href = F.concat(
        F.lit("https://x.example/"), "event_type", F.lit("/status/"), F.col("event_id") + _FIRST_ID,
        F.when(F.col("event_id") % 3 == 0, "/photo/1").otherwise(""),
    )
    return table(spark, folder, "events").select("event_id", entities.post_id_of(href).alias("id"))


_PERMALINK_SQL = f"""
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id + {_FIRST_ID} END AS id FROM events"""


def _page_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", F.posexplode(markup.hrefs(F.col("html"))).alias("pos", "href")
    )


_PAGE_LINKS_SQL = r"""
    SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS href
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1) AS l FROM pages)"""


def _page_text(spark: SparkSession, folder: str) -> DataFrame:
    html = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id", markup.visible_text(html).alias("text"),
        F.array_join(markup.picture_labels(html), " ").alias("picture_labels"),
        F.size(markup.times(html)).alias("times"),
    )


_PAGE_TEXT_SQL = r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(html,
            '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'),
        '&amp(;|([^A-Za-z0-9;])|$)', '&\2', 'g'),
        '\s+', ' ', 'g')) AS text,
        array_to_string(regexp_extract_all(html, '(?is)<img\b[^>]*?\balt="([^"]*)"', 1), ' ') AS picture_labels,
        CAST(len(regexp_extract_all(html, '(?is)<time\b[^>]*?\bdatetime="([^"]*)"', 1)) AS INTEGER) AS times
    FROM pages"""

_CHUNK = 512


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(chunk_text(F.col("text"), _CHUNK)).alias("chunk", "piece")
    )


_CHUNKS_SQL = f"""
    SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * {_CHUNK} + 1 AS BIGINT), {_CHUNK}) AS piece
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {_CHUNK}.0) AS BIGINT))) AS i FROM documents)"""


def _frequency(n: int, stem: bool = False):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        frequency = ngrams.gram_frequency(staged_words(spark, folder, stem), [n])
        return frequency.withColumn("rel_freq", F.round("rel_freq", 10))
    return run


def _frequency_sql(n: int, stem: bool = False) -> str:
    return with_ctes(f"""
        SELECT {n} AS n, gram, count(*) AS count,
            round(count(*) / CAST((SELECT count(DISTINCT gram) FROM grams) AS DOUBLE), 10) AS rel_freq
        FROM grams GROUP BY gram""", POSTS, *words_ctes(stem), f"grams AS ({grams_sql(n)})")


def _all_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Every size in one pass, relative to all grams of the size, and what is frequent in each."""
    frequency = ngrams.gram_frequency(staged_words(spark, folder), [1, 2, 3, 4, 5], denominator="total")
    return frequency.groupBy("n").agg(
        F.count(F.lit(1)).alias("distinct_grams"), F.sum("count").alias("grams"),
        F.max("count").alias("largest"), F.round(F.sum("rel_freq"), 6).alias("whole"),
    )


_ALL_SIZES_SQL = with_ctes(
    " UNION ALL ".join(f"""
        SELECT {n} AS n, count(*) AS distinct_grams, CAST(sum(c) AS BIGINT) AS grams, max(c) AS largest,
            round(1.0, 6) :: DOUBLE AS whole
        FROM (SELECT gram, count(*) AS c FROM ({grams_sql(n)}) GROUP BY gram)""" for n in range(1, 6)),
    POSTS, WORDS)


def _cleaned_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """The n-gram columns as text."""
    table_ = text_features.cleaned_ngrams(posts(spark, folder), stem=False)
    return table_.select("id", "date", *[F.array_join(name, "|").alias(name) for name in text_features.GRAMS],
                         F.round("bigram_probability", 9).alias("bigram_probability"))


def _cleaned_ngrams_sql() -> str:
    grams = ", ".join(
        f"array_to_string(list_transform(range(1, len(w.words) - {n} + 2), lambda i: array_to_string(w.words[i:i + {n} - 1], ' ')), '|') AS {name}"
        for name, n in text_features.GRAMS.items())
    return with_ctes(f"""
        SELECT w.id, CAST(p.created_at AS DATE) AS date, {grams}, s.bigram_probability
        FROM words w JOIN posts p USING (id) JOIN ({_order_n_sql(2, 0.0)}) s USING (id)""", POSTS, WORDS)


def _edge_words(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.edge_word_counts(word_posts(spark, folder))


_EDGE_SQL = with_ctes("""
    SELECT word, CAST(sum(f) AS BIGINT) AS first_count, CAST(sum(l) AS BIGINT) AS last_count FROM (
        SELECT words[1] AS word, 1 AS f, 0 AS l FROM words WHERE len(words) > 0
        UNION ALL SELECT words[len(words)], 0, 1 FROM words WHERE len(words) > 0)
    GROUP BY word""", POSTS, WORDS)


def _skipgrams(spark: SparkSession, folder: str) -> DataFrame:
    return coded.skipgram_counts(staged_words(spark, folder), 2)


_SKIPGRAMS_SQL = with_ctes(
    "SELECT gram, count(*) AS count FROM (" + " UNION ALL ".join(
        f"SELECT unnest(list_transform(range(1, len(words) - {gap} + 1), "
        f"lambda i: words[i] || ' ' || words[i + {gap}])) AS gram FROM words" for gap in (1, 2, 3)
    ) + ") GROUP BY gram", POSTS, WORDS)


def _unigram(stem: bool = False):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        scores = probability.score_posts(staged_words(spark, folder, stem), order=1)
        return scores.select(
            "id", "words", F.round("unigram_log_prob", 3).alias("unigram_log_prob"),
            F.round("unigram_probability", 9).alias("unigram_probability"),
        )
    return run


_COUNTS1 = f"c1 AS (SELECT gram, count(*) AS c FROM ({grams_sql(1)}) GROUP BY gram)"

def _unigram_sql(stem: bool = False) -> str:
    return with_ctes("""
    SELECT w.id, len(w.words) AS words, round(coalesce(s.log_prob, 0.0), 3) AS unigram_log_prob,
        round(exp(coalesce(s.log_prob, 0.0)), 9) AS unigram_probability
    FROM words w LEFT JOIN (
        SELECT g.id, sum(ln(c1.c / CAST((SELECT count(*) FROM c1) AS DOUBLE))) AS log_prob
        FROM (SELECT id, unnest(words) AS gram FROM words) g JOIN c1 USING (gram) GROUP BY g.id
    ) s USING (id)""", POSTS, *words_ctes(stem), _COUNTS1)


def _order_n(order: int, smoothing: float, stem: bool = False):
    name = {2: "bigram", 3: "trigram"}[order]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        scores = probability.score_posts(staged_words(spark, folder, stem), order=order, smoothing=smoothing)
        return scores.select(
            "id", F.round(f"{name}_log_prob", 3).alias(f"{name}_log_prob"),
            F.round(f"{name}_probability", 9).alias(f"{name}_probability"),
        )
    return run


def _order_n_sql(order: int, smoothing: float, stem: bool = False) -> str:
    name = {2: "bigram", 3: "trigram"}[order]
    below = f"{smoothing} * (SELECT count(*) FROM c1)"
    return with_ctes(f"""
        SELECT w.id, round(s.log_prob, 3) AS {name}_log_prob, round(coalesce(exp(s.log_prob), 0.0), 9) AS {name}_probability
        FROM words w LEFT JOIN (
            SELECT id, sum(term) + any_value(edge) AS log_prob FROM (
                SELECT g.id, ln((cn.c + {smoothing}) / (cp.c + {below})) AS term,
                    ln((cf.c + {smoothing}) / CAST(p.n AS DOUBLE)) + ln((cl.c + {smoothing}) / CAST(p.n AS DOUBLE)) AS edge
                FROM gn g
                JOIN words w ON w.id = g.id
                JOIN cn ON cn.gram = g.gram
                JOIN cp ON cp.gram = regexp_replace(g.gram, ' [^ ]*$', '')
                JOIN cf ON cf.word = w.words[1]
                JOIN cl ON cl.word = w.words[len(w.words)]
                CROSS JOIN (SELECT count(*) AS n FROM posts) p)
            GROUP BY id
        ) s USING (id)""", POSTS, *words_ctes(stem), _COUNTS1,
        f"gn AS ({grams_sql(order)})", "cn AS (SELECT gram, count(*) AS c FROM gn GROUP BY gram)",
        f"cp AS (SELECT gram, count(*) AS c FROM ({grams_sql(order - 1)}) GROUP BY gram)",
        "cf AS (SELECT words[1] AS word, count(*) AS c FROM words GROUP BY 1)",
        "cl AS (SELECT words[len(words)] AS word, count(*) AS c FROM words GROUP BY 1)")


def _relative(spark: SparkSession, folder: str) -> DataFrame:
    return probability.relative_probability(staged_words(spark, folder)).select(
        "id", F.round("mean_rel_freq", 8).alias("mean_rel_freq"),
        F.round("relative_probability", 10).alias("relative_probability"),
    )


_RELATIVE_SQL = with_ctes("""
    SELECT w.id, round(coalesce(m.mean, 0.0), 8) AS mean_rel_freq,
        round(coalesce(m.mean, 0.0) / (SELECT sum(mean) FROM m), 10) AS relative_probability
    FROM words w LEFT JOIN m USING (id)""", POSTS, WORDS, _COUNTS1, """
    m AS (SELECT g.id, avg(c1.c / CAST((SELECT count(*) FROM c1) AS DOUBLE)) AS mean
          FROM (SELECT id, unnest(words) AS gram FROM words) g JOIN c1 USING (gram) GROUP BY g.id)""")


_STEMMED_SQL = with_ctes("""
    SELECT id, array_to_string(words.words, ' ') AS cleaned_stem_text, array_to_string(plain.words, ' ') AS cleaned_nonstem_text
    FROM words JOIN plain USING (id)""", POSTS, *words_ctes(stem=True))
_CLEAN_SQL = with_ctes("SELECT id, array_to_string(words, ' ') AS cleaned_nonstem_text FROM words", POSTS, WORDS)
_GLUED_SQL = with_ctes(
    "SELECT id, array_to_string(words, ' ') AS cleaned_nonstem_text FROM ("
    f"SELECT id, {words_sql('glued')} AS words FROM glued)", POSTS,
    f"glued AS (SELECT id, regexp_replace(lower(text), '{patterns.ENTITY}|{patterns.BLANK_RUN}', '', 'g') AS text "
    "FROM posts)")
_STOP_SQL = with_ctes(
    f"SELECT id, CAST(len({words_sql('posts', '[]')}) AS INTEGER) AS all_words, "
    f"CAST(len({words_sql('posts', STOP_LIST)}) AS INTEGER) AS kept_words FROM posts", POSTS)

QUERIES = {
    "posts_clean": Query(_clean, _CLEAN_SQL),
    "posts_clean_glued": Query(_glued, _GLUED_SQL),
    "posts_stopwords": Query(_stop_words, _STOP_SQL),
    "posts_stemmed": Query(_stemmed, _STEMMED_SQL),
    "post_entities": Query(_entities, _ENTITIES_SQL),
    "emoji_names": Query(_emoji_names, _EMOJI_SQL),
    "metric_labels": Query(_metric_labels, _METRIC_SQL),
    "permalink_ids": Query(_permalinks, _PERMALINK_SQL),
    "page_links": Query(_page_links, _PAGE_LINKS_SQL),
    "page_text": Query(_page_text, _PAGE_TEXT_SQL),
    "text_chunks": Query(_chunks, _CHUNKS_SQL),
    **{f"ngram_frequency_{n}": Query(_frequency(n), _frequency_sql(n)) for n in range(1, 6)},
    "ngram_sizes": Query(_all_sizes, _ALL_SIZES_SQL),
    "cleaned_ngrams": Query(_cleaned_ngrams, _cleaned_ngrams_sql()),
    "edge_words": Query(_edge_words, _EDGE_SQL),
    "skipgrams": Query(_skipgrams, _SKIPGRAMS_SQL),
    **{f"ngram_frequency_{n}_stemmed": Query(_frequency(n, True), _frequency_sql(n, True)) for n in (1, 2)},
    "unigram_probability": Query(_unigram(), _unigram_sql()),
    "unigram_probability_stemmed": Query(_unigram(True), _unigram_sql(True)),
    "bigram_probability": Query(_order_n(2, 0.0), _order_n_sql(2, 0.0)),
    "bigram_probability_stemmed": Query(_order_n(2, 0.0, True), _order_n_sql(2, 0.0, True)),
    "trigram_probability": Query(_order_n(3, 0.0), _order_n_sql(3, 0.0)),
    "bigram_smoothed": Query(_order_n(2, 1.0), _order_n_sql(2, 1.0)),
    "relative_probability": Query(_relative, _RELATIVE_SQL),
}
