"""The registered queries of this subpackage, and the SQL they have to agree with where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.llm import (
    decontaminate, divergence, embedding_dedup, hard_negatives, line_crf, line_dedup, mixing, ordinal_toxicity, pieces, ppm,
    prefix_trie, rollups, simhash_dedup,
)
from crowdtape.llm.common import remainder, table
from crowdtape.sources.staging import new_path, staged


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, folder, "documents")).drop("line_hash")


def line_sql(docs: str) -> str:
    """CTEs that end in ``classed``: a row for each line with its class's first line."""
    white = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"
    return f"""
numbered AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS line_no
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs})),
lined AS (SELECT doc_id, line_no, trim(lines[line_no + 1], {white}) AS line FROM numbered
    WHERE length(trim(lines[line_no + 1], {white})) >= {line_dedup.LEAST_CHARS}),
same AS (SELECT line, min(doc_id * 1000000 + line_no) AS place FROM lined GROUP BY line),
pairs AS (SELECT a.place AS x, b.place AS y FROM same a JOIN same b ON length(b.line) BETWEEN length(a.line) AND length(a.line) + {line_dedup.EDITS}
    AND a.place <> b.place WHERE length(a.line) >= {line_dedup.LEAST_NEAR_CHARS} AND levenshtein(a.line, b.line) <= {line_dedup.EDITS}),
both_ways AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reached(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, l.y FROM reached r JOIN both_ways l ON l.x = r.y),
leader AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
classed AS (SELECT l.doc_id, l.line_no, l.line, s.place, least(s.place, coalesce(r.y, s.place)) AS class
    FROM lined l JOIN same s USING (line) LEFT JOIN leader r ON r.x = s.place)"""


LINE_SQL = f"""WITH RECURSIVE {line_sql("documents")}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(class // 1000000 AS BIGINT) AS class_id,
    CAST(class % 1000000 AS INTEGER) AS class_line, class <> place AS near, doc_id * 1000000 + line_no = class AS kept
FROM classed
"""


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM usable),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM normed a JOIN normed b ON a.vec_id <> b.vec_id
    AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
first AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, f.component_id, v.vec_id = f.component_id AS kept
FROM v JOIN first f ON f.x = v.vec_id LEFT JOIN counts c ON c.x = v.vec_id
"""


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=3)


# A document is good from this score on.
QUALITY = 0.3


def op4_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = line_crf.train(docs, labels, remainder("doc_id") != 0)
    scored = line_crf.with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op5_ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = ppm.score_texts(
        docs.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "text"), remainder("doc_id") != 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# A source's domain, and the weights of domains, languages and sources that the mixture aims at.
def domain(source: str = "source"):
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "0", "crawl").when(F.length(number) == 1, "web").otherwise("library")


MIX_WEIGHTS = [
    {"crawl": 2, "web": 3, "library": 5},
    {"en": 5, "de": 2, "es": 2, "fr": 2},
    {"src1": 3, "src10": 4, "src11": 2},
]
# The mixture holds this many hundredths of the words there are, and a document at most so often.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 60, 4, 42


def op6_hierarchical_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = mixing.with_copies(
        docs.select("doc_id", "lang", "source", "text"),
        {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS,
        F.expr(f"tokens * {MIX_SHARE} div 100"), seed=MIX_SEED, max_epochs=MIX_EPOCHS)
    return mixed.where("copies > 0").select("doc_id", domain().alias("domain"), "lang", "source", "copies")


def mix_sql(share: int, epochs: int, docs: str = "documents") -> str:
    """CTEs that end in ``copied``: doc_id, the three levels, tokens and copies."""
    levels = ["domain", "lang", "source"]

    def weight(i: int) -> str:
        return f"CASE {levels[i]} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS[i].items()) + " ELSE 1 END"

    ctes, given = [], f"SELECT least(sum(tokens) * {share} // 100, sum(room)) AS budget FROM leaves"
    ctes.append(f"given0 AS ({given})")
    for i, level in enumerate(levels):
        parents, path = ", ".join(levels[:i]), ", ".join(levels[:i + 1])
        part = f"PARTITION BY {parents} " if parents else ""
        join = f"JOIN given{i} USING ({parents})" if parents else f"CROSS JOIN given{i}"
        ctes.append(f"""
nodes{i} AS (SELECT n.*, budget FROM (SELECT {path}, CAST(sum(room) AS BIGINT) AS room, {weight(i)} AS weight FROM leaves GROUP BY {path}) n {join}),
ranked{i} AS (SELECT *, sum(room) OVER ({part}ORDER BY room / weight, {level} ROWS UNBOUNDED PRECEDING) - room AS before,
    sum(weight) OVER ({part}ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM nodes{i}),
filled{i} AS (SELECT *, room * rest_weight <= (budget - before) * weight AS is_full FROM ranked{i}),
opened{i} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE weight END AS open FROM filled{i}),
shared{i} AS (SELECT *, budget - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ({part}) AS left_over, sum(open) OVER ({part}) AS open_all,
    sum(open) OVER ({part}ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS open_to FROM opened{i}),
given{i + 1} AS (SELECT {path}, CASE WHEN is_full THEN room
    ELSE left_over * open_to // open_all - left_over * (open_to - open) // open_all END AS budget FROM shared{i})""")
    return f"""sized AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE regexp_extract(source, '([0-9]+)$', 1) WHEN '0' THEN 'crawl' ELSE
        CASE WHEN length(regexp_extract(source, '([0-9]+)$', 1)) = 1 THEN 'web' ELSE 'library' END END AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS room FROM sized GROUP BY ALL),
{', '.join(ctes)},
planned AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaves l JOIN given3 USING (domain, lang, source)),
ordered AS (SELECT doc_id, domain, lang, source, tokens, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' || doc_id) AS k
    FROM sized JOIN planned USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM ordered),
copied AS (SELECT doc_id, domain, lang, source, tokens,
    CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed)"""


NBEST = 3


def op7_sentencepiece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.Vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("text").alias("before"))
    encoded = pieces.with_pieces(docs, vocabulary, "text", NBEST)
    decoded = pieces.with_text(encoded.drop("text"), vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"),
        F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"),
        F.col("decoded").eqNullSafe(F.col("before")).alias("round_trip"))


def op8_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents under two tokenizer versions; then exact copies go, and texts that repeat a line of their own
    are counted again without the repeats. One batch is sent twice."""
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    sized = docs.select(
        "doc_id", "source", "lang", F.md5(text.cast("binary")).alias("digest"), text.alias("whole"),
        F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n")).alias("fewer"))
    before, after = rollups.counts("whole"), rollups.counts("fewer")
    sized = staged(sized.select(
        "doc_id", "source", "lang", "digest", F.col("fewer").isNotNull().alias("shrunk"),
        F.create_map(*[x for k, n in before.items() for x in (F.lit(k), n)]).alias("before"),
        F.create_map(*[x for k, n in after.items() for x in (F.lit(k), n)]).alias("after")), "token-counts")

    def changes(rows: DataFrame, op: str, counts: str, order: int, *versions: str) -> DataFrame:
        unrolled = rows.select("doc_id", "source", "lang", F.explode(counts).alias("tokenizer", "tokens"))
        return unrolled.where(F.col("tokenizer").isin(*versions)).withColumns(
            {"op": F.lit(op), "change_no": F.lit(order).cast("long")})

    both = (rollups.WORDS, rollups.PIECES)
    firsts = sized.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = sized.join(firsts, "digest").where("doc_id <> first")
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    first = changes(sized, "insert", "before", 1, rollups.WORDS)
    rollup.commit(1, first)
    rollup.commit(2, changes(sized, "insert", "before", 1, rollups.PIECES))
    rollup.commit(1, first)
    rollup.commit(3, changes(sized.where("shrunk"), "revise", "after", 1, *both).unionByName(
        changes(copies, "delete", "before", 2, *both)))
    return rollup.totals()


ROLLUP_SQL = f"""
WITH firsts AS (SELECT coalesce(text, '') AS body, min(doc_id) AS doc_id FROM documents GROUP BY 1),
kept AS (SELECT source, lang, array_to_string(list_transform(list_filter(list_transform(range(1, len(lines) + 1),
        lambda i: CASE WHEN list_position(lines, lines[i]) = i THEN i END), lambda i: i IS NOT NULL), lambda i: lines[i]), chr(10)) AS body
    FROM (SELECT d.source, d.lang, string_split(f.body, chr(10)) AS lines FROM firsts f JOIN documents d ON d.doc_id = f.doc_id)),
counted AS (SELECT source, lang, 'words-1' AS tokenizer,
        len(list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM kept
    UNION ALL SELECT source, lang, 'pieces-2', len(regexp_extract_all(body, '{rollups.PIECE}')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY ALL
"""


def op9_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = divergence.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def _divergence_sql() -> str:
    lists = divergence.COMMON_WORDS
    strip = "text AS t0"
    names = list(divergence.CLASSES)
    for i, pattern in enumerate(divergence.CLASSES.values()):
        strip += f", regexp_replace(t{i}, '{pattern.replace("'", "''")}', '', 'g') AS t{i + 1}"
    classes = ", ".join(f"length(t{i}) - length(t{i + 1})" for i in range(len(names))) + f", length(t{len(names)})"
    counts = "CASE lang " + " ".join(
        f"WHEN '{lang}' THEN [" + ", ".join(f"len(list_filter(spoken, lambda x: x = '{w}'))" for w in own)
        + f", len(list_filter(spoken, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in own)})))]"
        for lang, own in lists.items()) + " ELSE [len(spoken)] END"

    def distance(mine: str, theirs: str) -> str:
        return f"""sqrt(greatest(0.0, list_sum(list_transform(range(1, len({mine}) + 1), lambda i:
            (CASE WHEN {mine}[i] > 0 THEN {mine}[i] / list_sum({mine}) * ln(2 * ({mine}[i] / list_sum({mine}))
                / ({mine}[i] / list_sum({mine}) + {theirs}[i] / list_sum({theirs}))) ELSE 0.0 END)
            + (CASE WHEN {theirs}[i] > 0 THEN {theirs}[i] / list_sum({theirs}) * ln(2 * ({theirs}[i] / list_sum({theirs}))
                / ({mine}[i] / list_sum({mine}) + {theirs}[i] / list_sum({theirs}))) ELSE 0.0 END))) / (2 * ln(2))))"""

    def beyond(d: str, bins: str) -> str:
        return f"sqrt(greatest(0.0, {d} * {d} - ({bins} - 1) / (8.0 * ln(2) * greatest(n_words, 1))))"

    ws = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, lang, {strip},
    list_filter(regexp_split_to_array(text, '{ws}'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{ws}', '', 'g')) > 0) AS lines,
    list_filter(regexp_split_to_array(lower(text), '{divergence.WORD_ENDS}'), lambda x: x <> '') AS spoken FROM d),
counted AS (SELECT doc_id, lang, len(words) AS n_words, words, length(t0) - (length(t3) - length(t4)) AS word_chars,
    length(t5) - length(regexp_replace(t5, '{divergence.SYMBOLS}', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    list_transform([{classes}], lambda x: CAST(x AS DOUBLE)) AS classes,
    list_transform({counts}, lambda x: CAST(x AS DOUBLE)) AS common FROM parts),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {divergence.WINDOW - 1}], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, n_words - {divergence.WINDOW - 2})) AS i FROM counted
          WHERE n_words >= {divergence.WINDOW})),
twice AS (SELECT doc_id, i FROM windows JOIN (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1)
    USING (doc_id, w)),
spans AS (SELECT doc_id, least({divergence.WINDOW}, lead(i, 1, i + {divergence.WINDOW})
    OVER (PARTITION BY doc_id ORDER BY i) - i) AS n FROM twice),
repeats AS (SELECT doc_id, sum(n) AS n FROM spans GROUP BY doc_id),
stats AS (SELECT c.doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, classes, common,
    coalesce(r.n, 0) AS n_repeat_words FROM counted c LEFT JOIN repeats r USING (doc_id)),
refs AS (SELECT lang, [{', '.join(f'sum(classes[{i + 1}])' for i in range(len(names) + 1))}] AS all_classes,
    list_filter([{', '.join(f'sum(common[{i + 1}])' for i in range(max(map(len, lists.values())) + 1))}],
        lambda x: x IS NOT NULL) AS all_common FROM stats GROUP BY lang),
far AS (SELECT s.*,
    CASE WHEN list_sum(classes) > 0 THEN {distance("classes", "all_classes")} END AS class_distance,
    CASE WHEN len(common) > 1 AND list_sum(common) > 0 THEN {distance("common", "all_common")} END AS word_distance
    FROM stats s JOIN refs r ON s.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT (list_sum(classes) >= {divergence.LEAST_CHARS}
        AND coalesce({beyond("class_distance", str(len(names) + 1))} > {divergence.FARTHEST_CLASSES}, false))
    AND NOT (n_words >= {divergence.LEAST_WORDS}
        AND coalesce({beyond("word_distance", "len(common)")} > {divergence.FARTHEST_WORDS}, false)) AS kept
FROM far
"""


# A document is toxic if a grade above 0 is at least this likely.
TOXIC = 0.5


def op10_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = ordinal_toxicity.train(docs, labels, remainder("doc_id") != 0, split_flagged=True)
    graded = ordinal_toxicity.with_severity(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "severity", "grade", "p_toxic",
                         (F.col("p_toxic") >= TOXIC).alias("toxic"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


PASSAGE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words FROM documents),
i AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words FROM benchmark),
w AS (SELECT item_id, k, array_to_string(words[i0:i0 + k - 1], ' ') AS string FROM (
    SELECT item_id, words, least(len(words), {decontaminate.WINDOW}) AS k, unnest(range(1, len(words) - least(len(words), {decontaminate.WINDOW}) + 2)) AS i0
    FROM i WHERE len(words) > 0)),
v AS (SELECT n, k, i0, array_to_string(words[i0:i0 + k - 1], ' ') AS string FROM (
    SELECT n, words, k, unnest(range(1, len(words) - k + 2)) AS i0 FROM d JOIN (SELECT DISTINCT k FROM w) ON len(words) >= k)),
found AS (SELECT n, i0, k, item_id FROM v JOIN w USING (k, string)),
hits AS (SELECT n, count(*) AS hit FROM (SELECT DISTINCT n, unnest(range(i0, i0 + k)) FROM found) GROUP BY n),
named AS (SELECT n, count(*) AS items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT n, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM found) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (n) LEFT JOIN named USING (n)
"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    usable = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.hard_negatives(usable, F.col("id") % 50 == 0)


NEGATIVE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(list_transform(a.e, lambda x: CAST(x AS DOUBLE)), list_transform(b.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {hard_negatives.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {hard_negatives.HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}
"""


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversation c begins with up to h turns of conversation c - c % 5 and goes on with its own after h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 5
    begins = turns.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 8).alias("begin"))
    joined = turns.withColumns({"base_id": base, "h": h}).join(begins, "base_id", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("begin", F.array().cast("array<string>")), F.lit(1), F.col("h")), own).alias("turns"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = staged(prefix_trie.turn_ids(table(spark, folder, "conversations")), "turn-ids")
    trie = prefix_trie.prefix_trie(rebuilt(turns))
    listed = F.array_join(F.transform(F.array_sort("ends"), lambda x: x.cast("string")), ",")
    nodes = trie.nodes.withColumn("own", F.sha2(listed.cast("binary"), 256))
    spread = nodes.where("own IS NULL").join(prefix_trie.listed_digests(trie.ends), "node", "left").withColumn(
        "own", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))).drop("digest")
    return nodes.where("own IS NOT NULL").unionByName(spread).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.col("own").alias("ends_sha256"))


TRIE_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b)) AS crc),
own AS (SELECT conv_id, list(struct_pack(id := md5(strlen(role) || ':' || role || text) || lpad(hex(strlen(text)), 8, '0'), n := strlen(text))
    ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS turns
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
sized AS (SELECT conv_id, turns, CAST(xor(list_reduce(list_transform(range(1, len(c) + 1), lambda i: ord(c[i])),
        lambda s, x: xor(s >> 8, crc[CAST(xor(s & 255, x) AS BIGINT) + 1]), 4294967295), 4294967295) % 9 AS BIGINT) AS h
    FROM (SELECT *, CAST(conv_id AS VARCHAR) AS c FROM own) CROSS JOIN bits),
r AS (SELECT s.conv_id, list_concat(coalesce(b.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns
    FROM sized s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 5),
p AS (SELECT conv_id, d, len(turns) AS size, array_to_string(list_transform(turns[1:d], lambda x: x.id), '') AS path,
        CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, 
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM p GROUP BY d, path),
kids AS (SELECT d - 1 AS d, substr(path, 1, 40 * (d - 1)) AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT e AS d, substr(path, 1, 40 * e) AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n) AS saved
    FROM (SELECT node.*, n_children, unnest(range(0, node.d + 1)) AS e FROM node LEFT JOIN kids USING (d, path)) GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs,
    CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below USING (d, path) LEFT JOIN kids USING (d, path)
    LEFT JOIN node parent ON parent.d = node.d - 1 AND parent.path = substr(node.path, 1, 40 * (node.d - 1))
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_crf_quality": op4_crf_quality,
    "op5_ppm_score": op5_ppm_score,
    "op6_hierarchical_mix": op6_hierarchical_mix,
    "op7_sentencepiece_nbest": op7_sentencepiece_nbest,
    "op8_token_rollup": op8_token_rollup,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
    "op11_decontaminate": op11_decontaminate,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_SQL,
    "op2_embedding_near_dedup": EMBEDDING_SQL,
    "op6_hierarchical_mix": f"WITH {mix_sql(MIX_SHARE, MIX_EPOCHS)} "
    "SELECT doc_id, domain, lang, source, copies FROM copied WHERE copies > 0",
    "op8_token_rollup": ROLLUP_SQL,
    "op9_divergence_rules": _divergence_sql(),
    "op11_decontaminate": PASSAGE_SQL,
    "op12_hard_negatives": NEGATIVE_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
