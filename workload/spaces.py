"""Queries on models over very many columns: sparse regression and word vectors."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.plans import wide_regression, word_space
from workload.market import rounded
from workload.views import POSTS, WORDS, Query, staged_words, table, with_ctes


def _ols_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Three columns of each line item as long rows."""
    items = table(spark, folder, "lineitem").withColumn("timestamp", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    long = items.unpivot("timestamp", ["l_quantity", "l_discount", "l_tax"], "feature", "value")
    labels = items.groupBy("timestamp").agg(F.sum("l_extendedprice").alias("price"))
    return rounded(wide_regression.fit_sparse(long, labels, "price"), "coefficient", digits=2)


_OLS_SPARSE_SQL = """
    WITH d AS (SELECT sum(CAST(l_extendedprice AS DOUBLE)) AS y, sum(CAST(l_quantity AS DOUBLE)) AS a, sum(CAST(l_discount AS DOUBLE)) AS b,
        sum(CAST(l_tax AS DOUBLE)) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
    m AS (SELECT avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d),
    s AS (SELECT sum((d.a - m.a) * (d.a - m.a)) AS aa, sum((d.a - m.a) * (d.b - m.b)) AS ab, sum((d.a - m.a) * (d.c - m.c)) AS ac,
        sum((d.b - m.b) * (d.b - m.b)) AS bb, sum((d.b - m.b) * (d.c - m.c)) AS bc, sum((d.c - m.c) * (d.c - m.c)) AS cc,
        sum((d.a - m.a) * (d.y - m.y)) AS ay, sum((d.b - m.b) * (d.y - m.y)) AS by_, sum((d.c - m.c) * (d.y - m.y)) AS cy FROM d CROSS JOIN m),
    e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
    w AS (SELECT (ay * (bb * cc - bc * bc) + by_ * (ac * bc - ab * cc) + cy * (ab * bc - ac * bb)) / det AS wa,
        (ay * (ac * bc - ab * cc) + by_ * (aa * cc - ac * ac) + cy * (ab * ac - aa * bc)) / det AS wb,
        (ay * (ab * bc - ac * bb) + by_ * (ab * ac - aa * bc) + cy * (aa * bb - ab * ab)) / det AS wc FROM e)
    SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'intercept']) AS feature,
        unnest([round(wa, 2), round(wb, 2), round(wc, 2), round(m.y - wa * m.a - wb * m.b - wc * m.c, 2)]) AS coefficient FROM w CROSS JOIN m"""


def _cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    counts = word_space.pair_counts(staged_words(spark, folder), window=2)
    return rounded(word_space.ppmi(counts), "value", digits=6)


_COOCCURRENCE_SQL = with_ctes("""
    SELECT word, context, round(ln(n / total) - ln(of_word / total) - ln(of_context / total), 6) AS value
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY word) AS DOUBLE) AS of_word, CAST(sum(n) OVER (PARTITION BY context) AS DOUBLE) AS of_context,
        CAST(sum(n) OVER () AS DOUBLE) AS total FROM both_ways)
    WHERE ln(n / total) - ln(of_word / total) - ln(of_context / total) > 0""", POSTS, WORDS, """
    one_way AS (SELECT unnest(list_concat(
        list_transform(range(1, len(words)), lambda i: {'word': words[i], 'context': words[i + 1]}),
        list_transform(range(1, len(words) - 1), lambda i: {'word': words[i], 'context': words[i + 2]}))) AS p FROM words)""", """
    both_ways AS (SELECT word, context, count(*) AS n FROM (
        SELECT p.word AS word, p.context AS context FROM one_way UNION ALL SELECT p.context, p.word FROM one_way) GROUP BY 1, 2)""")


def _word_space(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for each word that meets another."""
    return word_space.word_space(staged_words(spark, folder), size=8, window=2)


QUERIES = {
    "ols_sparse": Query(_ols_sparse, _OLS_SPARSE_SQL),
    "word_cooccurrence": Query(_cooccurrence, _COOCCURRENCE_SQL),
    "word_space": Query(_word_space),
}
