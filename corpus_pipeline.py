"""From raw documents to token ids: what is kept, cleaned, mixed and encoded, stage by stage.

Every stage takes the documents that the one before has left. All but the last return the columns of
``documents``; each result is written and read again before the next stage begins.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtape.llm import line_crf, line_dedup, mixing, pieces, simhash_dedup
from crowdtape.llm.common import remainder, table
from crowdtape.llm.queries import MIX_SEED, MIX_WEIGHTS, NBEST, QUALITY, domain
from crowdtape.sources.staging import staged

# The mixture holds so many hundredths of the words that are left, each document once at most.
MIX_SHARE = 90


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, taught by ``labels``, takes for good."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.train(documents, labels, remainder("doc_id") != 0)
    return line_crf.with_quality(docs, model, score_col="_score").where(F.col("_score") >= QUALITY).drop("_score")


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that the corpus has had before; documents with nothing else go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles within 3 bits connect."""
    return simhash_dedup.keep_one(docs, shingle=3, radius=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As much of each source as its weight and the budget allow."""
    return mixing.mixture(
        docs, {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS,
        F.expr(f"tokens * {MIX_SHARE} div 100"), seed=MIX_SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the scores of its best segmentations, and whether the ids spell its text."""
    vocabulary = pieces.Vocabulary()
    found = pieces.with_pieces(docs.select("doc_id", "lang", "source", "text"), vocabulary, count=NBEST)
    decoded = pieces.with_text(found, vocabulary)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "score", "ids",
        F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality", quality), ("line_repeats", line_repeats), ("near_duplicates", near_duplicates), ("mixture", mixture),
    ("encoded", encoded),
]

# The classifier's decisions cannot be said in SQL; the tests compare every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
