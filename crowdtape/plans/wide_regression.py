"""Least squares on very many sparse features, straight from long rows.

A pivoted feature table has a column per user and measure, which ends at some thousand users. Here a feature is a
value of a column: rows are ``(time, feature, value)``, and what a time does not name is 0. Rows become sparse
vectors, a solver passes over them, once where the features are few, and coefficients are a table again, so scoring is
a join and a sum.
"""

from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crowdtape.operators.ordered import dense_ids
from crowdtape.sources.staging import new_path, staged

INTERCEPT = "intercept"
# Up to so many features their products with each other are summed in one pass, 1 MB a task.
FEW_FEATURES = 512


def summed(rows: DataFrame, ts: str = "timestamp", feature: str = "feature", value: str = "value") -> DataFrame:
    """One row per time and feature, repeats added up; rows without time, feature or value are left out."""
    known = rows.where(F.col(ts).isNotNull() & F.col(feature).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(ts, feature).agg(F.sum(F.col(value).cast("double")).alias(value))


def sparse_vectors(rows: DataFrame, numbers: DataFrame, size: int, ts: str = "timestamp", feature: str = "feature",
                   value: str = "value") -> DataFrame:
    """``ts`` and ``features``, a sparse vector of ``size``; ``numbers`` has each feature's number, from 0."""
    return _written(_parts(rows, numbers, size, ts, feature, value))


def _parts(rows: DataFrame, numbers: DataFrame, size: int, ts: str, feature: str, value: str) -> DataFrame:
    numbered = rows.join(numbers, feature).groupBy(ts).agg(
        F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("i"), F.col(value).alias("x")))).alias("_pairs"))
    return numbered.select(ts, _vector(size, F.col("_pairs")["i"], F.col("_pairs")["x"]).alias("features"))


def _vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector in the form in which it is stored."""
    return F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                    indices.alias("indices"), values.alias("values"))


def _written(parts: DataFrame) -> DataFrame:
    """The table written, and read back with its stored ``features`` as vectors."""
    path = new_path(parts.sparkSession, "vectors")
    parts.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT()) if f.name == "features" else f for f in parts.schema.fields]
    return parts.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def fit_sparse(rows: DataFrame, labels: DataFrame, label: str, ts: str = "timestamp", feature: str = "feature",
               value: str = "value", ridge: float = 0.0, most_passes: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """``feature, coefficient``, the least-squares coefficients; the row ``intercept`` holds the intercept.

    ``labels`` has one ``label`` per time; times without one take no part, and a time without any feature is all
    zeros. Up to ``FEW_FEATURES`` features the normal equations take one pass over the vectors. Beyond, no matrix of
    features by features is made: the solver (L-BFGS) passes over them up to ``most_passes`` times. Its coefficients lie
    on the driver, 8 bytes a feature. ``ridge`` penalises large coefficients, which decides among the many solutions
    that more features than times have.
    """
    rows = staged(summed(rows, ts, feature, value), "long-features")
    names = rows.select(feature).distinct()
    numbers = staged(dense_ids(names, [feature], "number").withColumn("number", F.col("number") - 1), "feature-numbers")
    size = numbers.count()
    parts = _parts(rows, numbers, size, ts, feature, value)
    known = labels.where(F.col(label).isNotNull()).select(ts, F.col(label).cast("double").alias("_label"))
    empty = _vector(size, F.array().cast("array<int>"), F.array().cast("array<double>"))
    joined = known.join(parts, ts, "left").select(F.coalesce("features", empty).alias("features"), "_label")
    # The solver keeps the vectors in blocks of its own while it passes over them.
    model = LinearRegression(featuresCol="features", labelCol="_label", solver="normal" if 0 < size <= FEW_FEATURES else "l-bfgs",
                             regParam=ridge, maxIter=most_passes, tol=tolerance).fit(_written(joined))
    spark = rows.sparkSession
    values = spark.createDataFrame(enumerate(model.coefficients.toArray().tolist()), "number long, coefficient double")
    named = numbers.join(values, "number").select(feature, "coefficient")
    intercept = spark.createDataFrame([(INTERCEPT, float(model.intercept))], f"`{feature}` string, coefficient double")
    return staged(named.unionByName(intercept), "coefficients")


def predict_sparse(coefficients: DataFrame, rows: DataFrame, ts: str = "timestamp", feature: str = "feature",
                   value: str = "value") -> DataFrame:
    """``ts, prediction`` for every time that ``rows`` name; features that were not fitted count as 0."""
    weights = coefficients.where(F.col(feature) != INTERCEPT)
    base = coefficients.where(F.col(feature) == INTERCEPT).agg(F.first("coefficient")).scalar()
    known = rows.where(F.col(ts).isNotNull())
    scored = known.join(weights, feature, "left").groupBy(ts).agg(
        F.sum(F.coalesce(F.col(value).cast("double") * F.col("coefficient"), F.lit(0.0))).alias("_sum"))
    return scored.select(ts, (F.col("_sum") + base).alias("prediction"))
