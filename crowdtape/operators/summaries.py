"""Summaries of forecasts and of classifications."""

from pyspark.sql import DataFrame, functions as F


def ensemble_by_time(runs: DataFrame, ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Mean over the runs at each time."""
    return runs.groupBy(ts).agg(F.avg(value).alias("mean_value"))


def ensemble_overall(runs: DataFrame, value: str = "value") -> DataFrame:
    """Mean and population standard deviation over all runs and times."""
    return runs.agg(F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))


def confusion_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the confusion matrix of a 0/1 label, accuracy, precision, recall and F1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": F.try_divide(tp + tn, tn + fp + fn + tp),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    sides = df.select(F.inline(F.array(
        F.struct(F.col(label).cast("int").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("predicted"),
                 F.lit(0).alias("hit")),
        F.struct(F.col(prediction).cast("int").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("predicted"),
                 (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
    )))
    counts = sides.groupBy("class").agg(
        F.sum("hit").alias("hits"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("support")
    )
    return counts.select(
        "class",
        F.try_divide("hits", "predicted").alias("precision"),
        F.try_divide("hits", "support").alias("recall"),
        F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )
