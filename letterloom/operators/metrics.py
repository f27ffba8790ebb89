"""Classification metrics over (y_true, y_pred); all work on the confusion counts, one row for each pair of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_class(pred: DataFrame) -> DataFrame:
    """label, tp, n_true, n_pred for every label that is true or predicted."""
    conf = pred.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    both = conf.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("c")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("c")),
    )))
    return both.groupBy("label").agg(F.sum("c").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def per_class_f1(pred: DataFrame) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return _by_class(pred).select("label", "n_true", F.round(f1, 6).alias("f1"), f1.alias("_f1"))


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    """Mean recall of the labels that are true somewhere."""
    return _by_class(pred).filter("n_true > 0").agg(F.round(F.avg(F.col("tp") / F.col("n_true")), 6).alias("balanced_accuracy"))


def macro_f1(pred: DataFrame) -> DataFrame:
    """Mean F1 of the labels that are true or predicted somewhere."""
    return per_class_f1(pred).agg(F.round(F.avg("_f1"), 6).alias("macro_f1"))


def weighted_f1(pred: DataFrame) -> DataFrame:
    c = _by_class(pred)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return c.agg(F.round(F.sum("tp") / F.sum("n_true"), 6).alias("accuracy"), F.round(F.sum(f1 * F.col("n_true")) / F.sum("n_true"), 6).alias("weighted_f1"))


def scores(pred: DataFrame, *keys: str) -> DataFrame:
    """Balanced accuracy and macro F1 for every point of a sweep in one pass."""
    conf = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    both = conf.select(*keys, F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("c")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("c")),
    )))
    c = both.groupBy(*keys, "label").agg(F.sum("c").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return c.groupBy(*keys).agg(
        F.round(F.avg(F.try_divide(F.col("tp").cast("double"), F.col("t").cast("double"))), 6).alias("balanced_accuracy"),
        F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))), 6).alias("macro_f1"),
    )


def sweep_best(swept: DataFrame, metric: str, *order: str) -> DataFrame:
    """The point with the greatest metric; the first in the given order of equal ones."""
    return swept.orderBy(F.col(metric).desc(), *order).limit(1)


def leaderboard(results: DataFrame, *metrics: str, k: int = 10) -> DataFrame:
    w = Window.orderBy(*[F.col(m).desc() for m in metrics], "model")
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_and_deviation(runs: DataFrame, metric: str, *keys: str) -> DataFrame:
    """keys, runs, mean and sample deviation of a metric over the runs of a model."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(metric), 6).alias("mean"), F.round(F.stddev_samp(metric), 6).alias("deviation"))
