"""Logistic regression of MLlib with balanced weights, and a ridge classifier in closed form."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.operators.profile import class_weights


def with_features(df: DataFrame, vec: str, label: str) -> DataFrame:
    """df with features, label as double and balanced weight."""
    rows = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    weights = class_weights(df, label).withColumnRenamed("label", "_l")
    return rows.join(weights, rows[label] == F.col("_l")).drop("_l").withColumn("y", F.col(label).cast("double"))


def fit(train: DataFrame, kind: str, c: float = 1.0):
    """A fitted MLlib model; c is the inverse of the penalty as elsewhere, divided by the sum of the weights."""
    n = train.agg(F.sum("weight")).first()[0] or 1.0
    reg = 1.0 / (c * n)
    if kind in ("logreg", "logreg_l1"):
        model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", regParam=reg, elasticNetParam=float(kind == "logreg_l1"), standardization=False, maxIter=50)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=[model]).fit(train)


def ridge(train: DataFrame, vec: str, label: str, alpha: float = 1.0) -> tuple[np.ndarray, list]:
    """Weights (features + 1 by classes) of ridge regression on targets of plus and minus one, intercept unpenalised.

    One pass adds up the normal equations per task; what is merged is bounded by features squared plus features times
    classes.
    """
    labels = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    at = {c: i for i, c in enumerate(labels)}
    dims = train.select(F.max(F.size(vec))).first()[0]

    def run(batches):
        import pandas as pd

        xx, xy = np.zeros((dims + 1, dims + 1)), np.zeros((dims + 1, len(labels)))
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.stack(pdf["v"].to_numpy()).astype(float), np.ones((len(pdf), 1))])
                y = -np.ones((len(pdf), len(labels)))
                y[np.arange(len(pdf)), [at[c] for c in pdf["y"]]] = 1
                w = pdf["w"].to_numpy()[:, None]
                xx += x.T @ (w * x)
                xy += x.T @ (w * y)
        yield pd.DataFrame({"pos": np.arange(dims + 1), "xx": list(xx), "xy": list(xy)})

    weights = class_weights(train, label).withColumnRenamed("label", "_l")
    rows = train.join(weights, train[label] == F.col("_l")).select(F.col(vec).alias("v"), F.col(label).alias("y"), F.col("weight").alias("w"))
    parts = rows.mapInPandas(run, "pos int, xx array<double>, xy array<double>").select("pos", F.posexplode(F.concat("xx", "xy")).alias("col", "x"))
    total = np.zeros((dims + 1, dims + 1 + len(labels)))
    for r in parts.groupBy("pos", "col").agg(F.sum("x").alias("x")).toLocalIterator():
        total[r["pos"], r["col"]] = r["x"]
    penalty = np.eye(dims + 1) * alpha
    penalty[-1, -1] = 0
    return np.linalg.solve(total[:, : dims + 1] + penalty, total[:, dims + 1 :]), labels


def ridge_predict(df: DataFrame, vec: str, model: tuple[np.ndarray, list]) -> DataFrame:
    """df with y_pred."""
    beta, labels = model

    @F.pandas_udf("int")
    def predict(v):
        import pandas as pd

        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(beta) - 1))
        return pd.Series(np.array(labels)[(x @ beta[:-1] + beta[-1]).argmax(1)] if len(v) else [], dtype="int32")

    return df.withColumn("y_pred", predict(F.col(vec)))
