"""Centroid and neighbour classifiers over (id, label, v) with v an array of numbers.

There is one centroid a label, so tables of centroids are small beside the rows and Spark may broadcast them below its
threshold. Neighbours of a query set are searched in blocks of queries against all rows, by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.try_divide(x, n))), F.lit(0))


def unit_rows(df: DataFrame, id_col: str, label: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), l2_normalize(doubles(F.col(vec))).alias("v"))


def _mean(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """keys, label, v: unit weighted mean of the rows of each label, summed as whole vectors before the shuffle. A label
    whose rows all have weight 0 has none; rows without a vector of some length count for nothing."""
    whole = rows.withColumn("_w", weight).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.col("_w") > 0))
    each = whole.select(*keys, "label", array_to_vector("v").alias("x"), F.col("_w").alias("w"))
    sums = each.groupBy(*keys, "label").agg(vector_to_array(Summarizer.metrics("sum").summary(F.col("x"), F.col("w")).getField("sum")).alias("s"))
    return sums.select(*keys, "label", l2_normalize(F.col("s")).alias("v"))


def _weighed(sim: DataFrame, mode: Column, ratio: Column, power: Column, *keys: str) -> DataFrame:
    """sim (keys, label, id, v, sim) with the weight w of each row in the next centroid.

    hard: one for the most similar rows, ties by id. soft: the similarity to a power, and zero up to the similarity of the
    last row to be zeroed. Similarities have six places, so the place of the cut follows from counts of at most two million
    values a label, and only rows of the one value that a hard cut divides are ranked: a label may hold any part of all rows.
    """
    group = [*keys, "label"]
    sim = sim.filter("sim IS NOT NULL")  # others have no direction
    counts = sim.groupBy(*group, "sim").agg(F.count(F.lit(1)).alias("c"))
    every, up = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("sim")
    counts = counts.withColumn("n", F.sum("c").over(every)).withColumn("low", F.sum("c").over(up)).withColumn("high", F.col("n") - F.col("low") + F.col("c"))
    keep = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * (1 - ratio), 9)))
    zero = F.floor(F.round(F.col("n") * ratio, 9))
    cuts = counts.groupBy(*group, "n").agg(
        F.max(F.when((F.col("high") >= keep) & (F.col("high") - F.col("c") < keep), F.struct("sim", (keep - F.col("high") + F.col("c")).alias("rest")))).alias("hard"),
        F.max(F.when((F.col("low") >= zero) & (F.col("low") - F.col("c") < zero), F.col("sim"))).alias("edge"),
    )
    joined = sim.join(cuts, group)
    divided = (mode == "hard") & (F.col("sim") == F.col("hard.sim"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
    soft = F.when((F.col("n") >= 3) & (ratio > 0) & (F.col("sim") <= F.col("edge")), 0.0).otherwise(F.pow(F.greatest("sim", F.lit(0.0)), power))
    plain = F.when(mode == "soft", soft).when(F.col("sim") > F.col("hard.sim"), 1.0)
    rest = joined.filter(~divided).withColumn("w", plain)
    at_cut = joined.filter(divided).withColumn("w", F.when(rank <= F.col("hard.rest"), 1.0))
    return rest.unionByName(at_cut).filter("w IS NOT NULL").drop("n", "hard", "edge")


def centroids(rows: DataFrame, mode: str = "mean", ratio: float = 0.15, power: float = 4.0, refine: int = 1) -> DataFrame:
    """label, v of each class. hard keeps the most similar rows, soft weighs rows by their similarity to the power and
    zeroes the least similar; both start from the mean and are repeated `refine` times."""
    if mode not in ("mean", "hard", "soft"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "mean":
        return _mean(rows, F.lit(1.0))
    return centroid_grid(rows, [(mode, ratio, power)], refine).select("label", "v")


def centroid_grid(rows: DataFrame, points: list[tuple[str, float, float]], refine: int = 1) -> DataFrame:
    """mode, ratio, power, label, v: the centroids of every point (mode, ratio, power) in one pass; the first similarities
    are those to the mean and are shared."""
    keys = ("mode", "ratio", "power")
    grid = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, p)]) for p in points])).alias("g")
    cosine = F.round(dot(F.col("v"), F.col("c")), 6).alias("sim")
    first = rows.join(_mean(rows, F.lit(1.0)).withColumnRenamed("v", "c"), "label").select("id", "label", "v", cosine)
    sim, c = first.select("*", grid).select("*", "g.*").drop("g"), None
    for i in range(1 + refine):
        if i:
            sim = rows.join(c.withColumnRenamed("v", "c"), "label").select(*keys, "id", "label", "v", cosine)
        c = _mean(_weighed(sim, F.col("mode"), F.col("ratio"), F.col("power"), *keys), F.col("w"), *keys)
    return c


def centroid_scores(rows: DataFrame, cents: DataFrame, *keys: str) -> DataFrame:
    """keys, id, y_true, label, sim for every row and class."""
    packed = cents.agg(F.collect_list(F.struct(*keys, "label", "v")).alias("cs"))  # one row, as many entries as classes
    each = rows.crossJoin(packed).select("id", F.col("label").alias("y_true"), "v", F.explode("cs").alias("c"))
    return each.select(*[F.col(f"c.{k}").alias(k) for k in keys], "id", "y_true", F.col("c.label").alias("label"), F.round(dot(F.col("v"), F.col("c.v")), 6).alias("sim"))


def best_label(scored: DataFrame, score: str, *keys: str) -> DataFrame:
    """keys, id, y_true, y_pred, score: the label with the greatest score, the least label of equal ones."""
    top = F.max_by("label", F.struct(F.col(score), -F.col("label")))
    return scored.groupBy(*keys, "id", "y_true").agg(top.alias("y_pred"), F.max(score).alias("score"))


def neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """id, y_true, other, label, sim, rank: the k most similar rows of each query by (rounded cosine, id)."""
    spark = rows.sparkSession
    base = rows.select("id", "label", "v")
    parts = max(1, -(-queries.count() // BLOCK_ROWS))
    out = None
    for p in range(parts):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).select("id", "label", "v").collect()
        if not block:
            continue
        ids, truth, matrix = np.array([r[0] for r in block]), np.array([r[1] for r in block]), np.array([r[2] for r in block])

        def run(batches: Iterator[pd.DataFrame], ids=ids, truth=truth, matrix=matrix) -> Iterator[pd.DataFrame]:
            best = None  # (similarities, ids, labels) of the k nearest rows of this partition so far
            for pdf in batches:
                if not len(pdf):
                    continue
                sim = np.round(matrix @ np.stack(pdf["v"].to_numpy()).T, 6)
                new = (sim, *(np.broadcast_to(pdf[c].to_numpy(), sim.shape) for c in ("id", "label")))
                if best is not None:
                    new = tuple(np.hstack(x) for x in zip(best, new))
                order = np.lexsort((new[1], -new[0]), axis=1)[:, :k]
                best = tuple(np.take_along_axis(x, order, 1) for x in new)
            if best is not None:
                n = best[0].shape[1]
                yield pd.DataFrame({"id": np.repeat(ids, n), "y_true": np.repeat(truth, n), "other": best[1].ravel(), "label": best[2].ravel(), "sim": best[0].ravel()})

        kind = dict(rows.dtypes)
        found = base.mapInPandas(run, f"id {kind['id']}, y_true {kind['label']}, other {kind['id']}, label {kind['label']}, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "id bigint, y_true int, other bigint, label int, sim double, rank int")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def soft_votes(found: DataFrame, temperature: Column, *keys: str) -> DataFrame:
    """keys, id, y_true, label, score: softmax of the neighbours' similarities, added up by label."""
    w = Window.partitionBy(*keys, "id")
    e = F.exp((F.col("sim") - F.max("sim").over(w)) / temperature)
    weighed = found.withColumn("_e", e).withColumn("_w", F.col("_e") / F.sum("_e").over(w))
    return weighed.groupBy(*keys, "id", "y_true", "label").agg(F.round(F.sum("_w"), 6).alias("score"))


def ensemble_scores(cent: DataFrame, votes: DataFrame) -> DataFrame:
    """id, y_true, label, c, nn: both scores spread over 0..1 for every query; labels without votes have none."""
    both = cent.join(votes.select("id", "label", "score"), ["id", "label"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("id")
    spread = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    return both.select("id", "y_true", "label", spread("sim").alias("c"), spread("score").alias("nn"))


def choose_candidate(cands: DataFrame, low: float, high: float, lengths: tuple[float, float] | None = None) -> DataFrame:
    """The candidate of each source that is in the window and most similar, else the most similar of all.

    With lengths, only candidates whose ratio to the source's length lies between them are looked at, unless none does.
    """
    fits = F.col("ratio").between(*lengths) if lengths else F.lit(True)
    w = Window.partitionBy("source_id").orderBy(fits.desc(), F.col("sim").between(low, high).desc(), F.col("sim").desc(), "cand_id")
    return cands.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def distinct_candidates(cands: DataFrame, text: str = "text") -> DataFrame:
    """The first candidate, by cand_id, of those of a source that have the same text; blank ones are dropped."""
    rows = cands.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    first = rows.groupBy("source_id", F.sha2(text, 256).alias("_k")).agg(F.min_by(F.struct(*cands.columns), "cand_id").alias("_c"))
    return first.select("_c.*")


def choose_candidate_bt(cands: DataFrame, low: float, high: float) -> DataFrame:
    """In the window the least perplexity, of equal ones the most similar; without any the most similar of all."""
    inside = F.col("sim").between(low, high)
    w = Window.partitionBy("source_id").orderBy(inside.desc(), F.when(inside, F.col("perplexity")).asc_nulls_last(), F.col("sim").desc(), "cand_id")
    return cands.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
