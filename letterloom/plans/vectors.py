"""Similarity and metric queries over embeddings; every fifth vector is a test row."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.operators import metrics as M
from letterloom.operators import similarity as S
from letterloom.plans.registry import query, table

KS = (1, 3, 5, 7, 9, 11, 15, 21, 31)
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
ORIGINAL_TEMPERATURES = (0.03, 0.05, 0.1, 0.15, 0.2, 0.3)
ALPHAS = (0.3, 0.4, 0.5, 0.6, 0.7)


def _rows(spark, d):
    return S.unit_rows(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


def _parts(spark, d):
    rows = _rows(spark, d)
    return rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")


_E = (
    "WITH e0 AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v0 FROM embeddings), "
    "e AS (SELECT id, label, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM e0), "
    "train AS (SELECT * FROM e WHERE id % 5 <> 0), test AS (SELECT * FROM e WHERE id % 5 = 0), "
)


def _mean_sql(name: str, source: str, weight: str) -> str:
    return (
        f"{name}x AS (SELECT label, i AS pos, sum(({weight}) * v[i]) AS s FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {source}) GROUP BY ALL), "
        f"{name}s AS (SELECT label, list(s ORDER BY pos) AS s FROM {name}x GROUP BY label), "
        f"{name} AS (SELECT label, list_transform(s, lambda x: x / nullif(sqrt(list_dot_product(s, s)), 0)) AS v FROM {name}s), "
    )


def _refined_sql(mode: str, ratio: float, power: float) -> str:
    out, last = _mean_sql("c0", "train", "1.0::DOUBLE"), "c0"
    for i in (1, 2):
        sim = f"SELECT t.id, t.label, t.v, round(list_dot_product(t.v, c.v), 6) AS sim FROM train t JOIN {last} c USING (label)"
        if mode == "hard":
            out += (
                f"k{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({sim})) WHERE r <= greatest(1, ceil(round(n * {1 - ratio}::DOUBLE, 9)))), "
            )
            out += _mean_sql(f"c{i}", f"k{i}", "1.0::DOUBLE")
        else:
            out += (
                f"k{i} AS (SELECT *, max(CASE WHEN r = floor(round(n * {ratio}::DOUBLE, 9)) THEN sim END) OVER (PARTITION BY label) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({sim}))), "
            )
            zero = f"n >= 3 AND {ratio} > 0 AND coalesce(sim <= edge, false)"
            out += _mean_sql(f"c{i}", f"k{i}", f"CASE WHEN {zero} THEN 0.0::DOUBLE ELSE pow(greatest(sim, 0.0::DOUBLE), {power}::DOUBLE) END")
        last = f"c{i}"
    return out + f"c AS (SELECT * FROM {last}) "


_C = _mean_sql("c1", "train", "1.0::DOUBLE") + "c AS (SELECT * FROM c1)"
_SCORED = ", s AS (SELECT t.id, t.label AS y_true, c.label, round(list_dot_product(t.v, c.v), 6) AS sim FROM test t, c), cp AS (SELECT id, y_true, label AS y_pred, sim AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1) "
_CENT = _E + _C + _SCORED
_N = "nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM (SELECT q.id, q.label AS y_true, t.id AS other, t.label, round(list_dot_product(q.v, t.v), 6) AS sim FROM test q, train t)) WHERE rank <= {k})"
_LONG = "SELECT label, CAST(i - 1 AS INT) AS pos, round(v[i], 6) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM c)"


def _long(c):
    return c.select("label", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


query("centroid_mean", _E + _C + " " + _LONG)(lambda s, d: _long(S.centroids(_parts(s, d)[0])))
query("centroid_hard", _E + _refined_sql("hard", 0.15, 4.0) + _LONG)(lambda s, d: _long(S.centroids(_parts(s, d)[0], "hard")))
query("centroid_soft", _E + _refined_sql("soft", 0.15, 4.0) + _LONG)(lambda s, d: _long(S.centroids(_parts(s, d)[0], "soft")))


def _predicted(spark, d):
    train, test = _parts(spark, d)
    return S.best_label(S.centroid_scores(test, S.centroids(train)), "sim")


query("centroid_predict", _CENT + "SELECT * FROM cp")(_predicted)


def _softvote(spark, d, k=5, t=0.1):
    train, test = _parts(spark, d)
    return S.soft_votes(S.neighbours(test, train, k), F.lit(t))


_VOTES = _E + _N.format(k=5) + ", w AS (SELECT id, y_true, label, exp((sim - max(sim) OVER (PARTITION BY id)) / 0.1::DOUBLE) AS e FROM nb), v AS (SELECT id, y_true, label, round(sum(p), 6) AS score FROM (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM w) GROUP BY ALL)"
query("knn_softvote", _VOTES + " SELECT id, y_true, label AS y_pred, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM v) WHERE r = 1")(
    lambda s, d: S.best_label(_softvote(s, d), "score")
)
_SCORE = (
    ", conf AS (SELECT {keys}, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT {keys}, y_true AS label, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS c FROM conf UNION ALL SELECT {keys}, y_pred, 0, n, 0 FROM conf), "
    "g AS (SELECT {keys}, label, sum(t) AS t, sum(p) AS p, sum(c) AS c FROM b GROUP BY ALL) SELECT {keys}, round(avg(c / CAST(nullif(t, 0) AS DOUBLE)), 6) AS balanced_accuracy, round(avg(2.0::DOUBLE * c / CAST(t + p AS DOUBLE)), 6) AS macro_f1 FROM g GROUP BY ALL"
)
_GRID = ", ".join(f"({k}, {t}::DOUBLE)" for k in KS for t in TEMPERATURES)
_SWEEP = (
    _E + _N.format(k=max(KS)) + f", grid(k, t) AS (VALUES {_GRID}), w AS (SELECT k, t, id, y_true, label, exp((sim - max(sim) OVER (PARTITION BY k, t, id)) / t) AS e FROM nb, grid WHERE rank <= k), "
    "v AS (SELECT k, t, id, y_true, label, round(sum(x), 6) AS score FROM (SELECT *, e / sum(e) OVER (PARTITION BY k, t, id) AS x FROM w) GROUP BY ALL), "
    "p AS (SELECT k, t AS temperature, id, y_true, label AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY k, t, id ORDER BY score DESC, label) AS r FROM v) WHERE r = 1)"
)


def knn_sweep(spark, d, temperatures=TEMPERATURES):
    train, test = _parts(spark, d)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("temperature")) for k in KS for t in temperatures])).alias("g")
    found = S.neighbours(test, train, max(KS)).select("*", grid).select("*", "g.*").filter("rank <= k")
    return M.scores(S.best_label(S.soft_votes(found, F.col("temperature"), "k", "temperature"), "score", "k", "temperature"), "k", "temperature")


query("knn_sweep", _SWEEP + _SCORE.format(keys="k, temperature"))(knn_sweep)
_ORIGINAL_GRID = ", ".join(f"({k}, {t}::DOUBLE)" for k in KS for t in ORIGINAL_TEMPERATURES)
query("knn_sweep_original", (_SWEEP + _SCORE.format(keys="k, temperature")).replace(_GRID, _ORIGINAL_GRID))(lambda s, d: knn_sweep(s, d, ORIGINAL_TEMPERATURES))
query("sweep_best", f"SELECT * FROM ({_SWEEP + _SCORE.format(keys='k, temperature')}) ORDER BY macro_f1 DESC, k, temperature LIMIT 1")(lambda s, d: M.sweep_best(knn_sweep(s, d), "macro_f1", "k", "temperature"))


RATIOS, POWERS = (0.0, 0.1, 0.15, 0.2), (2.0, 4.0, 6.0, 8.0)
#: Power only where the mode uses it.
CENTROID_POINTS = [("hard", r, 1.0) for r in RATIOS] + [("soft", r, p) for r in RATIOS for p in POWERS]


def centroid_sweep(spark, d):
    """All points of mode, ratio and power."""
    train, test = _parts(spark, d)
    keys = ("mode", "ratio", "power")
    best = S.best_label(S.centroid_scores(test, S.centroid_grid(train, CENTROID_POINTS), *keys), "sim", *keys)
    return M.scores(best, *keys)


def _sweep_part(mode, ratio, power):
    return f"SELECT '{mode}' AS mode, {ratio}::DOUBLE AS ratio, {power}::DOUBLE AS power, y_true, y_pred FROM ({_E + _refined_sql(mode, ratio, power) + _SCORED} SELECT * FROM cp)"


query("centroid_sweep", "WITH p AS (" + " UNION ALL ".join(_sweep_part(*x) for x in CENTROID_POINTS) + ")" + _SCORE.format(keys="mode, ratio, power"))(centroid_sweep)


def _ensemble(spark, d):
    train, test = _parts(spark, d)
    grid = F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha")
    both = S.ensemble_scores(S.centroid_scores(test, S.centroids(train)), S.soft_votes(S.neighbours(test, train, 5), F.lit(0.1)))
    mixed = both.select("*", grid).withColumn("score", F.round(F.col("alpha") * F.col("c") + (1 - F.col("alpha")) * F.col("nn"), 6))
    return S.best_label(mixed, "score", "alpha")


_spread = "coalesce(({x} - min({x}) OVER (PARTITION BY id)) / nullif(max({x}) OVER (PARTITION BY id) - min({x}) OVER (PARTITION BY id), 0), 0)"
_ENS = (
    _VOTES + ", " + _C + _SCORED.rstrip() + ", j AS (SELECT s.id, s.y_true, s.label, s.sim, coalesce(v.score, 0) AS nn0 FROM s LEFT JOIN v USING (id, label)), "
    f"m AS (SELECT id, y_true, label, {_spread.format(x='sim')} AS c, {_spread.format(x='nn0')} AS nn FROM j), "
    f"a AS (SELECT *, round(alpha * c + (1 - alpha) * nn, 6) AS score FROM m, (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha)), "
    "p AS (SELECT alpha, id, y_true, label AS y_pred, score FROM (SELECT *, row_number() OVER (PARTITION BY alpha, id ORDER BY score DESC, label) AS r FROM a) WHERE r = 1)"
)
query("centroid_nn", _ENS + " SELECT id, y_true, y_pred, score FROM p WHERE alpha = 0.6::DOUBLE")(lambda s, d: _ensemble(s, d).filter("alpha = 0.6D").drop("alpha"))
query("centroid_nn_sweep", _ENS + _SCORE.format(keys="alpha"))(lambda s, d: M.scores(_ensemble(s, d), "alpha"))
query(
    "cluster_exemplars",
    _E + _mean_sql("c1", "e", "1.0::DOUBLE") + "r AS (SELECT e.label, e.id, round(list_dot_product(e.v, c1.v), 6) AS sim FROM e JOIN c1 USING (label)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS INT) AS rank FROM r) WHERE rank <= 7",
)(lambda s, d: _exemplars(_rows(s, d)))


def _exemplars(rows):
    c = S.centroids(rows).withColumnRenamed("v", "c")
    sim = rows.join(c, "label").select("label", "id", F.round(S.dot(F.col("v"), F.col("c")), 6).alias("sim"))
    return sim.withColumn("rank", F.expr("row_number() OVER (PARTITION BY label ORDER BY sim DESC, id)")).filter("rank <= 7")


_CLASS = (
    _CENT + ", conf AS (SELECT y_true, y_pred, count(*) AS n FROM cp GROUP BY ALL), b AS (SELECT y_true AS label, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS c FROM conf UNION ALL SELECT y_pred, 0, n, 0 FROM conf), "
    "g AS (SELECT label, sum(t) AS t, sum(p) AS p, sum(c) AS c FROM b GROUP BY label) "
)
query("metric_balanced_accuracy", _CLASS + "SELECT round(avg(c / CAST(t AS DOUBLE)), 6) AS balanced_accuracy FROM g WHERE t > 0")(lambda s, d: M.balanced_accuracy(_predicted(s, d)))
query("metric_macro_f1", _CLASS + "SELECT round(avg(2.0::DOUBLE * c / CAST(t + p AS DOUBLE)), 6) AS macro_f1 FROM g")(lambda s, d: M.macro_f1(_predicted(s, d)))
query("metric_per_class_f1", _CLASS + "SELECT label, CAST(t AS BIGINT) AS n_true, round(2.0::DOUBLE * c / CAST(t + p AS DOUBLE), 6) AS f1 FROM g")(lambda s, d: M.per_class_f1(_predicted(s, d)).drop("_f1"))
query("metric_weighted_f1", _CLASS + "SELECT round(sum(c) / CAST(sum(t) AS DOUBLE), 6) AS accuracy, round(sum(2.0::DOUBLE * c / CAST(t + p AS DOUBLE) * t) / CAST(sum(t) AS DOUBLE), 6) AS weighted_f1 FROM g")(
    lambda s, d: M.weighted_f1(_predicted(s, d))
)


def leaderboard(spark, d):
    swept = knn_sweep(spark, d).withColumn("model", F.concat(F.lit("knn-"), F.col("k").cast("string"), F.lit("-"), F.round(F.col("temperature") * 100).cast("int").cast("string")))
    return M.leaderboard(swept.select("model", "balanced_accuracy", "macro_f1"), "macro_f1", "balanced_accuracy")


query(
    "leaderboard",
    f"SELECT model, balanced_accuracy, macro_f1, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, balanced_accuracy DESC, model) AS rank FROM (SELECT 'knn-' || k || '-' || CAST(round(temperature * 100) AS INT) AS model, balanced_accuracy, macro_f1 FROM ({_SWEEP + _SCORE.format(keys='k, temperature')}))) WHERE rank <= 10",
)(leaderboard)
# candidates of a row of train are the augmented rows made from it
_CANDS = (
    "SELECT a.train_row_id AS source_id, a.row_id AS cand_id, round(a.cosine_sim, 6) AS sim, CAST((a.row_id * 2654435761) % 1000 AS DOUBLE) AS perplexity, round(length(a.text) / CAST(length(t.text) AS DOUBLE), 6) AS ratio "
    "FROM train_augmented a JOIN train t ON t.row_id = a.train_row_id WHERE a.augmentation_type IS NOT NULL AND a.cosine_sim IS NOT NULL AND length(a.text) > 0 AND length(t.text) > 0"
)
_WINDOW, _LENGTHS = (0.8, 0.95), (0.5, 1.3)


def _cands(spark, d):
    made = table(spark, d, "train_augmented").filter("augmentation_type IS NOT NULL AND cosine_sim IS NOT NULL AND length(text) > 0")
    source = table(spark, d, "train").filter("length(text) > 0").select(F.col("row_id").alias("source_id"), F.length("text").alias("_n"))
    cands = made.select(F.col("train_row_id").alias("source_id"), F.col("row_id").alias("cand_id"), F.round("cosine_sim", 6).alias("sim"), F.length("text").alias("_m")).join(source, "source_id")
    return cands.select("source_id", "cand_id", "sim", (F.col("cand_id") * F.lit(2654435761) % 1000).cast("double").alias("perplexity"), F.round(F.col("_m") / F.col("_n"), 6).alias("ratio"))


def _chosen_sql(order: str) -> str:
    return f"SELECT source_id, cand_id, sim, perplexity, ratio FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {order}, sim DESC, cand_id) AS r FROM ({_CANDS})) WHERE r = 1"


_INSIDE = f"sim BETWEEN {_WINDOW[0]} AND {_WINDOW[1]}"
query("choose_candidate", _chosen_sql(f"{_INSIDE} DESC"))(lambda s, d: S.choose_candidate(_cands(s, d), *_WINDOW))
query("choose_candidate_bt", _chosen_sql(f"{_INSIDE} DESC, CASE WHEN {_INSIDE} THEN perplexity END NULLS LAST"))(lambda s, d: S.choose_candidate_bt(_cands(s, d), *_WINDOW))
query("choose_candidate_lengths", _chosen_sql(f"ratio BETWEEN {_LENGTHS[0]} AND {_LENGTHS[1]} DESC, {_INSIDE} DESC"))(lambda s, d: S.choose_candidate(_cands(s, d), *_WINDOW, _LENGTHS))


def _runs(spark, d):
    """Mean and deviation of a metric over runs: those of a number of neighbours are its temperatures."""
    return M.mean_and_deviation(knn_sweep(spark, d, ORIGINAL_TEMPERATURES), "macro_f1", "k")


query(
    "runs_mean_std",
    f"SELECT k, count(*) AS runs, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS deviation FROM ({(_SWEEP + _SCORE.format(keys='k, temperature')).replace(_GRID, _ORIGINAL_GRID)}) GROUP BY k",
)(_runs)
