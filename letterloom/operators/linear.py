"""Linear classifiers over dense vectors by exact steps on sums: squared-hinge support vectors, calibration, the funnel.

Each step is one pass: every task adds up, for all classes at once, what its rows contribute to the normal equations, and
what is merged is bounded by classes times features squared (at most MOST_FEATURES). Nothing grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.operators import estimators, metrics
from letterloom.operators.profile import class_weights

MOST_FEATURES, MOST_CLASSES = 1024, 1000
#: Bins of the margins on which calibration curves are fitted.
BINS = 4096


def _rows(df: DataFrame, vec: str, label: str, weights: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(weights.withColumnRenamed("label", "_l")), df[label] == F.col("_l"))  # one row a class
    return joined.select(F.transform(vec, lambda x: x.cast("double")).alias("v"), F.col(label).alias("y"), F.col("weight").alias("w"))


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all rows of what add(v, y, w) gives, an array of `size` numbers, a partial sum a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(size), False
        for pdf in batches:
            if len(pdf):
                total += add(np.stack(pdf["v"].to_numpy()).astype(float), pdf["y"].to_numpy(), pdf["w"].to_numpy())
                seen = True
        if seen:
            yield pd.DataFrame({"at": np.arange(0, size, 4096), "part": [total[i : i + 4096] for i in range(0, size, 4096)]})

    parts = rows.mapInPandas(run, "at bigint, part array<double>").select("at", F.posexplode("part").alias("i", "x"))
    total = np.zeros(size)
    summed = parts.groupBy((F.col("at") + F.col("i")).alias("at")).agg(F.sum("x").alias("x")).toArrow()
    total[summed.column("at").to_numpy()] = summed.column("x").to_numpy()
    return total


def _checked(train: DataFrame, vec: str, label: str) -> tuple[int, list]:
    labels = [r[0] for r in train.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).limit(MOST_CLASSES + 1).collect()]
    dims = train.select(F.max(F.size(vec))).first()[0] or 0
    if dims > MOST_FEATURES or len(labels) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_FEATURES} features or {MOST_CLASSES} classes")
    return dims, labels


def fit_svc(train: DataFrame, vec: str, label: str, c: float = 1.0, l1: bool = False, balanced: bool = True, steps: int = 12, tol: float = 1e-4) -> tuple[np.ndarray, list]:
    """Weights (features + 1 by classes) and labels of one-against-rest squared-hinge classifiers, by Newton steps.

    The penalty is half the squared length of the weights, the intercept included as a feature of ones, or with l1 the sum
    of their absolute values; c weighs the losses. Rows without a label take no part.
    """
    dims, labels = _checked(train, vec, label)
    d, k, at = dims + 1, len(labels), {x: i for i, x in enumerate(labels)}
    weights = class_weights(train, label) if balanced else train.select(F.col(label).alias("label"), F.lit(1.0).alias("weight")).distinct()
    # read again by every step
    rows = _rows(train.filter(F.col(label).isNotNull()), vec, label, weights).persist()
    beta = np.zeros((d, k))

    def add(v, y, w):
        x = np.hstack([v, np.ones((len(v), 1))])
        sign = -np.ones((len(v), k))
        sign[np.arange(len(v)), [at[i] for i in y]] = 1
        active = (sign * (x @ beta) < 1) * w[:, None]
        hess = np.stack([x.T @ (active[:, j, None] * x) for j in range(k)])
        return np.concatenate([hess.ravel(), (x.T @ (active * sign)).ravel(), [(active * (1 - sign * (x @ beta)) ** 2).sum()]])

    for _ in range(steps if k else 0):
        total = _summed(rows, k * d * d + d * k + 1, add)
        hess, pull = 2 * c * total[: k * d * d].reshape(k, d, d), 2 * c * total[k * d * d : -1].reshape(d, k)
        new = np.column_stack([_least(hess[j], pull[:, j], beta[:, j], l1) for j in range(k)])
        moved = np.abs(new - beta).max() / max(1e-9, np.abs(new).max())
        beta = new
        if moved < tol:
            break
    rows.unpersist()
    return beta, labels


def _least(hess: np.ndarray, pull: np.ndarray, start: np.ndarray, l1: bool) -> np.ndarray:
    """Minimum of half b'Hb - p'b plus the penalty of b."""
    if not l1:
        return np.linalg.solve(hess + np.eye(len(pull)), pull)
    b = start.copy()
    diagonal = np.maximum(np.diag(hess), 1e-12)
    for _ in range(200):
        before = b.copy()
        for i in range(len(b)):
            rest = pull[i] - hess[i] @ b + hess[i, i] * b[i]
            b[i] = np.sign(rest) * max(0.0, abs(rest) - 1) / diagonal[i]
        if np.abs(b - before).max() < 1e-6 * max(1.0, np.abs(b).max()):
            break
    return b


def _mapped(df: DataFrame, vec: str, label: str, out: str, kind: str, of) -> DataFrame:
    """id, y_true and what `of` gives for a matrix of vectors."""
    rows = df.select("id", F.col(label).alias("y_true"), F.transform(vec, lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "y_true": pdf["y_true"], out: list(of(np.stack(pdf["v"].to_numpy())))})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"id {kinds['id']}, y_true {kinds['y_true']}, {out} {kind}")


def margins(df: DataFrame, vec: str, model: tuple[np.ndarray, list], label: str) -> DataFrame:
    """id, y_true, margins: the margin of every class."""
    beta = model[0]
    return _mapped(df, vec, label, "margins", "array<double>", lambda x: x @ beta[:-1] + beta[-1])


def predicted(df: DataFrame, vec: str, model: tuple[np.ndarray, list], label: str) -> DataFrame:
    """id, y_true, y_pred: the class with the greatest margin, the first of equal ones."""
    beta, labels = model
    return _mapped(df, vec, label, "y_pred", df.schema[label].dataType.simpleString(), lambda x: [labels[i] for i in (x @ beta[:-1] + beta[-1]).argmax(1)])


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int) -> DataFrame:
    """df with fold: rows of a label are dealt out in the order of a hash; counted in bins of it, so that no task ranks a
    whole label."""
    from letterloom.operators.relational import ranked_within

    return ranked_within(df, id_col, label, 3, "_rank").withColumn("fold", F.pmod("_rank", F.lit(folds)).cast("int")).drop("_rank")


def platt(score: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(a * score + b)), with targets drawn in from 0 and 1, by Newton steps."""
    p, n = positive.sum(), (total - positive).sum()
    high, low = (p + 1) / (p + 2), 1 / (n + 2)
    t = positive * high + (total - positive) * low
    a, b = 0.0, float(np.log((n + 1) / (p + 1)))
    loss = lambda a, b: float((t * (a * score + b) + total * np.logaddexp(0, -(a * score + b))).sum())
    for _ in range(100):
        q = 1 / (1 + np.exp(np.clip(a * score + b, -500, 500)))
        g = np.array([((t - total * q) * score).sum(), (t - total * q).sum()])
        h = total * q * (1 - q)
        hess = np.array([[(h * score * score).sum(), (h * score).sum()], [(h * score).sum(), h.sum()]]) + 1e-12 * np.eye(2)
        step, size, now = np.linalg.solve(hess, g), 1.0, loss(a, b)
        while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(g).max() < 1e-5:
            break
    return a, b


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing rates nearest to positive / total, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for p, n in zip(positive, total):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, m2 = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += n2
            blocks[-1][2] += m2
    return np.concatenate([np.full(int(m), p / n) for p, n, m in blocks]) if blocks else np.zeros(0)


def calibrated_svc(train: DataFrame, test: DataFrame, vec: str, label: str, method: str = "sigmoid", c: float = 1.0, folds: int = 3) -> DataFrame:
    """id, y_true, y_pred: per fold one-against-rest support vectors on the other folds and, on the fold itself, a curve
    from margins to probabilities for every class; the folds' probabilities are scaled to sum to one and averaged.

    Curves are fitted on counts in BINS bins of the margins of a class. A class of fewer than two rows is an error.
    """
    smallest = train.groupBy(label).count().agg(F.min("count")).first()[0]
    if smallest is None or smallest < 2:
        raise ValueError("a class has fewer than two rows")
    folds = max(2, min(folds, smallest))
    dealt = stratified_folds(train, "id", label, folds)
    curves, models = [], []
    for f in range(folds):
        model = fit_svc(dealt.filter(F.col("fold") != f), vec, label, c)
        held = margins(dealt.filter(F.col("fold") == f), vec, model, label).select(F.col("y_true").alias("y"), F.posexplode("margins").alias("k", "m"))
        names = F.array(*[F.lit(x) for x in model[1]])
        hit = (F.get(names, F.col("k")) == F.col("y")).cast("int")
        span = held.agg(F.min("m").alias("low"), F.max("m").alias("high")).first()
        low, width = span["low"], max(1e-12, (span["high"] - span["low"]) / BINS)
        counts = held.groupBy("k", F.least(F.lit(BINS - 1), F.floor((F.col("m") - low) / width)).alias("bin")).agg(F.sum(hit).alias("p"), F.count(F.lit(1)).alias("n"), F.avg("m").alias("m"))
        table, curve = counts.orderBy("k", "bin").toPandas(), {}
        for k, part in table.groupby("k"):
            m, p, n = (part[x].to_numpy(float) for x in ("m", "p", "n"))
            curve[int(k)] = ("sigmoid", *platt(m, p, n)) if method == "sigmoid" else ("isotonic", m, isotonic(p, n))
        curves.append(curve)
        models.append(model)

    def probabilities(scores: np.ndarray, curve: dict) -> np.ndarray:
        out = np.zeros_like(scores)
        for k, fitted in curve.items():
            out[:, k] = 1 / (1 + np.exp(np.clip(fitted[1] * scores[:, k] + fitted[2], -500, 500))) if fitted[0] == "sigmoid" else np.interp(scores[:, k], fitted[1], fitted[2])
        total = out.sum(1, keepdims=True)
        return np.divide(out, total, out=np.full_like(out, 1 / out.shape[1]), where=total > 0)

    labels = sorted({x for _, names in models for x in names})

    def best(x: np.ndarray) -> list:
        total = np.zeros((len(x), len(labels)))
        for (beta, names), curve in zip(models, curves):
            total[:, [labels.index(n) for n in names]] += probabilities(x @ beta[:-1] + beta[-1], curve)
        return [labels[i] for i in total.argmax(1)]

    return _mapped(test, vec, label, "y_pred", test.schema[label].dataType.simpleString(), best)


def ridge_predicted(train: DataFrame, test: DataFrame, vec: str, label: str) -> DataFrame:
    return predicted(test, vec, estimators.ridge(train, vec, label), label)


def funnel(sources: dict[str, tuple[DataFrame, DataFrame]], vec: str, label: str, grid: tuple[float, ...], c_kinds: tuple[str, ...] = ("svc", "svc_l1", "logreg")) -> DataFrame:
    """model, source, c, balanced_accuracy, macro_f1, error, rank: every model at every c on every (train, test) source,
    then the best SVC of a source calibrated by sigmoid and isotonic, and ridge; a fit that fails is a row with its error.

    The fits are a fixed number of small jobs and their scores one row each.
    """
    spark = next(iter(sources.values()))[0].sparkSession
    out: list[tuple] = []

    def scored(model: str, source: str, c: float | None, make) -> float | None:
        try:
            row = metrics.scores(make()).first()
        except ValueError as e:
            out.append((model, source, c, None, None, str(e)))
            return None
        out.append((model, source, c, row["balanced_accuracy"], row["macro_f1"], None))
        return row["balanced_accuracy"]

    def logistic(train: DataFrame, test: DataFrame, c: float) -> DataFrame:
        model = estimators.fit(estimators.with_features(train, vec, label), "logreg", c)
        made = model.transform(estimators.with_features(test, vec, label))
        return made.select("id", F.col(label).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))

    for source, (train, test) in sources.items():
        best: tuple[float, float] | None = None
        for c in grid:
            for kind in c_kinds:
                if kind == "logreg":
                    scored(kind, source, c, lambda: logistic(train, test, c))  # noqa: B023
                    continue
                got = scored(kind, source, c, lambda: predicted(test, vec, fit_svc(train, vec, label, c, kind == "svc_l1"), label))  # noqa: B023
                if kind == "svc" and got is not None and (best is None or got > best[0]):
                    best = (got, c)
        for method in ("sigmoid", "isotonic"):
            if best:
                scored(f"svc_{method}", source, best[1], lambda: calibrated_svc(train, test, vec, label, method, best[1]))  # noqa: B023
        scored("ridge", source, None, lambda: ridge_predicted(train, test, vec, label))  # noqa: B023
    table = spark.createDataFrame(out, "model string, source string, c double, balanced_accuracy double, macro_f1 double, error string")
    return table.withColumn("rank", F.expr("row_number() OVER (ORDER BY balanced_accuracy DESC NULLS LAST, model, source, c)"))


def multinomial_nb(train: DataFrame, test: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """doc_id, y_pred of documents (doc_id, term, weight), fitted on train (likewise) with labels (doc_id, label).

    A term that a label has never had adds log(alpha), which is the same for all labels when alpha is one; so a document
    meets only the labels that have its terms, and what all its terms have in common is added by label.
    """
    if alpha != 1.0:
        raise ValueError("only alpha = 1 is sparse")
    each = train.join(labels, "doc_id").groupBy("label", "term").agg(F.sum("weight").alias("s"))
    size = F.broadcast(train.agg(F.count_distinct("term").alias("v")))
    prior = labels.join(train.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("label").agg(F.sum("s").alias("t")).join(prior, "label").join(size)
    total = F.broadcast(total.select("label", F.log("n").alias("prior"), F.log(F.col("t") + F.col("v")).alias("log_t")))  # a row a label
    known = test.join(each.select("term").distinct(), "term", "left_semi")
    mass = known.groupBy("doc_id").agg(F.sum("weight").alias("mass"))
    hits = known.join(each, "term").groupBy("doc_id", "label").agg(F.sum(F.col("weight") * F.log1p("s")).alias("hit"))
    docs = test.select("doc_id").distinct().join(mass, "doc_id", "left")
    scores = docs.join(total).join(hits, ["doc_id", "label"], "left")
    score = F.round(F.col("prior") + F.coalesce("hit", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0)) * F.col("log_t"), 6)
    ranked = scores.select("doc_id", "label", score.alias("score"))
    top = ranked.groupBy("doc_id").agg(F.max("score").alias("score")).join(ranked, ["doc_id", "score"])
    return top.groupBy("doc_id").agg(F.min("label").alias("y_pred"))
