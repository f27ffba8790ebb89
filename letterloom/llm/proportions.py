"""Problem 2: a sample whose categories have given shares.

Rows are counted in the cells of all margins (a bounded table), iterative proportional fitting turns the target shares
of every margin into one weight a cell, and each row gets the exponential key -ln(u) / weight with u from a hash of its
id, so that the smallest keys of a label form a weighted sample without replacement. How many a label gives follows from
its share, then minimums are repaired at the cost of labels that have more than theirs. The smallest keys are found by
counts over fixed-width key bins; only rows of the one bin where a label's sample ends are ranked.

The report counts the rows that the sample really has: a label is short if all its rows are drawn and they are fewer
than its share or its minimum asks for.

Defined cases: labels are compared without case, white space and punctuation; null, blank and unlisted labels count in
the total but are never drawn; a label with fewer rows than wanted gives all it has and is reported; equal keys go to
the smaller id; an empty table gives an empty sample and a report of zeros. Targets that name one label twice are added
up, with the larger minimum, under the first name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TARGETS = 10_000
KEY_BINS = 1024


def bare_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"(?U)[\s\p{P}]+", "")


def length_band(text: Column) -> Column:
    """Second margin: 0 for null texts, then a band for each doubling of the length from 256 characters on."""
    size = F.length(text)
    return F.when(size.isNull(), 0).otherwise(F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.log2(size / F.lit(128.0)))))).cast("int")


def band_targets(bands: np.ndarray, size: float, wanted: dict[int, float] | None) -> np.ndarray:
    """Second margin: wanted shares by length band, or those of the rows, without texts that are missing where others can
    take their place."""
    share = bands.astype(float)
    if wanted is not None:
        share = np.array([wanted.get(i, 0.0) for i in range(len(bands))], float)
    elif share[1:].sum():
        share[0] = 0
    return share / max(1e-12, share.sum()) * size


def rake(counts: np.ndarray, margins: list[np.ndarray], rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Expected draws of each cell whose sums along every axis follow that axis's margin as far as rows allow.

    counts has one axis for each margin. A cell never expects more than its rows.
    """
    draws = counts.astype(float) * (margins[0].sum() / max(1.0, counts.sum()))
    for _ in range(rounds):
        before = draws
        for axis, wanted in enumerate(margins):
            others = tuple(a for a in range(counts.ndim) if a != axis)
            have = draws.sum(axis=others)
            factor = np.divide(wanted, have, out=np.zeros_like(have), where=have > 0)
            draws = np.minimum(counts, draws * np.expand_dims(factor, others))
        if np.abs(draws - before).max(initial=0.0) < tol:
            break
    return draws


def quotas(available: np.ndarray, wanted: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Whole rows to draw of each label: shares by largest remainder, minimums repaired from the largest surpluses."""
    floor = np.minimum(available, least)
    whole = np.floor(wanted).astype(np.int64)
    spare = min(len(wanted), max(0, min(size, round(wanted.sum())) - whole.sum()))
    whole[np.argsort(-(wanted - whole), kind="stable")[:spare]] += 1
    quota = np.minimum(available, whole)
    raised = np.maximum(quota, floor)
    debt = int((raised - quota).sum())
    quota = raised
    while debt > 0:  # at most MAX_TARGETS passes: every pass takes from all that have a surplus
        # what a label lacks already is never made up at its own cost
        surplus = np.where(available < wanted, 0, np.maximum(0, quota - np.maximum(floor, np.ceil(wanted * 0.95).astype(np.int64))))
        total = surplus.sum()
        if not total:
            break
        take = np.minimum(surplus, np.ceil(surplus * min(1.0, debt / total)).astype(np.int64))
        order = np.argsort(-surplus, kind="stable")
        room = debt
        for i in order:
            t = min(int(take[i]), room)
            quota[i] -= t
            room -= t
        debt = room
    return quota


class ProportionalSample:
    """The sample and its report.

    sample: id, label (as written in the targets). report: label, available, wanted, min_rows, drawn, gap, short.
    """

    def __init__(self, rows: DataFrame, id_col: str, label_col: str, text_col: str, targets: DataFrame, fraction: float = 0.2, seed: int = 17, band_shares: dict[int, float] | None = None):
        self.spark = rows.sparkSession
        listed = targets.select("label", "target_share", "min_rows", bare_label(F.col("label")).alias("k")).limit(MAX_TARGETS + 1).collect()
        if len(listed) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        merged: dict[str, list] = {}
        for r in listed:
            if r["k"]:
                t = merged.setdefault(r["k"], [r["label"], 0.0, 0])
                t[1] += float(r["target_share"] or 0)
                t[2] = max(t[2], int(r["min_rows"] or 0))
        self.keys, self.targets = list(merged), list(merged.values())
        self.rows = rows.select(F.col(id_col).alias("id"), bare_label(F.col(label_col)).alias("k"), length_band(F.col(text_col)).alias("band"))
        self.seed, self.band_shares = seed, band_shares
        self._plan(fraction)

    def _plan(self, fraction: float) -> None:
        cells = self.rows.groupBy(F.when(F.col("k").isin(self.keys), F.col("k")).alias("k"), "band").count().collect()
        at = {k: i for i, k in enumerate(self.keys)}
        counts = np.zeros((len(self.keys), 9), np.int64)
        total, bands = 0, np.zeros(9)
        for r in cells:
            total += r["count"]
            bands[r["band"]] += r["count"]
            if r["k"] is not None:
                counts[at[r["k"]], r["band"]] += r["count"]
        self.size = total / (1 / fraction)
        share = np.array([t[1] for t in self.targets])
        self.available, self.least = counts.sum(axis=1), np.array([t[2] for t in self.targets], np.int64)
        self.wanted = share * self.size
        margins = [self.wanted, band_targets(bands, self.wanted.sum(), self.band_shares)]
        draws = rake(counts, margins) if len(self.keys) else counts
        self.weight = np.divide(draws, counts, out=np.zeros(counts.shape), where=counts > 0)
        self.quota = quotas(self.available, self.wanted, self.least, int(round(self.size)))

    def report(self) -> DataFrame:
        """The targets, at most MAX_TARGETS rows, joined with the counts of what the sample has."""
        rows = [(t[0], int(c), float(w), int(m)) for t, c, w, m in zip(self.targets, self.available, self.wanted, self.least)]
        listed = self.spark.createDataFrame(rows, "label string, available bigint, wanted double, min_rows bigint")
        drawn = self.sample().groupBy("label").agg(F.count(F.lit(1)).alias("drawn"))
        both = listed.join(drawn, "label", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
        gap = F.greatest(F.lit(0.0), F.greatest(F.col("wanted"), F.col("min_rows").cast("double")) - F.col("drawn"))
        exhausted = F.col("drawn") >= F.col("available")
        lacking = (F.col("drawn") < F.col("wanted")) | (F.col("drawn") < F.col("min_rows"))
        return both.select("label", "available", "wanted", "min_rows", "drawn", gap.alias("gap"), (exhausted & lacking).alias("short"))

    def sample(self) -> DataFrame:
        # cells and targets are at most MAX_TARGETS times nine rows, so these two tables may be broadcast
        cells = [(k, b, float(w)) for i, k in enumerate(self.keys) for b, w in enumerate(self.weight[i])]
        weights = F.broadcast(self.spark.createDataFrame(cells, "k string, band int, w double"))
        quota = F.broadcast(self.spark.createDataFrame([(k, t[0], int(q)) for k, t, q in zip(self.keys, self.targets, self.quota)], "k string, label string, quota bigint"))
        u = (F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        keyed = self.rows.join(weights, ["k", "band"]).withColumn("key", -F.log(u) / F.greatest("w", F.lit(1e-9)))
        keyed = keyed.withColumn("bin", F.floor(F.least(F.lit(KEY_BINS - 1.0), KEY_BINS * (1 - F.exp(-F.col("key") / 2)))).cast("int")).select("id", "k", "key", "bin")
        bins = keyed.groupBy("k", "bin").count().join(quota, "k")
        upto = bins.withColumn("upto", F.expr("sum(count) OVER (PARTITION BY k ORDER BY bin)"))
        # the first bin in which a label's draws reach its quota; labels with fewer rows have none and give all
        cut = upto.filter("upto >= quota").groupBy("k").agg(F.min_by(F.struct("bin", (F.col("quota") - F.col("upto") + F.col("count")).alias("rest")), "bin").alias("c"))
        cuts = F.broadcast(quota.join(cut, "k", "left").select("k", "label", F.col("c.bin").alias("cut"), F.col("c.rest").alias("rest")))
        marked = keyed.join(cuts, "k")
        sure = marked.filter("cut IS NULL OR bin < cut").select("id", "label")
        edge = marked.filter("bin = cut").withColumn("r", F.expr("row_number() OVER (PARTITION BY k ORDER BY key, id)"))
        return sure.unionByName(edge.filter("r <= rest").select("id", "label"))
