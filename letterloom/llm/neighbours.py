"""Problem 3: the most similar vectors of every vector.

Unit vectors are projected by Gaussian (2-stable) matrices onto a few dimensions: the projected squared distance of two
vectors is their squared distance times a chi-square variable. Several independent projections are each indexed by a
kd-tree; its upper levels, fitted on a bounded sample, send every row to one leaf, and within a leaf boxes of a small
kd-tree are visited in order of their projected distance. Their vectors are verified by the full cosine until the
chi-square test says that a vector nearer than the k-th one found would, with the given confidence, have been met.

Vectors travel to the leaves in half precision, which changes a cosine by less than HALF_ERROR; found pairs that this
could move over the bound or over the k-th place get their cosine from the whole vectors. Equal vectors are collapsed
first and never compared with each other. Results of the trees are merged by id. A pair parts more often in a deeper
tree, so the number of trees grows with the depth.

Defined cases: rows with a null vector, a null, NaN or infinite entry, only zeros or another length than most take no
part; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import join_by_hot_key, scratch, written

#: Rows at most on which the upper levels of the trees are fitted. Every row is indexed.
FITTED_ROWS = 32_768
PROJECTED = 8
#: Bound of the error of a cosine of two unit vectors in half precision: 2**-11 a vector, and what is below its range.
HALF_ERROR = 0.0011
#: A leaf keeps so many times the k neighbours asked for, as half precision may put the wrong ones first; where still more
#: are as near as that error, any of them may come out.
SPARE = 2


def chi_square_quantile(p: float, m: int) -> float:
    """Wilson and Hilferty's approximation, within a percent for m >= 4 and p >= 0.5."""
    c = 2 / (9 * m)
    return m * (1 - c + NormalDist().inv_cdf(p) * c**0.5) ** 3


def projections(dims: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dims, PROJECTED)).astype(np.float32)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, digest, unit: usable rows with the float32 bytes of the unit vector."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keep, units, digests = [], [], []
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            for i, (size, end) in enumerate(zip(sizes, ends)):
                v = flat[end - size : end].astype(np.float64)
                norm = np.sqrt(v @ v) if size else 0.0
                if norm > 0 and np.isfinite(norm):
                    u = (v / norm).astype(np.float32).tobytes()
                    keep.append(i)
                    units.append(u)
                    digests.append(hashlib.blake2b(u, digest_size=16).digest())
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["id", "digest", "unit"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return rows.filter("v IS NOT NULL").mapInArrow(run, "id bigint, digest binary, unit binary")


def fit_cuts(sample: np.ndarray, depth: int) -> list[np.ndarray]:
    """Medians of the upper levels: level l has 2**l cuts, all along dimension l modulo the number of dimensions."""
    cuts, leaf = [], np.zeros(len(sample), np.int64)
    for level in range(depth):
        x = sample[:, level % sample.shape[1]]
        order = np.lexsort((x, leaf))
        starts = np.searchsorted(leaf[order], np.arange(1 << level), "left")
        ends = np.searchsorted(leaf[order], np.arange(1 << level), "right")
        mid = order[np.minimum((starts + ends) // 2, len(order) - 1)]
        cut = np.where(ends > starts, x[mid], 0).astype(np.float32)
        cuts.append(cut)
        leaf = leaf * 2 + (x >= cut[leaf])
    return cuts


def leaf_of(points: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    leaf = np.zeros(len(points), np.int64)
    for level, cut in enumerate(cuts):
        leaf = leaf * 2 + (points[:, level % points.shape[1]] >= cut[leaf])
    return leaf


def search_leaf(units: np.ndarray, low: np.ndarray, k: int, least_cosine: float, confidence: float, box_rows: int = 64):
    """For every row its k nearest other rows of the leaf as (row, neighbour, cosine) arrays."""
    n = len(units)
    boxes = [np.arange(n)]
    while len(boxes[0]) > box_rows:  # halve every box along its widest side
        halves = []
        for b in boxes:
            x = low[b]
            side = int(np.argmax(x.max(0) - x.min(0)))
            order = np.argpartition(x[:, side], len(b) // 2)
            halves += [b[order[: len(b) // 2]], b[order[len(b) // 2 :]]]
        boxes = halves
    floor_of = np.array([low[b].min(0) for b in boxes])
    top_of = np.array([low[b].max(0) for b in boxes])
    quantile = chi_square_quantile(confidence, low.shape[1])
    farthest = 2 - 2 * least_cosine
    out_a, out_b, out_c = [], [], []
    for i, box in enumerate(boxes):
        gap = np.maximum(0, np.maximum(floor_of - top_of[i], floor_of[i] - top_of))
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable")
        best = np.full((len(box), k), -2.0, np.float32)
        who = np.full((len(box), k), -1, np.int64)
        at, step = 0, 4
        while at < len(order):
            kth = np.minimum(farthest, 2 - 2 * best[:, -1])
            if gap[order[at]] > quantile * kth.max():
                break
            rows = np.concatenate([boxes[j] for j in order[at : at + step]])
            at, step = at + step, step * 2
            cos = units[box] @ units[rows].T
            cos[box[:, None] == rows[None, :]] = -2
            both, names = np.hstack([best, cos]), np.hstack([who, np.broadcast_to(rows, cos.shape)])
            if both.shape[1] > k:
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                best_order = np.argsort(-best, axis=1, kind="stable")
                best, who = np.take_along_axis(best, best_order, 1), np.take_along_axis(who, best_order, 1)
        good = (who >= 0) & (best >= least_cosine)
        row, col = np.nonzero(good)
        out_a.append(box[row])
        out_b.append(who[row, col])
        out_c.append(best[row, col])
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_c)


def trees_for(depth: int) -> int:
    """Six trees up to five levels and two more for each further one: a pair parts more often in a deeper tree."""
    return 6 + 2 * max(0, depth - 5)


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 5, least_cosine: float = -1.0, trees: int | None = None, leaf_rows: int = 4096, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """id, other, cosine: for every usable row up to k most similar rows with at least least_cosine.

    least_cosine bounds the search radius: without it the test hardly ever ends early for vectors that have no near ones.
    """
    spark = df.sparkSession
    units = written(unit_vectors(df, id_col, vec_col), "units")
    size = units.agg(F.max(F.length("unit"))).first()[0]
    if size is None:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    units = units.filter(F.length("unit") == size)
    dims = size // 4
    # of a group of equal vectors only the k + 1 smallest ids can be anyone's neighbours
    groups = units.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups, "vector-groups")
    total = groups.count()
    repeated = groups.filter("copies > 1")
    is_rep = groups.select(F.col("rep").alias("id"))
    reps = units.select("id", "unit").join(is_rep, "id", "left_semi")

    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf_rows))))
    trees = trees or trees_for(depth)
    matrices = projections(dims, trees, seed)
    share = min(1.0, FITTED_ROWS / max(1, total))
    sample = units.filter(F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sampled = np.frombuffer(b"".join(r[0] for r in sample.select("unit").limit(FITTED_ROWS).collect()), np.float32).reshape(-1, dims)
    cuts = [fit_cuts(sampled @ m, depth) for m in matrices]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dims)
            halves = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
            for t, (m, c) in enumerate(zip(matrices, cuts)):
                leaf = leaf_of(x @ m, c) * trees + t
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), halves], ["leaf", "id", "unit"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        x = np.frombuffer(b"".join(pdf["unit"]), np.float16).reshape(-1, dims).astype(np.float32)
        m = matrices[int(pdf["leaf"].iloc[0]) % trees]
        a, b, c = search_leaf(x, x @ m, SPARE * k, least_cosine - HALF_ERROR, confidence)
        return pd.DataFrame({"id": ids[a], "other": ids[b], "cosine": c.astype(np.float64)})

    routed = reps.mapInArrow(route, "leaf bigint, id bigint, unit binary")
    found = routed.groupBy("leaf").applyInPandas(search, "id bigint, other bigint, cosine double")
    found = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    found = _top(_exact(written(_near_top(found, k), "near-top"), reps, k, least_cosine), k)
    if not repeated.limit(1).count():
        return found
    return _top(_with_copies(units, written(found, "nearest"), repeated, k), k)


def _near_top(found: DataFrame, k: int) -> DataFrame:
    """id, other, cosine, last of the k best and of all that the error of half precision keeps as near; last is the k-th
    cosine. A row has at most SPARE * k pairs from each tree."""
    order = "OVER (PARTITION BY id ORDER BY cosine DESC, other)"
    ranked = found.withColumn("_r", F.expr(f"row_number() {order}"))
    last = ranked.withColumn("last", F.expr(f"min(CASE WHEN _r <= {k} THEN cosine END) OVER (PARTITION BY id)"))
    return last.filter((F.col("_r") <= k) | (F.col("cosine") >= F.col("last") - 2 * HALF_ERROR)).drop("_r")


def _exact(near: DataFrame, units: DataFrame, k: int, least_cosine: float) -> DataFrame:
    """near with cosines of whole vectors where half precision leaves it open which side of a bound they are on."""
    more = F.count(F.lit(1)).over(Window.partitionBy("id")) > k
    doubt = (F.abs(F.col("cosine") - least_cosine) <= HALF_ERROR) | (more & (F.abs(F.col("cosine") - F.col("last")) <= 2 * HALF_ERROR))
    marked = near.withColumn("doubt", doubt).drop("last")
    one, other = units.select("id", F.col("unit").alias("x")), units.select(F.col("id").alias("other"), F.col("unit").alias("y"))
    pairs = marked.filter("doubt").select("id", "other").join(one, "id").join(other, "other").select("id", "other", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 1)) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((x * y).sum(1))], ["id", "other", "cosine"])

    sure = marked.filter("NOT doubt").select("id", "other", "cosine")
    return sure.unionByName(pairs.mapInArrow(run, "id bigint, other bigint, cosine double").filter(F.col("cosine") >= least_cosine))


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("_r", F.expr("row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other)"))
    return ranked.filter(f"_r <= {k}").drop("_r")


def _with_copies(units: DataFrame, found: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """Found pairs of representatives, spread over the copies of both sides.

    On the neighbour's side the k + 1 smallest ids of a group suffice, on the row's own side every copy gets its rows.
    """
    total = units.count()
    members = join_by_hot_key(units.select("id", "digest"), repeated, "digest", "copies", total).select("id", "rep", "copies")
    members = written(members, "vector-members")
    first = _first_ids(members, k + 1)
    as_other = found.join(first.withColumnRenamed("rep", "other"), "other", "left")
    spread = as_other.select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cosine")
    own = first.select(F.col("rep").alias("id"), F.explode("ids").alias("other"), F.lit(1.0).alias("cosine"))
    lists = spread.unionByName(own)
    ranked = lists.withColumn("_r", F.expr("row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other)")).filter(f"_r <= {k + 1}").drop("_r")
    sizes = members.groupBy("rep").agg(F.first("copies").alias("copies"))
    packed = ranked.groupBy(F.col("id").alias("rep")).agg(F.collect_list(F.struct("other", "cosine")).alias("list"))
    packed = packed.join(sizes, "rep", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    single = packed.filter("copies = 1").select(F.col("rep").alias("id"), F.inline("list"))
    copied = join_by_hot_key(members.select("id", "rep"), packed.filter("copies > 1"), "rep", "copies", total).select("id", F.inline("list"))
    return single.unionByName(copied).filter("id <> other")


def _first_ids(members: DataFrame, n: int) -> DataFrame:
    """rep, ids: the n smallest ids of each group, first within slices of a group and then over the slices."""
    sliced = members.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    ranked = sliced.withColumn("_r", F.expr("row_number() OVER (PARTITION BY rep, _s ORDER BY id)")).filter(f"_r <= {n}")
    return ranked.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))


def nearest_of_queries(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5, block_rows: int = 4096) -> DataFrame:
    """id, other, cosine: the exact k most similar rows of a stated set of queries, against all rows in blocks.

    Blocks of queries go to every partition of the rows; each keeps its own k best, so what is merged is k rows for each
    query and partition. The driver holds one block of about block_rows queries at a time.
    """
    spark = df.sparkSession
    rows = written(unit_vectors(df, id_col, vec_col).select("id", "unit"), "row-units")
    asked = written(unit_vectors(queries, id_col, vec_col).select("id", "unit"), "query-units")
    parts = max(1, -(-asked.count() // block_rows))
    any_block = False
    path = f"{scratch(spark)}/nearest-of-queries-{uuid.uuid4().hex}"
    for p in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).collect()  # block_rows rows on average
        if not block:
            continue
        names = np.array([r["id"] for r in block])
        matrix = np.frombuffer(b"".join(bytes(r["unit"]) for r in block), np.float32).reshape(len(block), -1)

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            best = np.full((len(names), k), -2.0, np.float32)
            who = np.full((len(names), k), -1, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, matrix.shape[1])
                cos = matrix @ x.T
                cos[names[:, None] == ids[None, :]] = -2
                both, named = np.hstack([best, cos]), np.hstack([who, np.broadcast_to(ids, cos.shape)])
                order = np.lexsort((named, -both), axis=1)[:, :k]
                best, who = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
            row, col = np.nonzero(best > -2)
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(who[row, col]), pa.array(best[row, col].astype(np.float64))], ["id", "other", "cosine"])

        # one block at a time is in the driver's memory
        _top(rows.mapInArrow(run, "id bigint, other bigint, cosine double"), k).write.mode("append").parquet(path)
        any_block = True
    schema = "id bigint, other bigint, cosine double"
    return spark.read.schema(schema).parquet(path) if any_block else spark.createDataFrame([], schema)
