"""Distributed Borůvka minimum spanning forest over an edge table, with its components at several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import observed, written


def roots(parents: DataFrame, limit: int = 64) -> DataFrame:
    """node, root for parents (node, parent) that form trees; a root is its own parent. Each pass jumps three steps."""
    for _ in range(limit):
        once = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        twice = parents.select(F.col("node").alias("above"), F.col("parent").alias("top"))
        jumped = parents.join(once, "parent").join(twice, "above").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved"))
        parents, seen = observed(jumped, "parents", F.count_if("moved").alias("moved"))
        parents = parents.drop("moved")
        if not seen["moved"]:
            return parents.withColumnRenamed("parent", "root")
    raise RuntimeError("the parents don't form trees")


def spanning_levels(edges: DataFrame, levels: list[float], rounds: int = 64) -> tuple[DataFrame, list[DataFrame | None]]:
    """Forest edges a, b, w of undirected edges a, b, w, and for every level the components that it joins.

    The entry of a level has (c, up): up is the component over edges below the level that holds c, a component of the
    level before it, or a node at the first; components that stay as they are may be missing, and None stands for no
    change at all. levels ascend, and edges at or above the last are left out.

    In every round each component takes its least edge by (w, a, b), a total order, so the edges taken hold no cycle but
    a component pair that has taken the same edge. Rounds at least halve the number of components that still have edges
    below the level; as these are the least edges of all, what is taken belongs to the minimum spanning forest.
    """
    spark = edges.sparkSession
    least_weight = F.min("w").alias("w")
    ends = edges.filter(F.col("w") < levels[-1]).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b")
    live, seen = observed(ends, "edges", least_weight)
    forest: list[DataFrame] = []
    joined: list[DataFrame | None] = []
    for level in levels:
        up = None
        for _ in range(rounds):
            if seen["w"] is None or seen["w"] >= level:
                break
            now = live.filter(F.col("w") < level)
            both = now.unionByName(now.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "w", "a", "b"))
            least = both.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("e")).select(F.col("ca").alias("node"), F.col("e.cb").alias("parent"), "e.w", "e.a", "e.b")
            least = written(least, "least-edges")
            forest.append(least.select("a", "b", "w"))
            # of two components that chose each other the smaller becomes a root
            back = least.select(F.col("node").alias("parent"), F.col("parent").alias("_back"))
            hooked = least.join(back, "parent", "left").select("node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
            top = roots(hooked)
            side = lambda c, n: top.select(F.col("node").alias(c), F.col("root").alias(n))  # noqa: B023, E731
            relabelled = live.join(side("ca", "ra"), "ca", "left").join(side("cb", "rb"), "cb", "left")
            relabelled = relabelled.select(F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"), "w", "a", "b").filter("ca <> cb")
            live, seen = observed(relabelled, "edges", least_weight)
            if up is None:
                up = top.select(F.col("node").alias("c"), F.col("root").alias("up"))
            else:
                further = top.select(F.col("node").alias("up"), F.col("root").alias("_new"))
                up = up.join(further, "up", "left").select("c", F.coalesce("_new", "up").alias("up"))
        joined.append(up if up is None else written(up, "components"))
    if not forest:
        return spark.createDataFrame([], "a bigint, b bigint, w double"), joined
    out = forest[0]
    for part in forest[1:]:
        out = out.unionByName(part)
    return written(out.distinct(), "forest"), joined
