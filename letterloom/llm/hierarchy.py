"""The condensed hierarchy of a spanning forest and the selection of its most stable clusters, level by level.

Components at the first level are its leaves: what would split below it stays whole. A component of at least `least_rows`
rows is a cluster. Where a level joins two or more clusters, these end and a new one begins; a single cluster that meets
smaller components goes on, and their rows, which leave it above the first level, are outliers; small components that
only together have enough rows begin a cluster. The stability of a cluster is the sum over its rows of 1 / distance at
which the row leaves it less 1 / distance at which it begins, and a cluster is chosen if it is at least as stable as the
chosen ones below it together. All of it are joins and sums by component, one step a level, so no component, however
large, has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import written

#: Distances below this count as this in stabilities, or copies would outweigh everything.
NEAREST = 0.02


def chosen_clusters(components: DataFrame, joined: list[DataFrame | None], levels: list[float], least_rows: int) -> DataFrame:
    """c0, cluster: the chosen cluster of every first-level component that is in one.

    components: c, n rows and rate, the sum over the rows of 1 / distance at which each leaves. joined: the further
    levels' entries as spanning_levels gives them; levels: all levels, the first one included.
    """
    state = components.select("c", "n", F.col("rate").alias("rate"), F.lit(0.0).alias("below"))
    where = components.select(F.col("c").alias("c0"), "c", F.lit(None).cast("bigint").alias("cluster"))
    large = F.col("n") >= least_rows
    for level, up in zip(levels, joined):
        if up is None:
            continue
        at = F.lit(1 / level)
        gain = F.col("rate") - F.col("n") * at
        moved = state.join(up, "c", "left").withColumn("up", F.coalesce("up", "c"))
        met = moved.groupBy("up").agg(
            F.count_if(large).alias("clusters"), F.sum("n").alias("all"), F.sum(F.when(large, F.col("n"))).alias("kept"), F.count(F.lit(1)).alias("parts"),
            F.sum(F.when(large, F.col("rate"))).alias("rate_on"), F.sum(F.when(large, F.col("below"))).alias("below_on"),
            F.sum(F.when(large, F.greatest(gain, F.col("below")))).alias("best"),
        )
        met = written(met, "met")
        one, several = F.col("clusters") == 1, F.col("clusters") > 1
        # components that joined nothing stay as they are
        fate = moved.join(met.select("up", "clusters", "parts"), "up").select("c", "up", (several & large & (gain >= F.col("below"))).alias("ends_chosen"), (~large & (F.col("clusters") > 0)).alias("left_out"))
        where = where.join(fate, "c").filter("NOT left_out").select("c0", F.col("up").alias("c"), F.when(F.col("ends_chosen"), F.col("c")).otherwise(F.col("cluster")).alias("cluster"))
        where = written(where, "where")
        state = met.select(
            F.col("up").alias("c"), F.col("all").alias("n"),
            F.when(one, F.col("rate_on") + (F.col("all") - F.col("kept")) * at).when((F.col("parts") > 1), F.col("all") * at).otherwise(F.lit(0.0)).alias("rate"),
            F.when(one, F.col("below_on")).when(several, F.col("best")).otherwise(F.lit(0.0)).alias("below"),
        )
    ends_chosen = F.col("rate") - F.col("n") / F.lit(levels[-1]) >= F.col("below")
    last = where.join(state.filter(large).select("c", ends_chosen.alias("ends_chosen")), "c")
    return last.select("c0", F.when(F.col("ends_chosen"), F.col("c")).otherwise(F.col("cluster")).alias("cluster")).filter("cluster IS NOT NULL")
