"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.llm.neighbours import nearest, nearest_of_queries
from letterloom.llm.registry import query, table


@query("p3_found")
def p3_found(spark, d):
    found = nearest(table(spark, d, "x_train_bert"), "row_id", "x_train_bert", k=5, least_cosine=0.85)
    pairs = found.select(F.least("id", "other").alias("row_id_a"), F.greatest("id", "other").alias("row_id_b"))
    return pairs.distinct()


@query("p3_nearest_five")
def p3_nearest_five(spark, d):
    """The search over a stated query set, every row whose id is divisible by 50, against all rows."""
    rows = table(spark, d, "x_train_bert")
    found = nearest_of_queries(rows, rows.filter("row_id % 50 = 0"), "row_id", "x_train_bert", k=5)
    return found.select(F.col("id").alias("row_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"))
