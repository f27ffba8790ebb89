"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.llm.overlaps import Overlaps, overlaps
from letterloom.llm.registry import query, table


@query("p4_found")
def p4_found(spark, d):
    return overlaps(table(spark, d, "test"), table(spark, d, "train_augmented")).select("test_id", "train_id")


@query("p4_report")
def p4_report(spark, d):
    test = table(spark, d, "test")
    return Overlaps(test, table(spark, d, "train_augmented")).report(test)


@query("p4_classes")
def p4_classes(spark, d):
    """Overlapping pairs of different wordings by their smallest rows, with the number of rows on either side."""
    found = Overlaps(table(spark, d, "test"), table(spark, d, "train_augmented"))
    size = lambda side, key, name: side.select(F.col("id").alias(key), F.col("copies").alias(name))
    both = found.near.join(size(found.test, "u", "test_rows"), "u").join(size(found.train, "v", "train_rows"), "v")
    return both.select(F.col("u").alias("test_id"), F.col("v").alias("train_id"), "edits", "test_rows", "train_rows")
