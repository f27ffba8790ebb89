"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.llm.proportions import ProportionalSample
from letterloom.llm.registry import query, table

_KEY = r"regexp_replace(lower(label), '[\s\p{Z}\p{P}]+', '', 'g')"
_SQL = f"""
WITH c AS (SELECT {_KEY} AS k, count(*) AS c FROM train GROUP BY 1),
     t AS (SELECT label, {_KEY} AS k, target_share, min_rows FROM sample_targets),
     n AS (SELECT count(*) / 5.0 AS n FROM train)
SELECT t.label, coalesce(c.c, 0) AS available, t.target_share * n.n AS wanted, t.min_rows
FROM t LEFT JOIN c USING (k) CROSS JOIN n
"""


def _drawn(spark, d):
    return ProportionalSample(table(spark, d, "train"), "row_id", "label", "text", table(spark, d, "sample_targets"))


@query("p2_found", f"SELECT label FROM ({_SQL}) WHERE available < wanted OR available < min_rows")
def p2_found(spark, d):
    """Labels that the drawn sample has exhausted and still lacks rows of."""
    return _drawn(spark, d).report().filter("short").select("label")


@query("p2_report", f"SELECT label, available, round(wanted, 6) AS wanted, CAST(min_rows AS BIGINT) AS min_rows FROM ({_SQL})")
def p2_report(spark, d):
    return _drawn(spark, d).report().select("label", "available", F.round("wanted", 6).alias("wanted"), "min_rows")


@query("p2_sample")
def p2_sample(spark, d):
    return _drawn(spark, d).sample().select(F.col("id").alias("row_id"), "label")


@query("p2_drawn")
def p2_drawn(spark, d):
    """What the sample has of each label, beside what was wanted."""
    return _drawn(spark, d).report().select("label", "drawn", F.round("gap", 6).alias("gap"), "short")
