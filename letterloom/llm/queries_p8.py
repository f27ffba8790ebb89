"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.llm.registry import query, table
from letterloom.llm.subjects import SubjectFactors


def _factors(spark, d):
    return SubjectFactors(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_examples"), table(spark, d, "subject_areas"))


@query("p8_found")
def p8_found(spark, d):
    return _factors(spark, d).found().select("doc_id", "subject")
