"""Queries of problem 1."""

from __future__ import annotations

from letterloom.llm.clusters import wording_clusters
from letterloom.llm.registry import query, table


@query("p1_found")
def p1_found(spark, d):
    members, _ = wording_clusters(table(spark, d, "original_data"), "row_id", "text")
    return members.filter("row_id <> first_id").select("first_id", "row_id")


@query("p1_clusters")
def p1_clusters(spark, d):
    """Size and the three most persistent members of each cluster."""
    return wording_clusters(table(spark, d, "original_data"), "row_id", "text")[1]
