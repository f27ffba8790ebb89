"""Queries of problem 7."""

from __future__ import annotations

from letterloom.llm.packing import MAX_CAPACITIES, packed_corpus, packing_report
from letterloom.llm.registry import query, table
from letterloom.llm.vocabularies import file_of, path_of


def _packed(spark, d, **options):
    capacities = table(spark, d, "pack_capacities")
    names = [r[0] for r in capacities.select("tokenizer").distinct().limit(MAX_CAPACITIES).collect()]
    paths = {n: path_of(spark, file_of(n)) for n in names}
    return packed_corpus(table(spark, d, "documents"), "doc_id", "text", capacities, paths, **options), capacities


@query("p7_packed")
def p7_packed(spark, d):
    return _packed(spark, d)[0]


@query("p7_report")
def p7_report(spark, d):
    return packing_report(*_packed(spark, d))


@query("p7_bounded")
def p7_bounded(spark, d):
    """Containers that may hold a document for each 128 tokens and a quarter of the attention cost of one whole text."""
    return _packed(spark, d, docs_share=1 / 128, cost_share=0.25)[0]
