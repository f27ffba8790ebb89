"""Queries of problem 6."""

from __future__ import annotations

from letterloom.llm.bpe import encode_corpus
from letterloom.llm.registry import query, table
from letterloom.llm.vocabularies import path_of


@query("p6_ids")
def p6_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", path_of(spark, "byte_bpe_50k.json"))
