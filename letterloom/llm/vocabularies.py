"""Where the public vocabularies lie: the session's letterloom.tokenizers, or /opt/tokenizers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"


def path_of(spark: SparkSession, name: str) -> str:
    return os.path.join(spark.conf.get("spark.letterloom.tokenizers", FOLDER), name)


def file_of(tokenizer: str) -> str:
    """File of a named tokenizer; the json files also list their merges, so they come first where both exist."""
    return {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}[tokenizer]
