"""Queries of the training-data operators, kept apart from the core registry."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import letterloom.llm as _package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _m in sorted(m.name for m in pkgutil.iter_modules(_package.__path__) if m.name.startswith("queries_p")):
    importlib.import_module(f"letterloom.llm.{_m}")
