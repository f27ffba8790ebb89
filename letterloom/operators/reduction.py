"""Truncated singular value decomposition of a matrix in long form (doc_id, term, weight).

Subspace iteration: a random vector for every term, from a hash of its name, is carried through the matrix and back a few
times and made orthonormal in between. Vectors live beside documents and terms in tables, and only the products of their
`k` columns with each other, k by k numbers, reach the driver; so neither side of the matrix has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns beyond those asked for, which make the leading ones exact sooner.
SPARE = 8


def _through(matrix: DataFrame, vectors: DataFrame, source: str, target: str) -> DataFrame:
    """target, x: for each target the sum of the vectors of its sources by the entries' weights."""
    signed = F.when(F.col("weight") < 0, F.transform("x", lambda v: -v)).otherwise(F.col("x"))
    each = matrix.join(vectors, source).select(target, array_to_vector(signed).alias("x"), F.abs("weight").alias("w")).filter("w > 0")
    return each.groupBy(target).agg(vector_to_array(Summarizer.metrics("sum").summary(F.col("x"), F.col("w")).getField("sum")).alias("x"))


def _products(vectors: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"row": np.arange(width), "part": list(total)})

    parts = vectors.select("x").mapInPandas(run, "row int, part array<double>").select("row", F.posexplode("part").alias("col", "p"))
    out = np.zeros((width, width))
    for r in parts.groupBy("row", "col").agg(F.sum("p").alias("p")).collect():
        out[r["row"], r["col"]] = r["p"]
    return out


def _times(vectors: DataFrame, key: str, right: np.ndarray) -> DataFrame:
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "x": list(np.stack(pdf["x"].to_numpy()) @ right)})

    return vectors.select(key, "x").mapInPandas(run, f"{key} {kind}, x array<double>")


def _orthonormal(products: np.ndarray) -> np.ndarray:
    """R with (Y R)'(Y R) = 1 for the products Y'Y; directions without length are left out."""
    value, vector = np.linalg.eigh(products)
    good = value > value.max(initial=0.0) * 1e-12
    return vector[:, good] / np.sqrt(value[good])


def truncated_svd(matrix: DataFrame, k: int, passes: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, x; term, x; singular values): documents' coordinates, the right singular vectors and the values, k or as
    many as the matrix has.

    Of each vector the sign is such that the sum of its cubes over the terms is positive. Rows without a term have no coordinates.
    New documents are placed by `placed`. An empty matrix gives empty tables and no values.
    """
    matrix = matrix.select("doc_id", "term", "weight").persist(StorageLevel.MEMORY_AND_DISK)  # read twice a pass

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            yield pd.DataFrame({"term": pdf["term"], "x": [np.random.default_rng((seed, zlib.crc32(t.encode()))).standard_normal(k + SPARE) for t in pdf["term"]]})

    terms = matrix.select("term").distinct().mapInPandas(start, "term string, x array<double>")
    kept: list[DataFrame] = []
    width = k + SPARE
    for _ in range(max(1, passes)):
        docs = _through(matrix, terms, "term", "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(docs)
        right = _orthonormal(_products(docs, width))
        width = right.shape[1]
        if not width:
            break
        terms = _through(matrix, _times(docs, "doc_id", right), "doc_id", "term").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(terms)
    if not width:
        spark = matrix.sparkSession
        return spark.createDataFrame([], "doc_id bigint, x array<double>"), spark.createDataFrame([], "term string, x array<double>"), np.zeros(0)
    value, vector = np.linalg.eigh(_products(terms, width))
    order = np.argsort(-value)[:k]
    order = order[value[order] > value.max() * 1e-12]
    singular = np.sqrt(value[order])
    components = _times(terms, "term", vector[:, order] / singular)
    cubes = components.agg(*[F.sum(F.pow(F.get("x", F.lit(i)), 3)).alias(f"c{i}") for i in range(len(order))]).first()
    sign = np.array([-1.0 if c < 0 else 1.0 for c in cubes])
    components = _times(components, "term", np.diag(sign)).persist(StorageLevel.MEMORY_AND_DISK)
    components.count()
    for df in kept:
        df.unpersist()
    return placed(matrix, components), components, singular


def placed(matrix: DataFrame, components: DataFrame) -> DataFrame:
    """doc_id, x: coordinates of documents by the components of a decomposition; terms it doesn't know are left out."""
    return _through(matrix, components, "term", "doc_id")
