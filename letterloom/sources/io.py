"""Readers and writers of labelled texts, and the checks that go with them."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.text import strip

CORPUS = "label string, text string"
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself, or ValueError that names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def _suffix(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix!r}; known are {', '.join(FORMATS)}")
    return suffix


def read_corpus(spark: SparkSession, path: str, schema: str | None = CORPUS) -> DataFrame:
    """Rows of a .json array, .jsonl, .csv or .parquet file; schema None reads the types from the file."""
    suffix = _suffix(path)
    reader = spark.read if schema is None or suffix == ".csv" else spark.read.schema(schema)
    if suffix == ".csv":
        # by name: columns may stand in any order and there may be others
        return reader.options(**CSV).csv(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    return getattr(reader, FORMATS[suffix])(path)


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    suffix = _suffix(path)
    writer = df.write.mode(mode)
    if suffix == ".csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        getattr(writer, FORMATS[suffix])(path)


def derived_path(path: str, what: str) -> str:
    """<stem>_<what><suffix> beside path."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_{what}{p.suffix}"))


def has_labels(df: DataFrame, label: str = "label") -> bool:
    return label in df.columns


def parse_list(values: str, kind=float) -> list:
    """'1,3,5' as a typed list; blanks are dropped."""
    return [kind(v) for v in values.split(",") if v.strip()]


def with_row_numbers(df: DataFrame, order_by: str, name: str = "sample_id", buckets: int = 256) -> DataFrame:
    """Numbers from 0 in the order of a unique number: quantiles cut the rows into buckets, which are numbered apart."""
    from letterloom.operators.relational import numbered

    cuts = df.approxQuantile(order_by, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return numbered(df, F.size(F.filter(edges, lambda e: e <= F.col(order_by))), [order_by], name)


def spread(df: DataFrame) -> DataFrame:
    """df itself, or over all cores where it comes in fewer parts than there are, as from one small file."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def nonempty(df: DataFrame, variant: str = "hybrid") -> DataFrame:
    """Rows with a text, by the rules of one of the loaders.

    cleaner: null texts become empty, nothing is dropped. hybrid and classifier: text and label stripped, both must be
    there. cosine: only the text is stripped and must not be empty; the label must not be null. embedding: as cosine,
    null labels drop before the text is looked at.
    """
    if variant == "cleaner":
        return df.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    rows = df.filter(F.col("text").isNotNull() & F.col("label").isNotNull()).withColumn("text", strip(F.col("text")))
    if variant in ("hybrid", "classifier"):
        rows = rows.withColumn("label", strip(F.col("label"))).filter("label <> ''")
    elif variant not in ("cosine", "embedding"):
        raise ValueError(f"unknown variant {variant!r}")
    return rows.filter("text <> ''")


def write_results(df: DataFrame, path: str) -> None:
    """Metrics, sweeps and run descriptions as JSON lines."""
    df.write.mode("overwrite").json(path)


def append_round(df: DataFrame, path: str, number: int) -> None:
    """Rows of one round of a resumable job, under its own folder, so that a repeated round replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/round={number}")


def resume_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rounds written so far, or none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema + ", round int")
    return spark.read.schema(schema + ", round int").parquet(path)


def write_matrix(rows: DataFrame, path: str, **facts) -> None:
    """A matrix in long form (doc_id, block, term, weight), a folder a block, and what is to be known of it as JSON."""
    rows.write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    rows = spark.read.parquet(f"{path}/rows").select("doc_id", F.col("block").cast("int").alias("block"), "term", "weight")
    return rows, json.loads(spark.read.text(f"{path}/facts").first()[0])


def write_linear_model(spark: SparkSession, model: tuple, path: str) -> None:
    """Weights (features + 1 by classes) and labels of a linear model, one row a class."""
    beta, labels = model
    kind = "string" if labels and isinstance(labels[0], str) else "bigint"
    rows = [(i, label, [float(x) for x in beta[:, i]]) for i, label in enumerate(labels)]
    spark.createDataFrame(rows, f"place int, label {kind}, weights array<double>").write.mode("overwrite").parquet(path)


def read_linear_model(spark: SparkSession, path: str) -> tuple:
    import numpy as np

    rows = spark.read.parquet(path).orderBy("place").collect()  # one row a class
    return np.array([r["weights"] for r in rows]).T, [r["label"] for r in rows]
