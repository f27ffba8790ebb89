"""Shared helpers: lineage cuts in the shared folder and joins that survive hot keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1024

_ROOTS: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, removed when the driver ends.

    A local temporary folder is used only where the session sets none and has a local master (tests); executors of a
    cluster couldn't share it, so there that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="letterloom-")
        root = f"{base}/letterloom-{uuid.uuid4().hex}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *sums) -> tuple[DataFrame, dict]:
    """written() and the named aggregates of all its rows, taken while they are written."""
    watch = Observation()
    out = written(df.observe(watch, *sums), name)
    # a plan that turns out empty may lose its watch
    return out, watch.get or out.agg(*sums).first().asDict()


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row a key, where single keys may hold a large part of the rows.

    groups has the number of rows of each key in `count`. Keys with more than total / HOT_PARTS rows, at most
    HOT_PARTS of them whatever the size of the input, are broadcast; the rest is joined by an ordinary join.
    """
    limit = max(1, total // HOT_PARTS)
    hot = groups.filter(F.col(count) > limit)
    cold = groups.filter(F.col(count) <= limit)
    hot_keys = hot.select(F.col(key)).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_keys), key, "left")
    out_hot = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    out_cold = marked.filter("_hot IS NULL").drop("_hot").join(cold, key)
    return out_hot.unionByName(out_cold)


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame, salts: int = 32) -> DataFrame:
    """Inner join on a key that may be hot on both sides: rows of the keys in hot are split over `salts` tasks by the
    right side's `spread`, and the left side's are repeated for each. hot must be small enough to broadcast: keys with at
    least a 1/HOT_PARTS part of the rows of either side, as hot_keys gives them."""
    marks = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    l = left.join(marks, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    r = right.join(marks, key, "left").withColumn("_salt", one).drop("_hot")
    return l.join(r, [key, "_salt"]).drop("_salt")


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Keys with more than total / HOT_PARTS rows, fewer than HOT_PARTS of them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(64, total // HOT_PARTS)).select(key)
