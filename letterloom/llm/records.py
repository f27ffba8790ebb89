"""Problem 5: records that differ only in formatting, kept in an incremental ledger of canonical keys.

Two records are the same if text and label are equal after dropping case, white space and punctuation (Unicode
category P), with the header fields of the text in any order and text and label possibly swapped.

Defined cases: a null or blank label is one value of its own; null texts and texts without a letter, digit or symbol
take no part; ties for the earliest representative go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import join_by_hot_key, scratch, written

#: Names of header fields.
HEADER_NAMES = ("Исх", "Вх", "Дата", "Тема", "Кому", "От", "Объект", "Договор")

#: Loops are possessive, so that no text makes the matcher recurse or backtrack.
_HEADER = r"(?iuU)^\s*+(?:(?:" + "|".join(HEADER_NAMES) + r")\s*+:[^\n\r;|]*+(?:[\n\r;|]\s*+|$))*+"
_DROPPED = r"(?U)[\s\p{P}]+"


def bare(text: Column) -> Column:
    """Text without case, white space and punctuation."""
    return F.regexp_replace(F.lower(text), _DROPPED, "")


def canonical(text: Column) -> Column:
    """bare() of the body after the sorted bare header fields."""
    header = F.regexp_extract(text, _HEADER, 0)
    fields = F.filter(F.transform(F.split(header, r"[\n\r;|]"), bare), lambda x: x != "")
    body = bare(F.substring(text, F.length(header) + 1, F.length(text)))
    return F.concat(F.array_join(F.array_sort(fields), "\u0001"), F.lit("\u0002"), body)


def record_keys(df: DataFrame, id_col: str, text_col: str, label_col: str, *keep: str) -> DataFrame:
    """id, key and the kept columns of each row that takes part; key is a 128-bit digest of the canonical record."""
    text, label = F.col(text_col), F.col(label_col)
    blank = label.isNull() | label.rlike(r"(?U)^\s*$")
    out = df.filter(text.rlike(r"[\p{L}\p{N}\p{S}]")).select(
        F.col(id_col).alias("row_id"),
        canonical(text).alias("_t"),
        F.when(blank, F.lit("\u0003")).otherwise(canonical(label)).alias("_l"),
        *keep,
    )
    pair = F.concat(F.least("_t", "_l"), F.lit("\u0004"), F.greatest("_t", "_l"))
    return out.select("row_id", F.unhex(F.md5(pair)).alias("key"), *keep)


class RecordLedger:
    """Counts of canonical keys by bucket, grown batch by batch.

    A batch is aggregated by key before it meets the ledger, then full-outer-joined with the buckets it touches; only
    those are rewritten, under a new version. When the keys outgrow their buckets, as many times more are made and all
    are rewritten once. The manifest of a batch names the version of each bucket, the number of buckets and the batches
    so far; it is written aside and renamed to a new number, so a batch that fails half way leaves the ledger as it was,
    and a batch that is given again under its name changes nothing.
    """

    SCHEMA = "key binary, copies bigint, first_id bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, keys_a_bucket: int = 1_000_000):
        self.spark, self.path, self.keys_a_bucket = spark, path, keys_a_bucket
        self.number, state = self._load()
        self.buckets: int = state.get("buckets", buckets)
        self.version: dict[int, str] = {int(k): v for k, v in state.get("version", {}).items()}
        self.keys: dict[int, int] = {int(k): v for k, v in state.get("keys", {}).items()}
        self.batches: list[str] = state.get("batches", [])

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> tuple[int, dict]:
        folder, fs = self._file("manifests")
        if not fs.exists(folder):
            return 0, {}
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, {}
        row = self.spark.read.text(f"{self.path}/manifests/{max(numbers):08d}.json").first()
        return max(numbers), json.loads(row[0])

    def _save(self, state: dict) -> None:
        aside, fs = self._file(f"manifests/{uuid.uuid4().hex}.part")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        final, _ = self._file(f"manifests/{self.number + 1:08d}.json")
        if not fs.rename(aside, final):
            raise RuntimeError(f"another writer has made {final.toString()}")

    @staticmethod
    def bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """key, copies, first_id of the whole ledger or some buckets."""
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in sorted(self.version.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """Add rows of (row_id, key). A batch whose name has been added already is left out."""
        if name is not None and name in self.batches:
            return
        new = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("m"))
        # one row a key is written first: the buckets it touches have to be known before the ledger is read
        new = written(new, "ledger-batch")
        count = lambda buckets: dict(new.groupBy(self.bucket(F.col("key"), buckets).alias("b")).count().collect())  # noqa: E731  at most a row a bucket
        touched = count(self.buckets)
        buckets = self.buckets
        while sum(self.keys.values()) + sum(touched.values()) > buckets * self.keys_a_bucket:
            buckets *= 2
        if buckets != self.buckets:
            old, kept = self.rows(), {}
        else:
            old, kept = self.rows(set(touched)), {b: v for b, v in self.version.items() if b not in touched}
        version, keys = dict(kept), {b: self.keys[b] for b in kept}
        if touched:
            both = old.join(new, "key", "full_outer").select(
                "key",
                (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
                F.least("first_id", "m").alias("first_id"),
            )
            name_of = uuid.uuid4().hex[:12]
            placed = both.withColumn("bucket", self.bucket(F.col("key"), buckets))
            placed.repartition(min(buckets, 4096) if buckets != self.buckets else len(touched), "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name_of}")
            made = dict(self.spark.read.schema(self.SCHEMA + ", bucket int").parquet(f"{self.path}/{name_of}").groupBy("bucket").count().collect())
            version |= dict.fromkeys(made, name_of)
            keys |= made
        batches = self.batches + ([name] if name is not None else [])
        self._save({"buckets": buckets, "version": version, "keys": keys, "batches": batches})
        self.number, self.buckets, self.version, self.keys, self.batches = self.number + 1, buckets, version, keys, batches


def ledger_over_batches(keys: DataFrame, arrival: str, batches: int = 3) -> RecordLedger:
    """Feed keys to a new ledger in `batches` parts by arrival time; rows without one come first."""
    spark = keys.sparkSession
    seconds = F.coalesce(F.unix_timestamp(arrival), F.lit(0))
    ledger = RecordLedger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    cuts = keys.select(seconds.alias("s")).approxQuantile("s", [i / batches for i in range(1, batches)], 0.02)
    edges = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        part = keys
        if low is not None:
            part = part.filter(seconds > low)
        if high is not None:
            part = part.filter(seconds <= high)
        ledger.add(part, f"arrival-{i}")
    return ledger


def copies_of_records(df: DataFrame, id_col: str, text_col: str, label_col: str, arrival: str) -> DataFrame:
    """first_id, copy_id, copies: each row but the first of every record that has copies."""
    keys = written(record_keys(df, id_col, text_col, label_col, arrival), "record-keys")
    ledger = ledger_over_batches(keys, arrival)
    repeated = ledger.rows().filter("copies > 1")
    joined = join_by_hot_key(keys.select("row_id", "key"), repeated, "key", "copies", keys.count())
    return joined.filter("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"), "copies")


def record_counts(df: DataFrame, id_col: str, text_col: str, label_col: str, arrival: str) -> DataFrame:
    """first_id, copies: one row for each record."""
    keys = written(record_keys(df, id_col, text_col, label_col, arrival), "record-keys")
    return ledger_over_batches(keys, arrival).rows().select("first_id", "copies")
