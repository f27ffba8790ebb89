"""Problem 7: texts into as few containers of fixed capacity as possible, by vector best-fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths). Items are taken
from the largest to the smallest; among the open containers that have room under every capacity the one with the least
weighted norm of what would remain (or the greatest weighted dot product of item and room) gets the item.

Items are dealt out by a hash of their id into groups of bounded size that are packed independently, so no task holds
more than about `group_items` items; a group wastes part of one container at most, beside what best-fit itself wastes.

Defined cases: a text larger than the capacity fills whole containers and its rest is packed as an item, other texts are
never split; an item that alone exceeds the attention capacity has a container of its own; null and empty texts have no tokens and no container (null); equal sizes are taken by id, equal scores go
to the container opened first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.bpe import encoder
from letterloom.llm.common import written

GROUP_ITEMS = 4096
MAX_CAPACITIES = 100
PACKED = "capacity_id int, doc_id bigint, part int, n_tokens int, container_id bigint"


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabularies: dict[str, str]) -> DataFrame:
    """doc_id and one int column for each vocabulary (name: path): tokens of the whole text. One pass, no shuffle."""
    names = sorted(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(vocabularies[n]) for n in names]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                counts = [pa.array(np.fromiter((len(e.packed(t)) // 4 for t in texts), np.int32, len(texts))) for e in encoders]
                for e in encoders:
                    e.rest()
                yield pa.RecordBatch.from_arrays([part.column(0), *counts], ["doc_id", *names])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"`{n}` int" for n in names))


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights=(1.0, 0.01, 0.01), by: str = "norm") -> np.ndarray:
    """Container of each item; sizes are positive, at most capacity and in descending order."""
    full = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights, float)
    out = np.empty(len(sizes), np.int64)
    room = np.empty((max(1, len(sizes)), 3))
    names = np.empty(max(1, len(sizes)), np.int64)
    opened = used = 0
    least = int(sizes[-1]) if len(sizes) else 0
    for i, size in enumerate(sizes):
        item = np.array([size, 1.0, float(size) ** 2])
        place = -1
        if used:
            after = room[:used] - item
            fits = (after >= 0).all(1)
            if fits.any():
                share = after / full
                score = (w * share * share).sum(1) if by == "norm" else -(w * (item / full) * (room[:used] / full)).sum(1)
                place = int(np.where(fits, score, np.inf).argmin())
        if place < 0:
            place = used
            room[used], names[used] = full, opened
            used, opened = used + 1, opened + 1
        room[place] -= item
        out[i] = names[place]
        if room[place, 0] < least or room[place, 1] < 1:  # nothing fits any more; order is kept for ties
            room[place : used - 1], names[place : used - 1] = room[place + 1 : used].copy(), names[place + 1 : used].copy()
            used -= 1
    return out


def pack(counts: DataFrame, capacities: DataFrame, docs_share: float | None = None, cost_share: float | None = None, weights: tuple[float, float, float] | None = None, by: str = "norm", group_items: int = GROUP_ITEMS) -> DataFrame:
    """capacity_id, doc_id, part, n_tokens, container_id for every document and every capacity.

    counts has a column of sizes for each tokenizer that capacities names. A container may hold docs_share * capacity
    documents (at least one) and an attention cost of cost_share * capacity squared; both default to 1, which binds no text
    of one token or more, and the weights then to those of tokens alone.
    """
    weights = weights or ((1.0, 0.01, 0.01) if docs_share is None and cost_share is None else (1.0, 1.0, 1.0))
    docs_share, cost_share = (1.0 if x is None else x for x in (docs_share, cost_share))
    spark = counts.sparkSession
    listed = capacities.select("capacity_id", "tokenizer", "capacity").limit(MAX_CAPACITIES + 1).collect()
    if len(listed) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    if not listed:
        return spark.createDataFrame([], PACKED)
    groups = max(1, -(-counts.count() // group_items))
    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("capacity_id"), F.lit(r[2]).alias("capacity"), F.col(r[1]).alias("size")) for r in listed])).alias("c")
    items = counts.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), each).select("doc_id", "group", "c.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, group = int(pdf["capacity"].iloc[0]), int(pdf["group"].iloc[0])
        ids, sizes = pdf["doc_id"].to_numpy(), pdf["size"].to_numpy().astype(np.int64)
        whole, rest = sizes // capacity, sizes % capacity
        parts = [
            pd.DataFrame({"doc_id": np.repeat(ids, whole), "part": np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), "n_tokens": capacity}),
        ]
        left = np.flatnonzero(rest > 0)
        left = left[np.lexsort((ids[left], -rest[left]))]
        at = best_fit(rest[left], capacity, max(1, int(docs_share * capacity)), cost_share * float(capacity) ** 2, weights, by)
        base = group << 32
        parts[0]["container_id"] = base + np.arange(len(parts[0])) if len(parts[0]) else np.array([], np.int64)
        parts.append(pd.DataFrame({"doc_id": ids[left], "part": whole[left], "n_tokens": rest[left], "container_id": base + len(parts[0]) + at}))
        none = np.flatnonzero(sizes == 0)
        parts.append(pd.DataFrame({"doc_id": ids[none], "part": 0, "n_tokens": 0, "container_id": -1}))
        out = pd.concat(parts, ignore_index=True)
        out["capacity_id"] = int(pdf["capacity_id"].iloc[0])
        out["container_id"] = out["container_id"].astype("Int64").mask(out["n_tokens"] == 0)
        return out[["capacity_id", "doc_id", "part", "n_tokens", "container_id"]]

    return items.groupBy("capacity_id", "group").applyInPandas(run, PACKED)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens, fill and the least number of containers that the tokens need, for every capacity."""
    by_container = packed.filter("container_id IS NOT NULL").groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("m"))
    total = by_container.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("n").alias("most_documents"))
    size = capacities.select("capacity_id", "capacity")
    return total.join(size, "capacity_id").select(
        "capacity_id", "containers", "tokens", "most_documents",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("fill"),
    )


def packed_corpus(docs: DataFrame, id_col: str, text_col: str, capacities: DataFrame, paths: dict[str, str], **options) -> DataFrame:
    """pack() of a corpus; sizes are counted once and kept."""
    return pack(written(token_counts(docs, id_col, text_col, paths), "token-counts"), capacities, **options)
