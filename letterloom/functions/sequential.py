"""Rewrites whose result depends on a left-to-right scan, as Arrow-batched functions."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from letterloom.functions import lines, text

PASSES = 6
LONGEST_GRAM, SHORTEST_GRAM, SHORTEST_CHAIN = 5, 2, 8


def _ids(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def _equal_from(ids: np.ndarray, lag: int) -> np.ndarray:
    """For every place, how many words in a row from there on equal those `lag` later."""
    same = ids[:-lag] == ids[lag:]
    breaks = np.append(np.flatnonzero(~same), len(same))
    return breaks[np.searchsorted(breaks, np.arange(len(same)))] - np.arange(len(same))


def _kept_after_grams(ids: np.ndarray) -> np.ndarray:
    """Places kept by one scan that turns a phrase said several times in a row into one, longer phrases first."""
    lengths = [n for n in range(LONGEST_GRAM, SHORTEST_GRAM - 1, -1) if len(ids) >= 2 * n]
    equal = {n: np.append(_equal_from(ids, n), np.zeros(n, np.int64)) for n in lengths}
    keep = np.ones(len(ids), bool)
    i = 0
    starts = np.zeros(len(ids), bool)
    for n in lengths:
        starts |= equal[n] >= n
    places = np.flatnonzero(starts)
    while True:
        at = np.searchsorted(places, i)
        if at == len(places):
            return keep
        i = int(places[at])
        n = next(n for n in lengths if equal[n][i] >= n)
        said = 1 + int(equal[n][i]) // n
        keep[i + n : i + said * n] = False
        i += said * n


def _chain_lags(ids: np.ndarray) -> list[int]:
    """Lengths at which a chain may repeat, ascending: distances between equal runs of SHORTEST_CHAIN words, which every
    repeated chain holds at its length. Runs are compared by a number, so a few lengths too many may come out."""
    n, longest = len(ids) - SHORTEST_CHAIN + 1, len(ids) // 2
    if longest < SHORTEST_CHAIN:
        return []
    run = np.zeros(n, np.uint64)
    for j in range(SHORTEST_CHAIN):
        run = run * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(run, kind="stable")
    run, lags = run[order], set()
    for step in range(1, n):
        same = run[:-step] == run[step:]
        if not same.any():
            break
        if step > 64:  # a text of little else than repetitions
            return list(range(SHORTEST_CHAIN, longest + 1))
        lags.update(np.unique(order[step:][same] - order[:-step][same]).tolist())
    return sorted(k for k in lags if SHORTEST_CHAIN <= k <= longest)


def _kept_after_chains(ids: np.ndarray) -> np.ndarray:
    """Places kept by one scan that drops the second of two equal chains of at least eight words, longest first."""
    longest = np.zeros(len(ids), np.int64)
    for k in _chain_lags(ids):
        same = ids[:-k] == ids[k:]
        if int(same.sum()) >= k:  # else no chain of this length can repeat
            longest[: len(same)][_equal_from(ids, k) >= k] = k
    keep = np.ones(len(ids), bool)
    i = 0
    places = np.flatnonzero(longest)
    while True:
        at = np.searchsorted(places, i)
        if at == len(places):
            return keep
        i = int(places[at])
        k = int(longest[i])
        keep[i + k : i + 2 * k] = False
        i += 2 * k


def _rewritten(value: str | None, least_words: int, scan) -> str:
    if value is None:
        return ""
    words = value.split()
    if len(words) < least_words:
        return value
    for _ in range(PASSES):
        keep = scan(_ids(words))
        if keep.all():
            break
        words = [w for w, k in zip(words, keep) if k]
    return " ".join(words)


def collapse_ngrams_py(value: str | None) -> str:
    return _rewritten(value, 2 * SHORTEST_GRAM, _kept_after_grams)


def remove_chains_py(value: str | None) -> str:
    return _rewritten(value, 2 * SHORTEST_CHAIN, _kept_after_chains)


def collapse_ngrams(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(collapse_ngrams_py)

    return run(c)


def remove_chains(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(remove_chains_py)

    return run(c)


def clean_text(df: DataFrame, text_col: str = "text", out: str = "value", line_aware: bool = False) -> DataFrame:
    """df with the cleaned text in a further column.

    In the original order the line breaks are gone before the line stages, which then find nothing to do; line_aware runs
    those first. Everything up to the scans is one projection, the scans one Arrow pass over it.
    """
    c = text.compress_points(F.col(text_col))
    if line_aware:
        c = lines.remove_dup_lines(lines.remove_marker_tables(lines.remove_lists(c)))
    c = text.truncate_attachments(text.remove_requisites(c))
    c = text.let(text.let(c, lines.collapse_token_runs), lines.collapse_marker_runs)
    at, names = len(df.columns), [*df.columns, out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [" ".join(remove_chains_py(collapse_ngrams_py(x)).split()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(done, pa.string())], names=names)

    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    return df.withColumn(out, c).mapInArrow(scan, schema)


def clean_generated(c: Column) -> Column:
    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return text.clean_generated_unescaped(unescape(c))


_AFTER_MARK = re.compile(r"(?<=[,;:—-])\s+|(?<=[,;:—-])(?=\S)")


def _packed(parts: list[str], most: int) -> list[str]:
    """Parts joined from left to right as long as they have at most `most` words together."""
    out: list[list[str]] = []
    used = 0
    for p in parts:
        n = len(p.split())
        if out and used + n <= most:
            out[-1].append(p)
            used += n
        else:
            out.append([p])
            used = n
    return [" ".join(x) for x in out]


def greedy_pack_py(sentence: str | None, most: int) -> list[str]:
    """Pieces of at most `most` words: cut after punctuation and packed, and what is still longer cut between words."""
    if not sentence or not sentence.strip():
        return []
    if len(sentence.split()) <= most:
        return [sentence.strip()]
    parts: list[str] = []
    for part in (p for p in _AFTER_MARK.split(sentence) if p and p.strip()):
        words = part.split()
        parts += [part.strip()] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
    return _packed(parts, most)


def greedy_pack(c: Column, most: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: greedy_pack_py(x, most))

    return run(c)
