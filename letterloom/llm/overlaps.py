"""Problem 4: evaluation texts that occur, exactly or nearly, in the training texts, by an edit-distance segment join.

The distance of two texts is the least number of words to add, remove or replace; it may be at most 15 % of the words of
the longer one. An evaluation text of L words is cut into one segment more than the most edits any partner allows, so in
every partner at least one segment stands unchanged, at a place that the edits allow. Any disjoint segments do: those
that are rarest among the evaluation texts are taken, which keeps phrases that all letters share out of the join. Of the
training substrings only those pass that a fixed-size bitmap of all segments may hold. Pairs that agree in a segment are
tested by place, length and a 128-bit parity sketch of their words (an edit changes two bits at most), none of which
loses a pair, and then verified by banded dynamic programming over many pairs at once.

Equal texts are collapsed on both sides before the join and spread over their rows after it; the report counts pairs
by the copies of both sides and spreads nothing.

Defined cases: null, empty, blank, wordless and marker-only texts take no part; words are what stands between white
space, without case and punctuation; labels don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.clusters import Words, marked_words, words_of
from letterloom.llm.common import HOT_PARTS, hot_keys, join_by_hot_key, join_salted, observed, written

PERCENT = 15
#: Counters of segment frequencies, sent to all tasks.
COUNTERS = 1 << 19
#: Bits a segment of the map of all segments, and the most and least bits that are sent to all tasks. Beyond the most the
#: map thins the training substrings less, but loses none.
BITS_A_SEGMENT, MOST_BITS, LEAST_BITS, BLOCK_BITS = 32, 1 << 30, 1 << 20, 1 << 18
#: Words of a long text whose segments are chosen together.
STRETCH = 512

_MARKERS = re.compile(r"\[[^\[\]]*\]|[^\w]|_")


def most_edits(words: int) -> int:
    """Edits that a text of so many words allows with its longest partner."""
    return PERCENT * (words * 100 // (100 - PERCENT)) // 100


def segment_words(words: int) -> int:
    """Length of the segments of a text: most_edits() + 1 of them always fit."""
    return 4 if words >= 24 else 3 if words >= 12 else 2 if words >= 5 else 1


def grams(words: np.ndarray, q: int) -> np.ndarray:
    if len(words) < q:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - q + 1, q, np.uint64)
    for j in range(q):
        h = (h ^ words[j : len(words) - q + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def rarest_segments(cost: np.ndarray, words: int, q: int, number: int) -> list[int]:
    """Starts of `number` disjoint segments of q words with the least total cost; long texts in stretches, each of which
    gives its part of them."""
    if words > 2 * STRETCH:
        parts = -(-words // STRETCH)
        edges, upto = words * np.arange(parts + 1) // parts, number * np.arange(parts + 1) // parts
        return [int(e) + at for e, f, n in zip(edges[:-1], edges[1:], np.diff(upto)) for at in rarest_segments(cost[e : f - q + 1], int(f - e), q, int(n))]
    best = np.full((words + 1, number + 1), np.inf)
    best[:, 0] = 0
    taken = np.zeros((words + 1, number + 1), bool)
    for end in range(1, words + 1):
        best[end] = best[end - 1]
        if end >= q:
            other = best[end - q, :-1] + cost[end - q]
            less = other < best[end, 1:]
            best[end, 1:][less] = other[less]
            taken[end, 1:] = less
    starts, end = [], words
    while number:
        if taken[end, number]:
            end -= q
            number -= 1
            starts.append(end)
        else:
            end -= 1
    return starts


def sketch_of(words: np.ndarray) -> tuple[int, int]:
    """Parity of the words that fall on each of 128 bits."""
    odd = np.bincount(((words >> np.uint64(40)) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return int(low), int(high)


def edit_distances(left: list[np.ndarray], right: list[np.ndarray], limit: int) -> np.ndarray:
    """Word edit distances of pairs, limit + 1 where they are above the limit; one band of diagonals for all pairs."""
    n, width = len(left), 2 * limit + 1
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows = int(la.max())
    a = np.zeros((n, rows), np.int64)
    b = np.full((n, rows + width + 1), -1, np.int64)  # column j of a right text stands at j + limit
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, : len(x)] = x
        cut = min(len(y), rows + limit)
        b[i, limit : limit + cut] = y[:cut]
    far = np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    column = step - limit  # of the right text, after row 0
    d = np.where(column >= 0, column, far).astype(np.int32)[None, :].repeat(n, 0)
    out = np.where((la == 0) & (lb <= limit), lb, limit + 1)
    of = np.arange(n)  # the pairs that are still near enough
    for i in range(1, rows + 1):
        change = d + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        drop = np.concatenate([d[:, 1:], np.full((len(d), 1), far, np.int32)], 1) + 1
        d = np.minimum(change, drop)
        d[:, column + i < 0] = far
        if i <= limit:
            d[:, limit - i] = i
        d = np.minimum.accumulate(d - step, axis=1) + step
        done = np.flatnonzero((la == i) & (np.abs(lb - la) <= limit))
        out[of[done]] = np.minimum(limit + 1, d[done, (lb - la)[done] + limit])
        if i % 8 == 0:  # the least of a row never falls again
            live = np.flatnonzero((d.min(1) <= limit) & (la > i))
            if len(live) < len(d):
                if not len(live):
                    break
                a, b, d, la, lb, of = a[live], b[live], d[live], la[live], lb[live], of[live]
    return out


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, sig of each text that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keep, sigs = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                values = marked_words(text, words)
                if len(values) and ((values & np.uint64(1)).min() == 0 or _MARKERS.sub("", text).strip()):
                    keep.append(i)
                    sigs.append(hashlib.blake2b((values & ~np.uint64(1)).tobytes(), digest_size=16).digest())
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sigs, pa.binary())], ["row_id", "sig"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return written(rows.mapInArrow(run, "row_id bigint, sig binary"), "texts")


def _chosen(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.join(ids.select("id"), "id", "left_semi")


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often segments fall on each of COUNTERS counters, summed by task and then by counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, w in _batches_of_words(batches):
            np.add.at(total, (grams(w, segment_words(len(w))) >> np.uint64(45)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    summed = texts.mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[summed.column("counter").to_numpy()] = summed.column("n").to_numpy()
    return np.minimum(often, 1 << 30).astype(np.int32)


def segment_map(segs: DataFrame, number: int) -> np.ndarray:
    """Bits set at the leading bits of every h; each task sets those of one stretch of BLOCK_BITS."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, number * BITS_A_SEGMENT):
        bits *= 2
    shift, width = 64 - (bits.bit_length() - 1), BLOCK_BITS // 8
    place = F.shiftrightunsigned("h", shift)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["place"].to_numpy()
        block = np.zeros(BLOCK_BITS, np.uint8)
        block[at % BLOCK_BITS] = 1
        return pd.DataFrame({"block": [int(at[0] // BLOCK_BITS)], "part": [np.packbits(block, bitorder="little").tobytes()]})

    places = segs.select(place.alias("place")).distinct().withColumn("block", F.floor(F.col("place") / BLOCK_BITS))
    out = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy("block").applyInPandas(fill, "block bigint, part binary").toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["part"], np.uint8)
    return out


def _batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    words = Words()
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield i, words_of(text, words)


_ROWS = "h bigint, id bigint, at int, n int, s1 bigint, s2 bigint"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "id", "at", "n", "s1", "s2"])


def segments(texts: DataFrame) -> tuple[DataFrame, int]:
    """h, id, at, n, s1, s2 of the chosen segments of every evaluation text (id, text), and how many there are."""

    often = _frequencies(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, w in _batches_of_words(batches):
            q = segment_words(len(w))
            h = grams(w, q)
            s1, s2 = sketch_of(w)
            signed = h.view(np.int64)
            for at in rarest_segments(often[(h >> np.uint64(45)).astype(np.int64)], len(w), q, most_edits(len(w)) + 1):
                rows.append((int(signed[at]), i, at, len(w), s1, s2))
            if len(rows) > 50_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    segs, seen = observed(texts.mapInArrow(cut, _ROWS), "segments", F.count(F.lit(1)).alias("n"))
    return segs, seen["n"]


def substrings(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """h, id, at, n, s1, s2 of the training substrings that a segment may equal."""
    shift = np.uint64(64 - ((len(bitmap) * 8).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                hs, ids, ats, ns, ones, twos = [], [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = words_of(text, words)
                    n = len(w)
                    shortest, longest = -(-n * (100 - PERCENT) // 100), n * 100 // (100 - PERCENT)
                    sketch = None
                    for q in range(segment_words(shortest), segment_words(longest) + 1):
                        h = grams(w, q)
                        place = (h >> shift).astype(np.int64)
                        at = np.flatnonzero(bitmap[place >> 3] >> (place & 7) & 1)
                        if len(at):
                            sketch = sketch or sketch_of(w)
                            hs.append(h[at])
                            ats.append(at)
                            ids.append((i, n, *sketch, len(at)))
                if not hs:
                    continue
                many = np.array([x[4] for x in ids])
                column = lambda c: np.repeat(np.array([x[c] for x in ids], np.int64), many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(column(0)), pa.array(np.concatenate(ats).astype(np.int32)), pa.array(column(1).astype(np.int32)), pa.array(column(2)), pa.array(column(3))],
                    ["h", "id", "at", "n", "s1", "s2"],
                )

    return texts.mapInArrow(run, _ROWS)


def candidates(segs: DataFrame, subs: DataFrame, number: int) -> DataFrame:
    """u, v: pairs that share a segment at places the edits allow and whose sketches differ in few enough bits.

    Segments that very many evaluation texts have, as texts of common phrases only do, are split by training text.
    """
    left = segs.select("h", F.col("id").alias("u"), F.col("at").alias("p"), F.col("n").alias("nu"), F.col("s1").alias("u1"), F.col("s2").alias("u2"))
    right = subs.select("h", F.col("id").alias("v"), F.col("at").alias("r"), F.col("n").alias("nv"), F.col("s1").alias("v1"), F.col("s2").alias("v2"))
    edits = F.floor(F.greatest("nu", "nv") * F.lit(PERCENT) / F.lit(100))
    shift = F.col("p") - F.col("r")
    bits = F.bit_count(F.col("u1").bitwiseXOR(F.col("v1"))) + F.bit_count(F.col("u2").bitwiseXOR(F.col("v2")))
    both = join_salted(left, right, "h", "v", hot_keys(segs, "h", number)).filter((F.abs(shift) + F.abs(F.col("nu") - F.col("nv") - shift) <= edits) & (bits <= edits * 2))
    return both.select("u", "v").distinct()


def _packed_words(texts: DataFrame, id_name: str, words_name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            packed = [(words_of(t, words) >> np.uint64(20)).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], [id_name, words_name])

    return texts.mapInArrow(run, f"{id_name} bigint, {words_name} binary")


def verified(pairs: DataFrame) -> DataFrame:
    """u, v, edits of pairs (u, v, wu, wv) that are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
            right = [np.frombuffer(x, np.uint32) for x in batch.column(3).to_pylist()]
            limit = np.array([PERCENT * max(len(x), len(y)) // 100 for x, y in zip(left, right)], np.int64)
            found = limit + 1
            order = np.argsort(limit, kind="stable")
            at = 0
            while at < len(order):  # pairs of like limits together, as many as fit a few MB
                most = max(1, 2_000_000 // (2 * int(limit[order[at]]) + 64))
                take = order[at : at + min(most, 1024)]
                take = take[limit[take] <= limit[order[at]] * 1.25 + 2]
                band = int(limit[take].max())
                found[take] = edit_distances([left[i] for i in take], [right[i] for i in take], band)
                at += len(take)
            good = np.flatnonzero(found <= limit)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(found[good].astype(np.int32))], ["u", "v", "edits"])

    return pairs.select("u", "v", "wu", "wv").mapInArrow(run, "u bigint, v bigint, edits int")


class Overlaps:
    """Near pairs of texts, one row for each pair of different wordings, and the rows that hold these.

    near: u, v, edits with the smallest row ids of both wordings. test, train: sig, id (that smallest row id) and copies.
    """

    def __init__(self, test: DataFrame, train: DataFrame, id_col: str = "row_id", text_col: str = "text"):
        self.test_rows, self.train_rows = _texts(test, id_col, text_col), _texts(train, id_col, text_col)
        group = lambda rows, name: written(rows.groupBy("sig").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies")), name)
        self.test, self.train = group(self.test_rows, "test-reps"), group(self.train_rows, "train-reps")
        segs, number = segments(_chosen(test, id_col, text_col, self.test))
        subs = substrings(_chosen(train, id_col, text_col, self.train), segment_map(segs, number))
        pairs = written(candidates(segs, subs, number), "pairs")
        wu = _packed_words(_chosen(test, id_col, text_col, pairs.select(F.col("u").alias("id")).distinct()), "u", "wu")
        wv = _packed_words(_chosen(train, id_col, text_col, pairs.select(F.col("v").alias("id")).distinct()), "v", "wv")
        self.near = written(verified(pairs.join(wu, "u").join(wv, "v")), "near-pairs")

    @staticmethod
    def _members(rows: DataFrame, reps: DataFrame, used: DataFrame, row: str, rep: str) -> DataFrame:
        """row, rep: the rows of the wordings in used; wordings with very many rows are joined apart."""
        total = reps.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        mine = reps.join(used.select(F.col(rep).alias("id")).distinct(), "id", "left_semi")
        return join_by_hot_key(rows, mine, "sig", "copies", total).select(F.col("row_id").alias(row), F.col("id").alias(rep))

    def test_members(self) -> DataFrame:
        return self._members(self.test_rows, self.test, self.near, "test_id", "u")

    def train_members(self) -> DataFrame:
        return self._members(self.train_rows, self.train, self.near, "train_id", "v")

    def pairs(self) -> DataFrame:
        """test_id, train_id, edits of every pair of rows; as many as there are, so pairs of texts that both have many
        copies are split over tasks by the row of the training side."""
        copies = self.near.join(self.train.select(F.col("id").alias("v"), "copies"), "v").join(self.test.select(F.col("id").alias("u"), F.col("copies").alias("cu")), "u")
        copies = written(copies, "near-copies")
        sums = copies.agg(F.sum("copies").alias("rows"), F.sum("cu").alias("cu")).first()
        spread = lambda side, key, n, total: side.groupBy(key).agg(F.sum(n).alias("_n")).filter(F.col("_n") > max(64, (total or 0) // HOT_PARTS)).select(key)
        by_train = join_salted(copies.select("u", "v", "edits"), self.train_members(), "v", "train_id", spread(copies, "v", "copies", sums["rows"]))
        return join_salted(self.test_members(), by_train, "u", "train_id", spread(copies, "u", "copies", sums["rows"])).select("test_id", "train_id", "edits")

    def report(self, test: DataFrame, id_col: str = "row_id") -> DataFrame:
        """split, source, rows, overlapping rows, exact and near pairs, by the copies of the training side."""
        by_rep = self.near.join(self.train.select(F.col("id").alias("v"), "copies"), "v").groupBy("u").agg(
            F.sum("copies").alias("pairs"), F.coalesce(F.sum(F.when(F.col("edits") == 0, F.col("copies"))), F.lit(0)).alias("exact")
        )
        counted = self.test_members().join(by_rep, "u").select(F.col("test_id").alias(id_col), "pairs", "exact")
        joined = test.select(id_col, "split", "source").join(counted, id_col, "left")
        return joined.groupBy("split", "source").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"),
            F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_pairs"), F.coalesce(F.sum(F.col("pairs") - F.col("exact")), F.lit(0)).alias("near_pairs"),
        )


def overlaps(test: DataFrame, train: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """test_id, train_id, edits of every pair of rows that are near enough."""
    return Overlaps(test, train, id_col, text_col).pairs()
