"""Problem 1: clusters of letters that share one wording, by hierarchical density clustering.

Equal wordings are collapsed. Each wording gets a min-hash sketch of its word triples, and all pairs of wordings that
agree in a band of it are measured exactly, once, where the band is; a band of very many wordings is cut into blocks whose
pairs are tasks of their own, so its work grows with its square but no task does. No neighbour is left out for being one
of many, nor for its sketch: only a bound on the words in common, which can't be wrong, spares a measurement, and only
edges that no result can depend on are left behind. The distance is one minus the longest common subsequence
of words relative to the longer text. Core distances give mutual reachability, a distributed Borůvka forest
its minimum spanning trees, level by level, and the condensed hierarchy of the levels the most stable clusters; what would
split only below the first level, `epsilon`, stays whole, and what leaves a cluster above it is an outlier. The members
that leave their cluster last are its exemplars; members that don't share more than 1 - `epsilon` of their words with the
first of them, as at the far end of a chain, are outliers too.

Defined cases: null texts and texts of fewer than `least_words` words are in no cluster; words are what stands between
white space, without case and punctuation; copies count as members; ties go to the smaller id; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import join_by_hot_key, observed, written
from letterloom.llm.hierarchy import NEAREST, chosen_clusters
from letterloom.llm.spanning import spanning_levels

SKETCH, BAND = 36, 3
#: Wordings of a band that are compared at once with each other or as many more.
BLOCK = 1024
#: Pairs that are measured at once, limbs in a table of their matches, and the longest text, in limbs of 64 words, that is
#: measured so; the few longer ones are measured pair by pair.
PAIRS, TABLE, MOST_LIMBS = 1 << 14, 1 << 20, 4
#: Edges of a part that are held before those not needed are left out.
EDGES = 1 << 18
#: Bits for the words of a text, to tell what can't have enough in common.
BITS = 2048
#: Levels of the hierarchy, as multiples of epsilon; texts farther apart than the last are strangers.
LEVELS = (1.0, 1.2, 1.4)

_MULT = np.random.default_rng(11).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_OTHER = re.compile(r"[^\w]+|_+")
_NAMES_OR_NUMBERS = re.compile(r"\d|^\W*\[\w+\]\W*$")


class Words(dict):
    """A 63-bit number for each word, odd for numbers and markers, 0 for what is only punctuation."""

    def __missing__(self, token: str) -> int:
        import xxhash

        word = _OTHER.sub("", token.lower())
        value = 0
        if word:
            value = (xxhash.xxh64_intdigest(word.encode()) >> 1 | 2) & ~1 | bool(_NAMES_OR_NUMBERS.search(token))
        if len(self) < 1_000_000:
            self[token] = value
        return value


def marked_words(text: str, words: Words) -> np.ndarray:
    """Numbers of the words, odd for numbers and markers."""
    values = np.fromiter(map(words.__getitem__, text.split()), np.uint64)
    return values[values != 0]


def words_of(text: str, words: Words) -> np.ndarray:
    """Numbers of the words; a marker without its brackets is the same word."""
    return marked_words(text, words) & ~np.uint64(1)


def sketch_of(words: np.ndarray) -> np.ndarray:
    """16-bit min-hashes of the triples of words that are no numbers or markers; of the words where too few are left."""
    plain = words[(words & np.uint64(1)) == 0]
    if len(plain) < 8:
        plain = words
    if len(plain) >= 3:
        plain = plain[:-2] * np.uint64(0x9E3779B97F4A7C15) + plain[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + plain[2:] * np.uint64(0x165667B19E3779F9)
        plain = plain ^ (plain >> np.uint64(29))
    best = None
    for at in range(0, len(plain), 4096):  # very long texts in parts
        low = ((plain[at : at + 4096, None] * _MULT + _ADD) >> np.uint64(32)).min(0)
        best = low if best is None else np.minimum(best, low)
    return best.astype(np.uint16)


_BITS = [1 << i for i in range(2048)]


def places_of(words: list[int]) -> dict[int, int]:
    """Of each word the bits of its places."""
    places: dict[int, int] = {}
    get = places.get
    for w, bit in zip(words, _BITS):
        places[w] = get(w, 0) | bit
    for i in range(len(_BITS), len(words)):
        places[words[i]] = get(words[i], 0) | 1 << i
    return places


def common_words(size: int, places: dict[int, int], other: Iterable[int]) -> int:
    """Length of the longest common subsequence of a text of `size` words, given their places, and another: one machine
    operation on bit strings for each word of the other that both have."""
    mask = full = (1 << size) - 1
    for m in filter(None, map(places.get, other)):
        hit = mask & m
        mask = mask + hit | mask - hit  # carries only run upwards, beyond the bits that count
    return size - (mask & full).bit_count()


def wordings(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """row_id, sig, sketch, words of each text that takes part; sig is a digest of its words, words 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep, sigs, sketches, packed = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    values = marked_words(text, words)
                    if len(values) >= least_words:
                        keep.append(i)
                        plain = values & ~np.uint64(1)
                        sigs.append(hashlib.blake2b(plain.tobytes(), digest_size=16).digest())
                        sketches.append(sketch_of(values).tobytes())
                        packed.append((plain >> np.uint64(20)).astype(np.uint32).tobytes())
                ids = part.column(0).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.binary()) for x in (sigs, sketches, packed))], ["row_id", "sig", "sketch", "words"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "row_id bigint, sig binary, sketch binary, words binary")


def _band_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, id: an entry for each band of (sketch, id); the band's number stands above the 48 bits of its values."""
    bands = SKETCH // BAND
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sketch = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16).reshape(-1, SKETCH)
            wide = sketch.astype(np.uint64)
            band = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :] << np.uint64(48), len(sketch), 0)
            for i in range(BAND):
                band += wide[:, i::BAND] << np.uint64(16 * i)
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(part.column(1).to_numpy(), bands))], ["band", "id"])


def blocks(reps: DataFrame, words: DataFrame) -> DataFrame:
    """band, part, side, id, earlier, words: the wordings (id, sketch) of every band that two or more share, each band
    and part together and in order; words has (id, words), and earlier are the shared bands before this one.

    A band of more than BLOCK wordings is cut into several sides, and each two of them, and each alone, are a part, so
    every pair of a band meets in one part and none needs more memory than two sides. In parts of two sides only pairs of
    one with the other count.
    """
    entries = reps.select("sketch", "id").mapInArrow(_band_entries, "band bigint, id bigint")
    shared = entries.withColumn("n", F.expr("count(1) OVER (PARTITION BY band)")).filter("n > 1")
    mine = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("band", "n"))).alias("bands")).join(words, "id")
    each = mine.select("id", "words", "bands", F.posexplode("bands").alias("i", "x")).select(
        "id", "words", F.expr("slice(bands.band, 1, i)").alias("earlier"), F.col("x.band").alias("band"), F.ceil(F.col("x.n") / BLOCK).alias("sides")
    )
    each = each.withColumn("side", F.expr("pmod(xxhash64(id), sides)")).withColumn("other", F.explode(F.expr("sequence(0L, sides - 1)")))
    part = F.expr("CASE WHEN other = side THEN -1 - side ELSE least(side, other) * sides + greatest(side, other) END").alias("part")
    return each.select("band", part, "side", "id", "earlier", "words").repartition("band", "part").sortWithinPartitions("band", "part")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Consecutive rows of the same band and part in tables of at least `rows` rows, but for the last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while batch.num_rows - at:
            ahead = batch.slice(at)
            band, part = (ahead.column(i).to_numpy() for i in range(2))
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (part[1:] != part[:-1])
            if kept:
                last = kept[-1].slice(kept[-1].num_rows - 1)
                new[0] = last.column(0)[0].as_py() != band[0] or last.column(1)[0].as_py() != part[0]
            # the first begin of a group at which there are enough rows
            ends = np.flatnonzero(new)
            ends = ends[ends >= rows - sum(x.num_rows for x in kept)]
            ends = ends[ends > 0] if not kept else ends
            if not len(ends):
                kept.append(ahead)
                break
            if ends[0]:
                kept.append(ahead.slice(0, ends[0]))
            yield pa.Table.from_batches(kept)
            kept, at = [], at + int(ends[0])
    if kept:
        yield pa.Table.from_batches(kept)


class _Group:
    """The rows of some whole groups, by group and length, and their pairs."""

    def __init__(self, table: pa.Table):
        band, part, side, ids = (table.column(i).to_numpy() for i in range(4))
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new) - 1
        packed = table.column(5).to_pylist()
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        order = np.lexsort((size, group))
        self.group, self.size, self.ids = group[order], size[order], ids[order]
        self.side, self.crossed = side[order], part[order] >= 0
        self.packed = [packed[i] for i in order]
        self.end = np.searchsorted(self.group, self.group, "right")
        earlier = table.column(4).combine_chunks()
        known = np.zeros((len(band), SKETCH // BAND + 1), np.int64)
        flat = earlier.flatten().to_numpy()
        known[np.repeat(np.arange(len(band)), earlier.value_lengths().to_numpy()), flat >> 48] = flat
        self.known = known[order]

    def ranges(self, pairs: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """Rows whose pairs with the rows after them are about so many."""
        n = len(self.ids)
        before = np.concatenate([[0], np.cumsum(self.end - np.arange(n) - 1)])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(before, before[at] + pairs, "right")) - 1)
            if before[to] > before[at]:
                yield at, to
            at = to

    def pairs(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs of rows at to `to` with rows of their group after them that share no band before this one."""
        first = np.arange(at, to)
        count = self.end[at:to] - first - 1
        x = np.repeat(first, count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        keep = ~((self.known[x] == self.known[y]) & (self.known[x] != 0)).any(1)
        keep &= ~self.crossed[x] | (self.side[x] != self.side[y])
        return x[keep], y[keep]


def links(reps: DataFrame) -> DataFrame:
    """a < b: all pairs of wordings (id, sketch) that share a band, each once; near_links measures these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in map(_Group, _whole_groups(batches)):
            for at, to in rows.ranges():
                a, b = (rows.ids[x] for x in rows.pairs(at, to))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return blocks(reps, reps.select("id", F.lit(b"").alias("words"))).mapInArrow(run, "a bigint, b bigint")


class _Matched:
    """Longest common subsequences of many pairs of texts at once, by the method of common_words on limbs of 64 bits."""

    def __init__(self, rows: _Group):
        self.rows = rows
        self.begin = np.concatenate([[0], np.cumsum(rows.size)])
        row = np.repeat(np.arange(len(rows.size)), rows.size)
        words = np.frombuffer(b"".join(rows.packed), np.uint32).astype(np.int64)
        keys = rows.group[row] << 32 | words
        order = np.argsort(keys, kind="stable")
        keys, row, words = keys[order], row[order], words[order]
        new = np.diff(keys, prepend=-1) != 0
        number = np.cumsum(new) - 1
        first = np.searchsorted(keys[new], np.arange(rows.group[-1] + 2) << 32)
        #: the number of a word within its group, and of each row how many there are
        self.local = np.empty(len(keys), np.int32)
        self.local[order] = number - first[rows.group[row]]
        self.vocabulary = np.diff(first)[rows.group]
        # a bit for each word of a text, its second and further occurrences being words of their own
        begins = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))
        again = np.arange(len(keys)) - np.repeat(begins, np.diff(begins, append=len(keys)))
        bit = (words * 0x9E3779B1 + again * 0x85EBCA77 >> 13) % BITS
        marks = np.zeros((len(rows.size), BITS), bool)
        marks[row, bit] = True
        self.bits = np.packbits(marks, axis=1).view(np.uint64)
        self.doubled = rows.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def at_most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """No fewer than the words that rows x and y have in common in any order: common bits, and what may share one."""
        out = np.minimum(self.doubled[x], self.doubled[y])
        for at in range(0, len(x), 4096):
            part = slice(at, at + 4096)
            out[part] += np.bitwise_count(self.bits[x[part]] & self.bits[y[part]]).sum(1, dtype=np.int64)
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of rows x and y, x being no longer; x ascending."""
        out = np.empty(len(x), np.int64)
        limbs = np.where(self.rows.size[y] > 64 * MOST_LIMBS, MOST_LIMBS + 1, (self.rows.size[x] + 63) // 64)
        for k in np.unique(limbs):
            these = np.flatnonzero(limbs == k)
            if k > MOST_LIMBS:
                places, last = {}, -1
                for i in these:
                    if x[i] != last:
                        places, last = places_of(np.frombuffer(self.rows.packed[x[i]], np.uint32).tolist()), x[i]
                    out[i] = common_words(int(self.rows.size[x[i]]), places, memoryview(self.rows.packed[y[i]]).cast("I"))
                continue
            begins = np.flatnonzero(np.diff(x[these], prepend=-1))
            room = np.cumsum(self.vocabulary[x[these[begins]]] * k) // TABLE
            for to in np.split(these, begins[np.flatnonzero(np.diff(room)) + 1]):
                for at in range(0, len(to), PAIRS):
                    i = to[at : at + PAIRS]
                    out[i] = self._common(x[i], y[i], int(k))
        return out

    def _common(self, x: np.ndarray, y: np.ndarray, limbs: int) -> np.ndarray:
        texts, which = np.unique(x, return_inverse=True)
        base = np.cumsum(self.vocabulary[texts]) - self.vocabulary[texts]
        room = int(self.vocabulary[texts].sum())
        size = self.rows.size[texts]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = self.local[np.repeat(self.begin[texts], size) + place] + np.repeat(base, size)
        table = np.zeros((limbs, room), np.uint64)
        np.add.at(table.reshape(-1), (place >> 6) * room + at, np.uint64(1) << (place & 63).astype(np.uint64))
        steps = self.rows.size[y]
        order = np.argsort(-steps, kind="stable")
        steps, base = steps[order], base[which[order]]
        others, which = np.unique(y[order], return_inverse=True)
        size = self.rows.size[others]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        word = np.zeros((steps[0], len(others)), np.int32)
        word[place, np.repeat(np.arange(len(others)), size)] = self.local[np.repeat(self.begin[others], size) + place]
        live = np.searchsorted(-steps, -np.arange(steps[0]), "left")
        state = np.full((limbs, len(x)), ~np.uint64(0))
        for j, n in enumerate(live):
            hit = base[:n] + word[j].take(which[:n])
            carry = None
            for k in range(limbs):
                mask = state[k, :n]
                met = mask & table[k].take(hit)
                total = mask + met
                over = total < mask if k + 1 < limbs else None
                if carry is not None:
                    total += carry
                    if over is not None:
                        over |= total < carry
                carry = over.view(np.uint8) if over is not None else None
                np.subtract(mask, met, out=met)
                np.bitwise_or(total, met, out=mask)
        left = np.bitwise_count(state[:-1]).sum(0, dtype=np.int64)
        short = self.rows.size[x[order]]
        left += np.bitwise_count(state[-1] & (~np.uint64(0) >> ((limbs * 64 - short).astype(np.uint64))))
        out = np.empty(len(x), np.int64)
        out[order] = short - left
        return out


def needed(a: np.ndarray, b: np.ndarray, d: np.ndarray, nearest: int) -> np.ndarray:
    """Places of the edges that are among the `nearest` of one of their ends or in the least spanning forest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, d))
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    by_end = np.lexsort((np.concatenate([rank, rank]), ends))
    sorted_ends = ends[by_end]
    close = np.arange(len(ends)) - np.searchsorted(sorted_ends, sorted_ends) < nearest
    keep = np.zeros(len(a), bool)
    keep[by_end[close] % len(a)] = True
    # Borůvka: each component takes its least edge
    top = np.arange(len(nodes))
    x, y, live = ends[: len(a)][order], ends[len(a) :][order], np.arange(len(a))
    while len(live):
        cx, cy = top[x[live]], top[y[live]]
        apart = cx != cy
        live, cx, cy = live[apart], cx[apart], cy[apart]
        least = np.full(len(nodes), len(a))
        for c in (cx, cy):
            np.minimum.at(least, c, live)
        taken = np.flatnonzero(least < len(a))
        edge = least[taken]
        keep[order[edge]] = True
        up = np.arange(len(nodes))
        up[taken] = top[x[edge]] + top[y[edge]] - taken
        both = up[up] == np.arange(len(nodes))
        up = np.where(both, np.minimum(up, np.arange(len(nodes))), up)
        while (up[up] != up).any():
            up = up[up]
        top = up[top]
    return np.flatnonzero(keep)


def near_links(reps: DataFrame, words: DataFrame, limit: float, samples: int) -> DataFrame:
    """a < b, d: exact distances below `limit` of the pairs of wordings (id, sketch) that share a band.

    All pairs are measured, where their band is. What can't change the hierarchy is left there: on a cycle of edges every
    text has two that are no longer than the longest, so with up to 3 samples no core distance on it is longer either,
    and the longest is in no spanning tree of mutual reachability that needs it. What stays is the spanning forest of each
    part and, for the core distances, the nearest neighbours of each text. With more samples all pairs stay.
    """

    def only_needed(edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        keep = needed(*edges, samples - 1)
        return tuple(c[keep] for c in edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in map(_Group, _whole_groups(batches)):
            matched, found = _Matched(rows), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for at, to in rows.ranges():
                x, y = rows.pairs(at, to)
                possible = 1 - np.minimum(matched.at_most(x, y), rows.size[x]) / rows.size[y] < limit
                x, y = x[possible], y[possible]
                d = 1 - matched.common(x, y) / rows.size[y]
                near = d < limit
                a, b = rows.ids[x[near]], rows.ids[y[near]]
                found = tuple(map(np.concatenate, zip(found, (np.minimum(a, b), np.maximum(a, b), d[near]))))
                if samples > 3:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["a", "b", "d"])
                    found = tuple(c[:0] for c in found)
                elif len(found[0]) > EDGES:  # what isn't needed among these isn't needed among more either
                    found = only_needed(found)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, only_needed(found))), ["a", "b", "d"])

    return blocks(reps, words).mapInArrow(run, "a bigint, b bigint, d double")


class _Distances:
    """Word distances of packed texts; the bits of a text are kept while pairs that share it follow each other."""

    def __init__(self) -> None:
        self.kept, self.places, self.last = None, {}, (None, None)

    def __call__(self, x: bytes, y: bytes) -> float:
        if self.kept not in (x, y):
            self.kept = x if x == self.last[0] else y
            self.places = places_of(np.frombuffer(self.kept, np.uint32).tolist())
        self.last = x, y
        other = y if x == self.kept else x
        return 1 - common_words(len(self.kept) // 4, self.places, memoryview(other).cast("I")) / (max(len(x), len(y)) // 4)


def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, d of batches of a, b and the packed words of both."""
    distance = _Distances()
    for batch in batches:
        d = np.fromiter(map(distance, batch.column(2).to_pylist(), batch.column(3).to_pylist()), float, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(d)], ["a", "b", "d"])


def mutual_reachability(dist: DataFrame, copies: DataFrame, samples: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, w; id, copies, core): the core distance is that to the samples-th text, copies and the text itself counted.

    Each text counts for at least one, so no more than the nearest `samples` of a text are listed.
    """
    repeated = copies.filter("copies > 1")
    for end in ("a", "b"):
        dist = dist.join(repeated.select(F.col("id").alias(end), F.col("copies").alias(f"c{end}")), end, "left")
    one = F.lit(1).cast("bigint")
    side = lambda a, b: dist.select(F.col(a).alias("a"), F.coalesce(f"c{a}", one).alias("own"), F.struct("d", F.coalesce(f"c{b}", one).alias("c")).alias("x"))
    both = side("a", "b").unionByName(side("b", "a"))
    nearest = both.withColumn("place", F.expr("row_number() OVER (PARTITION BY a ORDER BY x)")).filter(F.col("place") <= samples)
    lists = nearest.groupBy("a").agg(F.min("own").alias("own"), F.array_sort(F.collect_list("x")).alias("near"))
    reach = F.aggregate(
        "near", F.struct(F.col("own").alias("n"), F.lit(None).cast("double").alias("k")),
        lambda s, x: F.struct((s["n"] + x["c"]).alias("n"), F.coalesce(s["k"], F.when(s["n"] + x["c"] >= samples, x["d"])).alias("k")),
    )
    core = lists.select(F.col("a").alias("id"), F.col("own").alias("copies"), F.when(F.col("own") >= samples, 0.0).otherwise(F.coalesce(reach["k"], F.lit(1.0))).alias("core"))
    core = written(core, "cores")
    ends = dist.join(core.select(F.col("id").alias("a"), F.col("core").alias("x")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("y")), "b")
    return ends.select("a", "b", F.greatest("d", "x", "y").alias("w")), core


def wording_clusters(df: DataFrame, id_col: str, text_col: str, least_rows: int = 8, least_words: int = 15, samples: int = 3, epsilon: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(row_id, first_id of every member of a cluster; first_id, n_rows, exemplars of every cluster)."""
    rows, seen = observed(wordings(df, id_col, text_col, least_words), "wordings", F.count(F.lit(1)).alias("n"))
    reps = rows.groupBy("sig").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch"))
    reps = written(reps, "representatives")
    copies = reps.select("id", "copies")
    words = rows.select(F.col("row_id").alias("id"), "words")
    levels = [epsilon * x for x in LEVELS]
    dist = written(near_links(reps, words, levels[-1], samples), "distances")
    edges, core = mutual_reachability(dist, copies, samples)
    forest, (low, *higher) = spanning_levels(edges, levels)
    # the distance at which a wording parts from its last neighbour; copies never part
    ends = forest.select(F.col("a").alias("id"), "w").unionByName(forest.select(F.col("b").alias("id"), "w")).groupBy("id").agg(F.min("w").alias("leaves"))
    linked = core.join(ends, "id").select("id", "copies", F.when(F.col("copies") >= samples, 0.0).otherwise(F.col("leaves")).alias("leaves"), "core")
    # what has no neighbour is a cluster only by its copies
    alone = copies.filter(F.col("copies") >= least_rows).join(ends, "id", "left_anti").select("id", "copies", F.lit(0.0).alias("leaves"), F.lit(0.0).alias("core"))
    nodes = linked.unionByName(alone)
    if low is not None:
        nodes = nodes.join(low.select(F.col("c").alias("id"), F.col("up").alias("c0")), "id", "left")
    nodes = written(nodes.withColumn("c0", F.coalesce("c0", "id") if low is not None else F.col("id")), "nodes")
    components = nodes.groupBy(F.col("c0").alias("c")).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") / F.greatest("leaves", F.lit(NEAREST))).alias("rate"))
    chosen = chosen_clusters(written(components, "components"), higher, levels, least_rows)
    inside = nodes.join(chosen, "c0").select("cluster", "id", "copies", "leaves", "core")
    members, described = close_to_exemplar(written(inside, "inside"), words, least_rows, epsilon)
    by_sig = reps.select("sig", "id").join(members, "id").select("sig", "first_id", "copies")
    return join_by_hot_key(rows.select("row_id", "sig"), by_sig, "sig", "copies", seen["n"]).select("row_id", "first_id"), described


def close_to_exemplar(inside: DataFrame, words: DataFrame, least_rows: int, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """(id, first_id, copies; first_id, n_rows, exemplars) of the members (cluster, id, copies, leaves, core) that are
    near enough to the member that leaves last, where they are still enough."""
    order = F.struct("leaves", "core", "id")
    heads, seen = observed(inside.groupBy("cluster").agg(F.min(order).getField("id").alias("head"), F.count(F.lit(1)).alias("size")), "heads", F.sum("size").alias("n"))
    total = seen["n"] or 0
    packed = heads.filter("size > 1").join(words.select(F.col("id").alias("head"), F.col("words").alias("wa")), "head")
    mine = inside.select("cluster", "id").join(words, "id")
    pairs = join_by_hot_key(mine, packed, "cluster", "size", total).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), "wa", F.col("words").alias("wb"))
    far = pairs.mapInArrow(distances, "a bigint, b bigint, d double").filter(F.col("d") >= epsilon).select(F.col("b").alias("id"))
    near = written(inside.join(far, "id", "left_anti"), "near")
    sizes = near.groupBy("cluster").agg(F.sum("copies").alias("n_rows"), F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"))
    sizes = written(sizes.filter(F.col("n_rows") >= least_rows), "sizes")
    members = join_by_hot_key(near, sizes, "cluster", "size", total).select("id", "first_id", "copies")
    # the limit of three applies before rows are shuffled
    top = near.withColumn("place", F.expr("row_number() OVER (PARTITION BY cluster ORDER BY leaves, core, id)")).filter("place <= 3")
    exemplars = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).getField("id").alias("exemplars"))
    return members, sizes.join(exemplars, "cluster").select("first_id", "n_rows", "exemplars")
