"""Truncated singular value decomposition of the weights of texts, without moving the entries of their matrix.

The subspace iteration of `reduction.truncated_svd`, from the same start, where the texts are: parts of the texts (see
`weights`) are coded once, as the places of their words, and read anew in every pass. Parts form groups of about GROUP_BYTES of
text, and the terms of all texts buckets by their hash. In a pass each bucket gives every group the vectors of the terms
that it has; the group carries them to its documents and back, both ways in one go, and gives each bucket the sums. Only
these move, a vector for each term of a group, as 32-bit numbers; products of their columns reach the driver. What makes the
columns orthonormal is one small matrix, which the next pass applies to the vectors that it gets; it also turns them to the
singular directions found so far, so that no column hides a smaller one by its rounding.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators import weights as W
from letterloom.operators.reduction import SPARE, _orthonormal

#: Bytes of text in a group, about: more share more terms.
GROUP_BYTES = 128_000_000
#: Words that are taken apart at once.
STEP = 60_000
#: The most frequent terms of a group, whose products are those of full matrices.
FULL = 8192
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what is computed inside go with the job and not whenever the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _kept(df: DataFrame) -> DataFrame:
    """df computed, with its shuffle files removed, in the folder that all executors share; without one only a local master
    keeps it itself."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return df.checkpoint()
    return df.localCheckpoint()


def _packed(value: object) -> bytes:
    return zlib.compress(pickle.dumps(value, protocol=5), 1)


def _unpacked(data: bytes) -> object:
    return pickle.loads(zlib.decompress(data))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32)


_INDEX = "bucket int, part bigint, data binary"


def _settled(how: W.Weights):
    """The terms of a bucket that count: a row with their sorted names, and one for each part with their block, place in the
    part, place in the bucket and frequency."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prefix = pc.cast(table.column("block"), pa.string())
        names = pc.binary_join_element_wise(prefix, table.column("term"), ":").combine_chunks().dictionary_encode()
        term, n = names.indices.to_numpy().astype(np.int64), table.column("n").to_numpy()
        df = np.bincount(term, n, len(names.dictionary)).astype(np.int64)
        good = np.flatnonzero((df >= how.min_df) & (df <= how.max_df * how.n_docs))
        good = good[pc.sort_indices(names.dictionary.take(pa.array(good))).to_numpy()]
        place = np.full(len(df), -1)
        place[good] = np.arange(len(good))
        part, block, at = (table.column(c).to_numpy() for c in ("part", "block", "at"))
        has = np.flatnonzero(place[term] >= 0)
        has = has[np.lexsort((place[term[has]], part[has]))]
        ends = [*np.flatnonzero(np.concatenate([[True], part[has][1:] != part[has][:-1]])), len(has)] if len(has) else [0]
        parts = [None] + [int(part[has[i]]) for i in ends[:-1]]
        data = [_packed(names.dictionary.take(pa.array(good)).to_pylist())]
        for i, j in zip(ends, ends[1:]):
            x = has[i:j]
            data.append(_packed([_small(v) for v in (block[x], at[x], place[term[x]], df[term[x]])]))
        return pa.table([pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int32()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["bucket", "part", "data"])

    return run


def _coded(kinds: tuple[str, ...], how: W.Weights):
    """The documents of a part as the places of their words, with key (bucket and place) and idf of each term that counts."""

    def run(table: pa.Table, index: pa.Table) -> pa.Table:
        part, blocks = W.Part(table, kinds), []
        rows = sorted(zip(index.column("bucket").to_pylist(), index.column("data").to_pylist()))
        key = [np.full(len(b.vocabulary), -1, np.int64) for b in part.blocks]
        idf = [np.zeros(len(b.vocabulary)) for b in part.blocks]
        for bucket, data in rows:
            block, at, place, df = _unpacked(data)
            for i, (k, x) in enumerate(zip(key, idf)):
                of = block == i
                k[at[of]] = (bucket << 32) + place[of].astype(np.int64)
                x[at[of]] = np.log((1.0 + how.n_docs) / (1 + df[of])) + 1
        for b, k, x in zip(part.blocks, key, idf):
            if b.kind == "words":
                word, pair = k[b.word] >= 0, k[b.pair] >= 0
                arrays = {"doc": b.doc[word], "word": b.word[word], "pair_doc": b.pair_doc[pair], "pair": b.pair[pair]}
            else:
                arrays = {"doc": b.doc, "word": b.word, "grams": b.grams, "starts": b.starts, "sizes": b.sizes}
            blocks.append((b.kind, {c: _small(v) for c, v in arrays.items()}, k, x))
        out = pa.array([_packed((part.ids, blocks))], pa.binary())
        return pa.table([table.column("part").slice(0, 1), out], ["part", "code"]) if table.num_rows else pa.table([pa.array([], pa.int64()), out.slice(0, 0)], ["part", "code"])

    return run


def _restored(code: bytes) -> tuple[W.Part, list[np.ndarray], list[np.ndarray]]:
    """The part, and of each block's terms the key and idf."""
    ids, blocks = _unpacked(code)
    part = W.Part.__new__(W.Part)
    part.ids, part.blocks = ids, []
    for kind, arrays, k, _ in blocks:
        b = W.Block.__new__(W.Block)
        b.kind, b.vocabulary = kind, range(len(k))
        for c, v in arrays.items():
            setattr(b, c, v.astype(np.int64))
        part.blocks.append(b)
    return part, [b[2] for b in blocks], [b[3] for b in blocks]


class _Group:
    """Texts of a group and the matrix of their weights, read from the codes of its parts range by range."""

    def __init__(self, codes: list[bytes], sublinear: bool):
        self.codes, self.sublinear = codes, sublinear
        keys, idf = [np.empty(0, np.int64)], [np.empty(0)]
        for code in codes:
            for k, x in zip(*_restored(code)[1:]):
                keys.append(k[k >= 0])
                idf.append(x[k >= 0])
        self.keys, first = np.unique(np.concatenate(keys), return_index=True)
        common = np.argsort(np.concatenate(idf)[first], kind="stable")[:FULL]  # the smaller the idf, the more frequent
        self.common = np.sort(common)
        self.column = np.full(len(self.keys), -1, np.int64)
        self.column[self.common] = np.arange(len(self.common))

    def ranges(self) -> Iterator[tuple[W.Part, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """part, low, high; document - low, term of the group and weight of each entry."""
        for code in self.codes:
            part, keys, idf = _restored(code)
            places = [np.searchsorted(self.keys, k) for k in keys]
            for low, high in part.ranges(STEP):
                size, of = high - low, []
                for b, k, x, place in zip(part.blocks, keys, idf, places):
                    doc, term, n = b.entries(low, high)
                    good = k[term] >= 0
                    doc, term, n = doc[good], term[good], n[good]
                    of.append((doc, place[term], (1 + np.log(n) if self.sublinear else n) * x[term]))
                own = [np.bincount(doc, w * w, size) for doc, _, w in of]
                present = sum((x > 0).astype(np.int64) for x in own)
                scaled = [w / np.sqrt(x * present)[doc] for (doc, _, w), x in zip(of, own)]
                yield part, low, high, np.concatenate([x[0] for x in of]), np.concatenate([x[1] for x in of]), np.concatenate(scaled)

    def through(self, x: np.ndarray, back: bool) -> Iterator[tuple]:
        """For each range part, low, rows that have entries, their sums of x (term by column); back: self.sums as well, of
        the terms by these."""
        columns, self.sums = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1]) if back else None
        top = x[self.common]
        top_sums = np.zeros(top.shape)
        for part, low, high, doc, term, w in self.ranges():
            size, column = high - low, self.column[term]
            has = np.bincount(doc, minlength=size) > 0
            often, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
            full = np.zeros((size, len(self.common)))
            full.ravel()[doc[often] * len(self.common) + column[often]] = w[often]
            y = full @ top
            doc, term, w = doc[rare], term[rare], w[rare]
            for j, c in enumerate(columns):
                y[:, j] += np.bincount(doc, c[term] * w, size)
            if back:
                top_sums += full.T @ y
                for j, s in enumerate(self.sums):
                    s += np.bincount(term, y[:, j][doc] * w, len(s))
            yield part, low, np.flatnonzero(has), y
        if back:
            self.sums = self.sums.T
            self.sums[self.common] += top_sums


def _vectors(rows: pa.Table, width: int) -> np.ndarray:
    order = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
    return np.frombuffer(b"".join(rows.column("x").combine_chunks().take(pa.array(order)).to_pylist()), np.float32).reshape(-1, width).astype(float)


def _blobs(bucket: list, x: list, names: tuple[str, ...], *others: pa.Array) -> pa.Table:
    return pa.table([*others, pa.array(bucket, pa.int32()), pa.array(x, pa.binary())], list(names))


def _places(index: pa.Table) -> dict[int, np.ndarray]:
    """Of each group the places in the bucket of the terms that it has, in order."""
    out: dict[int, list[np.ndarray]] = {}
    for group, data in zip(index.column("group").to_pylist(), index.column("data").to_pylist()):
        if group is not None:
            out.setdefault(group, []).append(_unpacked(data)[2])
    return {g: np.unique(np.concatenate(p)) for g, p in sorted(out.items())}


def _gathered(width: int):
    """group, bucket, x: the vectors of a bucket that each group needs."""

    def run(index: pa.Table, vectors: pa.Table) -> pa.Table:
        places = _places(index)
        x = np.frombuffer(b"".join(vectors.column("x").to_pylist()), np.float32).reshape(-1, width)
        bucket = index.column("bucket").to_pylist()[:1] * len(places)
        return _blobs(bucket, [x[p].tobytes() for p in places.values()], ("group", "bucket", "x"), pa.array(list(places), pa.int64()))

    return run


def _carried(turn: np.ndarray, sublinear: bool):
    """group, bucket, x: sums for the terms of a group by bucket, and under bucket -1 the products of its documents' columns."""

    def run(codes: pa.Table, vectors: pa.Table) -> pa.Table:
        group = _Group(codes.column("code").to_pylist(), sublinear)
        products = np.zeros((turn.shape[1],) * 2)
        for *_, y in group.through(_vectors(vectors, len(turn)) @ turn, True):
            products += y.T @ y
        bucket = group.keys >> 32
        ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        sums = group.sums.astype(np.float32)
        x = [sums[i:j].tobytes() for i, j in zip(ends, ends[1:])] + [products.tobytes()]
        name = codes.column("group").to_pylist()[:1] * len(x)
        return _blobs([*(int(bucket[i]) for i in ends[:-1]), -1], x, ("group", "bucket", "x"), pa.array(name, pa.int64()))

    return run


def _totals(width: int):
    """bucket, x, products: the vectors of a bucket from the sums of all groups, and the products of their columns."""

    def run(index: pa.Table, sums: pa.Table) -> pa.Table:
        bucket = [*sums.column("bucket").to_pylist()[:1], *index.column("bucket").to_pylist()[:1]][0]
        if bucket == -1:
            total, x = sum(np.frombuffer(b) for b in sums.column("x").to_pylist()), None
        else:
            places = _places(index)
            vectors = np.zeros((1 + max((int(p[-1]) for p in places.values()), default=-1), width))
            for group, b in sorted(zip(sums.column("group").to_pylist(), sums.column("x").to_pylist())):
                vectors[places[group]] += np.frombuffer(b, np.float32).reshape(-1, width)
            vectors = vectors.astype(np.float32)
            total, x = vectors.T.astype(float) @ vectors, vectors.tobytes()
        return pa.table([pa.array([bucket], pa.int32()), pa.array([x], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["bucket", "x", "products"])

    return run


def _started(seed: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for data in batch.column(1).to_pylist():
                terms = [np.random.default_rng((seed, zlib.crc32(t.encode()))).standard_normal(width) for t in _unpacked(data)]
                x.append(np.array(terms, np.float32).reshape(-1, width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["bucket", "x"])

    return run


def _placed(turn: np.ndarray, sublinear: bool):
    """doc_id, x of the documents of a group that have terms."""

    def run(codes: pa.Table, vectors: pa.Table) -> pa.Table:
        group, ids, out = _Group(codes.column("code").to_pylist(), sublinear), [], []
        for part, low, has, y in group.through(_vectors(vectors, len(turn)) @ turn, False):
            ids.append(part.ids.take(pa.array(low + has)))
            out.append(y[has])
        ids = pa.chunked_array(ids, ids[0].type if ids else pa.int64())
        x = np.concatenate(out) if out else np.empty((0, turn.shape[1]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.table([ids, lists], ["doc_id", "x"])

    return run


def _named(turn: np.ndarray):
    def run(index: pa.Table, vectors: pa.Table) -> pa.Table:
        names = [t for part, data in zip(index.column("part").to_pylist(), index.column("data").to_pylist()) if part is None for t in _unpacked(data)]
        x = _vectors(vectors, len(turn)) @ turn
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.table([pa.array(names, pa.string()), lists], ["term", "x"])

    return run


def _cubes(turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(turn.shape[1])
            for data in batch.column(0).to_pylist():
                total += ((np.frombuffer(data, np.float32).reshape(-1, len(turn)) @ turn) ** 3).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["cubes"])

    return run


def text_svd(df: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...], k: int, passes: int = 3, seed: int = 42, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """reduction.truncated_svd of the weights of texts (see weights.row_sums): (doc_id, x; term, x; singular values). Terms
    are the number of the block, a colon and the term."""
    spark = df.sparkSession
    n_docs, text_bytes = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    how, kind, width = W.Weights(n_docs, min_df, max_df, sublinear), dict(df.dtypes)[id_col], k + SPARE
    texts = W.taken_apart(W.parts(df, id_col, text_col, text_bytes), kinds)
    n, keys = W.part_keys(spark, text_bytes, W.PART_BYTES)
    n_groups, names = W.part_keys(spark, text_bytes, GROUP_BYTES)
    at = F.col("id").cast("int")
    groups = F.broadcast(spark.range(n).select(F.get(keys, at).alias("part"), F.get(names, at % n_groups).alias("group")))
    with _shuffles_removed(spark):
        by_bucket = W.counted(texts, kinds).withColumn("bucket", F.pmod(F.hash("block", "term"), F.lit(n)))
        index = _kept(by_bucket.groupBy("bucket").applyInArrow(_settled(how), _INDEX))
        code = texts.groupBy("part").cogroup(index.filter("part IS NOT NULL").groupBy("part")).applyInArrow(_coded(kinds, how), "part bigint, code binary")
        code = _kept(code.join(groups, "part").repartition(n_groups, "group"))
        index = index.join(groups, "part", "left").select("bucket", "part", "group", "data")
        buckets = index.groupBy("bucket")
        vectors = index.filter("part IS NULL").select("bucket", "data").mapInArrow(_started(seed, width), "bucket int, x binary")  # read once
        turn = np.eye(width)

        def gathered() -> DataFrame:
            given = buckets.cogroup(vectors.groupBy("bucket")).applyInArrow(_gathered(len(turn)), "group bigint, bucket int, x binary")
            return code.groupBy("group").cogroup(given.groupBy("group"))

        for _ in range(max(1, passes)):
            sums = gathered().applyInArrow(_carried(turn, sublinear), "group bigint, bucket int, x binary")
            now = _kept(buckets.cogroup(sums.groupBy("bucket")).applyInArrow(_totals(turn.shape[1]), "bucket int, x binary, products binary"))
            width = turn.shape[1]
            docs, terms = np.zeros((width, width)), np.zeros((width, width))
            for bucket, products in now.select("bucket", "products").collect():
                (docs if bucket == -1 else terms)[...] += np.frombuffer(products).reshape(width, width)
            vectors = now.filter("bucket >= 0").select("bucket", "x")
            right = _orthonormal(docs)
            value, vector = np.linalg.eigh(right.T @ terms @ right)
            order = np.argsort(-value)
            order = order[value[order] > value.max(initial=0.0) * 1e-12]
            turn = right @ vector[:, order] / np.sqrt(value[order])
            if not len(order):
                break
        singular = np.sqrt(value[order][:k])
        if not len(singular):
            return spark.createDataFrame([], f"doc_id {kind}, x array<double>"), spark.createDataFrame([], "term string, x array<double>"), np.zeros(0)
        turn = turn[:, :k]
        cubes = sum(np.frombuffer(r[0]) for r in vectors.select("x").mapInArrow(_cubes(turn), "cubes binary").collect())
        turn = turn * np.where(cubes < 0, -1.0, 1.0)
        docs = gathered().applyInArrow(_placed(turn, sublinear), f"doc_id {kind}, x array<double>")
        components = buckets.cogroup(vectors.groupBy("bucket")).applyInArrow(_named(turn), "term string, x array<double>")
    return docs, components, singular
