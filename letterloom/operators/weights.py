"""Term weights computed where the texts are: sums over rows of the document-term matrix without moving its entries.

Texts move once, into parts of about PART_BYTES by a hash of their document. A part takes its texts apart twice. First it
gives each of its terms once, with the number of its documents that have it; these counts are summed by term, and each
part gets the sums of its own terms back, under the terms' places in the part's sorted vocabulary. Then it weighs its
documents. So what moves grows with the vocabularies of the parts, not with the entries of the matrix; and no vocabulary
has to fit more than its own part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.text import NON_WORD, WORD, WS

#: Bytes of text a part has, about.
PART_BYTES = 16_000_000
#: Words that are taken apart at once; single documents may have more.
STEP = 60_000
LEAST, MOST = 3, 5
#: Characters of words whose n-grams are taken at once.
LONG = 60


def _spaced(kind: str, text: Column) -> Column:
    """The words that a block counts, each followed by one space but the last."""
    if kind == "words":
        return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}{{2,}})"), F.lit(1)), " ")
    return F.regexp_replace(F.lower(text), f"{WS}+", " ")


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts; sorts in place."""
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of as many places as each size says, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What stands between spaces: the number of its text, its own number, and what the latter are."""
    split = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = pc.list_flatten(split).dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[word] if len(word) else np.empty(0, bool)
    return row[full], word[full], words


def _words_within(tokens: tuple[np.ndarray, np.ndarray, pa.Array], pattern: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """tokens of the matches of a pattern within tokens."""
    row, word, words = tokens
    found = list(map(re.compile(pattern).findall, words.to_pylist()))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array([w for f in found for w in f], words.type).dictionary_encode()
    every = coded.indices.to_numpy().astype(np.int64)
    return np.repeat(row, sizes[word]), every[_runs((np.cumsum(sizes) - sizes)[word], sizes[word])], coded.dictionary


def word_pattern(spark: SparkSession) -> str:
    """The pattern of the words that a block counts, with its characters as the engine knows them."""
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    known = spark.range(1).select(F.regexp_replace(F.lit(every), f"{NON_WORD}+", "").alias("x")).first()["x"]
    has = np.zeros(0x110000, bool)
    has[[ord(c) for c in known]] = True
    ends = np.flatnonzero(np.diff(has, prepend=False, append=False)).reshape(-1, 2)
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in ends) + "]{2,}"


def _grams(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The n-grams of words, and the number of the word that each is of."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    of, grams = [np.empty(0, np.int64)], [pa.array([], words.type)]
    space = pa.scalar("", words.type)
    spaced = pc.binary_join_element_wise(space, words, space, pa.scalar(" ", words.type))
    # words of a length together: each slice is of all of them at once
    for length in range(1, min(LONG, sizes.max(initial=0)) + 1) if len(words) else ():
        at = np.flatnonzero(sizes == length)
        if len(at):
            some = spaced.take(pa.array(at))
            for n in range(LEAST, MOST + 1):
                for i in range(length + 2 - n + 1):
                    of.append(at)
                    grams.append(pc.utf8_slice_codeunits(some, i, i + n))
    for k in np.flatnonzero(sizes > LONG).tolist():
        w = spaced[k].as_py()
        each = [w[i : i + n] for n in range(LEAST, MOST + 1) for i in range(len(w) - n + 1)]
        of.append(np.full(len(each), k))
        grams.append(pa.array(each, words.type))
    return np.concatenate(of), pa.concat_arrays(grams)


class Block:
    """Terms of the texts of one part: `words` (words of two characters, and pairs of neighbours) or `chars` (n-grams
    within words that have a space on either side). vocabulary is sorted."""

    def __init__(self, kind: str, tokens: tuple[np.ndarray, np.ndarray, pa.Array], doc: np.ndarray):
        """tokens of texts in the order of doc, the number of the document that each belongs to."""
        self.kind = kind
        row, word, words = tokens
        self.doc = doc[row]
        if kind == "words":
            near = np.flatnonzero(row[1:] == row[:-1])
            pairs, second = np.unique(word[near] * len(words) + word[near + 1], return_inverse=True)
            both = pc.binary_join_element_wise(words.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))), pa.scalar(" ", words.type))
            rank = self._sorted(pa.concat_arrays([words, both]))
            self.word, self.pair, self.pair_doc = rank[word], rank[len(words) + second], self.doc[near]
        else:
            of, grams = _grams(words)
            order = np.argsort(of, kind="stable")
            coded = grams.dictionary_encode()
            rank = self._sorted(coded.dictionary)
            self.word, self.grams = word, rank[coded.indices.to_numpy()[order]]
            self.sizes = np.bincount(of, minlength=len(words))
            self.starts = np.cumsum(self.sizes) - self.sizes

    def _sorted(self, terms: pa.Array) -> np.ndarray:
        order = pc.sort_indices(terms)
        self.vocabulary = terms.take(order)
        rank = np.empty(len(terms), np.int64)
        rank[order.to_numpy()] = np.arange(len(terms))
        return rank

    def entries(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document - low, term, count of the documents from low up to high, in this order."""
        size = max(1, len(self.vocabulary))
        at = slice(*np.searchsorted(self.doc, (low, high)))
        word, doc = self.word[at], (self.doc[at] - low) * size
        if self.kind == "words":
            two = slice(*np.searchsorted(self.pair_doc, (low, high)))
            keys = np.concatenate([doc + word, (self.pair_doc[two] - low) * size + self.pair[two]])
        else:
            sizes = self.sizes[word]
            keys = np.repeat(doc, sizes) + self.grams[_runs(self.starts[word], sizes)]
        # half as wide numbers are sorted in less than half the time
        keys, counts = _unique(keys.astype(np.uint32) if (high - low) * size < 1 << 32 else keys)
        keys = keys.astype(np.int64)
        return keys // size, keys % size, counts


class Part:
    """The documents of a part: their ids, a block for each kind, and ranges of documents to go through."""

    def __init__(self, table: pa.Table, kinds: tuple[str, ...], pattern: str | None = None):
        """With the pattern of words the texts are the same for all blocks, else each has its own."""
        table = table.combine_chunks()
        coded = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, doc = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(doc, kind="stable")
        self.doc, self.table = doc[order], table.take(pa.array(order))
        texts = lambda i: self.table.column(f"t{i}").combine_chunks().cast(pa.large_string())
        if pattern:
            tokens = _tokens(texts(0))
            self.blocks = [Block(k, _words_within(tokens, pattern) if k == "words" else tokens, self.doc) for k in kinds]
        else:
            self.blocks = [Block(k, _tokens(texts(i)), self.doc) for i, k in enumerate(kinds)]

    def ranges(self, words: int | None = None) -> Iterator[tuple[int, int]]:
        each = sum((np.bincount(b.doc, minlength=len(self.ids)) for b in self.blocks), np.zeros(len(self.ids), np.int64))
        step = np.cumsum(each) // (words or STEP)
        ends = [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(self.ids)] if len(self.ids) else []
        return zip([0, *ends[:-1]], ends)


@dataclass(frozen=True)
class Weights:
    """How entries are weighed: terms in at least min_df and at most the part max_df of n_docs documents."""

    n_docs: int
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = False


def part_keys(spark: SparkSession, text_bytes: int, part_bytes: int) -> tuple[int, Column]:
    """How many parts there are, and their numbers as an array: numbers whose hashes are all the partitions, one each."""
    n = max(spark.sparkContext.defaultParallelism, -(-text_bytes // part_bytes))
    rows = spark.range(32 * n + 1024).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    names = {r["at"]: r["id"] for r in rows}
    return n, F.array(*[F.lit(names.get(i, -1 - i)).cast("bigint") for i in range(n)])


def parts(df: DataFrame, id_col: str, text_col: str, text_bytes: int, *others: str, part_bytes: int | None = None) -> DataFrame:
    """part, doc_id, text and the others; all rows of a document in one part, and every partition one part."""
    n, keys = part_keys(df.sparkSession, text_bytes, part_bytes or PART_BYTES)
    part = F.get(keys, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))
    return df.select(part.alias("part"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others).repartition(n, "part")


def taken_apart(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return rows.select("part", "doc_id", *[_spaced(k, F.col("text")).alias(f"t{i}") for i, k in enumerate(kinds)], *[c for c in rows.columns if c not in ("part", "doc_id", "text")])


_LOCAL = "part bigint, block int, term string, at int, n bigint"


def counted(texts: DataFrame, kinds: tuple[str, ...], pattern: str | None = None) -> DataFrame:
    """part, block, term, at, n: each term of a part with its place and the number of documents that have it."""

    def run(table: pa.Table) -> pa.Table:
        part, out = Part(table, kinds, pattern), []
        counts = [np.zeros(len(b.vocabulary), np.int64) for b in part.blocks]
        for low, high in part.ranges():
            for b, n in zip(part.blocks, counts):
                n += np.bincount(b.entries(low, high)[1], minlength=len(n))
        key = table.column("part")[0]
        for i, (b, n) in enumerate(zip(part.blocks, counts)):
            has = np.flatnonzero(n)
            columns = [pa.repeat(key, len(has)), pa.repeat(pa.scalar(i, pa.int32()), len(has)), b.vocabulary.take(pa.array(has)).cast(pa.string()), pa.array(has.astype(np.int32)), pa.array(n[has])]
            out.append(pa.table(columns, [x.split()[0] for x in _LOCAL.split(", ")]))
        return pa.concat_tables(out)

    return texts.groupBy("part").applyInArrow(run, _LOCAL)


def local_terms(texts: DataFrame, kinds: tuple[str, ...], pattern: str | None = None) -> DataFrame:
    """counted(), by term."""
    spark = texts.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return counted(texts, kinds, pattern).repartition(n, "block", "term")


def frequencies(local: DataFrame, how: Weights) -> DataFrame:
    """block, term, df of the terms that count."""
    # both sides of the join in weighed() ask for all columns, so that the exchange of local_terms is made once
    df = local.groupBy("block", "term").agg(F.sum("n").alias("df"), F.expr("count(part, at)").alias("parts"))
    return df.filter((F.col("df") >= how.min_df) & (F.col("df") <= how.max_df * how.n_docs) & (F.col("parts") > 0)).drop("parts")


def returned(local: DataFrame, known: DataFrame) -> DataFrame:
    """part, block, term, at, df: the terms of each part that count."""
    return local.join(known.hint("shuffle_hash"), ["block", "term"]).select("part", "block", "term", "at", F.when(F.col("n") > 0, F.col("df")).alias("df"))


def weighed(texts: DataFrame, back: DataFrame, kinds: tuple[str, ...], how: Weights, finish: Callable, schema: str, pattern: str | None = None) -> DataFrame:
    """What finish(part, weights, sums) gives for each part, a table of the schema. weights yields (low, high, a list of a
    block's document - low, term and weight, without the scaling to unit length) of the documents from low up to high;
    sums are the part's rows of back: block (under 0 if it's no term), at, df and what else finish takes."""

    def run(table: pa.Table, sums: pa.Table) -> pa.Table:
        part = Part(table, kinds, pattern)
        idf = [np.zeros(len(b.vocabulary)) for b in part.blocks]
        block, at, df = (sums.column(c).to_numpy() for c in ("block", "at", "df"))
        for i, x in enumerate(idf):
            x[at[block == i]] = np.log((1.0 + how.n_docs) / (1 + df[block == i])) + 1

        def weights() -> Iterator[tuple[int, int, list]]:
            for low, high in part.ranges():
                out = []
                for b, x in zip(part.blocks, idf):
                    doc, term, n = b.entries(low, high)
                    good = x[term] > 0  # terms that don't count have none
                    doc, term, n = doc[good], term[good], n[good]
                    out.append((doc, term, (1 + np.log(n) if how.sublinear else n) * x[term]))
                yield low, high, out

        return finish(part, weights(), sums)

    return texts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(run, schema)


def _unit_blocks(part: Part, weights: Iterator) -> Iterator[tuple[int, int, list, list]]:
    """low, size, the blocks with all of them together of unit length, and the columns that both results below have:
    doc_id, n, and total, squares and greatest weight of its row; documents without terms have none."""
    for low, high, blocks in weights:
        size = high - low
        own = [np.bincount(doc, w * w, size) for doc, _, w in blocks]
        present = sum((x > 0).astype(np.int64) for x in own)
        n, total, squares, most, unit = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size), []
        for (doc, term, w), x in zip(blocks, own):
            if len(doc):
                w = w / np.sqrt(x * present)[doc]
                n += np.bincount(doc, minlength=size)
                total += np.bincount(doc, w, size)
                squares += np.bincount(doc, w * w, size)
                at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                most[doc[at]] = np.maximum(most[doc[at]], np.maximum.reduceat(w, at))
            unit.append((doc, term, w))
        has = np.flatnonzero(n)
        yield low, size, unit, [part.ids.take(pa.array(low + has)), pa.array(n[has]), pa.array(total[has]), pa.array(squares[has]), pa.array(most[has])]


_SUMS = ["doc_id", "n", "total", "squares", "most"]


def _no_sums(part: Part) -> list:
    return [part.ids.slice(0, 0), pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3]


def sums_by_document(part: Part, weights: Iterator, _: pa.Table) -> pa.Table:
    """doc_id, n, and total, squares and greatest weight of its row, with unit blocks; documents without terms have none."""
    out = [pa.table(columns, _SUMS) for _, _, _, columns in _unit_blocks(part, weights)]
    return pa.concat_tables(out or [pa.table(_no_sums(part), _SUMS)])


@cache
def _six() -> np.ndarray:
    """The lines of 0.000000 to 1.000000, as bytes."""
    n = np.arange(1_000_001)
    digits = [n // 10**k % 10 + ord("0") for k in range(6, -1, -1)]
    lines = [digits[0], np.full(len(n), ord(".")), *digits[1:], np.full(len(n), ord("\n"))]
    return np.stack(lines, 1).astype(np.uint8).view("V9")[:, 0]


def _lines(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data]).cast(pa.string())


def rows_by_document(part: Part, weights: Iterator, _: pa.Table) -> pa.Table:
    """sums_by_document() and the row itself: first, how many of its terms are of the first block; terms and weights, a line
    each, by block and term."""
    names = [*_SUMS, "first", "terms", "weights"]
    line = pa.scalar("\n", pa.large_string())
    every = pa.concat_arrays([pc.binary_join_element_wise(b.vocabulary, pa.scalar("", pa.large_string()), line) for b in part.blocks])
    starts = np.cumsum([0, *[len(b.vocabulary) for b in part.blocks]])
    out = []
    for _, size, blocks, columns in _unit_blocks(part, weights):
        doc, w = (np.concatenate([x[i] for x in blocks]) for i in (0, 2))
        term = np.concatenate([x[1] + start for x, start in zip(blocks, starts)])
        if len(blocks) > 1:
            order = np.argsort(doc, kind="stable")
            doc, term, w = doc[order], term[order], w[order]
        ends = np.concatenate([np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else [], [len(doc)]]).astype(np.int64)
        first = np.bincount(blocks[0][0], minlength=size)[doc[ends[:-1]]]
        text = every.take(pa.array(term))
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
        six = _six()[(w * 1e6 + 0.5).astype(np.int64)]
        out.append(pa.table([*columns, pa.array(first), _lines(at[ends], text.buffers()[2]), _lines(ends * 9, pa.py_buffer(six))], names))
    none = [*_no_sums(part), pa.array([], pa.int64()), *[pa.array([], pa.string())] * 2]
    return pa.concat_tables(out or [pa.table(none, names)])


def _size(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first())


def row_sums(df: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...], min_df: int = 1, max_df: float = 1.0, sublinear: bool = False) -> DataFrame:
    """doc_id, n, total, squares, most of each row of the weights of the texts, all blocks together of unit length."""
    n_docs, text_bytes = _size(df, text_col)
    how = Weights(n_docs, min_df, max_df, sublinear)
    texts = taken_apart(parts(df, id_col, text_col, text_bytes), kinds)
    local = local_terms(texts, kinds)
    kind = dict(df.dtypes)[id_col]
    back = returned(local, frequencies(local, how)).select("part", "block", "at", "df")
    return weighed(texts, back, kinds, how, sums_by_document, f"doc_id {kind}, n bigint, total double, squares double, most double")


def whole_rows(df: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...], min_df: int = 1, max_df: float = 1.0, sublinear: bool = False) -> DataFrame:
    """row_sums() and the rows themselves: first, terms, weights (see rows_by_document). Texts move with their spaces
    as the n-grams need them, and words are looked for in what stands between, once for each part that has it."""
    n_docs, text_bytes = _size(df, text_col)
    how = Weights(n_docs, min_df, max_df, sublinear)
    spaced = df.select(id_col, _spaced("chars", F.col(text_col)).alias(text_col))
    # a part's rows are many times its texts, and are held at once
    texts = parts(spaced, id_col, text_col, text_bytes, part_bytes=PART_BYTES // 2).withColumnRenamed("text", "t0")
    pattern = word_pattern(df.sparkSession) if "words" in kinds else None
    local = local_terms(texts, kinds, pattern)
    kind = dict(df.dtypes)[id_col]
    back = returned(local, frequencies(local, how)).select("part", "block", "at", "df")
    return weighed(texts, back, kinds, how, rows_by_document, f"doc_id {kind}, n bigint, total double, squares double, most double, first bigint, terms string, weights string", pattern)


def _unit(size: int, doc: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w / np.sqrt(np.bincount(doc, w * w, size))[doc]


def sums_by_label(part: Part, weights: Iterator, sums: pa.Table) -> pa.Table:
    """term, label, s: weights of each term by label; without a term, the rows of documents that have any; without a
    label, the documents of all parts that have the term."""
    labels = part.table.column("label").combine_chunks().dictionary_encode()
    label, ends = labels.indices.to_numpy().astype(np.int64), np.searchsorted(part.doc, np.arange(len(part.ids) + 1))
    vocabulary, named, seen = part.blocks[0].vocabulary, part.ids.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(part.ids), bool)
    size, keys, values = max(1, len(vocabulary)), [np.empty(0, np.int64)], [np.empty(0)]
    for low, high, [(doc, term, w)] in weights:
        w, good = _unit(high - low, doc, w), named[low + doc]  # no label belongs to documents without an id
        doc, term, w = low + doc[good], term[good], w[good]
        seen[doc] = True
        rows = ends[doc + 1] - ends[doc]
        keys.append(label[_runs(ends[doc], rows)] * size + np.repeat(term, rows))
        values.append(np.repeat(w, rows))
    every, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every, value = every[order], value[order]
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    n = np.bincount(label[seen[part.doc]], minlength=len(labels.dictionary))
    has = np.flatnonzero(n)
    known = sums.column("at").to_numpy()
    terms = pa.concat_arrays([vocabulary.take(pa.array(np.concatenate([every[at] % size, known]))).cast(pa.string()), pa.nulls(len(has), pa.string())])
    names = [labels.dictionary.take(pa.array(every[at] // size)), pa.nulls(len(known), pa.string()), labels.dictionary.take(pa.array(has))]
    s = np.concatenate([np.add.reduceat(value, at) if len(at) else np.empty(0), sums.column("df").to_numpy(), n[has]])
    return pa.table([terms, pa.concat_arrays(names), pa.array(s)], ["term", "label", "s"])


def best_label(part: Part, weights: Iterator, sums: pa.Table) -> pa.Table:
    """doc_id, y_pred of documents with known terms, by the sums of labels (see multinomial_nb)."""
    block, at, code, s, log_t = (sums.column(c).to_numpy() for c in ("block", "at", "code", "s", "log_t"))
    every = np.flatnonzero(block == -1)
    every = every[np.argsort(code[every])]
    prior, log_t, n_labels = s[every], log_t[every], len(every)
    names = sums.column("label").combine_chunks().take(pa.array(every))
    terms = np.flatnonzero(block == -2)
    terms = terms[np.argsort(at[terms], kind="stable")]
    ends = np.searchsorted(at[terms], np.arange(len(part.blocks[0].vocabulary) + 1))
    code, s = code[terms].astype(np.int64) - 1, np.log1p(s[terms])
    named, docs, chosen = part.ids.is_valid().to_numpy(zero_copy_only=False), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low, high, [(doc, term, w)] in weights:
        if not len(doc) or not n_labels:
            continue
        size, w = high - low, _unit(high - low, doc, w)
        mass, hit = np.bincount(doc, w, size), np.zeros(size * n_labels)
        count = ends[term + 1] - ends[term]
        steps = np.flatnonzero(np.diff(np.cumsum(count) // 2_000_000)) + 1
        for i, j in zip([0, *steps], [*steps, len(doc)]):
            rows = _runs(ends[term[i:j]], count[i:j])
            hit += np.bincount(np.repeat(doc[i:j] * n_labels, count[i:j]) + code[rows], np.repeat(w[i:j], count[i:j]) * s[rows], size * n_labels)
        hit = hit.reshape(size, n_labels)
        hit[~named[low:high]] = 0
        score = prior + hit - mass[:, None] * log_t
        score = np.trunc(score * 1e6 + np.copysign(0.5, score)) / 1e6
        has = np.unique(doc)
        docs.append(low + has)
        chosen.append(score[has].argmax(1))
    return pa.table([part.ids.take(pa.array(np.concatenate(docs))), names.take(pa.array(np.concatenate(chosen)))], ["doc_id", "y_pred"])


def multinomial_nb(train: DataFrame, test: DataFrame, id_col: str, text_col: str, label: str, min_df: int, max_df: float) -> DataFrame:
    """doc_id, y_pred of the texts of test: linear.multinomial_nb on the word weights of train.

    A part of test gets the sums of all labels for the terms that it has, and its documents are judged whole.
    """
    kinds, spark = ("words",), train.sparkSession
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    (n_docs, train_bytes), (_, test_bytes) = size(train), size(test)
    how = Weights(n_docs, min_df, max_df)
    texts = taken_apart(parts(train, id_col, text_col, train_bytes, F.col(label).alias("label"), part_bytes=2 * PART_BYTES), kinds)
    local = local_terms(texts, kinds)
    known = frequencies(local, how)
    fitted = weighed(texts, returned(local, known).select("part", "block", "at", "df"), kinds, how, sums_by_label, "term string, label string, s double")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # read for the labels and for the terms
    model = fitted.repartition(n, "term").groupBy("term", "label").agg(F.when(F.col("label").isNull(), F.max("s")).otherwise(F.sum("s")).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    total = model.filter("label IS NOT NULL").groupBy("label").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("s"))).alias("t"), F.sum(F.when(F.col("term").isNull(), F.col("s"))).alias("n"))
    v = model.filter("label IS NULL").agg(F.count(F.lit(1)).alias("v"))
    total = total.filter("t IS NOT NULL").join(F.broadcast(v)).select("label", F.log("n").alias("prior"), F.log(F.col("t") + F.col("v")).alias("log_t"))
    total = total.withColumn("code", F.expr("row_number() OVER (ORDER BY label)"))  # a row a label
    by_code = model.filter("term IS NOT NULL").join(F.broadcast(total.select("label", "code")), "label", "left").select("term", F.coalesce("code", F.lit(0)).alias("code"), "s")
    _, keys = part_keys(spark, test_bytes, 2 * PART_BYTES)
    asked = taken_apart(parts(test, id_col, text_col, test_bytes, part_bytes=2 * PART_BYTES), kinds)
    none, frequency = F.lit(None), F.col("code") == 0
    rows = local_terms(asked, kinds).select("part", "term", "at").join(by_code.hint("shuffle_hash"), "term").select(
        "part", F.when(frequency, 0).otherwise(-2).alias("block"), "at", F.when(frequency, F.col("s")).otherwise(0.0).alias("df"),
        "code", F.when(frequency, 0.0).otherwise(F.col("s")).alias("s"), none.cast("double").alias("log_t"), none.cast("string").alias("label"),
    )
    every = total.select(F.explode(keys).alias("part"), F.lit(-1).alias("block"), F.lit(0).alias("at"), F.lit(0.0).alias("df"), "code", F.col("prior").alias("s"), "log_t", "label")
    return weighed(asked, rows.unionByName(every), kinds, how, best_label, f"doc_id {dict(test.dtypes)[id_col]}, y_pred string")
