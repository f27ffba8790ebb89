"""Problem 8: subject areas by a seeded non-negative factorisation of the document-term matrix.

Terms are word stems and pairs of neighbouring stems, hashed into a fixed number of columns, so no vocabulary has to be
gathered and no term is left out. One component a subject is anchored in labelled examples; background components, one a
language of the examples, take what all subjects share. Alternating multiplicative updates (Kullback-Leibler) run over
all documents: each task solves the mixtures of its documents, and what it adds to the components is summed by term;
they end when a round hardly moves the components any more.
With the components fixed, every sentence is factored in the same way; a document has the subjects that at least a
quarter of its sentences with any subject deal with.

Defined cases: null, empty and wordless texts have no subject; header fields, markers and markup are no sentences;
examples without text or subject are left out; with no examples there are no subjects and the result is empty; more than
MAX_SUBJECTS subjects are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import written

#: Labelled examples at most from which the components are seeded.
MAX_EXAMPLES = 50_000
COLUMNS = 1 << 17
STEM = 6
FOUND_SHARE = 0.25
#: Words and pairs that a subject must explain in a sentence; a single rare word, often a misspelling, isn't enough.
LEAST_TERMS = 1.5
#: No term is barred from a component before documents have been seen.
FLOOR = 1e-7
#: A mixture has settled once a step moves no component by more words than that.
SETTLED = 0.05
MAX_SUBJECTS = 1000

#: Names of header fields; Latin letters that scanning puts for Cyrillic ones.
_NAMES = "Исх|Вх|Дата|Тема|Кому|От|Объект|Договор"
_LATIN, _CYRILLIC = "aceopxykmthbABCEHKMOPTXY", "асеорхукмтнвАВСЕНКМОРТХУ"

_HEADER = re.compile(rf"\s*(?:(?:{_NAMES})\s*:[^\n\r;|]*(?:[\n\r;|]\s*|$))*", re.I)
_NOISE = re.compile(r"\[[^\W\d_]+(?:_[^\W\d_]+)*\]|<[^<>]{1,200}>|&\w{2,8};")
#: Starts with one set of characters, which the matcher searches for quickly.
_END = re.compile(r"[.!?…\n\r](?:(?<=[\n\r])[\n\r]*|(?<![\n\r])\s+(?=[^\sа-яёa-z]))")
_WORD = re.compile(r"[^\W\d_]{3,}")
_MIXED = str.maketrans(_LATIN, _CYRILLIC)
_HAS_CYRILLIC = re.compile(r"[а-яё]", re.I)


class _Stems(dict):
    """Columns of the words of what stands between white space."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        import xxhash

        columns = []
        for word in _WORD.findall(token):
            plain = word.translate(_MIXED) if _HAS_CYRILLIC.search(word) else word
            stem = plain.lower().replace("ё", "е")[:STEM]
            columns.append(xxhash.xxh32_intdigest(stem.encode()) % COLUMNS)
        if len(self) < 500_000:
            self[token] = tuple(columns)
        return tuple(columns)


def sentences(text: str | None, stems: _Stems) -> tuple[list[int], list[int]]:
    """Columns of all words, and the number of words of each sentence that has any."""
    columns: list[int] = []
    sizes: list[int] = []
    if text:
        body = _NOISE.sub(" ", text[_HEADER.match(text).end() :])
        for sentence in _END.split(body):
            before = len(columns)
            for found in map(stems.__getitem__, sentence.split()):
                columns += found
            if len(columns) > before:
                sizes.append(len(columns) - before)
    return columns, sizes


def with_pairs(columns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their sentence: the words, then the pairs of neighbours within a sentence."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    if len(columns) < 2:
        return columns, of
    pairs = (columns[:-1].astype(np.int64) * 40503 + columns[1:].astype(np.int64) * 2654435761 + 12289) % COLUMNS
    inside = of[:-1] == of[1:]
    return np.concatenate([columns, pairs[inside]]), np.concatenate([of, of[:-1][inside]])


class Components:
    """Components by row: of each term the components that hold it and how much, and a floor for all others.

    Most terms are held by one or two components, so a step of the mixtures costs no more than that.
    """

    def __init__(self, parts: np.ndarray, floor: float = FLOOR):
        term, self.of = np.nonzero(parts)
        self.value = parts[term, self.of].astype(np.float64)
        self.start = np.searchsorted(term, np.arange(len(parts) + 1))
        self.number, self.floor = parts.shape[1], floor

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in terms, component and value of each component that holds one of the terms."""
        size = self.start[terms + 1] - self.start[terms]
        place = np.repeat(np.arange(len(terms)), size)
        at = np.arange(len(place)) + np.repeat(self.start[terms] - np.cumsum(size) + size, size)
        return place, self.of[at], self.value[at]


def mixtures(terms: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, parts: Components, tol: float = SETTLED, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative mixtures of each row, and for each term its weight by what the mixture expects of it.

    Multiplicative steps run until none changes a mixture by more than `tol` words.
    """
    place, of, value = parts.entries(terms)
    k = parts.number
    cell = row[place] * k + of
    expected = lambda w: np.bincount(place, w.ravel()[cell] * value, len(terms)) + parts.floor * w.sum(1)[row]
    w = np.ones((rows, k))
    for _ in range(most):
        ratio = weight / expected(w)
        new = np.bincount(cell, value * ratio[place], rows * k).reshape(rows, k)
        new += parts.floor * np.bincount(row, ratio, rows)[:, None]
        new *= w
        change = np.abs(new - w).max(initial=0.0)
        w = new
        if change < tol:
            break
    return w, weight / expected(w)


def _counted(terms: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in row order with their counts."""
    both, n = np.unique(row.astype(np.int64) * COLUMNS + terms, return_counts=True)
    return both % COLUMNS, n.astype(np.float32), both // COLUMNS


def seed_components(examples: list[tuple[str, str, str]], subjects: list[str]) -> np.ndarray:
    """Columns x components: anchored subjects first, then a background component for each language.

    A term counts for a subject by how much more often its examples have it than those of the other subjects do, by
    example and not by occurrence, so that a few wrong labels change little.
    """
    stems = _Stems()
    langs = sorted({lang for _, lang, _ in examples})
    has = np.zeros((COLUMNS, len(subjects)), np.float32)
    back = np.zeros((COLUMNS, len(langs)), np.float32)
    number = np.zeros(len(subjects), np.float32)
    for text, lang, subject in examples:
        columns, sizes = sentences(text, stems)
        if not columns:
            continue
        terms, _ = with_pairs(np.array(columns), np.array(sizes))
        s = subjects.index(subject)
        number[s] += 1
        distinct = np.unique(terms)
        has[distinct, s] += 1
        back[distinct, langs.index(lang)] += 1
    rate = has / np.maximum(1, number)
    others = (rate.sum(1, keepdims=True) - rate) / max(1, len(subjects) - 1)
    # of a term's examples the share that belongs to the subject, where it is clearly above an even spread
    lift = rate / np.maximum(rate + others * (len(subjects) - 1), 1e-9)
    anchored = np.where(lift > 0.4, has * lift, 0)
    general = back * (1 - np.minimum(1, lift.max(1, keepdims=True) * (lift.max(1, keepdims=True) > 0.4)))
    return _normal(np.hstack([anchored, general]))


def shared_apart(total: np.ndarray, back: np.ndarray, near: np.ndarray, certain: float = 0.4, doubt: float = 2.0) -> np.ndarray:
    """Gives every term to the one subject it keeps company with, or to the background components.

    total is how often a term occurs, back what the background components explain of it, and near how often it stands in
    documents of each subject, by the documents' mixtures, whatever component has explained it so far. A subject holds a
    term if its part of these rates, less for terms hardly seen, is above `certain`. So terms that no example has find
    their subject, and terms that all subjects share lose theirs.
    """
    rate = near / np.maximum(near.sum(0), 1e-9)
    seen = near.sum(1, keepdims=True)
    lift = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12) * seen / (seen + doubt)
    held = (lift > certain) & (lift == lift.max(1, keepdims=True))
    total = total[:, None]
    rest = np.maximum(0, total - back.sum(1, keepdims=True))
    even = (back + 1e-6) / (back + 1e-6).sum(1, keepdims=True) if back.shape[1] else back
    back = np.where(held.any(1, keepdims=True), 0, back + rest * even)
    return np.hstack([np.where(held, total, 0), back]).astype(np.float32)


def _normal(parts: np.ndarray) -> np.ndarray:
    total = parts.sum(0)
    return (parts / np.where(total > 0, total, 1)).astype(np.float32)


class SubjectFactors:
    """Components fitted on a whole corpus, and the subjects of its documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, examples: DataFrame, subjects: DataFrame, most_rounds: int = 10, settled: float = 0.05, anchor: float = 0.5):
        self.spark = docs.sparkSession
        named = [r[0] for r in subjects.select("subject").distinct().limit(MAX_SUBJECTS + 2).collect()]
        self.subjects = sorted(s for s in named if s)
        if len(self.subjects) > MAX_SUBJECTS:
            raise ValueError(f"more than {MAX_SUBJECTS} subjects")
        labelled = examples.filter(F.col("subject").isin(self.subjects) & F.col("text").isNotNull()).orderBy("example_id").limit(MAX_EXAMPLES)
        listed = [(r["text"], r["lang"] or "", r["subject"]) for r in labelled.select("text", "lang", "subject").collect()]
        self.seeds = seed_components(listed, self.subjects)
        self.seeded = bool(listed)
        self.parts = self.seeds
        self.terms = written(self._terms(docs, id_col, text_col), "document-terms")
        #: Of each round: the bits a term that the components before it left unexplained, and how far it moved them.
        self.surprise: list[float] = []
        self.moved: list[float] = []
        while listed and len(self.moved) < most_rounds and (not self.moved or self.moved[-1] > settled):
            before = self.parts
            self.surprise.append(self._update(anchor))
            self.moved.append(float(np.abs(self.parts - before).sum(0).mean() / 2))

    def _terms(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """doc_id, columns, sizes: the sparse rows of the matrix, kept by sentence."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stems = _Stems()
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    both = [sentences(t, stems) for t in part.column(1).to_pylist()]
                    arrays = [part.column(0)]
                    for side in (0, 1):
                        ends = np.cumsum([0, *(len(b[side]) for b in both)]).astype(np.int32)
                        flat = np.fromiter((x for b in both for x in b[side]), np.int32, int(ends[-1]))
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "columns", "sizes"])

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(run, "doc_id bigint, columns array<int>, sizes array<int>")

    def _update(self, anchor: float) -> float:
        """One alternating update over all documents; the bits a term that the components so far leave unexplained.

        Each task sums by term: how often it occurs, its documents' subjects and what the background explains of it. The
        sums are merged by term; what goes to the driver is bounded by COLUMNS x components.
        """
        parts, known = Components(self.parts), len(self.subjects)
        langs = self.parts.shape[1] - known
        names = [f"x{i}" for i in range(1 + langs + known)]
        explained = self.parts[:, known:] + np.float32(FLOOR)
        mass = self.parts.sum(0) + FLOOR * COLUMNS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((COLUMNS, len(names)), np.float32)
            bits, terms_seen = 0.0, 0.0
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    done = [_document_mixtures(batch.slice(at + i, 128), parts) for i in range(0, min(1024, batch.num_rows - at), 128)]
                    if not done:
                        continue
                    first_row = np.cumsum([0, *(len(x[4]) for x in done)])
                    terms, n, ratio = (np.concatenate([x[c] for x in done]) for c in range(3))
                    doc = np.concatenate([x[3] + r for x, r in zip(done, first_row)])
                    w = np.concatenate([x[4] for x in done]).astype(np.float32)
                    if not len(terms):
                        continue
                    scale = (w @ mass.astype(np.float32))[doc]
                    bits += float((n * np.log2(scale * ratio / n)).sum())
                    terms_seen += float(n.sum())
                    near = w[:, :known] / np.maximum(w[:, :known].sum(1, keepdims=True), 1e-9)
                    # sorted by term, with the place of each in the lower bits
                    order = np.sort(terms << 32 | np.arange(len(terms)))
                    terms, order = order >> 32, order & 0xFFFFFFFF
                    n, ratio, doc = n[order, None], ratio[order, None].astype(np.float32), doc[order]
                    share = np.hstack([n, w[:, known:][doc] * ratio, near[doc] * n])
                    first = np.flatnonzero(np.diff(terms, prepend=-1))
                    total[terms[first]] += np.add.reduceat(share, first, axis=0)
            total[:, 1 : 1 + langs] *= explained
            used = np.flatnonzero(total[:, 0])
            sums = np.zeros((1, len(names)), np.float32)
            sums[0, :2] = bits, terms_seen  # under column -1
            total = np.concatenate([total[used], sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["column", *names])

        partial = self.terms.select("columns", "sizes").mapInArrow(run, "column int, " + ", ".join(f"{n} float" for n in names))
        summed = partial.groupBy("column").agg(*[F.sum(n).cast("float").alias(n) for n in names]).toArrow()
        column = summed.column("column").to_numpy()
        new = np.zeros((COLUMNS + 1, len(names)))  # the last row takes column -1
        for i, n in enumerate(names):
            new[column, i] = summed.column(n).to_numpy()
        bits, seen = new[-1, :2]
        new = new[:-1]
        self.parts = _normal(_normal(shared_apart(new[:, 0], new[:, 1 : 1 + langs], new[:, 1 + langs :])) + anchor * self.seeds)
        return bits / max(1.0, seen)

    def sentence_subjects(self, least: float = LEAST_TERMS) -> DataFrame:
        """doc_id, subject, sentences: in how many sentences of a document a subject is dealt with."""
        parts, names = Components(self.parts), self.subjects

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    columns, sizes, per_doc = _lists(part.select(["columns", "sizes"]))
                    if not len(columns):
                        continue
                    subject = subject_of_sentences(columns, sizes, parts, len(names), least)
                    doc = np.repeat(np.arange(len(per_doc)), per_doc)
                    both, n = np.unique((doc * len(names) + subject)[subject >= 0], return_counts=True)
                    ids = part.column(0).take(pa.array(both // len(names)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([names[s] for s in both % len(names)], pa.string()), pa.array(n.astype(np.int32))], ["doc_id", "subject", "sentences"])

        if not names or not self.seeded:
            return self.spark.createDataFrame([], "doc_id bigint, subject string, sentences int")
        return self.terms.mapInArrow(run, "doc_id bigint, subject string, sentences int")

    def found(self, share: float = FOUND_SHARE) -> DataFrame:
        """doc_id, subject, share of the sentences with any subject."""
        counted = self.sentence_subjects()
        # a document's rows come from one task and are at most one a subject
        packed = counted.groupBy("doc_id").agg(F.sum("sentences").alias("all"), F.collect_list(F.struct("subject", "sentences")).alias("list"))
        each = packed.select("doc_id", "all", F.inline("list"))
        return each.filter(F.col("sentences") >= F.col("all") * share).select("doc_id", "subject", (F.col("sentences") / F.col("all")).alias("share"))


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = part.column(0).flatten().to_numpy().astype(np.int64)
    sizes = part.column(1).flatten().to_numpy()
    return columns, sizes, part.column(1).value_lengths().fill_null(0).to_numpy()


def _document_mixtures(part: pa.RecordBatch, parts: Components) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each document, their counts, counts by what is expected of them, documents; the mixtures."""
    columns, sizes, per_doc = _lists(part)
    terms, of = with_pairs(columns, sizes)
    terms, n, doc = _counted(terms, np.repeat(np.arange(len(per_doc)), per_doc)[of])
    w, ratio = mixtures(terms, n, doc, len(per_doc), parts)
    return terms, n, ratio, doc, w


def subject_of_sentences(columns: np.ndarray, sizes: np.ndarray, parts: Components, subjects: int, least: float) -> np.ndarray:
    """Index of the subject each sentence deals with, or -1: its component must explain `least` words and pairs."""
    terms, of = with_pairs(columns, sizes)
    w, _ = mixtures(terms, np.ones(len(terms)), of, len(sizes), parts)
    top = w[:, :subjects].argmax(1)
    return np.where(w[np.arange(len(w)), top] >= least, top, -1)
