"""Augmentation: heuristic filling of small classes, and the loop that accepts generated texts.

Generators, embedders and scorers are pluggable: anything that maps a pandas Series of texts. The built-in ones need no
pretrained model and are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions import text
from letterloom.operators import features


class Embedder(Protocol):
    def __call__(self, texts: pd.Series) -> np.ndarray:
        """One row of a float matrix a text."""


class Generator(Protocol):
    def __call__(self, texts: pd.Series, attempt: int) -> pd.Series:
        """A new text for each."""


class HashingEmbedder:
    """Signed counts of hashed words, as unit vectors; an empty text is the zero vector."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def __call__(self, texts: pd.Series) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class WordDropper:
    """Leaves out every n-th word, from another place at each attempt."""

    def __init__(self, every: int = 9):
        self.every = every

    def __call__(self, texts: pd.Series, attempt: int) -> pd.Series:
        return texts.map(lambda t: " ".join(w for i, w in enumerate((t or "").split()) if (i + attempt) % self.every))


def embed(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """df with the vectors of a column, batch by batch; the embedder is loaded once a task."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = list(embedder(pdf[text_col]))
            yield pdf

    return df.mapInPandas(run, schema)


def heuristic_plan(df: DataFrame, id_col: str, label: str, target: int) -> DataFrame:
    """label, number, mode, source id: what to make for each class of fewer than target rows.

    The i-th new row of a class of n takes its i mod n-th row and mode (i + 1) mod 4. Only rows of small classes are
    ranked, which are fewer than target each.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < target)
    rows = df.select(F.col(id_col).alias("source_id"), F.col(label).alias("label")).join(counts, "label")
    ranked = rows.withColumn("k", F.expr("row_number() OVER (PARTITION BY label ORDER BY source_id) - 1"))
    new = counts.select("label", "n", F.explode(F.sequence(F.lit(0), (F.lit(target) - F.col("n") - 1).cast("int"))).alias("i"))
    made = new.withColumn("k", (F.col("i") % F.col("n")).cast("int")).join(ranked.drop("n"), ["label", "k"])
    return made.select("label", F.col("i").alias("number"), ((F.col("i") + 1) % 4).alias("mode"), "source_id")


def top_sentences(sentences: DataFrame, n_all: int, n: int) -> DataFrame:
    """source_id, top: the n sentences of each text (source_id, pos, sentence) with the greatest sums of term weights, in
    the order of the text. Weights are fitted on all n_all sentences, on terms of two sentences or more and of at most 95 %."""
    keyed = sentences.withColumn("sid", F.struct("source_id", "pos"))
    weights = features.tfidf(features.term_counts(keyed, "sid", features.word_terms(F.col("sentence"), 1)), n_all, 2, 0.95)
    sums = weights.groupBy(F.col("doc_id").alias("sid")).agg(F.round(F.sum("weight"), 6).alias("score"))
    ranked = keyed.join(sums, "sid", "left").withColumn("r", F.expr("row_number() OVER (PARTITION BY source_id ORDER BY coalesce(score, 0) DESC, pos)")).filter(F.col("r") <= n)
    packed = ranked.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).getField("sentence").alias("s"))
    return packed.select("source_id", F.array_join("s", " ").alias("top"))


def heuristic_texts(plan: DataFrame, df: DataFrame, id_col: str, text_col: str, n_sentences: int = 3, label: str = "label", least_sentences: int = 10) -> DataFrame:
    """plan with the made text: first sentences, a window of sentences, the sentences with the greatest term weights, or
    the text without some words. Weights are fitted on the sentences of all texts of the planned labels; if these are
    fewer than least_sentences, words are left out instead."""
    c, salt = F.col("_t"), F.col("source_id") + F.col("number")
    texts = df.select(F.col(id_col).alias("source_id"), F.col(label).alias("label"), F.col(text_col).alias("_t"))
    joined = plan.join(texts.drop("label"), "source_id")
    sentences = texts.join(plan.select("label").distinct(), "label", "left_semi").select("source_id", F.posexplode(text.split_sentences(c)).alias("pos", "sentence"))
    n_all = sentences.count()
    top = text.drop_words(c, 15, salt)
    if n_all >= least_sentences:
        joined = joined.join(top_sentences(sentences, n_all, n_sentences), "source_id", "left")
        top = F.coalesce("top", c)
    made = (
        F.when(F.col("mode") == 0, text.first_n_sentences(c, n_sentences))
        .when(F.col("mode") == 1, text.window_sentences(c, n_sentences, salt))
        .when(F.col("mode") == 2, top)
        .otherwise(text.drop_words(c, 15, salt))
    )
    return joined.withColumn("text", made).drop("_t", "top")


def accept_rounds(
    base: DataFrame, label: str, text_col: str, target: int, generate: Generator, embedder: Embedder, kind: str = "paraphrase",
    length: tuple[float, float] = (0.5, 1.3), similar: tuple[float, float] = (0.75, 0.95), to_class: tuple[float, float] = (0.8, 0.98), rounds: int = 5,
) -> DataFrame:
    """label, text, source_text, cosine_sim, max_label_cosine_sim, augmentation_type of accepted texts.

    Each class below target is filled on its own: sources in turn, gates in the order length, identity, similarity to the
    source, similarity to the class; an accepted text joins its class. A class of fewer than target rows is all one task
    sees. Rounds end when one adds nothing.
    """
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") < target) & F.col(label).isNotNull())
    small = base.filter(F.col(text_col).isNotNull()).join(counts, label).select(F.col(label).alias("label"), F.col(text_col).alias("text"))

    def plain(t: str) -> str:
        return "".join(ch for ch in " ".join(t.lower().split()) if ch.isalnum() or ch in "_ ")

    def fits(source: str, made: str) -> bool:
        low = length[0]
        if kind == "paraphrase":
            low = 0.35 if len(source) < 700 else min(low * 0.9, 0.65) if len(source) > 1000 else low
        return bool(source) and low <= len(made) / len(source) <= length[1]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        sources = sorted(pdf["text"])
        vectors = list(embedder(pd.Series(sources)))
        source_vectors, out, cursor = vectors[:], [], 0
        need = target - len(sources)
        for attempt in range(rounds):
            added = 0
            for _ in range(max(1, 5 * (need - len(out)))):
                if len(out) >= need:
                    break
                at = cursor % len(sources)
                cursor += 1
                made = generate(pd.Series([sources[at]]), attempt * 31 + cursor).iloc[0]
                if not fits(sources[at], made) or plain(made) == plain(sources[at]):
                    continue
                v = embedder(pd.Series([made]))[0]
                to_source, most = float(v @ source_vectors[at]), float(max(v @ x for x in vectors))
                if similar[0] <= to_source <= similar[1] and to_class[0] <= most <= to_class[1]:
                    out.append((pdf["label"].iloc[0], made, sources[at], to_source, most, kind))
                    vectors.append(v)
                    added += 1
            if not added or len(out) >= need:
                break
        return pd.DataFrame(out, columns=["label", "text", "source_text", "cosine_sim", "max_label_cosine_sim", "augmentation_type"])

    return small.groupBy("label").applyInPandas(fill, "label string, text string, source_text string, cosine_sim double, max_label_cosine_sim double, augmentation_type string")


class FrequentSentences:
    """The n sentences of a text whose words it uses most, on average, in the order of the text; the first of equal ones."""

    def __init__(self, n: int = 3):
        self.n = n

    def __call__(self, texts: pd.Series) -> pd.Series:
        import re
        from collections import Counter

        def shortened(t: str) -> str:
            parts = [p for p in re.split(r"(?<=[.!?])\s+", t.strip()) if p]
            words = [re.findall(r"\w{2,}", p.lower()) for p in parts]
            often = Counter(w for ws in words for w in ws)
            score = [sum(often[w] for w in ws) / len(ws) if ws else 0.0 for ws in words]
            best = sorted(sorted(range(len(parts)), key=lambda i: (-score[i], i))[: self.n])
            return " ".join(parts[i] for i in best)

        return texts.map(shortened)


def summarize(df: DataFrame, id_col: str, text_col: str, model: Callable[[pd.Series], pd.Series], out: str = "summary") -> DataFrame:
    """df with a summary in `out`, which may be the text itself to replace it; blank texts aren't given to the model and
    keep a blank summary."""
    blank = F.coalesce(text.strip(F.col(text_col)), F.lit("")) == ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "_summary": model(pdf["t"])})

    kind = dict(df.dtypes)[id_col]
    made = df.filter(~blank).select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).mapInPandas(run, f"_id {kind}, _summary string")
    joined = df.join(made, df[id_col] == made["_id"], "left")
    return joined.withColumn(out, F.coalesce("_summary", F.lit(""))).drop("_id", "_summary")
