"""Overlapping chunks of word arrays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import let, tokens


def windows(words: Column, size: int, overlap: int) -> Column:
    """Slices of `size` words, each starting size - overlap after the last, up to the first that reaches the end."""
    step = size - overlap
    number = lambda w: F.ceil(F.greatest(F.lit(0), F.size(w) - size) / F.lit(float(step))).cast("int")
    cut = lambda w: F.transform(F.sequence(F.lit(0), number(w)), lambda i: F.slice(w, i * step + 1, F.lit(size)))
    return F.when(F.size(words) == 0, F.array().cast("array<array<string>>")).otherwise(let(words, cut))


def chunk_tokens(words: Column, size: int = 448, overlap: int = 128, distinct: bool = True) -> Column:
    """windows(), and for what is longer than one the halves of a window from the head and the tail."""
    half = size // 2
    both = lambda w: F.array(F.concat(F.slice(w, 1, half), F.slice(w, -half, half)))
    all_of = lambda w: F.when(F.size(w) > size, F.concat(windows(w, size, overlap), both(w))).otherwise(windows(w, size, overlap))
    chunks = let(words, all_of)
    return F.array_distinct(chunks) if distinct else chunks


def chunk_explode(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_pos, text: one row a chunk; documents without words have none."""
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(chunk_tokens(tokens(F.coalesce(F.col(text_col), F.lit(""))), size, overlap)).alias("chunk_pos", "c")).select(
        "doc_id", "chunk_pos", F.array_join("c", " ").alias("text")
    )


def chunk_padded(words: Column, size: int = 512, overlap: int = 128, most: int = 6, pad: str = "") -> Column:
    """input, mask, num_chunks: exactly `most` windows of exactly `size` words, the missing ones filled up."""

    def shape(w: Column) -> Column:
        kept = F.slice(windows(w, size, overlap), 1, most)
        filled = lambda ws: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get(ws, i), F.array().cast("array<string>")))
        padded = lambda ws: F.transform(filled(ws), lambda x: F.concat(x, F.array_repeat(F.lit(pad), F.lit(size) - F.size(x))))
        mask = lambda ws: F.transform(filled(ws), lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), F.lit(size) - F.size(x))))
        return let(kept, lambda ws: F.struct(padded(ws).alias("input"), mask(ws).alias("mask"), F.size(ws).alias("num_chunks")))

    return let(words, shape)


def fixed_word_windows(words: Column, size: int = 20) -> Column:
    return windows(words, size, 0)
