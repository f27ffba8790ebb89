"""Term weights in long form (doc_id, term, weight) and vector features.

Texts are taken apart once: counts by document and term are exchanged by document, and that exchange serves both the
document frequencies, which are summed before they move, and the rows they are joined with. Where the frequencies are few
enough to be broadcast, the rows stay where they are for their norms; else they move by term and back.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.text import WORD, WS, let


def word_terms(text: Column, most: int = 2) -> Column:
    """Words of at least two characters, and pairs of neighbours, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    if most == 1:
        return words
    pairs = lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))))
    return let(words, lambda w: F.concat(w, pairs(w)))


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words that have a space on either side; a shorter word counts once, as a whole."""
    words = F.transform(F.filter(F.split(F.lower(text), f"{WS}+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def grams(w: Column) -> Column:
        of = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        # a word shorter than n gives itself for the least n that is too long, and nothing for longer n
        once = F.when(F.length(w) < most, F.when(F.length(w) < least, F.array(w)).otherwise(F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of(n) for n in range(least, most + 1)], once)

    return F.flatten(F.transform(words, grams))


def char_rows(df: DataFrame, id_col: str, text: Column, least: int = 3, most: int = 5) -> DataFrame:
    """doc_id, term: the character n-grams of char_terms as rows, by plain string functions that compile."""
    words = df.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.lower(text), f"{WS}+")).alias("w")).filter("w <> ''")
    words = words.withColumn("w", F.concat(F.lit(" "), "w", F.lit(" "))).withColumn("n", F.length("w"))
    starts = words.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - least + 1))))
    # a word too short for any n gives itself
    grams = [F.when(F.col("n") >= F.col("i") + (k - 1), F.substring("w", F.col("i"), F.lit(k))) for k in range(least, most + 1)]
    grams[0] = F.when(F.col("n") < least, F.col("w")).otherwise(grams[0])
    return starts.select("doc_id", F.explode(F.array(*grams)).alias("term")).filter("term IS NOT NULL")


def term_counts(df: DataFrame, id_col: str, terms: Column | None = None, rows=None) -> DataFrame:
    """doc_id, term, tf, partitioned by document; terms is an array of terms, or rows a function of df to (doc_id, term).

    Rows move by document before they are taken apart, each text once instead of all its terms, and their counts again
    without moving between partitions of the same number: that second exchange is the one that is reused.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartition(n)
    each = rows(spread) if rows else spread.select(F.col(id_col).alias("doc_id"), F.explode(terms).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).repartition(n, "doc_id")


def tfidf(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, normalize: bool = True, fitted: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight: smooth idf plus one, optionally 1 + ln(tf), optionally rows of unit length.

    Frequencies are those of counts, or of `fitted`, the counts of n_docs other documents.
    """
    df = (counts if fitted is None else fitted).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    # no sort of all rows by term; a partition of the frequencies is small beside one of the rows
    raw = counts.join(df.hint("shuffle_hash"), "term").select("doc_id", "term", (tf * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("weight"))
    return by_document(raw) if normalize else raw


def by_document(rows: DataFrame) -> DataFrame:
    """rows with their weights scaled to unit length by document, in one pass over them."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return rows.withColumn("weight", F.try_divide("weight", norm))


def stacked(*blocks: DataFrame) -> DataFrame:
    """doc_id, block, term, weight of several blocks side by side, each as it is."""
    union = None
    for i, b in enumerate(blocks):
        part = b.select("doc_id", F.lit(i).alias("block"), "term", "weight")
        union = part if union is None else union.unionByName(part)
    return union


def joint_l2(*blocks: DataFrame) -> DataFrame:
    """stacked() with rows of unit length over all blocks together."""
    return by_document(stacked(*blocks))


def unit_blocks(*blocks: DataFrame) -> DataFrame:
    """joint_l2() of blocks that are each scaled to unit rows first, in one pass over unscaled blocks: where every block is
    a unit row, all together are as long as the root of their number."""
    rows, w = stacked(*blocks), Window.partitionBy("doc_id")
    square = F.col("weight") * F.col("weight")
    sums = [F.sum(F.when(F.col("block") == i, square)).over(w) for i in range(len(blocks))]
    present = sum((F.when(s > 0, 1).otherwise(0) for s in sums), F.lit(0))
    own = F.coalesce(*[F.when(F.col("block") == i, s) for i, s in enumerate(sums)])
    return rows.withColumn("weight", F.try_divide("weight", F.sqrt(own * present)))


def dense_block(rows: DataFrame, id_col: str, vec: str, weight: float = 1.0) -> DataFrame:
    """doc_id, term, weight of dense vectors scaled to unit length and then by `weight`; terms are their places. Rows
    without a usable vector have none."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = rows.select(F.col(id_col).alias("doc_id"), v.alias("v"), norm.alias("n")).filter("n > 0 AND NOT isnan(n)")
    each = good.select("doc_id", "n", F.posexplode("v").alias("pos", "x"))
    return each.select("doc_id", F.col("pos").cast("string").alias("term"), (F.col("x") / F.col("n") * weight).alias("weight"))


def hybrid_matrix(sparse: DataFrame, dense: DataFrame, normalize: bool) -> DataFrame:
    """doc_id, block, term, weight: rows of the sparse block (0, doc_id, term, weight, unit rows) and the dense block (1) of
    documents that have both; linear models take it as it is, others with rows of unit length."""
    both = sparse.select("doc_id").distinct().join(dense.select("doc_id").distinct(), "doc_id")
    rows = stacked(sparse, dense).join(both, "doc_id", "left_semi")
    return by_document(rows) if normalize else rows


def row_summary(weights: DataFrame) -> DataFrame:
    """doc_id, n_terms, sum, sum of squares and greatest weight of each row."""
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 4).alias("weight_sum"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 4).alias("weight_squares"), F.round(F.max("weight"), 6).alias("weight_max"),
    )


def standard_scale(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """id, pos, z by the means and population deviations of fit; a constant place becomes 0.

    The statistics are one row, summed over whole vectors before anything moves.
    """
    vectors = fit.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("x"))
    stats = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")).select("s.*")
    one = F.broadcast(stats.select(vector_to_array("mean").alias("m"), vector_to_array("variance").alias("s2"), "count"))
    scaled = rows.join(one).select("id", F.posexplode(F.arrays_zip("v", "m", "s2")).alias("pos", "p"), "count")
    sd = F.sqrt(F.col("p.s2") * (F.col("count") - 1) / F.col("count"))
    return scaled.select("id", "pos", F.when(sd > 0, (F.col("p.v") - F.col("p.m")) / sd).otherwise(0.0).alias("z"))


def block_energy_share(first: Column, second: Column) -> Column:
    """Part of the squared length that the second block has."""
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return squares(second) / (squares(first) + squares(second) + 1e-12)


def pooled(df: DataFrame, group: str, vec: str, how: str) -> DataFrame:
    """group, pos, x of the vectors of each group: mean, max or half their sum."""
    long = df.select(F.col(group).alias("grp"), F.posexplode(vec).alias("pos", "x"))
    mean, top = F.avg("x"), F.max("x")
    return long.groupBy("grp", "pos").agg({"mean": mean, "max": top, "mean_max": (mean + top) / 2}[how].alias("x"))
