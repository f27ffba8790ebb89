"""Class balance, coverage and length profiles of a labelled corpus.

Everything after the count by label works on one row a label; windows over those rows are over a table whose size is
the number of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.text import tokens
from letterloom.sources.io import spread


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def char_totals(df: DataFrame, before: Column, after: Column) -> DataFrame:
    size = lambda c: F.sum(F.length(F.coalesce(c, F.lit("")))).cast("bigint")
    return df.agg(size(before).alias("chars_before"), size(after).alias("chars_after"))


def dataset_summary(df: DataFrame, label: str = "label") -> DataFrame:
    c = label_counts(df.filter(F.col(label).isNotNull()), label)
    return c.agg(
        F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_per_class"), F.max("n").alias("max_per_class"),
        F.round(F.avg("n"), 6).alias("mean_per_class"),
    )


def text_describe(df: DataFrame, text: str = "text") -> DataFrame:
    """count, mean, std, min, quartiles and max of the lengths in characters and words."""
    rows = df.filter(F.col(text).isNotNull()).select(F.length(text).alias("chars"), F.size(tokens(F.col(text))).alias("words"))
    out = None
    for unit in ("chars", "words"):
        p = lambda q: F.percentile(unit, F.lit(q)).cast("double")  # noqa: B023, E731
        one = rows.agg(
            F.lit(unit).alias("unit"), F.count(unit).alias("n"), F.round(F.avg(unit), 6).alias("mean"), F.round(F.stddev_samp(unit), 6).alias("std"),
            F.min(unit).alias("min"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.max(unit).alias("max"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def class_size_thresholds(df: DataFrame, label: str, limits: tuple[int, ...]) -> DataFrame:
    c = label_counts(df.filter(F.col(label).isNotNull()), label)
    counted = c.agg(*[F.count_if(F.col("n") <= t).alias(str(t)) for t in limits])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("n_classes")) for t in limits])))


def _shares(df: DataFrame, label: str) -> DataFrame:
    c = label_counts(df.filter(F.col(label).isNotNull()), label)
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    s = _shares(df, label).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"), F.count(F.lit(1)).alias("k"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    return s.select(
        F.round("h", 6).alias("entropy"), F.round(F.try_divide("h", F.log("k")), 6).alias("normalized"),
        F.round(F.exp("h"), 6).alias("effective_classes"), F.round(1 - F.col("pp"), 6).alias("gini"),
    )


def label_coverage(df: DataFrame, label: str, levels: tuple[float, ...]) -> DataFrame:
    """How many of the largest classes it takes to go beyond each share of the rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "label")
    cum = label_counts(df.filter(F.col(label).isNotNull()), label).select(
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all")
    )
    counted = cum.agg(*[(F.count_if(F.round(F.col("c") / F.col("all"), 9) <= q) + 1).alias(f"q{i}") for i, q in enumerate(levels)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col(f"q{i}").alias("n_classes")) for i, q in enumerate(levels)])))


def label_tail(df: DataFrame, label: str, k: int) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("n", "label")
    ranked = _shares(df, label).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return ranked.agg(F.sum("n").alias("n_rows"), F.round(F.sum("p"), 6).alias("share"))


def lorenz_curve(df: DataFrame, label: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("n", "label")
    every = Window.partitionBy(F.lit(0))
    return label_counts(df.filter(F.col(label).isNotNull()), label).select(
        "label",
        F.round(F.row_number().over(w) / F.count(F.lit(1)).over(every), 6).alias("class_share"),
        F.round(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every), 6).alias("row_share"),
    )


def missing_counts(df: DataFrame, *columns: str) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])))


def duplicate_stats(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows beyond the first of each text, and of each text and label, and the share of rows whose text recurs.

    Grouped by a hash of the text first, so the texts themselves are not sorted.
    """
    groups = df.groupBy(F.sha2(F.coalesce(text, F.lit("\u0000")), 256).alias("t"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    by_text = groups.groupBy("t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    return by_text.agg(
        (F.sum("n") - F.count(F.lit(1))).alias("dup_text"), (F.sum("n") - F.sum("pairs")).alias("dup_text_label"),
        F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_in_dups"),
    )


def top_labels_per_group(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    counted = df.groupBy(F.col(group).alias("grp"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp").orderBy(F.col("n").desc(), F.col("label").asc_nulls_first())
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_bigrams(df: DataFrame, group: str, words: Column, k: int) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))
    each = spread(df).select(F.col(group).alias("grp"), words.alias("w")).filter(F.size("w") > 1).select("grp", F.explode(pairs).alias("bigram"))
    counted = each.groupBy("grp", "bigram").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp").orderBy(F.col("n").desc(), "bigram")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def length_histogram(df: DataFrame, text: str, bins: int) -> DataFrame:
    """Equal-width bins between the least and the greatest length; the last bin holds its upper edge."""
    rows = df.filter(F.col(text).isNotNull()).select(F.length(text).alias("n"))
    edges = rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("n") - F.col("lo"), width))).cast("int")
    # edges is one row
    return rows.crossJoin(F.broadcast(edges)).groupBy(F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n_docs"))


def approx_tokens(df: DataFrame, text: str, factor: float = 1.4) -> DataFrame:
    """Mean and median of words times factor, rounded half to even."""
    t = df.filter(F.col(text).isNotNull()).select(F.bround(F.size(tokens(F.col(text))) * F.lit(factor)).alias("t"))
    return t.agg(F.round(F.avg("t"), 6).alias("mean_tokens"), F.percentile("t", F.lit(0.5)).cast("double").alias("median_tokens"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    c = label_counts(df.filter(F.col(label).isNotNull()), label)
    every = Window.partitionBy(F.lit(0))
    return c.select("label", F.round(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), 6).alias("weight"))


def label_topn_other(df: DataFrame, label: str, n: int) -> DataFrame:
    """df with the label, or Other where it isn't among the n most frequent."""
    c = label_counts(df.filter(F.col(label).isNotNull()), label)
    top = c.withColumn("_r", F.row_number().over(Window.orderBy(F.col("n").desc(), "label"))).filter(F.col("_r") <= n)
    # n rows
    return df.join(F.broadcast(top.select(F.col("label").alias("_top"))), F.col(label) == F.col("_top"), "left").withColumn("label_top", F.coalesce("_top", F.lit("Other"))).drop("_top")


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """label, label_id: distinct labels in order, from 0."""
    distinct = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return distinct.withColumn("label_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1)


def unseen_labels(test: DataFrame, train: DataFrame, label: str) -> DataFrame:
    have = train.select(F.col(label).alias("label")).distinct()
    return test.select(F.col(label).alias("label")).filter("label IS NOT NULL").distinct().join(have, "label", "left_anti")


def small_classes(df: DataFrame, label: str, target: int) -> DataFrame:
    return label_counts(df.filter(F.col(label).isNotNull()), label).filter(F.col("n") < target).withColumn("needed", target - F.col("n"))
