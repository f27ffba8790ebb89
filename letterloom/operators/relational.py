"""Deduplication, merging, splitting, ordering and pairing of labelled texts.

Random choices follow an arithmetic hash of a unique id, so they are the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.text import dedup_key


def multiplier(seed: int) -> int:
    """An odd number below 2**32; other seeds give other orders, not shifted ones."""
    return (2654435761 + seed * 1640531526) % 4294967296 | 1


def draw(id_col: Column, seed: int) -> Column:
    """A number below 2**32 from an id; nothing overflows, whatever the id."""
    return F.pmod(id_col, F.lit(1 << 31)) * F.lit(multiplier(seed)) % F.lit(4294967296)


def keep_first(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """One row a key, the first in the given order. Aggregates before the shuffle, unlike a window."""
    columns = df.columns
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("_key")).agg(first.alias("_row")).select("_row.*")


def merge_augmented(base: DataFrame, *tracks: DataFrame) -> DataFrame:
    """label, text, source_rank, row_id: base, then of every track what no earlier one has; the first of equal keys.

    An anti join against all earlier rows and then dropping repeated keys keeps the same rows as dropping repeats of the
    union in order, so that is all that is done: one shuffle by key.
    """
    parts = [t.select("label", "text", "row_id", F.lit(i).alias("source_rank")) for i, t in enumerate((base, *tracks))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    keyed = union.withColumn("k", F.sha2(F.coalesce(dedup_key(F.col("label"), F.col("text")), F.lit("\u0000")), 256))
    return keep_first(keyed, "k", "source_rank", "row_id").select("label", "text", "source_rank", "row_id")


def augment_delta(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """label, n_before, n_after, added; labels of either side, 0 where one has none."""
    a = before.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_after"))
    both = a.join(b, "label", "full_outer").select("label", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.withColumn("added", F.col("n_after") - F.col("n_before"))


def clean_report(df: DataFrame, label: str, before: Column, after: Column, kept: Column) -> DataFrame:
    """label, n_before, n_removed, n_edited, n_remaining in one aggregation."""
    rows = df.select(F.col(label).alias("label"), kept.alias("k"), (after != before).alias("e"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(~F.col("k")).alias("n_removed"),
        F.count_if(F.col("k") & F.col("e")).alias("n_edited"), F.count_if(F.col("k")).alias("n_remaining"),
    )


def ranked_within(df: DataFrame, id_col: str, label: str, seed: int, name: str, bins: int = 256) -> DataFrame:
    """df with the place, from 0, of each row among those of its label in the order of a hash of its id.

    Rows are counted in bins of the hash and numbered within a bin, so a label may hold any part of all rows.
    """
    h = draw(F.col(id_col), seed)
    rows = df.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 32 - bins.bit_length() + 1).cast("int"))
    counts = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(label).alias("_l"), F.col("_bin").alias("_b"), before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", id_col)) - 1
    numbered_rows = rows.withColumn("_w", within)
    joined = numbered_rows.join(starts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bin") == F.col("_b")))
    return joined.withColumn(name, F.col("_start") + F.col("_w")).drop("_h", "_bin", "_w", "_l", "_b", "_start")


def stratified_split(df: DataFrame, id_col: str, label: str, percent: int = 20, seed: int = 42, min_train: int = 0) -> DataFrame:
    """df with split test or train: one row of every label in test, then labels with at least two more by quota.

    Quotas are each label's part of what test still lacks, by largest remainder. min_train keeps that many rows of a
    label in train before any goes to test. Raises ValueError if test would be smaller than the number of labels.
    """
    rows = df.filter(F.col(label).isNotNull())
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row a label
    total, k = sum(r["_n"] for r in sizes), len(sizes)
    target = round(total * percent / 100)
    if target < k:
        raise ValueError(f"{target} test rows for {k} labels")
    rest = {r[label]: r["_n"] - 1 for r in sizes if r["_n"] >= 3}
    pool, wanted = sum(rest.values()), target - k
    whole = {c: n * wanted // pool for c, n in rest.items()} if pool else {}
    left = min(wanted, pool) - sum(whole.values())
    for c in sorted(rest, key=lambda c: (-(rest[c] * wanted % pool), c))[:left]:
        whole[c] += 1
    quota = {r[label]: min(1 + whole.get(r[label], 0), max(0, r["_n"] - min_train)) for r in sizes}
    quotas = df.sparkSession.createDataFrame(list(quota.items()), f"`{label}` {dict(df.dtypes)[label]}, _q bigint")
    ranked = ranked_within(rows, id_col, label, seed, "_r").join(F.broadcast(quotas), label)
    return ranked.withColumn("split", F.when(F.col("_r") < F.col("_q"), "test").otherwise("train")).drop("_r", "_q")


def deterministic_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """df with its place in a shuffled order, from 1. Numbered in buckets of the hash, so that no task numbers all rows."""
    mixed = df.withColumn("_h", draw(F.col(id_col), seed))
    return numbered(mixed, F.shiftright("_h", 20), ["_h", id_col], "place").withColumn("place", F.col("place") + 1).drop("_h")


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """df with numbers from 0 in the given order; bucket must grow with it. Buckets are numbered apart, after a count."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy("_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", before.alias("_s"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return rows.withColumn("_n", within).join(starts, "_b").withColumn(name, F.col("_n") + F.col("_s")).drop("_b", "_n", "_s")


def pair_split(df: DataFrame, id_col: str, share: float, seed: int = 7) -> DataFrame:
    """df with split valid or train by a hash; the share is held within 1 and 30 percent."""
    share = min(0.3, max(0.01, share))
    return df.withColumn("split", F.when(draw(F.col(id_col), seed) < int(share * 4294967296), "valid").otherwise("train"))


def pair_caps(df: DataFrame, label: str, cap: int) -> DataFrame:
    """label, n, n_pairs and the upper median over labels of the pairs held to cap, at least 1."""
    c = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("n_pairs", F.least(F.lit(cap).cast("bigint"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")))
    every = Window.partitionBy(F.lit(0))
    ranked = c.withColumn("_r", F.row_number().over(every.orderBy("n_pairs", "label"))).withColumn("_k", F.count(F.lit(1)).over(every))
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_k") / 2) + 1, F.col("n_pairs"))).over(every)
    return ranked.select("label", "n", "n_pairs", F.greatest(F.lit(1).cast("bigint"), median).alias("cap"))


def cross_pairs(rows: DataFrame, within: str, part: str, cap: int, seed: int) -> DataFrame:
    """within, a < b: min(cap, all) pairs of rows (id) that are alike in `within` and differ in `part`.

    With the rows of a group in the order of their parts, each row is paired with all rows of later parts. These pairs
    are numbered by the sizes of the parts and taken at equal steps, and each number tells its two places: nothing is
    searched or drawn again, however uneven the parts are.
    """
    sizes = rows.groupBy(within, part).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(within)
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_later", F.sum("_n").over(group) - F.col("_start") - F.col("_n"))
    sizes = sizes.withColumn("_pairs", F.col("_n") * F.col("_later"))
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_pairs").over(before), F.lit(0))).withColumn("_total", F.sum("_pairs").over(group))
    # the k-th pair taken has the number k * total / want; the products don't fit 64 bits
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    least_k = lambda c: F.expr(f"({big(c)} * {big('_want')} + {big('_total - 1')}) DIV {big('_total')}")
    taken = sizes.filter("_pairs > 0").withColumn("_want", F.least(F.lit(cap).cast("bigint"), F.col("_total")))
    taken = taken.withColumn("_from", least_k("_first")).withColumn("_to", least_k("_first + _pairs") - 1).filter("_from <= _to")
    taken = taken.withColumn("_k", F.explode(F.sequence("_from", "_to"))).withColumn("_number", F.expr(f"{big('_k')} * {big('_total')} DIV {big('_want')} - _first"))
    places = taken.select(within, F.expr("_start + _number DIV _later").alias("_p"), F.expr("_start + _n + _number % _later").alias("_q"))
    rank = F.row_number().over(Window.partitionBy(within, part).orderBy(draw(F.col("id"), seed), "id")) - 1
    placed = rows.withColumn("_rank", rank).join(sizes.select(within, part, "_start"), [within, part]).select(within, "id", (F.col("_start") + F.col("_rank")).alias("_place"))
    side = lambda place, name: placed.select(within, F.col("_place").alias(place), F.col("id").alias(name))
    pairs = places.join(side("_p", "x"), [within, "_p"]).join(side("_q", "y"), [within, "_q"])
    return pairs.select(within, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def positive_pairs(df: DataFrame, id_col: str, doc_col: str, label: str, cap: int, seed: int = 3) -> DataFrame:
    """a, b, label: min(cap, all) unordered pairs of chunks of one label and different documents.

    All pairs of a label would grow with its square. Where every document is one chunk, the chunks of a label are put in
    a row by hash and joined with those 1, 2, ... steps on, as many as this label needs, so the work is about cap pairs a
    label. Labels that have several chunks of a document go through cross_pairs.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(doc_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(label).alias("label"))
    docs = rows.groupBy("label", "doc").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    m = F.least(F.col("n"), F.lit(cap + 1))
    # steps 1 to s hold s * m - s * (s + 1) / 2 pairs
    enough = F.ceil((2 * m - 1 - F.sqrt(F.greatest(F.lit(0), (2 * m - 1) * (2 * m - 1) - 8 * F.lit(cap)))) / 2) + 1
    steps = F.when(m * (m - 1) <= 2 * cap, m - 1).otherwise(F.least(m - 1, enough))
    single = docs.filter("most = 1 AND n > 1").select("label", m.alias("m"), steps.alias("steps"))
    wl = Window.partitionBy("label").orderBy(draw(F.col("id"), seed), "id")
    ring = rows.withColumn("i", F.row_number().over(wl)).filter(F.col("i") <= cap + 1)
    each = ring.join(single, "label").filter("i < m").withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("steps", F.col("m") - F.col("i"))))).withColumn("k", F.col("i") + F.col("j"))
    other = ring.select("label", F.col("i").alias("k"), F.col("id").alias("b"))
    ranked = each.join(other, ["label", "k"]).withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("j", "i"))).filter(F.col("_r") <= cap)
    several = rows.join(docs.filter("most > 1").select("label"), "label", "left_semi")
    out = ranked.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "label")
    return out.unionByName(cross_pairs(several, "label", "doc", cap, seed))


def negative_pairs(df: DataFrame, id_col: str, label: str, cap: int, seed: int = 5) -> DataFrame:
    """a, b: min(cap, all) unordered pairs of different labels."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.lit(0).alias("_all"))
    return cross_pairs(rows, "_all", "label", cap, seed).select("a", "b")
