"""Deduplication, merging, splitting, pairing and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import chunks, text
from letterloom.functions.sequential import clean_text
from letterloom.operators import relational as R
from letterloom.plans.registry import query, table
from letterloom.plans.texts import sql_strip, sql_tokens
from letterloom.sources.io import spread

_EMPTY = "coalesce(text, '')"
_KEY = f"label || '|||' || lower({sql_strip(_EMPTY)})"


def _draw(c: str, seed: int) -> str:
    return f"(({c} % 2147483648) * {R.multiplier(seed)} % 4294967296)"


query("dedup_exact", f"SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({_KEY}, '<null>') ORDER BY row_id) AS r FROM train) WHERE r = 1")(
    lambda s, d: R.keep_first(
        table(s, d, "train").select("row_id", "label", F.sha2(F.coalesce(text.dedup_key(F.col("label"), F.col("text")), F.lit("\u0000")), 256).alias("k")), "k", "row_id"
    ).select("row_id", "label")
)
_UNION = (
    "SELECT 0 AS source_rank, row_id, label, text FROM train UNION ALL SELECT 1, row_id, label, text FROM train_augmented WHERE augmentation_type = 'paraphrase' "
    "UNION ALL SELECT 2, row_id, label, text FROM train_augmented WHERE augmentation_type = 'back_translation'"
)


def _merged(s, d):
    aug = table(s, d, "train_augmented")
    return R.merge_augmented(table(s, d, "train"), aug.filter("augmentation_type = 'paraphrase'"), aug.filter("augmentation_type = 'back_translation'"))


query("merge_augmented", f"SELECT source_rank, row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({_KEY}, '<null>') ORDER BY source_rank, row_id) AS r FROM ({_UNION})) WHERE r = 1")(
    lambda s, d: _merged(s, d).select("source_rank", "row_id", "label")
)
query(
    "augment_delta",
    "WITH a AS (SELECT label, count(*) AS n_before FROM train GROUP BY label), b AS (SELECT label, count(*) AS n_after FROM train_augmented GROUP BY label) "
    "SELECT coalesce(a.label, b.label) AS label, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_after, 0) - coalesce(n_before, 0) AS added FROM a FULL JOIN b ON a.label = b.label",
)(lambda s, d: R.augment_delta(table(s, d, "train"), table(s, d, "train_augmented"), "label"))
@query("clean_report")
def clean_report(s, d):
    """Rows of a label before, removed, edited and left by the whole cleaning stage."""
    rows = spread(table(s, d, "documents").select("lang", text.strip(F.coalesce("text", F.lit(""))).alias("text")))
    done, c = clean_text(rows, out="cleaned"), F.col("cleaned")
    return R.clean_report(done, "lang", F.col("text"), c, (c != "") & (text.content_ratio(c) >= 0.15) & (text.content_tokens(c) >= 5))


@query("clean_corpus")
def clean_corpus(s, d):
    """The whole cleaning stage: cleaned texts that have enough content left."""
    done = clean_text(spread(table(s, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))), out="cleaned").drop("text")
    c = F.col("cleaned")
    return done.filter((c != "") & (text.content_ratio(c) >= 0.15) & (text.content_tokens(c) >= 5))


_SPLIT = (
    "WITH t AS (SELECT row_id, label FROM train WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n FROM t GROUP BY label), "
    "g AS (SELECT round_even(sum(n) * 20 / 100.0::DOUBLE, 0) - count(*) AS wanted, coalesce(sum(n - 1) FILTER (n >= 3), 0) AS pool FROM c), "
    "w AS (SELECT label, n, CASE WHEN n >= 3 THEN CAST((n - 1) * wanted AS BIGINT) // CAST(pool AS BIGINT) ELSE 0 END AS whole, CASE WHEN n >= 3 THEN CAST((n - 1) * wanted AS BIGINT) % CAST(pool AS BIGINT) END AS rest FROM c, g), "
    "o AS (SELECT label, n, whole, rest, row_number() OVER (ORDER BY rest DESC NULLS LAST, label) AS r, least((SELECT wanted FROM g), (SELECT pool FROM g)) - sum(whole) OVER () AS left_over FROM w), "
    "quota AS (SELECT label, least(n, 1 + whole + CASE WHEN rest IS NOT NULL AND r <= left_over THEN 1 ELSE 0 END) AS q FROM o) "
    f"SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_draw('row_id', 42)}, row_id) <= q THEN 'test' ELSE 'train' END AS split FROM t JOIN quota USING (label)"
)
query("stratified_split", _SPLIT)(lambda s, d: R.stratified_split(table(s, d, "train").select("row_id", "label"), "row_id", "label"))
query("deterministic_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_draw('doc_id', 42)}, doc_id) AS place FROM documents")(
    lambda s, d: R.deterministic_shuffle(table(s, d, "documents").select("doc_id"), "doc_id")
)
query("pair_split", f"SELECT row_id, CASE WHEN {_draw('row_id', 7)} < {int(0.1 * 4294967296)} THEN 'valid' ELSE 'train' END AS split FROM train")(
    lambda s, d: R.pair_split(table(s, d, "train").select("row_id"), "row_id", 0.1)
)
query(
    "pair_caps",
    "WITH c AS (SELECT label, count(*) AS n, least(500, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT)) AS n_pairs FROM train WHERE label IS NOT NULL GROUP BY label), "
    "r AS (SELECT *, row_number() OVER (ORDER BY n_pairs, label) AS r, count(*) OVER () AS k FROM c) SELECT label, n, n_pairs, greatest(1, max(CASE WHEN r = k // 2 + 1 THEN n_pairs END) OVER ()) AS cap FROM r",
)(lambda s, d: R.pair_caps(table(s, d, "train"), "label", 500))
_RING = f"SELECT row_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {_draw('row_id', 3)}, row_id) AS i FROM train WHERE label IS NOT NULL"
def _positive_sql(cap: int) -> str:
    """min(cap, all) pairs of a label: those of the rows in the order of their hashes that are the fewest places apart."""
    return (
        f"WITH ring AS (SELECT * FROM ({_RING}) WHERE i <= {cap + 1}) SELECT least(id, b) AS a, greatest(id, b) AS b, label FROM "
        f"(SELECT x.id, y.id AS b, x.label, row_number() OVER (PARTITION BY x.label ORDER BY y.i - x.i, x.i) AS r FROM ring x JOIN ring y ON x.label = y.label AND y.i > x.i) WHERE r <= {cap}"
    )


def _negative_sql(cap: int) -> str:
    """min(cap, all) pairs of different labels at equal steps of all of them, numbered by label and place."""
    return (
        f"WITH t AS (SELECT row_id AS id, label, row_number() OVER (ORDER BY label, {_draw('row_id', 5)}, row_id) - 1 AS place FROM train WHERE label IS NOT NULL), "
        "n AS (SELECT label, count(*) AS n, min(place) AS start, (SELECT count(*) FROM t) - min(place) - count(*) AS later FROM t GROUP BY label), "
        "c AS (SELECT *, n * later AS pairs, sum(n * later) OVER (ORDER BY label) - n * later AS first, sum(n * later) OVER () AS total FROM n), "
        f"k AS (SELECT CAST(k * (SELECT max(total) FROM c) // least({cap}, (SELECT max(total) FROM c)) AS HUGEINT) AS number FROM (SELECT unnest(range(0, CAST(least({cap}, (SELECT max(total) FROM c)) AS BIGINT)))::HUGEINT AS k)), "
        "p AS (SELECT start + (number - first) // later AS p, start + n + (number - first) % later AS q FROM k JOIN c ON number >= first AND number < first + pairs) "
        "SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p JOIN t x ON x.place = p.p JOIN t y ON y.place = p.q"
    )


for _cap in (100, 5000):
    query("positive_pairs" + "_5000" * (_cap == 5000), _positive_sql(_cap))(lambda s, d, cap=_cap: R.positive_pairs(table(s, d, "train").withColumn("doc", F.col("row_id")), "row_id", "doc", "label", cap))
for _cap in (500, 5000):
    query("negative_pairs" + "_5000" * (_cap == 5000), _negative_sql(_cap))(lambda s, d, cap=_cap: R.negative_pairs(table(s, d, "train"), "row_id", "label", cap))

_SIZE, _OVER = 64, 16
_W = sql_tokens(_EMPTY)
_CHUNKS = (
    f"SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) > {_SIZE} THEN list_append(c, list_concat(list_slice(w, 1, {_SIZE // 2}), list_slice(w, len(w) - {_SIZE // 2} + 1, len(w)))) ELSE c END AS c FROM "
    f"(SELECT doc_id, w, list_transform(range(0, CAST(ceil(greatest(0, len(w) - {_SIZE}) / {_SIZE - _OVER}.0::DOUBLE) AS BIGINT) + 1), lambda i: list_slice(w, i * {_SIZE - _OVER} + 1, i * {_SIZE - _OVER} + {_SIZE})) AS c FROM (SELECT doc_id, {_W} AS w FROM documents))"
)
_EXPLODED = f"SELECT doc_id, array_to_string(x, ' ') AS text, min(i) AS i FROM (SELECT doc_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM ({_CHUNKS})) GROUP BY doc_id, x"
query("chunk_explode", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_pos, text FROM ({_EXPLODED})")(
    lambda s, d: chunks.chunk_explode(table(s, d, "documents"), "doc_id", "text", _SIZE, _OVER)
)
query("chunk_tokens", f"SELECT doc_id, CAST(len(c) AS INT) AS n_chunks, CAST(coalesce(list_sum(list_transform(c, lambda x: len(x))), 0) AS BIGINT) AS n_words FROM ({_CHUNKS})")(
    lambda s, d: table(s, d, "documents")
    .select("doc_id", chunks.chunk_tokens(text.tokens(F.coalesce("text", F.lit(""))), _SIZE, _OVER, distinct=False).alias("c"))
    .select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)).alias("n_words"))
)
query(
    "chunk_dedup",
    f"SELECT doc_id, chunk_pos FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk_pos) AS r FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_pos, text FROM ({_EXPLODED}))) WHERE r = 1",
)(
    lambda s, d: R.keep_first(
        chunks.chunk_explode(table(s, d, "documents"), "doc_id", "text", _SIZE, _OVER).select("doc_id", "chunk_pos", F.sha2("text", 256).alias("k")), "k", "doc_id", "chunk_pos"
    ).select("doc_id", "chunk_pos")
)
query(
    "chunk_padded",
    f"SELECT doc_id, n AS num_chunks, CAST(coalesce(list_sum(list_transform(range(n), lambda i: least(64, greatest(0, len(w) - i * 48)))), 0) AS BIGINT) AS n_masked, CAST(6 * 64 AS INT) AS n_places "
    f"FROM (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(least(6, 1 + ceil(greatest(0, len(w) - 64) / 48.0::DOUBLE)) AS INT) END AS n FROM (SELECT doc_id, {_W} AS w FROM documents))",
)(
    lambda s, d: table(s, d, "documents")
    .select("doc_id", chunks.chunk_padded(text.tokens(F.coalesce("text", F.lit(""))), 64, 16, 6).alias("c"))
    .select("doc_id", "c.num_chunks", F.aggregate(F.flatten("c.mask"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_masked"), F.size(F.flatten("c.input")).alias("n_places"))
)
query("fixed_word_windows", f"SELECT doc_id, CAST(i AS INT) AS pos, array_to_string(list_slice(w, i * 20 + 1, i * 20 + 20), ' ') AS words FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 20.0::DOUBLE) AS BIGINT))) AS i FROM (SELECT doc_id, {_W} AS w FROM documents))")(
    lambda s, d: table(s, d, "documents")
    .select("doc_id", F.posexplode(chunks.fixed_word_windows(text.tokens(F.coalesce("text", F.lit(""))))).alias("pos", "w"))
    .select("doc_id", "pos", F.array_join("w", " ").alias("words"))
)
