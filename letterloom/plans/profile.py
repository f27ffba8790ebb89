"""Profile queries. documents.lang or source, or train.label, play the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions.text import norm_space, simple_tokens
from letterloom.operators import profile as P
from letterloom.plans.registry import query, table
from letterloom.plans.texts import SQL_WORDS, sql_norm, sql_tokens

DOCS = "documents"
COUNTS = "WITH c AS (SELECT label, count(*) AS n FROM train WHERE label IS NOT NULL GROUP BY label), s AS (SELECT label, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM c) "


def _train(spark, d):
    return table(spark, d, "train")


query("label_counts", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")(lambda s, d: P.label_counts(table(s, d, DOCS), "lang"))
query("char_totals", f"SELECT CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars_before, CAST(sum(length(coalesce({sql_norm('text')}, ''))) AS BIGINT) AS chars_after FROM documents")(
    lambda s, d: P.char_totals(table(s, d, DOCS), F.col("text"), norm_space(F.col("text")))
)
query("dataset_summary", COUNTS + "SELECT CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_classes, min(n) AS min_per_class, max(n) AS max_per_class, round(avg(n), 6) AS mean_per_class FROM c")(
    lambda s, d: P.dataset_summary(_train(s, d))
)
_lengths = f"SELECT length(text) AS chars, len({sql_tokens('text')}) AS words FROM documents WHERE text IS NOT NULL"
_one = "SELECT '{u}' AS unit, count({u}) AS n, round(avg({u}), 6) AS mean, round(stddev_samp({u}), 6) AS std, CAST(min({u}) AS INT) AS min, quantile_cont({u}, 0.25) AS p25, quantile_cont({u}, 0.5) AS p50, quantile_cont({u}, 0.75) AS p75, CAST(max({u}) AS INT) AS max FROM l"
query("text_describe", f"WITH l AS ({_lengths}) {_one.format(u='chars')} UNION ALL {_one.format(u='words')}")(lambda s, d: P.text_describe(table(s, d, DOCS)))
_limits = (5, 10, 20, 50, 100, 150, 200, 240)
query("class_size_thresholds", COUNTS + f"SELECT CAST(t AS INT) AS threshold, (SELECT count(*) FROM c WHERE n <= t) AS n_classes FROM (SELECT unnest([{', '.join(map(str, _limits))}]) AS t)")(
    lambda s, d: P.class_size_thresholds(_train(s, d), "label", _limits)
)
query(
    "label_entropy",
    COUNTS + "SELECT round(h, 6) AS entropy, round(h / ln(k), 6) AS normalized, round(exp(h), 6) AS effective_classes, round(1 - pp, 6) AS gini FROM (SELECT -sum(p * ln(p + 1e-12)) AS h, count(*) AS k, sum(p * p) AS pp FROM s)",
)(lambda s, d: P.label_entropy(_train(s, d), "label"))
query(
    "label_coverage",
    COUNTS + ", m AS (SELECT sum(n) OVER (ORDER BY n DESC, label) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM c) SELECT CAST(l AS DOUBLE) AS level, (SELECT count(*) FROM m WHERE round(q, 9) <= l) + 1 AS n_classes FROM (SELECT unnest([0.8, 0.9, 0.95, 0.99]) AS l)",
)(lambda s, d: P.label_coverage(_train(s, d), "label", (0.8, 0.9, 0.95, 0.99)))
query("label_tail", COUNTS + "SELECT CAST(sum(n) AS BIGINT) AS n_rows, round(sum(p), 6) AS share FROM (SELECT * FROM s ORDER BY n, label LIMIT 15)")(lambda s, d: P.label_tail(_train(s, d), "label", 15))
query(
    "lorenz_curve",
    COUNTS + "SELECT label, round(row_number() OVER (ORDER BY n, label) / CAST(count(*) OVER () AS DOUBLE), 6) AS class_share, round(sum(n) OVER (ORDER BY n, label) / CAST(sum(n) OVER () AS DOUBLE), 6) AS row_share FROM c",
)(lambda s, d: P.lorenz_curve(_train(s, d), "label"))
_cols = ("text", "lang", "source", "n_chars", "received_at", "loaded_at")
query("missing_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM documents" for c in _cols))(
    lambda s, d: P.missing_counts(table(s, d, DOCS), *_cols)
)
query(
    "duplicate_stats",
    "WITH g AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT text, sum(n) AS n, count(*) AS pairs FROM g GROUP BY text) SELECT CAST(sum(n) - count(*) AS BIGINT) AS dup_text, CAST(sum(n) - sum(pairs) AS BIGINT) AS dup_text_label, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share_in_dups FROM t",
)(lambda s, d: P.duplicate_stats(table(s, d, DOCS), "text", "lang"))
query(
    "top_labels_per_group",
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, label NULLS FIRST) AS INT) AS rank FROM (SELECT source AS grp, lang AS label, count(*) AS n FROM documents GROUP BY ALL)) WHERE rank <= 10",
)(lambda s, d: P.top_labels_per_group(table(s, d, DOCS), "source", "lang", 10))
query(
    "top_bigrams",
    f"WITH w AS (SELECT source AS grp, {SQL_WORDS} AS w FROM documents), b AS (SELECT grp, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w WHERE len(w) > 1), "
    "c AS (SELECT grp, bigram, count(*) AS n FROM b GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, bigram) AS INT) AS rank FROM c) WHERE rank <= 10",
)(lambda s, d: P.top_bigrams(table(s, d, DOCS), "source", simple_tokens(F.col("text")), 10))
query(
    "length_histogram",
    "WITH e AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM documents) SELECT CAST(least(59, floor((length(text) - lo) / ((hi - lo) / 60.0::DOUBLE))) AS INT) AS bin, count(*) AS n_docs FROM documents, e WHERE text IS NOT NULL GROUP BY ALL",
)(lambda s, d: P.length_histogram(table(s, d, DOCS), "text", 60))
query("approx_tokens", f"WITH t AS (SELECT round_even(len({sql_tokens('text')}) * 1.4::DOUBLE, 0) AS t FROM documents WHERE text IS NOT NULL) SELECT round(avg(t), 6) AS mean_tokens, CAST(quantile_cont(t, 0.5) AS DOUBLE) AS median_tokens FROM t")(
    lambda s, d: P.approx_tokens(table(s, d, DOCS), "text")
)
query("class_weights", COUNTS + "SELECT label, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight FROM c")(lambda s, d: P.class_weights(_train(s, d), "label"))
query("label_topn_other", COUNTS + "SELECT row_id, coalesce(t.label, 'Other') AS label_top FROM train LEFT JOIN (SELECT label FROM c ORDER BY n DESC, label LIMIT 10) t USING (label)")(
    lambda s, d: P.label_topn_other(_train(s, d), "label", 10).select("row_id", "label_top")
)
query("label_encode", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id FROM (SELECT DISTINCT label FROM train WHERE label IS NOT NULL)")(lambda s, d: P.label_encode(_train(s, d), "label"))
query("unseen_labels", "SELECT DISTINCT label FROM test WHERE label IS NOT NULL AND label NOT IN (SELECT label FROM train WHERE label IS NOT NULL)")(
    lambda s, d: P.unseen_labels(table(s, d, "test"), _train(s, d), "label")
)
query("small_classes", COUNTS + "SELECT label, n, 30 - n AS needed FROM c WHERE n < 30")(lambda s, d: P.small_classes(_train(s, d), "label", 30))
