"""Queries of the string functions over documents.text, with SQL where RE2 can express the pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterloom.functions import lines, sequential, text
from letterloom.plans.registry import query, table
from letterloom.sources.io import spread

WS = text.WS


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def sql_norm(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda x: x <> '')"


def sql_lines(x: str) -> str:
    brk = text.LINE_BREAK
    return f"regexp_split_to_array(regexp_replace(coalesce({x}, ''), {q(brk + chr(92) + 'z')}, ''), {q(brk)})"


def scalar(name, column, sql=None):
    """Register a query with doc_id and one column named value."""
    query(name, None if sql is None else f"SELECT doc_id, {sql} AS value FROM documents")(
        lambda spark, d: table(spark, d, "documents").select("doc_id", column().alias("value"))
    )


MARK = q(text.ANY_MARKER)
FULL_MARK = q(f"^{text.ANY_MARKER}$")
N_TOKENS = f"len({sql_tokens('text')})"
N_CONTENT = f"len(list_filter({sql_tokens('text')}, lambda x: NOT regexp_matches(x, {FULL_MARK})))"
RATIO = f"CASE WHEN {N_TOKENS} > 0 THEN {N_CONTENT} / CAST({N_TOKENS} AS DOUBLE) ELSE 0.0 END"

scalar("norm_space", lambda: text.norm_space(F.col("text")), sql_norm("text"))
scalar("marker_ratio", lambda: F.round(text.marker_ratio(F.col("text")), 6), f"round(CASE WHEN {N_TOKENS} > 0 THEN len(regexp_extract_all(text, {MARK})) / CAST({N_TOKENS} AS DOUBLE) ELSE 0.0 END, 6)")
scalar(
    "preprocess_text",
    lambda: text.preprocess_text(F.col("text")),
    sql_strip(f"regexp_replace(regexp_replace(regexp_replace(text, '[-=_*]{{5,}}', '—', 'g'), {q('[.' + WS[1:] + '{5,}')}, ' ', 'g'), {q(WS + '{2,}')}, ' ', 'g')"),
)
_marks = "text"
for _m in (",", ".", "!", "?"):
    _marks = f"regexp_replace({_marks}, '[{_m}]{{3,}}', '{_m}', 'g')"
scalar(
    "clean_aug_result",
    lambda: text.clean_aug_result(F.col("text")),
    sql_strip(f"regexp_replace(regexp_replace(regexp_replace({_marks}, {q(WS + '+')}, ' ', 'g'), ' +,', ',', 'g'), ', *', ', ', 'g')"),
)
_lower = "lower(text)"
SQL_COMPARE = f"regexp_replace(regexp_replace({sql_strip(_lower)}, {q(WS + '+')}, ' ', 'g'), {q('[^' + text.WORD[1:-1] + WS[1:])}, '', 'g')"
scalar("normalize_compare", lambda: text.normalize_compare(F.col("text")), SQL_COMPARE)
_typo = f"translate(text, {q(text.TYPOGRAPHY_FROM)}, {q(text.TYPOGRAPHY_TO)})"
scalar("normalize_typography", lambda: text.normalize_typography(F.col("text")), sql_norm(_typo))
SQL_WORDS = f"list_filter(string_split(regexp_replace(lower(text), {q(text.NON_WORD + '+')}, ' ', 'g'), ' '), lambda x: x <> '')"
scalar("simple_tokens", lambda: F.array_join(text.simple_tokens(F.col("text")), " "), f"array_to_string({SQL_WORDS}, ' ')")
_names = "|".join(text.DROPPED_PLACEHOLDERS)
scalar("drop_placeholders", lambda: text.drop_placeholders(F.col("text")), rf"regexp_replace(text, '(?i)\[(?:{_names})\]', ' ', 'g')")
scalar("text_cut", lambda: F.substring(F.col("text"), 1, 2000), "substring(text, 1, 2000)")
scalar("dedup_key", lambda: text.dedup_key(F.col("lang"), F.col("text")), f"lang || '|||' || lower({sql_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})")
_stops = f"regexp_replace(text, {q('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g')"
SQL_SENTENCES = f"list_filter(list_transform(string_split({_stops}, chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '')"
scalar("split_sentences", lambda: F.array_join(text.split_sentences(F.col("text")), "\n|"), f"array_to_string({SQL_SENTENCES}, chr(10) || '|')")
scalar("first_n_sentences", lambda: text.first_n_sentences(F.col("text"), 3), f"CASE WHEN len({SQL_SENTENCES}) > 0 THEN array_to_string(list_slice({SQL_SENTENCES}, 1, 3), ' ') ELSE text END")
_start = f"(doc_id * 31 % greatest(1, len({SQL_SENTENCES}) - 2))"
scalar(
    "window_sentences",
    lambda: text.window_sentences(F.col("text"), 3, F.col("doc_id") * 31),
    f"CASE WHEN len({SQL_SENTENCES}) = 0 THEN text WHEN len({SQL_SENTENCES}) <= 3 THEN array_to_string({SQL_SENTENCES}, ' ') "
    f"ELSE array_to_string(list_slice({SQL_SENTENCES}, {_start} + 1, {_start} + 3), ' ') END",
)
_bare = f"list_filter(string_split(regexp_replace(text, {q(text.NON_WORD + '+')}, ' ', 'g'), ' '), lambda x: x <> '')"
_kept = f"list_filter({_bare}, lambda w, i: lower(w) IN ('не', 'ни') OR (doc_id + i - 1) * 2654435761 % 4294967296 % 100 >= 15)"
scalar("drop_words", lambda: text.drop_words(F.col("text"), 15, F.col("doc_id")), f"CASE WHEN len({_bare}) < 5 THEN text WHEN len({_kept}) = 0 THEN array_to_string({_bare}, ' ') ELSE array_to_string({_kept}, ' ') END")
_letters, _digits, _upper = (f"len(regexp_extract_all(text, '{p}'))" for p in (r"\p{L}", r"\p{Nd}", r"\p{Lu}"))
scalar(
    "formality_gate",
    lambda: text.formality_gate(F.col("text")),
    f"{_letters} >= 80 AND regexp_matches(text, {q('|'.join(text.FORMAL_WORDS))}) AND ({_digits} > {_letters} * 0.35 OR {_upper} > {_letters} * 0.55)",
)
scalar(
    "drop_latin_short_lines",
    lambda: text.drop_latin_short_lines(F.col("text")),
    f"array_to_string(list_filter(list_transform({sql_lines('text')}, lambda x: {sql_strip('x')}), lambda x: x <> '' AND (regexp_matches(x, '[А-Яа-я]') OR length(x) > 40)), ' ')",
)
SQL_MASKED = (
    f"array_to_string(list_transform(regexp_split_to_array(text, {q(text.PLACEHOLDER)}), "
    "lambda x, i: CASE WHEN i = 1 THEN x ELSE '<PH_' || CAST(i - 2 AS VARCHAR) || '>' || x END), '')"
)
scalar("mask_placeholders", lambda: text.mask_placeholders(F.col("text")), SQL_MASKED)
# masks that a text holds from the start are damaged ones for the way back and are left to the unit tests
_tidy = rf"regexp_replace(regexp_replace(regexp_replace(text, '[Pp][Hh][_\-\s]*\d+', '', 'g'), {q(WS + '+')}, ' ', 'g'), ' +([,.;:!?])', '\1', 'g')"
query("unmask_roundtrip", f"SELECT doc_id, {sql_strip(_tidy)} AS value FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[Pp][Hh][_ -]?[0-9]')")(
    lambda spark, d: table(spark, d, "documents")
    .filter(F.col("text").isNotNull() & ~F.col("text").rlike("[Pp][Hh][_ -]?[0-9]"))
    .select("doc_id", text.unmask_placeholders(text.mask_placeholders(F.col("text")), text.placeholders(F.col("text"))).alias("value"))
)

_flags = f"list_transform({sql_lines('text')}, lambda x: regexp_matches(x, {q('(?i)^' + WS + '*' + text.LIST_ITEM)}))"
_runs3 = " OR ".join("(" + " AND ".join(f"coalesce(f[i{s:+d}], false)" if s else "f[i]" for s in range(a, a + 3)) + ")" for a in (-2, -1, 0))
query(
    "remove_lists",
    f"SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: NOT ({_runs3.replace('f[i-2]', 'CASE WHEN i > 2 THEN f[i-2] END').replace('f[i-1]', 'CASE WHEN i > 1 THEN f[i-1] END')})), chr(10)), '') AS value "
    f"FROM (SELECT doc_id, {sql_lines('text')} AS l, {_flags} AS f FROM documents)",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", lines.remove_lists(F.col("text")).alias("value")))

_n = f"len({sql_tokens('x')})"
_tables = f"list_transform({sql_lines('text')}, lambda x: {_n} > 0 AND len(regexp_extract_all(x, {MARK})) / CAST({_n} AS DOUBLE) >= 0.4)"
query(
    "remove_marker_tables",
    "SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN f[i] AND (coalesce(CASE WHEN i > 1 THEN f[i - 1] END, false) OR coalesce(f[i + 1], false)) "
    "THEN CASE WHEN coalesce(CASE WHEN i > 1 THEN f[i - 1] END, false) THEN NULL ELSE '[MARKER_TABLE]' END ELSE x END), lambda x: x IS NOT NULL), chr(10)), '') AS value "
    f"FROM (SELECT doc_id, {sql_lines('text')} AS l, {_tables} AS f FROM documents)",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", lines.remove_marker_tables(F.col("text")).alias("value")))

query(
    "remove_dup_lines",
    "SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: k[i] = '' OR list_position(k, k[i]) = i), chr(10)), '') AS value "
    f"FROM (SELECT doc_id, {sql_lines('text')} AS l, list_transform({sql_lines('text')}, lambda x: {sql_norm('x')}) AS k FROM documents)",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", lines.remove_dup_lines(F.col("text")).alias("value")))

_prev = "coalesce(CASE WHEN i > 1 THEN t[i - 1] END = w, false)"
query(
    "collapse_token_runs",
    f"SELECT doc_id, CASE WHEN len(t) < 3 THEN coalesce(text, '') ELSE array_to_string(list_filter(t, lambda w, i: NOT ({_prev} AND (coalesce(CASE WHEN i > 2 THEN t[i - 2] END = w, false) OR coalesce(t[i + 1] = w, false)))), ' ') END AS value "
    f"FROM (SELECT doc_id, text, {sql_tokens('coalesce(text, chr(32))')} AS t FROM documents)",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", lines.collapse_token_runs(F.col("text")).alias("value")))
query(
    "collapse_marker_runs",
    f"SELECT doc_id, coalesce(array_to_string(list_filter(t, lambda w, i: NOT ({_prev} AND regexp_matches(w, {q('^' + text.KNOWN_MARKER + '$')}))), ' '), '') AS value "
    f"FROM (SELECT doc_id, {sql_tokens('coalesce(text, chr(32))')} AS t FROM documents)",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", lines.collapse_marker_runs(F.col("text")).alias("value")))


@query("content_ratio", f"SELECT doc_id, round({RATIO}, 6) AS ratio, CAST({N_CONTENT} AS INT) AS n_content FROM documents WHERE text IS NOT NULL")
def content_ratio(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.round(text.content_ratio(F.col("text")), 6).alias("ratio"), text.content_tokens(F.col("text")).alias("n_content"))


@query("low_content_filter", f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {sql_strip('text')} <> '' AND {RATIO} >= 0.15 AND {N_CONTENT} >= 5")
def low_content_filter(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull() & (text.strip(F.col("text")) != ""))
    return docs.filter((text.content_ratio(F.col("text")) >= 0.15) & (text.content_tokens(F.col("text")) >= 5)).select("doc_id")


@query("load_nonempty", f"SELECT row_id, {sql_strip('label')} AS label, {sql_strip('text')} AS text FROM train WHERE {sql_strip('text')} <> '' AND {sql_strip('label')} <> ''")
def load_nonempty(spark, d):
    from letterloom.sources.io import nonempty

    return nonempty(table(spark, d, "train"), "hybrid").select("row_id", "label", "text")


_aug = "FROM train_augmented a JOIN train t ON a.train_row_id = t.row_id WHERE a.augmentation_type IS NOT NULL AND a.text IS NOT NULL AND t.text IS NOT NULL"


def _made(spark, d):
    made = table(spark, d, "train_augmented").filter("augmentation_type IS NOT NULL AND text IS NOT NULL")
    source = table(spark, d, "train").filter("text IS NOT NULL").select(F.col("row_id").alias("train_row_id"), F.col("text").alias("source_text"))
    return made.join(source, "train_row_id")


_r = "length(a.text) / CAST(length(t.text) AS DOUBLE)"
_para = f"{_r} >= CASE WHEN length(t.text) < 700 THEN 0.35 WHEN length(t.text) > 1000 THEN 0.45 ELSE 0.5 END AND {_r} <= 1.3"


@query("length_ratio_gate", f"SELECT a.row_id, length(t.text) > 0 AND CASE WHEN a.augmentation_type = 'paraphrase' THEN {_para} ELSE {_r} BETWEEN 0.5 AND 1.3 END AS passes {_aug} AND length(t.text) > 0")
def length_ratio_gate(spark, d):
    gate = lambda kind: text.length_ratio_gate(F.col("source_text"), F.col("text"), kind, 0.5, 1.3)
    passes = F.when(F.col("augmentation_type") == "paraphrase", gate("paraphrase")).otherwise(gate("back_translation"))
    return _made(spark, d).filter(F.length("source_text") > 0).select("row_id", passes.alias("passes"))


def _cmp(c: str) -> str:
    return SQL_COMPARE.replace("lower(text)", f"lower({c}.text)")


@query("identity_gate", f"SELECT a.row_id, {_cmp('a')} = {_cmp('t')} AS same {_aug}")
def identity_gate(spark, d):
    return _made(spark, d).select("row_id", text.identity_gate(F.col("source_text"), F.col("text")).alias("same"))


@query(
    "similarity_gate",
    "SELECT row_id, cosine_sim BETWEEN CASE WHEN augmentation_type = 'paraphrase' THEN 0.75 ELSE 0.8 END AND 0.95 AND max_label_cosine_sim BETWEEN 0.8 AND 0.98 AS passes "
    "FROM train_augmented WHERE augmentation_type IS NOT NULL AND cosine_sim IS NOT NULL AND max_label_cosine_sim IS NOT NULL",
)
def similarity_gate(spark, d):
    rows = table(spark, d, "train_augmented").filter("augmentation_type IS NOT NULL AND cosine_sim IS NOT NULL AND max_label_cosine_sim IS NOT NULL")
    low = F.when(F.col("augmentation_type") == "paraphrase", 0.75).otherwise(0.8)
    return rows.select("row_id", (F.col("cosine_sim").between(low, 0.95) & F.col("max_label_cosine_sim").between(0.8, 0.98)).alias("passes"))


@query("concat_summary", f"SELECT doc_id, text || ' [SEP] ' || CASE WHEN len({SQL_SENTENCES}) > 0 THEN array_to_string(list_slice({SQL_SENTENCES}, 1, 2), ' ') ELSE text END AS value FROM documents")
def concat_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" [SEP] "), text.first_n_sentences(F.col("text"), 2)).alias("value"))


# RE2 knows word borders of ASCII only, so they are spelled out
_KW = "|".join(w.replace(r"\s", WS) for w in text.ATTACHMENT_WORDS)
_CUT = q(f"(?is)^((?:.*?{text.NON_WORD})??)(?:{_KW})(?:{text.NON_WORD}|$)")
_PREFIX = f"regexp_replace(regexp_extract(text, {_CUT}, 1), {q(WS + '+$')}, '')"
scalar(
    "truncate_attachments",
    lambda: text.truncate_attachments(F.col("text")),
    f"CASE WHEN text IS NULL THEN '' WHEN NOT regexp_matches(text, {_CUT}) THEN text WHEN {_PREFIX} = '' THEN '[ATTACHMENTS]' ELSE {_PREFIX} || ' [ATTACHMENTS]' END",
)
_BLOCK = f"(?i)(^|{text.NON_WORD})" + text.TRANSFER_BLOCK.removeprefix(r"\b").removesuffix(r"\b").replace(r"\s", WS) + f"({text.WORD})"
_REQUISITES = f"regexp_replace(regexp_replace(coalesce(text, ''), {q(_BLOCK)}, '\\1 \\2', 'g'), {q('(?i)' + text.FINANCE_DATE.replace(chr(92) + 's', WS))}, ' ', 'g')"
scalar("remove_requisites", lambda: text.remove_requisites(F.col("text")), sql_norm(_REQUISITES))
scalar("compress_points", lambda: text.compress_points(F.col("text")))
scalar("dedup_repeated_tokens", lambda: text.dedup_repeated_tokens(F.col("text")))
scalar("collapse_ngrams", lambda: sequential.collapse_ngrams(F.col("text")))
scalar("remove_chains", lambda: sequential.remove_chains(F.col("text")))
scalar("clean_generated", lambda: sequential.clean_generated(F.col("text")))


@query("greedy_pack")
def greedy_pack(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return docs.select("doc_id", "sentence_no", F.posexplode(sequential.greedy_pack(F.col("sentence"), 20)).alias("piece_no", "piece"))


@query("clean_text")
def clean_text(spark, d):
    return sequential.clean_text(spread(table(spark, d, "documents").select("doc_id", "text"))).drop("text")


@query("clean_text_line_aware")
def clean_text_line_aware(spark, d):
    return sequential.clean_text(spread(table(spark, d, "documents").select("doc_id", "text")), line_aware=True).drop("text")
