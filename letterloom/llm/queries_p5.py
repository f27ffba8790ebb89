"""Queries of problem 5."""

from __future__ import annotations

from letterloom.llm.records import HEADER_NAMES, copies_of_records, record_counts
from letterloom.llm.registry import query, table

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
_HEADER = rf"^[{_SPACE}]*(?:(?:{'|'.join(HEADER_NAMES)})[{_SPACE}]*:[^\n\r;|]*(?:[\n\r;|][{_SPACE}]*|$))*"


def _bare(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[{_SPACE}\p{{P}}]+', '', 'g')"


def _canonical(c: str) -> str:
    header = f"regexp_extract({c}, '{_HEADER}', 0, 'i')"
    fields = rf"list_sort(list_filter(list_transform(regexp_split_to_array({header}, '[\n\r;|]'), lambda x: {_bare('x')}), lambda x: x <> ''))"
    return f"array_to_string({fields}, chr(1)) || chr(2) || " + _bare(f"substring({c}, length({header}) + 1)")


_SQL = (
    rf"WITH r AS (SELECT row_id, {_canonical('text')} AS t, CASE WHEN label IS NULL OR regexp_full_match(label, '[{_SPACE}]*') THEN chr(3) ELSE {_canonical('label')} END AS l FROM original_data WHERE regexp_matches(text, '[\p{{L}}\p{{N}}\p{{S}}]')), "
    "k AS (SELECT row_id, least(t, l) || chr(4) || greatest(t, l) AS k FROM r), g AS (SELECT k, min(row_id) AS first_id, count(*) AS copies FROM k GROUP BY k) "
)


@query("p5_found", _SQL + "SELECT first_id, row_id AS copy_id FROM k JOIN g USING (k) WHERE row_id <> first_id")
def p5_found(spark, d):
    rows = table(spark, d, "original_data")
    return copies_of_records(rows, "row_id", "text", "label", "loaded_at").select("first_id", "copy_id")


@query("p5_records", _SQL + "SELECT first_id, copies FROM g")
def p5_records(spark, d):
    return record_counts(table(spark, d, "original_data"), "row_id", "text", "label", "loaded_at")
