"""Runs of lines and words, by comparing each element with its neighbours in the array: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions.text import KNOWN_MARKER, LIST_ITEM, WS, let, marker_ratio, norm_space, split_lines, tokens


def _at(flags: Column, i: Column, step: int) -> Column:
    return F.coalesce(F.when(i + step >= 0, F.get(flags, i + step)), F.lit(False))


def in_run(flags: Column, i: Column, least: int) -> Column:
    """Whether element i is true and in a run of at least `least` true elements (2 or 3)."""
    near = {s: _at(flags, i, s) for s in range(1 - least, least)}
    runs = [F.lit(True)]
    any_window = None
    for start in range(1 - least, 1):
        window = runs[0]
        for s in range(start, start + least):
            window = window & near[s]
        any_window = window if any_window is None else any_window | window
    return any_window


def remove_lists(c: Column, least: int = 3) -> Column:
    """Runs of at least three lines that look like list items go."""

    def kept(lines: Column) -> Column:
        item = F.transform(lines, lambda x: x.rlike(f"(?iuU)^{WS}*{LIST_ITEM}"))
        return let(item, lambda f: F.array_join(F.filter(lines, lambda x, i: ~in_run(f, i, least)), "\n"))

    return let(split_lines(c), kept)


def remove_marker_tables(c: Column, ratio: float = 0.4, least: int = 2) -> Column:
    """Runs of at least two lines that consist of markers for the most part become one marker."""

    def replaced(lines: Column, f: Column) -> Column:
        inside = lambda i: in_run(f, i, least)
        each = F.transform(lines, lambda x, i: F.when(~inside(i), x).when(_at(f, i, -1), F.lit(None)).otherwise(F.lit("[MARKER_TABLE]")))
        return F.array_join(F.filter(each, lambda x: x.isNotNull()), "\n")

    flags = lambda lines: F.transform(lines, lambda x: marker_ratio(x) >= ratio)
    return let(split_lines(c), lambda lines: let(flags(lines), lambda f: replaced(lines, f)))


def remove_dup_lines(c: Column) -> Column:
    """Lines that stood before go, compared without differences in white space; blank lines stay."""
    first = lambda keys, i: (F.get(keys, i) == "") | (F.array_position(keys, F.get(keys, i)) == i + 1)
    kept = lambda lines, keys: F.array_join(F.filter(lines, lambda x, i: first(keys, i)), "\n")
    return let(split_lines(c), lambda lines: let(F.transform(lines, norm_space), lambda keys: kept(lines, keys)))


def _without(words: Column, drop: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.filter(words, lambda w, i: ~drop(w, i)), " ")


def _same(words: Column, w: Column, i: Column, step: int) -> Column:
    return F.coalesce(F.when(i + step >= 0, F.get(words, i + step) == w), F.lit(False))


def collapse_token_runs(c: Column) -> Column:
    """Runs of at least three equal words become one; texts of fewer than three words stay as they are."""
    whole = F.coalesce(c, F.lit(""))
    drop = lambda t: lambda w, i: _same(t, w, i, -1) & (_same(t, w, i, -2) | _same(t, w, i, 1))
    return let(tokens(whole), lambda t: F.when(F.size(t) < 3, whole).otherwise(_without(t, drop(t))))


def collapse_marker_runs(c: Column) -> Column:
    """Runs of one known marker become one."""
    drop = lambda t: lambda w, i: _same(t, w, i, -1) & w.rlike(f"^{KNOWN_MARKER}$")
    return let(tokens(F.coalesce(c, F.lit(""))), lambda t: _without(t, drop(t)))
