"""String functions against expected values worked out by hand, and against slow obvious versions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterloom.functions import chunks, lines, sequential, text


def run(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


CASES = [
    (lines.collapse_token_runs, "a a a b", "a b"),
    (lines.collapse_token_runs, "a a b", "a a b"),
    (lines.collapse_token_runs, "a  a", "a  a"),
    (lines.collapse_marker_runs, "[PERSON] [PERSON] x", "[PERSON] x"),
    (lines.collapse_marker_runs, "[FOO] [FOO] x", "[FOO] [FOO] x"),
    (lines.remove_lists, "x\n1. a\n2. b\n3. c\ny", "x\ny"),
    (lines.remove_lists, "x\n1. a\n2. b\ny", "x\n1. a\n2. b\ny"),
    (lines.remove_marker_tables, "[ID] [DATE]\n[ID] [DATE]\nx", "[MARKER_TABLE]\nx"),
    (lines.remove_dup_lines, "a\n\na\n\nb", "a\n\n\nb"),
    (text.truncate_attachments, "Приложение: x", "[ATTACHMENTS]"),
    (text.truncate_attachments, "Текст. Приложение 1", "Текст. [ATTACHMENTS]"),
    (text.compress_points, "а именно следующие точки: 1. a 2. b Кроме того, c", "а именно следующие точки: [POINTS_LIST] Кроме того, c"),
    (text.compress_points, "а именно следующие точки: нет", "а именно следующие точки: нет"),
    (text.remove_requisites, "a УПД № [DOCUMENT_NUMBER]/1 от [DATE] b", "a УПД № [DOCUMENT_NUMBER]/1 от [DATE] b"),
    (text.remove_requisites, "a [FINANCIAL_DATA] [DATE] b", "a b"),
    (text.mask_placeholders, "от [DATE] к [ORG]", "от <PH_0> к <PH_1>"),
    (text.drop_latin_short_lines, "Привет\nabc", "Привет"),
    (text.dedup_repeated_tokens, "Исполнитель: Исполнитель: x", "Исполнитель: x"),
    (text.normalize_typography, "Ёлка «а» – б", 'Елка "а" - б'),
    (text.preprocess_text, "a ------ b.....c", "a — b c"),
    (text.clean_aug_result, "a ,b!!!  c", "a, b! c"),
    (text.norm_space, " a \t b\x1c", "a b"),
    (text.drop_placeholders, "[person] x", "  x"),
]


@pytest.mark.parametrize("fn,value,expected", CASES)
def test_cases(spark, fn, value, expected):
    assert run(spark, fn, value) == [expected]


def test_unmask(spark):
    fn = lambda c: text.unmask_placeholders(text.mask_placeholders(c), text.placeholders(c))
    assert run(spark, fn, "от [DATE] к [ORG] .", "без", "x [A] <PH_9> y") == ["от [DATE] к [ORG].", "без", "x [A] y"]


def test_ratio_and_nulls(spark):
    assert run(spark, text.content_ratio, "[ID] a", "") == [0.5, 0.0]
    for fn in (lines.remove_lists, lines.collapse_token_runs, text.compress_points, text.truncate_attachments):
        assert run(spark, fn, None) == [""]


def slow_grams(words):
    for _ in range(6):
        out, i, changed = [], 0, False
        while i < len(words):
            hit = None
            for n in (5, 4, 3, 2):
                r = 1
                while words[i : i + n] == words[i + r * n : i + (r + 1) * n] and len(words[i : i + n]) == n:
                    r += 1
                if r > 1:
                    hit = (n, r)
                    break
            out += words[i : i + hit[0]] if hit else [words[i]]
            i += hit[0] * hit[1] if hit else 1
            changed |= bool(hit)
        words = out
        if not changed:
            break
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=4, max_size=30))
def test_grams_against_slow(words):
    assert sequential.collapse_ngrams_py(" ".join(words)) == " ".join(slow_grams(words))


def test_chains():
    words = [str(i) for i in range(8)]
    assert sequential.remove_chains_py(" ".join(words * 2)) == " ".join(words)
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 6))]
        w = w + words * rng.randint(1, 3) + w
        got = sequential.remove_chains_py(" ".join(w)).split()
        assert not any(got[i : i + k] == got[i + k : i + 2 * k] for k in range(8, len(got) // 2 + 1) for i in range(len(got) - 2 * k + 1))


@pytest.mark.parametrize("n,expected", [(0, 0), (5, 1), (448, 1), (449, 3), (768, 3), (769, 4)])
def test_chunk_numbers(spark, n, expected):
    value = " ".join(f"w{i}" for i in range(n))
    got = run(spark, lambda c: F.transform(chunks.chunk_tokens(text.tokens(c)), lambda x: F.size(x)), value)[0]
    assert len(got) == expected
    if n == 449:
        assert got == [448, 129, 448]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab ,;:-.", max_size=200), st.integers(1, 6))
def test_greedy_pack_keeps_words(sentence, most):
    pieces = sequential.greedy_pack_py(sentence, most)
    assert all(len(p.split()) <= most for p in pieces)
    assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", sentence)


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "Текст  текст2\nтекст2 текст2. Приложение 1"), (2, None)], "doc_id int, text string")
    got = dict(sequential.clean_text(df).select("doc_id", "value").collect())
    assert got == {1: "Текст текст2 текст2 текст2. [ATTACHMENTS]", 2: ""}


def test_chains_are_looked_for_at_every_length_they_can_have():
    import random
    import time

    import numpy as np

    from letterloom.functions import sequential

    rng = random.Random(12)
    for _ in range(300):
        words = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        part = [rng.randint(0, 9) for _ in range(rng.randint(6, 14))]
        ids = np.array(words + part * rng.randint(1, 3) + words[::-1] + part, np.int64)
        want = {k for k in range(sequential.SHORTEST_CHAIN, len(ids) // 2 + 1) if (sequential._equal_from(ids, k) >= k).any()}
        assert want <= set(sequential._chain_lags(ids))
    long = np.arange(60_000) % 50_000
    began = time.perf_counter()
    assert sequential._kept_after_chains(long).all() and time.perf_counter() - began < 5
