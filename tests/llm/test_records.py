"""Records, proportions and neighbours on small tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterloom.llm import neighbours, proportions, records
from letterloom.llm.common import join_by_hot_key, scratch


def found(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string").withColumn("loaded_at", F.expr("timestamp_seconds(row_id)")).withColumn("key", F.lit(1))
    got = records.copies_of_records(df, "row_id", "text", "label", "loaded_at").collect()
    return {(r["first_id"], r["copy_id"]) for r in got}


def test_same_records(spark):
    rows = [
        (1, "Исх: № 1; Тема: о ходе; Просим дать ответ.", "Отдел А"),
        (2, "ТЕМА:О ХОДЕ\nИСХ : № 1\nпросим  дать ответ", "отдел «а»"),
        (3, "Отдел А", "Исх: № 1 | Тема: о ходе | Просим дать ответ!"),
        (4, "Исх: № 1; Тема: о ходе; Просим дать ответ.", None),
        (5, "Исх: № 1; Тема: о ходе; Просим дать ответ.", " "),
        (6, "Исх: № 2; Тема: о ходе; Просим дать ответ.", "Отдел А"),
        (7, "Ёлка", "x"), (8, "Елка", "x"), (9, None, "x"), (10, None, "x"), (11, "...", "x"), (12, "!", "x"), (13, "", None), (14, "", None),
        (15, "а. б.", "x"), (16, "б. а.", "x"), (17, "№", "x"), (18, " № ", "x"),
    ]
    assert found(spark, rows) == {(1, 2), (1, 3), (4, 5), (17, 18)}


def test_long_and_hot(spark):
    header = "От: x; " * 20_000
    rows = [(1, header + "конец", "l"), (2, header + "КОНЕЦ", "l")] + [(i, "Повтор!", "l") for i in range(10, 400)]
    got = found(spark, rows)
    assert (1, 2) in got and len(got) == 1 + 389


def test_empty(spark):
    assert found(spark, []) == set()


def test_ledger_grows_by_batches(spark):
    ledger = records.RecordLedger(spark, f"{scratch(spark)}/ledger-test", buckets=4)
    batch = lambda rows: spark.createDataFrame([(i, bytearray(k)) for i, k in rows], "row_id bigint, key binary")
    ledger.add(batch([(5, b"a"), (6, b"b")]))
    ledger.add(batch([]))
    ledger = records.RecordLedger(spark, ledger.path, buckets=4)  # as a later run would open it
    ledger.add(batch([(2, b"a"), (9, b"c"), (8, b"c")]))
    assert {bytes(r["key"]): (r["copies"], r["first_id"]) for r in ledger.rows().collect()} == {b"a": (2, 2), b"b": (1, 6), b"c": (2, 8)}


def test_join_by_hot_key(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_by_hot_key(rows, groups, "k", "n", 3000).count() == 3000


TARGETS = [("А", 0.5, 2), ("Б", 0.3, 2), ("В", 0.1, 5), ("Г", 0.1, 0)]


def drawn(spark, rows, fraction=0.2):
    df = spark.createDataFrame(rows, "row_id bigint, label string, text string")
    targets = spark.createDataFrame(TARGETS, "label string, target_share double, min_rows int")
    return proportions.ProportionalSample(df, "row_id", "label", "text", targets, fraction)


def test_proportions(spark):
    rows = [(i, "а " if i % 2 else "Б!", "т" * (100 + i)) for i in range(1000)] + [(2000 + i, "в", None) for i in range(4)] + [(3000 + i, None, "x") for i in range(10)]
    sample = drawn(spark, rows)
    report = {r["label"]: r for r in sample.report().collect()}
    assert {k for k, r in report.items() if r["short"]} == {"В", "Г"}
    got = {r["label"]: r["count"] for r in sample.sample().groupBy("label").count().collect()}
    assert got == {k: r["drawn"] for k, r in report.items() if r["drawn"]}
    assert abs(got["А"] - 0.5 * sample.size) <= 1 and got["В"] == 4
    assert sample.sample().distinct().count() == sum(got.values())
    assert sorted(drawn(spark, rows).sample().collect()) == sorted(sample.sample().collect())


def test_proportions_empty(spark):
    sample = drawn(spark, [])
    assert sample.sample().count() == 0
    assert {r["label"] for r in sample.report().filter("short").collect()} == {"А", "Б", "В"}


def test_rake_meets_both_margins():
    counts = np.array([[50, 50], [80, 20]])
    got = proportions.rake(counts, [np.array([20.0, 10.0]), np.array([12.0, 18.0])])
    assert np.allclose(got.sum(1), [20, 10], atol=1e-6) and np.allclose(got.sum(0), [12, 18], atol=1e-6)


def vectors(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32))
    for i in range(0, n // 3):
        x[i] = x[i % 20] + 0.15 * rng.standard_normal(32)
    return x.astype(np.float32)


def brute(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(x)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}


def test_nearest_recall(spark):
    x = vectors()
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "row_id bigint, vec array<float>, unit int")
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, "row_id", "vec", 5, 0.85, leaf_rows=100).collect()}
    want = brute(x, ids, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want)
    assert all((a, b) in want for a, b in got) or len(got - want) <= 0.02 * len(want)


def test_nearest_without_floor(spark):
    x = vectors(200)
    ids = list(range(200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "row_id bigint, vec array<float>")
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, "row_id", "vec", 3).collect()}
    want = brute(x, ids, 3, -1)
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_of_queries(spark):
    x = vectors(200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<float>")
    got = {(r["id"], r["other"]) for r in neighbours.nearest_of_queries(df, df.filter("row_id % 10 = 0"), "row_id", "vec", 3, block_rows=7).collect()}
    assert got == {p for p in brute(x, list(range(200)), 3, -1) if p[0] % 10 == 0}


def test_unusable_and_equal_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [float("inf"), 1.0])]
    rows += [(i, [1.0, 0.0]) for i in range(10, 20)] + [(30, [2.0, 0.001]), (31, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<float>")
    got = neighbours.nearest(df, "row_id", "vec", 5, 0.85).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["other"])
    assert sorted(by) == [*range(10, 20), 30]
    assert sorted(by[10]) == [11, 12, 13, 14, 15] and sorted(by[19]) == [10, 11, 12, 13, 14] and sorted(by[30]) == [10, 11, 12, 13, 14]
    assert neighbours.nearest(df.limit(0), "row_id", "vec").count() == 0
    assert neighbours.nearest(df.filter("row_id < 6"), "row_id", "vec").count() == 0


@pytest.mark.parametrize("m", [4, 8, 20])
def test_chi_square(m):
    x = (np.random.default_rng(0).standard_normal((200_000, m)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.99):
        assert abs(neighbours.chi_square_quantile(p, m) / np.quantile(x, p) - 1) < 0.03


def test_nearest_keeps_recall_in_deep_trees(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(512, 64)), 4, 0) + 0.3 * rng.normal(size=(2048, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(v)) for j in np.argsort(-cos[i])[:3] if cos[i, j] >= 0.8}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    found = neighbours.nearest(df, "id", "v", k=3, least_cosine=0.8, leaf_rows=8).collect()  # eight levels
    assert len(want & {(r["id"], r["other"]) for r in found}) >= 0.95 * len(want)


def keyed(spark, rows):
    return spark.createDataFrame([(i, bytearray(k)) for i, k in rows], "row_id bigint, key binary")


def test_ledger_rewrites_only_touched_buckets_and_takes_a_batch_once(spark):
    ledger = records.RecordLedger(spark, f"{scratch(spark)}/ledger-touched", buckets=8)
    ledger.add(keyed(spark, [(i, b"k%d" % i) for i in range(200)]), "first")
    before = dict(ledger.version)
    assert len(before) == 8
    ledger.add(keyed(spark, [(1000, b"k7")]), "second")
    assert sum(ledger.version[b] != before[b] for b in before) == 1
    again = records.RecordLedger(spark, ledger.path)
    again.add(keyed(spark, [(1000, b"k7")]), "second")  # the same batch, after a restart
    assert again.version == ledger.version and again.buckets == 8
    got = {bytes(r["key"]): (r["copies"], r["first_id"]) for r in again.rows().collect()}
    assert len(got) == 200 and got[b"k7"] == (2, 7) and sum(n for n, _ in got.values()) == 201


def test_ledger_survives_a_failed_batch(spark, monkeypatch):
    ledger = records.RecordLedger(spark, f"{scratch(spark)}/ledger-failed", buckets=4)
    ledger.add(keyed(spark, [(1, b"a"), (2, b"a")]), "first")
    monkeypatch.setattr(records.RecordLedger, "_save", lambda self, state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.add(keyed(spark, [(3, b"a"), (4, b"b")]), "second")
    monkeypatch.undo()
    for l in (ledger, records.RecordLedger(spark, ledger.path)):
        assert [(r["copies"], r["first_id"]) for r in l.rows().collect()] == [(2, 1)]
    ledger.add(keyed(spark, [(3, b"a"), (4, b"b")]), "second")
    assert {(r["copies"], r["first_id"]) for r in ledger.rows().collect()} == {(3, 1), (1, 4)}


def test_ledger_buckets_grow_with_the_keys(spark):
    ledger = records.RecordLedger(spark, f"{scratch(spark)}/ledger-growing", buckets=2, keys_a_bucket=50)
    for n in range(4):
        ledger.add(keyed(spark, [(i, b"k%d" % i) for i in range(n * 100, n * 100 + 150)]))
    assert ledger.buckets == 16 and len(ledger.version) == 16
    got = {bytes(r["key"]): r["copies"] for r in records.RecordLedger(spark, ledger.path).rows().collect()}
    assert len(got) == 450 and sum(got.values()) == 600


def test_short_labels_follow_from_the_sample(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        sizes = rng.integers(1, 60, 12)
        rows = [(1000 * k + i, f"l{k}", None if rng.random() < 0.3 else "т" * int(rng.integers(1, 2000))) for k, n in enumerate(sizes) for i in range(n)]
        share, least = rng.dirichlet(np.ones(12) * 2), rng.integers(0, 20, 12)
        targets = spark.createDataFrame([(f"L{k}", float(s), int(m)) for k, (s, m) in enumerate(zip(share, least))], "label string, target_share double, min_rows int")
        df = spark.createDataFrame(rows, "row_id bigint, label string, text string")
        sample = proportions.ProportionalSample(df, "row_id", "label", "text", targets)
        n = len(rows) / 5
        want = {f"L{k}" for k in range(12) if sizes[k] < share[k] * n or sizes[k] < least[k]}
        assert {r["label"] for r in sample.report().filter("short").collect()} == want


def test_second_margin_prefers_texts(spark):
    rows = [(i, "а" if i % 2 else "Б", None if i % 4 < 2 else "т" * 300) for i in range(1000)]
    sample = drawn(spark, rows)
    texts = {r[0]: r[2] for r in rows}
    assert all(texts[r["id"]] is not None for r in sample.sample().collect())


def test_half_precision_decides_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(128)
    base /= np.linalg.norm(base)
    rows = []
    for i in range(400):  # cosines with the first within a thousandth of the bound, the greatest a little apart
        side = rng.standard_normal(128)
        side -= side @ base * base
        side /= np.linalg.norm(side)
        c = 0.85 + (i - 200) * 5e-6 + max(0, i - 392) * 3e-4
        rows.append(c * base + (1 - c * c) ** 0.5 * side)
    x = np.array([base, *rows]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    u = u.astype(np.float32).astype(np.float64)
    cos = u[1:] @ u[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<float>")
    got = {r["id"] for r in neighbours.nearest(df, "row_id", "vec", 5, 0.85).collect() if r["other"] == 0}
    assert got == {i + 1 for i in np.flatnonzero(cos >= 0.85)}
    best = [r["other"] for r in neighbours.nearest(df, "row_id", "vec", 5, 0.85).collect() if r["id"] == 0]
    assert set(best) == {int(i) + 1 for i in np.argsort(-cos)[:5]}
