"""Clusters, overlaps and subjects on small tables, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from letterloom.llm import clusters, hierarchy, overlaps, spanning, subjects

VOCAB = [f"слово{i}" for i in range(400)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.random()
        if k < 0.4:
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        elif k < 0.7 and len(w) > 1:
            del w[rng.randrange(len(w))]
        else:
            w.insert(rng.randint(0, len(w)), rng.choice(VOCAB))
    return w


def test_edit_distances():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        k = rng.randint(0, 8)
        if a:
            assert overlaps.edit_distances([np.array(a)], [np.array(b)], k)[0] == min(k + 1, edits(a, b))


def test_segments_always_fit():
    for n in range(1, 3000):
        assert (overlaps.most_edits(n) + 1) * overlaps.segment_words(n) <= n


def test_overlaps_against_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 3, 6, 10, 13, 20, 25, 40, 90]))] for _ in range(60)]
    test = [(i, " ".join(w)) for i, w in enumerate(base)]
    train, words = [], []
    for i in range(300):
        w = changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5, 8, 12]))
        if w:
            train.append((1000 + i, " ".join(w).upper() + "."))
            words.append(w)
    want = {(i, t) for i, a in enumerate(base) for (t, _), b in zip(train, words) if edits(a, b) * 100 <= 15 * max(len(a), len(b))}
    extra = [(500, None), (501, ""), (502, "[DATE] [PERSON]."), (503, "...")]
    schema = "row_id bigint, text string"
    got = overlaps.overlaps(spark.createDataFrame(test + extra, schema), spark.createDataFrame(train + [(i + 5000, t) for i, t in extra], schema)).collect()
    assert {(r["test_id"], r["train_id"]) for r in got} == want and len(got) == len(want)


def test_overlaps_empty(spark):
    none = spark.createDataFrame([], "row_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "row_id bigint, text string")
    assert overlaps.overlaps(none, some).count() == 0
    assert overlaps.overlaps(some, none).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (x == y)))
        row = new
    return row[-1]


def test_common_words():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert clusters.common_words(len(a), clusters.places_of(a), b) == lcs(a, b)
        packed = [np.array(x, np.uint32).tobytes() for x in (a, b)]
        distance = clusters._Distances()
        assert {round(distance(*packed), 9), round(distance(*packed[::-1]), 9)} == {round(1 - lcs(a, b) / max(len(a), len(b)), 9)}


def test_clusters(spark):
    rng = random.Random(5)
    rows, want, n = [], set(), 0
    for c, size in enumerate([8, 12, 7, 30]):
        base = [rng.choice(VOCAB) for _ in range(60)]
        ids = []
        for _ in range(size):
            rows.append((n, " ".join(changed(rng, base, rng.randint(0, 6))) + "!"))
            ids.append(n)
            n += 1
        if size >= 8:
            want |= {(ids[0], i) for i in ids[1:]}
    rows += [(n + i, " ".join(rng.choice(VOCAB) for _ in range(50))) for i in range(60)]
    n += 60
    rows += [(n + i, "Одно и то же письмо без всяких изменений должно войти в скопление целиком вместе с копиями сразу" + "!" * (i % 3)) for i in range(9)]
    want |= {(n, n + i) for i in range(1, 9)}
    rows += [(n + 20 + i, "мало слов") for i in range(20)] + [(n + 50, None), (n + 51, ""), (n + 52, " ".join(VOCAB * 40))]
    df = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("row_id", "text", "row_id AS id", "text AS sig")
    members, described = clusters.wording_clusters(df, "row_id", "text")
    got = {(r["first_id"], r["row_id"]) for r in members.filter("row_id <> first_id").collect()}
    assert got == want
    sizes = {r["first_id"]: (r["n_rows"], len(r["exemplars"])) for r in described.collect()}
    assert sorted(s for s, _ in sizes.values()) == [8, 9, 12, 30] and all(1 <= e <= 3 for _, e in sizes.values())


def test_clusters_of_wordings_that_differ_in_numbers(spark):
    # two groups of equal sketches in one cluster: the second is too small to be one alone
    rng = random.Random(11)
    first = [rng.choice(VOCAB) for _ in range(60)]
    second = first[:45] + [rng.choice(VOCAB) for _ in range(15)]
    rows = [(i, " ".join(["письмо", str(1000 + i), *(first if i < 12 else second)])) for i in range(19)]
    members, described = clusters.wording_clusters(spark.createDataFrame(rows, "row_id bigint, text string"), "row_id", "text")
    assert {(r["first_id"], r["row_id"]) for r in members.collect()} == {(0, i) for i in range(19)}
    assert [r["n_rows"] for r in described.collect()] == [19]


def test_clusters_empty(spark):
    members, described = clusters.wording_clusters(spark.createDataFrame([], "row_id bigint, text string"), "row_id", "text")
    assert members.count() == 0 and described.count() == 0


def hierarchy_of(spark, components, joined):
    """components: c -> (n rows, distance at which they part); joined: c -> up for each further level."""
    df = spark.createDataFrame([(c, n, n / d) for c, (n, d) in components.items()], "c bigint, n bigint, rate double")
    maps = [spark.createDataFrame(list(m.items()), "c bigint, up bigint") if m else None for m in joined]
    return dict(hierarchy.chosen_clusters(df, maps, [0.5, 0.625, 0.75], 8).collect())


def test_hierarchy_decides(spark):
    # two dense groups that meet above the first level stay two clusters, what they meet on the way is an outlier
    assert hierarchy_of(spark, {1: (10, 0.1), 2: (9, 0.2), 3: (3, 0.1), 4: (5, 0.1)}, [{1: 1, 2: 1, 3: 1}, None]) == {1: 1, 2: 2}
    # two loose groups that hold together for longer than either alone are one
    assert hierarchy_of(spark, {1: (10, 0.49), 2: (9, 0.49), 3: (3, 0.1)}, [{1: 1, 2: 1, 3: 1}, None]) == {1: 1, 2: 1}
    # one group that only meets small ones goes on; a second level splits it from another
    assert hierarchy_of(spark, {1: (10, 0.2), 2: (3, 0.1), 5: (8, 0.3)}, [{1: 1, 2: 1}, {1: 1, 5: 1}]) == {1: 1, 5: 5}
    # three groups too small alone make one together, which ends where it meets a dense one
    assert hierarchy_of(spark, {1: (3, 0.1), 2: (3, 0.1), 3: (3, 0.1), 4: (20, 0.1)}, [{1: 1, 2: 1, 3: 1}, {1: 1, 4: 1}]) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert hierarchy_of(spark, {1: (7, 0.1)}, [None, None]) == {}


def test_nested_groups_split_and_outliers_are_in_no_cluster(spark):
    """Two dense groups and some letters share a frame of two fifths of their words; all of it at the default epsilon."""
    rng = random.Random(13)
    frame = [rng.choice(VOCAB) for _ in range(40)]
    bodies = [[f"{side}{i}" for i in range(60)] for side in "аб"]
    rows = [(i, " ".join(changed(rng, frame + bodies[i % 2], 3))) for i in range(24)]
    rows += [(100 + i, " ".join(frame + [f"прочее{i}слово{j}" for j in range(60)])) for i in range(9)]
    members, described = clusters.wording_clusters(spark.createDataFrame(rows, "row_id bigint, text string"), "row_id", "text")
    assert {(r["first_id"], r["row_id"]) for r in members.collect()} == {(i % 2, i) for i in range(24)}
    assert sorted(r["n_rows"] for r in described.collect()) == [12, 12]


def test_a_chain_is_no_cluster_beyond_half_of_the_words(spark):
    words = [f"слово{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)]
    members, described = clusters.wording_clusters(spark.createDataFrame(rows, "row_id bigint, text string"), "row_id", "text")
    texts = {i: t.split() for i, t in rows}
    heads = {r["first_id"]: r["exemplars"][0] for r in described.collect()}
    got = members.collect()
    assert got and all(2 * lcs(texts[r["row_id"]], texts[heads[r["first_id"]]]) > 60 for r in got)


def test_links_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    base = [[rng.choice(VOCAB) for _ in range(40)] for _ in range(30)]
    texts = [(i, " ".join(changed(rng, rng.choice(base), rng.randint(0, 3)))) for i in range(300)]
    reps = clusters.wordings(spark.createDataFrame(texts, "row_id bigint, text string"), "row_id", "text", 15).selectExpr("row_id AS id", "sketch")
    got = []
    for n in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got.append({tuple(r) for r in clusters.links(reps).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert got[0] == got[1] == got[2] and len(got[0]) > 500


def of_one_band(n):
    """Wordings with equal sketches in n groups of 8; only those of a group have more than half of their words in common."""
    rng = random.Random(17)
    frame = ["".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(30)]
    return [(k * n + g, " ".join([*frame, *(str(100 * g + i + 10_000) for i in range(40)), str(k)])) for k in range(8) for g in range(n)]


def test_clusters_whose_members_are_not_next_in_their_band(spark):
    df = spark.createDataFrame(of_one_band(20), "row_id bigint, text string")
    members, described = clusters.wording_clusters(df, "row_id", "text")
    assert {(r["first_id"], r["row_id"]) for r in members.collect()} == {(g, k * 20 + g) for k in range(8) for g in range(20)}
    assert [r["n_rows"] for r in described.collect()] == [8] * 20


@pytest.mark.parametrize("block", [1024, 7])
def test_every_pair_of_a_band_is_measured(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(19)
    base = [[rng.choice(VOCAB) for _ in range(rng.choice([20, 70, 300]))] for _ in range(8)]
    texts = of_one_band(4) + [(1000 + i, " ".join(changed(rng, rng.choice(base), rng.randint(0, 12)))) for i in range(60)]
    rows = clusters.wordings(spark.createDataFrame(texts, "row_id bigint, text string"), "row_id", "text", 15)
    reps, words = rows.selectExpr("row_id AS id", "sketch"), rows.selectExpr("row_id AS id", "words")
    sketches = {r["id"]: np.frombuffer(r["sketch"], np.uint16).reshape(-1, clusters.BAND) for r in reps.collect()}
    shared = {(a, b) for a, b in combinations(sorted(sketches), 2) if (sketches[a] == sketches[b]).all(1).any()}
    got = [tuple(r) for r in clusters.links(reps).collect()]
    assert set(got) == shared and len(got) == len(shared) > 500
    split = {i: t.split() for i, t in texts}
    want = {(a, b): d for a, b in shared if (d := 1 - lcs(split[a], split[b]) / max(len(split[a]), len(split[b]))) < 0.7}
    # with 4 samples all of them stay
    assert {(r["a"], r["b"]): r["d"] for r in clusters.near_links(reps, words, 0.7, 4).collect()} == want
    some = {(r["a"], r["b"]): r["d"] for r in clusters.near_links(reps, words, 0.7, 3).collect()}
    assert some.items() <= want.items() and len(some) < len(want)

    def hierarchy_by(edges):
        """Core distances and the weights at which components merge."""
        near = {}
        for (a, b), d in edges.items():
            near.setdefault(a, []).append(d)
            near.setdefault(b, []).append(d)
        core = {i: sorted([*x, 1.0])[1] if len(x) > 1 else 1.0 for i, x in near.items()}
        top, merged = {i: i for i in near}, {}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for w, a, b in sorted((max(d, core[a], core[b]), a, b) for (a, b), d in edges.items()):
            if find(a) != find(b):
                top[find(a)] = find(b)
                merged.setdefault(w, []).append((a, b))
            sets = {}
            for i in near:
                sets.setdefault(find(i), set()).add(i)
            merged[w, "sets"] = frozenset(map(frozenset, sets.values()))
        return core, {w[0]: s for w, s in merged.items() if isinstance(w, tuple)}

    (core, sets), (all_core, all_sets) = hierarchy_by(some), hierarchy_by(want)
    assert core == all_core
    at = lambda levels, w: next((levels[x] for x in sorted(levels, reverse=True) if x <= w), None)
    assert all(at(sets, w) == s for w, s in all_sets.items())


def test_spanning_forest(spark):
    rng = random.Random(9)
    edges = {}
    for _ in range(400):
        x, y = sorted(rng.sample(range(150), 2))
        edges[x, y] = round(rng.random(), 1)
    table = spark.createDataFrame([(x, y, w) for (x, y), w in edges.items()], "a bigint, b bigint, w double")
    forest, joined = spanning.spanning_levels(table, [0.25, 0.45, 0.48, 1.1])
    assert joined[2] is None
    at = {i: i for i in range(150)}
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = count = 0
    todo = sorted(edges.items(), key=lambda e: (e[1], e[0]))
    for level, up in zip([0.25, 0.45, 0.48, 1.1], joined):
        up = dict(up.collect()) if up is not None else {}
        at = {i: up.get(c, c) for i, c in at.items()}
        while todo and todo[0][1] < level:
            (x, y), w = todo.pop(0)
            if find(x) != find(y):
                parent[find(x)] = find(y)
                weight += w
                count += 1
        assert all((at[x] == at[y]) == (find(x) == find(y)) for x, y in combinations(at, 2))
    got = forest.collect()
    assert len(got) == count and abs(sum(r["w"] for r in got) - weight) < 1e-9


AREAS = {"sport": "матч гол вратарь трибуна турнир".split(), "law": "суд иск ответчик договор неустойка".split(), "medicine": "врач рентген прививка больница фельдшер".split()}
GENERAL = "просим рассмотреть вопрос сообщаем направляем ответ письмо коллеги срок материалы".split()


def sentence(rng, area):
    own = rng.sample(AREAS[area], 3) if area else []
    words = rng.sample(GENERAL, 5) + own
    rng.shuffle(words)
    return " ".join(words).capitalize() + "."


def test_subjects(spark):
    rng = random.Random(11)
    examples = [(i, " ".join(sentence(rng, a) for _ in range(3)), "ru", a) for i, a in enumerate(list(AREAS) * 30)]
    examples[0] = (0, examples[0][1], None, "law")  # a wrong label and no language
    examples += [(1000, None, "ru", "law"), (1001, "слова", "ru", None)]
    docs, want = [], set()
    for i in range(200):
        first, second = rng.sample(list(AREAS), 2)
        parts = [first] * 5 + [second] * rng.choice([0, 1, 3]) + [None] * 3
        n = parts.count(second)
        want |= {(i, first)} | ({(i, second)} if n / (5 + n) >= 0.25 else set())
        rng.shuffle(parts)
        docs.append((i, "Исх: № 1; Тема: " + "матч\n" + "\n".join(sentence(rng, a) for a in parts)))
    docs += [(900, None), (901, ""), (902, " \n "), (903, "12 [DATE] 34")]
    area = spark.createDataFrame([(a, a) for a in AREAS], "subject string, name string")
    ex = spark.createDataFrame(examples, "example_id bigint, text string, lang string, subject string")
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "text AS columns", "doc_id AS sizes")
    got = {(r["doc_id"], r["subject"]) for r in subjects.SubjectFactors(dd, "doc_id", "text", ex, area).found().collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert not {i for i, _ in got} & {900, 901, 902, 903}
    assert subjects.SubjectFactors(dd.limit(0), "doc_id", "text", ex, area).found().count() == 0
    assert subjects.SubjectFactors(dd, "doc_id", "text", ex.limit(0), area).found().count() == 0


def test_mixtures_by_entries_equal_the_dense_ones():
    rng = np.random.default_rng(1)
    parts = rng.random((40, 5)).astype(np.float32) * (rng.random((40, 5)) < 0.3)
    terms, row, n = rng.integers(0, 40, 200), np.sort(rng.integers(0, 12, 200)), rng.integers(1, 4, 200).astype(float)
    w, ratio = subjects.mixtures(terms, n, row, 13, subjects.Components(parts), tol=1e-9, most=25)
    dense, want = parts[terms] + subjects.FLOOR, np.ones((13, 5))
    for _ in range(25):
        r = n / (want[row] * dense).sum(1)
        new = np.zeros((13, 5))
        np.add.at(new, row, dense * r[:, None])
        want = want * new
    assert np.allclose(w, want, atol=1e-6) and np.allclose(ratio, n / (want[row] * dense).sum(1), rtol=1e-4)
    assert not w[~np.isin(np.arange(13), row)].any()


def test_too_many_subjects_are_an_error(spark):
    areas = spark.range(subjects.MAX_SUBJECTS + 1).selectExpr("CAST(id AS STRING) AS subject", "'x' AS name")
    none = spark.createDataFrame([], "example_id bigint, text string, lang string, subject string")
    with pytest.raises(ValueError):
        subjects.SubjectFactors(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", "text", none, areas)


def test_rarest_segments_of_a_very_long_text():
    n = 50_000
    q, number = overlaps.segment_words(n), overlaps.most_edits(n) + 1
    cost = np.random.default_rng(3).integers(0, 99, n - q + 1).astype(float)
    starts = sorted(overlaps.rarest_segments(cost, n, q, number))
    assert len(starts) == number and starts[0] >= 0 and starts[-1] <= n - q and (np.diff(starts) >= q).all()
    assert cost[starts].mean() < 30


def test_report_counts_pairs_of_copies(spark):
    long = " ".join(VOCAB[:40])
    test = [(i, long, "test" if i < 60 else "valid", "s") for i in range(120)] + [(200, "другое письмо совсем", "test", "t")]
    train = [(1000 + i, long.upper()) for i in range(300)] + [(2000 + i, long + " ещё") for i in range(5)]
    t = spark.createDataFrame(test, "row_id bigint, text string, split string, source string")
    found = overlaps.Overlaps(t, spark.createDataFrame(train, "row_id bigint, text string"))
    got = {tuple(r) for r in found.report(t).select("split", "source", "n_rows", "n_overlapping", "exact_pairs", "near_pairs").collect()}
    assert got == {("test", "s", 60, 60, 60 * 300, 60 * 5), ("valid", "s", 60, 60, 60 * 300, 60 * 5), ("test", "t", 1, 0, 0, 0)}
    assert found.near.count() == 2 and found.pairs().distinct().count() == 120 * 305
