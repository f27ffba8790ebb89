"""Weights computed where the texts are: the same rows as in long form, and what moves is bounded by vocabularies."""

import pytest
from pyspark.sql import functions as F

from letterloom.operators import features as X
from letterloom.operators import weights as W
from letterloom.plans import all_queries

ODD = [
    (1, "Договор договор № 12 аб"), (1, "аб договор о поставке"), (None, "без номера договор"), (None, "номера аб"), (2, ""), (3, "   \n\t "), (4, "я"),
    (5, "Ёлка ΣΑΣ İstanbul 𝒳𝒳 договор"), (6, "и договор о поставке"), (7, "_a_ b1 договор договор договор"), (8, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").filter("text IS NOT NULL")


def summed(rows, digits=9):
    return {r[0]: (r[1], *(round(x, digits) for x in r[2:])) for r in rows}


def moved(spark, df):
    """Rows of df and the records it wrote for shuffles."""
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm

    def records():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        return sum(s.shuffleWriteRecords() for s in [x for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, jvm.java.util.ArrayList()))])

    before = records()
    rows = df().collect()
    return rows, records() - before


@pytest.mark.parametrize("kinds", [("chars",), ("words", "chars")])
@pytest.mark.parametrize("cut", [dict(), dict(min_df=2, max_df=0.5, sublinear=True)])
def test_row_sums_equal_long_form(odd, kinds, cut, monkeypatch):
    monkeypatch.setattr(W, "STEP", 5)
    n = odd.count()
    counts = {"words": X.term_counts(odd, "doc_id", X.word_terms(F.col("text"))), "chars": X.term_counts(odd, "doc_id", rows=lambda r: X.char_rows(r, "doc_id", F.col("text")))}
    long = X.unit_blocks(*[X.tfidf(counts[k], n, normalize=False, **cut) for k in kinds])
    want = long.groupBy("doc_id").agg(F.count(F.lit(1)), F.sum("weight"), F.sum(F.col("weight") * F.col("weight")), F.max("weight"))
    got = summed(W.row_sums(odd, "doc_id", "text", kinds, **cut).collect())
    assert got == summed(want.collect()) and len(got) >= 4
    assert W.row_sums(odd.limit(0), "doc_id", "text", kinds, **cut).collect() == []


def letters(spark, folder, name, key):
    """400 letters of two kinds, each with a few hundred different terms."""
    texts = [" ".join(f"слово{k}{i % 2}" for k in range(40)) for i in range(400)]
    spark.createDataFrame([(i, "один" if i % 2 else "два", t) for i, t in enumerate(texts)], f"{key} bigint, label string, text string").write.parquet(f"{folder}/{name}.parquet")


def test_char_tfidf_moves_vocabularies(spark, tmp_path):
    letters(spark, tmp_path, "documents", "doc_id")
    rows, records = moved(spark, lambda: all_queries.QUERIES["char_tfidf"](spark, str(tmp_path)))
    assert len(rows) == 400 and sum(r["n_terms"] for r in rows) > 60_000
    assert records < 10_000


def test_hybrid_tfidf_moves_vocabularies(spark, tmp_path):
    letters(spark, tmp_path, "documents", "doc_id")
    rows, records = moved(spark, lambda: all_queries.QUERIES["hybrid_tfidf"](spark, str(tmp_path)))
    assert len(rows) == 400 and sum(r["n_terms"] for r in rows) > 90_000
    assert records < 12_000


def test_hybrid_matrix_moves_vocabularies(spark, tmp_path):
    letters(spark, tmp_path, "train", "row_id")
    vectors = [(i, [1.0, float(i), 2.0]) for i in range(0, 400, 2)] + [(0, [0.5, 0.5, 0.5]), (1, [0.0, 0.0, 0.0]), (999, [1.0, 1.0, 1.0])]
    spark.createDataFrame(vectors, "row_id bigint, x_train_bert array<float>").write.parquet(f"{tmp_path}/x_train_bert.parquet")
    rows, records = moved(spark, lambda: all_queries.QUERIES["hybrid_matrix"](spark, str(tmp_path)))
    by = {(r["artefact"], r["doc_id"]): r for r in rows}
    assert len(rows) == 400 and {k[1] for k in by} == set(range(0, 400, 2))
    assert (by["blocks", 2]["squares"], by["unit", 2]["squares"], by["unit", 2]["dense_share"]) == (26.0, 1.0, round(25 / 26, 6))
    assert by["blocks", 0]["squares"] == 51.0 and by["unit", 0]["n_terms"] == by["unit", 2]["n_terms"] + 3
    assert records < 12_000


def test_nb_moves_sums_by_label(spark, tmp_path):
    """As the long form, also for repeated ids of different labels and texts without known words; entries don't move."""
    from letterloom.operators import linear

    letters(spark, tmp_path, "train", "row_id")
    letters(spark, tmp_path, "test", "row_id")
    extra = [(1, "два", "слово10 слово20 особое"), (1, "два", "слово10 особое"), (500, "три", "слово30 слово31"), (501, "три", "никто не знает"), (502, "нет", None)]
    for t in ("train", "test"):
        spark.createDataFrame(extra, "row_id bigint, label string, text string").write.mode("append").parquet(f"{tmp_path}/{t}.parquet")
    got, records = moved(spark, lambda: all_queries.QUERIES["nb"](spark, str(tmp_path)))
    train = spark.read.parquet(f"{tmp_path}/train.parquet").filter("text IS NOT NULL")
    counts, n = X.term_counts(train, "row_id", X.word_terms(F.col("text"))), train.count()
    weights = X.tfidf(counts, n, min_df=2, max_df=0.95)
    want = linear.multinomial_nb(weights, weights, train.select(F.col("row_id").alias("doc_id"), "label"))
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()} and len(got) >= 401
    assert records < 12_000


@pytest.mark.parametrize("cut", [dict(), dict(min_df=2, max_df=0.98, sublinear=True)])
def test_text_svd_equals_long_form(spark, monkeypatch, cut):
    """The same values, coordinates and terms, with several ranges a part and few terms in full matrices."""
    from letterloom.operators import decomposition, reduction

    monkeypatch.setattr(decomposition, "STEP", 90)
    monkeypatch.setattr(decomposition, "FULL", 40)
    texts = [(i, " ".join(f"{'слово' if (i * k) % 7 else 'Дело'}{(i * i + k * (i % 5)) % 29}" for k in range(i % 13))) for i in range(90)]
    df = spark.createDataFrame(ODD + texts, "doc_id bigint, text string").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    counts = X.term_counts(df, "doc_id", X.word_terms(F.col("text"))), X.term_counts(df, "doc_id", rows=lambda r: X.char_rows(r, "doc_id", F.col("text")))
    long = X.unit_blocks(*[X.tfidf(c, df.count(), normalize=False, **cut) for c in counts])
    want = reduction.truncated_svd(long.select("doc_id", F.concat_ws(":", "block", "term").alias("term"), "weight"), 5)
    got = decomposition.text_svd(df, "doc_id", "text", ("words", "chars"), 5, **cut)
    assert got[2] == pytest.approx(want[2], abs=1e-5) and len(got[2]) == 5
    for a, b in zip(got[:2], want[:2]):
        a, b = ({r[0]: list(r["x"]) for r in t.collect()} for t in (a, b))
        assert a.keys() == b.keys() and all(a[key] == pytest.approx(b[key], abs=1e-4) for key in a)
    none = decomposition.text_svd(df.limit(0), "doc_id", "text", ("words", "chars"), 5, **cut)
    assert none[0].count() == none[1].count() == len(none[2]) == 0


def test_truncated_svd_moves_vocabularies(spark, tmp_path):
    letters(spark, tmp_path, "train", "row_id")
    rows, records = moved(spark, lambda: all_queries.QUERIES["truncated_svd"](spark, str(tmp_path)))
    assert rows and all(r["value"] > 0 for r in rows)
    assert records < 20_000


CUTS = {"char_tfidf": (("chars",), dict(min_df=2, max_df=0.95)), "hybrid_tfidf": (("words", "chars"), dict(min_df=2, max_df=0.98, sublinear=True))}


def entries(row, names=("terms", "weights")):
    """Term and weight of each entry of a row, in its order."""
    terms, weights = (row[n].split("\n") for n in names)
    assert terms.pop() == weights.pop() == "" and len(terms) == len(weights)
    return list(zip(terms, map(float, weights)))


@pytest.mark.parametrize("name", sorted(CUTS))
def test_tfidf_gives_every_entry(spark, odd, tmp_path, name):
    kinds, cut = CUTS[name]
    spark.createDataFrame(ODD, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {"words": X.term_counts(odd, "doc_id", X.word_terms(F.col("text"))), "chars": X.term_counts(odd, "doc_id", rows=lambda r: X.char_rows(r, "doc_id", F.col("text")))}
    long = X.unit_blocks(*[X.tfidf(counts[k], odd.count(), normalize=False, **cut) for k in kinds])
    want = {}
    for r in sorted(long.collect(), key=lambda r: (r["block"], r["term"].encode())):
        want.setdefault(r["doc_id"], []).append((r["term"], round(r["weight"], 6)))
    got = all_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: entries(r) for r in got} == want and None in want
    words = {r["doc_id"]: r["n_words"] for r in got} if len(kinds) > 1 else {}
    assert all(n == long.filter(F.col("doc_id").eqNullSafe(F.lit(i)) & (F.col("block") == 0)).count() for i, n in list(words.items())[:3])
    assert all(r["n_terms"] == len(want[r["doc_id"]]) for r in got) and sum(map(len, want.values())) > 100


def test_rows_by_document_in_ranges():
    """The same rows whatever the ranges of documents, as their entries say; none where no document has terms."""
    texts = [" ".join(f"слово{(i * k) % 7}" for k in range(i % 6)) for i in range(40)] + ["один"]
    part = W.Part(W.pa.table({"doc_id": list(range(41)), "t0": texts, "t1": texts}), ("words", "chars"))

    def weights(step):
        for low, high in part.ranges(step):
            yield low, high, [(doc, term, n * 2.0) for doc, term, n in (b.entries(low, high) for b in part.blocks)]

    whole = W.rows_by_document(part, weights(None), None).to_pylist()
    assert whole == W.rows_by_document(part, weights(3), None).to_pylist() and len(list(part.ranges(3))) > 20
    assert len(whole) == sum(bool(t) for t in texts) and all(r["n"] == len(entries(r)) for r in whole)
    assert all(sum(w * w for _, w in entries(r)) == pytest.approx(1, abs=1e-4) for r in whole)
    last = whole[-1]
    assert (last["doc_id"], last["first"], entries(last)[0]) == (40, 1, ("один", 0.707107)) and "дин " in dict(entries(last)[1:])
    none = W.Part(W.pa.table({"doc_id": [1, 2], "t0": ["", " "]}), ("chars",))
    assert W.rows_by_document(none, iter([(0, 2, [none.blocks[0].entries(0, 2)])]), None).num_rows == W.rows_by_document(none, iter([]), None).num_rows == 0


def test_whole_rows_of_no_documents(odd):
    assert W.whole_rows(odd.limit(0), "doc_id", "text", ("words", "chars")).collect() == []


def test_words_within_tokens_are_those_of_texts(spark, odd):
    """The words of spaced texts are those that the engine finds in texts as they are, for every character there is."""
    texts = [t for _, t in ODD if t] + ["".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)])), "а.б,вг-дё  x1\u00a0Ⅷ½_ ½²³"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = df.select(W._spaced("chars", F.col("text")), W._spaced("words", F.col("text"))).collect()
    row, word, words = W._words_within(W._tokens(W.pa.array([r[0] for r in rows], W.pa.large_string())), W.word_pattern(spark))
    got = [[words[int(w)].as_py() for w in word[row == i]] for i in range(len(rows))]
    assert got == [r[1].split(" ") if r[1] else [] for r in rows] and len(got[-2]) > 100


def test_grams_of_long_words(monkeypatch):
    words = W.pa.array(["", "я", "два", "договора", "𝒳𝒳", "длинноеслово"], W.pa.large_string())
    found = []
    for long in (60, 3, 0):
        monkeypatch.setattr(W, "LONG", long)
        of, grams = W._grams(words)
        found.append(sorted(zip(of.tolist(), grams.to_pylist())))
    spaced = [f" {w} " for w in words.to_pylist()]
    want = sorted((k, w[i : i + n]) for k, w in enumerate(spaced) if k for n in (3, 4, 5) for i in range(len(w) - n + 1))
    assert found == [want] * 3
