"""Encoding, packing: against the public libraries and by invariants."""

import os
import random

import numpy as np
import pytest

from letterloom.llm import bpe, packing
from letterloom.llm.vocabularies import FOLDER

JSON, RANKS = os.path.join(FOLDER, "byte_bpe_50k.json"), os.path.join(FOLDER, "byte_bpe_multi_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabularies")

TEXTS = [
    None, "", " ", "\n", "слово", "Просим  рассмотреть\n\n вопрос.", "a" * 5000, "аб" * 3000, "<|endoftext|>", " leading", "trailing ", "\t x  y z", "don't we'll",
    "№ 123-ОК/5", "\U0001f600 émoji é", "12345 67", "x\r\ny", "a\t b",
]


def random_texts(n=2000):
    rng = random.Random(5)
    chars = [chr(c) for c in range(1, 0x500)] + list(" \n\t\x85  　\x1c") * 30 + [chr(c) for c in range(0x1F600, 0x1F620)]
    return ["".join(rng.choice(chars) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_json_against_tokenizers():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(JSON)
    ref.encode_special_tokens = True
    enc = bpe.PrefixEncoder(JSON)
    for t in [*TEXTS, *random_texts()]:
        assert enc.encode(t) == ref.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_ranks_against_tiktoken():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.PrefixEncoder(RANKS)
    for t in [*TEXTS, *random_texts()]:
        assert enc.encode(t) == ref.encode_ordinary(t or ""), repr(t)


def test_corpus(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, ids string").withColumnRenamed("ids", "text").selectExpr("doc_id", "text", "text AS ids")
    got = dict(bpe.encode_corpus(df, "doc_id", "text", JSON).collect())
    enc = bpe.PrefixEncoder(JSON)
    assert got == {i: enc.encode(t) for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", JSON).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_holds_every_capacity(by):
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 900, 500))[::-1]
    at = packing.best_fit(sizes, 1000, 4, 900_000, by=by)
    for c in np.unique(at):
        mine = sizes[at == c]
        assert mine.sum() <= 1000 and len(mine) <= 4 and (mine.astype(float) ** 2).sum() <= 900_000


def test_best_fit_is_near_the_bound():
    sizes = np.sort(np.random.default_rng(4).integers(1, 700, 3000))[::-1]
    assert packing.best_fit(sizes, 1000, 1000, 1e6).max() + 1 <= 1.02 * sizes.sum() / 1000 + 1


def test_pack(spark):
    counts = spark.createDataFrame([(1, 0), (2, 10), (3, 25), (4, 3), (5, 7), (6, 10)], "doc_id bigint, t int")
    caps = spark.createDataFrame([(1, "t", 10)], "capacity_id int, tokenizer string, capacity int")
    rows = packing.pack(counts, caps).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert sorted(parts[3]) == [5, 10, 10] and parts[2] == [10] and parts[1] == [0]
    held = {}
    for r in rows:
        if r["container_id"] is not None:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
    assert max(held.values()) <= 10 and len(held) == 6
    assert [r["container_id"] for r in rows if r["doc_id"] == 1] == [None]
    assert packing.packing_report(packing.pack(counts, caps), caps).first()["containers"] == 6
    assert packing.pack(counts.limit(0), caps).count() == 0
    assert packing.pack(counts, caps.limit(0)).count() == 0


def test_pack_holds_documents_and_attention_cost(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 5, 30, 90, 120, 260])) for i in range(600)]
    counts = spark.createDataFrame(sizes, "doc_id bigint, t int")
    caps = spark.createDataFrame([(1, "t", 100), (2, "t", 400)], "capacity_id int, tokenizer string, capacity int")
    rows = packing.pack(counts, caps, docs_share=0.05, cost_share=0.4, group_items=250).collect()
    bound = {1: (100, 5, 4000.0), 2: (400, 20, 64000.0)}
    held, total = {}, {}
    for r in rows:
        if r["container_id"] is not None:
            held.setdefault((r["capacity_id"], r["container_id"]), []).append(r["n_tokens"])
        total[r["capacity_id"], r["doc_id"]] = total.get((r["capacity_id"], r["doc_id"]), 0) + r["n_tokens"]
    assert all(total[c, i] == n for i, n in sizes for c in (1, 2))
    for (c, _), items in held.items():
        tokens, docs, cost = bound[c]
        assert sum(items) <= tokens and len(items) <= docs
        assert len(items) == 1 or sum(x * x for x in items) <= cost  # alone, an item may cost more
    assert max(len(items) for (c, _), items in held.items() if c == 2) == 20
    free = {}
    for r in packing.pack(counts, caps, docs_share=0.05, group_items=250).filter("capacity_id = 2 AND n_tokens > 0").collect():
        free.setdefault(r["container_id"], []).append(r["n_tokens"])
    assert any(len(items) > 1 and sum(x * x for x in items) > 64000 for items in free.values())  # so the cost binds
