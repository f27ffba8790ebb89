"""Shared helpers of the training-data operators."""

import pytest
from pyspark.sql import functions as F

from letterloom.llm import common


def test_observed_counts_what_is_written(spark):
    for n in (0, 1000):
        out, seen = common.observed(spark.range(n), "observed", F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        assert out.count() == n and seen == {"n": n, "least": 0 if n else None}
    empty = spark.range(10).join(spark.range(20, 30), "id")
    out, seen = common.observed(empty, "observed", F.count(F.lit(1)).alias("n"))
    assert out.count() == 0 and seen == {"n": 0}


def test_join_salted_equals_an_ordinary_join(spark):
    left = spark.range(400).selectExpr("IF(id % 2 = 0, 0, id) AS k", "id AS u")
    right = spark.range(700).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    hot = common.hot_keys(left, "k", 400)
    assert [r["k"] for r in hot.collect()] == [0]
    got = common.join_salted(left, right, "k", "v", hot, 7)
    assert sorted(map(tuple, got.select("k", "u", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "u", "v").collect()))
    none = hot.limit(0)
    assert common.join_salted(left, right, "k", "v", none).count() == left.join(right, "k").count()


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "another", "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        common.scratch(Session())
