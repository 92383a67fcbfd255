"""Small sources beside a huge one get their own targets, not whole blocks or nothing."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing


def test_tiny_sources(spark):
    huge = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 5000) AS text", "'m' AS source")
    tiny = spark.range(40).selectExpr("1000 + id AS doc_id", "repeat('w ', CAST(1 + id AS INT)) AS text", "concat('t', id) AS source")
    docs = huge.union(tiny)
    by = {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 2 * r.size
        key = "m" if r.doc_id < 1000 else r.doc_id
        by[key] = (by.get(key, (0, 0))[0] + r.taken, r.target)
    assert len(by) == 41
    for key, (taken, target) in by.items():
        assert taken == pytest.approx(target, rel=0.02, abs=0.5), key
    plan = mixing.schedule(docs)[0].groupBy("slot").agg(F.min("key").alias("key"), F.sum("tokens").alias("n")).collect()
    last = max(r.slot for r in plan)
    assert all(0 < r.n <= 46 for r in plan)
    assert 0.3 < sum(r.slot for r in plan if r.key[1] == "t") / sum(r.key[1] == "t" for r in plan) / last < 0.7


def test_large_mixes_have_more_slots(spark, monkeypatch):
    """Blocks don't grow beyond their limit, whatever the number of words."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 100) AS text", "concat('s', id % 3) AS source")
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    plan = mixing.schedule(docs, n_slots=64)[0].groupBy("slot").agg(F.sum("tokens").alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert max(r.n for r in plan) == 50
    assert {r["keys"] for r in plan} == {1}
    assert len(plan) == pytest.approx(45_000 / 50, rel=0.02)
