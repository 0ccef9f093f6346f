from datetime import UTC, datetime

import pytest
from palimpsest.operators import intent
from palimpsest.sources import cache
from pyspark.sql import functions as F

NOW = datetime(2026, 1, 2, 3, 4, 5, 6, tzinfo=UTC)
FULL = {"object_terms": ["shield"], "task_terms": ["design"], "method_terms": ["graph search"], "scope_terms": ["support"], "accepted_paper_roles": ["b", "a"]}


def test_prepare():
    state, frozen = intent.prepare("q", lambda q: FULL, NOW)
    assert state == "FROZEN" and frozen["accepted_paper_roles"] == ["a", "b"] and frozen["frozen_at"] == "2026-01-02T03:04:05.000006Z"
    assert intent.replayed(dict(reversed(frozen.items())), frozen) is frozen
    with pytest.raises(intent.IntentError):
        intent.replayed(frozen | {"language": "zh"}, frozen)
    state, asked = intent.prepare("q", lambda q: {"language": "zh"}, NOW)
    assert state == "CLARIFY" and [f for f, _ in asked] == ["OBJECT", "TASK", "METHOD"] and asked[0][1].endswith("？")


def test_refusals():
    for bad in ({"x": 1}, {"object_terms": "no list"}, {"object_terms": [" "]}, {"object_terms": ["a", "A "]}, {"confidence": {"OBJECT": 2}}, {"confidence": {"OBJECT": True}}, {"language": "fr"}, None):
        with pytest.raises(intent.IntentError):
            intent.read_candidate(bad)
    with pytest.raises(intent.IntentError):
        intent.freeze(intent.read_candidate(FULL), datetime(2026, 1, 1))
    with pytest.raises(intent.IntentError):
        intent.freeze(intent.Draft(), NOW)
    assert intent.stable_id("Q1", "a", 1) == intent.stable_id("Q1", "a", 1) != intent.stable_id("Q1", "a", 2)


def test_cache(spark, tmp_path):
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "q string").withColumn("key", cache.response_key(F.col("q"), 5, "e", "n"))
    stored = asked.where("q <> 'q3'").selectExpr("key", "IF(q = 'q1', array('a'), CAST(array() AS array<string>)) AS answer", "1 AS stored_at")
    cache.append(stored, f"{tmp_path}/c")
    cache.append(stored.where("size(answer) > 0").selectExpr("key", "array('newer') AS answer", "2 AS stored_at"), f"{tmp_path}/c")
    table = spark.read.parquet(f"{tmp_path}/c")
    got = {r.q: r.answer for r in cache.read(asked, table, F.col("answer").isNotNull()).collect()}
    assert got == {"q1": ["newer"], "q2": [], "q3": None} and tuple(cache.audit(asked, table).first()) == (3, 1, 1)
    keys = spark.sql("SELECT 'a' p, 'b' p2, 't' t").select(cache.embedding_key("d", F.col("t")), cache.rerank_key("d", F.col("t"), F.col("p"), F.col("t")), cache.rerank_key("d", F.col("t"), F.col("p2"), F.col("t"))).first()
    assert len(set(keys)) == 3
