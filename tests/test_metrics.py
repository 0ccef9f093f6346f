import math

import pytest
from palimpsest.operators import calibration, metrics, planning, ranking
from pyspark.sql import functions as F

J = "run string, rank int, paper_id string, relevance string"


def rows(df):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.collect()}


def test_precision_and_ndcg(spark):
    j = spark.createDataFrame([("a", 1, "x", "IRRELEVANT"), ("a", 2, "y", "HIGH"), ("a", 3, "z", "PARTIAL"), ("b", 1, "x", "IRRELEVANT")], J)
    assert rows(metrics.precision_at_k(j, 10)) == {"a": (0.1,), "b": (0.0,)} and rows(metrics.precision_at_k(j, 10, True))["a"] == (0.2,)
    dcg, best = 3 / math.log2(3) + 1 / 2, 3 + 1 / math.log2(3)
    got = rows(metrics.ndcg_at_k(j, 10))
    assert got["a"][0] == pytest.approx(dcg / best) and got["b"] == (0.0,)
    assert metrics.ndcg_at_k(spark.createDataFrame([], J), 10).count() == 0


def test_audits(spark):
    j = spark.createDataFrame([("a", 0, "x", "HIGH"), ("a", 1, "x", "GOOD"), ("b", 1, "y", None)], J)
    assert {tuple(r) for r in metrics.label_violations(j).collect()} == {("a", "RANK"), ("a", "LABEL"), ("a", "REPEATED_PAPER"), ("b", "LABEL")}
    r = spark.createDataFrame([("p", 1, 5, "x", "HIGH"), ("p", 2, 1, "x", "HIGH"), ("p", 2, 2, "y", "PARTIAL"), ("p", 1, 1, "q", "IRRELEVANT")], "project string, round int, rank int, paper_id string, relevance string")
    assert rows(metrics.new_useful(r, 10)) == {"p": (1,)} and rows(metrics.suppression(r, 10)) == {"p": (0.1,)}
    assert metrics.hallucination(spark.createDataFrame([], "confirmed boolean")).first()[0] == 0.0
    assert metrics.hallucination(spark.createDataFrame([(True,), (None,)], "confirmed boolean")).first()[0] == 0.5


def test_stages(spark):
    asked = [("INIT", "CLARIFYING", 0, "INIT", "OK"), ("INIT", "INIT", 0, "INIT", "ALREADY_APPLIED"), ("FINALIZED", "FINALIZED", 9, "FINALIZED", "ALREADY_APPLIED"),
             ("FINALIZED", "INIT", 9, "FINALIZED", "FINALIZED_TERMINAL"), ("INIT", "FINALIZED", 9, "INIT", "INVALID_TRANSITION"), ("INIT", "CLARIFYING", 0, "CLARIFYING", "STALE_STATE"),
             ("WAITING_FOR_FEEDBACK", "ROUND2_SEARCHING", 5, "WAITING_FOR_FEEDBACK", "INSUFFICIENT_FEEDBACK"), ("WAITING_FOR_FEEDBACK", "ROUND2_SEARCHING", 6, "WAITING_FOR_FEEDBACK", "OK"),
             ("INIT", None, None, "INIT", "INVALID_TRANSITION"), (None, "INIT", 1, "INIT", "STALE_STATE")]
    df = spark.createDataFrame(asked, "current string, target string, feedback int, actual string, want string")
    assert all(r.result == r.want for r in metrics.transition(df).collect())


def test_budget_and_gaps(spark):
    f = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 3, None), ("a", 4, 5)], "run string, seq int, n int")
    assert [r.taken for r in metrics.budgeted(f, 5, 9).orderBy("seq").collect()] == [5, 3, 0, 1]
    e = spark.sql("SELECT 'u' u, timestamp_seconds(x) t FROM VALUES (10.0), (4.0), (5.5), (NULL) v(x)")
    assert rows(metrics.request_gaps(e, "u", "t")) == {"u": (1.5,)}


def test_rerank(spark):
    c = spark.createDataFrame([("q", "a", 1, 2.0), ("q", "b", 2, 4.0), ("q", "c", 3, 3.0), ("e", "a", 1, 1.0), ("e", "b", 2, 1.0), ("n", "a", 1, float("nan")), ("n", "b", 2, 1.0)], "query string, id string, pos int, raw double")
    got = {(r.query, r.id): (r.normalized_score, r["rank"]) for r in ranking.rerank(c).collect()}
    assert got == {("q", "b"): (1.0, 1), ("q", "c"): (0.5, 2), ("q", "a"): (0.0, 3), ("e", "a"): (1.0, 1), ("e", "b"): (1.0, 2)}
    assert ranking.window_size(60, 7) == 7
    with pytest.raises(ValueError):
        ranking.window_size(10, 7)


def test_embedding_contract_and_cache(spark):
    i = spark.createDataFrame([("k", "t"), ("k", "t"), ("l", "uu")], "key string, text string")
    assert {r.key: r.vector for r in ranking.embed(i, lambda ts: [[len(t), 0] for t in ts], 2).collect()} == {"k": [1.0, 0.0], "l": [2.0, 0.0]}
    hits, misses = ranking.cached(spark.createDataFrame([("1", "k"), ("2", "m"), ("3", "m")], "id string, key string"), spark.createDataFrame([("k",)], "key string"))
    assert [r.id for r in hits.collect()] == ["1"] and [tuple(r) for r in misses.collect()] == [("m", "2")]


def test_scores_and_selection(spark):
    p = spark.createDataFrame([("a", *[1.0] * 6), ("b", *[1.0] * 5, None)], "id string, rerank double, dense double, concept double, branch double, slot double, metadata double")
    assert {r.id: (r.complete, r.score and round(r.score, 9)) for r in ranking.total_score(p).collect()} == {"a": (True, 1.0), "b": (False, None)}
    c = spark.createDataFrame([("q", "a", 0.9, "g", "S1"), ("q", "b", 0.88, "g", "S1"), ("q", "c", 0.8, "h", "S2"), ("q", "d", None, "h", None)], "question string, id string, score double, group string, slot string")
    assert [r.id for r in ranking.selection(c, 3).orderBy("position").collect()] == ["a", "c", "b"]


def test_calibration(spark):
    q = spark.createDataFrame([("p", [1.0, 0.0])], "project string, v array<double>")
    j = spark.createDataFrame([("p", "HIGH", [2.0, 4.0]), ("p", "HIGH", [0.0, 0.0]), ("p", "IRRELEVANT", [1.0, 1.0]), ("p", "?", [9.0, 9.0])], "project string, relevance string, v array<double>")
    assert [round(r.value, 6) for r in calibration.rocchio(q, j).orderBy("dim").collect()] == [1.6, 1.35]
    b = spark.createDataFrame([("p", "x", 3), ("p", "y", 1), ("z", "x", 0), ("z", "y", 0)], "project string, branch string, useful int")
    assert {(r.project, r.branch): round(r.share, 6) for r in calibration.branch_budget(b).collect()} == {("p", "x"): 0.7, ("p", "y"): 0.3, ("z", "x"): 0.5, ("z", "y"): 0.5}
    f = spark.createDataFrame([("p", f"{i}", "HIGH") for i in range(6)] + [("p", "0", "PARTIAL"), ("p", None, "HIGH"), ("p", "9", "?")], "project string, paper_id string, relevance string")
    assert tuple(calibration.feedback_state(f).first()) == ("p", 5, 1, False)
    m = spark.createDataFrame([("p", 1, i, f"a{i}") for i in range(1, 8)] + [("p", 2, 1, "a1"), *[("p", 2, i, f"b{i}") for i in range(2, 9)]], "project string, round int, rank int, paper_id string")
    got = [r.paper_id for r in calibration.final_merge(m).orderBy("position").collect()]
    assert got == ["a1", "a2", "a3", "a4", "a5", "b2", "b3", "b4", "b5", "b6"]


def test_planning(spark):
    q = spark.createDataFrame([("1", "How can graph search support radiation shielding design?"), ("2", "What is this?"), ("3", None)], "question_id string, question string")
    i = planning.intents(q)
    assert [r.question_id for r in i.collect()] == ["1"]
    p = planning.plan(i).cache()
    assert p.count() == 12 and p.select("query_id").distinct().count() == 12 and abs(p.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    text = {(r.branch, r.breadth): r.query_text for r in p.collect()}
    assert text["METHOD_DOMAIN", "NARROW"] == 'all:"graph search" AND all:"design"' and '"radiation protection"' not in text["PROBLEM_DOMAIN", "NARROW"]
    assert text["DIRECT_INTERSECTION", "MEDIUM"].count("radiation protection") == 1 and '"optimization"' in text["DIRECT_INTERSECTION", "MEDIUM"]
    assert planning.plan_violations(p).count() == 0
    twice = spark.createDataFrame([("1", "How can transfer learning support radiation shielding design?")], "question_id string, question string")
    assert [r.problem for r in planning.plan_violations(planning.plan(planning.intents(twice))).collect()] == ["REPEATED_TERM"]  # transfer is a bridge term, too
    g = spark.createDataFrame([("p", "OBJECT", False, 1.0), ("p", "TASK", True, None), ("p", "EXCLUSIONS", True, None), ("p", "SCOPE", False, 0.0)], "project string, field string, missing boolean, confidence double")
    assert {r.field: round(r.priority, 6) for r in planning.gaps(g).collect()} == {"OBJECT": 0.0, "TASK": 0.825, "SCOPE": 0.0}
    kept, gone = planning.exclude(spark.createDataFrame([("p", "Graph  Search"), ("p", "graph")], "project string, term string"), spark.createDataFrame([("p", "graph search")], "project string, term string"))
    assert [r.term for r in kept.collect()] == ["graph"] and gone.count() == 1
