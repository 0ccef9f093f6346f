"""Queries over runs: vectors, reranking, metrics, feedback, calibration, gates, stages.

The event table stands for judged runs: a user is a run and a project, an event a paper at the place of its
time, event types are relevance labels, and the first half of a user's events are round 1. Query and paper
vectors stand in for each other by their ids. These pairings are made up, as no table holds judgements.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import calibration, metrics, planning, ranking
from palimpsest.plans.catalogue import query
from palimpsest.runtime import table
from palimpsest.streaming import feedback

RELEVANCE = "CASE event_type WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'PARTIAL' ELSE 'IRRELEVANT' END"
JUDGED = f"""(SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, CAST(event_id AS VARCHAR) AS paper_id, {RELEVANCE} AS relevance, event_type, value, ts, event_id FROM events)"""
ROUNDS = f"""(SELECT run AS project, CASE WHEN rank * 2 <= n THEN 1 ELSE 2 END AS round, CASE WHEN rank * 2 <= n THEN rank ELSE rank - n // 2 END AS rank, paper_id, relevance, event_type, value
FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM {JUDGED}))"""
BRANCH = "CASE event_type WHEN 'purchase' THEN 'DIRECT_INTERSECTION' WHEN 'click' THEN 'PROBLEM_DOMAIN' WHEN 'view' THEN 'METHOD_DOMAIN' ELSE 'BRIDGE_DOMAIN' END"


def judged(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(w).alias("rank"), F.col("event_id").cast("string").alias("paper_id"), F.expr(RELEVANCE).alias("relevance"), "event_type", "value", "ts", "event_id"
    )


def rounds(spark, d):
    n = F.count("*").over(Window.partitionBy("run"))
    half = F.floor(F.col("n") / 2)
    first = F.col("rank") * 2 <= F.col("n")
    return judged(spark, d).withColumn("n", n).select(
        F.col("run").alias("project"), F.when(first, 1).otherwise(2).alias("round"), F.when(first, F.col("rank")).otherwise(F.col("rank") - half).cast("long").alias("rank"), "paper_id", "relevance", "event_type", "value"
    )


PRECISION_SQL = f"SELECT run, round(count(*) FILTER (WHERE rank <= 10 AND relevance = 'HIGH') / 10.0::DOUBLE, 6) AS strict, round(count(*) FILTER (WHERE rank <= 10 AND relevance <> 'IRRELEVANT') / 10.0::DOUBLE, 6) AS inclusive FROM {JUDGED} GROUP BY run"
NDCG_SQL = f"""SELECT run, round(coalesce(sum((2.0::DOUBLE ** g - 1) / log2(rank + 1)) / nullif(sum((2.0::DOUBLE ** g - 1) / log2(ideal + 1)), 0), 0), 6) AS ndcg
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY g DESC, rank) ideal FROM (SELECT *, CASE relevance WHEN 'HIGH' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END g FROM {JUDGED} WHERE rank <= 10)) GROUP BY run"""


@query("precision_at_k", PRECISION_SQL)
def precision_at_k(spark, d):
    j = judged(spark, d)
    return metrics.precision_at_k(j, 10).withColumnRenamed("precision", "strict").join(metrics.precision_at_k(j, 10, True), "run").select("run", F.round("strict", 6).alias("strict"), F.round("precision", 6).alias("inclusive"))


@query("ndcg_at_k", NDCG_SQL)
def ndcg_at_k(spark, d):
    return metrics.ndcg_at_k(judged(spark, d), 10).select("run", F.round("ndcg", 6).alias("ndcg"))


@query("evidence_coverage", f"SELECT run, round(count(DISTINCT event_type) / 5.0::DOUBLE, 6) AS coverage FROM {JUDGED} WHERE rank <= 10 GROUP BY run")
def evidence_coverage(spark, d):
    return metrics.coverage(judged(spark, d).where("rank <= 10").withColumnRenamed("event_type", "slot")).select("run", F.round("coverage", 6).alias("coverage"))


@query("negative_suppression", f"""SELECT project, round((count(*) FILTER (WHERE round = 1 AND rank <= 10 AND relevance = 'IRRELEVANT') - count(*) FILTER (WHERE round = 2 AND rank <= 10 AND relevance = 'IRRELEVANT')) / 10.0::DOUBLE, 6) AS suppression
FROM {ROUNDS} GROUP BY project""")
def negative_suppression(spark, d):
    return metrics.suppression(rounds(spark, d), 10).select("project", F.round("suppression", 6).alias("suppression"))


@query("new_useful_papers", f"""SELECT project, count(DISTINCT paper_id) FILTER (WHERE round = 2 AND rank <= 10 AND relevance <> 'IRRELEVANT') AS new_useful FROM {ROUNDS} GROUP BY project""")
def new_useful_papers(spark, d):
    return metrics.new_useful(rounds(spark, d), 10)


@query("hallucination_rate", "SELECT round(avg((NOT coalesce(regexp_matches(url, '^https?://') AND source_id <> '', false))::INT), 6) AS rate FROM paper_records")
def hallucination_rate(spark, d):
    ok = F.col("url").rlike("^https?://") & (F.col("source_id") != "")
    return metrics.hallucination(table(spark, d, "paper_records").select(ok.alias("confirmed"))).select(F.round("rate", 6).alias("rate"))


@query("label_audit", f"SELECT run, 'REPEATED_PAPER' AS problem FROM {JUDGED} GROUP BY run, paper_id HAVING count(*) > 1")
def label_audit(spark, d):
    return metrics.label_violations(judged(spark, d))


STAGE = "list_extract(['INIT','CLARIFYING','ROUND1_SEARCHING','WAITING_FOR_FEEDBACK','ROUND2_SEARCHING','WAITING_FOR_DIRECTION_CONFIRMATION','FINALIZED'], CAST({} AS INT))"


@query("stage_transitions", f"""
SELECT event_id, CASE WHEN a IS DISTINCT FROM c THEN 'STALE_STATE' WHEN t = c THEN 'ALREADY_APPLIED' WHEN c = 7 THEN 'FINALIZED_TERMINAL' WHEN t <> c + 1 THEN 'INVALID_TRANSITION' WHEN t = 5 AND f < 6 THEN 'INSUFFICIENT_FEEDBACK' ELSE 'OK' END AS result
FROM (SELECT event_id, 1 + event_id % 7 c, 1 + (event_id % 7 + 1 + user_id % 3) % 7 t, 1 + (event_id % 7 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 7 a, user_id % 12 f FROM events)""")
def stage_transitions(spark, d):
    stage = lambda i: F.element_at(F.array(*map(F.lit, metrics.STAGES)), (i + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    asked = table(spark, d, "events").select(
        "event_id", stage(e % 7).alias("current"), stage((e % 7 + 1 + u % 3) % 7).alias("target"), stage((e % 7 + (F.col("event_type") == "error").cast("int")) % 7).alias("actual"), (u % 12).alias("feedback")
    )
    return metrics.transition(asked).select("event_id", "result")


@query("feedback_gate", f"""
SELECT project, count(*) FILTER (WHERE n = 1) AS valid, count(*) FILTER (WHERE n > 1) AS conflicts, count(*) FILTER (WHERE n = 1) >= 6 AS may_start
FROM (SELECT run AS project, CAST(value AS BIGINT) AS paper, count(DISTINCT relevance) n FROM {JUDGED} WHERE value IS NOT NULL GROUP BY ALL) GROUP BY project""")
def feedback_gate(spark, d):
    f = judged(spark, d).select(F.col("run").alias("project"), F.rint("value").cast("long").alias("paper_id"), "relevance")
    return calibration.feedback_state(f)


@query("feedback_windows", "SELECT user_id AS project, date_trunc('day', ts) AS window_start, count(*) AS n, count(*) >= 6 AS may_start FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL")
def feedback_windows(spark, d):
    return feedback.windowed(table(spark, d, "events")).select("project", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "may_start")


@query("request_gaps", "SELECT user_id, min(gap) AS min_gap_seconds FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6::DOUBLE gap FROM events) GROUP BY user_id")
def request_gaps(spark, d):
    return metrics.request_gaps(table(spark, d, "events"), "user_id", "ts")


@query("budgeted_scan", """
SELECT run, seq, CAST(greatest(0, least(want, 60 - (s - want))) AS INT) AS taken FROM (SELECT *, sum(want) OVER (PARTITION BY run ORDER BY seq) s
FROM (SELECT user_id AS run, event_id AS seq, least(greatest(CAST(floor(value) AS BIGINT), 0), 5) want FROM events))""")
def budgeted_scan(spark, d):
    found = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.floor("value").alias("n"))
    return metrics.budgeted(found, 5, 60)


@query("intent_gaps_top3", f"""
SELECT project, field, round(priority, 6) AS priority, missing AND row_number() OVER (PARTITION BY project ORDER BY priority DESC, pos) <= 3 AS asked
FROM (SELECT *, CASE WHEN missing THEN 0.65::DOUBLE + 0.35::DOUBLE * (1 - confidence) ELSE 0 END priority FROM (SELECT user_id project, CASE event_type WHEN 'signup' THEN 'OBJECT' WHEN 'view' THEN 'TASK' WHEN 'click' THEN 'METHOD' WHEN 'error' THEN 'SCOPE' ELSE 'ACCEPTED_PAPER_ROLES' END field,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 ELSE 5 END pos, min(value) < 3 AS missing, least(1.0, max(value) / 100.0) confidence FROM events GROUP BY ALL))""")
def intent_gaps_top3(spark, d):
    names = {"signup": "OBJECT", "view": "TASK", "click": "METHOD", "error": "SCOPE", "purchase": "ACCEPTED_PAPER_ROLES"}
    field = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    f = table(spark, d, "events").groupBy(F.col("user_id").alias("project"), field.alias("field")).agg((F.min("value") < 3).alias("missing"), F.least(F.lit(1.0), F.max("value") / 100).alias("confidence"))
    return planning.gaps(f).select("project", "field", F.round("priority", 6).alias("priority"), "asked")


@query("cosine_topk", """
WITH s AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) c FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s)
SELECT query, id, c AS cosine, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = ranking.nearest_to_queries(v, v.where("id % 100 = 0"), 10)
    return near.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("norm_audit", """
SELECT count(*) AS vectors, count(*) FILTER (WHERE coalesce(abs(n - 1) > 1e-3 * greatest(n, 1.0), true)) AS not_unit
FROM (SELECT CASE WHEN len(list_filter(vector, lambda x: x IS NULL)) = 0 THEN sqrt(list_sum(list_transform(vector, lambda x: x * x))) END n FROM vector_snapshot)""")
def norm_audit(spark, d):
    return ranking.norm_audit(table(spark, d, "vector_snapshot").select(F.col("vector").alias("v")))


@query("vector_contract", """
SELECT input_kind, CASE WHEN vector IS NULL THEN 'NULL' WHEN len(vector) <> dimension THEN 'LENGTH' WHEN len(list_filter(vector, lambda x: isfinite(x))) < len(vector) THEN 'NOT_FINITE' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'ZERO' ELSE 'OK' END AS state, count(*) AS n
FROM vector_snapshot GROUP BY ALL""")
def vector_contract(spark, d):
    v = F.col("vector")
    state = (
        F.when(v.isNull(), "NULL").when(F.size(v) != F.col("dimension"), "LENGTH").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE")
        .when(F.forall(v, lambda x: x == 0), "ZERO").otherwise("OK")
    )
    return table(spark, d, "vector_snapshot").groupBy("input_kind", state.alias("state")).agg(F.count("*").alias("n"))


@query("rerank_minmax", """
SELECT query, id, raw AS raw_score, round(CASE WHEN hi = lo THEN 1.0 ELSE (raw - lo) / (hi - lo) END, 6) AS normalized_score, row_number() OVER (PARTITION BY query ORDER BY raw DESC, id) AS rank
FROM (SELECT *, min(raw) OVER (PARTITION BY query) lo, max(raw) OVER (PARTITION BY query) hi FROM (SELECT user_id query, event_id id, value raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events) WHERE i <= 50)""")
def rerank_minmax(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), F.col("value").alias("raw"))
    return ranking.rerank(c, 50).select("query", "id", "raw_score", F.round("normalized_score", 6).alias("normalized_score"), F.col("rank").cast("long").alias("rank"))


@query("cache_hit_miss", """
SELECT input_kind, (text_sha256 IN (SELECT text_sha256 FROM vector_snapshot WHERE vector IS NOT NULL)) AS hit, count(*) AS inputs, count(DISTINCT text_sha256) AS keys FROM vector_snapshot GROUP BY ALL""")
def cache_hit_miss(spark, d):
    v = table(spark, d, "vector_snapshot").select("input_kind", F.col("input_id").alias("id"), F.col("text_sha256").alias("key"), "vector")
    known = v.where("vector IS NOT NULL").select("key").distinct().withColumn("hit", F.lit(True))
    return v.join(known, "key", "left").groupBy("input_kind", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("inputs"), F.count_distinct("key").alias("keys"))


PARTS = "round(least(1.0, value / 100.0), 6)"


@query("six_part_score", f"""
SELECT event_id, round(0.35 * r + 0.25 * p + 0.15 * p + 0.10 * b + 0.10 * b + 0.05 * r, 6) AS score FROM (SELECT event_id, {PARTS}::DOUBLE r, (CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END)::DOUBLE p, (user_id % 4 / 4.0)::DOUBLE b FROM events)""")
def six_part_score(spark, d):
    r = F.round(F.least(F.lit(1.0), F.col("value") / 100), 6)
    p = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    b = (F.col("user_id") % 4 / 4).cast("double")
    parts = table(spark, d, "events").select("event_id", r.alias("rerank"), p.alias("dense"), p.alias("concept"), b.alias("branch"), b.alias("slot"), r.alias("metadata"))
    return ranking.total_score(parts).select("event_id", F.round("score", 6).alias("score"))


@query("greedy_selection")
def greedy_selection(spark, d):
    c = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("question"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("score"), F.get_json_object("props", "$.k").alias("group"), F.col("event_type").alias("slot")
    )
    return ranking.selection(c, 15)


@query("rocchio_query", """
WITH v AS (SELECT label AS project, vec_id, CASE vec_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'PARTIAL' ELSE 'IRRELEVANT' END relevance, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
q AS (SELECT project, dim, x q FROM v JOIN (SELECT label, min(vec_id) m FROM embeddings GROUP BY 1) f ON v.project = f.label AND v.vec_id = f.m),
m AS (SELECT project, dim, sum(w * a) d FROM (SELECT project, dim, relevance, avg(x) a, CASE relevance WHEN 'HIGH' THEN 0.75 WHEN 'PARTIAL' THEN 0.35 ELSE -0.15 END::DOUBLE w FROM v GROUP BY ALL) GROUP BY ALL)
SELECT q.project, q.dim, round(q + d, 6) AS value FROM q JOIN m ON q.project = m.project AND q.dim = m.dim""")
def rocchio_query(spark, d):
    e = table(spark, d, "embeddings")
    rel = F.when(F.col("vec_id") % 3 == 0, "HIGH").when(F.col("vec_id") % 3 == 1, "PARTIAL").otherwise("IRRELEVANT")
    first = e.groupBy(F.col("label").alias("project")).agg(F.min_by("embedding", "vec_id").alias("v"))
    out = calibration.rocchio(first, e.select(F.col("label").alias("project"), rel.alias("relevance"), F.col("embedding").alias("v")))
    return out.select("project", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


TERMS = "(SELECT DISTINCT paper_id, CASE WHEN year >= 2018 THEN 'HIGH' ELSE 'IRRELEVANT' END relevance, unnest(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) term FROM paper_records WHERE title IS NOT NULL AND year IS NOT NULL)"


@query("term_shift", f"""
WITH t AS (SELECT DISTINCT * FROM {TERMS} WHERE term <> ''), c AS (SELECT count(DISTINCT paper_id) FILTER (WHERE relevance = 'HIGH') h, count(DISTINCT paper_id) FILTER (WHERE relevance = 'IRRELEVANT') i FROM t),
s AS (SELECT term, count(*) FILTER (WHERE relevance = 'HIGH') liked, count(*) FILTER (WHERE relevance = 'IRRELEVANT') disliked FROM t GROUP BY term),
o AS (SELECT term, liked, disliked, ln((liked + 0.5::DOUBLE) / (h - liked + 0.5::DOUBLE)) - ln((disliked + 0.5::DOUBLE) / (i - disliked + 0.5::DOUBLE)) w FROM s, c)
SELECT term, liked, disliked, round(w, 6) AS weight FROM o WHERE w <= 0 OR term NOT IN (SELECT word FROM common_words WHERE word IS NOT NULL)""")
def term_shift(spark, d):
    """Papers from 2018 on stand for liked ones."""
    p = table(spark, d, "paper_records").where("title IS NOT NULL AND year IS NOT NULL")
    t = p.select("paper_id", F.when(F.col("year") >= 2018, "HIGH").otherwise("IRRELEVANT").alias("relevance"), F.explode(X.tokens(F.lower("title"))).alias("term"))
    return calibration.term_shift(t, table(spark, d, "common_words").select(F.col("word").alias("term"))).select("term", "liked", "disliked", F.round("weight", 6).alias("weight"))


@query("branch_budget", f"""
SELECT project, branch, round(0.1::DOUBLE + (1 - 0.1::DOUBLE * n) * CASE WHEN total > 0 THEN useful / total ELSE 1.0::DOUBLE / n END, 6) AS share
FROM (SELECT *, count(*) OVER (PARTITION BY project) n, sum(useful) OVER (PARTITION BY project) total FROM (SELECT user_id project, {BRANCH} branch, count(*) FILTER (WHERE value > 10)::DOUBLE useful FROM events GROUP BY ALL))""")
def branch_budget(spark, d):
    useful = table(spark, d, "events").groupBy(F.col("user_id").alias("project"), F.expr(BRANCH).alias("branch")).agg(F.count_if(F.col("value") > 10).alias("useful"))
    return calibration.branch_budget(useful).select("project", "branch", F.round("share", 6).alias("share"))


@query("final_merge", f"""
SELECT project, paper_id, round, row_number() OVER (PARTITION BY project ORDER BY round, j) AS position FROM (SELECT *, row_number() OVER (PARTITION BY project, round ORDER BY rank, paper_id) j FROM {ROUNDS}) WHERE round = 2 OR j <= 5
QUALIFY position <= 10""")
def final_merge(spark, d):
    out = calibration.final_merge(rounds(spark, d).select("project", "round", "rank", "paper_id"))
    return out.select("project", "paper_id", "round", F.col("position").cast("long").alias("position"))


def _round_metrics(spark, d):
    r = rounds(spark, d).withColumn("run", F.struct("project", "round"))
    j = r.select("run", "rank", "paper_id", "relevance")
    fresh = metrics.new_useful(r, 10)
    return (
        metrics.precision_at_k(j, 10, True).join(metrics.ndcg_at_k(j, 10), "run")
        .join(metrics.coverage(r.where("rank <= 10").select("run", F.col("event_type").alias("slot"))), "run", "left")
        .select("run.project", "run.round", "precision", "ndcg", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.lit(0.0).alias("hallucination")).join(fresh, "project")
    )


@query("project_gates")
def project_gates(spark, d):
    return calibration.gates(_round_metrics(spark, d))


@query("go_no_go")
def go_no_go(spark, d):
    return calibration.overall(calibration.gates(_round_metrics(spark, d)))


@query("flagship_ranking", f"SELECT p.run, strict, inclusive, ndcg FROM ({PRECISION_SQL}) p JOIN ({NDCG_SQL}) n ON p.run = n.run")
def flagship_ranking(spark, d):
    return precision_at_k(spark, d).join(ndcg_at_k(spark, d), "run")
