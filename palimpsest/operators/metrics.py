"""Retrieval metrics over judged rankings (run, rank, paper_id, relevance), and the stages of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grades of relevance, stages and their order.
GRADE = {"HIGH": 2, "PARTIAL": 1, "IRRELEVANT": 0}
STAGES = ("INIT", "CLARIFYING", "ROUND1_SEARCHING", "WAITING_FOR_FEEDBACK", "ROUND2_SEARCHING", "WAITING_FOR_DIRECTION_CONFIRMATION", "FINALIZED")
SLOT_COUNT = 5
OLD = 20  # places of round 1 that count as seen


def grade() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in GRADE.items() for x in kv]), F.col("relevance"))


def precision_at_k(judged: DataFrame, k: int, partial: bool = False) -> DataFrame:
    """(run, precision): useful among the first k, over k even if fewer were returned."""
    good = ("HIGH", "PARTIAL") if partial else ("HIGH",)
    return judged.groupBy("run").agg((F.count_if((F.col("rank") <= k) & F.col("relevance").isin(*good)) / k).alias("precision"))


def ndcg_at_k(judged: DataFrame, k: int) -> DataFrame:
    """(run, ndcg): gains of the first k against their own best order; 0 where nothing is relevant."""
    top = judged.where(F.col("rank") <= k).withColumn("g", grade())
    best = Window.partitionBy("run").orderBy(F.desc("g"), "rank")
    gain = lambda r: (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(r + 1)
    sums = top.withColumn("ideal", F.row_number().over(best)).groupBy("run").agg(F.sum(gain(F.col("rank"))).alias("d"), F.sum(gain(F.col("ideal"))).alias("i"))
    runs = judged.select("run").distinct()
    return runs.join(sums, "run", "left").select("run", F.coalesce(F.col("d") / F.nullif(F.col("i"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def coverage(slots: DataFrame) -> DataFrame:
    """(run, coverage): distinct evidence slots over five; null slots count for nothing."""
    return slots.groupBy("run").agg((F.count_distinct("slot") / SLOT_COUNT).alias("coverage"))


def suppression(rounds: DataFrame, k: int) -> DataFrame:
    """(project, suppression): share of irrelevant papers among the first k, round 1 less round 2."""
    bad = lambda r: F.count_if((F.col("round") == r) & (F.col("rank") <= k) & (F.col("relevance") == "IRRELEVANT")) / k
    return rounds.groupBy("project").agg((bad(1) - bad(2)).alias("suppression"))


def new_useful(rounds: DataFrame, k: int) -> DataFrame:
    """(project, new_useful): useful papers among the first k of round 2 that were not among the first 20 of round 1."""
    seen = rounds.where((F.col("round") == 1) & (F.col("rank") <= OLD)).select("project", "paper_id")
    fresh = rounds.where((F.col("round") == 2) & (F.col("rank") <= k) & F.col("relevance").isin("HIGH", "PARTIAL")).join(seen, ["project", "paper_id"], "left_anti")
    count = fresh.groupBy("project").agg(F.count_distinct("paper_id").alias("n"))
    return rounds.select("project").distinct().join(count, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("new_useful"))


def hallucination(confirmed: DataFrame) -> DataFrame:
    """One row: share of metadata not confirmed by the source; 0 for nothing. A null counts as not confirmed."""
    return confirmed.agg(F.coalesce(F.avg((~F.coalesce("confirmed", F.lit(False))).cast("double")), F.lit(0.0)).alias("rate"))


def label_violations(judged: DataFrame) -> DataFrame:
    """(run, problem): unknown labels, papers listed twice, and places below 1."""
    bad = judged.where(~F.coalesce(F.col("relevance").isin(*GRADE), F.lit(False))).select("run", F.lit("LABEL").alias("problem"))
    twice = judged.groupBy("run", "paper_id").count().where("count > 1").select("run", F.lit("REPEATED_PAPER").alias("problem"))
    return bad.union(twice).union(judged.where("rank < 1").select("run", F.lit("RANK").alias("problem"))).distinct()


def transition(requests: DataFrame) -> DataFrame:
    """Requests (current, target, feedback, actual) with ``result``: OK or the first error that applies.

    A stale view comes first, then a repeated step, the end state, an unknown step, and too little feedback.
    """
    follows = F.array_position(F.array(*map(F.lit, STAGES)), F.col("target")) == F.array_position(F.array(*map(F.lit, STAGES)), F.col("current")) + 1
    known = F.col("target").isin(*STAGES) & F.col("current").isin(*STAGES)
    return requests.withColumn("result", (
        F.when(~F.col("actual").eqNullSafe(F.col("current")), "STALE_STATE").when(F.col("target") == F.col("current"), "ALREADY_APPLIED")
        .when(F.col("current") == "FINALIZED", "FINALIZED_TERMINAL").when(~F.coalesce(known & follows, F.lit(False)), "INVALID_TRANSITION")
        .when((F.col("target") == "ROUND2_SEARCHING") & (F.coalesce("feedback", F.lit(0)) < 6), "INSUFFICIENT_FEEDBACK").otherwise("OK")
    ))


def request_gaps(events: DataFrame, by: str, at: str) -> DataFrame:
    """(by, min_gap_seconds): shortest pause between the starts of two requests; null for a single one."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(by).orderBy(at))
    return events.where(F.col(at).isNotNull()).withColumn("gap", gap).groupBy(by).agg((F.min("gap") / 1e6).alias("min_gap_seconds"))


def budgeted(found: DataFrame, per_query: int, total: int) -> DataFrame:
    """(run, seq, taken): results taken of each query in order, at most per_query and total in all."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = F.least(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)), F.lit(per_query))
    s = found.withColumn("want", want).withColumn("sum", F.sum("want").over(w))
    return s.select("run", "seq", F.greatest(F.lit(0), F.least("want", F.lit(total) - (F.col("sum") - F.col("want")))).cast("int").alias("taken"))
