"""Second round: feedback, Rocchio, shifted terms, branch budgets, merged result, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rocchio weights.
ROCCHIO = {"HIGH": 0.75, "PARTIAL": 0.35, "IRRELEVANT": -0.15}
FLOOR = 0.10  # least share of a branch (ours, budget-1)
LABELS = ("HIGH", "PARTIAL", "IRRELEVANT")
ENOUGH = 6


def feedback_state(feedback: DataFrame) -> DataFrame:
    """(project, valid, conflicts, may_start): a paper labelled differently is a conflict and not valid; six valid ones are needed.

    Unknown labels and null papers count for nothing; a repeated label counts once.
    """
    known = feedback.where(F.col("relevance").isin(*LABELS) & F.col("paper_id").isNotNull())
    per = known.groupBy("project", "paper_id").agg(F.count_distinct("relevance").alias("n"))
    return per.groupBy("project").agg(F.count_if(F.col("n") == 1).alias("valid"), F.count_if(F.col("n") > 1).alias("conflicts")).withColumn("may_start", F.col("valid") >= ENOUGH)


def rocchio(query: DataFrame, judged: DataFrame) -> DataFrame:
    """(project, dim, value): q + .75 mean(HIGH) + .35 mean(PARTIAL) - .15 mean(IRRELEVANT), by dimension.

    A class without papers adds nothing. query: (project, v); judged: (project, relevance, v).
    """
    q = query.select("project", F.posexplode("v").alias("dim", "x")).groupBy("project", "dim").agg(F.sum(F.col("x").cast("double")).alias("q"))
    j = judged.where(F.col("relevance").isin(*LABELS)).select("project", "relevance", F.posexplode("v").alias("dim", "x"))
    mean = j.groupBy("project", "dim", "relevance").agg(F.avg(F.col("x").cast("double")).alias("m"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ROCCHIO.items() for x in kv]), F.col("relevance"))
    move = mean.groupBy("project", "dim").agg(F.sum(weight * F.col("m")).alias("d"))
    return q.join(move, ["project", "dim"], "left").select("project", "dim", (F.col("q") + F.coalesce("d", F.lit(0.0))).alias("value"))


def term_shift(terms: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(term, liked, disliked, weight): smoothed log-odds of a term in HIGH against IRRELEVANT papers; excluded terms never rise.

    terms: (paper_id, relevance, term); a paper counts a term once.
    """
    t = terms.where("relevance IN ('HIGH', 'IRRELEVANT') AND term IS NOT NULL").select("paper_id", "relevance", "term").distinct()
    n = t.groupBy("term").agg(F.count_if(F.col("relevance") == "HIGH").alias("liked"), F.count_if(F.col("relevance") == "IRRELEVANT").alias("disliked"))
    total = t.agg(F.count_distinct(F.when(F.col("relevance") == "HIGH", F.col("paper_id"))).alias("h"), F.count_distinct(F.when(F.col("relevance") == "IRRELEVANT", F.col("paper_id"))).alias("i"))
    odds = F.log((F.col("liked") + 0.5) / (F.col("h") - F.col("liked") + 0.5)) - F.log((F.col("disliked") + 0.5) / (F.col("i") - F.col("disliked") + 0.5))
    scored = n.join(F.broadcast(total)).withColumn("weight", odds)  # total is one row
    barred = exclusions.select("term").distinct().withColumn("barred", F.lit(True))
    return scored.join(barred, "term", "left").where("barred IS NULL OR weight <= 0").select("term", "liked", "disliked", "weight")


def branch_budget(useful: DataFrame) -> DataFrame:
    """(project, branch, share) of (project, branch, useful): every branch keeps FLOOR, the rest follows its useful papers."""
    w = Window.partitionBy("project")
    n, total = F.count("*").over(w), F.sum("useful").over(w)
    rest = F.when(total > 0, F.col("useful") / F.nullif(total, F.lit(0))).otherwise(F.lit(1.0) / n)
    return useful.select("project", "branch", (F.lit(FLOOR) + (1 - FLOOR * n) * rest).alias("share"))


def final_merge(rounds: DataFrame, keep: int = 5, most: int = 10) -> DataFrame:
    """(project, paper_id, round, position): up to ``keep`` of round 1, then new ones of round 2, ``most`` in all.

    rounds: (project, round, rank, paper_id); a paper of both rounds counts as one of round 1.
    """
    first = Window.partitionBy("project", "paper_id").orderBy("round", "rank")
    once = rounds.withColumn("i", F.row_number().over(first)).where("i = 1")
    per = Window.partitionBy("project", "round").orderBy("rank", "paper_id")
    once = once.withColumn("j", F.row_number().over(per)).where((F.col("round") == 2) | (F.col("j") <= keep))
    out = Window.partitionBy("project").orderBy("round", "j")
    return once.withColumn("position", F.row_number().over(out)).where(F.col("position") <= most).select("project", "paper_id", "round", "position")


def gates(metrics: DataFrame) -> DataFrame:
    """One row a project of (project, round, precision, ndcg, coverage, new_useful, hallucination): each gate by itself."""
    v = lambda c, r: F.max(F.when(F.col("round") == r, F.col(c)))
    w = metrics.groupBy("project").agg(*[v(c, r).alias(f"{c}{r}") for c in ("precision", "ndcg", "coverage", "new_useful", "hallucination") for r in (1, 2)])
    return w.select(
        "project", (F.col("precision2") > F.col("precision1")).alias("precision_up"), (F.col("ndcg2") >= F.col("ndcg1")).alias("ndcg_kept"),
        (F.col("coverage2") >= F.col("coverage1")).alias("coverage_kept"), (F.col("new_useful2") >= 1).alias("new_useful"),
        (F.coalesce("hallucination2", F.lit(0.0)) == 0).alias("no_hallucination"), (F.col("precision2") - F.col("precision1")).alias("delta"),
    )


def overall(gated: DataFrame) -> DataFrame:
    """Go if seven of ten projects improve, the mean gain is .05, and nothing else got worse anywhere."""
    share = F.count_if("precision_up") / F.nullif(F.count("*"), F.lit(0))
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return gated.agg((F.coalesce(share, F.lit(0.0)) >= 0.7).alias("improved"), (F.coalesce(F.avg("delta"), F.lit(0.0)) >= 0.05).alias("gain"), every("ndcg_kept").alias("ndcg"), every("coverage_kept").alias("coverage"), every("no_hallucination").alias("grounded"))
