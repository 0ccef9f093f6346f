"""Checks that return their violations, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of the fields that differ, null equal to null; a row on one side only says so. Keys must be unique."""
    a = before.select(F.col(key), F.struct(*fields).alias("a"))
    b = after.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]))
    out = F.when(F.col("a").isNull(), F.array(F.lit("ADDED"))).when(F.col("b").isNull(), F.array(F.lit("REMOVED"))).otherwise(changed)
    return both.select(key, out.alias("changed")).where(F.size("changed") > 0)


def one_to_one(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, problem) where a provider left out an input, made one up, or answered twice."""
    a, b = inputs.groupBy(key).agg(F.count("*").alias("asked")), outputs.groupBy(key).agg(F.count("*").alias("got"))
    problem = F.when(F.col("got").isNull(), "MISSING").when(F.col("asked").isNull(), "INVENTED").when(F.col("got") > 1, "REPEATED")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def cluster_violations(clusters: DataFrame) -> DataFrame:
    """(cluster_id, problem): repeated ids, and members that their canonical record is not among."""
    twice = clusters.groupBy("cluster_id").count().where("count > 1").select("cluster_id", F.lit("REPEATED_CLUSTER").alias("problem"))
    stray = clusters.where("canonical_record IS NOT NULL").where(~F.exists("member_records", lambda m: m["paper_id"] == F.col("canonical_record.paper_id")))
    return twice.union(stray.select("cluster_id", F.lit("CANONICAL_NOT_MEMBER"))).distinct()


def decision_violations(decisions: DataFrame) -> DataFrame:
    """(problem, n) over raw decisions: unsorted or equal sides, null sides, unknown actions."""
    action = F.lower(F.trim("action"))
    found = F.array_compact(F.array(
        F.when(F.col("left_paper_id").isNull() | F.col("right_paper_id").isNull(), "NULL_SIDE"), F.when(F.col("left_paper_id") == F.col("right_paper_id"), "SAME_PAPER"),
        F.when(F.col("left_paper_id") > F.col("right_paper_id"), "UNSORTED"), F.when(~F.coalesce(action.isin("auto_merge", "manual_review", "keep_separate"), F.lit(False)), "ACTION"),
    ))
    return decisions.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def run_metrics(papers: DataFrame) -> DataFrame:
    """One row of coverage ratios over papers; 0 for an empty run."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return papers.agg(
        F.count("*").alias("papers"), share(F.length(F.trim("source_id")) > 0).alias("source_id_coverage"), share(F.col("url").rlike("^https?://")).alias("url_coverage"),
        share(F.length(F.trim("abstract")) > 0).alias("abstract_coverage"), share(F.size("authors") > 0).alias("author_coverage"), share(F.col("year").isNotNull()).alias("year_coverage"),
    )
