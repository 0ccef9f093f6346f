"""Query planning in batch: intents to twelve boolean queries each, exclusions, gaps and clarification questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

VERSION = "m1-t01.v2"
# Branches with their weights, bridge terms, synonyms of search terms.
BRANCHES = {"DIRECT_INTERSECTION": 0.35, "PROBLEM_DOMAIN": 0.25, "METHOD_DOMAIN": 0.20, "BRIDGE_DOMAIN": 0.20}
BREADTHS = ("NARROW", "MEDIUM", "WIDE")
BRIDGE = ("application", "adaptation", "transfer", "framework", "methodology", "benchmark")
SYNONYMS = {"transfer learning": "domain adaptation", "radiation shielding": "radiation protection", "design": "optimization", "nuclear engineering": "nuclear technology"}
QUESTION = r"^how can (.+?) support (.+?)\?$"
INTENT_FIELDS = ("OBJECT", "TASK", "METHOD", "SCOPE", "ACCEPTED_PAPER_ROLES", "EXCLUSIONS")


def intents(questions: DataFrame) -> DataFrame:
    """(question_id, object, task, method, scope) read from "how can <method> support <task>?"; other questions have no row.

    Method and task need two words each; the object is the task without its last word.
    """
    q = X.fold_ascii(F.col("question"))
    method, task = F.regexp_extract(q, QUESTION, 1), F.regexp_extract(q, QUESTION, 2)
    words = lambda c: F.split(c, " ")
    body = F.array_join(F.slice(words(task), 1, F.greatest(F.size(words(task)) - 1, F.lit(0))), " ")
    return questions.where((F.size(words(method)) >= 2) & (F.size(words(task)) >= 2)).select(
        "question_id",
        F.array_distinct(F.concat(F.array(body), words(body))).alias("object"), F.array(F.element_at(words(task), -1)).alias("task"),
        F.array_distinct(F.concat(F.array(method), words(method))).alias("method"), F.array(F.lit("support"), task).alias("scope"),
    )


def _with_synonyms(terms: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.array_distinct(F.concat(terms, F.array_compact(F.transform(terms, lambda t: F.element_at(table, t)))))


def plan(intent: DataFrame) -> DataFrame:
    """Twelve rows an intent: branch, breadth, weight, groups, query_text, query_id. Synonyms widen MEDIUM and WIDE only."""
    wide = {c: _with_synonyms(F.col(c)) for c in ("object", "task", "method", "scope")}
    base = intent.select("question_id", "object", "task", "method", "scope", *[v.alias(f"{c}_x") for c, v in wide.items()])
    one = lambda c: F.array(F.col(c)[0])
    o, t, m, s = (F.col(f"{c}_x") for c in ("object", "task", "method", "scope"))
    b = F.array(*map(F.lit, BRIDGE))
    groups = {
        ("DIRECT_INTERSECTION", "NARROW"): (one("object"), one("task"), one("method")),
        ("DIRECT_INTERSECTION", "MEDIUM"): (o, t, m),
        ("DIRECT_INTERSECTION", "WIDE"): (o, F.concat(t, m)),
        ("PROBLEM_DOMAIN", "NARROW"): (one("object"), one("task"), one("scope")),
        ("PROBLEM_DOMAIN", "MEDIUM"): (o, t, s),
        ("PROBLEM_DOMAIN", "WIDE"): (o, F.concat(t, s)),
        ("METHOD_DOMAIN", "NARROW"): (one("method"), one("task")),
        ("METHOD_DOMAIN", "MEDIUM"): (m, t),
        ("METHOD_DOMAIN", "WIDE"): (m,),
        ("BRIDGE_DOMAIN", "NARROW"): (one("object"), one("task"), one("method"), F.array(F.lit(BRIDGE[0]))),
        ("BRIDGE_DOMAIN", "MEDIUM"): (o, m, b),
        ("BRIDGE_DOMAIN", "WIDE"): (F.concat(o, t), F.concat(m, b)),
    }
    cells = [
        F.struct(F.lit(br).alias("branch"), F.lit(wd).alias("breadth"), F.lit(BRANCHES[br] / 3).alias("weight"), F.array(*[F.array_distinct(g) for g in gs]).alias("groups"))
        for (br, wd), gs in groups.items()
    ]
    out = base.select("question_id", F.explode(F.array(*cells)).alias("c")).select("question_id", "c.*").withColumn("query_text", X.clause(F.col("groups")))
    ident = F.to_json(F.array("question_id", "branch", "breadth", "query_text", F.lit(VERSION)))
    return out.withColumn("query_id", F.concat(F.lit("Q1-"), F.substring(F.sha2(ident, 256), 1, 16)))


def plan_violations(planned: DataFrame) -> DataFrame:
    """(question_id, problem) where a plan has not twelve distinct queries, weights of 1, or a term twice in a query."""
    per = planned.groupBy("question_id").agg(F.count_distinct("query_id").alias("n"), F.sum("weight").alias("w"), F.max(F.size(F.flatten("groups")) - F.size(F.array_distinct(F.flatten("groups")))).alias("twice"))
    bad = F.array_compact(F.array(F.when(F.col("n") != 12, "QUERY_COUNT"), F.when(F.abs(F.col("w") - 1) > 1e-9, "WEIGHTS"), F.when(F.col("twice") > 0, "REPEATED_TERM")))
    return per.select("question_id", F.explode(bad).alias("problem"))


def exclude(terms: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of (project, term): a term goes if its folded form equals an excluded one, never by containing it."""
    fold = lambda df: df.withColumn("key", X.fold_ascii(F.col("term")))
    out = fold(exclusions).select("project", "key").distinct()
    return fold(terms).join(out, ["project", "key"], "left_anti").select("project", "term"), fold(terms).join(out, ["project", "key"], "left_semi").select("project", "term")


def gaps(fields: DataFrame) -> DataFrame:
    """(project, field, missing, priority, question) of (project, field, missing, confidence); exclusions are no gap.

    priority = .65 + .35 (1 - confidence) of a missing field, unknown confidence being .5; a field that is given has
    priority 0 and is never asked. Of the missing ones the three first are asked.
    """
    order = F.array_position(F.array(*map(F.lit, INTENT_FIELDS)), F.col("field"))
    pr = F.when(F.col("missing"), 0.65 + 0.35 * (1 - F.coalesce("confidence", F.lit(0.5)))).otherwise(0.0)
    w = Window.partitionBy("project").orderBy(F.desc("priority"), "pos")
    return fields.where("field <> 'EXCLUSIONS'").withColumn("priority", pr).withColumn("pos", order).withColumn("rank", F.row_number().over(w)).select(
        "project", "field", "missing", "priority", (F.coalesce("missing", F.lit(False)) & (F.col("rank") <= 3)).alias("asked")
    )
