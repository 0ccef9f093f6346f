"""Similarity, reranking, scores and selection of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

# Parts of the total score.
SCORE = {"rerank": 0.35, "dense": 0.25, "concept": 0.15, "branch": 0.10, "slot": 0.10, "metadata": 0.05}
SELECTION_VERSION = "selection-1"  # ours: sizes of penalty and bonus are not given by the specification
PENALTY, BONUS = 0.20, 0.10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def nearest_to_queries(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, cosine, rank): the k vectors nearest to each given query vector, ties by id.

    ``queries`` is the stated small side (one row a question) and is broadcast; ``vectors`` is scanned once. A
    per-task top k (window over a salt) bounds what is shuffled. Vectors of another length than the query, null or
    zero ones have no cosine and no row.
    """
    q = queries.select(F.col("id").alias("query"), F.col("v").alias("qv"))
    scored = vectors.join(F.broadcast(q), F.size("v") == F.size("qv")).select("query", "id", cosine(F.col("v"), F.col("qv")).alias("cosine")).where("cosine IS NOT NULL AND id <> query")
    salted = Window.partitionBy("query", "salt").orderBy(F.desc("cosine"), "id")
    best = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("i", F.row_number().over(salted)).where(F.col("i") <= k)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "cosine", "rank")


def norm_audit(vectors: DataFrame) -> DataFrame:
    """One row: vectors, and those whose length is not 1 within 1e-3."""
    n = norm(F.col("v"))
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(F.coalesce(F.abs(n - 1) > 1e-3 * F.greatest(n, F.lit(1.0)), F.lit(True))).alias("not_unit"))


def window_size(configured: int, available: int) -> int:
    if not 50 <= configured <= 100:
        raise ValueError("the rerank window is 50 to 100")
    return min(configured, available)


def rerank(candidates: DataFrame, k: int = 50) -> DataFrame:
    """(query, id, raw_score, normalized_score, rank) of the first k candidates of each query in input order.

    The score is given (``raw``). The whole scored set of a query is scaled to 0..1 at once; if all scores are equal
    they become 1. A null or non-finite score fails the query: it has no rows.
    """
    w = Window.partitionBy("query").orderBy("pos", "id")
    first = candidates.withColumn("i", F.row_number().over(w)).where(F.col("i") <= window_size(k, k))
    per = Window.partitionBy("query")
    finite = F.col("raw").isNotNull() & ~F.isnan("raw") & (F.abs("raw") < float("inf"))
    lo, hi = F.min("raw").over(per), F.max("raw").over(per)
    scored = first.withColumn("ok", F.min(finite.cast("int")).over(per)).where("ok = 1").withColumn("s", F.when(hi == lo, 1.0).otherwise((F.col("raw") - lo) / F.nullif(hi - lo, F.lit(0.0))))
    order = Window.partitionBy("query").orderBy(F.desc("raw"), "id")
    return scored.select("query", "id", F.col("raw").alias("raw_score"), F.col("s").alias("normalized_score"), F.row_number().over(order).alias("rank"))


def cached(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (id, key): a miss key is listed once, however many inputs share it."""
    known = cache.select("key").distinct()
    return inputs.join(known, "key", "left_semi"), inputs.join(known, "key", "left_anti").groupBy("key").agg(F.min("id").alias("id"))


def embed(inputs: DataFrame, provider, dimensions: int) -> DataFrame:
    """(key, vector) of (key, text) by a batch provider texts -> vectors, loaded once a worker; every key is computed once."""
    def run(batches):
        for pdf in batches:
            vectors = provider(list(pdf.text))
            if len(vectors) != len(pdf) or any(len(v) != dimensions for v in vectors):
                raise ValueError("the provider broke its contract")
            yield pd.DataFrame({"key": pdf.key, "vector": [list(map(float, v)) for v in vectors]})

    return inputs.groupBy("key").agg(F.min("text").alias("text")).mapInPandas(run, "key string, vector array<double>")


def total_score(parts: DataFrame) -> DataFrame:
    """The parts with ``score``; a missing part makes the score null and ``complete`` false, never 0."""
    total = sum((F.col(c) * w for c, w in SCORE.items()), F.lit(0.0))
    complete = F.lit(True)
    for c in SCORE:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return parts.withColumn("complete", complete).withColumn("score", F.when(F.col("complete"), total))


def select_diverse(pool: pd.DataFrame, size: int) -> pd.DataFrame:
    """Greedy choice from at most 100 candidates of one question: score, less a penalty for a taken group, plus a bonus for a new slot."""
    left = pool.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")[:100]
    taken, groups, slots = [], set(), set()
    while left and len(taken) < size:
        worth = lambda r: r["score"] - PENALTY * (r["group"] in groups) + BONUS * (r["slot"] is not None and r["slot"] not in slots)
        best = min(left, key=lambda r: (-worth(r), r["id"]))
        left.remove(best)
        taken.append((best["question"], best["id"], len(taken) + 1, worth(best)))
        groups.add(best["group"])
        slots.add(best["slot"])
    return pd.DataFrame(taken, columns=["question", "id", "position", "worth"])


def selection(candidates: DataFrame, size: int = 15) -> DataFrame:
    """(question, id, position, worth): ``size`` diverse candidates of the 100 best of each question."""
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    best = candidates.where("score IS NOT NULL").withColumn("i", F.row_number().over(w)).where("i <= 100")
    cols = best.select("question", "id", "score", "group", "slot")
    return cols.groupBy("question").applyInPandas(lambda pdf: select_diverse(pdf.where(pdf.notna(), None), size), "question string, id string, position int, worth double")


def metadata_quality() -> Column:
    """Share of six descriptive fields that are present (our definition, version quality-1)."""
    have = lambda c: F.coalesce(F.length(X.collapse(F.col(c))) > 0, F.lit(False)).cast("int")
    return (have("title") + have("abstract") + have("doi") + have("url") + (F.coalesce(F.size("authors"), F.lit(0)) > 0).cast("int") + F.col("year").isNotNull().cast("int")) / 6
