"""Caches as tables: keyed by a digest of everything an answer depends on, looked up by joins, appended atomically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(**parts: Column) -> Column:
    """SHA-256 over compact JSON of named parts, sorted by name; a null part counts as null."""
    return F.sha2(F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def response_key(query: Column, most: int, endpoint: str, namespace: str) -> Column:
    return key(endpoint=F.lit(endpoint), max_results=F.lit(most), namespace=F.lit(namespace), query_text=query, schema=F.lit(1))


def embedding_key(descriptor: str, text_sha256: Column) -> Column:
    """Does not depend on who asks: equal texts share a vector."""
    return key(descriptor=F.lit(descriptor), text_sha256=text_sha256)


def rerank_key(descriptor: str, query_sha256: Column, paper_id: Column, text_sha256: Column) -> Column:
    """Depends on the paper, unlike an embedding's key."""
    return key(descriptor=F.lit(descriptor), paper_id=paper_id, query_sha256=query_sha256, text_sha256=text_sha256)


def read(asked: DataFrame, cache: DataFrame, valid: Column) -> DataFrame:
    """``asked`` with ``answer`` (null for a miss); entries that are not valid, and all but the newest of a key, do not count.

    asked: (key, ...); cache: (key, answer, stored_at).
    """
    newest = cache.where(valid).groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return asked.join(newest, "key", "left")


def audit(planned: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: planned keys, those without an entry, those whose entry is empty."""
    entries = cache.groupBy("key").agg(F.max(F.size("answer")).alias("n"))
    j = planned.select("key").distinct().join(entries, "key", "left")
    return j.agg(F.count("*").alias("planned"), F.count_if(F.col("n").isNull()).alias("absent"), F.count_if(F.col("n") == 0).alias("empty"))


def append(entries: DataFrame, path: str) -> None:
    """One commit: readers see all entries of a run or none."""
    entries.write.mode("append").parquet(path)
