"""Sinks: run reports, and tables that appear together with the manifest that describes them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import remove


def json_report(run: dict) -> str:
    return json.dumps(run, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def markdown_report(title: str, candidates: list[dict]) -> str:
    """Numbered candidates (a bounded list), with a word for what is missing."""
    out = [f"# {title}", ""]
    for i, c in enumerate(candidates, 1):
        out += [f"## {i}. {c.get('title') or 'Not provided'}", "", *(f"- {k}: {c.get(k) or 'Not provided'}" for k in ("authors", "year", "doi", "url", "abstract")), ""]
    return "\n".join(out) + "\n"


def manifest(papers: DataFrame) -> DataFrame:
    """One row about a snapshot: counts, present abstracts, hash over its sorted ids (a digest of fixed length is aggregated)."""
    identity = F.sha2(F.to_json(F.struct("paper_id", "source", "source_id")), 256)
    return papers.agg(
        F.count("*").alias("papers"), F.count_distinct("paper_id").alias("ids"), F.count_if(F.length(F.trim("abstract")) > 0).alias("abstracts"),
        F.coalesce(F.bit_xor(F.xxhash64(identity)), F.lit(0)).alias("identity_digest"),
    )


def publish(papers: DataFrame, path: str) -> None:
    """Write the snapshot, then its manifest: a reader that finds no manifest sees no snapshot. A failed write leaves nothing."""
    try:
        papers.write.mode("overwrite").parquet(f"{path}/papers")
        manifest(papers.sparkSession.read.parquet(f"{path}/papers")).write.mode("overwrite").parquet(f"{path}/manifest")
    except Exception:
        remove(papers.sparkSession, path)
        raise


def verify(spark, path: str) -> DataFrame:
    """The fields in which a snapshot differs from its manifest; empty if it is what was published."""
    told = spark.read.parquet(f"{path}/manifest")
    seen = manifest(spark.read.parquet(f"{path}/papers"))
    names = F.array(*map(F.lit, told.columns))
    a = told.select(F.explode(F.arrays_zip(names.alias("field"), F.array(*[F.col(c).cast("string") for c in told.columns]).alias("told"))).alias("x")).select("x.*")
    b = seen.select(F.explode(F.arrays_zip(names.alias("field"), F.array(*[F.col(c).cast("string") for c in seen.columns]).alias("seen"))).alias("x")).select("x.*")
    return a.join(b, "field").where(~F.col("told").eqNullSafe(F.col("seen")))
