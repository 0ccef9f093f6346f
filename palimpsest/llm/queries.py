"""The pN_ queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import canonical, components, encode, linkage, lookalikes, names, packing, quality, vectors
from palimpsest.runtime import Scratch, table


def p1_canonical(spark, d):
    return canonical.canonical_records(table(spark, d, "dedup_clusters"), table(spark, d, "paper_sources"))


def p1_found(spark, d):
    kept = canonical.survivors(table(spark, d, "dedup_clusters"), table(spark, d, "paper_sources"))
    return kept.where("members > 1 AND holders = 1 AND certain").select(
        "cluster_id", F.col("field").alias("field_name"), F.col("holder").alias("paper_id")
    )


def p2_normalized(spark, d):
    papers = table(spark, d, "paper_records").select("paper_id", "title").distinct()
    forms = lookalikes.one_form(papers, "title")
    return papers.join(forms, papers.title == forms.stored, "left").select("paper_id", F.col("form").alias("normalized_title"))


def p2_found(spark, d):
    return lookalikes.same_print(table(spark, d, "paper_records"), "paper_id", "title").toDF("paper_id_a", "paper_id_b")


def p5_found(spark, d):
    links = components.merge_links(table(spark, d, "dedup_decisions"))
    return components.connected_groups(links).toDF("paper_id", "group_id")


def p3_entities(spark, d):
    authors = table(spark, d, "paper_records").select(F.explode("authors").alias("name"))
    return names.entities(authors, "name")


def p3_found(spark, d):
    authors = table(spark, d, "paper_records").select(F.explode("authors").alias("name"))
    return names.same_entity(authors, "name").toDF("name_a", "name_b")


def p4_links(spark, d):
    linked = linkage.link(table(spark, d, "paper_records"), table(spark, d, "catalog_records"), "paper_id", "catalog_no")
    return linked.select(F.col("l").alias("paper_id"), F.col("r").cast("long").alias("catalog_no"), "confidence")


def p4_found(spark, d):
    return p4_links(spark, d).select("paper_id", "catalog_no")


P5_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT left_paper_id a, right_paper_id b FROM dedup_decisions
  WHERE lower(regexp_replace(action, '^\\s+|\\s+$', '', 'g')) = 'auto_merge' AND left_paper_id <> right_paper_id),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM reach r JOIN g ON r.b = g.a)
SELECT a AS paper_id, min(b) AS group_id FROM reach GROUP BY a
"""


def p6_neighbours(spark, d):
    return vectors.nearest(table(spark, d, "vector_snapshot"), "input_id", "vector").toDF("input_id", "neighbour_id", "cosine")


def p6_found(spark, d):
    near = vectors.nearest(table(spark, d, "vector_snapshot"), "input_id", "vector").where("cosine >= 0.9")
    return near.select(F.least("a", "b").alias("input_id_a"), F.greatest("a", "b").alias("input_id_b")).distinct()


P6_SQL = """
WITH ok AS (
  SELECT input_id, min(vector) v FROM vector_snapshot
  WHERE input_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY input_id),
s AS (SELECT a.input_id a, b.input_id b, round(list_cosine_similarity(a.v, b.v), 12) c FROM ok a JOIN ok b ON a.input_id <> b.input_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) n FROM s)
SELECT DISTINCT least(a, b) AS input_id_a, greatest(a, b) AS input_id_b FROM r WHERE n <= 5 AND c >= 0.9
"""


def p7_ids(spark, d):
    return encode.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_packing(spark, d):
    """(budget_name, doc_id, part, tokens, container_id) for the capacity of every row of pack_budgets."""
    sizes = encode.encode_column(table(spark, d, "documents"), "doc_id", "text", only_count=True)
    sizes = Scratch(spark, "sizes").cut(sizes, "tokens")
    budgets = table(spark, d, "pack_budgets").where("capacity_tokens > 0").select("budget_name", "capacity_tokens").distinct()
    out = None
    for b in budgets.orderBy("budget_name", "capacity_tokens").collect():  # a few capacities
        one = packing.pack(sizes, "doc_id", "tokens", b["capacity_tokens"]).select(
            F.lit(b["budget_name"]).alias("budget_name"), "doc_id", "part", "tokens", "container_id"
        )
        out = one if out is None else out.union(one)
    return out


def p9_quality(spark, d):
    return quality.outlierness(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))


def p9_found(spark, d):
    far = quality.outlierness(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))
    return far.where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p1_canonical, p1_found, p2_normalized, p2_found, p3_entities, p3_found, p4_links, p4_found, p5_found, p6_neighbours, p6_found, p7_ids, p8_packing, p9_quality, p9_found)}
SQL = {"p5_found": P5_SQL, "p6_found": P6_SQL}
