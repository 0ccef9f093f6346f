"""Queries over papers: projections, identifiers, model inputs, deduplication, evidence, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import audit, dedup, evidence, planning, ranking
from palimpsest.plans.catalogue import query
from palimpsest.runtime import Scratch, spread, table

PAPER = ("paper_id", "source", "source_id", "title", "abstract", "authors", "year", "doi", "url", "language", "retrieval_paths", "user_visible")
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"  # RE2's \s is ASCII only


def records(spark, d):
    return table(spark, d, "paper_records").select(*PAPER)


def observations(spark, d):
    return Scratch(spark, "observations").cut(dedup.coalesce_observations(records(spark, d)), "papers")


@query("papers_projection", f"""
SELECT DISTINCT paper_id, title, CASE WHEN trim(regexp_replace(abstract, '{BLANK}', ' ', 'g')) <> '' THEN abstract END AS abstract FROM paper_records""")
def papers_projection(spark, d):
    return records(spark, d).select("paper_id", "title", X.abstract_or_null(F.col("abstract")).alias("abstract")).distinct()


@query("normalize_titles", """
SELECT paper_id, n AS normalized_title, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS tokens
FROM (SELECT DISTINCT paper_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) n FROM paper_records WHERE title IS NOT NULL)""")
def normalize_titles(spark, d):
    low = F.lower("title")
    return table(spark, d, "paper_records").where("title IS NOT NULL").select("paper_id", X.tokens_only(low).alias("normalized_title"), F.size(X.tokens(low)).alias("tokens")).distinct()


@query("canonical_doi", """
SELECT DISTINCT paper_id, CASE WHEN regexp_full_match(b, '10\\.\\d{4,9}/\\S+') THEN b END AS doi
FROM (SELECT paper_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(doi, '\\s+', ' ', 'g'))), '^(https://dx\\.doi\\.org/|https://doi\\.org/|http://doi\\.org/|doi:)', ''), '[.,;:)\\]}>"'']+$', '') b FROM paper_records)""")
def canonical_doi(spark, d):
    return table(spark, d, "paper_records").select("paper_id", X.canonical_doi(X.fold_ascii(F.col("doi"))).alias("doi")).distinct()


@query("canonical_source_id", """
SELECT DISTINCT paper_id, coalesce(CASE WHEN source = 'arxiv' AND regexp_full_match(source_id, '(\\d{4}\\.\\d{4,5}|[a-z-]+(\\.[A-Z]{2})?/\\d{7})(v[1-9]\\d*)?') THEN regexp_replace(source_id, 'v\\d+$', '') END, source_id) AS source_id
FROM paper_records""")
def canonical_source_id(spark, d):
    return table(spark, d, "paper_records").select("paper_id", F.coalesce(X.canonical_arxiv_id(F.col("source"), F.col("source_id")), "source_id").alias("source_id")).distinct()


@query("url_identity", """
SELECT paper_id, host, count(*) AS n FROM (SELECT paper_id, regexp_extract(url, '^https?://([^/?#]+)', 1) host FROM paper_records WHERE url IS NOT NULL) GROUP BY ALL""")
def url_identity(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, d, "paper_records").where("url IS NOT NULL").groupBy("paper_id", host.alias("host")).agg(F.count("*").alias("n"))


def stripped(sql: str) -> str:
    """SQL that takes white space of any kind off both ends."""
    space = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"regexp_replace({sql}, '^{space}|{space}$', '', 'g')"


LINES_SQL = "replace({}, chr(13) || chr(10), chr(10))"
TITLE_SQL, ABSTRACT_SQL = stripped(LINES_SQL.format("title")), stripped(LINES_SQL.format("coalesce(abstract, '')"))


@query("embedding_text_hash", f"""
SELECT DISTINCT paper_id, sha256('title:' || chr(10) || t || CASE WHEN a <> '' THEN chr(10) || chr(10) || 'abstract:' || chr(10) || a ELSE '' END) AS text_sha256
FROM (SELECT paper_id, {TITLE_SQL} t, {ABSTRACT_SQL} a FROM paper_records) WHERE t <> '' AND lower(a) NOT IN ('no abstract', 'not provided', 'no abstract available')""")
def embedding_text_hash(spark, d):
    body = X.paper_text(F.col("title"), F.col("abstract"))
    return table(spark, d, "paper_records").select("paper_id", F.sha2(body, 256).alias("text_sha256")).where("text_sha256 IS NOT NULL").distinct()


@query("query_text_hash", f"SELECT query_id, 'query:' || sha256('query:' || chr(10) || q) AS input_id FROM (SELECT query_id, {stripped(LINES_SQL.format('query_text'))} q FROM search_queries) WHERE q <> ''")
def query_text_hash(spark, d):
    body = X.query_text(F.col("query_text"))
    return table(spark, d, "search_queries").where(body.isNotNull()).select("query_id", F.concat(F.lit("query:"), F.sha2(body, 256)).alias("input_id"))


@query("source_text_hash", f"""
SELECT DISTINCT paper_id, CASE WHEN t <> '' AND coalesce(a <> '', true) THEN sha256(json_object('abstract', a, 'title', t)::VARCHAR) END AS source_text_sha256
FROM (SELECT paper_id, {stripped("replace(" + LINES_SQL.format("title") + ", chr(13), chr(10))")} t, {stripped("replace(" + LINES_SQL.format("abstract") + ", chr(13), chr(10))")} a FROM paper_records)""")
def source_text_hash(spark, d):
    return table(spark, d, "paper_records").select("paper_id", X.source_hash(F.col("title"), F.col("abstract")).alias("source_text_sha256")).distinct()


@query("fake_embedding", """
SELECT query_id, i AS dim, round(('0x' || substr(sha256(encode(query_text) || from_hex(lpad(hex(i // 8), 16, '0'))), (i % 8) * 8 + 1, 8))::UBIGINT / 4294967296.0::DOUBLE, 9) AS value
FROM search_queries, range(16) r(i)""")
def fake_embedding(spark, d):
    v = X.hashed_vector(F.col("query_text"), "")
    return table(spark, d, "search_queries").select("query_id", F.posexplode(v).alias("dim", "value")).select("query_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


@query("retrieval_paths_union", """
SELECT paper_id, array_to_string(list_sort(list_distinct(flatten(list(retrieval_paths)))), ' ') AS paths, count(*) AS observations FROM paper_records GROUP BY paper_id""")
def retrieval_paths_union(spark, d):
    return records(spark, d).groupBy("paper_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("retrieval_paths")))), " ").alias("paths"), F.count("*").alias("observations")
    )


@query("coalesced_observations")
def coalesced_observations(spark, d):
    return dedup.coalesce_observations(records(spark, d)).select("paper_id", "title", "year", F.size("retrieval_paths").alias("paths"), "conflicting")


@query("candidate_pairs_blocked")
def candidate_pairs_blocked(spark, d):
    n = Scratch(spark, "pairs").cut(dedup.normalise(dedup.coalesce_observations(records(spark, d))), "papers")
    return dedup.candidate_pairs(n)


@query("pair_decisions")
def pair_decisions(spark, d):
    return dedup.all_decisions(records(spark, d))


@query("paper_clusters")
def paper_clusters(spark, d):
    return dedup.cluster(records(spark, d))[0]


@query("replay_diff", """
SELECT coalesce(a.paper_id, b.paper_id) AS paper_id,
  CASE WHEN a.paper_id IS NULL THEN 'ADDED' WHEN b.paper_id IS NULL THEN 'REMOVED' ELSE concat_ws(',', CASE WHEN a.t IS DISTINCT FROM b.t THEN 'title' END, CASE WHEN a.y IS DISTINCT FROM b.y THEN 'year' END) END AS changed
FROM (SELECT paper_id, min(title) t, min(year) y FROM paper_records GROUP BY 1) a
FULL JOIN (SELECT paper_id, min(normalized_title) t, min(year) y FROM paper_records WHERE normalized_title IS NOT NULL GROUP BY 1) b ON a.paper_id = b.paper_id
WHERE a.paper_id IS NULL OR b.paper_id IS NULL OR a.t IS DISTINCT FROM b.t OR a.y IS DISTINCT FROM b.y""")
def replay_diff(spark, d):
    """What an earlier run stored against what is there now: rows on one side, and differing fields."""
    p = table(spark, d, "paper_records")
    now = p.groupBy("paper_id").agg(F.min("title").alias("title"), F.min("year").alias("year"))
    old = p.where("normalized_title IS NOT NULL").groupBy("paper_id").agg(F.min("normalized_title").alias("title"), F.min("year").alias("year"))
    return audit.differences(now, old, "paper_id", ["title", "year"]).select("paper_id", F.array_join("changed", ",").alias("changed"))


@query("run_metrics", """
SELECT count(*) AS papers, round(avg((coalesce(length(trim(source_id)) > 0, false))::INT), 6) AS source_id_coverage, round(avg(coalesce(regexp_matches(url, '^https?://'), false)::INT), 6) AS url_coverage,
  round(avg(coalesce(length(trim(abstract)) > 0, false)::INT), 6) AS abstract_coverage, round(avg(coalesce(len(authors) > 0, false)::INT), 6) AS author_coverage, round(avg((year IS NOT NULL)::INT), 6) AS year_coverage
FROM paper_records""")
def run_metrics(spark, d):
    m = audit.run_metrics(table(spark, d, "paper_records"))
    return m.select("papers", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("cluster_audit", """
SELECT DISTINCT cluster_id, 'REPEATED_CLUSTER' AS problem FROM dedup_clusters GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT DISTINCT cluster_id, 'CANONICAL_NOT_MEMBER' FROM dedup_clusters WHERE canonical_record IS NOT NULL AND NOT list_contains(list_transform(member_records, lambda m: m.paper_id), canonical_record.paper_id)""")
def cluster_audit(spark, d):
    return audit.cluster_violations(table(spark, d, "dedup_clusters"))


@query("decision_audit", """
SELECT problem, count(*) AS n FROM (
  SELECT 'NULL_SIDE' problem FROM dedup_decisions WHERE left_paper_id IS NULL OR right_paper_id IS NULL
  UNION ALL SELECT 'SAME_PAPER' FROM dedup_decisions WHERE left_paper_id = right_paper_id
  UNION ALL SELECT 'UNSORTED' FROM dedup_decisions WHERE left_paper_id > right_paper_id
  UNION ALL SELECT 'ACTION' FROM dedup_decisions WHERE NOT coalesce(lower(trim(action)) IN ('auto_merge', 'manual_review', 'keep_separate'), false)) GROUP BY 1""")
def decision_audit(spark, d):
    return audit.decision_violations(table(spark, d, "dedup_decisions"))


@query("candidate_projection", """
SELECT cluster_id, canonical_record.paper_id AS paper_id, canonical_record.title AS title, len(list_distinct(retrieval_paths)) AS paths FROM (SELECT DISTINCT cluster_id, canonical_record, retrieval_paths FROM dedup_clusters WHERE canonical_record IS NOT NULL)""")
def candidate_projection(spark, d):
    return table(spark, d, "dedup_clusters").where("canonical_record IS NOT NULL").select(
        "cluster_id", "canonical_record.paper_id", "canonical_record.title", F.size(F.array_distinct("retrieval_paths")).alias("paths"), "canonical_record", "retrieval_paths"
    ).distinct().drop("canonical_record", "retrieval_paths")


def _whole(spark, d):
    return spread(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("text").alias("source"), F.col("text").alias("fragment"), F.lit(0).alias("offset")))


@query("marker_matches")
def marker_matches(spark, d):
    """Every document as one fragment: slots it hits, with score and specificity."""
    return evidence.matches(_whole(spark, d)).select("paper_id", "slot", "score", "specificity", "high", "generic", "marker")


def _any_sql(patterns):
    ascii_ones, other = "|".join(p for p in patterns if p.isascii()), "|".join(p for p in patterns if not p.isascii())
    return f"(regexp_matches(text, '(?i)\\b({ascii_ones})\\b') OR regexp_matches(text, '{other}'))"


@query("support_levels", f"""
SELECT doc_id, CASE WHEN {_any_sql(evidence.HYPOTHETICAL)} AND NOT {_any_sql(evidence.DIRECT)} THEN 'HYPOTHETICAL' WHEN {_any_sql(evidence.INDIRECT)} AND NOT {_any_sql(evidence.DIRECT)} THEN 'INDIRECT' ELSE 'DIRECT' END AS support_level
FROM documents WHERE text IS NOT NULL""")
def support_levels(spark, d):
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", evidence.support_level(F.col("text")).alias("support_level"))


def _classified(spark, d):
    one = records(spark, d).where("title IS NOT NULL").groupBy("paper_id").agg(F.min_by(F.struct("title", "abstract"), F.struct(F.col("abstract").isNull(), "abstract")).alias("r"))
    return evidence.classify(spread(one.select("paper_id", "r.title", X.abstract_or_null(F.col("r.abstract")).alias("abstract"))))


@query("evidence_slots")
def evidence_slots(spark, d):
    return _classified(spark, d)


@query("slot_histogram")
def slot_histogram(spark, d):
    return evidence.histogram(_classified(spark, d))


@query("quality_diagnostics")
def quality_diagnostics(spark, d):
    return evidence.diagnostics(_classified(spark, d))


def _questions(spark, d):
    """A question of every English title: its first three words as the method, its last three as the task."""
    t = table(spark, d, "paper_records").where("language = 'en' AND title IS NOT NULL").select("paper_id", X.tokens(F.lower("title")).alias("w")).where("size(w) >= 6").distinct()
    part = lambda i: F.array_join(F.slice("w", i, 3), " ")
    return t.select(F.col("paper_id").alias("question_id"), F.concat(F.lit("how can "), part(1), F.lit(" support "), part(-3), F.lit("?")).alias("question"))


@query("query_plan_cells")
def query_plan_cells(spark, d):
    return planning.plan(planning.intents(_questions(spark, d))).select("question_id", "branch", "breadth", "weight", "query_text", "query_id")


@query("query_weights", "SELECT branch, breadth, count(*) AS n, round(sum(weight), 6) AS weight, min(length(query_text)) AS shortest FROM search_queries GROUP BY ALL")
def query_weights(spark, d):
    return table(spark, d, "search_queries").groupBy("branch", "breadth").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.min(F.length("query_text")).alias("shortest"))


@query("exclusion_antijoin", """
SELECT DISTINCT query_id AS project, lower(term) AS term FROM (SELECT query_id, unnest(regexp_extract_all(query_text, '[A-Za-z-]+')) term FROM search_queries)
WHERE lower(term) NOT IN (SELECT lower(word) FROM common_words WHERE word IS NOT NULL)""")
def exclusion_antijoin(spark, d):
    found = F.explode(F.regexp_extract_all("query_text", F.lit("[A-Za-z-]+"), F.lit(0))).alias("term")
    terms = table(spark, d, "search_queries").select(F.col("query_id").alias("project"), found).select("project", F.lower("term").alias("term"))
    barred = terms.select("project").distinct().join(F.broadcast(table(spark, d, "common_words").select(F.lower("word").alias("term"))))  # a fixed list of words
    return planning.exclude(terms, barred)[0].distinct()


@query("metadata_quality", """
SELECT DISTINCT paper_id, round(((coalesce(trim(title) <> '', false))::INT + coalesce(trim(abstract) <> '', false)::INT + coalesce(trim(doi) <> '', false)::INT + coalesce(trim(url) <> '', false)::INT
  + (coalesce(len(authors), 0) > 0)::INT + (year IS NOT NULL)::INT) / 6.0::DOUBLE, 6) AS quality FROM paper_records""")
def metadata_quality(spark, d):
    return table(spark, d, "paper_records").select("paper_id", F.round(ranking.metadata_quality(), 6).alias("quality")).distinct()
