"""Atom feeds of a preprint server as paper records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X

ENTRY = "struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>"


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """(query_id, problem, papers) of (query_id, body), one row a response.

    problem: MALFORMED for text that is no XML, INVALID_FEED for another root, API_ERROR for an error feed,
    INVALID_ENTRY if any entry lacks a valid id, title or abstract; papers is then null, since a page counts whole.
    Null and empty bodies are malformed; a feed without entries gives an empty array.
    """
    plain = F.regexp_replace("body", r"<(/?)\w+:", "<$1")
    root = F.regexp_extract("body", r"<(?:\?xml[^>]*\?>|!--.*?--|\s|<)*\s*([A-Za-z][\w.-]*)", 1)
    options = {"rowTag": "feed", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
    f = feeds.select("query_id", "body", root.alias("root"), F.from_xml(plain, f"entry array<{ENTRY}>, _bad string", options).alias("f"))
    entries = F.coalesce("f.entry", F.array().cast(f"array<{ENTRY}>"))
    clean = lambda c: X.collapse(F.coalesce(c, F.lit("")))
    read = F.transform(entries, lambda e: F.struct(
        X.arxiv_id_of_url(clean(e["id"])).alias("sid"), clean(e["id"]).alias("url"), clean(e["title"]).alias("title"), clean(e["summary"]).alias("abstract"),
        F.filter(F.transform(F.coalesce(e["author"], F.array().cast("array<struct<name:string>>")), lambda a: clean(a["name"])), lambda n: n != "").alias("authors"),
        X.leading_year(clean(e["published"])).alias("year"),
    ))
    f = f.withColumn("read", read)
    failed = F.exists("read", lambda e: (F.lower(e["title"]) == "error") | e["url"].rlike(r"^https?://arxiv\.org/api/errors"))
    broken = F.exists("read", lambda e: e["sid"].isNull() | (e["title"] == "") | (e["abstract"] == ""))
    problem = (
        F.when(F.col("body").isNull() | (F.trim("body") == "") | F.col("f._bad").isNotNull() | ~F.col("body").rlike(r"</[\w:]+>\s*$|/>\s*$"), "MALFORMED")
        .when(F.col("root") != "feed", "INVALID_FEED").when(failed, "API_ERROR").when(broken, "INVALID_ENTRY")
    )
    papers = F.transform("read", lambda e: F.struct(
        F.concat(F.lit("arxiv:"), e["sid"]).alias("paper_id"), F.lit("arxiv").alias("source"), e["sid"].alias("source_id"), e["title"].alias("title"), e["abstract"].alias("abstract"),
        e["authors"].alias("authors"), e["year"].alias("year"), F.lit(None).cast("string").alias("doi"), e["url"].alias("url"), F.lit("en").alias("language"),
    ))
    return f.select("query_id", problem.alias("problem"), F.when(problem.isNull(), papers).alias("papers"))


def papers(feeds: DataFrame) -> DataFrame:
    """Paper records of all sound responses, with the query they came by."""
    return parse_feeds(feeds).where("problem IS NULL").select("query_id", F.explode("papers").alias("p")).select("p.*", F.array("query_id").alias("retrieval_paths"))
