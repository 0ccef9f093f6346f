"""Column functions over text: comparable forms, identifiers, model inputs, hashes.

All are null in, null out unless they say otherwise, and take texts of any length.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
# How a DOI may be introduced; one of them is taken off.
DOI_PREFIX = r"^(?:https://dx\.doi\.org/|https://doi\.org/|http://doi\.org/|doi:)"
DOI_TAIL = r"[.,;:)\]}>\"']+$"
DOI = r"^10\.\d{4,9}/\S+$"
ARXIV_ID = r"^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v[1-9]\d*)?$"
# Abstracts that say there is none.
PLACEHOLDER_ABSTRACTS = ("no abstract", "not provided", "no abstract available")
# Chinese research terms and their English search terms.
SEARCH_TERMS = {
    "辐射屏蔽": "radiation shielding", "核反应堆": "nuclear reactor", "核工程": "nuclear engineering", "迁移学习": "transfer learning",
    "深度学习": "deep learning", "机器学习": "machine learning", "设计": "design", "评估": "evaluation", "方法": "method", "框架": "framework",
}


@F.pandas_udf(T.StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())


def collapse(c: Column) -> Column:
    """Runs of any white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Compatibility form, case-folded, white space collapsed (an Arrow kernel: Spark has no Unicode normaliser)."""
    return _nfkc_casefold(c)


def fold_ascii(c: Column) -> Column:
    """The same for text known to be ASCII, without leaving the JVM."""
    return F.lower(collapse(c))


def compatible(c: Column) -> Column:
    return _nfkc(c)


def tokens_only(folded: Column) -> Column:
    """Letters and digits of an already folded text; everything else separates tokens."""
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def tokens(folded: Column) -> Column:
    """Tokens in order; an empty array for a text without any."""
    t = tokens_only(folded)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, " "))


def canonical_doi(folded: Column) -> Column:
    """A DOI in one notation, null where the text is none. Only one known prefix is taken off."""
    bare = F.regexp_replace(F.regexp_replace(folded, DOI_PREFIX, ""), DOI_TAIL, "")
    return F.when(bare.rlike(DOI), bare)


def canonical_arxiv_id(source: Column, source_id: Column) -> Column:
    """The identifier without its version, only where the source vouches for it."""
    return F.when((source == "arxiv") & source_id.rlike(ARXIV_ID), F.regexp_replace(source_id, r"v\d+$", ""))


def arxiv_id_of_url(url: Column) -> Column:
    """Identifier of an abstract page, null for any other address."""
    path = F.try_parse_url(url, F.lit("PATH"))
    raw = F.substring(path, 6, 1_000)
    ok = (
        F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) == "arxiv.org")
        & F.try_parse_url(url, F.lit("QUERY")).isNull() & F.try_parse_url(url, F.lit("REF")).isNull() & path.startswith("/abs/") & raw.rlike(ARXIV_ID)
    )
    return F.when(ok, F.regexp_replace(raw, r"v\d+$", ""))


def leading_year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def abstract_or_null(c: Column) -> Column:
    return F.when(F.length(collapse(c)) > 0, c)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def is_placeholder_abstract(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*PLACEHOLDER_ABSTRACTS), F.lit(False))


def paper_text(title: Column, abstract: Column) -> Column:
    """Model input of a paper; null (refused) where the title is blank or the abstract says that there is none."""
    t, a = strip(lines(title)), strip(lines(abstract))
    body = F.concat(F.lit("title:\n"), t, F.when(F.length(a) > 0, F.concat(F.lit("\n\nabstract:\n"), a)).otherwise(""))
    return F.when((F.length(t) > 0) & ~is_placeholder_abstract(a), body)


def query_text(question: Column) -> Column:
    q = strip(lines(question))
    return F.when(F.length(q) > 0, F.concat(F.lit("query:\n"), q))


def source_hash(title: Column, abstract: Column) -> Column:
    """Hash of title and abstract as compact JSON with sorted keys; a null abstract counts as null, not as absent.

    Null (refused) where the title is null or either text is given but blank.
    """
    unix = lambda c: strip(F.replace(lines(c), F.lit("\r"), F.lit("\n")))
    t, a = unix(title), unix(abstract)
    digest = F.sha2(F.to_json(F.struct(a.alias("abstract"), t.alias("title")), {"ignoreNullFields": "false"}), 256)
    return F.when((F.length(t) > 0) & (a.isNull() | (F.length(a) > 0)), digest)


def hashed_vector(text: Column, salt: str, dimensions: int = 16) -> Column:
    """Deterministic stand-in for an embedding: blocks of SHA-256 as numbers in [0, 1)."""
    def number(i):
        block, at = (i / 8).cast("int"), (i % 8).cast("int")
        tail = F.unhex(F.lpad(F.hex(block), 16, "0"))
        digest = F.sha2(F.concat(F.encode(F.concat(text, F.lit(salt)), "UTF-8"), tail), 256)
        return F.conv(F.substring(digest, at * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0

    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), number)


def search_term(folded: Column) -> Column:
    """Chinese research terms in English, longest first; null where Chinese is left over."""
    out = folded
    for zh in sorted(SEARCH_TERMS, key=lambda k: -len(k)):
        out = F.replace(out, F.lit(zh), F.lit(SEARCH_TERMS[zh]))
    return F.when(~out.rlike("[㐀-鿿]"), out)


def clause(groups: Column) -> Column:
    """AND of OR-groups of quoted terms; a group of several terms is put in brackets."""
    def group(g):
        terms = F.array_join(F.transform(g, lambda t: F.concat(F.lit('all:"'), t, F.lit('"'))), " OR ")
        return F.when(F.size(g) > 1, F.concat(F.lit("("), terms, F.lit(")"))).otherwise(terms)

    return F.array_join(F.transform(groups, group), " AND ")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def distinct_in_order(a: Column) -> Column:
    return F.array_distinct(a)
