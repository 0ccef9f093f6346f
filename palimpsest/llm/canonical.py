"""Problem 1: one surviving record for every group of duplicates, chosen field by field.

Sound values of a field are aligned token by token (progressive alignment), every column takes a
weighted vote of all members, and every stored value is measured by the winning tokens: one that two
members or more contradict in most of its tokens is no version of the field but damage, and is outvoted. Of
the values near the consensus the most trusted and, among those, newest survives, so that a late correction
outweighs older copies; where none is near, the nearest does. A member votes with 1 + 2^-trust_rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch, width

FIELDS = ("title", "abstract", "authors", "year", "doi")
BLOCK = 64  # sequences aligned in one task
SEP = "\x1f"
YEARS, NO_YEAR = (1500, 2100), (1900, 1901, 2099, 2100)  # outside, and among: placeholders
NEAR, FAR = 0.4, 0.6  # shares of tokens that differ from the consensus: a version of it, and none

# Texts that stand for a missing value, in lower case.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "unknown", "anonymous", "not provided", "not available", "no abstract available",
    "no abstract", "abstract", "no title", "untitled", "untitled document", "title", "tbd", "todo", "-",
    "无", "暂无", "摘要", "无标题", "佚名",
)
# What pages add around a text.
PAGE_TEXT = (
    r"(?i)download (full text|pdf)|\bpage \d+ of \d+|do not cite|cookies are|sign in or|buy access|all rights reserved"
    r"|paper portal|view this page|skip to main content"
)
PADDING = r"(?i)\s*(\(accepted manuscript.*|- download full text.*|page \d+ of \d+.*)$"
# How a sound earlier version is marked.
VERSION_TAIL = r"(?i)(\s*\((working paper|preprint|draft)\)|\s*:\s*a preliminary study|（初稿）|（工作论文）)$"
VERSION_HEAD = r"(?i)^towards\s+"
DANGLING = r"(?i)(?:[:;,（(\-–—]|\s(?:a|an|the|of|in|on|at|for|by|with|and|or|to|from|under|across|through|during|after|above))\s*$"
CUT = r"(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\.\.)\s*$"
MOJIBAKE = "Ã[\\u0080-\\u00bf]|Â[\\u0080-\\u00bf]|�"


def _blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s　]+", " "))


def _placeholder(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(_blank(c)), r"^[\[(<]+|[\])>.]+$", "")
    return bare.isin(*PLACEHOLDERS) | (bare == "") | bare.rlike(r"^[\w-]+\.(pdf|docx?|tex|txt|html?)$")


def sound(field: Column, value: Column) -> Column:
    """Whether a stored value is usable by itself (authors are joined by SEP); null counts as unusable."""
    text = ~_placeholder(value) & ~value.rlike(MOJIBAKE) & ~value.rlike(PAGE_TEXT) & ~value.rlike(CUT)
    title = text & ~value.rlike(DANGLING)
    abstract = text & value.rlike(r"[.!?。！？][\s\])}\"'”’]*$")
    people = F.split(value, SEP)
    whole = F.forall(
        people,
        lambda a: ~_placeholder(a)
        & ~a.rlike(r"(?i)^\s*(et\.? al\.?|and others|others|等)\s*$")
        & ~a.contains(";")
        & ~a.rlike(MOJIBAKE)
        & ~a.rlike(r"^\s*\w\.(?:[\s-]*\w\.)*\s*\S*$|^[一-鿿]\.$")  # only an initial before the family name
        & ~a.rlike(r"^[a-zß-ÿ-]+$"),  # a family name alone
    )
    year = value.try_cast("int").between(*YEARS) & ~value.try_cast("int").isin(*NO_YEAR)
    doi = value.rlike(r"^10\.\d{4,9}/[^\s/]\S*$") & ~value.rlike(r"(?i)x{4,}")
    ok = (
        F.when(field == "title", title).when(field == "abstract", abstract).when(field == "authors", whole)
        .when(field == "year", year).otherwise(doi)
    )
    return F.coalesce(ok, F.lit(False))


def _whole(field: Column, value: Column) -> Column:
    """The value without padding and version marks, and with misread letters undone as far as needed to compare."""
    text = F.regexp_replace(F.regexp_replace(value, PADDING, ""), VERSION_TAIL, "")
    text = F.regexp_replace(F.regexp_replace(text, VERSION_HEAD, ""), r"\s*(\[\s*(\.\.\.|…)\s*\]|\.\.\.|…)\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, "Ã¯", "i"), "Ã³", "o")
    return F.when(field.isin("title", "abstract"), text).when(field == "authors", F.concat(value, F.lit(SEP))).otherwise(value)


def followed(df: DataFrame, keys: list[str], text: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``cut``: whether ``text`` is a proper prefix of another text of the same keys.

    In sorted order a text that is a prefix of any later one is a prefix of the next. Rows are sorted by
    range, so a group of any size is spread over tasks; only the first row of each task meets the last of
    the one before.
    """
    n = width(df.sparkSession)
    order = [*keys, text]
    ranged = scratch.cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    after = F.lead(F.struct(*order)).over(Window.partitionBy("_part").orderBy(*order))
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(*order)).alias("_first"))  # one row a partition
    firsts = firsts.withColumn("_next", F.lead("_first").over(Window.orderBy("_part"))).select("_part", "_next")
    next_row = F.coalesce("_after", "_next")
    same = F.lit(True)
    for k in keys:
        same = same & (next_row[k] == F.col(k))
    cut = same & next_row[text].startswith(F.col(text)) & (next_row[text] != F.col(text))
    return (
        ranged.withColumn("_after", after)
        .join(F.broadcast(firsts), "_part")
        .withColumn("cut", F.coalesce(cut, F.lit(False)))
        .drop("_part", "_after", "_next")
    )


def _merge(a: list, b: list) -> list:
    """Two profiles (lists of {token: weight}) aligned: equal or overlapping columns meet, others stay apart."""
    head = 0
    while head < min(len(a), len(b)) and a[head].keys() & b[head].keys():
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].keys() & b[-1 - tail].keys():
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [_join(p, q) for p, q in zip(a[:head], b[:head])]
    out += _align(x, y) if x and y else x + y
    return out + [_join(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]


def _align(x: list, y: list) -> list:
    """The cheapest alignment of two profiles of any length: columns without a common token cost one, as does a column left apart.

    Costs are kept for one row in so many; the rows between are taken again on the way back, so memory grows as
    the length to the power 1.5 and not as its square.
    """
    at: dict[str, list[int]] = {}
    for j, q in enumerate(y):
        for t in q:
            at.setdefault(t, []).append(j)
    place = np.arange(len(y) + 1, dtype=np.int32)

    def advance(last: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of row ``i``, and those of coming there by a meeting and from above."""
        differ = np.ones(len(y), dtype=np.int32)
        for t in x[i - 1]:
            if t in at:
                differ[at[t]] = 0
        meet, up = last[:-1] + differ[: len(last) - 1], last[1:] + 1
        now = np.empty_like(last)
        now[0], now[1:] = i, np.minimum(meet, up)
        return np.minimum.accumulate(now - place[: len(now)]) + place[: len(now)], meet, up

    some = max(math.isqrt(len(x)) + 1, 4_000_000 // len(y))  # rows taken at once on the way back
    kept = [place]
    last = place
    for i in range(1, (len(x) - 1) // some * some + 1):
        last = advance(last, i)[0]
        if i % some == 0:
            kept.append(last)
    i, j, out = len(x), len(y), []
    while i and j:
        first = (i - 1) // some
        last, steps = kept[first][: j + 1], []
        for k in range(first * some + 1, i + 1):
            last, meet, up = advance(last, k)
            left = last[:-1] + 1
            steps.append(np.where((meet <= up) & (meet <= left), 0, np.where(up <= left, 1, 2)).astype(np.int8))
        while i > first * some and j:
            step = steps[i - first * some - 1][j - 1]
            if step == 0:
                i, j = i - 1, j - 1
                out.append(_join(x[i], y[j]))
            elif step == 1:
                i -= 1
                out.append(x[i])
            else:
                j -= 1
                out.append(y[j])
    return x[:i] + y[:j] + out[::-1]


def _join(p: dict, q: dict) -> dict:
    out = dict(p)
    for k, v in q.items():
        out[k] = out.get(k, 0.0) + v
    return out


def vote(sequences: list[tuple[list[str], float]]) -> list[str]:
    """The consensus of weighted token lists: heaviest first into one alignment, then a vote in each column."""
    profile: list[dict] = []
    total = 0.0
    for tokens, weight in sorted(sequences, key=lambda s: (-s[1], s[0])):
        one = [{t: weight} for t in tokens]
        profile = _merge(profile, one) if profile else one
        total += weight
    out = []
    for column in profile:
        token, most = min(column.items(), key=lambda kv: (-kv[1], kv[0]))
        if most > total - sum(column.values()):  # else the gap wins
            out.append(token)
    return out


def _vote_block(pdf: pd.DataFrame) -> pd.DataFrame:
    won = vote([(t.split(SEP), w) for t, w in zip(pdf.tokens, pdf.weight)])
    out = pdf[["cluster_id", "field"]].head(1).copy()
    out["tokens"], out["weight"] = SEP.join(won), pdf.weight.sum()
    return out


def members_of(clusters: DataFrame) -> DataFrame:
    """One row for each member of each cluster, however often cluster or member is written; the newest copy counts."""
    one = clusters.select("cluster_id", F.explode("member_records").alias("m")).where(
        "cluster_id IS NOT NULL AND m.paper_id IS NOT NULL"
    )
    return one.groupBy("cluster_id", F.col("m.paper_id").alias("paper_id")).agg(
        F.max(F.struct(F.col("m.observed_at").alias("at"), F.col("m").alias("m")))["m"].alias("m")
    )


def survivors(clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, field, value, holder, holders, certain) for every field that any member holds soundly.

    ``value`` is the stored value that survives (authors joined by SEP, the year as text), ``holder`` the
    least paper_id that stores it, ``holders`` how many members store the identical value. ``certain`` says
    that it is the only value that stands, or that its newest holder is the newest of all that stand and no
    member of the cluster is more trusted.

    - null, empty and placeholder values, values cut short (also: a proper prefix of another member's
      value), misread or padded with page text are never kept; a field without sound values has no row;
    - repeated clusters and members count once; a source without rank is less trusted than any other;
    - a title or abstract of which two members or more hold another version is outvoted (see FAR), however trusted;
    - ties of trust and time go to the value nearest to the consensus, then the heaviest; texts of any length are compared whole; other columns
      are ignored; an empty table gives an empty result.

    Copies of a value are collapsed by aggregates before anything else. Values of one field of one cluster
    are voted on in blocks of 64, and block winners again, so that no cluster, however large, is one task.
    """
    spark = clusters.sparkSession
    keep = Scratch(spark, "survivors")
    ranks = sources.groupBy("source").agg(F.min("trust_rank").alias("trust"))
    members = members_of(clusters)
    long = members.select(
        "cluster_id", "paper_id", F.col("m.source").alias("source"), F.col("m.observed_at").alias("at"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), (
                F.array_join(F.col("m.authors"), SEP, "") if f == "authors" else F.col(f"m.{f}").cast("string")
            ).alias("value")) for f in FIELDS
        ])).alias("f"),
    )
    long = long.select("cluster_id", "paper_id", "source", "at", "f.field", "f.value").join(ranks, "source", "left")
    long = keep.cut(long.withColumn("trust", F.coalesce("trust", F.lit(30)).cast("int")).drop("source"), "members")
    highest = long.groupBy("cluster_id").agg(F.min("trust").alias("top"), F.countDistinct("paper_id").alias("members"))
    distinct = (
        long.where("value IS NOT NULL")
        .groupBy("cluster_id", "field", "value")
        .agg(
            F.count("*").alias("holders"), F.min("paper_id").alias("holder"), F.max("at").alias("newest"),
            F.max(F.struct((-F.col("trust")).alias("t"), F.col("at").alias("a"))).alias("rank"),
            F.sum(1 + F.pow(F.lit(2.0), -F.col("trust"))).alias("weight"),
        )
    )
    field, value = F.col("field"), F.col("value")
    judged = distinct.withColumn("ok", sound(field, value)).withColumn("whole", _whole(field, value))
    usable = followed(judged.where((F.length("value") > 0)), ["cluster_id", "field"], "whole", keep)
    cut = F.col("cut") & field.isin("title", "abstract", "authors")
    good = keep.cut(usable.where(F.col("ok") & ~cut).drop("ok", "whole", "cut"), "sound")
    per = good.groupBy("cluster_id", "field").agg(F.count("*").alias("n"))
    tokens = (
        F.when(field.isin("title", "abstract"), F.array_join(F.regexp_extract_all("value", F.lit(r"\p{IsHan}|[^\s\p{IsHan}]+"), F.lit(0)), SEP))
        .when(field == "doi", F.array_join(F.regexp_extract_all("value", F.lit(r"\d+|[A-Za-z]+|."), F.lit(0)), SEP))
        .otherwise(F.col("value"))
    )
    ranked = keep.cut(
        good.join(per, ["cluster_id", "field"]).withColumn("tokens", tokens),
        "ranked",
    )
    level = ranked.where("n > 1").select("cluster_id", "field", "tokens", "weight", "n")
    most = level.agg(F.max("n")).first()[0] or 0
    schema = "cluster_id string, field string, tokens string, weight double"
    while most > 0:
        blocks = F.ceil(F.col("n") / BLOCK)
        level = (
            level.withColumn("block", F.pmod(F.xxhash64("tokens", "weight"), blocks))
            .repartition(width(spark), "cluster_id", "field", "block")
            .groupBy("cluster_id", "field", "block")
            .applyInPandas(_vote_block, schema)
        )
        level = keep.cut(level, "vote")
        if most <= BLOCK:
            break
        sizes = level.groupBy("cluster_id", "field").agg(F.count("*").alias("n"))
        level = level.join(sizes, ["cluster_id", "field"])
        most = sizes.agg(F.max("n")).first()[0]
    won = level.select("cluster_id", "field", F.col("tokens").alias("consensus"))
    mine, theirs = F.array_distinct(F.split("tokens", SEP)), F.array_distinct(F.split("consensus", SEP))
    far = 1 - F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))
    several = ranked.where("n > 1").join(won, ["cluster_id", "field"]).withColumn("far", F.when(field.isin("title", "abstract"), far).otherwise(0.0))
    backed = several.groupBy("cluster_id", "field").agg(F.sum(F.when(F.col("far") <= NEAR, F.col("holders"))).alias("backers"))
    several = several.join(backed, ["cluster_id", "field"]).withColumn("outvoted", F.col("far") > F.when(F.col("backers") >= 2, FAR).otherwise(1.0))
    several = keep.cut(several.unionByName(ranked.where("n = 1"), allowMissingColumns=True).fillna({"far": 0.0, "outvoted": False}), "measured")
    standing = several.where(~F.col("outvoted"))
    best = F.max_by(F.struct("value", "holder", "holders", "rank", "newest"), F.struct("rank", -F.col("far"), F.col("weight"), F.col("value")))
    chosen = standing.groupBy("cluster_id", "field").agg(best.alias("b"), F.max("newest").alias("last"), F.count("*").alias("left")).select("cluster_id", "field", "b.*", "last", "left")
    certain = (F.col("left") == 1) | ((-F.col("rank.t") == F.col("top")) & (F.col("rank.a") == F.col("last")))
    return (
        chosen.join(highest, "cluster_id")
        .select("cluster_id", "field", "value", "holder", "holders", "members", certain.alias("certain"))
    )


def canonical_records(clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, title, abstract, authors, year, doi): the surviving record; null where no member is sound."""
    kept = survivors(clusters, sources)
    wide = kept.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    ids = clusters.select("cluster_id").where("cluster_id IS NOT NULL").distinct()
    return ids.join(wide, "cluster_id", "left").select(
        "cluster_id", "title", "abstract", F.split("authors", SEP).alias("authors"), F.col("year").cast("double").cast("int").alias("year"), "doi"
    )
