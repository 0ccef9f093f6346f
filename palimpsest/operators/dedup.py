"""Conservative deduplication: observations, candidate pairs, decisions, guarded clusters, canonical records."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.runtime import Scratch, width

TITLE_JACCARD, TITLE_RATIO, AUTHOR_JACCARD, YEARS = 0.92, 0.96, 0.50, 1
TIERS = ("EXACT_DOI", "EXACT_ARXIV_ID", "EXACT_NORMALIZED_TITLE_WITH_AUTHOR", "HIGH_TITLE_SIMILARITY_WITH_AUTHOR")
MEET = 2048  # papers of one author that meet in one block
FIELDS = ("source", "source_id", "title", "abstract", "authors", "year", "doi", "url", "language", "user_visible")


def normalise(papers: DataFrame) -> DataFrame:
    """Papers with ``ntitle``, ``ttokens``, ``nauthors``, ``cdoi``, ``carxiv`` (columns of these names are replaced).

    A null title or author gives no tokens; a null author list an empty one.
    """
    authors = F.coalesce("authors", F.array().cast("array<string>"))
    out = papers.withColumn("_names", _fold_each(authors))
    return (
        out.withColumn("_t", X.fold("title")).withColumn("_d", X.fold("doi")).withColumn("_s", X.compatible("source_id"))
        .withColumn("ntitle", F.coalesce(X.tokens_only(F.col("_t")), F.lit("")))
        .withColumn("ttokens", F.array_distinct(X.tokens(F.col("_t"))))
        .withColumn("nauthors", F.filter(F.transform("_names", X.tokens_only), lambda a: a != ""))
        .withColumn("cdoi", X.canonical_doi(F.col("_d")))
        .withColumn("carxiv", X.canonical_arxiv_id(F.col("source"), F.col("_s")))
        .drop("_t", "_d", "_s", "_names")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_each(lists: pd.Series) -> pd.Series:
    import unicodedata

    return lists.map(lambda xs: [" ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in xs if x is not None])


def coalesce_observations(papers: DataFrame) -> DataFrame:
    """One row a paper_id: the observation of the least JSON form, all retrieval paths, and ``conflicting``.

    ``conflicting`` marks papers whose observations do not say the same after normalisation: a strict
    caller stops there, nothing is dropped. A null paper_id is no paper. Repeated rows count once.
    """
    known = papers.where("paper_id IS NOT NULL")
    shown = F.to_json(F.struct(*[F.col(c) for c in sorted(FIELDS) if c in papers.columns]), {"ignoreNullFields": "false"})
    n = normalise(known).withColumn("_abstract", X.fold("abstract")).withColumn("_source", X.fold("source")).withColumn("_language", X.fold("language"))
    n = n.withColumn("_sid", F.coalesce("carxiv", X.compatible("source_id"))).withColumn("_url", X.compatible("url"))
    said = F.to_json(F.struct("_source", "_sid", "ntitle", "_abstract", "nauthors", "year", "cdoi", "_url", "_language", "user_visible"))
    rows = n.withColumn("_shown", shown).withColumn("_said", F.xxhash64(said))
    keep = [c for c in papers.columns if c not in ("paper_id", "retrieval_paths")]
    return rows.groupBy("paper_id").agg(
        F.min_by(F.struct(*keep), "_shown").alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("retrieval_paths", F.array().cast("array<string>")))))).alias("retrieval_paths"),
        (F.count_distinct("_said") > 1).alias("conflicting"),
    ).select("paper_id", "r.*", "retrieval_paths", "conflicting")


def _similar_titles(n: DataFrame, by: str | None) -> DataFrame:
    """(l, r): pairs whose token sets can have a Jaccard of 0.92, with a common value of array ``by`` if given.

    Below 23 tokens such sets are equal, or one is the other and one token more, so the hash of a whole set meets
    the hashes of sets without one token. Longer titles (23 of 25 tokens are 0.92, too) meet on their rarest tokens (prefix filter). Nothing is lost.
    """
    extra = F.explode(F.array_distinct(by)) if by else F.lit("")
    t = n.where("size(ttokens) > 0").select("paper_id", F.array_sort("ttokens").alias("s"), extra.alias("x"))
    code = lambda s: F.xxhash64(s, F.col("x"))
    whole = t.select("paper_id", code(F.col("s")).alias("k"))
    without = F.explode(F.transform("s", lambda w: F.array_remove("s", w)))
    less = t.where("size(s) BETWEEN 13 AND 25").select("paper_id", "x", without.alias("s")).select("paper_id", code(F.col("s")).alias("k"))
    long = t.where("size(s) >= 23")
    df = n.where("size(ttokens) >= 23").select(F.explode("ttokens").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    w = Window.partitionBy("paper_id", "x").orderBy("df", "w")
    rare = long.select("paper_id", "x", F.size("s").alias("n"), F.explode("s").alias("w")).join(df, "w").withColumn("i", F.row_number().over(w))
    rare = rare.where(F.col("i") <= F.col("n") - F.ceil(F.lit(TITLE_JACCARD) * F.col("n") - 1e-9) + 1).select("paper_id", code(F.col("w")).alias("k"))
    out = None
    for a, b in ((whole, whole), (whole, less), (rare, rare)):
        p = a.toDF("l", "k").join(b.toDF("r", "k"), "k").where("l <> r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
        out = p if out is None else out.union(p)
    return out


def _same(n: DataFrame, column: str, many: bool = False) -> DataFrame:
    key = F.explode(F.array_distinct(column)) if many else F.col(column)
    one = n.select("paper_id", key.alias("k")).where("k IS NOT NULL").distinct()
    return one.toDF("l", "k").join(one.toDF("r", "k"), "k").where("l < r").select("l", "r")


def candidate_pairs(n: DataFrame) -> DataFrame:
    """(l, r), l < r: all pairs that any rule can call more than separate, and few others.

    Such a pair shares a DOI, an arXiv id or an author, or has similar titles. All pairs of papers of one author
    more than a year apart are for review, so this set grows with the square of an author's papers, as its
    definition says; clustering does not need it (``merge_pairs``).
    """
    return _same(n, "cdoi").union(_same(n, "carxiv")).union(_same(n, "nauthors", True)).union(_similar_titles(n, None)).distinct()


def merge_pairs(n: DataFrame) -> DataFrame:
    """(l, r), l < r: all pairs that can be merged or contested: same DOI, same arXiv id, or similar titles by a common author."""
    return _same(n, "cdoi").union(_same(n, "carxiv")).union(_similar_titles(n, "nauthors")).distinct()


def close_pairs(n: DataFrame) -> DataFrame:
    """(l, r), l < r: the pairs of ``candidate_pairs`` that more than a common author speaks for, so that they can be merged or contested."""
    untitled = n.where("ntitle = ''")
    return _same(n, "cdoi").union(_same(n, "carxiv")).union(_same(untitled, "nauthors", True)).union(_similar_titles(n, None)).distinct()


def all_pairs(n: DataFrame) -> DataFrame:
    """Every pair, for small sets where each decision must be shown (quadratic by nature)."""
    ids = n.select("paper_id")
    return ids.toDF("l").join(ids.toDF("r"), F.col("l") < F.col("r"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of characters; depends on the order of its arguments."""
    return pd.Series([1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(left, right)])


def decide(pairs: DataFrame, n: DataFrame, show_all: bool = False) -> DataFrame:
    """(left_paper_id, right_paper_id, action, reason, title_similarity, author_overlap, year_difference).

    The costly ratio is taken where the token Jaccard allows it to matter; elsewhere title_similarity is
    null, unless ``show_all``. An unknown year agrees with any; an empty title or author list is similar to nothing.
    """
    cols = ("ntitle", "nauthors", "cdoi", "carxiv", "year", "language")
    side = lambda s: n.select(F.col("paper_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    p = pairs.join(side("l"), "l").join(side("r"), "r")
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, " ")))  # noqa: E731, ttokens; titles travel once
    p = p.withColumn("jac", X.jaccard(words("l_ntitle"), words("r_ntitle"))).withColumn("overlap", X.jaccard(F.array_distinct("l_nauthors"), F.array_distinct("r_nauthors")))
    p = p.withColumn("gap", F.abs(F.col("l_year") - F.col("r_year")))
    rated = p if show_all else p.where(F.col("jac") >= TITLE_JACCARD)
    rated = rated.withColumn("ratio", sequence_ratio("l_ntitle", "r_ntitle"))
    if not show_all:
        rated = rated.unionByName(p.where(F.col("jac") < TITLE_JACCARD).withColumn("ratio", F.lit(None).cast("double")))
    same_doi, same_arxiv = F.col("l_cdoi") == F.col("r_cdoi"), F.col("l_carxiv") == F.col("r_carxiv")
    high_title = (F.col("jac") >= TITLE_JACCARD) & (F.coalesce("ratio", F.lit(0.0)) >= TITLE_RATIO)
    rule = _rule(same_doi, same_arxiv, F.col("l_ntitle") == F.col("r_ntitle"), high_title, F.col("l_language").eqNullSafe(F.col("r_language")))
    return _decided(rated, rule)


def _rule(same_doi, same_arxiv, same_title, high_title, same_language):
    """(action, reason) of a pair with ``overlap`` of its authors and ``gap`` of its years."""
    conflict = F.coalesce((same_doi & ~same_arxiv) | (same_arxiv & ~same_doi), F.lit(False))
    year_ok = F.coalesce(F.col("gap") <= YEARS, F.lit(True))
    shared = F.col("overlap") > 0
    high_author = F.col("overlap") >= AUTHOR_JACCARD
    verdict = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    return (
        F.when(conflict, verdict("manual_review", "IDENTITY_CONFLICT"))
        .when(F.coalesce(same_doi, F.lit(False)), verdict("auto_merge", TIERS[0]))
        .when(F.coalesce(same_arxiv, F.lit(False)), verdict("auto_merge", TIERS[1]))
        .when(same_language & year_ok & same_title & shared, verdict("auto_merge", TIERS[2]))
        .when(same_language & year_ok & high_title & high_author, verdict("auto_merge", TIERS[3]))
        .when(~same_language & (shared | high_title), verdict("manual_review", "CROSS_LANGUAGE_POSSIBLE_DUPLICATE"))
        .when((high_title & ~high_author) | (~year_ok & (shared | high_title)) | (high_author & ~high_title), verdict("manual_review", "INSUFFICIENT_EVIDENCE"))
        .otherwise(verdict("keep_separate", "INSUFFICIENT_EVIDENCE"))
    )


def _decided(rated: DataFrame, rule) -> DataFrame:
    return rated.select(
        F.col("l").alias("left_paper_id"), F.col("r").alias("right_paper_id"), rule.alias("v"),
        F.col("ratio").alias("title_similarity"), F.col("overlap").alias("author_overlap"), F.col("gap").cast("int").alias("year_difference"),
    ).select("left_paper_id", "right_paper_id", "v.*", "title_similarity", "author_overlap", "year_difference")


def author_decisions(n: DataFrame, close: DataFrame) -> DataFrame:
    """Decisions, as of ``decide``, for all pairs with a common author that are not in ``close`` (l, r), a superset of those of ``close_pairs``.

    These can only be reviewed or kept apart, by authors, years and languages. They grow with the square of an
    author's papers, so none is shuffled or written here: papers meet at each author, a pair counts at the least of its
    common authors, and each paper brings along the later ones it is close to. Papers of a frequent author meet in blocks.
    """
    spark = n.sparkSession
    known = close.groupBy("l").agg(F.collect_list("r").alias("known")).withColumnRenamed("l", "id")
    codes = F.array_distinct(F.transform("nauthors", lambda a: F.xxhash64(a)))
    one = n.where("size(nauthors) > 0").select(F.col("paper_id").alias("id"), codes.alias("by"), "year", "language")
    one = one.join(known, "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    met = one.select(F.explode("by").alias("a"), "*")
    sizes = one.select(F.explode("by").alias("a")).groupBy("a").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts")).where("parts > 1")
    met = met.join(F.broadcast(sizes), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    met = met.select("a", "i", "j", "part", "id", "by", "year", "language", "known").repartition(4 * width(spark), "a", "i", "j")
    at = ["a", "i", "j"]
    side = lambda s: met.select(*at, *[F.col(c).alias(f"{s}{x}") for c, x in (("id", ""), ("part", "_part"), ("by", "_by"), ("year", "_year"), ("language", "_language"), ("known", "_known"))])
    common = F.array_intersect("l_by", "r_by")
    pairs = side("l").join(side("r"), at).where("l < r AND (i = j OR l_part <> r_part)").where(F.array_min(common) == F.col("a"))
    pairs = pairs.where(~F.array_contains("l_known", F.col("r")) & ~F.array_contains("r_known", F.col("l")))
    shared = F.size(common)
    rated = pairs.select(
        "l", "r", F.lit(None).cast("double").alias("ratio"), (shared / (F.size("l_by") + F.size("r_by") - shared)).alias("overlap"),
        F.abs(F.col("l_year") - F.col("r_year")).alias("gap"), F.col("l_language").eqNullSafe(F.col("r_language")).alias("same_language"),
    )
    no = F.lit(False)
    return _decided(rated, _rule(no, no, no, no, F.col("same_language")))


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(id, comp): least id of everything linked through (l, r); labels spread and jump until none changes."""
    both = edges.select(F.col("l").alias("u"), F.col("r").alias("v")).union(edges.select("r", "l")).distinct()
    both = keep.cut(both, "edges")
    label = keep.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        seen = both.join(label.toDF("v", "cv"), "v").groupBy("u").agg(F.min("cv").alias("m"))
        new = label.join(seen, "u").select("u", F.least("c", "m").alias("c"))
        jump = new.join(new.toDF("c", "cc"), "c", "left").select("u", F.least("c", F.coalesce("cc", "c")).alias("c"))
        jump = keep.cut(jump, "labels")
        changed = jump.join(label.toDF("u", "old"), "u").where("c <> old").isEmpty()
        if changed:
            return jump.toDF("id", "comp")
        keep.drop(label)
        label = jump


def guard(component: pd.DataFrame) -> pd.DataFrame:
    """The ordered, guarded merges inside one component: tier by tier, pairs by id.

    A merge that would bring two DOIs or two arXiv ids together, or that rests on a title while some pair across
    is no automatic merge, becomes a manual review.
    """
    group: dict[str, set[str]] = {}
    dois: dict[str, set[str]] = {}
    arxivs: dict[str, set[str]] = {}
    for side in ("left", "right"):
        for i, d, a in zip(component[f"{side}_paper_id"], component[f"{side}_doi"], component[f"{side}_arxiv"]):
            if i not in group:
                group[i] = {i}
                dois[i], arxivs[i] = {d} - {None}, {a} - {None}
    merges = set(zip(component.left_paper_id, component.right_paper_id))
    tier = component.reason.map(TIERS.index)
    order = component.assign(tier=tier).sort_values(["tier", "left_paper_id", "right_paper_id"])
    out = []
    for l, r, reason, t in zip(order.left_paper_id, order.right_paper_id, order.reason, order.tier):
        a, b = group[l], group[r]
        ia, ib = min(a), min(b)
        action = "auto_merge"
        if len(dois[ia] | dois[ib]) > 1 or len(arxivs[ia] | arxivs[ib]) > 1:
            action, reason = "manual_review", "IDENTITY_CONFLICT"
        elif t >= 2 and a is not b and any((min(x, y), max(x, y)) not in merges for x in a for y in b):
            action, reason = "manual_review", "TRANSITIVE_BRIDGE_RISK"
        elif a is not b:
            top = min(ia, ib)
            dois[top], arxivs[top] = dois[ia] | dois[ib], arxivs[ia] | arxivs[ib]
            a |= b
            for x in b:
                group[x] = a
        out.append((l, r, action, reason, "", ""))
    out += [(i, i, "member", "", min(g), "") for i, g in group.items()]
    return pd.DataFrame(out, columns=["l", "r", "action", "reason", "root", "_"]).drop(columns="_")


def cluster(papers: DataFrame, pairs=merge_pairs, show_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clusters, decisions) of all papers, decisions for the given pairs; see ``decide`` for the rules and ``guard`` for the merges.

    clusters: cluster_id, paper_ids, canonical_paper_id, retrieval_paths, source_identities, auto_merges.
    Papers without a partner are clusters of their own. Only components of automatic merges reach Python,
    one task each: the guards look at every pair inside, and such pairs exist, so a component of n papers has
    at least n - 1 and at most n(n - 1)/2 rows.
    """
    return _cluster(papers, pairs, show_all)[1:]


def all_decisions(papers: DataFrame) -> DataFrame:
    """The decisions of ``cluster`` for all pairs of ``candidate_pairs``; those that only an author speaks for come straight from their join."""
    n, _, close = _cluster(papers, close_pairs, False)
    return close.unionByName(author_decisions(n, close.select(F.col("left_paper_id").alias("l"), F.col("right_paper_id").alias("r"))))


def _cluster(papers: DataFrame, pairs, show_all: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, clusters, decisions); of an abstract the papers only keep whether it is blank, of a title its normal form."""
    spark = papers.sparkSession
    keep = Scratch(spark, "dedup")
    n = normalise(coalesce_observations(papers)).withColumn("abstract", F.substring(X.collapse(F.col("abstract")), 1, 1))
    n = keep.cut(n.drop("title", "authors", "doi", "user_visible", "conflicting"), "papers")
    base = keep.cut(decide(pairs(n), n, show_all), "decisions")
    auto = base.where("action = 'auto_merge'")
    comp = components(auto.select(F.col("left_paper_id").alias("l"), F.col("right_paper_id").alias("r")), keep)
    ids = n.select("paper_id", "cdoi", "carxiv")
    rich = (
        auto.select("left_paper_id", "right_paper_id", "reason")
        .join(ids.toDF("left_paper_id", "left_doi", "left_arxiv"), "left_paper_id")
        .join(ids.toDF("right_paper_id", "right_doi", "right_arxiv"), "right_paper_id")
        .join(comp.toDF("left_paper_id", "comp"), "left_paper_id")
    )
    guarded = rich.repartition(width(spark), "comp").groupBy("comp").applyInPandas(guard, "l string, r string, action string, reason string, root string")
    guarded = keep.cut(guarded, "guarded")
    final = guarded.where("action <> 'member'").select(F.col("l").alias("left_paper_id"), F.col("r").alias("right_paper_id"), F.col("action").alias("a2"), F.col("reason").alias("r2"))
    decisions = base.join(final, ["left_paper_id", "right_paper_id"], "left").select(
        "left_paper_id", "right_paper_id", F.coalesce("a2", "action").alias("action"), F.coalesce("r2", "reason").alias("reason"),
        "title_similarity", "author_overlap", "year_difference",
    )
    decisions = keep.cut(decisions, "final")
    roots = guarded.where("action = 'member'").select(F.col("l").alias("paper_id"), "root")
    contested = decisions.where("reason = 'IDENTITY_CONFLICT'").select(F.explode(F.array("left_paper_id", "right_paper_id")).alias("paper_id")).distinct().withColumn("contested", F.lit(True))
    members = n.join(roots, "paper_id", "left").join(contested, "paper_id", "left").withColumn("root", F.coalesce("root", "paper_id"))
    merged = decisions.where("action = 'auto_merge'").join(members.select(F.col("paper_id").alias("left_paper_id"), "root"), "left_paper_id").groupBy("root").agg(F.count("*").alias("auto_merges"))
    clusters = members.groupBy("root").agg(
        F.array_sort(F.collect_list("paper_id")).alias("paper_ids"),
        F.min_by("paper_id", canonical_key()).alias("canonical_paper_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("retrieval_paths")))).alias("retrieval_paths"),
        F.array_sort(F.collect_set(F.struct("source", "source_id", "url"))).alias("source_identities"),
        F.min("cdoi").alias("doi"), F.min("carxiv").alias("arxiv"), F.max("contested").alias("contested"),
    )
    named = (
        F.when(F.col("contested"), F.concat(F.lit("paper:"), F.col("root")))
        .when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), F.col("doi")))
        .when(F.col("arxiv").isNotNull(), F.concat(F.lit("arxiv:"), F.col("arxiv")))
        .otherwise(F.concat(F.lit("paper:"), F.col("root")))
    )
    clusters = clusters.join(merged, "root", "left").select(
        named.alias("cluster_id"), "paper_ids", "canonical_paper_id", "retrieval_paths", "source_identities", F.coalesce("auto_merges", F.lit(0)).alias("auto_merges")
    )
    return n, clusters, decisions


def canonical_key():
    """Sort key of the record to show for a cluster: identified, sourced, linked, described, complete, long, then by id."""
    blank = lambda c: F.coalesce(F.length(X.collapse(F.col(c))) == 0, F.lit(True))
    return F.struct(
        F.col("cdoi").isNull().alias("a"), blank("source_id").alias("b"), (~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))).alias("c"),
        blank("abstract").alias("d"), (-F.size("nauthors")).alias("e"), F.col("year").isNull().alias("f"), (-F.length("ntitle")).alias("g"), F.col("paper_id").alias("h"),
    )

