"""Problem 5: consolidating pairwise matches into groups by seed-tree pruning.

Each round every vertex tells itself and its neighbours the least id it sees. A vertex that nobody,
itself included, took for a least id drops out of the graph and hangs under the least id it was told:
an edge of the propagation forest. What is left are the candidate minima, linked where one vertex was
told several. When no edge is left the remaining vertices are the seeds, and their ids flow down the
forest, last round first. A parent always leaves in a later round than its child, so one join a round
labels the whole forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch


def connected_groups(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(id, group_id) for every id that is linked to another one; group_id is the least id of the group.

    - a row with a null side, or with twice the same id, links nothing;
    - repeated rows and both orders of a pair count once; other columns are ignored;
    - an empty input gives an empty result.

    Only minima and counts are aggregated (partial aggregates first, so a vertex that holds a third of
    all edges is never gathered); joins are plain equi-joins that adaptive execution may split. Every
    round is written to the shared folder, so a lost executor repeats one round at most.
    """
    spark = pairs.sparkSession
    keep = Scratch(spark, "groups")
    one = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).where(
        "u IS NOT NULL AND v IS NOT NULL AND u <> v"
    )
    graph = keep.cut(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph")
    forest: list[DataFrame] = []
    while not graph.isEmpty():
        least = graph.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        told = keep.cut(
            graph.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m")).distinct(),
            "told",
        )
        best = told.groupBy("x").agg(
            F.min("m").alias("p"), F.count("*").alias("n"), F.max(F.col("m") == F.col("x")).alias("stays")
        )
        forest.append(keep.cut(best.where("NOT stays").select("x", "p"), "forest"))
        several = told.join(best.where("n > 1").select("x", "p"), "x").where("m <> p")
        after = keep.cut(
            several.select(F.col("m").alias("u"), F.col("p").alias("v"))
            .union(several.select(F.col("p").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "graph",
        )
        keep.drop(told, graph)
        graph = after
    if not forest:
        return graph.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    labels = forest.pop().select(F.col("x").alias("id"), F.col("p").alias("group_id"))
    while forest:
        level = forest.pop()
        above = labels.select(F.col("id").alias("p"), F.col("group_id"))
        here = level.join(above, "p", "left").select(
            F.col("x").alias("id"), F.coalesce("group_id", "p").alias("group_id")
        )
        labels = keep.cut(labels.unionByName(here), "labels") if forest else labels.unionByName(here)
    labels = keep.cut(labels, "labels")
    seeds = labels.select(F.col("group_id").alias("id"), "group_id").distinct()
    return labels.unionByName(seeds)


def merge_links(decisions: DataFrame) -> DataFrame:
    """The (left, right) ids of decisions whose action reads auto_merge, without regard to case and outer blanks."""
    return decisions.where(F.lower(F.regexp_replace("action", r"^\s+|\s+$", "")) == "auto_merge").select(
        F.col("left_paper_id").alias("left"), F.col("right_paper_id").alias("right")
    )
