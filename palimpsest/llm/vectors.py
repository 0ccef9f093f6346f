"""Problem 6: the k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Vectors are brought to unit length, and equal ones are represented once. Coarse centroids and codebooks
are fitted on a bounded sample; every vector is indexed. A vector searches the lists of its nearest
centroids: tables of distances from its residual to the codewords (asymmetric: the query is not
quantised) rank the codes of a list, and the best of them are reranked by the exact cosine of the stored
vectors, which travel with their codes so that reranking needs no further join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch, spread, width

SAMPLE = 30_000  # vectors to fit centroids and codebooks on
LISTS = 2_048  # at most
PROBES = 8
PARTS = 16  # subspaces, one byte each
CODEWORDS = 256
SHORTLIST = 64  # candidates of a list block that are reranked
BLOCK = 4_096  # vectors of a list in one task group
QUERIES = 8_192  # queries against a block in one task group
SEED = 11


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty cell restarts at a random point."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and codebooks of their residuals; a few hundred kilobytes, whatever the corpus."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(SEED)
        lists = max(1, min(LISTS, int(math.sqrt(rows)), len(sample) // 8 or 1))
        self.coarse = _means(sample, lists, 12, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = PARTS if sample.shape[1] % PARTS == 0 else 1
        self.step = sample.shape[1] // self.parts
        self.books = [_means(rest[:, p * self.step : (p + 1) * self.step], CODEWORDS, 8, rng) for p in range(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of vectors."""
        near = _nearest(x, self.coarse)
        rest = x - self.coarse[near]
        codes = np.stack([_nearest(rest[:, p * self.step : (p + 1) * self.step], b) for p, b in enumerate(self.books)], 1)
        return near, codes.astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        n = min(n, len(self.coarse))
        d = x @ self.coarse.T - (self.coarse * self.coarse).sum(1) / 2
        return np.argpartition(-d, n - 1, axis=1)[:, :n]

    def distances(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of list ``of``, from one table a query and subspace."""
        rest = queries - self.coarse[of]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for p, book in enumerate(self.books):
            part = rest[:, p * self.step : (p + 1) * self.step]
            table = (book * book).sum(1)[None, :] - 2 * part @ book.T
            out += table[:, codes[:, p]]
        return out


def usable(vectors: DataFrame, key: str, column: str, dimension: int) -> DataFrame:
    """(id, v): one row for each id with ``dimension`` finite numbers that are not all zero, at unit length.

    If an id has several usable vectors, the least one (as an array) counts.
    """
    v = F.col("v")
    ok = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    one = vectors.select(F.col(key).alias("id"), F.col(column).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(ok)
    one = one.groupBy("id").agg(F.min("v").alias("v"))
    top = F.array_max(F.transform("v", F.abs))  # scaled first, so that squares neither vanish nor overflow
    one = one.withColumn("v", F.transform("v", lambda x: x / top))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return one.withColumn("v", F.transform("v", lambda x: (x / length)))


def nearest(vectors: DataFrame, key: str, column: str, dimension: int = 64, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(a, b, cosine): for every usable vector a its k most similar other vectors b.

    - null vectors, wrong lengths, NaN, infinities and all zeros are no vectors and take no part; a null id
      neither; a repeated id counts once; equal vectors under different ids are different vectors;
    - of equally similar vectors the one with the lesser id comes first; other columns are ignored;
    - an empty table gives an empty result; fewer than k + 1 vectors give fewer neighbours.

    Copies (equal unit vectors) are searched once by a representative and then given each other by id
    order, so a vector that fills a third of the table costs no more than another. Lists are cut into
    blocks of 4,096 vectors and their queries into groups of 8,192: no task holds more.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "vectors")
    rows = keep.cut(usable(vectors, key, column, dimension), "unit")
    print_ = F.transform("v", lambda x: F.round(x, 12) + F.lit(0.0))
    marked = keep.cut(rows.select("id", print_.alias("v")), "marked")
    # representatives: least id of each class of equal vectors; members beyond k + 1 can be nobody's neighbour
    classes = keep.cut(marked.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    if n == 0:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine"))
    some = classes.select("v") if n <= SAMPLE else classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v")
    sample = np.array([r[0] for r in some.toLocalIterator()], np.float32)  # bounded by SAMPLE
    shared = spark.sparkContext.broadcast(Index(sample, n))  # bounded by LISTS and CODEWORDS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1).astype(np.float32)
                near, codes = index.encode(x)
                near_all = index.probes(x, probes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep"), b.column("v"), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(near_all.astype(np.int32)), pa.list_(pa.int32()))],
                    ["rep", "v", "list", "code", "probes"],
                )

    placed = keep.cut(
        spread(classes.select("rep", "v")).mapInArrow(place, "rep string, v array<double>, list int, code binary, probes array<int>"), "placed"
    )
    asked = placed.select("rep", "v", F.explode("probes").alias("list"))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(
        asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "list"
    )  # one row a list, LISTS at most
    sizes = F.broadcast(keep.cut(sizes, "sizes"))
    base = placed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "rep", "v", "code"
    )
    seek = asked.join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep"), "groups").cast("int").alias("group"), "rep", "v"
    ).toDF("list_", "block_", "group_", "rep_", "v_")
    cell = ["list", "block", "group"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series([], dtype=str), "b": pd.Series([], dtype=str), "cosine": pd.Series([], dtype=float)})
        if left.empty or right.empty:
            return none
        index = shared.value
        exact = np.stack(left.v.to_numpy())
        codes = np.frombuffer(b"".join(left.code), np.uint8).reshape(len(left), -1)
        names, ids = left.rep.to_numpy(), right.rep_.to_numpy()
        place_of = {name: i for i, name in enumerate(names)}
        out = []
        take = min(SHORTLIST, len(left))
        for at in range(0, len(right), 512):
            q = np.stack(right.v_.to_numpy()[at : at + 512])
            own = ids[at : at + 512]
            far = index.distances(q.astype(np.float32), int(left.list.iloc[0]), codes)
            short = np.argpartition(far, take - 1, axis=1)[:, :take]
            cosine = np.einsum("qd,qsd->qs", q, exact[short])
            cosine[short == np.array([place_of.get(x, -1) for x in own])[:, None]] = -2
            order = np.argsort(-cosine, axis=1, kind="stable")[:, : k + 1]
            best = np.take_along_axis(cosine, order, 1)
            which = np.take_along_axis(short, order, 1)
            r, c = np.nonzero(best > -2)
            out.append(pd.DataFrame({"a": own[r], "b": names[which[r, c]], "cosine": np.minimum(best[r, c], 1.0)}))
        return pd.concat(out) if out else none

    wide = width(spark)
    found = (
        base.repartition(wide, *cell).groupBy(*cell)
        .cogroup(seek.repartition(wide, "list_", "block_", "group_").groupBy("list_", "block_", "group_"))
        .applyInPandas(search, "a string, b string, cosine double")
    )
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "b"))), 1, k)
    found = keep.cut(found.groupBy("a").agg(top.alias("near")).select("a", F.explode("near").alias("n")).select("a", "n.b", (-F.col("n.far")).alias("cosine")), "found")
    # from representatives to ids: only the k + 1 least ids of a class can be neighbours of others
    members = marked.join(classes.select("v", "rep", "copies"), "v").select("id", "rep", "copies")
    few = (
        members.groupBy("rep", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
        .agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
        .groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    )
    near = found.join(few.withColumnRenamed("rep", "b"), "b").select("a", F.explode("ids").alias("b"), "cosine")
    near = near.groupBy("a").agg(top.alias("near"))
    copies = few.select(F.col("rep").alias("a"), F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("b"))).alias("copies"))
    lists = copies.join(near, "a", "left").select(
        "a", F.sort_array(F.concat("copies", F.coalesce("near", F.array().cast("array<struct<far:double,b:string>>")))).alias("all")
    )
    return (
        members.join(lists.withColumnRenamed("a", "rep"), "rep")
        .select("id", F.slice(F.filter("all", lambda x: x["b"] != F.col("id")), 1, k).alias("all"))
        .select(F.col("id").alias("a"), F.explode("all").alias("n"))
        .select("a", "n.b", (-F.col("n.far")).alias("cosine"))
    )
