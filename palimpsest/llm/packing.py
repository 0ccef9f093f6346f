"""Problem 8: filling containers of fixed capacity by minimum bin slack.

Every container takes the longest item left; a bitset subset-sum over the lengths still available finds
the fullest combination that goes with it. A combination is used as often as the lengths allow before
the next is sought, so the plan depends on the histogram of lengths, at most ``capacity`` numbers, and not
on the number of items: it is made once and sent to all tasks, which place their items in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch

SALTS = 64


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths (with repeats, no more than counted) whose sum is the largest that ``room`` holds."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            now = reach | (reach << (take * length)) & mask
            if now != reach:
                steps.append((reach, length, take))
                reach = now
            if reach >> room & 1:
                break
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: list[int] = []
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            out += [length] * take
            best -= take * length
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a container, how many such containers) that use up all counted items of 1..capacity."""
    left, out = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        mates = fullest(capacity - longest, left) if capacity > longest else []
        left[longest] += 1
        lengths = [longest, *mates]
        used = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((lengths, times))
    return out


def pack(items: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """(key, part, tokens, container_id): every item, or part of an item over ``capacity``, in one container.

    - an item that fits is never split; a longer one gives full containers of its own and a rest that is
      packed like any item (parts are numbered from 0);
    - null, negative and zero sizes need no room: container 0, part 0, 0 tokens;
    - repeated keys are separate items; ties are placed by key; extra columns are ignored; an empty table
      gives an empty result. The same input gives the same containers, however it is partitioned,
      up to the exchange of items of the same key and size.

    Items of one length are numbered by salted counts, so a length that most items share is not one task.
    """
    spark = items.sparkSession
    keep = Scratch(spark, "packing")
    size = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    base = items.select(F.col(key).alias("k"), size.alias("size"))
    whole = F.floor(F.col("size") / capacity)
    rest = F.col("size") - whole * capacity
    full = F.when(whole > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: F.struct(i.cast("int").alias("part"), F.lit(capacity).alias("tokens"))))
    full = F.coalesce(full, F.array().cast("array<struct<part:int,tokens:int>>"))
    tail = F.when((rest > 0) | (F.col("size") == 0), F.array(F.struct(whole.cast("int").alias("part"), rest.cast("int").alias("tokens")))).otherwise(F.array().cast("array<struct<part:int,tokens:int>>"))
    parts = base.select("k", F.explode(F.concat(full, tail)).alias("p")).select("k", "p.part", "p.tokens")
    parts = keep.cut(parts.withColumn("salt", F.pmod(F.xxhash64(F.col("k").cast("string"), "part"), F.lit(SALTS)).cast("int")), "parts")
    cells = parts.groupBy("tokens", "salt").agg(F.count("*").alias("n"))  # capacity x SALTS rows at most
    before = F.sum("n").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("n")
    cells = keep.cut(cells.select("tokens", "salt", before.alias("before"), "n"), "cells")
    counts = {r["tokens"]: r["n"] for r in cells.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # capacity + 1 rows at most
    counts.pop(0, None)
    shared = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    rank = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("k", "part")) - 1 + F.col("before")
    ranked = parts.join(F.broadcast(cells.drop("n")), ["tokens", "salt"]).select("k", "part", "tokens", rank.alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        for pdf in batches:
            at = np.zeros(len(pdf), np.int64)
            for length, rows in pdf.groupby("tokens").indices.items():
                if length:
                    start, first, many = slots[int(length)]
                    r = pdf["rank"].to_numpy()[rows]
                    i = np.searchsorted(start, r, "right") - 1
                    at[rows] = first[i] + (r - start[i]) // many[i]
            yield pd.DataFrame({"k": pdf["k"], "part": pdf["part"], "tokens": pdf["tokens"], "container_id": at})

    kind = parts.schema["k"].dataType.simpleString()
    return ranked.mapInPandas(place, f"k {kind}, part int, tokens int, container_id long").withColumnRenamed("k", key)


def _slots(combinations: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first container and items a container of each run of equal containers."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for lengths, times in combinations:
        for x in sorted(set(lengths)):
            many = lengths.count(x)
            runs.setdefault(x, []).append((seen.get(x, 0), first, many))
            seen[x] = seen.get(x, 0) + many * times
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}
