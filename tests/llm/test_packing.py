import itertools
import random

from palimpsest.llm.packing import fullest, pack, plan


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 8))]
        room = rng.randrange(1, 30)
        counts = {x: items.count(x) for x in items}
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        got = fullest(room, counts)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_plan_uses_every_item_once():
    rng = random.Random(4)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(30)}
    used = {}
    for lengths, times in plan(counts, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def check(rows, out, capacity):
    size = {}
    for r in out:
        size[r.container_id] = size.get(r.container_id, 0) + r.tokens
        assert 0 <= r.tokens <= capacity
    assert all(s <= capacity for s in size.values())
    back = {}
    for r in out:
        back.setdefault(r.k, []).append(r)
    for k, n in rows:
        parts = sorted(back[k], key=lambda r: r.part)
        assert sum(p.tokens for p in parts) == max(n or 0, 0) and [p.part for p in parts] == list(range(len(parts)))
        assert len(parts) == 1 or n > capacity
    return len([s for s in size.values() if s])


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(0, 50), 300])) for i in range(900)] + [(900, None), (901, 0), (902, -3), (903, 64), (904, 65), (905, 128)]
    df = spark.createDataFrame(rows, "k int, n int").selectExpr("*", "1 AS size", "2 AS part", "3 AS tokens", "4 AS salt")
    out = pack(df, "k", "n", 64).collect()
    bins = check(rows, out, 64)
    assert bins <= 1.03 * sum(n for _, n in rows if n and n > 0) / 64


def test_empty(spark):
    assert pack(spark.createDataFrame([], "k string, n int"), "k", "n", 8).count() == 0
    assert [tuple(r) for r in pack(spark.createDataFrame([("a", 0)], "k string, n int"), "k", "n", 8).collect()] == [("a", 0, 0, 0)]
