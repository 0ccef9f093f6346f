import numpy as np
from palimpsest.llm.vectors import nearest


def test_recall_copies_and_dirt(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    x = np.concatenate([c + 0.3 * rng.normal(size=(25, 64)) for c in centres]) * rng.uniform(0.1, 9, size=(500, 1))
    rows = [(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(f"w{i:02}", [float(a) for a in x[7] * 2]) for i in range(9)]  # a class of ten copies
    dirt = [("n", None), ("z", [0.0] * 64), ("s", [1.0] * 3), ("q", [float("nan")] + [1.0] * 63), ("i", [float("inf")] * 64), (None, [1.0] * 64), rows[0], rows[0], ("e", []), ("nn", [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows + dirt, "id string, v array<double>").selectExpr("*", "1 AS rep", "2 AS a", "3 AS copies")
    got = {}
    for r in nearest(df, "id", "v").collect():
        got.setdefault(r.a, []).append((-r.cosine, r.b))
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(ids) and all(len(v) == 5 and a not in {b for _, b in v} for a, v in got.items())
    at = {i: n for n, i in enumerate(ids)}
    hits = sum(s[at[a], at[b]] >= np.sort(s[at[a]])[-5] - 1e-9 for a, v in got.items() for _, b in v)
    assert hits >= 0.9 * 5 * len(ids)
    assert sorted(b for _, b in got["w08"]) == ["v007", "w00", "w01", "w02", "w03"]


def test_few_and_none(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "id string, v array<double>")
    got = {(r.a, r.b): round(r.cosine, 6) for r in nearest(one, "id", "v", 2, 5).collect()}
    assert len(got) == 6 and got["a", "c"] == 0.707107 and got["a", "b"] == 0.0
    assert nearest(one.where("id = 'a'"), "id", "v", 2).count() == 0 and nearest(one.where("false"), "id", "v", 2).count() == 0
