import random

from palimpsest.llm.components import connected_groups, merge_links


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "left string, right string")
    return {r.id: r.group_id for r in connected_groups(df).collect()}


def brute(pairs):
    label = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in range(len(label)):
        for a, b in pairs:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_shapes(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("zz", f"s{i:03}") for i in range(80)]
    rng = random.Random(3)
    noise = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)]
    pairs = chain + star + noise + [("b", "a"), ("a", "b"), ("a", "b"), ("x", "x"), ("y", None), (None, "y"), (None, None)]
    rng.shuffle(pairs)
    assert groups(spark, pairs) == brute(pairs)


def test_nothing_to_link(spark):
    assert groups(spark, []) == {} and groups(spark, [("x", "x"), (None, "y")]) == {}


def test_untidy_actions_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", "a", " AUTO_Merge\t", 1), ("c", "d", "manual_review", 2), ("e", "f", None, 3)], "left_paper_id string, right_paper_id string, action string, left int")
    assert [tuple(r) for r in merge_links(df).collect()] == [("b", "a")]
