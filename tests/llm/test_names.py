import random

from palimpsest.llm.names import entities, parse, trie_join


def edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_join_finds_all_neighbours(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(250)} | {"ab", ""}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    want = {(a, b) for a in words for b in words if min(len(a), len(b)) >= 3 and a != b and edits(a, b) == 1}
    assert {tuple(r) for r in trie_join(df, "w").collect()} == want


def test_parse():
    assert parse("Dr. Zoë van der Bargel1") == ("full", ["zoe", "bargel"], "") and parse("Bargel, J.-L. A.") == ("init", ["bargel"], "jla") and parse("BARGEL, Peggy") == ("full", ["bargel", "margaret"], "")
    assert parse("et al.")[0] == parse(" ")[0] == parse("Anonymous")[0] == "none" and parse("荻渚·陌虞*") == ("han", ["荻渚陌虞"], "") and parse("Bargel HR") == ("init", ["bargel"], "hr")


def test_entities(spark):
    people = [
        "Henrietta Bargelost", "Bargelost, Henrietta", "HENRIETTA BARGELOST", "H. Bargelost", "Etta Bargelots", "Zoë Bargelost", "Bargelost, Z.", "Ulrike Bargelost",
        "Jean-Luc Höfeluuk", "Jean Luc Höfeluuk", "Hoefeluuk JL", "Jeanluc Höfeluuk", "The Wonavoav Shielding Institute", "Institute of Shielding, Wonavoav", "Wonavoav Shield. Inst.", "Tuguhuox Shielding Institute", "Kelmoron Shielding Institute", "Varnokiar Shielding Laboratory",
        "Marta Kellan", "Martin Kellan", "M. Kellan", "荻渚陌虞", "荻渚 陌虞", "荻渚陌岳", "et al.", "", None, "Anonymous", "x" * 5000,
    ]
    df = spark.createDataFrame([(p,) for p in people * 2], "name string").selectExpr("*", "1 AS entity", "2 AS f", "3 AS person")
    got = {r["name"]: r.entity for r in entities(df, "name").collect()}
    same = lambda *xs: len({got[x] for x in xs}) == 1
    assert same(*people[:5]) and same("Zoë Bargelost", "Bargelost, Z.") and same(*people[8:12]) and same(*people[12:15]) and same("荻渚陌虞", "荻渚 陌虞")
    assert len({got[x] for x in ("Henrietta Bargelost", "Zoë Bargelost", "Ulrike Bargelost", "Wonavoav Shield. Inst.", "Tuguhuox Shielding Institute", "Marta Kellan", "Martin Kellan", "M. Kellan", "荻渚陌岳")}) == 9
    assert not {"et al.", "", "Anonymous"} & set(got)
    assert entities(spark.createDataFrame([], "name string"), "name").count() == 0
