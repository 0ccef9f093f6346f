import datetime

from palimpsest.llm.canonical import canonical_records, survivors, vote
from pyspark.sql import functions as F

MEMBER = "struct<paper_id:string,source:string,title:string,abstract:string,authors:array<string>,year:int,doi:string,observed_at:timestamp>"
SCHEMA = f"cluster_id string, canonical_record {MEMBER}, member_records array<{MEMBER}>, field string"


def member(i, source, day, title="A sound title of a work", abstract="All is told here.", authors=("Ada Author",), year=2020, doi="10.1000/x.1"):
    return (i, source, title, abstract, list(authors) if authors is not None else None, year, doi, datetime.datetime(2024, 1, day))


def kept(spark, clusters):
    df = spark.createDataFrame([(c, None, ms, "clash") for c, ms in clusters], SCHEMA)
    sources = spark.createDataFrame([("good", 1), ("poor", 5)], "source string, trust_rank int")
    return {(r.cluster_id, r.field): r for r in survivors(df, sources).collect()}, canonical_records(df, sources)


def test_vote():
    assert vote([("a b c".split(), 1.0), ("a x c".split(), 1.0), ("a b c d".split(), 1.0)]) == ["a", "b", "c"]
    assert vote([("a b".split(), 3.0), ("c d e".split(), 1.0), ("c d e".split(), 1.0)]) == ["a", "b"] and vote([([], 1.0)]) == []


def test_long_texts_are_aligned_as_short_ones_are():
    for n in (10, 2_100):  # beyond 2,000 tokens of either, texts were put one after the other
        common = [f"w{i}" for i in range(n)]
        assert vote([(["here", *common, "ends"], 1.0), (["there", *common, "stops"], 1.0)]) == ["here", *common, "ends"]


def test_choice(spark):
    clusters = [
        ("one", [member("a", "good", 5, year=2021), member("b", "good", 2), member("c", "poor", 1), member("c", "poor", 1), member("d", "poor", 4, doi="n/a")]),
        ("dirty", [member("a", "good", 9, "ms_final_v2.pdf", "Cut off here and", ["A. Author"], 1900, "10.1000/"), member("b", "poor", 1)]),
        ("cut", [member("a", "good", 9, "A sound title of", None, ["Ada Author", "et al."], 2099, "x.1"), member("b", "poor", 1, authors=["Ada Author", "Bo Author"])]),
        ("cut", [member("b", "poor", 1, authors=["Ada Author", "Bo Author"])]),
        ("fight", [member("a", "good", 1, year=2019), member("b", "poor", 9, year=2020)]),
        ("nothing", [member("a", "?", 1, None, "", [], None, None), member("b", None, 2, "Untitled document", "N/A", None, 2100, "unknown")]),
        (None, [member("a", "good", 1)]), ("null", None),
    ]
    got, records = kept(spark, clusters)
    assert (got["one", "year"].value, got["one", "year"].holder, got["one", "year"].certain, got["one", "year"].members) == ("2021", "a", True, 4)
    assert got["one", "title"].holders == 4 and got["one", "doi"].holders == 3
    assert all(got["dirty", f].holder == "b" and got["dirty", f].certain for f in ("title", "abstract", "authors", "year", "doi"))
    assert all(got["cut", f].holder == "b" and got["cut", f].holders == 1 for f in ("title", "abstract", "authors", "year", "doi"))
    assert not got["fight", "year"].certain and not any(c == "nothing" for c, _ in got)
    r = {x.cluster_id: x for x in records.collect()}
    assert set(r) == {"one", "dirty", "cut", "fight", "nothing", "null"} and r["nothing"].title is None and r["cut"].authors == ["Ada Author", "Bo Author"] and r["one"].year == 2021


def test_large_cluster_is_voted_in_blocks(spark):
    ms = [member(f"p{i:03}", "poor", 1 + i % 20, f"A sound title number {i} of a work") for i in range(150)] + [member("best", "good", 28, "A sound title numbered best of a work")]
    wrong = [member("a", "good", 28, "Proceedings and venue information for visitors", "Nobody can tell what this was about at all."), member("b", "poor", 2), member("c", "poor", 3)]
    got, _ = kept(spark, [("big", ms), ("wrong", wrong), ("two", wrong[:2])])
    assert got["big", "title"].value == "A sound title numbered best of a work" and got["big", "title"].certain and got["big", "title"].members == 151
    # by trust and time alone the value of another text would survive; the vote of two members rejects it, that of one does not
    assert all(got["wrong", f].holders == 2 and got["wrong", f].certain for f in ("title", "abstract")) and got["two", "title"].holder == "a"


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert survivors(df, spark.createDataFrame([], "source string, trust_rank int")).select(F.count("*")).first()[0] == 0
