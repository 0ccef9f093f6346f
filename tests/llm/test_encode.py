import random

import pytest
from palimpsest.llm import encode
from palimpsest.llm.lexicon import Lexicon, compile_lexicon


def test_lexicon_round_trip(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abcde") for _ in range(rng.randrange(0, 9))) for _ in range(3000)}
    entries = [(w, [rng.randrange(50000) for _ in range(rng.randrange(1, 4))]) for w in words]
    data = compile_lexicon(list(entries))
    (tmp_path / "x").write_bytes(data)
    lexicon = Lexicon(str(tmp_path / "x"))
    assert lexicon.words == len(words) and all(lexicon.get(w) == ids for w, ids in entries)
    assert all(lexicon.get(w) is None for w in (b"zz", b"abcdeabcdeabcde", bytes([255])) if w not in words)
    suffixes = compile_lexicon([(f"{a}{b}ation".encode(), [1]) for a in "abcdefgh" for b in "abcdefgh"])
    (tmp_path / "y").write_bytes(suffixes)
    assert Lexicon(str(tmp_path / "y")).first.shape[0] - 1 < 12  # endings are shared


TEXTS = ["", "   ", "Hello world's  end\n\n  x", "图检索 naïve 🙂 <|endoftext|>", "a" * 5000, "Zq9$" * 3000, "​﻿é́", None, "It's 12,345.67\t\tok"]


def test_against_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = encode.load_ranks(encode.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS ids")
    for words in (4, 1000):
        got = {r.doc_id: r.ids for r in encode.encode_column(df, "doc_id", "text", words=words).collect()}
        assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in encode.encode_column(df, "doc_id", "text", only_count=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_empty_table(spark):
    assert encode.encode_column(spark.createDataFrame([], "d int, t string"), "d", "t").count() == 0
