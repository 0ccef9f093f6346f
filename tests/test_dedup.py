import itertools
import random

import pandas as pd
from palimpsest.operators import dedup

SCHEMA = (
    "paper_id string, source string, source_id string, title string, abstract string, authors array<string>, year int, doi string, url string,"
    " language string, retrieval_paths array<string>, user_visible boolean"
)


def paper(i, title, authors=("Ada Author",), year=2020, doi=None, source="crossref", source_id=None, language="en", paths=("Q1",), abstract="Told"):
    return (i, source, source_id or i, title, abstract, list(authors) if authors is not None else None, year, doi, f"https://x.test/{i}", language, list(paths), True)


def clusters(spark, rows, **how):
    c, d = dedup.cluster(spark.createDataFrame(rows, SCHEMA), **how)
    return {r.cluster_id: tuple(r.paper_ids) for r in c.collect()}, {(r.left_paper_id, r.right_paper_id): (r.action, r.reason) for r in d.collect()}


def test_rules_and_names_of_clusters(spark):
    rows = [
        paper("a", "Graph search for shields", doi="https://doi.org/10.1000/X.1"), paper("b", "Something else", ["Bo"], doi="doi:10.1000/x.1."),
        paper("c", "Twin study of pumps", source="arxiv", source_id="2401.00001v2"), paper("d", "Twin study of pumps!", year=2021),
        paper("e", "Twin study of pumps", year=2025), paper("f", "图检索", ["Ada Author"], language="zh"), paper("g", "Lonely work", ["Zed"]),
    ]
    found, decided = clusters(spark, rows, pairs=dedup.all_pairs, show_all=True)
    assert found["doi:10.1000/x.1"] == ("a", "b") and found["arxiv:2401.00001"] == ("c", "d") and found["paper:g"] == ("g",)
    assert decided["a", "b"] == ("auto_merge", "EXACT_DOI") and decided["c", "d"][1] == "EXACT_NORMALIZED_TITLE_WITH_AUTHOR"
    assert decided["c", "e"] == ("manual_review", "INSUFFICIENT_EVIDENCE") and decided["a", "f"] == ("manual_review", "CROSS_LANGUAGE_POSSIBLE_DUPLICATE")
    assert decided["a", "g"][0] == "keep_separate" and len(decided) == 21


def test_guards(spark):
    rows = [  # b bridges two DOIs by title; f and g are linked, but f and h are not
        paper("a", "Same title here", doi="10.1000/one"), paper("b", "Same title here"), paper("c", "Same title here", doi="10.1000/two"),
        paper("f", "Other title there", year=2019), paper("g", "Other title there", year=2020), paper("h", "Other title there", year=2021),
    ]
    found, decided = clusters(spark, rows)
    assert decided["b", "c"] == ("manual_review", "IDENTITY_CONFLICT") or decided["a", "c"][1] == "IDENTITY_CONFLICT"
    assert ("a", "b") in found.values() and ("f", "g") in found.values() and decided["g", "h"] == ("manual_review", "TRANSITIVE_BRIDGE_RISK")


def test_observations(spark):
    rows = [paper("a", "One", paths=["Q2"]), paper("a", "One", paths=["Q1", "Q2"]), paper("a", "One", paths=["Q1"]), paper("b", "Two"), paper("b", "Two changed"), paper(None, "Nobody")]
    got = {r.paper_id: r for r in dedup.coalesce_observations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"a", "b"} and got["a"].retrieval_paths == ["Q1", "Q2"] and not got["a"].conflicting and got["b"].conflicting


def test_nulls_empties_long_texts_and_extra_columns(spark):
    rows = [paper("n", None, None, None, abstract=None), paper("m", "", [], None), paper("o", "!!!", [None, ""], None), paper("p", "word " * 30000, ["X"]), paper("q", "word " * 30000, ["X"])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS l", "2 AS k", "'x' AS root")
    c, _ = dedup.cluster(df.select(*[f.split()[0] for f in SCHEMA.split(", ")]))
    assert sorted(len(r.paper_ids) for r in c.collect()) == [1, 1, 1, 2]
    assert dedup.cluster(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_blocked_pairs_give_the_clusters_of_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        base = [words[(i // 4 * 7 + j) % 40] for j in range(rng.choice([5, 15, 26]))]
        if rng.random() < 0.4 and len(base) > 12:
            base.pop(rng.randrange(len(base)))
        rows.append(paper(f"p{i:02}", " ".join(base), [f"A{i // 4}"], 2020 + rng.randrange(2), f"10.1000/{i // 8}" if rng.random() < 0.3 else None))
    a, _ = clusters(spark, rows)
    b, _ = clusters(spark, rows, pairs=dedup.all_pairs, show_all=True)
    assert a == b
    n = dedup.normalise(dedup.coalesce_observations(spark.createDataFrame(rows, SCHEMA))).cache()
    every = {tuple(r[:2]): r.action for r in dedup.decide(dedup.all_pairs(n), n, True).collect()}
    blocked = {tuple(r) for r in dedup.candidate_pairs(n).collect()}
    assert {p for p, action in every.items() if action != "keep_separate"} <= blocked


def test_ratio_depends_on_order():
    f = dedup.sequence_ratio.func
    assert f(pd.Series(["tide"]), pd.Series(["diet"]))[0] == 0.25 and f(pd.Series(["diet"]), pd.Series(["tide"]))[0] == 0.5


def test_order_of_rows_does_not_matter(spark):
    rows = [paper(f"p{i}", f"title {i % 3} of a work", [f"A{i % 2}"]) for i in range(12)]
    assert clusters(spark, rows)[0] == clusters(spark, list(reversed(rows)))[0]
    assert len(list(itertools.chain(*clusters(spark, rows)[0].values()))) == 12


def test_two_words_left_out_of_twenty_five(spark):
    words = [f"w{i:02}" for i in range(25)]
    rows = [paper("a", " ".join(words), ["Ada"]), paper("b", " ".join(words[:7] + words[8:19] + words[20:]), ["Ada"])]
    n = dedup.normalise(dedup.coalesce_observations(spark.createDataFrame(rows, SCHEMA)))
    assert {tuple(r) for r in dedup._similar_titles(n, None).collect()} == {("a", "b")} == {tuple(r) for r in dedup._similar_titles(n, "nauthors").collect()}


def test_pairs_of_authors_are_decided_without_writing_them(spark, monkeypatch):
    rng = random.Random(3)
    titles = [None, "", "Editorial", *(f"title {i} of a work" for i in range(30))]
    rows = [paper(f"p{i:02}", rng.choice(titles), rng.sample(["Ada", "Bo", "Cy", "Di", "Ed"], rng.randrange(4)), rng.choice([2019, 2020, 2023, None]), rng.choice([None, None, None, f"10.1000/{i // 9}"]), language=rng.choice(["en", "en", "zh"])) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = sorted(map(tuple, dedup.cluster(df, dedup.candidate_pairs)[1].collect()), key=str)
    written, cut = [], dedup.Scratch.cut
    monkeypatch.setattr(dedup.Scratch, "cut", lambda self, t, name: (out := cut(self, t, name), written.append(out.count()))[0])
    for most in (dedup.MEET, 5):
        monkeypatch.setattr(dedup, "MEET", most)
        written.clear()
        assert sorted(map(tuple, queries_of(monkeypatch, df)(spark, "").collect()), key=str) == expected
        assert max(written) < len(expected) / 3


def queries_of(monkeypatch, df):
    from palimpsest.plans import papers

    monkeypatch.setattr(papers, "records", lambda spark, d: df)
    return papers.pair_decisions
