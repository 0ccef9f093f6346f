from palimpsest.llm.quality import STATISTICS, outlierness

PROSE = "The model was fitted to the data, and we found that it is of use in the field. " * 4
KINDS = {
    "prose": [PROSE, "A title of the work\n" + PROSE, "User: " + PROSE, "今后的工作将进一步讨论疲劳与材料组织之间的关系。由于探测器数量有限，反演问题仍然是病态的，因此需要引入先验约束。", PROSE + "\n- one item\n- two items"],
    "list": ["\n".join(f"- graph method {i}" for i in range(12)), "\n".join(f"{i}. Ada Author (2019) On graphs and the rest, vol {i}" for i in range(9)), 'all:"a b" AND ti:"c"\n' * 6, "Heading one\nHeading two\nHeading three\nHeading four", "裂纹萌生、应力腐蚀、热疲劳、相分离、空洞肿胀、蠕变断裂"],
    "table": ["a\tb\tc\n" + "1.5\tNA\t7\n" * 9, "| x | y |\n|---|---|\n" + "| 1 | fuel |\n" * 9, "run;dose;flux\n" + "1.2;NA;3e+00\n" * 9, "<tr><td>1</td><td>b</td></tr>\n" * 6, "dose=1  flux=2  run=x\n" * 6, "a & b & c \\\\\n" * 7],
    "junk": ["=" * 60 + "\n" + "*" * 40, "hG7fK2pLq9ZxTr4WmVb8" * 12, "Home > RSS > Share > Login > Cart > PDF", "2024-01-01T00:00:00Z INFO x GET /a 200\n" * 5, "���\n" * 9, '{"a":1,"b":null,"c":[]}', "nn8]wg 7wh]g gg9zp 9b1l[] 2hn[l 84g2s1 n7p 4cd;3w", "loading loading loading loading loading loading"],
}


def test_kinds(spark):
    rows, want = [], {}
    for kind, texts in KINDS.items():
        for t in texts:
            want[len(rows)] = kind
            rows.append((len(rows), t))
    rows += [(100, None), (101, ""), (102, "  \n\t"), (103, " ".join(f"The model number {i} was fitted to the data of the field, and we found that it is of use." for i in range(2000)))] + [(200 + i, PROSE[: 80 * (1 + i % 4)] + f"It was {i}.") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS k", "2 AS kind", "3 AS f")
    common = spark.createDataFrame([("en", w) for w in "the of and to in is that it was we a".split()] + [("zh", w) for w in "的 是 了".split()], "lang string, word string")
    got = {r.doc_id: r for r in outlierness(df, "doc_id", "text", common).collect()}
    assert {i: got[i].kind for i in want} == want and got[103].kind == "prose" and not {100, 101, 102} & set(got)
    assert not any(got[i].outlier for i in range(200, 260))
    # forms alone, without the distance, would leave most of the junk among the prose
    assert all(got[i].outlier for i in want if want[i] == "junk" and got[i].form == "open") and sum(want[i] == "junk" and got[i].form == "open" for i in want) >= 5
    r = got[5]
    assert abs(sum(r[f"part_{s}"] for s in STATISTICS) - r.distance) < 1e-6 * max(1, abs(r.distance))


def test_empty(spark):
    none = outlierness(spark.createDataFrame([], "d int, t string"), "d", "t", spark.createDataFrame([], "lang string, word string"))
    assert none.count() == 0
