import json
import time

from palimpsest.operators import audit, evidence
from palimpsest.sources import atom, reports, search
from palimpsest.streaming import feedback

FEED = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'
ENTRY = "<entry><id>http://arxiv.org/abs/{}</id><title> A\n title </title><summary>Told.</summary><published>2024-01-02T00:00:00Z</published><author><name>Ada A</name></author><author><name> </name></author></entry>"


def test_atom(spark):
    bodies = {
        "good": FEED.format(ENTRY.format("2401.00001v2") + ENTRY.format("hep-th/9901001")), "empty": FEED.format(""), "cut": "<feed><entry>", "none": None,
        "other": "<rss><entry></entry></rss>", "bad": FEED.format(ENTRY.format("x y")), "error": FEED.format(ENTRY.format("2401.00001").replace(" A\n title ", "Error")),
    }
    df = spark.createDataFrame(list(bodies.items()), "query_id string, body string")
    got = {r.query_id: r for r in atom.parse_feeds(df).collect()}
    assert {k: v.problem for k, v in got.items()} == {"good": None, "empty": None, "cut": "MALFORMED", "none": "MALFORMED", "other": "INVALID_FEED", "bad": "INVALID_ENTRY", "error": "API_ERROR"}
    p = atom.papers(df).orderBy("paper_id").collect()
    assert [r.paper_id for r in p] == ["arxiv:2401.00001", "arxiv:hep-th/9901001"] and p[0].authors == ["Ada A"] and p[0].year == 2024 and p[0].title == "A title" and p[0].retrieval_paths == ["good"]


def test_search_client_paces_and_retries():
    now, slept, answers = [0.0], [], [(503, "", {"Retry-After": "4"}), (0, "", {}), (200, "ok", {}), (404, "no", {})]

    def sleep(x):
        slept.append(round(x, 6))
        now[0] += x

    c = search.Client(lambda q, s: answers.pop(0), 3.0, 3, 1.0, sleep, lambda: now[0])
    assert c.get("q", 0) == (200, "ok") and c.get("q", 1) == (404, "no") and slept == [4.0, 3.0, 3.0]
    assert search.retry_after("Wed, 21 Oct 2099 07:28:00 GMT", time.time(), 60) == 60 and search.retry_after("x", 0, 60) == 0 and search.retry_after(None, 0, 60) == 0
    assert search.attempt_bound(12, 5, 3, 100) == 9 and search.backoff(2, 1.0) == 4.0


def test_recorded_scan(spark, tmp_path):
    (tmp_path / search.cache_key("q1", 5, "")).write_text("<feed/>")
    spark.dataSource.register(search.SearchSource)
    got = spark.read.format("literature_search").options(queries=json.dumps(["q1", "q2"]), recorded=str(tmp_path)).load().collect()
    assert [(r.query, r.status, r.body) for r in got] == [("q1", 200, "<feed/>"), ("q2", 404, None)]


def test_snapshot_and_reports(spark, tmp_path):
    papers = spark.createDataFrame([("a", "s", "1", "x"), ("b", "s", "2", None)], "paper_id string, source string, source_id string, abstract string")
    path = f"file://{tmp_path}/snap"
    reports.publish(papers, path)
    assert reports.verify(spark, path).count() == 0
    papers.where("paper_id = 'a'").write.mode("overwrite").parquet(f"{path}/papers")
    assert {r.field for r in reports.verify(spark, path).collect()} >= {"papers", "identity_digest"}
    assert "Not provided" in reports.markdown_report("R", [{"title": "T"}]) and reports.json_report({"b": 1, "a": 2}).startswith('{\n  "a"')


def test_audits(spark):
    a = spark.createDataFrame([("1", 1, None), ("2", 2, "x"), ("3", 3, "y")], "k string, v int, w string")
    b = spark.createDataFrame([("1", 1, None), ("2", 5, None), ("4", 4, "z")], "k string, v int, w string")
    assert {r.k: r.changed for r in audit.differences(a, b, "k", ["v", "w"]).collect()} == {"2": ["v", "w"], "3": ["REMOVED"], "4": ["ADDED"]}
    assert {tuple(r) for r in audit.one_to_one(a, b.union(b.where("k = '1'")), "k").collect()} == {("3", "MISSING"), ("4", "INVENTED"), ("1", "REPEATED")}
    assert audit.run_metrics(spark.createDataFrame([], "source_id string, url string, abstract string, authors array<string>, year int")).first().url_coverage == 0.0


def test_sentences():
    said = evidence.sentences("We got 3.5 e.g. by Dr. A.B. Smith. See x.org! 完成。\n\nEnd")
    assert [s for s, _ in said] == ["We got 3.5 e.g. by Dr. A.B. Smith.", "See x.org!", "完成。", "End"] and said[1][1] == 35
    assert evidence.sentences(None) == [] and evidence.sentences(" ... ") != [None]
    assert len(evidence.RULES) == 79 and sum(r[4] for r in evidence.RULES) == 59


def test_evidence(spark):
    papers = [
        ("a", "We propose a method", "It could help."), ("b", "On graphs", "Nothing to see, a task."), ("c", "Plain title", None), ("d", "Benchmark results", None), ("e", "x", "benchmark pipeline"),
        ("f", None, None), ("g", "t", "A limitation " + "z" * 3000 + "."), ("h", "Words", "Nothing."),
    ]
    got = {r.paper_id: r for r in evidence.classify(spark.createDataFrame(papers, "paper_id string, title string, abstract string")).collect()}
    assert got["a"].evidence_slot == "CURRENT_METHODS" and got["a"].support_level == "DIRECT" and got["a"].state == "CLASSIFIED"
    assert got["b"].kind == "generic_only" and got["c"].state == "INSUFFICIENT_SOURCE_TEXT" and got["d"].state == "TITLE_ONLY" and got["d"].evidence_slot == "EVALUATION_BASIS"
    assert got["e"].kind == "ambiguous" and got["f"].kind == "no_match" and len(got["g"].supporting_excerpt) == 1000 and got["h"].state == "REJECTED"
    c = evidence.classify(spark.createDataFrame(papers, "paper_id string, title string, abstract string"))
    assert sum(r.n for r in evidence.histogram(c).where("dimension = 'slot'").collect()) == 3 and evidence.diagnostics(c).first().ambiguous == 1
    assert "NO_REJECTED_OR_UNCERTAIN_RECORDS" in evidence.diagnostics(c.where("false")).first().warnings


def test_feedback_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    feedback.start(stream, lambda df, _: seen.extend(tuple(r) for r in df.collect()), f"{tmp_path}/ckpt").awaitTermination()
    whole = {tuple(r) for r in feedback.windowed(events).collect()}
    assert seen and set(seen) <= whole
