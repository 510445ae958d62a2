import json

import pytest
from pyspark.sql import functions as F

from clauseforge.operators import models, parse, prompts, questions, retrieval, sampling, triage
from clauseforge.plans import runs
from clauseforge.sources import files

CLAUSES = [
    "This Agreement is governed by the laws of Ormland and no other law applies here.",
    "Either party may end the Agreement on 30 days written notice to the other party.",
    "The royalty is five percent of net sales and is paid every quarter of the year.",
]
TEXT = "\n\n".join(CLAUSES)


@pytest.fixture(scope="module")
def corpus(spark):
    at = [TEXT.index(c) for c in CLAUSES]
    docs = spark.createDataFrame([("d1", "One", TEXT, "Supply"), ("d2", "Two", TEXT.replace("Ormland", "Brayland"), None), ("d3", "Three", None, None)], "doc_id string, title string, full_text string, contract_type string")
    rows = [(f"{d}::b{i:05d}", d, "paragraph", t.replace("Ormland", "Ormland" if d == "d1" else "Brayland"), 1, ["Terms"], at[i], at[i] + len(t) + (d == "d2" and i == 0)) for d in ("d1", "d2") for i, t in enumerate(CLAUSES)]
    blocks = spark.createDataFrame(rows, "block_id string, doc_id string, block_type string, text string, page int, section_path array<string>, char_start int, char_end int")
    chunks = blocks.select(F.regexp_replace("block_id", "::b", "::fixed::").alias("chunk_id"), "doc_id", F.lit("fixed").alias("strategy"), "text", F.lit(None).cast("string").alias("context_text"), "section_path", F.col("page").alias("page_start"), (F.col("page") + 1).alias("page_end"), "char_start", "char_end")
    q = [("q1", "Which law governs?", "d1", "Law", "laws of Ormland", [CLAUSES[0][:50]], True, "test", "One"), ("q2", "What royalty is paid?", "d1", "Royalty", "five percent", [CLAUSES[2][:40]], True, "test", "One"), ("q3", "Who insures the ship?", "d2", "Insurance", "", [], False, "test", None), ("q4", "What notice ends it?", "d2", "Notice", "30 days", [CLAUSES[1][:60]], True, "dev", None)]
    qs = spark.createDataFrame(q, "qid string, question string, doc_id string, category string, reference_answer string, evidence_spans array<string>, answerable boolean, split string, contract_name string").withColumn("qtype", F.lit("derived"))
    return docs, blocks, chunks, qs


def queue(replies):
    """A client that gives each request the reply its text asks for."""

    def make():
        return lambda requests: [next((r for k, r in replies if k in q["messages"][-1]["content"]), {"content": "none"}) for q in requests]

    return make


def test_context_and_messages(spark, corpus):
    _, _, chunks, _ = corpus
    ranked = spark.createDataFrame([("q", 2, "d1::fixed::00000"), ("q", 1, "d1::fixed::00002")], "qid string, rank long, chunk_id string")
    shown = prompts.excerpts(ranked, chunks)
    got = shown.select(prompts.build_messages(F.lit("Why?"), "excerpts").alias("m")).first()["m"]
    assert [m["role"] for m in got] == ["system", "user"]
    assert got[1]["content"] == f"Context excerpts:\n\n[1] (Terms, pp.1-2)\n{CLAUSES[2]}\n\n[2] (Terms, pp.1-2)\n{CLAUSES[0]}\n\nQuestion: Why?"
    one = shown.select(prompts.format_context(F.transform("excerpts", lambda e: e.withField("section_path", F.array().cast("array<string>")).withField("page_end", e["page_start"]))).alias("t")).first()["t"]
    assert one.startswith("[1] (no section, p.1)\n")


def test_generation_counts_marks_and_falls_back_to_text(spark, corpus):
    _, _, chunks, qs = corpus
    ranked = spark.createDataFrame([(q, 1, "d1::fixed::00000") for q in ("q1", "q2", "q3")], "qid string, rank long, chunk_id string")
    client = queue([("law governs", {"content": json.dumps({"answer": "Ormland [1][3], [1, 7]", "abstained": False}), "done_reason": "length", "prompt_tokens": 5}), ("royalty", {"content": "plain words [1]"}), ("insures", {"content": json.dumps({"answer": " ", "abstained": True})})])
    got = {r["qid"]: r for r in models.generate(qs, prompts.excerpts(ranked, chunks), client, "c", "m").collect()}
    assert got["q1"]["cited_chunk_ids"] == ["d1::fixed::00000"] and got["q1"]["invalid_citations"] == 2 and got["q1"]["truncated"] and got["q1"]["prompt_tokens"] == 5
    assert got["q2"]["answer"] == "plain words [1]" and not got["q2"]["abstained"] and not got["q2"]["truncated"]
    assert got["q3"]["answer"] == prompts.ABSTAIN and got["q3"]["abstained"]
    with pytest.raises(Exception, match="every request"):
        models.generate(qs, prompts.excerpts(ranked, chunks), lambda: lambda r: [], "c", "m").collect()


def test_each_statement_sees_its_own_excerpts(spark):
    ex = [{"rank": 1, "chunk_id": "a", "text": "Governed by Ormland law.", "section_path": ["A", "B", "C"], "page_start": 1, "page_end": 1}, {"rank": 2, "chunk_id": "b", "text": "Ends on ninety (90) days' notice.", "section_path": [], "page_start": 1, "page_end": 1}]
    shown = spark.createDataFrame([("k1", ex), ("k2", ex), ("k3", ex)], "key string, excerpts array<struct<rank:long,chunk_id:string,text:string,section_path:array<string>,page_start:int,page_end:int>>")
    a = spark.createDataFrame([("k1", "q", "Ormland law governs [1]. It ends in 90 days [2]. It ends in 60 days [2]. No source here. Bad mark [9]."), ("k2", "q", "Unusable [1]."), ("k3", "q", "")], "key string, question string, answer string")
    seen = queue([("Ormland law governs", {"content": json.dumps({"verdicts": [{"id": i, "supported": True, "on_topic": i != 4, "reason": ""} for i in range(1, 6)]})}), ("Unusable", {"content": "{}"})])
    got = models.check_answers(a, shown, seen).orderBy("key", "pos").collect()
    assert [r["supported"] for r in got] == [True, True, False, False, False, None] and [r["on_topic"] for r in got[:5]] == [True, True, True, False, True]
    assert got[2]["missing"] == ["60"] and got[0]["excerpts"] == "Governed by Ormland law." and got[4]["valid"] == 0 and got[5]["judged"] is None
    asked = []
    models.lexical_judge()([{"schema": "verdicts", "messages": [{"content": "Question: q\n\nStatement 1: x\nExcerpts cited by statement 1:\n(no excerpts cited)"}]}])
    assert not asked


def test_grades(spark, corpus):
    qs = corpus[3]
    a = spark.createDataFrame([("q1", "q1", "The laws of Ormland [1]"), ("q2", "q2", "odd")], "key string, qid string, answer string")
    c = queue([("Ormland", {"content": json.dumps({"correctness": " Correct ", "reason": "r"})}), ("odd", {"content": json.dumps({"correctness": "fine"})})])
    assert {r["key"]: r["grade"] for r in models.grade_answers(a, qs, c).collect()} == {"q1": "correct", "q2": None}


def test_matrix_is_resumed_and_shares_contexts(spark, corpus, tmp_path):
    docs, _, chunks, qs = corpus
    calls = spark.sparkContext.accumulator(0)

    def counting(make):
        def factory():
            client = make()

            def run(requests):
                calls.add(len(requests))
                return client(requests)

            return run

        return factory

    keys = [runs.BASELINE.format(chunking="fixed"), "fixed__bm25__nodense__none__overlap__k8__doc", "fixed__bm25__nodense__none__norerank__k8__doc__rawq"]
    res = runs.Resources(qs, chunks)
    got = runs.run_matrix(res, docs, f"file://{tmp_path}/run", keys, counting(models.extractive_client), counting(models.lexical_judge))
    assert got["scores"].count() == 9 == got["generation"].count() and got["scores"].select("config_id").distinct().count() == 3
    assert got["generation"].select("content_key").distinct().count() < 9
    first = calls.value
    again = runs.run_matrix(res, docs, f"file://{tmp_path}/run", keys, counting(models.extractive_client), counting(models.lexical_judge))
    assert calls.value == first and again["scores"].count() == 9
    scores = {(r["config_id"], r["qid"]): r for r in again["scores"].collect()}
    q1 = scores[keys[0], "q1"]
    assert q1["mrr"] == 1.0 and q1["faithfulness"] == 1.0 and json.loads(q1["judge_rationale"])["grade"]["grade"] in ("correct", "partial", "incorrect")
    m = {(r["config_id"], r["metric"]): r["mean"] for r in runs.matrix_summary(again["scores"], again["generation"], n_boot=40).collect()}
    assert m[keys[0], "citation_validity"] == 1.0 and (keys[0], "median_generation_ms") in m
    assert {r["candidate"] for r in runs.compare_with_baselines(again["scores"], keys, 40).collect()} == set(keys[1:])
    t = triage.triage_run(again, qs, chunks, docs)
    assert t.count() == 9 and {r["category"] for r in t.filter("qid = 'q3'").collect()} <= {"correct", "answered_unanswerable"}
    assert triage.summary_by_config(t).filter("category = 'all'").count() == 3 and triage.without_evidence(t).count() == 1


def test_ablation_and_choice_of_settings(spark, corpus, tmp_path):
    docs, _, chunks, qs = corpus
    cs = [retrieval.Config(), retrieval.Config(reranker="overlap"), retrieval.Config(doc_filter=False, raw_query=True)]
    res = runs.Resources(qs, chunks)
    got = runs.run_ablation(res, docs, f"file://{tmp_path}/ab", cs)
    assert got["scores"].count() == 9 and got["scores"].filter("mrr is null").count() == 0
    assert {(r["config_id"], r["split"]): r["n"] for r in got["summary"].collect()}[cs[0].config_id, "test"] == 2
    stamp = sorted(p.stat().st_mtime_ns for p in (tmp_path / "ab").rglob("*.parquet"))
    assert runs.run_ablation(res, docs, f"file://{tmp_path}/ab", cs)["scores"].count() == 9 and sorted(p.stat().st_mtime_ns for p in (tmp_path / "ab").rglob("*.parquet")) == stamp
    sel = spark.createDataFrame([(cs[1].config_id, 1), (cs[0].config_id, 2)], "config_id string, place int")
    best = spark.createDataFrame([("fixed", cs[1].config_id)], "chunking string, config_id string")
    assert runs.choose_configs(sel, best, [c.config_id for c in cs], extra=["x"], top=1) == [cs[1].config_id, cs[0].config_id, "x"]
    assert runs.estimated_latency(cs[:2], {"bm25": 0.04, "overlap": 2.0}) == {cs[0].config_id: 0.0, cs[1].config_id: 2.0}


def test_calibration(spark, corpus, tmp_path):
    docs, blocks, _, qs = corpus
    got = runs.run_calibration(qs, docs, blocks, f"file://{tmp_path}/cal", split="test")
    r = got["summary"].first()
    assert r["questions"] == 3 and r["citation_validity"] is not None
    items = {x["qid"]: x for x in got["items"].collect()}
    assert "faithfulness" not in got["items"].columns and any(e["text"] == CLAUSES[0] for e in items["q1"]["excerpts"]) and items["q1"]["excerpts"][0]["section"] == "Terms"
    assert runs.run_calibration(qs, docs, blocks, f"file://{tmp_path}/cal", split="test")["answers"].count() == 3


def test_questions_out_of_annotations(spark, corpus):
    docs = corpus[0]
    ask = lambda c: f'Highlight the parts related to "{c}" that should be reviewed.'
    rows = [("d1", ask("Law"), CLAUSES[0][:50]), ("d1", ask("Law"), CLAUSES[0][:40]), ("d1", ask("Notice"), CLAUSES[1]), ("d2", ask("Notice"), CLAUSES[1]), ("d2", ask("Law"), "[●]"), ("d1", ask("Fee"), "not in the text at all xx"), ("d1", "no category", "x")]
    spans = questions.annotated_spans(spark.createDataFrame(rows, "doc_id string, question string, answer string"))
    placed = questions.place_spans(spans, docs)
    assert {(r["doc_id"], r["category"], r["position"]) for r in placed.collect()} == {("d1", "Law", 0), ("d1", "Notice", TEXT.index(CLAUSES[1])), ("d2", "Notice", TEXT.index(CLAUSES[1]) + 1)}
    sheet = spark.createDataFrame([("d1", "Document Name-Answer", "SUPPLY AGREEMENT"), ("d1", "Parties - Answer", "Acme Inc.; Beta LLC"), ("d1", "Law-Answer", "Ormland"), ("d1", "Fee-Answer", "No"), ("d2", "Cap-Answer", None)], "doc_id string, column string, value string")
    found = questions.contracts(placed, spans, sheet, docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got["d1"]["name"] == "the Supply Agreement between Acme Inc. and Beta LLC" and got["d2"]["name"] == "the Agreement" and got["d1"]["dropped"] == 2 and got["d1"]["present"] == ["Fee", "Law", "Notice"]
    t = questions.templates(spark, [("derived", ("Law",), "Law of {name}?"), ("numeric", ("Notice",), "Days in {name}?"), ("unanswerable", ("Cap",), "Cap of {name}?"), ("multi_span", ("Law", "Notice"), "Both in {name}?")])
    pool = questions.candidates(found, t)
    have = {(r["doc_id"], r["qtype"]): r for r in pool.collect()}
    assert set(have) == {("d1", "derived"), ("d1", "numeric"), ("d2", "numeric"), ("d1", "unanswerable"), ("d2", "unanswerable"), ("d3", "unanswerable")}
    assert have["d1", "derived"]["reference"] == "Ormland" and have["d1", "derived"]["question"] == f"Law of {got['d1']['name']}?"
    splits = spark.createDataFrame([("d1", "dev"), ("d2", "test"), ("d3", "test")], "doc_id string, split string")
    quotas = {"dev": {"derived": 1, "numeric": 1, "unanswerable": 1}, "test": {"numeric": 1, "unanswerable": 1}}
    qs, short = questions.build_questions(pool, splits, quotas)
    rows = qs.orderBy("qid").collect()
    assert [(r["qid"], r["split"], r["qtype"]) for r in rows] == [("q0001", "dev", "numeric"), ("q0002", "dev", "unanswerable"), ("q0003", "test", "numeric"), ("q0004", "test", "unanswerable")]
    assert list(map(tuple, short.collect())) == [("dev", "derived", 1)] and not rows[1]["answerable"]  # the cap of two questions a document
    other = "d3" if rows[3]["doc_id"] == "d2" else "d2"
    again = questions.replace_questions(qs, pool, splits, {"q0004": "bad"})
    r = again.filter("qid = 'q0004'").first()
    assert r["doc_id"] == other and r["notes"] == "replaced: bad" and again.count() == 4
    with pytest.raises(ValueError):
        questions.replace_questions(qs, pool, splits, {"q0099": "x"})
    assert questions.build_questions(pool, splits, {})[0].count() == 0


def test_pickable_leaves_nothing_out_that_could_be_picked(spark):
    import random

    r = random.Random(3)
    rows = [(f"d{r.randint(0, 9)}", f"k{r.randint(0, 2)}") for _ in range(60)]
    rows = [(d, k, [k]) for d, k in sorted(set(rows))]
    df = spark.createDataFrame(rows, "doc_id string, key string, categories array<string>")
    for quota in (1, 3, 8):
        whole = sampling.select_round_robin(df.toPandas(), quota)
        cut = sampling.select_round_robin(questions.pickable(df, quota, 0).toPandas(), quota)
        assert whole[["doc_id", "key"]].values.tolist() == cut[["doc_id", "key"]].values.tolist()


def test_classification():
    kinds = lambda *a, **k: [(u.kind, u.text, u.level) for u in parse.classify(*a, **k)]
    assert kinds("2.1 Base Fees") == [("heading", "2.1 Base Fees", 2)] and kinds("ARTICLE IV GENERAL TERMS") == [("heading", "ARTICLE IV GENERAL TERMS", 1)]
    assert kinds("3. Term. It runs for two years and then ends.") == [("heading", "3. Term.", 1), ("paragraph", "It runs for two years and then ends.", None)]
    assert kinds('1.2 "Net Sales" means all that is sold by the supplier.') == [("heading", '1.2 "Net Sales"', 2), ("paragraph", "means all that is sold by the supplier.", None)]
    assert kinds("250 units are sold to the buyer") == [("paragraph", "250 units are sold to the buyer", None)] and kinds("Fees ........ 12") == [("other", "Fees ........ 12", None)]
    assert kinds("(a) it pays") == [("list_item", "(a) it pays", None)] and kinds("Note", bold=0.9) == [("heading", "Note", 1)] and kinds("Is it bold?", bold=0.9)[0][0] == "paragraph"
    assert kinds("x", True) == [("table", "x", None)] and kinds("Fees", tag=("heading", 3)) == [("heading", "Fees", 3)]
    assert parse.markdown_of([["a|b"], ["c", "d"]]) == "| a\\|b |  |\n| --- | --- |\n| c | d |" and parse.markdown_of([]) == ""


def test_parsing_isolates_failures_and_keeps_what_was_parsed(spark, tmp_path):
    good = "<h1>Deal</h1><p>The supplier pays the buyer at once.</p><h2>2.1 Fees</h2><table><tr><td>A</td><td>1</td></tr></table>\f<p>The second page has more of it.</p>"
    pages = spark.createDataFrame([("d1", good), ("d2", "<p>x</p>"), ("d3", None), (None, good)], "doc_id string, html string")
    docs, blocks, bad = parse.tables_of(parse.parse_corpus(pages, f"file://{tmp_path}/cache"))
    d = docs.collect()
    assert [x["doc_id"] for x in d] == ["d1"] and d[0]["num_pages"] == 2 and {x["doc_id"] for x in bad.collect()} == {"d2", "d3"}
    b = blocks.orderBy("char_start").collect()
    assert all(d[0]["full_text"][x["char_start"] : x["char_end"]] == x["text"] for x in b) and [x["page"] for x in b] == [1, 1, 1, 1, 2]
    assert b[3]["block_type"] == "table" and b[3]["section_path"] == ["Deal", "2.1 Fees"] and b[0]["block_id"] == "d1::b00000"
    more = pages.unionByName(spark.createDataFrame([("d4", good)], "doc_id string, html string"))
    assert parse.parse_corpus(more, f"file://{tmp_path}/cache").select("doc_id").distinct().count() == 4


def test_commands(spark, corpus, tmp_path, capsys):
    from clauseforge.__main__ import main

    docs, blocks, chunks, qs = corpus
    for name, df in (("contracts", docs), ("blocks", blocks), ("chunks", chunks.withColumns({"token_count": F.lit(1), "has_table": F.lit(False)})), ("questions", qs)):
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    base = ["--data", f"file://{tmp_path}/in", "--out", f"file://{tmp_path}/out"]
    for argv in (["chunk", "--strategy", "fixed"], ["index", "--strategy", "fixed", "--model", "crc"], ["split"], ["matrix"], ["triage"], ["ask", "--doc", "d1", "--question", "What royalty?"], ["calibrate"]):
        main([argv[0], *base, *argv[1:]])
    out = capsys.readouterr().out
    assert "royalty is five percent" in out and (tmp_path / "out" / "index" / "fixed" / "docs").exists() and (tmp_path / "out" / "vectors" / files.collection("fixed", "crc")).exists()


def test_rows_added_by_phase_and_requests(spark, tmp_path):
    from clauseforge.streaming import events

    df = spark.createDataFrame([("a", "q1", "retrieval"), ("b", "q1", "retrieval")], "config_id string, qid string, phase string")
    files.append_partitioned(df, f"file://{tmp_path}/r")
    files.append_partitioned(df, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 4
    row = spark.createDataFrame([("r1", "d", 200, 1.5)], "request_id string, doc_id string, status int, latency_ms double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    files.log_requests(row, f"file://{tmp_path}/log")
    q = events.request_log(spark, f"file://{tmp_path}/log").writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("log").count() == 1
