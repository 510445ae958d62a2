import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clauseforge.operators import ablation, chunking, ingest, judge, sampling, triage
from clauseforge.sources import files
from clauseforge.streaming import events as streaming


def test_fixed_windows(spark):
    text = "  ".join(f"w{i}" for i in range(25))
    d = spark.createDataFrame([("d", text), ("one", "x"), ("none", "  "), ("null", None)], "doc_id string, full_text string")
    got = chunking.fixed_windows(d, 10, 2).orderBy("doc_id", "chunk_index").collect()
    d_rows = [r for r in got if r["doc_id"] == "d"]
    assert [text[r["char_start"] : r["char_end"]].split()[0] for r in d_rows] == ["w0", "w8", "w16"]
    assert [r["token_count"] for r in d_rows] == [10, 10, 9] and {r["doc_id"] for r in got} == {"d", "one"}
    with pytest.raises(ValueError):
        chunking.fixed_windows(d, 4, 4)


BLOCKS = [
    ("d", "b0", "heading", "1. Term", 0, 7, 1, ["Term"]),
    ("d", "b1", "paragraph", "It starts now. It ends later on some day.", 9, 50, 1, ["Term"]),
    ("d", "b2", "heading", "2. Fees", 52, 59, 2, ["Fees"]),
    ("d", "b3", "heading", "2.1 Base", 61, 69, 2, ["Fees", "Base"]),
    ("d", "b4", "table", "a b c d e", 71, 80, 3, ["Fees", "Base"]),
]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "doc_id string, block_id string, block_type string, text string, char_start int, char_end int, page int, section_path array<string>")


def test_sections_never_leave_a_heading_alone(spark):
    b = blocks(spark)
    assert [r["section"] for r in chunking.sections(b).orderBy("char_start").collect()] == [0, 0, 1, 1, 1]
    got = chunking.section_chunks(b, b.select("doc_id"), 4).orderBy("chunk_index").collect()
    assert [(r["char_start"], r["char_end"]) for r in got][0][0] == 0 and all(r["char_end"] > r["char_start"] for r in got)
    assert got[-1]["char_end"] == 80
    assert chunking.section_chunks(b.limit(0), b.select("doc_id"), 4).count() == 0 == chunking.section_chunks(b, b.select("doc_id").limit(0)).count()


def test_section_packing():
    p = chunking.pack_section
    full, head = "paragraph", "heading"
    assert p([(head, 0, 2), (full, 2, 10)], 10) == [(0, 10)]
    assert p([(head, 0, 2), (full, 2, 12)], 10) == [(0, 10), (10, 12)]  # a heading never makes a chunk too large, and isn't left alone
    assert p([(full, 0, 4), (full, 4, 9), (full, 9, 12)], 8) == [(0, 4), (4, 12)]
    assert p([(full, 0, 3), (full, 3, 25), (full, 25, 27)], 10) == [(0, 10), (10, 20), (20, 25), (25, 27)]  # the rest of a large block stays by itself
    assert p([(head, 0, 2), (head, 2, 4)], 10) == [(0, 4)] and p([], 10) == []
    for seed in range(200):
        import random

        r, at, blocks = random.Random(seed), 0, []
        for _ in range(r.randint(1, 8)):
            n = r.randint(1, 14)
            blocks.append((r.choice([head, full]), at, at + n))
            at += n
        got = p(blocks, 9)
        assert [a for a, _ in got[1:]] == [b for _, b in got[:-1]] and got[0][0] == 0 and got[-1][1] == at and all(0 < b - a <= 9 for a, b in got)


def test_short_tables_are_units_of_their_own(spark):
    rows = [("d", "a", "heading", 0, 5, 2), ("d", "b", "table", 6, 8, 1), ("d", "c", "paragraph", 9, 12, 1), ("d", "e", "paragraph", 13, 60, 9), ("d", "f", "other", 61, 63, 1), ("d", "g", "heading", 64, 66, 1), ("h", "x", "heading", 0, 4, 1)]
    u = chunking.attach_prefixes(spark.createDataFrame(rows, "doc_id string, block_id string, block_type string, s long, e long, tokens long"))
    assert [tuple(r) for r in u.orderBy("doc_id", "unit").collect()] == [("d", 0, 0, 8, "b"), ("d", 1, 9, 60, "e"), ("d", 2, 61, 66, "f"), ("h", 0, 0, 4, "x")]


def test_chunk_rows(spark):
    text = "1. Term\n\nIt starts now. It ends later on some day.\n\n2. Fees\n\n2.1 Base\n\na b c d e"
    d = spark.createDataFrame([("d", text), ("n", None)], "doc_id string, full_text string")
    got = chunking.run_chunking(d, blocks(spark), ["fixed", "section", "sentence_window", "fixed"], max_tokens=6, overlap=1, window=1, min_tokens=3)
    rows = got.collect()
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] and r["chunk_id"].split("::")[:2] == ["d", r["strategy"]] for r in rows)
    assert len({r["chunk_id"] for r in rows}) == len(rows) and {r["strategy"] for r in rows} == set(chunking.STRATEGIES)
    assert all((r["context_text"] is not None) == (r["strategy"] == "sentence_window") for r in rows) and max(r["token_count"] for r in rows if r["strategy"] != "sentence_window") <= 6
    assert {tuple(r["section_path"]) for r in rows if r["has_table"] and r["strategy"] == "sentence_window"} == {("Fees", "Base")}
    with pytest.raises(ValueError):
        chunking.run_chunking(d, blocks(spark), ["other"])


def test_sentence_windows(spark):
    u = chunking.attach_prefixes(chunking.sentence_units(blocks(spark)), 3)
    rows = u.orderBy("unit").collect()
    assert rows[0]["s"] == 0 and rows[-1]["e"] == 80
    n = chunking.neighbourhoods(u, 1).orderBy("unit").collect()
    assert n[0]["context_start"] == 0 and n[0]["context_end"] == rows[1]["e"]


def test_roll_up(spark):
    r = spark.createDataFrame([("d", 0, 55, 75)], "doc_id string, chunk_index int, char_start int, char_end int")
    x = chunking.roll_up(r, blocks(spark)).first()
    assert (x["page_start"], x["page_end"], x["has_table"], x["section_path"]) == (2, 3, True, ["Fees"])


def test_blocks_offsets_margins(spark):
    d = spark.createDataFrame([("d", "ab\n\ncd\n\n\n\ne"), ("x", ""), ("n", None)], "doc_id string, full_text string")
    got = [(r["text"], r["char_start"], r["char_end"]) for r in ingest.text_blocks(d).orderBy("pos").collect()]
    assert got == [("ab", 0, 2), ("cd", 4, 6), ("e", 10, 11)]
    b = spark.createDataFrame([("d", f"b{p}{k}", p, t, 100 * p + k, 100 * p + k + 1) for p in (1, 2, 3) for k, t in enumerate((f"Acme page {p}", f"Body {'x' * p} text", "same in the body", f"– {p} –"))], "doc_id string, block_id string, page int, text string, char_start int, char_end int")
    m = ingest.repeated_margins(b)
    assert {r["key"] for r in m.collect()} == {"acme page #", "– # –"}
    assert {r["text"] for r in ingest.drop_margins(b, m).collect()} == {"Body x text", "Body xx text", "Body xxx text", "same in the body"}
    lay = b.withColumns({"y0": F.lit(50.0), "y1": F.lit(60.0), "page_height": F.lit(100.0)})
    assert ingest.repeated_margins(lay).count() == 0 and ingest.repeated_margins(lay.withColumn("y1", F.lit(95.0))).count() == 3


def test_section_stack_and_tables(spark):
    h = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, None, "t"), ("d", 2, 3, "B"), ("d", 3, 2, "C"), ("d", 4, 1, "D")], "doc_id string, pos long, level int, text string")
    assert [r["section_path"] for r in ingest.section_paths(h).orderBy("pos").collect()] == [["A"], ["A"], ["A", "B"], ["A", "C"], ["D"]]
    b = spark.createDataFrame([("d", "in", 1, 0.0, 0.0, 10.0, 10.0), ("d", "out", 1, 50.0, 50.0, 60.0, 60.0)], "doc_id string, block_id string, page int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, 0.0, 0.0, 20.0, 6.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["block_id"] for r in ingest.outside_tables(b, t).collect()] == ["out"]
    lay = spark.createDataFrame([("d", "x" * 50, 11.2), ("d", "x" * 50, 10.6), ("d", "y", 30.0), ("e", "y", 9.0)], "doc_id string, text string, font_size double")
    assert {r["doc_id"]: round(r["body_size"], 6) for r in ingest.body_font(lay).collect()} == {"d": 10.9, "e": 10.0}


def test_reconcile_and_resume(spark):
    listed = spark.createDataFrame([("acmedeal", "a"), ("betterdealwithname", "b"), ("gone", "g"), ("twofilesxx", "t"), ("ab", "s"), ("longname", "l"), ("twice", "w")], "key string, doc_id string")
    f = spark.createDataFrame([("acmedeal", "1"), ("betterdeal", "2"), ("twofilesxx1", "3"), ("twofilesxx2", "4"), ("abzz", "5"), ("lon", "6"), ("twice", "7"), ("twice", "8")], "key string, path string")
    got = {r["doc_id"]: (r["path"], r["how"]) for r in ingest.reconcile(listed, f).collect()}
    assert got == {"a": ("1", "exact"), "b": ("2", "prefix"), "g": (None, "missing"), "t": (None, "ambiguous"), "s": ("5", "prefix"), "l": ("6", "prefix"), "w": (None, "ambiguous")}
    done = spark.createDataFrame([("c1", "q1"), ("c1", "q2"), ("c2", "q1")], "config_id string, qid string")
    assert [r["config_id"] for r in ingest.settings_to_do(done.select("config_id").distinct(), done, 2).collect()] == ["c2"]
    assert ingest.upsert(done, done.limit(1), ["config_id", "qid"]).count() == 3


def test_sampling(spark):
    assert sampling.allocate({"A": 8, "B": 4, "C": 3}, 7) == {"A": 4, "B": 2, "C": 1}
    assert sampling.allocate({}, 3) == {} and sum(sampling.allocate({"A": 1, "B": 1}, 9).values()) == 2
    df = spark.createDataFrame([("A", f"a{i}") for i in range(8)] + [("B", f"b{i}") for i in range(4)] + [(None, "n")], "t string, k string")
    got = sampling.stratified(df, "t", "k", 6)
    assert {r["t"]: r["count"] for r in got.groupBy("t").count().collect()} == {"A": 4, "B": 2}
    s = sampling.split_documents(df.withColumnRenamed("k", "doc_id"), 0.3)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"dev": 4, "test": 9}
    c = pd.DataFrame([{"doc_id": f"d{i % 3}", "key": f"c{i % 2}", "categories": [f"c{i % 2}"]} for i in range(6)])
    picked = sampling.select_round_robin(c, 5, per_doc=2)
    assert len(picked) == 5 and picked.groupby("doc_id").size().max() <= 2 and not picked[['doc_id', 'key']].duplicated().any()


def test_question_building(spark):
    sp = spark.createDataFrame([("d", "A", "pays $5 fee", 0), ("d", "B", "5% of [***]", 100), ("d", "A", "$5", 3000), ("e", "B", "90 days", 1)], "doc_id string, category string, text string, position int")
    assert {(r["doc_id"], r["category"]) for r in sampling.numeric_candidates(sp).collect()} == {("d", "A"), ("e", "B")}
    assert {(r["category_a"], r["category_b"]) for r in sampling.far_apart(sp).collect()} == {("A", "A")}
    assert sampling.drop_contained(sp).count() == 3
    t = spark.createDataFrame([("A", "What is A of {name}?")], "category string, template string")
    n = spark.createDataFrame([("d", "the Deal")], "doc_id string, name string")
    assert sampling.fill_templates(sp.select("doc_id", "category").distinct(), t, n).first()["question"] == "What is A of the Deal?"
    pairs = spark.createDataFrame([("d", "C", "No"), ("d", "A", ""), ("d", "D", "Yes")], "doc_id string, category string, answer string")
    assert [r["category"] for r in sampling.absent_categories(pairs, sp).collect()] == ["C"]


def test_judging(spark):
    a = spark.createDataFrame([("r1", "Delaware law governs [1]. It ends in 30 days [2].", False, True), ("r2", "The text does not state it.", False, False), ("r3", "", False, True)], "request_id string, answer string, abstained boolean, answerable boolean")
    c = spark.createDataFrame([("r1", 1, "Governed by Delaware law."), ("r1", 2, "Ends in ninety days")], "request_id string, n int, text string")
    st = judge.check_statements(judge.cited_excerpts(judge.answer_statements(a), c))
    assert {r["statement"]: r["supported"] for r in st.filter("request_id = 'r1'").collect()} == {"Delaware law governs": True, "It ends in 30 days": False}
    g = spark.createDataFrame([("r1", "Partial "), ("r3", "correct")], "request_id string, grade string")
    s = {r["request_id"]: r for r in judge.score_answers(a.withColumn("valid_citations", F.lit(2)).withColumn("invalid_citations", F.lit(0)), st, g).collect()}
    assert s["r1"]["faithfulness"] == 0.5 and s["r1"]["answer_correctness"] == 0.5
    assert s["r2"]["abstention_correct"] and s["r2"]["faithfulness"] is None and s["r3"]["answer_correctness"] == 0.0


def test_model_output_parsing(spark):
    ok = json.dumps({"verdicts": [{"id": 1, "supported": True, "on_topic": True, "reason": ""}, {"id": 1, "supported": False, "on_topic": True, "reason": ""}, {"id": 2, "supported": False, "on_topic": True, "reason": ""}]})
    df = spark.createDataFrame([(ok, 2), (ok, 3), ("nonsense", 1), (None, 0)], "raw string, n int")
    got = [r["v"] for r in df.select(judge.parse_verdicts(F.col("raw"), F.col("n")).alias("v")).collect()]
    assert [x["supported"] for x in got[0]] == [True, False] and got[1] is None and got[2] is None
    out = spark.createDataFrame([('{"answer": "", "abstained": true}',), ("plain text",), (None,)], "raw string").select(judge.parse_output(F.col("raw")).alias("o")).collect()
    assert out[0]["o"]["abstained"] and out[0]["o"]["answer"].startswith("The provided") and out[1]["o"]["answer"] == "plain text" and out[2]["o"]["answer"] == ""


def test_triage_ladder(spark):
    tr = [("c", "q1", 0, True, 1, None, 1, True), ("c", "q2", 0, False, None, None, None, False), ("c", "q3", 0, True, None, None, None, False), ("c", "q4", 0, True, 9, 2, None, False), ("c", "q5", 0, True, 30, None, None, False), ("c", "q6", 0, True, 1, 1, 1, True), ("c", "q6", 1, True, 9, None, None, False)]
    t = spark.createDataFrame(tr, "config_id string, qid string, span_index long, covered boolean, candidate_rank long, prerank_rank long, final_rank long, delivered boolean")
    rows = [("c", q, "x", True, False, 0.0, None, True) for q in ("q2", "q3", "q4", "q5", "q6", "q9")] + [("c", "q1", "x", True, True, 0.0, None, True), ("c", "q7", "x", False, False, None, None, True), ("c", "q8", "x", True, True, 1.0, None, True)]
    a = spark.createDataFrame(rows, "config_id string, qid string, qtype string, answerable boolean, declined boolean, correctness double, faithfulness double, reranked boolean")
    got = {r["qid"]: r["category"] for r in triage.triage(a, t).collect()}
    assert got == {"q1": "refused_with_evidence", "q2": "lost_in_chunking", "q3": "retrieval_miss", "q4": "reranker_demotion", "q5": "ranking_miss", "q6": "partial_evidence", "q7": "answered_unanswerable", "q8": "correct", "q9": "lost_in_chunking"}
    assert {r["name"]: r["failures"] for r in triage.summary(triage.triage(a, t)).filter("level = 'stage'").collect()} == {"retrieval": 6, "generation": 2}


def test_selection_folds_equal_settings(spark):
    s = spark.createDataFrame([(c, q, x, x) for c, x in (("a", 1.0), ("b", 1.0), ("c", 0.5)) for q in ("q1", "q2")], "config_id string, qid string, context_recall double, mrr double")
    o = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "config_id string, grid_order int")
    assert [(r["config_id"], r["folded"]) for r in ablation.select_configs(s, o).orderBy("place").collect()] == [("b", 1), ("c", 0)]
    l = [spark.createDataFrame(x, "config_id string, place int") for x in ([("a", 1), ("b", 2)], [("b", 1), ("z", 2)])]
    assert [r["config_id"] for r in ablation.ordered_union(l, "config_id").collect()] == ["a", "b", "z"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿name,note\na,\"1,2\"\n", encoding="utf-8")
    df = files.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert df.columns == ["name", "note"] and df.first()["note"] == "1,2"
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "chunk", missing_ok=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "d", "num_pages": "x"}\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "document").collect()
    sq = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a", "answer_start": 3}]}, {"id": "2", "question": "r", "answers": []}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(sq))
    assert [(r["qa_id"], r["answer"]) for r in files.read_squad(spark, f"file://{tmp_path}/s.json").orderBy("qa_id").collect()] == [("1", "a"), ("2", None)]
    assert files.checksums(spark, f"file://{tmp_path}", "*.csv").first()["md5"]


def test_html(spark):
    h = "<html><head><title>no</title></head><nav>skip</nav><h2>Fees</h2><p>Pay <b>now</b>.</p><table><tr><th>A</th><td>1</td></tr></table><li>x"
    got = files.html_blocks(spark.createDataFrame([(1, h), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["block_type"], r["level"], r["text"]) for r in got] == [("heading", 2, "Fees"), ("paragraph", None, "Pay now."), ("table", None, ""), ("list_item", None, "x")]
    assert got[2]["rows"] == [["A", "1"]]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-01 00:50:00", 1, "a", 2.0), (3, "2024-01-01 01:10:00", 2, "b", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    q = streaming.windowed_counts(streaming.event_stream(spark, f"{tmp_path}/in", df.schema)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streaming.windowed_counts(df).collect()))


def test_service(spark):
    from clauseforge.plans.service import QuestionService, UnknownDocument

    d = spark.createDataFrame([("d", "Deal", "ACME,INC_06_02_2020-EX-10.7-SUPPLY AGREEMENT", 2)], "doc_id string, title string, source_path string, num_pages int")
    c = spark.createDataFrame([("d::fixed::0", "d", "fixed", "The royalty is five percent.", None, ["Fees"], 1, 1)], "chunk_id string, doc_id string, strategy string, text string, context_text string, section_path array<string>, page_start int, page_end int")
    s = QuestionService(spark, d, c)
    got = s.ask("d", "What royalty?")
    assert got["citations"][0]["section"] == "Fees" and not got["abstained"] and got["invalid_citations"] == 0
    assert s.ask("d", "unrelated words")["abstained"]
    with pytest.raises(UnknownDocument):
        s.ask("x", "y")
    assert s.contracts().first()["source"] == "Supply Agreement · Acme, Inc · 2020"
