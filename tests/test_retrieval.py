import pytest

from clauseforge.operators import retrieval as R

CHUNKS = [
    ("c1", "d1", "Either party may terminate this agreement with notice."),
    ("c2", "d1", "The governing law is the law of Delaware."),
    ("c3", "d2", "Termination for cause requires written notice."),
    ("c4", "d2", "Royalties are paid quarterly."),
    ("c5", "d2", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string")


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("qid", "rank").collect()]


def ask(spark, text, doc=None):
    return spark.createDataFrame([("q", text, doc)], "qid string, question string, doc_id string")


def test_bm25_scope_and_empty_lists(spark, chunks):
    ix = R.build_index(chunks)
    assert ids(R.bm25(ix, R.query_terms(ask(spark, "royalties paid")))) == ["c4"]
    assert set(ids(R.bm25(ix, R.query_terms(ask(spark, "notice"))))) == {"c1", "c3"}
    assert ids(R.bm25(ix, R.query_terms(ask(spark, "notice", "d2")))) == ["c3"]
    assert ids(R.bm25(ix, R.query_terms(ask(spark, "notice", "gone")))) == []
    assert ids(R.bm25(ix, R.query_terms(ask(spark, "unheard of")))) == []
    assert ids(R.bm25(R.build_index(chunks.limit(0)), R.query_terms(ask(spark, "notice")))) == []


def test_scope_does_not_change_scores(spark, chunks):
    ix = R.build_index(chunks)
    score = lambda doc: {r["chunk_id"]: r["score"] for r in R.bm25(ix, R.query_terms(ask(spark, "notice", doc))).collect()}
    assert score(None)["c3"] == score("d2")["c3"]


def test_stemming_matches_word_forms(spark, chunks):
    ix = R.build_index(chunks, stemmed=True)
    assert set(ids(R.bm25(ix, R.query_terms(ask(spark, "terminating"), stemmed=True)))) == {"c1", "c3"}


def lists(spark, **stages):
    rows = [("q", s, i + 1, c, float(x)) for s, cs in stages.items() for i, (c, x) in enumerate(cs)]
    return spark.createDataFrame(rows, "qid string, stage string, rank long, chunk_id string, score double")


def test_rrf_sums_reciprocal_ranks_of_every_list(spark):
    three = lists(spark, bm25=[("m", 9), ("n", 8)], dense=[("n", 0.7), ("o", 0.6), ("m", 0.5)], other=[("o", 1)])
    want = {"m": 1 / 8 + 1 / 10, "n": 1 / 9 + 1 / 8, "o": 1 / 9 + 1 / 8}
    got = R.rrf(three, k=7).orderBy("rank").collect()
    assert {r["chunk_id"]: round(r["score"], 12) for r in got} == {c: round(x, 12) for c, x in want.items()}
    assert [r["chunk_id"] for r in got] == ["n", "o", "m"]  # n and o tie in score and best rank: the smaller id first
    assert ids(R.rrf(three, k=7, cut=1)) == ["n"] and ids(R.rrf(three.limit(0))) == []


def test_weighted_fusion_scales_each_list_by_itself(spark):
    sparse, vectors = lists(spark, bm25=[("p", 40), ("q", 30), ("r", 20)]), lists(spark, dense=[("r", 0.5), ("s", 0.5)])
    for alpha in (0.0, 0.25, 1.0):
        want = {"p": 1 - alpha, "q": (1 - alpha) / 2, "r": alpha, "s": alpha}  # a list of equal scores counts full, a missing chunk nothing
        got = {r["chunk_id"]: r["score"] for r in R.weighted(sparse, vectors, alpha).collect()}
        assert all(abs(got[c] - x) < 1e-12 for c, x in want.items()) and len(got) == 4
    assert ids(R.weighted(sparse, vectors, 0.0, cut=2)) == ["p", "q"]
    with pytest.raises(ValueError):
        R.weighted(sparse, vectors, -0.1)


def test_blocks_of_questions_and_of_vectors_change_nothing(spark, chunks, monkeypatch):
    ix = R.build_index(chunks)
    q = spark.createDataFrame([(f"q{i}", t, d) for i, (t, d) in enumerate([("notice law", None), ("royalties", "d2"), ("notice", "d1"), ("delaware notice cause", None)])], "qid string, question string, doc_id string")
    v = spark.createDataFrame([(f"v{i:02}", [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [("w", [1.0, 0.0])], "chunk_id string, vec array<float>")
    asked = v.limit(7).select(R.F.col("chunk_id").alias("qid"), R.F.col("vec").alias("qvec"))
    whole = sorted(map(tuple, R.bm25(ix, R.query_terms(q), 2).collect())), sorted(map(tuple, R.dense(v, asked, 3).collect()))
    monkeypatch.setattr(R, "BLOCK_ROWS", 2)
    monkeypatch.setattr(R, "BLOCK_VECTORS", 2)
    monkeypatch.setattr(R, "KEPT", 3)
    assert (sorted(map(tuple, R.bm25(ix, R.query_terms(q), 2).collect())), sorted(map(tuple, R.dense(v, asked, 3).collect()))) == whole


def test_dense_equals_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(f"c{i:03}", [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame([*rows, ("z", None)], "chunk_id string, vec array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    got = R.dense(v, v.filter("chunk_id < 'c005'").selectExpr("chunk_id as qid", "vec as qvec"), 4).collect()
    for q, x in rows[:5]:
        want = [c for c, _ in sorted(rows, key=lambda y: (-round(cos(x, y[1]), 12), y[0]))[:4]]
        assert [g["chunk_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["qid"] == q] == want


def test_encoded_questions_and_a_stored_index(spark, chunks, tmp_path):
    from clauseforge.sources import files

    q = R.encode_questions(ask(spark, "law of delaware"), prefix="query: ").first()
    assert len(q["qvec"]) == 64 and abs(sum(x * x for x in q["qvec"]) - 1) < 1e-5
    files.write_index(R.build_index(chunks), f"{tmp_path}/ix")
    again = files.read_index(spark, f"{tmp_path}/ix")
    assert ids(R.bm25(again, R.query_terms(ask(spark, "royalties paid")))) == ["c4"] and again.totals.first()["n"] == 5
    assert {(r["term"], r["tf"]) for r in again.postings.filter("chunk_id = 'c4'").collect()} == {("royalties", 1), ("are", 1), ("paid", 1), ("quarterly", 1)} - {("are", 1)}


def test_dense_leaves_out_unusable_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [2.0, 0.0])], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0])], "qid string, qvec array<float>")
    assert ids(R.dense(v, q)) == ["a", "d"]


def test_rerank_keeps_order_of_ties(spark, chunks):
    l = lists(spark, bm25=[("c4", 3), ("c1", 2), ("c3", 1)])
    assert ids(R.rerank(l, ask(spark, "written notice"), chunks)) == ["c3", "c4", "c1"]


def test_scoped_question(spark):
    df = spark.createDataFrame([("What does the A.B Deal say? A.B Deal!", "A.B Deal"), ("x", None), ("y", "")], "q string, n string")
    assert [r[0] for r in df.select(R.scoped_question("q", "n")).collect()] == ["What does the the agreement say? the agreement!", "x", "y"]


def test_configs_round_trip_and_reject():
    for c in R.grid(["fixed", "section"], ["m1", "m2"], ["r1"]):
        back = R.parse_config(c.config_id)
        assert back.config_id == c.config_id and back.doc_filter == c.doc_filter
    assert len(R.grid(["fixed"], ["m1", "m2"], ["r1"])) == (1 + 2 + 4) * 2 * 2 + 3
    for bad in ({"sparse": False}, {"dense_model": "m"}, {"fusion": "rrf"}, {"dense_model": "m", "fusion": "weighted"}, {"k_final": 60}):
        with pytest.raises(ValueError):
            R.Config(**bad)


def test_pipeline_keeps_every_stage(spark, chunks):
    q = ask(spark, "notice").selectExpr("*", "cast(null as string) as contract_name")
    d = lists(spark, dense=[("c4", 0.9), ("c1", 0.5)])
    c = R.Config(dense_model="m", fusion="rrf", reranker="overlap", k_final=2)
    got = R.run_pipeline(c, q, chunks, R.build_index(chunks), d)
    assert {r["stage"] for r in got.select("stage").distinct().collect()} == {"bm25", "dense", "fusion", "rerank", "final"}
    assert got.filter("stage = 'final'").count() == 2
