import hashlib

import numpy as np
import pytest

from clauseforge.operators import labels, metrics

LIST = [("c", "q", i + 1, x) for i, x in enumerate("xbycz")]


def ranked(spark, rows=LIST):
    return spark.createDataFrame(rows, "config_id string, qid string, rank long, chunk_id string")


def held(spark, rows):
    return spark.createDataFrame(rows, "qid string, span_index long, chunk_id string")


def test_all_metrics(spark):
    r = metrics.score_lists(ranked(spark), held(spark, [("q", 0, "a"), ("q", 0, "b"), ("q", 1, "c")]), ks=(1, 2, 4)).first()
    assert r["recall_at"] == {1: 0.0, 2: 0.5, 4: 1.0}
    assert r["mrr"] == 0.5 and r["context_precision"] == 0.5 and r["context_recall"] == 1.0
    assert abs(r["chunk_recall"] - 2 / 3) < 1e-12 and r["hit"] == 1.0
    assert 0 < r["ndcg_at_10"] < 1


def test_uncovered_span_is_a_miss_and_no_evidence_is_null(spark):
    r = metrics.score_lists(ranked(spark), held(spark, [("q", 0, "b"), ("q", 1, None)]), ks=(4,)).first()
    assert r["recall_at"] == {4: 0.5}
    r = metrics.score_lists(ranked(spark), held(spark, [("other", 0, "b")]), ks=(4,)).first()
    assert r["recall_at"] is None and r["mrr"] is None and r["context_recall"] is None
    r = metrics.score_lists(ranked(spark), held(spark, [("q", 0, "nowhere")]), ks=(4,)).first()
    assert r["mrr"] == 0.0 and r["context_precision"] == 0.0
    assert metrics.metric_table(metrics.score_lists(ranked(spark), held(spark, []), ks=(4,))).count() == 0


@pytest.mark.parametrize(("pairs", "kappa"), [([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")], 0.5), ([("y", "y")] * 3, 1.0)])
def test_kappa(spark, pairs, kappa):
    df = spark.createDataFrame([*pairs, ("y", None)], "a string, b string")
    r = metrics.agreement(df, "a", "b").first()
    assert abs(r["kappa"] - kappa) < 1e-12 and r["n"] == len(pairs)


def test_native_bootstrap_holds_the_mean_and_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("g", f"k{i}", float(i % 2)) for i in range(20)] + [("g", "null", None)], "g string, k string, v double")
    a = metrics.bootstrap_native(df, ["g"], "v", "k", 50).first()
    b = metrics.bootstrap_native(df.repartition(7), ["g"], "v", "k", 50).first()
    assert a == b and a["n"] == 20 and a["ci_low"] <= a["mean"] == 0.5 <= a["ci_high"]
    assert metrics.bootstrap_native(df.limit(0), ["g"], "v", "k", 50).count() == 0


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 1, 2, 5)] + [("b", 7)], "g string, v int")
    got = {r["g"]: (r["n"], r["p50"]) for r in metrics.nearest_rank_by(df, ["g"], "v", (0.5,)).collect()}
    assert got == {"a": (4, 2), "b": (1, 7)}


def test_labels(spark):
    q = spark.createDataFrame([("q", "d", ["laws of New York", "nowhere at all in here"], True), ("n", None, ["x"], True)], "qid string, doc_id string, evidence_spans array<string>, answerable boolean")
    d = spark.createDataFrame([("d", "It is governed by the laws of New York. The laws of New-York.")], "doc_id string, full_text string")
    c = spark.createDataFrame([("d::0", "d", "fixed", 0, 40), ("d::1", "d", "fixed", 40, 60), ("d::2", "d", "section", 55, 60)], "chunk_id string, doc_id string, strategy string, char_start int, char_end int")
    e = {(r["qid"], r["span_index"]): (r["found"], r["occurrences"]) for r in labels.locate_exact(q, d).collect()}
    assert e == {("q", 0): (True, 2), ("q", 1): (False, 0), ("n", 0): (False, 0)}
    a = labels.align(q, d)
    held_ = {(r["strategy"], r["chunk_id"]) for r in labels.relevant_chunks(a, c).collect()}
    assert held_ == {("fixed", "d::0"), ("section", None)}
    rep = {r["strategy"]: r for r in labels.alignment_report(q, a, labels.relevant_chunks(a, c)).collect()}
    assert rep["section"]["uncovered_spans"] == 1 and rep["fixed"]["unaligned_spans"] == 2 and rep["fixed"]["ambiguous_spans"] == 1


def poisson(key, rounds):
    """A row's weights drawn number by number."""
    steps, out = [24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535], []
    for r in range(rounds):
        u = int(hashlib.md5(f"{r // 8}~{key}".encode()).hexdigest()[4 * (r % 8) : 4 * (r % 8) + 4], 16)
        out.append(sum(u >= x for x in steps))
    return np.array(out, dtype=float)


def test_paired_differences_take_2000_rounds(spark):
    diffs = {f"q{i:02d}": ((i * 7) % 11 - 4) / 10 for i in range(23)}
    rows = [(c, q, "mrr", v if c == "new" else 0.0) for q, v in diffs.items() for c in ("old", "new")]
    t = spark.createDataFrame([*rows, ("old", "only", "mrr", 1.0)], "config_id string, qid string, metric string, value double")
    x = np.array([diffs[q] for q in sorted(diffs)])
    exact = np.random.default_rng(0).choice(x, size=(2000, len(x)), replace=True).mean(axis=1)
    w = np.stack([poisson(q, 2000) for q in sorted(diffs)])
    for found, means in ((metrics.paired_difference_exact(t, "old", "new"), exact), (metrics.paired_difference(t, "old", "new"), x @ w / w.sum(0))):
        r = found.first()
        low, high = np.quantile(means, [0.025, 0.975])
        assert (r["metric"], r["n"]) == ("mrr", 23) and r["mean"] == pytest.approx(x.mean())
        assert (r["ci_low"], r["ci_high"]) == (pytest.approx(low), pytest.approx(high)) and r["significant"] == (low > 0 or high < 0)


def test_weighted_intervals_are_those_of_drawing_rows():
    x = np.random.default_rng(1).normal(size=400)
    w = np.stack([poisson(f"k{i}", 2000) for i in range(400)])
    drawn = np.random.default_rng(0).choice(x, size=(2000, 400), replace=True).mean(axis=1)
    assert np.allclose(np.quantile(x @ w / w.sum(0), [0.025, 0.975]), np.quantile(drawn, [0.025, 0.975]), atol=0.02)


def test_agreement_report_and_stage_scores(spark):
    h = spark.createDataFrame([("q1", "yes", "no"), ("q2", "no", ""), ("q3", "yes", "partial")], "qid string, faithful string, correct string")
    j = metrics.judge_labels(spark.createDataFrame([("q1", 1.0, 0.0), ("q2", 0.5, 1.0), ("q3", 0.2, None)], "qid string, faithfulness double, answer_correctness double"))
    got = {r["field"]: r for r in metrics.agreement_report(h, j).collect()}
    assert got["faithful"]["n"] == 3 and got["faithful"]["confusion"] == {"no -> no": 1, "yes -> no": 1, "yes -> yes": 1}
    assert got["correct"]["n"] == 1 and got["correct"]["kappa"] == 1.0
    rows = [("c", "q", s, i + 1, x) for s, ids in (("bm25", "abcd"), ("final", "ba")) for i, x in enumerate(ids)]
    lists = spark.createDataFrame(rows, "config_id string, qid string, stage string, rank long, chunk_id string")
    s = {r["config_id"]: r for r in metrics.score_stages(lists, held(spark, [("q", 0, "c"), ("q", 1, "b")]), ks=(1, 3)).collect()}
    assert set(s) == {"c", "c@bm25"} and s["c@bm25"]["recall_at"] == {1: 0.0, 3: 1.0} and s["c@bm25"]["context_recall"] == 0.5 == s["c"]["context_recall"]
