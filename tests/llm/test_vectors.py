import math
import random

import numpy as np

from clauseforge.llm import vectors as V


def brute(rows, k=5):
    out = set()
    for m in {r[0] for r in rows}:
        own = {key: np.array(v) for mm, key, v in rows if mm == m}
        for a, x in own.items():
            near = sorted(((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), b) for b, y in own.items() if b != a))
            near = sorted(((round(s, 12), b) for s, b in near))[:k]
            out |= {(m, *sorted((a, b))) for _, b in near}
    return out


def data(seed, n=120, width=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [("m", f"k{i:04d}", [float(np.float32(c + r.gauss(0, 0.2))) for c in centres[i % 12]]) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "model string, key string, vector array<float>, slot int")
    return {tuple(r) for r in V.nearest_pairs(df, **kw).collect()}


def test_recall_against_brute_force(spark):
    rows = data(1) + [("other", k, v[:6]) for _, k, v in data(2, 40)]
    got, want = run(spark, rows + rows[:10]), brute(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_unusable_vectors_take_no_part(spark):
    rows = data(3, 30)
    bad = [("m", "z1", None), ("m", "z2", [0.0] * 8), ("m", "z3", [1.0] * 7), ("m", "z4", [math.nan] * 8), ("m", "z5", [math.inf] + [1.0] * 7), ("m", "z6", []), (None, "z7", [1.0] * 8), ("m", None, [1.0] * 8)]
    assert not {p for p in run(spark, rows + bad) for k in p[1:] if k.startswith("z")}


def test_many_copies_keep_all_their_neighbours_and_ties_go_to_small_keys(spark):
    rows = [("m", f"c{i:03d}", [1.0, 2.0, 3.0]) for i in range(40)] + [("m", "x", [3.0, 2.0, 1.0]), ("m", "y", [2.0, 4.0, 6.0])]
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_few_rows_and_empty_tables(spark):
    assert run(spark, [("m", "a", [1.0, 0.0])]) == set()
    assert run(spark, [("m", "a", [1.0, 0.0]), ("m", "b", [-1.0, 0.0])]) == {("m", "a", "b")}
    assert V.nearest_pairs(spark.createDataFrame([], "model string, key string, vector array<float>")).count() == 0


def test_chi_square_quantiles():
    assert abs(V.chi2_quantile(0.95, 1) - 3.841459) < 1e-4
    assert abs(V.chi2_quantile(0.5, 8) - 7.344121) < 1e-4


def test_tree_puts_every_row_in_the_box_of_its_cell():
    x = np.random.default_rng(0).normal(size=(3000, 16))
    t = V.ProjectionTree(x[:1000], 16, 16000, 4)
    p = V.unit(x).astype(np.float32) @ t.matrix
    assert t.cells == 16
    assert (t.distances(p)[np.arange(3000), t.cell(p)] == 0).all()


def test_models_in_groups_and_hot_groups_in_pieces(spark, monkeypatch):
    rows = data(4, 40) + [("other", k, v[:6]) for k, v in [(k, v) for _, k, v in data(5, 30)]] + [("third", f"c{i:03d}", [1.0, 2.0, 3.0]) for i in range(30)]
    whole = run(spark, rows)
    monkeypatch.setattr(V, "hot_keys", lambda df, key: [r[0] for r in df.select(key).distinct().collect()])
    assert run(spark, rows) == whole
    monkeypatch.setattr(V, "MAX_MODELS", 1)
    assert {p for p in run(spark, rows) if p[0] == "third"} == {p for p in whole if p[0] == "third"} and {p[0] for p in run(spark, rows)} == {"m", "other", "third"}


def test_cells_grow_and_the_sample_is_bounded():
    assert V.cells_of(100) == 1 and V.cells_of(1 << 20) == 1024 and V.cells_of(10**10) == 200_000
    assert all(V.cells_of(n) <= V.cells_of(4 * n) <= 4 * V.cells_of(n) for n in (10, 10**4, 10**6, 10**9))


def test_hadoop_paths_for_arrow():
    assert V.arrow_path("file:/tmp/x") == V.arrow_path("file:///tmp/x") == V.arrow_path("/tmp/x") == "/tmp/x"
    assert V.arrow_path("s3a://b/x") == "s3://b/x" and V.arrow_path("hdfs://n:8020/x") == "hdfs://n:8020/x" and V.arrow_path("dbfs:/mnt/x") == "/dbfs/mnt/x" and V.arrow_path("wasbs://c@a/x") == "abfss://c@a/x"
