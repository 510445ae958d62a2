import itertools
import random

import pytest

from clauseforge.llm import packing as P


def padding(hist, bounds):
    return sum((min(b for b in bounds if b >= s) - s) * n for s, n in hist.items())


@pytest.mark.parametrize("seed", range(8))
def test_buckets_are_optimal(seed):
    r = random.Random(seed)
    hist = {r.randint(1, 60): r.randint(1, 9) for _ in range(9)}
    k = r.randint(1, 5)
    got = P.length_buckets(hist, k)
    sizes = sorted(hist)
    best = min(padding(hist, (*c, sizes[-1])) for n in range(k) for c in itertools.combinations(sizes[:-1], n))
    assert len(got) <= k and padding(hist, got) == best


@pytest.mark.parametrize("seed", range(5))
def test_batches_stay_within_the_budget(seed):
    r = random.Random(seed)
    counts = {r.randint(0, 100): r.randint(1, 500) for _ in range(20)}
    segments, n = P.fill(counts, 100)
    load = [0] * n
    taken = dict.fromkeys(counts, 0)
    for s in segments:
        assert s.start == taken[s.bucket]
        taken[s.bucket] = s.end
        for k in range(s.start, s.end):
            load[s.first + (k - s.start) // s.each] += s.bucket
    assert taken == counts and max(load) <= 100
    assert P.fill({}, 10) == ([], 0)


def test_pack(spark, monkeypatch):
    r = random.Random(5)
    sizes = [(i, r.randint(0, 120)) for i in range(400)] + [(1000, 2500), (1001, 100), (1002, 200)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 128), (2, 128)], "capacity_id int, capacity_tokens int")
    for block in (P.RANK_BLOCK, 50):  # one rank per bucket, and ranks from blocks
        monkeypatch.setattr(P, "RANK_BLOCK", block)
        rows = P.pack(df, caps).collect()
        for cid, cap in ((1, 100), (2, 128)):
            own = [x for x in rows if x["capacity_id"] == cid]
            load, parts = {}, {}
            for x in own:
                load[x["container_id"]] = load.get(x["container_id"], 0) + x["n_tokens"]
                parts.setdefault(x["doc_id"], []).append((x["part"], x["token_start"], x["n_tokens"]))
            assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
            for d, n in sizes:
                got = sorted(parts[d])
                assert sum(p[2] for p in got) == n and [p[0] for p in got] == list(range(len(got)))
                assert len(got) == max(1, -(-n // cap)) and all(p[1] == k * cap for k, p in enumerate(got))
            assert sum(load.values()) / (len(load) * cap) > 0.9


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(1, 10)], "capacity_id int, capacity_tokens int")
    assert P.pack(df, caps).count() == 0 and P.pack(df, caps.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, spark.createDataFrame([(1, 0)], "capacity_id int, capacity_tokens int"))
    d = spark.createDataFrame([(1, "one two three", "x"), (1, "one two three", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, size string")
    got = {r["doc_id"]: r["n_tokens"] for r in P.pack_documents(d, caps).collect()}
    assert got == {1: 3, 3: 0}
    assert P.utilisation(P.pack_documents(d, caps)).first()["containers"] == 1
