import random

import pytest

from clauseforge.llm import spans


def brute(docs, n):
    own = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            own.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in docs:
        runs = []
        for i in range(len(t or "") - n + 1):
            if len(own[t[i : i + n]]) > 1:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + n
                else:
                    runs.append([i, i + n])
        out |= {(d, a, b) for a, b in runs}
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdé中") for _ in range(k))
    shared = [word(r.randint(25, 90)) for _ in range(5)]
    docs = []
    for i in range(14):
        parts = [x for _ in range(4) for x in (word(r.randint(0, 50)), r.choice(shared)[r.randint(0, 12) : r.randint(20, 90)])]
        docs.append((f"d{i}", "".join(parts)))
    hot = word(60)
    docs += [(f"h{i}", word(9) + hot + word(9)) for i in range(12)]
    return docs + [("twice", shared[0][:22] + "-" + hot[:40] + "=" + hot[:40]), ("same", docs[0][1]), ("rep", "xyxyxyxy" * 20), ("rep2", "yxyxyx" * 12), ("empty", ""), ("null", None), ("short", "abc")]


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    docs = texts(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs + docs[:3]], "doc_id string, full_text string, dk int")
    got = {tuple(r) for r in spans.shared_spans(df, span=20, k=10).collect()}
    assert got == brute(docs, 20)


def test_offsets_count_code_points_and_empty_tables(spark):
    t = "é中ß" * 10
    df = spark.createDataFrame([("a", "x" + t), ("b", t + "yy"), (None, t)], "doc_id string, full_text string")
    assert {tuple(r) for r in spans.shared_spans(df, span=20, k=10).collect()} == {("a", 1, 31), ("b", 0, 30)}
    assert spans.shared_spans(df.limit(0)).count() == 0
    share = {r["doc_id"]: r["shared_share"] for r in spans.shared_share(spans.shared_spans(df.filter("doc_id is not null"), span=20, k=10), df.filter("doc_id is not null")).collect()}
    assert share["a"] == round(30 / 31, 6)


def test_chains_are_collinear_and_pay_for_gaps():
    lines = spans.chains([(0, 0), (10, 10), (20, 5), (30, 30), (5000, 40)], k=10, gap=0.1)
    best = [i for _, line in lines for i in line]
    assert sorted(best) == [0, 1, 2, 3, 4]
    for _, line in lines:
        assert line == sorted(line)
    assert lines[0][1] in ([0, 1, 3], [0, 2, 3]) and (10.0, [4]) in lines
    assert spans.chains([]) == []


def test_passages(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(200))
    df = spark.createDataFrame([("a", t), ("b", t[:90] + "#" + t[90:])], "doc_id string, full_text string")
    got = spans.shared_passages(df, span=40, k=20).filter("doc_id = 'a'").collect()
    assert got and all(r["partner"] == "b" for r in got) and sum(r["seeds"] for r in got) >= 2


def test_passages_keep_all_common_seeds_of_every_pair(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    one, two, three = word(60), word(70), word(80)
    docs = [("b", one + word(30) + two + word(30) + three), ("d", word(15) + one + word(9) + two + word(20) + three)]
    docs += [(f"x{i}{j}", word(20) + c + word(20)) for i, c in enumerate((one, two, three)) for j in range(3)]
    docs += [("b2", docs[0][1]), ("b3", docs[0][1]), ("alone", word(99))]
    df = spark.createDataFrame([*docs, docs[0], (None, one), ("null", None)], "doc_id string, full_text string")
    rows = spans.shared_passages(df, span=40, k=20).collect()
    got, text = {}, dict(docs)
    for q in rows:
        got[q["doc_id"], q["partner"]] = got.get((q["doc_id"], q["partner"]), 0) + q["seeds"]
    cut = {d: spans.seeds(t, 40, 20)[4].tolist() for d, t in docs}
    want = {(a, c): sum(cut[c].count(h) for h in cut[a]) for a in cut for c in cut if text[a] != text[c] and not {a, c} & {"b2", "b3"}}
    want |= {p: len(cut["b"]) for c in ("b2", "b3") for p in (("b", c), (c, "b"))}
    assert got == {p: n for p, n in want.items() if n}
    (whole,) = [q for q in rows if (q["doc_id"], q["partner"]) == ("b", "d")]
    assert whole["char_end"] - whole["char_start"] > 190 and text["b"][whole["char_start"] : whole["char_end"]].count(two) == 1
    assert spans.shared_passages(df.limit(0)).count() == 0


def test_passages_that_differ_every_hundred_letters(spark):
    r = random.Random(8)
    t = "".join(r.choice("abcdefghij") for _ in range(2000))
    other = "".join("#" if i % 100 == 50 else c for i, c in enumerate(t))
    df = spark.createDataFrame([("a", t), ("b", other)], "doc_id string, full_text string")
    assert {(q["doc_id"], q["partner"]) for q in spans.shared_passages(df).collect()} == {("a", "b"), ("b", "a")}


def test_chains_decide_what_is_shared(spark):
    """Without chains the result isn't the same: windows they settle aren't compared."""
    r = random.Random(5)
    clause = "".join(r.choice("abcdefgh") for _ in range(200))
    docs = [(f"d{i}", f"{i}" * (30 + i) + clause + f"{i}" * 40) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id string, full_text string")
    got = lambda: {tuple(x) for x in spans.shared_spans(df, span=40, k=20).collect()}
    whole = got()
    assert whole == brute(docs, 40) and len(whole) == 4
    h, place, first, last, _, _ = spans.seeds(docs[1][1], 40, 20)
    own = [{"pos": int(p), "rep_pos": int(p) + 5, "same": False, "on": True} for p in place]
    at = {int(p): i for i, p in enumerate(place)}
    line = spans.chains([(x["pos"], x["rep_pos"]) for x in own], 20)[0][1]
    assert spans.stretches(line, own, at, place, first, last, 40, 20) == [(int(place[0]), int(place[-1]) + 20, 5)]
    own[3]["on"] = False
    assert all(e - s >= 40 for s, e, _ in spans.stretches(line, own, at, place, first, last, 40, 20)) and spans.stretches([], own, at, place, first, last, 40, 20) == []


@pytest.mark.parametrize("seed", range(10, 16))
def test_many_partners_that_share_different_parts(spark, seed):
    r = random.Random(seed)
    base = "".join(r.choice("abc") for _ in range(160))
    docs = []
    for i in range(18):
        a = r.randint(0, 120)
        docs.append((f"d{i:02}", "".join(r.choice("xyz") for _ in range(r.randint(0, 9))) + base[a : a + r.randint(15, 70)] + "".join(r.choice("xyz") for _ in range(12))))
    df = spark.createDataFrame(docs, "doc_id string, full_text string")
    assert {tuple(x) for x in spans.shared_spans(df, span=20, k=10).collect()} == brute(docs, 20)
