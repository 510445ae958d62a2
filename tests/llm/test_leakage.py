import random

import pytest

from clauseforge.llm import leakage as L

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(400)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


ITEMS = [(i, text(R.randint(30, 60))) for i in range(12)] + [(98, ""), (99, None)]
ITEMS.append((50, ITEMS[0][1][: len(ITEMS[0][1]) // 2] + " " + text(30)))  # shares its start with item 0


def brute(doc):
    out = set()
    ws = L.folded(doc or "").split()
    for i, t in ITEMS:
        w = L.folded(t or "").split()
        need = -(-len(w) // 2)
        if need and any(w[k : k + need] == ws[j : j + need] for k in range(len(w) - need + 1) for j in range(len(ws) - need + 1)):
            out.add(i)
    return out


def docs():
    out = []
    for k in range(60):
        i, t = ITEMS[k % 12]
        w = t.split()
        n = R.choice([len(w), -(-len(w) // 2), len(w) // 2 - 2, len(w) // 3])
        at = R.randint(0, len(w) - n)
        out.append((k, text(40) + " " + " ".join(w[at : at + n]) + " " + text(40)))
    return out


DOCS = docs()


def test_matches_brute_force(spark):
    d = spark.createDataFrame([*DOCS, *DOCS[:3], (900, None), (901, ""), (902, "short")], "doc_id long, text string").withColumnRenamed("x", "x")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_items(d, items).collect()}
    assert got == {(k, i) for k, t in DOCS for i in brute(t)}
    assert L.leaked_items(d.limit(0), items).count() == 0 and L.leaked_items(d, items.limit(0)).count() == 0


def test_disguises_make_no_difference():
    a = L.Items([(1, "The quick brown fox jumps over the lazy dog by the cold river bank")])
    for t in ("THE QUICK, brown-fox; jumps over the LAZY dog!", "Tһе quісk brоwn fох јumps оvеr tһе lаzу dоg", "The qu​ick br­own foxjumps overthe lazy dog", "Ｔｈｅ quick brown fox jumps over the lazy"):
        assert [x[0] for x in a.found("Before this. " + t + " After that.")] == [1]
    assert a.found("The quick brown cat jumps over a lazy dog") == []


def test_one_changed_letter_splits_a_run_but_hides_neither_part():
    item = text(120)
    auto = L.Items([(1, item), (2, text(20))])
    s = L.letters(item)
    for at in (115, 150, 210):
        doc = s[:at] + "z" + s[at + 1 :] + " " + text(50)
        (found,) = auto.found(doc)
        words = L._WORD.findall(item)
        ends = [sum(map(len, words[: k + 1])) for k in range(len(words))]
        assert found == (1, sum(e - len(w) > at for e, w in zip(ends, words)), 120)


def test_parts_give_what_one_automaton_gives(spark, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, (77, "two words"), (78, "ab")], "item_id long, text string")
    whole = {tuple(r) for r in L.leaked_items(d, items).collect()}
    assert {(k, i) for k, t in DOCS for i in brute(t)} <= {r[:2] for r in whole} and any(r[1] == 78 for r in whole)
    monkeypatch.setattr(L, "PART_CHARS", 900)
    assert len(list(L._parts(items))) > 2 and {tuple(r) for r in L.leaked_items(d, items).collect()} == whole


def test_short_items_leave_the_search_for_others_alone():
    alone, mixed = L.Items([ITEMS[1]]), L.Items([ITEMS[1], (5, "two words")])
    assert [(g.k, g.step) for g in alone.groups] == [(g.k, g.step) for g in mixed.groups[-1:]]
    assert mixed.found("There are two here") == [(5, 1, 2)]


def test_runs_are_found_by_the_automaton_alone():
    """Every stop of every diagonal, against comparing the strings place by place."""
    r = random.Random(8)
    for _ in range(40):
        items = [(i, " ".join(r.choice(["ab", "ba", "a", "bb", "abc"]) for _ in range(r.randint(2, 7)))) for i in range(3)]
        doc = "".join(r.choice("ab") for _ in range(30))
        own = L.Items(items)
        want = {}
        for i, (key, raw) in enumerate(items):
            t, starts = L._words(raw)
            for p in range(len(doc)):
                for q in range(len(t)):
                    n = 0
                    while p + n < len(doc) and q + n < len(t) and doc[p + n] == t[q + n]:
                        n += 1
                    w = sum(q <= a and b <= q + n for a, b in zip(starts, starts[1:]))
                    if w >= -(-(len(starts) - 1) // 2):
                        want[key] = max(want.get(key, 0), w)
        assert {k: n for k, n, _ in own.found(doc)} == want


def test_spans_and_removal(spark):
    item = "The quick brown fox jumps over the lazy dog by the cold river bank"
    doc = "Before  this. THE QUICK, brown-fox; jumps over the LAZY dog! After\n\nthat tһе quісk brоwn fох јumps оvеr tһе lаzу dоg."
    own = L.Items([(1, item)])
    assert [doc[a:b] for _, a, b in own.spans(doc)] == ["THE QUICK, brown-fox; jumps over the LAZY dog!", "tһе quісk brоwn fох јumps оvеr tһе lаzу dоg."]
    d = spark.createDataFrame([(1, doc, "x"), (2, "Nothing here.", "y"), (3, None, "z")], "doc_id long, text string, lang string")
    spans = L.leaked_spans(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = {r["doc_id"]: (r["text"], r["lang"], r["removed_chars"]) for r in L.remove_leaks(d, spans).collect()}
    clean = "Before  this. After\n\nthat"
    assert out == {1: (clean, "x", len(doc) - len(clean)), 2: ("Nothing here.", "y", 0), 3: (None, "z", 0)}
    assert not own.found(clean) and L.without("a b", []) == "a b" and L.without("a b", [(0, 3)]) == ""
