import pytest

from clauseforge.llm import visual as V

SAME = [
    ("Ｓｅｌｌｅｒ ３２", "Seller 32"), ("tһе Сlіеnt", "the Client"), ("ﬁnal oﬃce", "final office"), ("café", "café"), ("a b　c d", "a b c d"),
    ("co‑op ‐", "co-op -"), ("in­spect​ ﻿t⁠o", "inspect to"), ("a  b\nc", "a b c"), ("Αfter Μarine abοve Inνoice", "After Marine above Invoice"), ("е́té", "été"),
]
DIFFERENT = [("⁷1 days", "71 days"), ("clausula", "cláusula"), ("SeCret", "Secret"), ("10", "1O"), ("a–b", "a-b"), ("№ 5", "No 5"), ("½", "1/2"), ("①", "1")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_to_the_eye(a, b):
    assert V.visual_form(a) == V.visual_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_visible_changes_stay(a, b):
    assert V.visual_form(a) != V.visual_form(b)


def test_folding_and_idempotence():
    assert V.visual_form("Straße ⁷", fold_case=True, visible=False) == "strasse 7"
    for a, _ in SAME + DIFFERENT:
        assert V.visual_form(V.visual_form(a)) == V.visual_form(a)
    assert V.visual_form(None) is None and V.visual_form("") == "" and V.visual_form("​ ") == ""


def test_hidden_evidence(spark):
    q = spark.createDataFrame(
        [("q1", "d", ["plain text", "Ｐlain text", "⁷1 days", "gone", "", "​"], 0), ("q1", "d", ["plain text", "Ｐlain text", "⁷1 days", "gone", "", "​"], 0), ("q2", None, ["Ｐlain text"], 0), ("q3", "x", ["Ｐlain text"], 0), ("q4", "d", None, 0), ("q5", "e", ["a"], 0)],
        "qid string, doc_id string, evidence_spans array<string>, form int",
    )
    c = spark.createDataFrame([("d", "Some plain text and Plain text of 71 days.", 1), ("e", None, 1)], "doc_id string, full_text string, form int")
    assert [tuple(r) for r in V.hidden_evidence(q, c).collect()] == [("q1", 1)]
    assert V.hidden_evidence(q.limit(0), c).count() == 0 and V.hidden_evidence(q, c.limit(0)).count() == 0
    assert V.forms(c, q).filter("kind = 'evidence' and form is null").count() == 0


def test_characters_drawn_as_nothing_above_the_basic_plane():
    from clauseforge.llm.visual import visual_form

    assert visual_form("a\U000e0041b\U000e0100c\U0001d173d") == "abcd" and visual_form("a\U0001f600") == "a\U0001f600"
