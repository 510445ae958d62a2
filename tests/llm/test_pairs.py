import pytest

from clauseforge.llm import pairs as P

Q = "Please explain the audit right in the agreement with Acme Logistics."
GOOD = "The Agent may inspect the books of Acme once a year on 9 days' notice [3]."
CASES = [
    (Q, None, ["empty"]), (Q, " ​\n", ["empty"]), (Q, "[1][2].", ["empty"]), (Q, "**Answer** [3]", ["empty"]), (Q, "Answer:", ["empty"]), (Q, "```\n```", ["empty"]),
    (Q, GOOD, []), (Q, "63 days [6]", []), (Q, GOOD + " (bona fide) [1]", []), (Q, "- Yes, it may do so once a year [1].\n- Acme must keep books [2].", []),
    (Q, "The Agent may inspect the books of", ["truncated"]), (Q, "The Agent may inspect ...", ["truncated"]), (Q, GOOD + " The Agent shall [", ["truncated"]), (Q, GOOD[:-4] + "[3", ["truncated"]),
    (Q, Q, ["copied_question"]), (Q, f'"{Q.upper()}" [1]', ["copied_question"]), (Q, "Question: " + Q[:-1], ["copied_question"]), (Q, f"{Q} {Q}", ["copied_question"]), (Q, "You asked: " + Q, ["copied_question"]),
    (Q, Q[:-1] + ": " + GOOD, []),
    (Q, "I cannot determine the audit right.", ["refusal"]), (Q, "Nothing in the excerpts speaks to the audit right - sorry.", ["refusal"]), (Q, "The text is silent on the audit right [3]", ["refusal"]),
    (Q, "I could not find a fixed date; however, Section 26 gives Acme 98 days after each delivery [6].", []),
    (Q, "The Agent may decline to answer requests that arrive more than 84 days late, and Acme accepts this [3].", []),
    (Q, "The passages are silent on data loss, but the general limit of $41,654 applies to it as well [5].", []),
    (Q, "El proveedor puede revisar los libros de Acme una vez al año con 9 días de aviso [4].", ["other_language"]),
    (Q, "Ich kann diese Frage nicht beantworten.", ["refusal", "other_language"]),
    (Q, "Покупатель хранит документы в течение 9 лет в городе Acme. [4]", ["other_language"]),
    (Q, "Es gilt das Recht von (", ["truncated", "other_language"]),
    ("Wie ist das Recht geregelt?", "Rechnungen sind innerhalb von 9 Tagen zu zahlen, sonst fallen 4,30 % Zinsen an [7].", []),
    (None, GOOD, []), ("", "Yes", ["truncated"]),
]


@pytest.mark.parametrize(("question", "answer", "want"), CASES)
def test_defects(question, answer, want):
    assert P.defects(question, answer) == want == P.defects(question, answer, {})


def test_automaton_tracks_longest_matches():
    a = P.SuffixAutomaton("abcbcd")
    assert a.matches("xbcbz") == [0, 1, 2, 3, 0] and a.matches("") == [] and P.SuffixAutomaton("").matches("a") == [0]


def test_table(spark):
    rows = [("r1", Q, None, "x"), ("r1", Q, None, "x"), ("r2", Q, GOOD, "x"), ("r3", Q, "Ich kann diese Frage nicht beantworten.", "x")]
    df = spark.createDataFrame(rows, "request_id string, question string, answer string, defect string")
    assert sorted(map(tuple, P.defective_pairs(df).collect())) == [("r1", "empty"), ("r3", "other_language"), ("r3", "refusal")]
    assert P.defective_pairs(df.limit(0)).count() == 0


def test_copies_of_any_number_and_of_short_questions():
    for n in (1, 4, 9, 40):
        assert P.defects(Q, " ".join([Q] * n)) == ["copied_question"] == P.defects(Q, " ".join([Q] * n), {})
        assert P.defects(Q, " ".join([Q] * n + [GOOD])) == [] == P.defects(Q, " ".join([Q] * n + [GOOD]), {})
    assert P.defects("Fee?", "Fee?") == P.defects("Fee?", '"FEE" - fee, fee. [1]') == P.defects("Fee?", "Fee? " * 30, {}) == ["copied_question"]
    assert P.defects("Fee?", "The fee is 9 euros [1].") == [] == P.defects("Fee?", "Coffee [1].") == P.defects("Fee?", "Fee: 9.")


FOREIGN = [
    ("Какой закон применяется к договору?", "Я не могу ответить на этот вопрос.", "Применяется право города Ольм. [1]"),
    ("适用哪国法律？", "抱歉，我无法回答这个问题。", "本合同适用瓦兰法律。[1]"),
    ("準拠法は何ですか。", "この質問にはお答えできません。", "契約はオルム法に従います。[1]"),
    ("कौन सा कानून लागू होता है?", "इस प्रश्न का उत्तर नहीं दिया जा सकता।", "अनुबंध पर ओल्म का कानून लागू होता है। [1]"),
    ("ما القانون الواجب التطبيق؟", "لا يمكنني الإجابة على هذا السؤال.", "يخضع العقد لقانون أولم. [1]"),
    ("ใช้กฎหมายใด", "ไม่สามารถตอบคำถามนี้ได้", "สัญญานี้อยู่ภายใต้กฎหมายโอล์ม"),
]


@pytest.mark.parametrize(("question", "refusal", "answer"), FOREIGN)
def test_refusals_of_other_scripts(question, refusal, answer):
    assert "refusal" in P.defects(question, refusal) and "refusal" not in P.defects(question, answer)


def test_refusal_automaton_agrees_with_trying_every_place():
    import itertools

    from clauseforge.llm.refusals import PhraseAutomaton

    auto = PhraseAutomaton(["ab|b ~3 c*", "a ~1w d", "e $"])
    for s in map("".join, itertools.product("ab c", repeat=5)):
        heads = [(i, i + n) for n in (1, 2) for i in range(len(s)) if s[i : i + n] in ("ab", "b") and not (i and s[i - 1].isalnum()) and not s[i + n : i + n + 1].isalnum()]
        tails = [i for i in range(len(s)) if s[i] == "c" and not (i and s[i - 1].isalnum())]
        assert bool(auto.find(s)) == any(0 <= t - b <= 3 for _, b in heads for t in tails), s
    assert auto.find("a big d") == (0, 7) and auto.find("a, d") is None and auto.find("a b b d") is None
    assert auto.find("e.") == (0, 1) and auto.find("e and more of it") is None and auto.find("he.") is None


def test_a_pair_is_judged_once_however_often_it_stands(spark):
    df = spark.createDataFrame([(f"r{i}", Q, "I cannot determine the audit right.") for i in range(300)], "request_id string, question string, answer string")
    assert P.defective_pairs(df).count() == 300
