import random

import pytest
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.functions import udfs


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


def test_tokens_keep_repeats_and_drop_stopwords(spark):
    assert one(spark, "The fee, the Fee and a größer_1 x", T.tokens) == ["fee", "fee", "größer_1"]
    assert one(spark, None, T.tokens) == []


def test_normalize(spark):
    assert one(spark, "  “Net-Sales”: 5.0% ", T.normalize) == "net sales 5 0"
    assert one(spark, None, T.normalize) is None


@pytest.mark.parametrize(
    ("statement", "excerpt", "missing"),
    [
        ("Notice of 90 days.", "ninety (90) days", []),
        ("Notice of 30 days.", "thirty days", []),
        ("A fee of $1,000.00", "a fee of $1000", []),
        ("Within 60 days under 4.2", "within sixty days", ["4.2"]),
        ("One party", "", []),
    ],
)
def test_unsupported_numbers(spark, statement, excerpt, missing):
    df = spark.createDataFrame([(statement, excerpt)], "s string, e string")
    assert df.select(T.unsupported_numbers("s", "e").alias("m")).first()["m"] == missing


def test_citations_in_order_without_repeats(spark):
    assert one(spark, "a [2]. b [1, 3][2] c [x]", T.citations) == [2, 1, 3]
    assert one(spark, None, T.citations) == []


def test_declines(spark):
    rows = [("The agreement does not specify a period. It ends.", False), ("It ends. It does not state why.", False), ("Yes.", True), (" ", None)]
    got = spark.createDataFrame(rows, "a string, f boolean").select(T.declines("a", "f").alias("d")).collect()
    assert [r["d"] for r in got] == [True, False, True, True]


def test_section_label_and_markdown(spark):
    assert one(spark, ["a", "b", "c"], T.section_label, "array<string>") == "b > c"
    assert one(spark, [], T.section_label, "array<string>") == "no section"
    assert one(spark, [["a", "b|c"], ["d"]], T.table_markdown, "array<array<string>>") == "| a | b\\|c |\n| --- | --- |\n| d |  |"
    assert one(spark, [], T.table_markdown, "array<array<string>>") == ""


def test_hyphens_margins_titles(spark):
    assert one(spark, "termi-\nnation of\nthe", T.join_hyphenated) == "termination of the"
    assert one(spark, " Page 12  of 30 ", T.repetition_key) == "page # of #"
    assert one(spark, "BETA CORP_20190815-EX-4.1-LICENSE_AGREEMENT", T.display_title) == "License Agreement · Beta Corp · 2019" and one(spark, "plain name", T.display_title) == "plain name"


def test_inline_form(spark):
    assert one(spark, "ﬁ\xadne  x", udf_inline) == "fine x"
    assert one(spark, None, udf_inline) is None


def udf_inline(c):
    return T.normalize_inline(F.col(c))


def test_stems():
    words = "termination terminate caresses flies dying running agreed hopping generously communism skies national".split()
    assert [udfs.stem(w) for w in words] == ["termin", "termin", "caress", "fli", "die", "run", "agre", "hop", "generous", "communism", "sky", "nation"]


def test_statements():
    assert udfs.statements("A within 30 days [3], B within a time [4].") == [("A within 30 days", [3]), ("B within a time", [4])]
    assert udfs.statements("First. And second one. [1][2]") == [("First", []), ("second one", [1, 2])] or udfs.statements("First. [1]") == [("First", [1])]
    assert udfs.statements(None) == [] and udfs.statements("[1]") == []


def test_locate_exact_and_fuzzy():
    doc = "Intro. This “Agreement” is governed by the laws of New York, without regard to conflicts. End."
    s, e, score, method, n = udfs.locate("this agreement is governed by the laws of New York", doc)
    assert (method, score, n) == ("exact", 100.0, 1) and doc[s:e].startswith("This “Agreement”")
    fuzzy = udfs.locate("This agreement is governd by the law of New York, without regards to conflict", doc)
    assert fuzzy[3] == "fuzzy" and 85 <= fuzzy[2] < 100
    assert udfs.locate("nothing like it at all here", doc) is None
    assert udfs.locate("", doc) is None and udfs.locate("x", None) is None


def brute_ratio(needle, text, least):
    def lcs(b):
        row = [0] * (len(needle) + 1)
        for c in b:
            above, row = row, [0]
            for i, x in enumerate(needle):
                row.append(above[i] + 1 if c == x else max(above[i + 1], row[i]))
        return row[-1]

    n = len(needle)
    r, s = max((200.0 * lcs(text[s : s + n]) / (2 * n), -s) for s in range(len(text) - n + 1))
    return (r, -s, n - s) if r >= least else None


@pytest.mark.parametrize("seed", range(4))
def test_fuzzy_search_equals_brute_force(seed):
    r = random.Random(seed)
    text = "".join(r.choice("abcd e") for _ in range(200))
    for n in (1, 7, 30):
        at = r.randint(0, 200 - n)
        needle = "".join(r.choice("abcd e") if r.random() < 0.15 else c for c in text[at : at + n])
        for least in (60.0, 85.0):
            assert udfs.partial_ratio(needle, text, least) == brute_ratio(needle, text, least)


def test_fuzzy_search_needs_no_whole_word():
    words = [f"clause{chr(97 + i)}number" for i in range(16)]
    altered = " ".join(w[:3] + "x" + w[4:] for w in words)  # none of its words stands in the text
    text = "some other words " * 9 + " ".join(words) + " and further words" * 9
    score, s, e = udfs.partial_ratio(altered, text)
    assert s == text.index("clauseanumber") and score > 90
    # More than 64 places of frequent words before the passage.
    text = "of the and in by to " * 40 + "of the xand inn byy to off thee andd inx" + " of the and in by to" * 40
    assert udfs.partial_ratio("of the xxand inn byy to off thee andd in", text)[0] > 95


def test_sentences_of_the_chunker():
    t = "Fees of Acme Inc. are due. They rise (see No. 4). Done"
    assert [t[a:b] for a, b in udfs.sentence_spans(t)] == ["Fees of Acme Inc. are due.", "They rise (see No. 4).", "Done"]


def test_encoder_is_deterministic_and_unit_length():
    v = udfs.crc_encode("governing law governing")
    assert v == udfs.crc_encode("Law governing, GOVERNING") and abs(sum(x * x for x in v) - 1) < 1e-6
    assert not any(udfs.crc_encode("1 2 3"))


def col(spark, row, expr):
    return spark.createDataFrame([row], ", ".join(f"c{i} string" for i in range(len(row)))).select(expr.alias("x")).first()["x"]


def test_names_of_agreements(spark):
    assert col(spark, ("SUPPLY AND SERVICE AGREEMENT",), T.title_case("c0")) == "Supply and Service Agreement" and col(spark, ("Kept As it is",), T.title_case("c0")) == "Kept As it is"
    assert col(spark, ('Acme, Inc. ("Acme"); Beta LLC (the "B"); acme, inc.; ',), T.parse_parties("c0")) == ["Acme, Inc.", "Beta LLC"] and col(spark, (None,), T.parse_parties("c0")) == []
    name = T.agreement_name("c0", T.parse_parties("c1"), "c2")
    assert col(spark, ('"THE SUPPLY AGREEMENT (t"', "Acme Inc. including its heirs; Beta LLC, a company", "x"), name) == "the Supply Agreement between Acme Inc. and Beta LLC"
    assert col(spark, ("", "Acme", "Lease"), name) == "the Lease with Acme" and col(spark, (None, None, "Lease"), name) == "the Lease"
    assert col(spark, ("Ab_c d.PDF",), T.slug("c0")) == "ab-c-d" and col(spark, ("Supply_Agreements 2",), T.canonical_type("c0", {"supply agreements": "Supply"})) == "Supply"


def test_best_sentence_and_short_ids(spark):
    text = "The term ends on the last day of the year. The fee is 1,500 euros for the supply. The fee is due at once every year."
    assert col(spark, (text, "A fee of 1,500 is due"), T.best_sentence("c0", "c1")) == "The fee is 1,500 euros for the supply."
    assert col(spark, ("Short.", "fee"), T.best_sentence("c0", "c1")) == "" and col(spark, ("d::fixed::00001",), T.short_id("c0")) == "fixed::00001"
    assert col(spark, ("two words\n\n of re-\nlease and A-\nb",), T.join_hyphenated("c0")) == "two words of release and A- b"
    assert col(spark, ("a  b", "a\nb "), T.whitespace_equivalent("c0", "c1"))


def test_content_words_can_be_stemmed(spark):
    assert col(spark, ("Terminating the terminations",), T.content_words("c0", udfs.stems)) == ["termin"]


def test_normal_text_leads_back():
    t = "  İstanbul's “LAW”, 2.5"
    n = udfs.NormalText(t)
    assert n.text == "i stanbul s law 2 5" and t[n.at(n.text.index("law")) :].startswith("LAW") and t[n.at(len(n.text) - 1)] == "5"
    assert udfs.NormalText("").text == "" == udfs.NormalText(" .;").text
