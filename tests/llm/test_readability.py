from clauseforge.llm import readability as R

PLAIN = ["You pay 60 dollars.", "Keep the lamp dry and clean.", "We will tell you before we change the price.", "Ask us if you do not know what to do.", "Please send the box back to us."]
DENSE = [
    "Notwithstanding any antecedent representation, the aggregate indemnification liability shall in no circumstance exceed the consideration.",
    "Irrespective of any supervening impossibility, the obligations incumbent upon the Guarantor shall survive the determination of the instrument.",
    "Without prejudice to the equitable remedies reserved herein, the arbitral tribunal shall possess exclusive jurisdiction thereof.",
]


def doc(parts, n, k):
    return " ".join(parts[(i * k + k) % len(parts)] for i in range(n))


def docs():
    return [(i, doc(PLAIN, 12, i % 4 + 1), 1) for i in range(12)] + [(100 + i, doc(DENSE, 6, i % 2 + 1), 3) for i in range(12)]


def test_levels_are_learned(spark):
    d = docs()
    more = [(200, doc(PLAIN, 11, 3) + " " + DENSE[0], "x"), (201, doc(DENSE, 5, 1) + " " + PLAIN[0], "x"), (202, "Too short.", "x"), (203, None, "x"), (204, "", "x"), (205, "本合同第58条规定的保密义务在合同终止后41年内继续有效。" * 9, "x")]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in d] + more + more[:1], "doc_id long, text string, band string")
    labels = spark.createDataFrame([(i, b) for i, _, b in d] + [(999, 2), (0, None)], "doc_id long, band int")
    model = R.fit_levels(table, labels)
    got = {r["doc_id"]: r for r in R.reading_levels(table, model).collect()}
    assert all(got[i]["band"] == b for i, _, b in d)
    assert got[200]["band"] == 1 and got[201]["band"] == 3 and not {202, 203, 204, 205} & set(got)
    assert got[200]["difficulty"] < got[201]["difficulty"] and abs(sum(got[200]["shares"]) - 1) < 1e-4
    assert R.reading_levels(table.limit(0), model).count() == 0


def test_no_labels_no_levels(spark):
    table = spark.createDataFrame([(1, doc(PLAIN, 12, 1))], "doc_id long, text string")
    model = R.fit_levels(table, spark.createDataFrame([], "doc_id long, band int"))
    assert model.levels == [] and R.reading_levels(table, model).count() == 0


def test_language_and_words():
    s = R.Scorer(R.LevelModel([1, 2]))
    assert s.score("Der Mieter zahlt die Miete und der Vermieter ist nicht zu den Kosten verpflichtet, wenn er das will.", 5)[:2] == ("de", 18)
    assert s.score("word", 5) is None and R.word_count("a - b | 5 %") == 3
