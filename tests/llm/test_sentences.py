import pytest

from clauseforge.llm.sentences import sentence_units, sentences

CASES = [
    ["Fees (see Sec. 4.2. and Exh. 87) rise by approx. 7.53% each year, e.g. from $598,625 to $1.48.", "The goods leave at 9.30 a.m. and arrive at 4.15 p.m. on May 5, 2029.", "Deliveries end at 6 p.m.", "This is law."],
    ["9. The term begins.", "Dr. B. Vale of Acme Inc. and Prof. Low of Bray Ltd. agree."],
    ['The notice shall state: "Payment is overdue. Cure it within 13 days!"', "Neither party may assign."],
    ['The label must read "Do not open. Return to X at once." and must stay.', "Stop!"],
    ["The remaining parts ... shall be stored in Oslo, U.S. customs permitting.", "Who pays?"],
    ["(a) Stop all use: now;\nat once!", "The Contractor pays."],
    ["Ab dem 23. Monat steigt der Preis, z. B. in Ulm, vgl. Ziff. 3, auf 5 Euro zzgl. MwSt. bis zum 5. Mai 2031.", "Es gilt das Recht der Muster GmbH & Co. KG.", "Auf dem Schild steht: „Nicht öffnen. Bitte senden.“", "Der Rest."],
    ["La empresa S.A. paga aprox. 8 euros al Sr. Low, según el art. 8 y el núm. 6.", "¿Quién paga?", "¡Pare ya!"],
    ["L'avis précise : « Le solde est dû ! »", "Le taux passe à 5,1 %, p. ex. pour M. Low, cf. art. 2."],
    ["Согласно ст. 5 п. 3, т. е. по договору от 5 мая 2001 г., арендатор платит 9 руб. компании.", "На ящике написано: «Не открывать. Вернуть!»", "Конец."],
    ["विलंब होने पर 5.1% ब्याज देय होगा।", 'पर्ची पर लिखा हो: "न खोलें। लौटाएँ।"', "डॉ. Low और कु. Vale आएँगे।"],
    ["يوقع د. Low عن شركة Vale بنسبة 15.50% من القيمة.", "يكتب على الصندوق: «لا تفتح. أعده.»", "هل يتحمل؟"],
]
JOINED = [
    ["箱には「開けないでください。返送してください。」と表示する。", "利率は年3.70%とする！", "負うのか？"],
    ["标签上写明：“请勿打开。请退回。”字样，并寄送。", "通知应注明“已逾期！请补足。”", "乙方负责。"],
    ["The term ends.", "The tribunal sits.", "¿Quién paga?", "Rulcaham pays."],
]


def check(parts, text):
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize("parts", CASES)
def test_with_spaces(parts):
    check(parts, " ".join(parts))
    check(parts, "  " + "\n".join(parts) + " \n")


@pytest.mark.parametrize("parts", JOINED)
def test_without_spaces(parts):
    check(parts, "".join(parts))


def test_thai_sentences_are_parted_by_white_space():
    a, b = "ราคาเพิ่มขึ้น2.49%เป็น1086บาท", "ผู้ซื้อต้องคืนหรือไม่?"
    t = f"5.5 {a}  {b}{a}"
    assert [t[x:y] for x, y in sentences(t)] == [f"5.5 {a}", b, a]


def test_invisible_and_wide_characters_do_not_matter():
    t = "Th​e end­.　Ｎｅｘｔ one． Done"
    assert [t[a:b] for a, b in sentences(t)] == ["Th​e end­.", "Ｎｅｘｔ one．", "Done"]


def test_edges(spark):
    assert sentences(None) == sentences("") == sentences(" \n ") == []
    assert sentences("No end") == [(0, 6)] and sentences("...") == [(0, 3)]
    long = "A sentence here. " * 20_000
    assert len(sentences(long)) == 20_000
    df = spark.createDataFrame([("b1", "One. Two.", 1), ("b1", "One. Two.", 1), ("b2", None, 1), ("b3", " ", 1)], "block_id string, text string, s int")
    got = sorted(map(tuple, sentence_units(df, "block_id", "text").collect()))
    assert got == [("b1", 0, 4), ("b1", 5, 9)] and sentence_units(df.limit(0), "block_id", "text").count() == 0


@pytest.mark.parametrize("parts", [["The answer is no.", "The tenant may leave."], ["It was sold to the art.", "The buyer pays."], ["El contrato es para.", "La parte paga."], ["See the env.", "The Supplier shall comply."]])
def test_abbreviations_of_other_languages_dont_count(parts):
    check(parts, " ".join(parts))


def test_long_runs_of_marks_and_space():
    check(["It ends" + "!" * 90, "Then it goes on."], "It ends" + "!" * 90 + " " * 60 + "Then it goes on.")
