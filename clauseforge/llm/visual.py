"""Visually identical text with different characters, brought to one form.

Compatibility normalisation in composed form, mapped white space, look-alike
letters, removal of default-ignorable characters and, where wanted, full case
folding. A batch is normalised once per distinct value.

What a reader can see stays different: compatibility characters that look
different from their plain forms (raised and lowered signs, circled signs,
fractions, squared words, letterlike signs) are left as they are unless
``visible=False``, and letter case is kept unless ``fold_case=True``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hot_keys, salted_join

# Letters of other scripts that look like a Latin letter, lower case then upper case.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ԍ": "g", "ց": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ү": "Y",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "κ": "k", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian, Latin variants and letterlike forms
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ѡ": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
    "Տ": "S", "Օ": "O", "Ս": "U", "ꓐ": "B",
}
# Dashes drawn like the hyphen.
HYPHENS = "‐‑-﹣－֊᠆"
# Characters with the property Default_Ignorable_Code_Point that category Cf does not hold.
IGNORABLE_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
# Decompositions after which a character looks different.
SEEN_TAGS = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>", "<vertical>"}


def _bmp() -> Iterator[str]:
    return (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)


def _invisible(ch: str) -> bool:
    """Format characters (all drawn as nothing), variation selectors and the listed rest; number signs over digits are seen."""
    if ch in IGNORABLE_EXTRA or "︀" <= ch <= "️":
        return True
    return unicodedata.category(ch) == "Cf" and not ("؀" <= ch <= "؅" or ch in "۝܏࣢")


# Ranges above the basic plane that hold characters drawn as nothing (tags, variation selectors, format marks).
BEYOND = ((0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
INVISIBLE = frozenset(c for c in _bmp() if _invisible(c)) | {chr(c) for a, b in BEYOND for c in range(a, b + 1) }
SPACES = frozenset(c for c in _bmp() if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp")) | {"⠀"}
SEEN = frozenset(
    c for c in _bmp() if unicodedata.decomposition(c).split(" ")[0] in SEEN_TAGS or ("℀" <= c <= "⅏" and unicodedata.decomposition(c).startswith("<"))
)
_MAP = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS} | {ord(k): v for k, v in LOOKALIKES.items()}
# Astral characters as ranges: a class tries those that it lists one by one.
_INVISIBLE_RE = re.compile("[" + "".join(re.escape(c) for c in sorted(INVISIBLE) if ord(c) < 0x10000) + "".join(f"{chr(a)}-{chr(b)}" for a, b in BEYOND) + "]")
_SEEN_RE = re.compile("([" + "".join(map(re.escape, sorted(SEEN))) + "]+)")
_RUN = re.compile("  +")


def visual_form(text: str | None, fold_case: bool = False, visible: bool = True) -> str | None:
    """The one form of ``text``; null stays null, empty stays empty, it is idempotent.

    Runs of white space become one space and the ends are trimmed, since a line
    break or a second space inside a sentence is only layout.
    """
    if text is None:
        return None
    if not text.isascii():
        parts = _SEEN_RE.split(text) if visible else [text]
        # Decomposed first, so that accents on look-alike letters are mapped with their letter.
        text = "".join(p if k % 2 else unicodedata.normalize("NFKD", p) for k, p in enumerate(parts)).translate(_MAP)
        text = unicodedata.normalize("NFC", text)
    elif not text.isprintable():
        text = text.translate(_MAP)
    if fold_case:
        text = unicodedata.normalize("NFC", text.casefold())
    return _RUN.sub(" ", text).strip(" ")


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE_RE.sub("", text)


def normalise(col: Column | str, fold_case: bool = False, visible: bool = True) -> Column:
    """Column of ``visual_form``, worked out once per distinct value of each Arrow batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s, use_na_sentinel=True)
            forms = [visual_form(v, fold_case, visible) for v in values] + [None]
            yield pd.Series([forms[c] for c in codes], dtype=object)

    return run(F.col(col) if isinstance(col, str) else col)


def evidence_spans(questions: DataFrame) -> DataFrame:
    """``qid, doc_id, span_index (from 0), span``: one row per span; repeated questions count once, null spans drop."""
    q = questions.select("qid", "doc_id", "evidence_spans").distinct()
    return q.select("qid", "doc_id", F.posexplode("evidence_spans").alias("span_index", "span")).filter(F.col("span").isNotNull())


def hidden_evidence(questions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Spans that are not in their contract as stored, but are there for a reader's eye: ``qid, span_index``.

    Spans join contracts on ``doc_id`` with hot contracts salted; a contract is
    normalised once, before the join, and only if some question names it.
    Null ``doc_id``, unknown contracts, null texts and spans without a visible
    character give no row.
    """
    spans = evidence_spans(questions.filter(F.col("doc_id").isNotNull()))
    texts = contracts.select("doc_id", "full_text").filter(F.col("full_text").isNotNull())
    named = texts.join(questions.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = named.withColumn("form", normalise("full_text"))
    asked = spans.withColumn("span_form", normalise("span")).filter(F.length("span_form") > 0)
    met = salted_join(asked, texts, "doc_id", hot=hot_keys(spans, "doc_id"))
    seen = ~F.contains("full_text", "span") & F.contains("form", "span_form")
    return met.filter(seen).select("qid", F.col("span_index").cast("int").alias("span_index")).distinct()


def forms(contracts: DataFrame, questions: DataFrame) -> DataFrame:
    """The consistent form of every contract text and evidence span: ``kind, id, span_index, form``."""
    c = contracts.select(F.lit("contract").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("span_index"), F.col("full_text").alias("t"))
    e = evidence_spans(questions).select(F.lit("evidence").alias("kind"), F.col("qid").alias("id"), F.col("span_index").cast("int"), F.col("span").alias("t"))
    return c.distinct().unionByName(e).select("kind", "id", "span_index", normalise("t").alias("form"))


