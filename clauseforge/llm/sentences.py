"""Sentence boundaries across languages and scripts, by cascading rule tables.

Candidates (a run of terminators with its closing marks, or a gap in a script
that parts sentences by white space) are decided by ordered pairs of regular
expressions, one for the text before and one for the text after. Tables are
asked in the order of ``CASCADE``; the first rule whose two sides match decides,
and the last table always decides. The abbreviations and rules of a language are
asked only in texts of that language, by script or stop-word votes. Quotations and brackets that stay open over
a candidate are handled before the tables: nothing inside them ends a sentence.

Rules run on a folded copy of the text (invisible characters dropped,
full-width and look-alike characters mapped one to one), and offsets are mapped
back, so disturbed characters neither make nor hide a boundary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import SCRIPTS, WORD, language, votes
from .visual import HYPHENS, INVISIBLE, LOOKALIKES, SPACES

#: Characters before a candidate's run of marks and after the white space behind it that rules may look at; no rule needs more.
BEFORE, AFTER = 32, 24


def _fold_one(ch: str) -> str:
    if ch in SPACES:
        return "\n" if ch == "\n" else " "
    if ch in HYPHENS:
        return "-"
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if "！" <= ch <= "～":
        return unicodedata.normalize("NFKC", ch)
    return ch


_FOLD = {c: _fold_one(chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and _fold_one(chr(c)) != chr(c)}
_DROP = INVISIBLE


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded copy and, for each of its characters, the place in ``text`` (None: the same places)."""
    if text.isascii():
        return text, None
    folded = text.translate(_FOLD)
    if not any(c in _DROP for c in folded):
        return folded, None
    kept = [k for k, c in enumerate(folded) if c not in _DROP]
    return "".join(folded[k] for k in kept), kept


@dataclass(frozen=True)
class Rule:
    """``before`` must match up to the end of the text before the gap, ``after`` from the start of the text after it."""

    ends: bool
    before: str
    after: str = ""


def _any(words: str) -> str:
    return "|".join(regex.escape(fold(w)[0]) for w in words.split())


# Abbreviations that never end a sentence (a name, number or noun follows), by language.
GOVERNING = {
    "en": "Mr Mrs Ms Dr Prof Rev Hon Gen Col Capt Lt Sgt St Messrs Sec Secs Exh Exhs Sched Art Arts No Nos Fig Figs Vol Ch Cl Cls "
    "para paras pp approx viz vs e.g i.e cf al ca esp incl excl resp",
    "de": "Dr Prof Hr Fr Frau Herr Nr Nrn Abs Art Ziff Anl Bd Kap Tz Rn Rdn vgl bzw zzgl inkl exkl ca evtl ggf bspw insb einschl "
    "gem lt bzgl sog u.a z.B d.h i.d.R Str Hrn Mio Mrd Tel Dipl Ing",
    "fr": "M MM Mme Mmes Mlle Mlles Me Dr Pr St Ste art al n no env cf p ex chap par ann fig vol p.ex c.-à-d réf tél",
    "es": "Sr Sra Srta Sres Sras D Dña Dr Dra Dres Lic Ing Prof art arts núm núms n nº pág págs aprox p.ej ej cap ap apdo cl fig vol Ud Uds tel",
    "ru": "ст п пп ч см им ул д кв стр рис табл т тов проф акад напр ок обл гл разд прил т.е т.к т.н г-н г-жа",
    "hi": "डॉ कु श्री श्रीमती सु प्रो रु नं पं",
    "ar": "د أ م ص ج",
}
# Month names that follow a day number with a full stop.
MONTHS_DE = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
# What goes on after a quotation that ends with a full stop, in Chinese and Japanese.
GOES_ON_ZH = "字样 的 为 等 并 或 和 与 及 ， 、 ； ： , ; :"
GOES_ON_JA = "と の を は が に で へ も や 等 、 ， , ね よ か"

_L, _CJK, _OPEN = r"\p{L}\p{M}", r"\p{Han}\p{Hiragana}\p{Katakana}ー", "\"“„«»‘'「『(¿¡["
_CASELESS = r"\p{Lo}"
_TABLES: dict[str, list[Rule]] = {
    "marks": [],
    "cjk": [
        Rule(False, r"[。!?][」』”\"]+", rf"(?:{_any(GOES_ON_JA)})") ,
        Rule(False, r"[。!?][”\"」』]+", rf"(?:{_any(GOES_ON_ZH)})"),
        Rule(True, r"[。｡][」』”\"’)）]*"),
        Rule(True, rf"[{_CJK}][!?]+[」』”\"’)]*", r"[^,;:)、，]"),
        Rule(True, r"[!?]+[」』”\"’)]*", rf"[{_CJK}]"),
    ],
    "hi": [
        Rule(True, r"[।॥][\"”’)]*"),
        Rule(False, rf"\p{{Devanagari}}\.", ""),
    ],
    "ar": [
        Rule(True, r"؟[\"”»’)]*"),
        Rule(False, r"(?:^|[\s(«\"])\p{Arabic}\.", ""),
        Rule(True, rf"[\p{{Arabic}}][.!]+[\"”»’)]*", rf"\s*[{_L}\p{{N}}{_OPEN}]"),
    ],
    "th": [
        Rule(False, r"\p{Thai}\.", ""),
        Rule(True, r"\p{Thai}[!?]+[\"”’)]*", ""),
    ],
    "de": [
        Rule(False, r"(?:^|\W)\d{1,2}\.", rf"\s+(?:{_any(MONTHS_DE)})\b"),
        Rule(False, r"(?:^|\W)(?:[Dd]e[mnrs]|[Dd]ie|[Dd]as|[AaIi]m|[Vv]om|[Zz]u[mr]|[Bb]eim|[Jj]ede[nrms]?)\s\p{N}{1,3}\.", r"\s*\p{Lu}"),
        Rule(False, r"(?:^|\W)(?:z|d|u|i|s|o|v)\.", r"\s*\p{L}{1,2}\."),
        Rule(False, r"(?:^|\W)Co\.", r"\s*(?:KG|KGaA|OHG)\b"),
    ],
    "ru": [
        Rule(False, rf"(?:^|\W)(?:{_any('в из г')})\s*{fold('г')[0]}\.", r"\s*\p{Lu}"),
    ],
    "numbers": [
        # A word of up to four letters with a full stop before a figure is taken for an abbreviation.
        Rule(False, rf"(?:^|[^{_L}\p{{N}}])\p{{L}}{{1,4}}\.", r"\s*[\p{N}§$€]") ,
        Rule(False, r"\p{N}\.", r"\p{N}"),
    ],
    "initials": [
        # One capital alone before a name; not the last letter of S.A. or U.S.
        Rule(False, r"(?:^|[\s(\"“„«'])\p{Lu}\.", r"\s*\p{Lu}"),
        Rule(False, r"(?:^|[\s(\"“„«'])\p{Lu}\.(?:\s?\p{Lu}\.)*", r"\s?\p{Lu}\."),
    ],
    "general": [
        Rule(False, "", r"\s*[,;:)\]}%–—/-](?!\s)"),
        Rule(False, "", r"\s*[,;:)\]}%]"),
        Rule(False, "", r"\s*[(\"“„«'‘]?\p{Ll}"),
        Rule(True, "", r"\s"),
        # The space is missing.
        Rule(True, rf"(?:[\p{{Ll}}\p{{M}}]{{2}}|[\p{{N}}%)\]\"”»’“])[.!?…]+[\"”»’“)]*", rf"[{_OPEN}]*(?:\p{{Lu}}[\p{{Ll}}\p{{M}}']|\p{{Lu}}\s|{_CASELESS}|[¿¡])"),
        Rule(True, r"[!?…]+[\"”»’“)]*", rf"[{_OPEN}]*(?:\p{{Lu}}|{_CASELESS}|[¿¡])"),
        Rule(False, "", ""),
    ],
}
for _lang, _words in GOVERNING.items():
    _list = sorted({fold(w)[0] for w in _words.split()}, key=len, reverse=True)
    _alt = "|".join(regex.escape(w).replace(r"\.", r"\.\s?") for w in _list)
    _TABLES.setdefault(_lang, []).append(Rule(False, rf"(?:^|[^{_L}\p{{N}}])(?:{_alt})\.", r"\s*[\p{L}\p{N}(\"“„«§$€№]"))

#: Tables in the order they are asked: scripts first, then languages, then what holds for all. A language's table is asked
#: only in texts that are, or partly are, in that language (``_spoken``).
CASCADE = ("cjk", "hi", "ar", "th", "de", "ru", "en", "fr", "es", "numbers", "initials", "general")


#: Tables whose rules need a letter of their own script before the gap.
SCRIPT_TABLES = frozenset({"cjk", "hi", "ar", "th"})
#: Tables of one language each.
LANGUAGE_TABLES = frozenset({"de", "ru", "en", "fr", "es"})


def _compiled(tables: Iterable[str]) -> list[tuple[bool, regex.Pattern | None, regex.Pattern | None, str | None]]:
    return [
        (r.ends, regex.compile(f"(?:{r.before})$") if r.before else None, regex.compile(r.after) if r.after else None, t if t in LANGUAGE_TABLES else None)
        for t in tables
        for r in _TABLES[t]
    ]


_RULES = _compiled(CASCADE)
#: After Latin, Cyrillic or Greek text or a figure the script tables can't match, so they aren't asked.
_RULES_ALPHABETIC = _compiled(t for t in CASCADE if t not in SCRIPT_TABLES)
_GOES_ON = regex.compile(r"\s*[(\"“„«'‘]?\p{Ll}")
_CANDIDATE = regex.compile(r"(?P<stop>[.!?…]+|[。｡।॥؟]+[!?]*)(?P<close>(?:[  ]?»|[\"”“’'」』)\]])*)|(?P<gap>(?<=\p{Thai}[^\s]*)\s+)")
_WIDE_STOP = regex.compile(r"[。｡।॥؟][\"”“’'」』)）\]»]*$|[!?]+[\"”“’'」』)）\]»]*$")
_MARK = regex.compile(r"\s*(?:[-–—•*·▪◦‣●○]\s*)?\(?(?:\p{N}{1,3}(?:\.\p{N}{1,3})*|[A-Za-z]|[ivxlIVXL]{1,6})\s*")
_PAIRS = {"„": "“”", "“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）"}
_QUOTES = regex.compile(r"[\"„“”«»「」『』()\[\]（）]")


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets that are closed, as (place of the opening mark, place of the closing mark)."""
    out, stack = [], []
    for m in _QUOTES.finditer(text):
        c, k = m[0], m.start()
        if c == '"':
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), None)
            if open_at is None:
                stack.append((c, k))
            else:
                out.append((stack[open_at][1], k))
                del stack[open_at:]
            continue
        match = next((i for i in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[i][0], "")), None)
        if match is not None:
            out.append((stack[match][1], k))
            del stack[match:]
        elif c in _PAIRS:
            stack.append((c, k))
    return out


def _spoken(text: str, folded: str) -> frozenset[str]:
    """Languages whose tables a text asks: that of its script, or those with at least half of the most stop-word votes; all, where nothing tells."""
    lang = language(text, folded=folded)
    if lang in SCRIPTS:
        return frozenset({lang})
    v = votes(WORD.findall(folded.lower()))
    most = max(v.values())
    return frozenset(k for k, n in v.items() if n >= most / 2) if most else LANGUAGE_TABLES


def _ends_here(text: str, at: int, gap: int, spoken: Callable[[], frozenset[str]]) -> bool:
    """Whether the candidate ``text[at:gap]`` ends a sentence: the first rule that matches decides."""
    space = gap
    while text[space : space + 1].isspace():
        space += 1
    before, after = text[max(0, at - BEFORE) : gap], text[gap : space + AFTER]
    alphabetic = ("".join(c for c in text[max(0, at - 6) : gap] if c.isalnum()) or "a")[-1] < "԰"
    if alphabetic and _GOES_ON.match(after):
        return False
    for ends, b, a, lang in _RULES_ALPHABETIC if alphabetic and not _WIDE_STOP.search(before) else _RULES:
        if (a is None or a.match(after)) and (b is None or b.search(before)) and (lang is None or lang in spoken()):
            return ends
    return False


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) offsets without surrounding white space; none for null and blank texts.

    A clause number or list mark stays with the sentence after it. Colons,
    semicolons and line breaks don't end a sentence. Time is linear in the text.
    """
    if not text or text.isspace():
        return []
    t, places = fold(text)
    enclosed = sorted(_enclosed(t)) if _QUOTES.search(t) else []
    out, start, e, active = [], 0, 0, []
    known: list[frozenset[str]] = []

    def spoken() -> frozenset[str]:
        if not known:
            known.append(_spoken(text, t))
        return known[0]

    def add(a: int, b: int) -> None:
        while a < b and t[a].isspace():
            a += 1
        while b > a and t[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((places[a], places[b - 1] + 1) if places else (a, b))

    for m in _CANDIDATE.finditer(t):
        at, gap = m.start(), m.end()
        while e < len(enclosed) and enclosed[e][0] < at:
            active.append(enclosed[e][1])
            e += 1
        if active:
            active = [c for c in active if c >= at]
            if any(c >= gap for c in active):
                continue
        if m["gap"] is not None:
            if gap < len(t):
                add(start, at)
                start = gap
            continue
        if gap >= len(t):
            continue
        if t[at - 1 : at].isdigit() and t[gap].isdigit():
            continue
        if m["stop"] == "." and _MARK.fullmatch(t, start, at):
            continue
        if _ends_here(t, at, gap, spoken):
            add(start, gap)
            start = gap
    add(start, len(t))
    return out


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sent_start, sent_end`` for every sentence of ``text``; other columns aren't read.

    Each distinct text of an Arrow batch is cut once. Rows with a null or blank
    text give no row, repeated rows count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, values = pd.factorize(b["t"])
            cut = [sentences(v) for v in values]
            keys, starts, ends = [], [], []
            for k, c in zip(b["k"], codes):
                if c >= 0:
                    for s, e in cut[c]:
                        keys.append(k)
                        starts.append(s)
                        ends.append(e)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=object), "s": pd.Series(starts, dtype="int32"), "e": pd.Series(ends, dtype="int32")})

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    out = src.mapInPandas(run, f"k {kind}, s int, e int").distinct()
    return out.select(F.col("k").alias(key), F.col("s").alias("sent_start"), F.col("e").alias("sent_end"))
