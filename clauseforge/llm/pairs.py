"""Defects of prompt and response pairs.

* ``empty``: nothing is left without white space, invisible characters,
  punctuation, citation markers and bare labels.
* ``copied_question``: the response is traversed over the suffix automaton of
  its prompt; what the matches don't cover is no more than a label.
* ``refusal``: the refusal automaton of the response's language (of every
  language, where that can't be told) matches, and no clause gives an answer
  all the same.
* ``truncated``: a delimiter stack is left open, or the end is neither a
  complete sentence nor a complete citation.
* ``other_language``: stop-word votes of prompt and response differ.

Only the texts decide; the flags that come with a response aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import frame
from .languages import WORD, language, votes
from .refusals import REFUSALS, UNSPACED, first, refusal_automaton, turn_automaton
from .sentences import GOVERNING
from .visual import SPACES, strip_invisible, visual_form

# Labels that are no answer by themselves, folded.
LABELS = frozenset(
    "answer answers response reply result results summary note a r re q question questions you asked your question my the final "
    "antwort antworten ergebnis frage ihre sie fragten die zusammenfassung hinweis "
    "réponse résultat question votre vous demandez avez demandé résumé la le q r "
    "respuesta resultado pregunta su usted preguntó preguntaba resumen nota ha preguntado".split()
)
CITATION = re.compile(r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]")
_SOME = re.compile(r"[^\W_]")
_ALNUM = re.compile(r"[\W_]+")
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“", "「": "」"}, {")", "]", "}", "»", "」"}
_DELIMITERS = re.compile("[" + "".join(map(re.escape, sorted({*_OPENERS, *_CLOSERS, "“", "”"}))) + "]")
_LAST_CITATION = re.compile(r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]$")
#: White space and marks of emphasis, with which an answer may end.
_MARKUP = "".join(sorted(SPACES)) + "*_`"
_TRAIL = _MARKUP + "."
_DONE = re.compile(r"[.!?。！？।؟](?:\s?[\"”“’'»」)\]*_`])*$")
_DOTS = re.compile(r"(?:\.\s?\.\s?\.?|…)(?:[\"”’»)\]*_`]|\s)*$")
#: At the end of the last word.
_ABBREVIATION = re.compile(r"(?:^|\()(" + "|".join(re.escape(w) for k in ("en", "de", "fr", "es") for w in sorted(GOVERNING[k].split(), key=len, reverse=True)) + r")\.$")
# Words with which no sentence ends before a citation.
_DANGLING = frozenset("the a of and or our their its der das den dem des und oder le les du des et ou el los y o del".split())


class SuffixAutomaton:
    """Suffix automaton of one string; ``matches`` streams another string over it."""

    def __init__(self, s: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, last = [-1], [0], 0
        for c in s:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matches(self, s: str) -> list[int]:
        """At each place, the length of the longest match that ends there."""
        v, n, out = 0, 0, []
        for c in s:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                v, n = 0, 0
            out.append(n)
        return out


def _letters(text: str) -> str:
    return _ALNUM.sub("", text)


def _uncovered(auto: SuffixAutomaton, s: str, least: int) -> tuple[int, list[tuple[int, int]]]:
    """Characters covered by matches of at least ``least`` characters, and the ranges that are left."""
    reach, spans = auto.matches(s), []
    k = len(s) - 1
    while k >= 0:
        n = reach[k]
        if n >= least:
            spans.append((k - n + 1, k + 1))
            k -= n
        else:
            k -= 1
    spans.reverse()
    left, at = [], 0
    for a, b in spans:
        if a > at:
            left.append((at, a))
        at = b
    if at < len(s):
        left.append((at, len(s)))
    return sum(b - a for a, b in spans), left


class Prompt:
    """A question with what its answers are compared with; the automaton is built when an answer needs it."""

    def __init__(self, question: str) -> None:
        self.folded = visual_form(question, True, False).replace("’", "'")
        self.letters = _letters(self.folded)
        self.language = language(question, folded=self.folded)
        self.least = min(8, len(self.letters))
        self.grams = {self.letters[i : i + self.least] for i in range(len(self.letters) - self.least + 1)} if self.letters else set()
        self._auto: SuffixAutomaton | None = None

    @property
    def automaton(self) -> SuffixAutomaton:
        if self._auto is None:
            self._auto = SuffixAutomaton(self.letters)
        return self._auto

    def reach(self, s: str) -> int:
        """At least as many characters as matches of ``least`` and more can cover in ``s``."""
        k, grams = self.least, self.grams
        at = [i for i in range(len(s) - k + 1) if s[i : i + k] in grams]
        return sum(min(k, b - a) for a, b in zip([-k, *at], at))


def copies_question(prompt: Prompt, answer: str) -> bool:
    """Whether the folded ``answer`` (without citations) only gives the question back.

    Matches of 8 characters and more (of the whole question where it is shorter)
    must cover all of the answer but labels, and at least 60 % of the question's
    length. The automaton is traversed only where the common 8-grams could cover that much.
    """
    q, a = prompt.letters, _letters(answer)
    if not q or len(a) < 0.6 * len(q) or prompt.reach(a) < 0.6 * len(q):
        return False
    covered, left = _uncovered(prompt.automaton, a, prompt.least)
    if covered < 0.6 * len(q):
        return False
    if not left:
        return True
    rest = {a[x:y] for x, y in left}
    if len(q) < 8:  # a figure is an answer to it
        return rest <= LABELS
    if all(r in LABELS or len(r) <= 2 for r in rest):
        return True
    foreign = any(x not in q for x in map(_letters, re.split(r"[:\n\"“”„«»]", answer)) if x)
    return foreign and all(all(w in LABELS for w in WORD.findall(part)) for part in re.split(r"[:\n]", answer) if _letters(part) and _letters(part) not in q)


def _open_delimiter(text: str) -> bool:
    """Whether a bracket, guillemet or code fence is still open at the end."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for c in _DELIMITERS.findall(text):
        if c in _OPENERS:
            stack.append(_OPENERS[c])
        elif stack and c == stack[-1] or (stack and stack[-1] == "“" and c == "”"):
            stack.pop()
    return bool(stack)


def breaks_off(answer: str) -> bool:
    """Whether a non-empty answer ends before its last sentence is complete."""
    t = strip_invisible(answer).strip()
    if _open_delimiter(t) or _DOTS.search(t):
        return True
    cited = False
    while (end := t.rstrip(_TRAIL)).endswith("]") and (m := _LAST_CITATION.match(end, end.rfind("["))):
        t, cited = end[: m.start()].rstrip(), True
    t = t.rstrip(_MARKUP)
    if t.endswith(")"):
        t = re.sub(r"[.!?]\s*\([^()]*\)$", ".", t)
    if not t:
        return False
    if _DONE.search(t):
        return not cited and t.endswith(".") and bool(_ABBREVIATION.search(t.rsplit(None, 1)[-1]))
    if not cited:
        return True
    last = WORD.findall(t)
    return t[-1] in ",;:(-–—/" or (bool(last) and t.endswith(last[-1]) and last[-1].lower() in _DANGLING)


_LANGUAGES = tuple(REFUSALS)
_FIGURES = re.compile(
    r"[$€%]|\d{2,}[.,]\d{3}|\b\d+ (?:days?|weeks?|months?|tage?n?|wochen|monate?n?|jours|mois|semaines|días|semanas|meses|euros?)\b"
)


def refuses(folded: str, lang: str | None = None) -> bool:
    """Whether the folded answer (citations removed) declines or says that nothing is said, and gives no answer.

    ``lang`` chooses the automaton; without it, every language's is asked.
    """
    langs = (lang,) if lang in REFUSALS else _LANGUAGES
    m = first(refusal_automaton, langs, folded)
    if not m:
        return False
    start, end = m
    rest = folded[end:]
    turn = first(turn_automaton, langs, rest)
    if turn:
        after = rest[turn[1] :]
        told = len(after) > 8 if lang in UNSPACED else len(WORD.findall(after)) > 3
        if re.search(r"\d", after) or told and not first(refusal_automaton, langs, after):
            return False
    # An answer that gives figures elsewhere isn't a refusal; figures of the place asked about may stand.
    return not _FIGURES.search(folded[:start] + " " + rest)


def defects(question: str | None, answer: str | None, known: dict[str | None, Prompt] | None = None) -> list[str]:
    """Defects of one pair, in a fixed order; a null or blank question has no language and can't be copied.

    ``known`` keeps what was worked out for a question (its form, letters, language and automaton) for the next pair.
    """
    shown = strip_invisible(answer or "")
    stripped = CITATION.sub(" ", shown) if "[" in shown else shown
    a = visual_form(stripped, True, False).replace("’", "'")
    if not _SOME.search(stripped) or not any(w[0] not in LABELS for w in WORD.finditer(a)) and not re.search(r"\d", a):
        return ["empty"]
    prompt = (known or {}).get(question)
    if prompt is None:
        prompt = Prompt(question or "")
        if known is not None:
            known[question] = prompt
    out = []
    if copies_question(prompt, a):
        return ["copied_question"]
    if breaks_off(answer or ""):
        out.append("truncated")
    body = re.sub(r"\([^()]*\)", " ", a) if "(" in a else a
    la = language(stripped, 0.5, folded=body)
    if refuses(a, la):
        out.append("refusal")
    lq = prompt.language
    if lq and la and la != lq:
        v = votes(WORD.findall(body))
        if la not in v or v[la] > v.get(lq, 0) + 0.5 or v.get(lq, 0) == 0:
            out.append("other_language")
    return out


def defective_pairs(df: DataFrame, key: str = "request_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """``key, defect``: one row per defect of a pair; repeated rows count once, only three columns are read.

    Each distinct pair of an Arrow batch is judged once, and each distinct question worked out once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str | None, Prompt] = {}
            judged: dict[tuple, list[str]] = {}
            out = []
            for k, q, a in zip(b["k"], b["q"], b["a"]):
                if (q, a) not in judged:
                    judged[q, a] = defects(q, a, known)
                out += [(k, d) for d in judged[q, a]]
            yield frame(out, ["k", "defect"])

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    return src.mapInPandas(run, f"k {kind}, defect string").distinct().withColumnRenamed("k", key)
