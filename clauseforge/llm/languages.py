"""Language of a text by stop-word votes, with scripts deciding where they can."""

from __future__ import annotations

import re

# Frequent function words, by language.
STOPWORDS = {
    "en": "the of and to in is are was be been may must shall will not for on at by with from this that these those it its as an or "
    "if unless until after before under above which who whom you your we our they their what how why when where does do did can "
    "could would should has have had any all each either neither nor than then there here such upon about into per within without "
    "day days week weeks month months year years",
    "de": "der die das den dem des ein eine einer eines einem einen und oder nicht ist sind war wird werden wurde kann können darf dürfen muss "
    "müssen soll sollen für auf mit von vom zum zur bei bis aus nach über unter gegen ohne durch sich sie er es wir ihr ihnen ihre "
    "ihren seine seinen wie wer wo wenn wann dass daß als auch nur noch aber sofern sonst jede jeder jedes jedem jeden keine kein "
    "im am an zu hat haben hierzu dazu tag tage tagen woche wochen monat monate monaten jahr jahre jahren",
    "fr": "le la les un une des du de et ou ne pas est sont était être peut peuvent doit doivent pour sur avec par dans chez au aux ce cette ces "
    "il elle ils elles nous vous je qui que quoi dont où si sauf sous avant après sans plus moins en à l d qu n s c j se sa son ses leur "
    "leurs votre notre aucun aucune chaque tout toute tous toutes comment quel quelle jour jours semaine semaines mois an ans année",
    "es": "el la los las un una unos unas de del al y o no es son fue ser puede pueden debe deben para por con sin sobre en entre hasta desde "
    "que qué como cómo cuál quién si salvo se su sus lo le les este esta estos estas ese esa nos usted ustedes yo me mi más menos "
    "cada ningún ninguna ninguno todo toda todos todas ha han hay según día días semana semanas mes meses año años",
}
WORD = re.compile(r"[^\W\d_]+")
_SETS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
#: word -> languages that have it
VOTES: dict[str, tuple[str, ...]] = {}
for _k, _v in _SETS.items():
    for _w in _v:
        VOTES[_w] = VOTES.get(_w, ()) + (_k,)
# First and last character of the blocks of scripts that decide a language or a group.
SCRIPTS = {
    "ru": ("Ѐ", "ӿ"),
    "ar": ("؀", "ۿ"),
    "hi": ("ऀ", "ॿ"),
    "th": ("฀", "๿"),
    "ja": ("぀", "ヿ"),
    "zh": ("㐀", "鿿"),
}
_SCRIPT = {k: re.compile(f"[{a}-{b}]") for k, (a, b) in SCRIPTS.items()}
#: Any letter of a deciding script.
_ANY = re.compile("[" + "".join(f"{a}-{b}" for a, b in SCRIPTS.values()) + "]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


def script_counts(text: str) -> dict[str, int]:
    """Letters by deciding script; ``latin`` for the rest. Kana make the Han letters Japanese."""
    if text.isascii() or not _ANY.search(text):
        return {"latin": len(LATIN.findall(text))}
    n = {k: len(r.findall(text)) for k, r in _SCRIPT.items()}
    n["latin"] = len(LATIN.findall(text))
    if n["ja"]:
        n["ja"], n["zh"] = n["ja"] + n["zh"], 0
    return n


def votes(words: list[str]) -> dict[str, float]:
    """Stop-word votes of lower-case words; a word of several languages gives each its share."""
    out = dict.fromkeys(STOPWORDS, 0.0)
    for hit in filter(None, map(VOTES.get, words)):
        for k in hit:
            out[k] += 1 / len(hit)
    return out


def language(text: str, least: float = 1.0, folded: str | None = None) -> str | None:
    """Language of most of ``text``: by script if most letters are in one, else by votes; None if they tell nothing.

    Letters of scripts that write a word in one or two count threefold against
    Latin. ``folded`` is the text to vote on, where look-alike letters are Latin.
    """
    if not text.isascii() and _ANY.search(text):
        n = script_counts(text)
        latin = n.pop("latin")
        top = max(n, key=n.get)
        weight = 3 if top in ("zh", "ja") else 1
        if n[top] * weight > latin:
            return top
    elif not LATIN.search(text):
        return None
    v = votes(WORD.findall((text if folded is None else folded).lower()))
    first, second = sorted(v.values(), reverse=True)[:2]
    return max(v, key=v.get) if first >= least and first > second else None
