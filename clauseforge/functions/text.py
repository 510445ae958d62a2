"""Text functions as Column expressions; a UDF only where Catalyst can't say the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The 33 English stop words of the search index.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
# Stop words of the failure analysis.
CONTENT_STOPWORDS = (
    "the a an of to in on for and or by with under between is are be do does what which who when how long any either party parties "
    "agreement this that it its from as at can may shall will"
).split()
# Number words that count as figures on the evidence side.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "sixty": 60, "ninety": 90, "hundred": 100,
}
# Patterns of tokens, citations, numbers and refusals.
TOKEN = r"[\p{L}\p{N}_]{2,}"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
SENTENCE_END = r"(?<=[.;])\s+(?=[A-Z(\"“])"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z(\"'“])"
DECLINES = (
    r"(?i)\b(?:does|do|did) not (?:explicitly |expressly |specifically )?(?:contain|specify|mention|include|state|provide|address|define|set out)"
    r"|\b(?:doesn't|don't|didn't) (?:contain|specify|mention|include|state|provide|address|define)"
    r"|\bnot (?:specified|stated|mentioned)\b|\bno (?:specific|explicit)\b"
)
SAYS_NOT_FOUND = (
    r"(?i)\b(?:does not|do not|doesn't|did not) (?:contain|specify|mention|include|state|provide|address|define)"
    r"|not (?:specified|explicitly|stated|mentioned)|no (?:specific|explicit)"
)
EXTRA_DETAIL = (
    r"(?i)not (?:present|mentioned|found|included|stated|contained|specified) in (?:the )?(?:provided |highlighted )?(?:clause|text|reference)"
    r"|extraneous|not requested|not asked"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str, stopwords: list[str] | None = STOPWORDS) -> Column:
    """Lower-case tokens of two letters and more, in order, with repeats; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))
    if not stopwords:
        return found
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(found, lambda x: ~F.array_contains(stop, x))


def content_words(c: Column | str, stem: Callable[[Column], Column] | None = None) -> Column:
    """Distinct words of three letters and more that carry meaning; ``stem`` maps the array of words to their stems (``udfs.stems``)."""
    stop = F.array(*[F.lit(w) for w in CONTENT_STOPWORDS])
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[a-z]+"), F.lit(0))
    words = F.filter(found, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
    return F.array_distinct(stem(words) if stem else words)


def normalize(c: Column | str) -> Column:
    """Lower case, letters and digits only, every run of anything else one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def token_count(c: Column | str) -> Column:
    """Number of parts between white space (the pluggable default token counter)."""
    return F.size(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("bigint")


def repetition_key(c: Column | str) -> Column:
    """Key under which a repeated page margin counts as the same: digits become #."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(_col(c), r"\s+", " "))), r"\d+", "#")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def normalize_markdown(c: Column | str) -> Column:
    """Lines trimmed and inner runs of spaces squeezed; empty lines dropped."""
    lines = F.transform(F.split(_col(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def join_hyphenated(c: Column | str) -> Column:
    """Lines joined by a space; a word of two letters and more broken by a hyphen before a small letter is glued. Empty lines don't count."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"[ \t]*\n\s*", "\n"), r"[ \t]+", " ")
    return F.replace(F.regexp_replace(tidy, r"(?<=\b\w{2,40})-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" "))


@F.pandas_udf(StringType())
def normalize_inline(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form, soft hyphens dropped, horizontal space squeezed, trimmed; once per distinct value."""
    for s in batches:
        codes, values = pd.factorize(s)
        done = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v).replace("­", "")).strip() for v in values] + [None]
        yield pd.Series([done[c] for c in codes], dtype=object)


def citations(c: Column | str) -> Column:
    """Cited numbers in order of first mention, without repeats."""
    groups = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(CITATION), F.lit(1))
    flat = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_distinct(F.transform(flat, lambda x: F.try_to_number(x, F.lit("999999999999999999")).cast("bigint")))


def strip_citations(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), CITATION, "")


def numbers(c: Column | str, words: bool = False) -> Column:
    """Distinct figures without thousands commas and ``.00``; with ``words``, number words count as their figures."""
    text = F.coalesce(_col(c), F.lit(""))
    figures = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.00$", ""))
    if words:
        named = F.filter(
            F.array(*[F.when(text.rlike(rf"(?i)\b{w}\b"), F.lit(str(n))) for w, n in NUMBER_WORDS.items()]), lambda x: x.isNotNull()
        )
        figures = F.concat(figures, named)
    return F.array_distinct(figures)


def unsupported_numbers(statement: Column | str, excerpts: Column | str) -> Column:
    """Figures of a statement that its excerpts mention neither as figures nor as words, sorted."""
    return F.array_sort(F.array_except(numbers(statement), numbers(excerpts, words=True)))


def declines(answer: Column | str, abstained: Column | str) -> Column:
    """By the flag, by an empty answer, or because the first sentence says the contract doesn't cover it."""
    text = F.trim(F.coalesce(_col(answer), F.lit("")))
    first = F.element_at(F.split(text, SENTENCE_GAP, 2), 1)
    return F.coalesce(_col(abstained), F.lit(False)) | (text == "") | first.rlike(DECLINES)


def excerpt_text(context: Column | str, text: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(context), F.lit("")), _col(text))


def table_markdown(rows: Column | str) -> Column:
    """Markdown of an array of rows of cells: pipes escaped, short rows padded, a header line made from the first row; empty for no rows."""
    r = _col(rows)
    width = F.array_max(F.transform(r, lambda x: F.size(x)))
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), r"\|", r"\\|")
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))), clean), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), line)
    return F.when(F.size(r) > 0, F.array_join(F.concat(F.array(line(F.element_at(r, 1)), rule), body), "\n")).otherwise(F.lit(""))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def covers(start: Column, end: Column, a_start: Column, a_end: Column, share: float = 0.5) -> Column:
    """Overlap of more than nothing and of at least ``share`` of the shorter side."""
    ov = overlap(start, end, a_start, a_end)
    return (ov > 0) & (ov >= F.lit(share) * F.least(end - start, a_end - a_start))


def section_label(path: Column | str, last: int = 2) -> Column:
    """The last parts of a section path, joined; a shorter path as it is, an empty one ``no section``."""
    p = _col(path)
    tail = F.when(F.size(p) > last, F.slice(p, -last, last)).otherwise(p)
    return F.coalesce(F.nullif(F.array_join(tail, " > "), F.lit("")), F.lit("no section"))


def match_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def mostly_upper(c: Column | str, share: float = 0.5) -> Column:
    """Whether more than ``share`` of the letters that have a case are capitals."""
    big, small = F.regexp_count(_col(c), F.lit(r"\p{Lu}")), F.regexp_count(_col(c), F.lit(r"\p{Ll}"))
    return big > share * (big + small)


def capitalised(c: Column | str) -> Column:
    """Every letter after something that isn't a letter large, the others small."""
    parts = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def display_title(c: Column | str) -> Column:
    """Readable title of a filing's file name: kind of agreement, company and year, parted by dots; a name without ``_`` stays.

    The kind stands after the last exhibit mark, the company before the first
    ``_``; the year is the first of 19.. or 20.., with or without a day. Names in capitals are capitalised.
    """
    src = _col(c)
    tidy = lambda x: F.when(mostly_upper(x), capitalised(x)).otherwise(x)
    company = F.trim(F.replace(F.replace(F.substring_index(src, "_", 1), F.lit(","), F.lit(", ")), F.lit(",  "), F.lit(", ")))
    last = F.element_at(F.split(src, r"EX-[0-9A-Za-z.()]+[-_ ]"), -1)
    kind = F.replace(F.regexp_replace(last, r"^[ \-_]+|[ \-_]+$", ""), F.lit("_"), F.lit(" "))
    year = F.regexp_extract(src, r"(?<!\d)((?:19|20)\d{2})(?:\d{4})?(?!\d)", 1)
    parts = F.array(tidy(F.coalesce(F.nullif(kind, F.lit("")), src)), tidy(company), year)
    return F.when(F.contains(src, F.lit("_")), F.array_join(F.filter(parts, lambda x: x != ""), " · ")).otherwise(src)


# Words that stay small inside a title; what begins the descriptive tail of a party's name.
SMALL_WORDS = "a an and as at by for in of on or the to with".split()
PARTY_TAIL = r"(?i)\s+(?:including|together with|and its|operating|doing business|d/b/a|acting|as successor)\b|,\s+an?\s"


def title_case(c: Column | str) -> Column:
    """Names written mostly in capitals in title case, small words small but for the first; other names stay."""
    words = F.split(F.lower(squeeze(c)), " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    large = lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    letters, big = F.regexp_count(_col(c), F.lit(r"\p{L}")), F.regexp_count(_col(c), F.lit(r"\p{Lu}"))
    return F.when((letters > 0) & (big >= 0.8 * letters), F.array_join(F.transform(words, large), " ")).otherwise(_col(c))


def parse_parties(c: Column | str) -> Column:
    """Names of a party list parted by semicolons, without what stands in brackets; a name counts once whatever its case."""
    edges = r"^[ ,;\"'“”]+|[ ,;\"'“”]+$"
    clean = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ";"), lambda x: F.regexp_replace(squeeze(F.regexp_replace(x, r"\([^)]*\)", "")), edges, ""))
    some = F.filter(clean, lambda x: x != "")
    return F.filter(some, lambda x, i: F.array_position(F.transform(some, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def short_party(c: Column, limit: int = 60) -> Column:
    """A party's name without its descriptive tail; where it is still longer than ``limit``, what stands before the first comma."""
    head = F.regexp_replace(F.element_at(F.split(c, PARTY_TAIL, 2), 1), r"^[ ,]+|[ ,]+$", "")
    return F.when((F.length(head) > limit) & F.contains(head, F.lit(",")), F.trim(F.substring_index(head, ",", 1))).otherwise(head)


def agreement_name(document_name: Column | str, parties: Column, fallback: Column | str) -> Column:
    """``the <agreement> between <first> and <second>``, with one party ``with <first>``; the fallback stands in for an empty name."""
    base = F.regexp_replace(F.trim(F.coalesce(_col(document_name), F.lit(""))), r"^[ .\"'“”]+|[ .\"'“”]+$", "")
    base = title_case(F.regexp_replace(F.regexp_replace(base, r"\s*\([^)]*$", ""), r",\s*\w{1,2}$", ""))
    base = F.regexp_replace(F.coalesce(F.nullif(base, F.lit("")), _col(fallback)), r"(?i)^(?:the|this)\s+", "")
    who = F.transform(parties, lambda x: short_party(x))
    tail = F.when(F.size(who) >= 2, F.concat(F.lit(" between "), who[0], F.lit(" and "), who[1])).when(F.size(who) == 1, F.concat(F.lit(" with "), who[0])).otherwise(F.lit(""))
    return F.concat(F.lit("the "), base, tail)


def slug(c: Column | str) -> Column:
    """File name without its ending as an id: small letters and digits, everything else one dash."""
    stem = F.regexp_replace(_col(c), r"\.[^./]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def canonical_type(c: Column | str, known: dict[str, str]) -> Column:
    """Contract type of a folder's name by its letters alone; an unknown folder is an error."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z]+", " "), r"\s+", " "))
    found = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[key]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown contract type: "), _col(c))).cast("string"))


def whitespace_equivalent(a: Column | str, b: Column | str) -> Column:
    """Whether two texts differ in white space only."""
    return squeeze(a) == squeeze(b)


def short_id(c: Column | str) -> Column:
    """A chunk's id without its document's."""
    return F.regexp_extract(_col(c), r"(?s)^.*?::(.*)$", 1)


def best_sentence(text: Column | str, statement: Column | str, least: int = 25) -> Column:
    """The sentence of ``text`` with the most of the statement's meaning words, a shared figure counting three; the first of equals, empty for none.

    Sentences of ``least`` characters and fewer don't count.
    """
    sents = F.filter(F.transform(F.split(squeeze(text), SENTENCE_END), lambda x: F.trim(x)), lambda x: F.length(x) > least)
    words, figures = content_words(statement), F.array_distinct(F.regexp_extract_all(F.coalesce(_col(statement), F.lit("")), F.lit(NUMBER), F.lit(0)))
    worth = lambda x: F.size(F.array_intersect(content_words(x), words)) + 3 * F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))), figures))
    ranked = F.transform(sents, lambda x, i: F.struct(worth(x).alias("n"), (-i).alias("i"), x.alias("s")))
    return F.coalesce(F.array_max(ranked)["s"], F.lit(""))


def hash_draw(*parts: Column | str) -> Column:
    """A draw from 0 to 2³²-1 that depends on its parts only (stands in for a seeded generator)."""
    text = F.concat_ws("~", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
