"""Evaluation passages that have got into training text.

The test items, normalised to their letters and digits (so that case,
punctuation, spacing, invisible and look-alike characters make no difference),
form a generalised suffix automaton. Training text is streamed over it, and at
each character the longest matching length is tracked, with the items and the
places in them that the match, and each shorter suffix long enough to count,
ends at. A run that can't go on is measured in words of its item: a document is
reported with an item if one unbroken run holds at least ``coverage`` of the
item's words, and such runs can be removed.

Items are grouped by the letters that a run of theirs needs, and into parts of
bounded size, each with an automaton of its own: so a short item doesn't change
how the others are searched, and no worker holds more than one part.

Most text never needs an automaton: a run of L characters holds one of the
k-grams taken every L - k + 1 characters, so a text none of whose sampled
k-grams is in an item can't hold a run. That test loses nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import frame
from .visual import LOOKALIKES, strip_invisible

#: Characters of test items in one part, which is one broadcast and one automaton a group (about 400 bytes a character).
PART_CHARS = 400_000
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_ODD = re.compile("[" + "".join(LOOKALIKES) + "]")
#: Characters between sampled k-grams, and of a k-gram, at most (shorter runs need less). Smaller steps sample more, but tell texts
#: that only share a phrase from those that hold a run.
STEP, GRAM = 16, 48
#: Letters that one character can become when it is folded (the longest compatibility decomposition has 18).
LONGEST_FOLD = 18
_NOT_WORD_WIDE = re.compile(r"[^\w\x00-\x7f]+")
_WORD = re.compile(r"[^\W_]+")
_ASCII_DROP = bytes(c for c in range(128) if not chr(c).isalnum())


def folded(text: str, case: bool = True) -> str:
    """Compatibility forms, look-alike letters and (if wanted) case folded; punctuation and spacing still there."""
    if text.isascii():
        return text.lower() if case else text
    text = unicodedata.normalize("NFKD", strip_invisible(text))
    if _ODD.search(text):  # before case folding: a capital and its small letter can look like different letters
        text = text.translate(_FOLD)
    return unicodedata.normalize("NFC", text.casefold() if case else text)


def letters(text: str) -> str:
    """The letters and digits of the folded text, without anything between them."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_DROP).decode()
    return _NOT_WORD_WIDE.sub("", folded(text)).encode().translate(None, _ASCII_DROP).decode()


def _words(raw: str) -> tuple[str, list[int]]:
    """The letters of an item, and where each of its words starts (and the last ends) in them."""
    words, starts = _WORD.findall(folded(raw)), [0]
    for w in words:
        starts.append(starts[-1] + len(w))
    return "".join(words), starts


@dataclass(frozen=True)
class Run:
    """An unbroken run: item, its words in the run, letters of the text from ``start`` to ``end``."""

    item: int
    words: int
    start: int
    end: int


class ItemAutomaton:
    """Generalised suffix automaton of items that need runs of about the same length; each state long enough has the places it ends at."""

    def __init__(self, items: list[tuple[int, str, list[int], int, int]]) -> None:
        """``items``: index, letters, word starts, words needed, letters that so many words have at least."""
        self.text = {i: t for i, t, *_ in items}
        self.starts = {i: s for i, _, s, *_ in items}
        self.need = {i: n for i, _, _, n, _ in items}
        self.shortest = min(x[4] for x in items)
        self.k = self.shortest if self.shortest <= 12 else min(GRAM, self.shortest - min(STEP, self.shortest // 4) + 1)
        self.step = min(STEP, self.shortest - self.k + 1)
        grams: dict[str, set[int]] = {}
        for i, t, *_ in items:
            for p in range(len(t) - self.k + 1):
                grams.setdefault(t[p : p + self.k], set()).add(i)
        self.grams = {g: tuple(v) for g, v in grams.items()}
        #: Sampled k-grams that a run of the item's words holds at least.
        self.samples = {i: max(1, (n - self.k + 1) // self.step) for i, _, _, _, n in items}
        self._built = False

    def _build(self) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}

        def copy(p: int, q: int, c: str) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            return clone

        for i, t in self.text.items():
            last = 0
            for at, c in enumerate(t, 1):
                q = nxt[last].get(c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else copy(last, q, c)
                else:
                    cur, p = len(nxt), last
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p != -1:
                        q = nxt[p][c]
                        link[cur] = q if length[q] == length[p] + 1 else copy(p, q, c)
                    last = cur
                if at >= self.shortest:
                    ends.setdefault(last, []).append((i, at))
        # A match that ends at a place ends there with each of its suffixes; only suffixes long enough are ever asked.
        for v in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            up = link[v]
            if v in ends and length[up] >= self.shortest:
                ends.setdefault(up, []).extend(ends[v])
        self.next, self.link, self.length, self.ends = nxt, link, length, ends
        self._built = True

    def stream(self, s: str, base: int = 0) -> Iterator[Run]:
        """Runs of ``s`` with at least the words their items need, each once, as it stops."""
        if not self._built:
            self._build()
        nxt, link, length, ends, text, least = self.next, self.link, self.length, self.ends, self.text, self.shortest
        v = n = 0
        for e, c in enumerate(s):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            else:
                v = n = 0
            if n < least:
                continue
            then = s[e + 1 : e + 2]
            u, size, seen = v, n, ()
            while size >= least:
                places = ends.get(u, ())
                if len(places) > len(seen):  # a suffix ends wherever the match does, and perhaps elsewhere
                    for i, q in places:
                        if (then and text[i][q : q + 1] == then) or (seen and (i, q) in seen):
                            continue  # the run goes on, or was longer
                        starts = self.starts[i]
                        words = bisect_right(starts, q) - 1 - bisect_left(starts, q - size)
                        if words >= self.need[i]:
                            yield Run(i, words, base + e + 1 - size, base + e + 1)
                    seen = places
                u = link[u]
                size = length[u]

    def runs(self, s: str) -> Iterator[Run]:
        """``stream`` over the stretches of ``s`` that can hold a run: as many sampled k-grams of an item in a row as its run holds."""
        k, step, grams = self.k, self.step, self.grams
        rows: dict[int, list[int]] = {}  # of each item: first and last place of the row going on, k-grams in it
        regions: list[tuple[int, int]] = []

        def close(i: int) -> None:
            a, b, n = rows[i]
            if n >= self.samples[i]:
                regions.append((max(0, a - step), b + k + step))

        for p in range(0, len(s) - k + 1, step):
            own = grams.get(s[p : p + k])
            if own:
                for i in own:
                    row = rows.get(i)
                    if row and row[1] == p - step:
                        row[1], row[2] = p, row[2] + 1
                    else:
                        if row:
                            close(i)
                        rows[i] = [p, p, 1]
        for i in rows:
            close(i)
        regions.sort(reverse=True)
        while regions:
            a, b = regions.pop()
            while regions and regions[-1][0] <= b:
                b = max(b, regions.pop()[1])
            yield from self.stream(s[a:b], a)


class Items:
    """Test items in groups by the length of run they need (doubling up to that of a k-gram and a step), each with its automaton."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = 0.5) -> None:
        self.ids, self.total, groups = [], [], {}
        for key, raw in items:
            t, starts = _words(raw or "")
            if not t:
                continue
            n = max(1, ceil(coverage * (len(starts) - 1) - 1e-9))
            least = min(starts[k + n] - starts[k] for k in range(len(starts) - n))
            groups.setdefault(min(least.bit_length(), (GRAM + STEP).bit_length()), []).append((len(self.ids), t, starts, n, least))
            self.ids.append(key)
            self.total.append(len(starts) - 1)
        self.groups = [ItemAutomaton(groups[g]) for g in sorted(groups)]
        self.shortest = min((g.shortest for g in self.groups), default=0)

    def runs(self, text: str | None) -> list[Run]:
        if not self.ids or not text:
            return []
        s = letters(text)
        return [r for g in self.groups if len(s) >= g.shortest for r in g.runs(s)]

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, words in the longest run, words of the item) for each item that leaks into ``text``."""
        best: dict[int, int] = {}
        for r in self.runs(text):
            best[r.item] = max(best.get(r.item, 0), r.words)
        return [(self.ids[i], n, self.total[i]) for i, n in best.items()]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, start, end) of each run as offsets in ``text``, widened to whole words between white space."""
        runs = self.runs(text)
        if not runs:
            return []
        sizes, starts, ends = [0], [], []
        for m in _TOKEN.finditer(text):
            n = len(letters(m[0]))
            if n:
                sizes.append(sizes[-1] + n)
                starts.append(m.start())
                ends.append(m.end())
        return sorted({(self.ids[r.item], starts[bisect_right(sizes, r.start) - 1], ends[bisect_left(sizes, r.end) - 1]) for r in runs})


_TOKEN = re.compile(r"\S+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; what stood on either side of one is parted by a space."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out.append(text[at:a].strip())
        at = max(at, b)
    return " ".join(p for p in [*out, text[at:].strip()] if p)


_CACHE: dict[tuple, Items] = {}


def _built(items: tuple, coverage: float) -> Items:
    key = (hash(items), coverage)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Items(list(items), coverage)
    return _CACHE[key]


def _parts(items: DataFrame) -> Iterator[tuple]:
    """The usable items in parts of about ``PART_CHARS`` characters at most, one after the other in the driver."""
    usable = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = ceil(size / PART_CHARS)
    for k in range(n):
        own = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else usable
        rows = own.orderBy("item_id", "text").collect()
        if rows:
            yield tuple((r["item_id"], r["text"]) for r in rows)


def _over_parts(documents: DataFrame, items: DataFrame, coverage: float, columns: str, of: Callable[[Items, str], list[tuple]]) -> DataFrame:
    """``doc_id`` and what ``of`` finds of every part of the items in every text, one pass over the documents a part."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, {columns}"
    spark, out = documents.sparkSession, None
    for part in _parts(items):
        shared, least = spark.sparkContext.broadcast(part), Items(list(part), coverage).shortest
        if not least:
            continue

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = _built(shared.value, coverage)
            for b in batches:
                yield frame([(d, *f) for d, t in zip(b["doc_id"], b["text"]) for f in of(own, t)], [c.split()[0] for c in schema.split(", ")])

        src = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") >= least // LONGEST_FOLD))
        found = src.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def leaked_items(documents: DataFrame, items: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``doc_id, item_id, run_words, item_words`` for each document that holds at least ``coverage`` of an item's words in one run.

    ``items`` (``item_id``, ``text``) is collected part by part (``PART_CHARS``)
    and sent to the workers; documents are passed over once for each part, and
    aren't shuffled but for the distinct result rows. Null, empty and wordless
    texts on either side give no row; repeated rows count once.
    """
    found = _over_parts(documents, items, coverage, "run_words int, item_words int", lambda own, t: own.found(t))
    return found.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))


def leaked_spans(documents: DataFrame, items: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``doc_id, item_id, char_start, char_end``: every run that counts, as a range of whole words of the document's text."""
    return _over_parts(documents, items, coverage, "char_start int, char_end int", lambda own, t: own.spans(t)).distinct()


def remove_leaks(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with the ranges of ``spans`` (``doc_id, char_start, char_end``) cut out of ``text``, and ``removed_chars``.

    Only documents with a range reach Python; null texts and repeated rows stay
    as they are. A document's ranges are bounded by its length.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else without(t, [(x["a"], x["b"]) for x in r]) for t, r in zip(text, ranges)], dtype=object)

    own = spans.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("char_start").alias("a"), F.col("char_end").alias("b"))).alias("_ranges"))
    names = [c for c in documents.columns if c != "text"]
    hit = documents.join(own, "doc_id").withColumn("_cut", cut("text", "_ranges"))
    changed = hit.select(*names, F.col("_cut").alias("text"), (F.length("text") - F.length("_cut")).alias("removed_chars"))
    kept = documents.join(own.select("doc_id"), "doc_id", "left_anti").select(*names, "text", F.lit(0).alias("removed_chars"))
    return changed.unionByName(kept)
