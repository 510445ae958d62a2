"""Reading level of documents, from the levels of their sentences.

A regularised softmax model over words and over character n-grams inside words
is fitted on a bounded sample of labelled documents. Its score of a word is the
sum of the word's weight and of its n-grams' weights, so each distinct word is
scored once; a sentence's distribution over the levels follows from its words,
and a document's distribution from its sentences, weighted by their words. The
document's difficulty is its expected level after calibration on the sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import frame
from .languages import SCRIPTS, VOTES, script_counts
from .leakage import folded

#: Labelled documents that the model is fitted on at most, and the longest of them in characters (bounds of a sample, not of what is scored).
SAMPLE_DOCS, SAMPLE_CHARS = 400, 12_000
#: Feature buckets, n-gram lengths, ridge penalty and steps of the fit.
BUCKETS, GRAMS, RIDGE, STEPS = 1 << 17, (4,), 2e-4, 40
LANGUAGES = ("en", "de", "fr", "es")
MIN_WORDS = 40
#: Calibration: exponents of a sentence's words in its weight, and factors on its score.
POWERS, TEMPERATURES = (0.0, 0.25, 0.5, 0.75, 1.0), (1.0, 1.5, 2.0)
#: One in so many labelled documents is held out of the fit that the calibration is measured on.
HELD_OUT = 5
#: Words whose scores a worker keeps at a time.
KEPT_WORDS = 300_000
_OTHER = re.compile("[" + "".join(f"{a}-{b}" for a, b in SCRIPTS.values()) + "]")
_SENTENCE = re.compile(r"[.!?][\"”“»)]*\s+(?=[\"„“«(¿¡]?[A-ZÀ-ÝА-Я])")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a folded word: itself and its n-grams; figures are one word by their number of digits."""
    if word[0].isdigit():
        return [_bucket(f"#{min(len(word), 4)}")]
    framed = f"<{word}>"
    return [_bucket("=" + word)] + [_bucket(framed[k : k + n]) for n in GRAMS for k in range(len(framed) - n + 1)]


def split_sentences(text: str) -> list[list[str]]:
    """Words of each sentence of the folded text; a plain splitter is enough for a share of sentences."""
    return [w for p in folded(text, case=False).split("\n\n") for s in _SENTENCE.split(p) if (w := _WORD.findall(s.lower()))]


def word_count(text: str) -> int:
    """Parts between white space that hold a letter, digit or underscore."""
    return len(text.split()) - len(_BARE.findall(text))


def other_script(text: str) -> bool:
    """Whether most of the text is in a script other than Latin; letters of scripts that write a word in one or two count threefold."""
    if text.isascii() or not _OTHER.search(text):
        return False
    n = script_counts(text)
    latin = n.pop("latin")
    return latin <= sum(v * (3 if k in ("zh", "ja") else 1) for k, v in n.items())


class LevelModel:
    """Softmax weights (bucket × level) with the calibration of a document's distribution."""

    def __init__(self, levels: list[int]) -> None:
        self.levels, self.weights, self.bias = levels, np.zeros((BUCKETS, len(levels)), dtype=np.float32), np.zeros(len(levels), dtype=np.float32)
        self.temperature, self.power = 1.0, 1.0

    def fit(self, docs: list[tuple[str, int]]) -> LevelModel:
        """Sentences take the level of their document at first, then, twice, a level the fitted model shares with it."""
        rows, cols, vals, label, doc = [], [], [], [], []
        for d, (text, level) in enumerate(docs):
            for words in split_sentences(text):
                if len(words) < 3:
                    continue
                f = [b for w in words for b in word_features(w)]
                rows.append(np.full(len(f), len(label), dtype=np.int32))
                cols.append(np.asarray(f, dtype=np.int32))
                vals.append(np.full(len(f), 1 / len(words), dtype=np.float32))
                label.append(self.levels.index(level))
                doc.append(d)
        if not label or len(self.levels) < 2:
            return self
        r, c, v, y = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), np.asarray(label)
        starts = np.searchsorted(r, np.arange(len(y)))
        by_bucket = np.argsort(c, kind="stable")
        r2, v2 = r[by_bucket], v[by_bucket]
        used, first = np.unique(c[by_bucket], return_index=True)
        m = len(self.levels)
        w, b, gw, target = np.zeros((len(used), m), np.float32), np.zeros(m, np.float32), np.full((len(used), m), 1e-6, np.float32), np.eye(m, dtype=np.float32)[y]
        local = np.searchsorted(used, c)
        share = np.bincount(y, minlength=m).astype(np.float32)
        weight = (len(y) / m / np.maximum(share, 1))[y][:, None]
        for step in range(STEPS):
            z = np.add.reduceat(w[local] * v[:, None], starts, axis=0) + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            if step in (STEPS // 2, STEPS * 3 // 4):
                # A plain sentence in a dense document stays plain: soften labels the model clearly contradicts.
                target = np.where((p.max(1) > 0.9)[:, None] & (p.argmax(1) != y)[:, None], p, np.eye(m, dtype=np.float32)[y])
            g = (p - target) * weight
            grad = np.add.reduceat(g[r2] * v2[:, None], first, axis=0) / len(y) + RIDGE / len(used) * w
            gw += grad * grad
            w -= 1.0 * grad / np.sqrt(gw)
            b -= 0.1 * g.mean(0)
        self.weights[used], self.bias = w, b
        return self

    def calibrate(self, docs: list[tuple[str, int]]) -> LevelModel:
        """How much a sentence's length counts, and how sharp distributions are, by the labelled documents."""
        scorer, best, chosen = Scorer(self), (-1.0, 0.0), (1.0, 1.0)
        if len(self.levels) < 2 or not docs:
            return self
        y = np.array([self.levels.index(level) for _, level in docs])
        cut = [split_sentences(t) for t, _ in docs]
        for power in POWERS:
            for temperature in TEMPERATURES:
                self.power, self.temperature = power, temperature
                p = np.array([scorer.shares(c)[0] for c in cut])
                right = float((p.argmax(1) == y).mean())
                fit = float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean())
                if (right, fit) > best:
                    best, chosen = (right, fit), (power, temperature)
        self.power, self.temperature = chosen
        return self


class _Vocabulary(dict):
    """Number of each word seen; new words get the next number and are scored once."""

    def __init__(self, model: LevelModel) -> None:
        self.model, self.rows = model, np.zeros((1024, len(model.levels) + len(LANGUAGES)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        m = len(self.model.levels)
        self.rows[k, :m] = self.model.weights[word_features(word)].sum(0)
        hit = VOTES.get(word, ())
        for lang in hit:
            self.rows[k, m + LANGUAGES.index(lang)] = 1 / len(hit)
        self[word] = k
        return k


class Scorer:
    """Scores texts with a model; the scores of words are kept, for at most ``KEPT_WORDS`` words at a time."""

    def __init__(self, model: LevelModel) -> None:
        self.model, self.words = model, _Vocabulary(model)

    def shares(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Share of the document at each level, and the stop-word votes of each language; zeros for no words."""
        m = len(self.model.levels)
        if not sents:
            return np.zeros(m), np.zeros(len(LANGUAGES))
        if len(self.words) > KEPT_WORDS:
            self.words = _Vocabulary(self.model)
        ids = [self.words[w] for s in sents for w in s]
        size = np.fromiter(map(len, sents), dtype=np.int64, count=len(sents))
        sums = np.add.reduceat(self.words.rows[ids], np.cumsum(size) - size, axis=0)
        z = (sums[:, :m] / size[:, None] + self.model.bias) * self.model.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if m else z
        p /= p.sum(1, keepdims=True)
        weight = size.astype(float) ** self.model.power
        return (p * weight[:, None]).sum(0) / weight.sum(), sums[:, m:].sum(0)

    def score(self, text: str, min_words: int = MIN_WORDS) -> tuple[str, int, np.ndarray] | None:
        """(language, words, shares) of a text in one of ``LANGUAGES`` with enough words, else None."""
        n = word_count(text)
        if n < min_words or other_script(text):
            return None
        shares, votes = self.shares(split_sentences(text))
        if not shares.sum() or not votes.max():
            return None
        return LANGUAGES[int(votes.argmax())], n, shares


def fit_levels(documents: DataFrame, labels: DataFrame) -> LevelModel:
    """The model of ``labels`` (``doc_id, band``), fitted on at most ``SAMPLE_DOCS`` labelled documents in hash order. Runs one job.

    Labels without a document, null bands and blank texts are left out; without
    any usable label the model has no level and scores nothing.
    """
    named = labels.filter(F.col("band").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "band").distinct()
    texts = documents.select("doc_id", "text").filter(F.length(F.trim("text")).between(1, SAMPLE_CHARS))
    picked = named.orderBy(F.xxhash64("doc_id"), "doc_id", "band").limit(SAMPLE_DOCS)
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("band").cast("int").alias("band")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["band"], r["text"]))
    levels = sorted({r["band"] for r in rows})
    docs = [(r["text"], r["band"]) for r in rows]
    held = [d for i, d in enumerate(docs) if i % HELD_OUT == 0]
    seen = [d for i, d in enumerate(docs) if i % HELD_OUT]
    if {b for _, b in seen} != set(levels):  # too few to hold any out
        return LevelModel(levels).fit(docs).calibrate(docs)
    # Calibrated on documents that the fit hasn't seen; the model itself is then fitted on all of them.
    tried, model = LevelModel(levels).fit(seen).calibrate(held), LevelModel(levels).fit(docs)
    model.power, model.temperature = tried.power, tried.temperature
    return model


def reading_levels(documents: DataFrame, model: LevelModel, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, language, words, band, difficulty, shares`` of each document in one of ``LANGUAGES`` with ``min_words`` words.

    ``band`` is the level of most of the document, ``difficulty`` the expected
    level, ``shares`` the distribution in the order of the levels. Null and
    blank texts give no row; repeated rows count once. The model (of a fixed
    size) is broadcast; documents aren't shuffled but for the result rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        levels = shared.value.levels
        value = np.asarray(levels, dtype=float)
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"]):
                if levels and (r := scorer.score(t, min_words)):
                    out.append((d, r[0], r[1], levels[int(r[2].argmax())], round(float(r[2] @ value), 6), [round(float(x), 6) for x in r[2]]))
            yield frame(out, ["doc_id", "language", "words", "band", "difficulty", "shares"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    src = documents.select("doc_id", "text").filter(F.length("text") >= 2 * min_words - 1)
    return src.mapInPandas(run, f"doc_id {kind}, language string, words int, band int, difficulty double, shares array<double>").dropDuplicates(["doc_id", "band"])
