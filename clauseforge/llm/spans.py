"""Long exact spans shared between records.

Seeds are the k-mers that are smallest (by hash) in some window of ``span``
characters, so every window has exactly one seed, fixed by its content alone.
Seeds are joined by hash with a representative of another record, and the
ordered matches of a record with each representative are chained with gap costs
through a Fenwick tree. A chain is aligned from seed to seed: two seeds that
follow one another on both sides at one distance, with equal text from the one
to the other, and the context (the text of all windows a seed stands for) of a
seed where it is equal, make up stretches that stand in both records letter for
letter. A stretch of ``span`` characters and more is shared, on both sides.

A representative isn't every partner, and pairs within a group of copies are
never listed. So the windows that no chain settles are compared by their hashes
over all records; the representative, which stands for all that align with it,
takes part with all its windows. That makes the result exact for any number of
partners, while the inside of a clause that many records share is compared once
per clause and not once per record.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import frame, materialise, salted_join

#: Characters of a shared run, of a seed (half a run: shorter ones stand in many records that share no run); cost of a
#: character skipped in a chain, in seed characters.
SPAN, SEED, GAP_COST = 300, 150, 0.02
#: Characters of a seed of a passage, which may differ between its seeds.
PASSAGE_SEED = 60
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(which: str, n: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 14), _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        base[0] = 1
        have = _POWERS[which] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of all substrings of a text, by code points; equal substrings have equal hashes wherever they are."""

    def __init__(self, text: str) -> None:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.n = len(c)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(c + np.uint64(1)) * _powers("up", self.n), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * _powers("down", self.n + 1)[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from the minima of blocks before and after."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(full, axis=1).ravel()[:n]
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def seeds(text: str, span: int = SPAN, k: int = SEED) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place, first and last window start, seed hash, context hash) of each seed; a tie goes to the left."""
    h = Hashes(text)
    none = np.zeros(0, dtype=np.int64)
    if h.n < span:
        return h, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(h.n - k + 1)
    value = h.of(at, at + k)
    order = np.argsort(value, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    anchor = order[_sliding_min(rank, span - k + 1)]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    place = anchor[first]
    context = _mix(h.of(first, last + span) + (place - first).astype(np.uint64))
    return h, place, first, last, value[place], context


class _Fenwick:
    """Greatest (value, index) over a prefix."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, k: int, value: tuple[float, int]) -> None:
        k += 1
        while k < len(self.best):
            if value > self.best[k]:
                self.best[k] = value
            k += k & -k

    def get(self, k: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while k > 0:
            if self.best[k] > out:
                out = self.best[k]
            k -= k & -k
        return out


def chains(matches: list[tuple[int, int]], k: int = SEED, gap: float = GAP_COST) -> list[tuple[float, list[int]]]:
    """Collinear chains of matches (place here, place there), as (score, indices in order); each match is in one chain.

    A match scores its characters, a link costs ``gap`` for every character it
    skips on either side; the best predecessor comes from a Fenwick tree over
    the places there. Time is n log n.
    """
    order = sorted(range(len(matches)), key=lambda i: matches[i])
    there = sorted({y for _, y in matches})
    tree, score, back = _Fenwick(len(there)), {}, {}
    waiting: deque[int] = deque()
    for i in order:
        x, y = matches[i]
        while waiting and matches[waiting[0]][0] < x:
            j = waiting.popleft()
            tree.put(bisect_left(there, matches[j][1]), (score[j] + gap * sum(matches[j]), j))
        best, j = tree.get(bisect_left(there, y))
        gain = best - gap * (x + y) if j >= 0 else 0.0
        score[i], back[i] = (k + gain, j) if gain > 0 else (float(k), -1)
        waiting.append(i)
    out, taken = [], set()
    for i in sorted(score, key=lambda i: (-score[i], matches[i])):
        line, j = [], i
        while j >= 0 and j not in taken:
            taken.add(j)
            line.append(j)
            j = back[j]
        if line:
            out.append((score[i], line[::-1]))
    return out


def _records(df: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """Texts long enough; repeated rows stay, since dropping them would shuffle every text, and count once further on."""
    return df.select(F.col(key).alias("dk"), F.col(text).alias("t")).filter(F.col(key).isNotNull() & (F.length("t") >= span))


def _frame(rows: list[list], names: tuple[str, ...]) -> pd.DataFrame:
    """Columns out of rows of arrays; the first column is each row's record, repeated."""
    keys = np.empty(len(rows), dtype=object)
    keys[:] = [r[0] for r in rows]
    out = {names[0]: np.repeat(keys, [len(r[1]) for r in rows])}
    return pd.DataFrame(out | {n: np.concatenate([r[i] for r in rows]) if rows else [] for i, n in enumerate(names[1:], 1)})


def _links(records: DataFrame, span: int, k: int) -> DataFrame:
    """Seeds that stand in more than one record: ``dk, pos, h, rep, rep_pos, same, on, ask, whole``.

    The representative is the first record that has the seed, for that one the
    last. ``same``: it has the seed's whole context, ``on``: it has the same text
    up to the next seed. ``ask``: contexts differ between records, so windows are
    compared; ``whole``: all of them, whatever a chain settles (of a first record
    that others leave out their windows for, and of all where a record has the
    seed in several places).
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for dk, t in zip(b["dk"], b["t"]):
                h, place, _, _, value, context = seeds(t, span, k)
                if len(place):
                    then = np.append(place[1:], place[-1])
                    _, back, n = np.unique(value, return_inverse=True, return_counts=True)
                    rows.append([dk, value.view(np.int64), context.view(np.int64), h.of(place, then + k).view(np.int64), place.astype(np.int32), n[back] > 1])
            yield _frame(rows, ("dk", "h", "c", "g", "pos", "again"))

    kind = records.schema["dk"].dataType.simpleString()
    s = materialise(records.mapInPandas(cut, f"dk {kind}, h long, c long, g long, pos int, again boolean"), "seeds")
    # Most seeds stand in one record; they go before anything but their hash and their record's is shuffled.
    own = F.xxhash64("dk")
    often = s.groupBy("h").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo < hi").select("h")
    s = materialise(salted_join(s, often, "h"), "shared")
    place = F.struct("dk", "pos", "c", "g")
    by_seed = s.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), (F.min("c") < F.max("c")).alias("ask"), (F.count("*") > 2).alias("many"), F.bool_or("again").alias("again")).filter("lo.dk < hi.dk")
    met = salted_join(s.drop("again"), by_seed, "h")
    is_first = F.col("dk") == F.col("lo.dk")
    rep = F.when(is_first, F.col("hi")).otherwise(F.col("lo"))
    return met.select("dk", "pos", "h", rep["dk"].alias("rep"), rep["pos"].alias("rep_pos"), (rep["c"] == F.col("c")).alias("same"), (rep["g"] == F.col("g")).alias("on"), "ask", ((is_first & F.col("many")) | F.col("again")).alias("whole"))


def stretches(line: list[int], own: list[dict], at: dict[int, int], place: np.ndarray, first: np.ndarray, last: np.ndarray, span: int, k: int) -> list[tuple[int, int, int]]:
    """Aligns a chain: (start, end, shift to the representative) of each stretch that both sides have letter for letter."""
    out: list[tuple[int, int, int]] = []
    joined = None  # place here and there that the text up to is known to be equal
    for j in line:
        x = own[j]
        i, shift = at[x["pos"]], x["rep_pos"] - x["pos"]
        a, b = (int(first[i]), int(last[i]) + span) if x["same"] else (x["pos"], x["pos"] + k)
        if out and out[-1][2] == shift and (a <= out[-1][1] or joined == (x["pos"], shift)):
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]), shift)
        else:
            out.append((a, b, shift))
        joined = (int(place[i + 1]), shift) if x["on"] and i + 1 < len(place) else None
    return [o for o in out if o[1] - o[0] >= span]


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "full_text", span: int = SPAN, k: int = SEED) -> DataFrame:
    """``key, char_start, char_end``: the longest ranges whose every place lies in a run of ``span`` characters of another record.

    Ranges that touch or overlap are one; a repetition inside one record
    doesn't count. Null, empty and shorter texts give no row, repeated rows
    count once. Writes the seeds and the compared windows as tables.
    """
    records = _records(df, key, text, span)
    kind = records.schema["dk"].dataType.simpleString()
    # A record has no more links than characters.
    own = _links(records, span, k).groupBy("dk").agg(F.collect_set(F.struct("pos", "h", "rep", "rep_pos", "same", "on", "ask", "whole")).alias("links"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for dk, t, links in zip(b["dk"], b["t"], b["links"]):
                h, place, first, last, value, _ = seeds(t, span, k)
                at = {int(p): i for i, p in enumerate(place)}
                by_rep: dict = {}
                for x in links:
                    by_rep.setdefault(x["rep"], []).append(x)
                sure: list[tuple] = []
                ask, seed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for rep, group in by_rep.items():
                    settled = np.zeros(h.n + 1, dtype=bool)
                    for _, line in chains([(x["pos"], x["rep_pos"]) for x in group], k):
                        for a, e, shift in stretches(line, group, at, place, first, last, span, k):
                            sure += [(dk, a, e), (rep, a + shift, e + shift)]
                            settled[a : e - span + 1] = True
                    # Only what this representative stands for: it takes part for it.
                    for x in group:
                        if x["ask"]:
                            i = at[x["pos"]]
                            w = np.arange(first[i], last[i] + 1)
                            w = w if x["whole"] else w[~settled[w]]
                            ask.append(w)
                            seed.append(np.full(len(w), x["h"], np.int64))
                w = np.concatenate(ask)
                rows.append([dk, h.of(w, w + span).view(np.int64), np.concatenate(seed), w.astype(np.int32), (w + span).astype(np.int32), np.zeros(len(w), bool)])
                for r, a, e in set(sure):
                    rows.append([r, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([a], np.int32), np.array([e], np.int32), np.ones(1, bool)])
            yield _frame(rows, ("dk", "wh", "h", "a", "b", "sure"))

    found = materialise(records.join(own, "dk").mapInPandas(align, f"dk {kind}, wh long, h long, a int, b int, sure boolean"), "windows")
    # A window's hash and its seed's make 128 bits; both keys of the join.
    windows = found.filter(~F.col("sure")).select(F.xxhash64("wh", "h").alias("w"), "wh", "h", "dk", "a", "b")
    twice = windows.groupBy("w", "wh", "h").agg(F.min("dk").alias("x"), F.max("dk").alias("y")).filter("x < y").select("w").distinct()
    shared = salted_join(windows.select("w", "dk", "a", "b"), twice, "w").select("dk", "a", "b")
    # Many records report the same stretch of their representative, so equal rows go before the shuffle by record.
    shared = shared.unionByName(found.filter("sure").select("dk", "a", "b")).distinct()
    order = W.partitionBy("dk").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col("a"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    merged = shared.withColumn("island", island).groupBy("dk", "island").agg(F.min("a").alias("char_start"), F.max("b").alias("char_end"))
    return merged.select(F.col("dk").alias(key), "char_start", "char_end")


def shared_share(spans: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """``key, n_chars, shared_chars, shared_share`` of every record; records that share nothing have 0, empty ones a null share."""
    own = spans.groupBy(key).agg(F.sum(F.col("char_end") - F.col("char_start")).alias("shared_chars"))
    all_ = df.select(key, F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).dropDuplicates([key])
    got = all_.join(own, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("long"))
    return got.withColumn("shared_share", F.round(F.col("shared_chars") / F.nullif(F.col("n_chars"), F.lit(0)), 6))


def shared_passages(df: DataFrame, key: str = "doc_id", text: str = "full_text", span: int = SPAN, k: int = PASSAGE_SEED) -> DataFrame:
    """Chains of common seeds of every two records: ``key, partner, char_start, char_end, seeds, score``, one row for either side.

    A passage may differ between its seeds (a fuzzy passage). It is sure to be
    found if it has a run of ``span`` equal characters, and found by chance (the
    more equal runs of ``k`` or more it has, the likelier) if it has shorter ones;
    without ``k`` equal characters in a row it isn't found. Every pair of
    different texts keeps all its common seeds, so rows grow with the number of
    such pairs. Of records with one text, the first by key stands for all: it has
    the pairs with other texts, and each copy one row with it (and it with the
    copy), never with each other. Writes the seeds as a table.
    """
    records = _records(df, key, text, span).select(F.col("dk").alias("id"), "t", F.xxhash64("t").alias("tk"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tk, t in zip(b["tk"], b["t"]):
                _, place, _, _, value, _ = seeds(t, span, k)
                rows.append((value.view(np.int64), np.full(len(place), tk, np.int64), place.astype(np.int32)))
            yield pd.DataFrame({n: np.concatenate([r[i] for r in rows]) if rows else [] for i, n in enumerate(("h", "tk", "pos"))})

    def line_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y, at in zip(b["x"], b["y"], b["at"]):
                m = [(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in at]
                for score, line in chains(m, k) if len(m) > 1 else [(float(k), [0])]:
                    (a, c), (e, g), n, score = m[line[0]], m[line[-1]], len(line), round(score, 4)
                    out += [(x, y, a, e + k, n, score), (y, x, c, g + k, n, score)]
            yield frame(out, [key, "partner", "char_start", "char_end", "seeds", "score"])

    names = materialise(records.select("tk", "id").distinct(), "names")
    first = names.groupBy("tk").agg(F.min("id").alias("x"))
    s = materialise(records.select("tk", "t").mapInPandas(cut, "h long, tk long, pos int"), "seeds")
    often = s.groupBy("h").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi")).filter("lo < hi").select("h")
    met = salted_join(salted_join(s, often, "h").distinct(), first, "tk")
    other = met.select("h", F.col("tk").alias("tk2"), F.col("x").alias("y"), F.col("pos").alias("pos2"))
    place = lambda a, c: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(c).cast("long")).alias("at")
    between = met.join(other, "h").filter("tk < tk2 and x <> y").select("x", "y", place("pos", "pos2"))
    copies = salted_join(names, first, "tk").filter("id <> x").select("tk", "x", F.col("id").alias("y"))
    own = s.join(copies.select("tk").distinct(), "tk").select("tk", place("pos", "pos")).distinct()
    same = copies.join(own, "tk").select("x", "y", "at")
    kind = df.schema[key].dataType.simpleString()
    matches = between.unionByName(same).groupBy("x", "y").agg(F.collect_list("at").alias("at"))
    return matches.mapInPandas(line_up, f"{key} {kind}, partner {kind}, char_start int, char_end int, seeds int, score double")
