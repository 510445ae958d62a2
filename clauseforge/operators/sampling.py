"""Samples, splits and question sets, reproducible by hash order."""

from __future__ import annotations

import hashlib
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.text import hash_draw

#: Bins of draws that a split counts.
CUT_BINS = 1 << 16
# What counts as an amount, a duration or a date in a clause ("$45,420", "ninety (90) days", "two-year", "May 1, 2020"), and as a redaction.
_UNIT = r"(?:%|(?:percent|per\s*cent|days?|weeks?|months?|years?|hours?)\b)"
_NUMBER_WORD = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|sixty|ninety)"
_DATE = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\b\d{1,2}/\d{1,2}/\d{2,4}"
AMOUNT = rf"(?i)\$\s?\d|\b\d[\d,.]*[\s-]*{_UNIT}|\b{_NUMBER_WORD}\b(?:[\s-]+\w+)?[\s-]*(?:\(\d+\)[\s-]*)?{_UNIT}|{_DATE}"
REDACTED = r"\[\s*(?:\*+|●)\s*\]"


def allocate(counts: dict[str, int], size: int) -> dict[str, int]:
    """Rows of each stratum: proportional floors, at least one each where the size allows, then one at a time by the largest (smallest) remainder; ties by name."""
    total = sum(counts.values())
    size = min(size, total)
    if not total or size <= 0:
        return dict.fromkeys(counts, 0)
    quota = {k: size * n / total for k, n in counts.items()}
    out = {k: min(counts[k], max(int(q), 1 if size >= len(counts) else 0)) for k, q in quota.items()}
    while sum(out.values()) < size:
        k = min((k for k in out if out[k] < counts[k]), key=lambda k: (-(quota[k] - out[k]), k))
        out[k] += 1
    while sum(out.values()) > size:
        k = min((k for k in out if out[k] > (1 if size >= len(counts) else 0)), key=lambda k: (quota[k] - out[k], k))
        out[k] -= 1
    return out


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: str = "0") -> DataFrame:
    """``size`` rows in proportion to their strata, picked by hash order in each. Collects the strata's counts."""
    counts = {r[stratum]: r["count"] for r in df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    take = allocate(counts, size)
    if not take:
        return df.limit(0)
    quota = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])[F.col(stratum)]
    order = W.partitionBy(stratum).orderBy(hash_draw(seed, F.col(key).cast("string")), key)
    return df.filter(F.col(stratum).isNotNull()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= quota).drop("_n")


def split_documents(ids: DataFrame, dev: float = 0.3, seed: str = "0", key: str = "doc_id") -> DataFrame:
    """``key, split``: round(n · dev), half to even, documents in hash order are dev, the others test; no document is in both.

    The cut is the draw of the last dev document. It is found by counting draws
    in ``CUT_BINS`` equal bins and sorting the one bin that holds it, so
    documents are never sorted as a whole. Runs two jobs.
    """
    d = ids.select(key).distinct().withColumn("_h", F.struct(hash_draw(seed, F.col(key).cast("string")).alias("h"), F.col(key).alias("k")))
    width = 2**32 // CUT_BINS
    bins = {r["b"]: r["count"] for r in d.groupBy(F.floor(F.col("_h.h") / width).alias("b")).count().collect()}
    k = round(sum(bins.values()) * dev)
    if k == 0:
        return d.select(key, F.lit("test").alias("split"))
    before = 0
    for b in sorted(bins):
        if before + bins[b] >= k:
            break
        before += bins[b]
    cut = d.filter(F.floor(F.col("_h.h") / width) == b).orderBy("_h").limit(k - before).agg(F.max("_h").alias("c"))
    return d.crossJoin(F.broadcast(cut)).select(key, F.when(F.col("_h") <= F.col("c"), "dev").otherwise("test").alias("split"))


def numeric_candidates(spans: DataFrame) -> DataFrame:
    """(doc, category) pairs with an amount, and no redaction, in the same span: ``doc_id, category``."""
    return spans.filter(F.col("text").rlike(AMOUNT) & ~F.col("text").rlike(REDACTED)).select("doc_id", "category").distinct()


def far_apart(spans: DataFrame, least: int = 1500) -> DataFrame:
    """Pairs of categories of a document whose nearest spans are more than ``least`` characters apart, and categories with two spans so far apart.

    ``doc_id, category_a, category_b, distance``; spans are ``doc_id, category, position``. Pairs are formed inside a document only.
    """
    per = spans.groupBy("doc_id", "category").agg(F.collect_set("position").alias("p"))
    a, b = per.select("doc_id", F.col("category").alias("category_a"), F.col("p").alias("pa")), per.select("doc_id", F.col("category").alias("category_b"), F.col("p").alias("pb"))
    gap = F.array_min(F.flatten(F.transform("pa", lambda x: F.transform("pb", lambda y: F.abs(x - y)))))
    two = a.join(b, "doc_id").filter("category_a < category_b").select("doc_id", "category_a", "category_b", gap.alias("distance"))
    one = per.filter(F.size("p") >= 2).select("doc_id", F.col("category").alias("category_a"), F.col("category").alias("category_b"), (F.array_max("p") - F.array_min("p")).alias("distance"))
    return two.unionByName(one).filter(F.col("distance") > least)


def absent_categories(all_pairs: DataFrame, present: DataFrame) -> DataFrame:
    """(doc, category) pairs that have no span and whose sheet answer is empty or no."""
    empty = F.coalesce(F.lower(F.trim("answer")), F.lit("")).isin("", "no")
    return all_pairs.filter(empty).join(present.select("doc_id", "category").distinct(), ["doc_id", "category"], "left_anti").select("doc_id", "category")


def drop_contained(spans: DataFrame) -> DataFrame:
    """Spans without those that stand inside another of the same document and category."""
    o = spans.select("doc_id", "category", F.col("text").alias("_o")).distinct()
    inside = spans.select("doc_id", "category", "text").distinct().join(o, ["doc_id", "category"]).filter(F.contains("_o", "text") & (F.col("_o") != F.col("text")))
    return spans.join(inside.select("doc_id", "category", "text").distinct(), ["doc_id", "category", "text"], "left_anti")


def fill_templates(candidates: DataFrame, templates: DataFrame, names: DataFrame) -> DataFrame:
    """Questions of candidates: templates joined on their category, ``{name}`` replaced by the contract's name."""
    met = candidates.join(templates, "category").join(names, "doc_id")
    return met.withColumn("question", F.replace("template", F.lit("{name}"), F.col("name")))


def informative(answer: Column | str) -> Column:
    """Whether a sheet's answer says more than nothing, yes or no."""
    return ~F.lower(F.trim(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))).isin("", "yes", "no")


def reference_answer(categories: Column, answers: Column, spans: Column, longest: int = 800) -> Column:
    """Per category the sheet's value where it says something, else the spans joined; several as ``category: value``; cut to ``longest`` characters.

    ``answers`` and ``spans`` are maps by category.
    """
    value = lambda c: F.when(informative(answers[c]), answers[c]).otherwise(F.array_join(F.coalesce(spans[c], F.array().cast("array<string>")), " … "))
    several = F.array_join(F.transform(categories, lambda c: F.concat(c, F.lit(": "), value(c))), "; ")
    return F.substring(F.when(F.size(categories) > 1, several).otherwise(value(categories[0])), 1, longest)


def enough_letters(text: Column | str, least: int = 3) -> Column:
    """Whether a span has at least ``least`` letters and digits (redaction marks alone haven't)."""
    return F.length(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[^\p{L}\p{N}]", "")) >= least


def first_of_split(questions: DataFrame, split: str, most: int | None = None) -> DataFrame:
    """Questions of a split, of those the ``most`` first by id."""
    q = questions.filter(F.col("split") == split).dropDuplicates(["qid"])
    return q if most is None else q.orderBy("qid").limit(most)


def select_round_robin(candidates: pd.DataFrame, quota: int, seed: str = "0", per_doc: int = 2, used_docs: Counter | None = None, used_pairs: set | None = None) -> pd.DataFrame:
    """One candidate per key in turn, under a cap per document and without a repeated (document, category), until the quota is met.

    ``candidates``: ``doc_id, key, categories`` (and more). Each pick depends on
    those before it, so it runs in the driver on the candidates that could still
    be picked (``pickable``); the two ``used`` arguments carry its state over types and splits.
    """
    used_docs, used_pairs = Counter() if used_docs is None else used_docs, set() if used_pairs is None else used_pairs
    draw = lambda *p: hashlib.md5("~".join((seed, *map(str, p))).encode()).hexdigest()
    queues = {k: deque(sorted(part.to_dict("records"), key=lambda r: draw(r["doc_id"], r["key"]))) for k, part in candidates.groupby("key")}
    turn, out = deque(sorted(queues, key=draw)), []
    while turn and len(out) < quota:
        key = turn.popleft()
        while queues[key]:
            r = queues[key].popleft()
            pairs = {(r["doc_id"], c) for c in r["categories"]}
            if used_docs[r["doc_id"]] < per_doc and not pairs & used_pairs:
                used_docs[r["doc_id"]] += 1
                used_pairs |= pairs
                out.append(r)
                turn.append(key)
                break
    return pd.DataFrame(out, columns=candidates.columns)


def distractors(blocks: DataFrame, evidence: DataFrame, questions: DataFrame, k: int = 3, unanswerable: int = 2, seed: str = "0", least: int = 80) -> DataFrame:
    """``qid, block_id`` of blocks that aren't evidence, headings or short, ``k`` per question in hash order (more for unanswerable ones)."""
    pool = blocks.filter((F.col("block_type") != "heading") & (F.length("text") >= least)).select("doc_id", "block_id").distinct()
    q = questions.filter("doc_id is not null").select("qid", "doc_id", "answerable").dropDuplicates(["qid"])
    met = q.join(pool, "doc_id").join(evidence.select("qid", "block_id").distinct(), ["qid", "block_id"], "left_anti")
    order = W.partitionBy("qid").orderBy(hash_draw(seed, F.col("qid"), F.col("block_id")), "block_id")
    want = F.when(F.col("answerable"), F.lit(k)).otherwise(F.lit(k + unanswerable))
    return met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= want).select("qid", "block_id", F.col("n").cast("bigint").alias("n"))


def evidence_blocks(blocks: DataFrame, placed: DataFrame, most: int | None = 6) -> DataFrame:
    """``qid, block_id, n``: blocks that a placed span touches, in reading order, the ``most`` first of each question."""
    b = blocks.select("doc_id", "block_id", F.col("char_start").alias("s"), F.col("char_end").alias("e")).dropDuplicates(["block_id"])
    met = placed.join(b, "doc_id").filter("s < char_end and e > char_start").select("qid", "block_id", "s", "e").distinct()
    ranked = met.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("s", "e", "block_id")).cast("bigint"))
    return (ranked if most is None else ranked.filter(F.col("n") <= most)).select("qid", "block_id", "n")


def oracle_context(blocks: DataFrame, placed: DataFrame, questions: DataFrame, k: int = 3, seed: str = "0", most_chars: int = 2500) -> DataFrame:
    """The context a perfect search would give: each question's evidence blocks and distractors of its contract, in hash order.

    ``qid, rank, chunk_id, doc_id, text, section_path, page_start, page_end, char_start, char_end``; texts are cut to ``most_chars``.
    """
    evidence = evidence_blocks(blocks, placed)
    picked = evidence.select("qid", "block_id").unionByName(distractors(blocks, evidence, questions, k, seed=seed).select("qid", "block_id"))
    b = blocks.dropDuplicates(["block_id"]).select("doc_id", "block_id", F.substring("text", 1, most_chars).alias("text"), "section_path", "page", "char_start")
    met = picked.join(b, "block_id")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(hash_draw(seed, F.lit("order"), F.col("qid"), F.col("block_id")), "block_id"))
    met = met.withColumn("rank", rank.cast("bigint"))
    name = F.concat_ws("::", F.col("doc_id"), F.lit("oracle"), F.lpad((F.col("rank") - 1).cast("string"), 5, "0"))
    return met.select("qid", "rank", name.alias("chunk_id"), "doc_id", "text", "section_path", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))
