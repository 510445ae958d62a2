"""Documents from their parts: blocks and offsets, page margins, section paths, inventories and caches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.udfs import encoder

# A text that is nothing but a page number.
PAGE_NUMBER = r"(?i)^(?:page\s*)?[-–—]?\s*\d+\s*[-–—]?$"


def text_blocks(documents: DataFrame, text: str = "full_text", separator: str = "\n\n") -> DataFrame:
    """Blocks of a text between separators, with running offsets: ``doc_id, pos, text, char_start, char_end``; empty texts have none."""
    rows = documents.filter(F.col(text) != "").select("doc_id", F.posexplode(F.split(text, separator)).alias("pos", "text"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(separator)).over(before), F.lit(0))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text", start.alias("char_start"), (start + F.length("text")).alias("char_end")).filter("text <> ''")


def in_margin(blocks: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Blocks with ``margin``: whether they stand in the top or bottom ``ratio`` of the page.

    By ``y0``, ``y1`` and ``page_height`` where the layout is known; else the
    first and the last block of a page are its margins.
    """
    if {"y0", "y1", "page_height"} <= set(blocks.columns):
        return blocks.withColumn("margin", (F.col("y0") <= F.col("page_height") * ratio) | (F.col("y1") >= F.col("page_height") * (1 - ratio)))
    page, order = W.partitionBy("doc_id", "page"), ["char_start", "char_end", "block_id"]
    first, last = F.row_number().over(page.orderBy(*order)), F.row_number().over(page.orderBy(*[F.desc(c) for c in order]))
    return blocks.withColumn("margin", (first == 1) | (last == 1))


def repeated_margins(blocks: DataFrame, least_pages: int = 2, share: float = 0.5, longest: int = 200) -> DataFrame:
    """``doc_id, key, pages`` of short texts that stand, but for figures, in the margin of at least ``share`` of a document's pages."""
    b = in_margin(blocks).filter(F.col("margin") & (F.length("text") <= longest)).select("doc_id", "page", T.repetition_key("text").alias("key")).distinct()
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("all_pages"))
    n = b.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"))
    need = F.greatest(F.lit(least_pages), F.ceil(F.col("all_pages") * F.lit(share)))
    return n.join(pages, "doc_id").filter(F.col("pages") >= need).select("doc_id", "key", "pages")


def drop_margins(blocks: DataFrame, margins: DataFrame) -> DataFrame:
    """Blocks without repeated margins, wherever their text stands again, and bare page numbers."""
    b = blocks.filter(~F.col("text").rlike(PAGE_NUMBER)).withColumn("_key", T.repetition_key("text"))
    return b.join(margins.select("doc_id", F.col("key").alias("_key")), ["doc_id", "_key"], "left_anti").drop("_key")


def body_font(layout: DataFrame, least_chars: int = 40, default: float = 10.0) -> DataFrame:
    """``doc_id, body_size``: median of the font sizes, rounded to a tenth, of texts of some length outside tables; the default where there is none."""
    text = layout.filter(F.length("text") >= least_chars)
    text = text.filter(F.col("block_type") != "table") if "block_type" in layout.columns else text
    m = text.groupBy("doc_id").agg(F.median(F.bround(F.col("font_size").cast("double"), 1)).alias("m"))
    return layout.select("doc_id").distinct().join(m, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(default)).alias("body_size"))


def block_style(lines: DataFrame) -> DataFrame:
    """``doc_id, block_id, bold_ratio, font_size`` of text spans (``doc_id, block_id, text, bold, size``): share of bold characters, largest size."""
    n = F.sum(F.length("text"))
    bold = F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0))
    return lines.groupBy("doc_id", "block_id").agg(F.when(n > 0, bold / n).otherwise(F.lit(0.0)).alias("bold_ratio"), F.max("size").alias("font_size"))


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Text blocks of which less than ``share`` of the area (at least 1) lies in a table of the page; boxes are ``x0, y0, x1, y1``."""
    t = tables.select("doc_id", "page", *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")])
    w = F.greatest(F.lit(0), F.least("x1", "tx1") - F.greatest("x0", "tx0"))
    h = F.greatest(F.lit(0), F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    inside = blocks.join(t, ["doc_id", "page"]).filter(w * h >= share * area).select("doc_id", "block_id").distinct()
    return blocks.join(inside, ["doc_id", "block_id"], "left_anti")


def section_paths(headings: DataFrame) -> DataFrame:
    """``doc_id, pos, section_path``: the stack of headings at each block; a heading of level n cuts the stack to n - 1 first. Level null: no heading.

    The stack is folded in order inside a document.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[str] = []
        paths = []
        pdf = pdf.sort_values("pos")
        for level, text in pdf[["level", "text"]].itertuples(index=False):
            if level is not None and level == level:
                stack = [*stack[: int(level) - 1], text]
            paths.append(list(stack))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "section_path": paths})

    return headings.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("double").alias("level"), "text").groupBy("doc_id").applyInPandas(run, "doc_id string, pos long, section_path array<string>")


def parse_report(blocks: DataFrame) -> DataFrame:
    """Blocks by type with the documents and pages they stand on."""
    return blocks.groupBy("block_type").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "page").alias("pages"))


def failure_report(documents: DataFrame, least_chars: int = 20) -> DataFrame:
    """One row: documents, those that failed, and the failure rate (0 for no documents)."""
    good, bad = split_failures(documents, least_chars)
    n = good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("failures")))
    total = F.col("good") + F.col("failures")
    return n.select(total.alias("documents"), "failures", F.when(total > 0, F.col("failures") / total).otherwise(F.lit(0.0)).alias("failure_rate"))


def split_failures(documents: DataFrame, least_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents with text, failures ``doc_id, error``): a bad document never fails the job."""
    text = F.length(F.trim(F.coalesce("full_text", F.lit(""))))
    bad = documents.filter(text < least_chars).select("doc_id", F.when(text == 0, "no text").otherwise("too little text").alias("error"))
    return documents.filter(text >= least_chars), bad


def _prefixes(keys: DataFrame, lengths: list[int]) -> DataFrame:
    """Every prefix of ``key`` that has one of the lengths, as ``prefix``."""
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("key"))
    return keys.withColumn("prefix", F.explode(F.transform(cut, lambda n: F.substring(F.col("key"), F.lit(1), n))))


def reconcile(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Inventory ``key, doc_id`` against files ``key, path``: equal keys, else the one file whose key begins with the other's or the reverse.

    ``doc_id, path, how``; ``how`` is ``missing`` without a match and ``ambiguous`` with several. Keys
    of every length meet: the longer side's prefixes of the lengths the shorter side has are joined by equality.
    """
    exact = listed.join(files, "key").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    left = listed.join(exact.select("doc_id"), "doc_id", "left_anti")
    lengths = lambda d: sorted(r[0] for r in d.select(F.length("key")).distinct().collect() if r[0])  # noqa: E731 - no more than a name is long
    f = files.select("key", "path")
    longer_files = _prefixes(f, lengths(left)).select(F.col("prefix").alias("key"), "path")
    longer_names = _prefixes(left, lengths(f)).select("doc_id", F.col("prefix").alias("key"))
    met = left.join(longer_files, "key").select("doc_id", "path").unionByName(longer_names.join(f, "key").select("doc_id", "path")).distinct()
    per = left.select("doc_id").join(met, "doc_id", "left").groupBy("doc_id").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    how = lambda one: F.when(F.col("n") == 1, one).when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("how")
    out = lambda d, one: d.select("doc_id", F.when(F.col("n") == 1, F.col("path")).alias("path"), how(one))
    return out(exact, "exact").unionByName(out(per, "prefix"))


def smallest_of_each(records: DataFrame, kind: str, size: str, key: str, most: int = 3) -> DataFrame:
    """The smallest record of each kind, and of those the ``most`` smallest: a small fixture of different kinds."""
    first = F.row_number().over(W.partitionBy(kind).orderBy(size, key))
    return records.filter(F.col(kind).isNotNull()).withColumn("_r", first).filter("_r = 1").drop("_r").orderBy(size, key).limit(most)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``key, text`` of the distinct texts whose (model, sha256) isn't in the cache."""
    t = texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    return t.join(cache.filter(F.col("model") == model).select("key").distinct(), "key", "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The cache with new rows in place of those with the same key (the last write wins)."""
    return cache.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def to_do(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows still to be worked on when a run is taken up again."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def settings_to_do(wanted: DataFrame, done: DataFrame, questions: int) -> DataFrame:
    """Settings that aren't finished: a setting is done only with a row for every question."""
    full = done.groupBy("config_id").agg(F.countDistinct("qid").alias("n")).filter(F.col("n") == questions)
    return wanted.join(full.select("config_id"), "config_id", "left_anti")


def encode_missing(texts: DataFrame, cache: DataFrame, model: str, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``model, key, vector`` of the distinct texts, from the cache where it has them; only the others reach the encoder."""
    t = texts.filter("text is not null").select("text")
    keys = t.select(F.sha2("text", 256).alias("key")).distinct()
    known = cache.filter(F.col("model") == model).select("key", "vector").dropDuplicates(["key"])
    fresh = cache_misses(t, cache, model).select("key", encoder(encode)("text").alias("vector"))
    return keys.join(known, "key").unionByName(fresh).select(F.lit(model).alias("model"), "key", "vector")
