"""Chunkers: fixed token windows, sentence windows and sections, with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.udfs import sentence_spans
from ..session import frame

STRATEGIES = ("fixed", "sentence_window", "section")
#: As the token counter counts: parts between plain white space.
_TOKEN = re.compile(r"\S+", re.ASCII)
_WINDOWS = "doc_id string, chunk_index long, char_start long, char_end long, token_count long"


def token_places(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the parts between white space."""
    return [m.span() for m in _TOKEN.finditer(text or "")]


def window_starts(n: int, max_tokens: int, overlap: int = 0) -> range:
    """First tokens of the windows over ``n`` tokens: one window, or 1 + ceil((n - max) / (max - overlap)); none for no tokens."""
    step = max_tokens - overlap
    return range(0, max(1, n - overlap), step) if n else range(0)


def fixed_windows(documents: DataFrame, max_tokens: int = 512, overlap: int = 64, text: str = "full_text") -> DataFrame:
    """Windows of ``max_tokens`` tokens that share ``overlap`` with the one before: ``doc_id, chunk_index, char_start, char_end, token_count``.

    A document's windows depend on nothing but its text, so nothing is
    shuffled. Null and blank texts have none.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be smaller than max_tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["d"], b["t"]):
                at = token_places(t)
                for i, a in enumerate(window_starts(len(at), max_tokens, overlap)):
                    e = min(a + max_tokens, len(at))
                    out.append((d, i, at[a][0], at[e - 1][1], e - a))
            yield frame(out, ["doc_id", "chunk_index", "char_start", "char_end", "token_count"])

    return documents.select(F.col("doc_id").alias("d"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, _WINDOWS)


def sentence_units(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_id, block_type, s, e, tokens``: sentences of paragraphs and list items, other blocks whole."""
    rows = blocks.select("doc_id", "block_id", "block_type", "text", "char_start", "char_end").dropDuplicates(["block_id"])
    whole = rows.filter(~F.col("block_type").isin("paragraph", "list_item")).select("doc_id", "block_id", "block_type", F.col("char_start").cast("bigint").alias("s"), F.col("char_end").cast("bigint").alias("e"), T.token_count("text").alias("tokens"))

    def cut(batches):
        for b in batches:
            out = [
                (d, k, t, c + x, c + y, len(token_places(s[x:y])))
                for d, k, t, s, c in b[["doc_id", "block_id", "block_type", "text", "char_start"]].itertuples(index=False)
                for x, y in sentence_spans(s or "")
            ]
            yield frame(out, ["doc_id", "block_id", "block_type", "s", "e", "tokens"])

    sents = rows.filter(F.col("block_type").isin("paragraph", "list_item")).mapInPandas(cut, "doc_id string, block_id string, block_type string, s long, e long, tokens long")
    return whole.unionByName(sents)


def attach_prefixes(units: DataFrame, min_tokens: int = 5) -> DataFrame:
    """Headings and sentences under ``min_tokens`` join the next full unit, trailing ones the last: ``doc_id, unit (from 0), s, e, block_id``.

    Tables and other blocks are full units however short they are. ``block_id``
    is that of the full unit. A unit's group is the number of full units at or after it.
    """
    full = (F.col("block_type") != "heading") & (F.col("block_type").isin("table", "other") | (F.col("tokens") >= min_tokens))
    after = W.partitionBy("doc_id").orderBy("s", "e", "block_id").rowsBetween(0, W.unboundedFollowing)
    g = units.withColumn("full", full).withColumn("g", F.sum(full.cast("bigint")).over(after))
    # Group 0 holds what trails the last full unit; it joins that unit's group, 1, where there is one.
    any_full = F.max("g").over(W.partitionBy("doc_id"))
    g = g.withColumn("g", F.when((F.col("g") == 0) & (any_full > 0), F.lit(1)).otherwise(F.col("g")))
    merged = g.groupBy("doc_id", "g").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.coalesce(F.max_by("block_id", F.when(F.col("full"), F.col("s"))), F.max_by("block_id", "s")).alias("block_id")
    )
    order = W.partitionBy("doc_id").orderBy("s")
    return merged.withColumn("unit", (F.row_number().over(order) - 1).cast("bigint")).select("doc_id", "unit", "s", "e", "block_id")


def neighbourhoods(units: DataFrame, window: int = 3) -> DataFrame:
    """Each unit with the range from ``window`` units before it to ``window`` after it, clamped to the document."""
    w = W.partitionBy("doc_id").orderBy("unit").rowsBetween(-window, window)
    return units.withColumn("context_start", F.min("s").over(w)).withColumn("context_end", F.max("e").over(w))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with their section number: a heading after something that isn't a heading opens a section."""
    order = W.partitionBy("doc_id").orderBy("char_start", "char_end", "block_id")
    opens = (F.col("block_type") == "heading") & (F.coalesce(F.lag("block_type").over(order), F.lit("heading")) != "heading")
    return blocks.withColumn("section", F.sum(opens.cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def pack_section(blocks: list[tuple[str, int, int]], max_tokens: int) -> list[tuple[int, int]]:
    """Token ranges of the chunks of one section's blocks, given as (type, first token, token after the last) in order.

    A chunk takes blocks while it has room. What doesn't fit in one piece, a
    block of more than ``max_tokens`` or a heading with the block under it, is
    cut into windows that don't overlap, together with what waits before it; so
    no chunk is larger than ``max_tokens``, and a heading is alone only where nothing follows.
    """
    out: list[tuple[int, int]] = []
    waiting: list[tuple[str, int, int]] = []
    for kind, a, b in blocks:
        begin = waiting[0][1] if waiting else a
        too_large, only_headings = b - a > max_tokens, all(k == "heading" for k, _, _ in waiting)
        if b - begin <= max_tokens:
            waiting.append((kind, a, b))
        elif too_large or only_headings:
            out += [(x, min(x + max_tokens, b)) for x in range(begin, b, max_tokens)]
            waiting = []
        else:
            out.append((begin, waiting[-1][2]))
            waiting = [(kind, a, b)]
    return out + ([(waiting[0][1], waiting[-1][2])] if waiting else [])


def section_chunks(blocks: DataFrame, documents: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Section chunks of each document: ``doc_id, chunk_index, char_start, char_end, token_count``; a chunk never crosses into another section.

    Packing follows the order of blocks, so each document is one row of its
    blocks (bounded by its length). Blocks without tokens and of unknown documents give nothing.
    """
    rows = sections(blocks.dropDuplicates(["block_id"])).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "block_id", "section", "block_type", "text"))).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, own in zip(b["doc_id"], b["blocks"]):
                places: list[tuple[int, int]] = []
                of_section: dict[int, list[tuple[str, int, int]]] = {}
                for x in own:
                    first = len(places)
                    places += [(x["char_start"] + s, x["char_start"] + e) for s, e in token_places(x["text"])]
                    if len(places) > first:
                        of_section.setdefault(x["section"], []).append((x["block_type"], first, len(places)))
                cut = [c for k in sorted(of_section) for c in pack_section(of_section[k], max_tokens)]
                out += [(d, i, places[s][0], places[e - 1][1], e - s) for i, (s, e) in enumerate(cut)]
            yield frame(out, ["doc_id", "chunk_index", "char_start", "char_end", "token_count"])

    return each.mapInPandas(run, _WINDOWS)


def sentence_windows(blocks: DataFrame, documents: DataFrame, window: int = 3, min_tokens: int = 5) -> DataFrame:
    """Sentence chunks with the range of their context: ``doc_id, chunk_index, char_start, char_end, context_start, context_end, block_id``."""
    known = blocks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    n = neighbourhoods(attach_prefixes(sentence_units(known), min_tokens), window)
    return n.select("doc_id", F.col("unit").alias("chunk_index"), F.col("s").alias("char_start"), F.col("e").alias("char_end"), "context_start", "context_end", "block_id")


def make_chunks(ranges: DataFrame, strategy: str, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk rows of the ranges of one strategy: id, text, context, section path, pages, offsets, tokens and whether a table is in it.

    A range that covers no block has no row. A sentence's section path is its block's.
    """
    r = roll_up(ranges.select("doc_id", "chunk_index", "char_start", "char_end"), blocks)
    own = ["doc_id", "chunk_index"]
    if "context_start" in ranges.columns:
        path = blocks.dropDuplicates(["block_id"]).select("block_id", F.col("section_path").alias("_path"))
        r = r.join(ranges.select(*own, "context_start", "context_end", "block_id"), own).join(path, "block_id").withColumn("section_path", F.col("_path"))
    else:
        r = r.withColumns({"context_start": F.lit(None).cast("bigint"), "context_end": F.lit(None).cast("bigint")})
    met = r.join(documents.select("doc_id", "full_text").dropDuplicates(["doc_id"]), "doc_id")
    part = lambda a, b: F.substring(F.col("full_text"), F.col(a) + 1, F.col(b) - F.col(a))
    met = met.withColumn("text", part("char_start", "char_end"))
    return met.select(
        chunk_id(F.col("doc_id"), strategy, F.col("chunk_index")).alias("chunk_id"), "doc_id", F.lit(strategy).alias("strategy"), "text",
        F.when(F.col("context_start").isNotNull(), part("context_start", "context_end")).alias("context_text"), "section_path", "page_start", "page_end",
        F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), T.token_count("text").cast("int").alias("token_count"), "has_table",
    )


def run_chunking(documents: DataFrame, blocks: DataFrame, strategies: Sequence[str] = STRATEGIES, max_tokens: int = 512, overlap: int = 64, window: int = 3, min_tokens: int = 5) -> DataFrame:
    """Chunks of every strategy named, each once. Blocks that don't stand in their document are an error of the caller (``validate_blocks``)."""
    docs = documents.dropDuplicates(["doc_id"])
    makers = {
        "fixed": lambda: fixed_windows(docs, max_tokens, overlap),
        "sentence_window": lambda: sentence_windows(blocks, docs, window, min_tokens),
        "section": lambda: section_chunks(blocks, docs, max_tokens),
    }
    if unknown := [s for s in strategies if s not in makers]:
        raise ValueError(f"unknown strategies {unknown}")
    out = None
    for s in dict.fromkeys(strategies):
        part = make_chunks(makers[s](), s, blocks, docs)
        out = part if out is None else out.unionByName(part)
    return out


def chunk_id(doc: Column, strategy: str, index: Column) -> Column:
    return F.concat_ws("::", doc, F.lit(strategy), F.when(index < 100_000, F.lpad(index.cast("string"), 5, "0")).otherwise(index.cast("string")))


def roll_up(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages, tables and the common section path of the blocks each range (``doc_id, chunk_index, char_start, char_end``) overlaps.

    The longest common prefix of paths is that of the smallest and the greatest path.
    """
    b = blocks.dropDuplicates(["block_id"]).select("doc_id", "page", "block_type", "section_path", F.col("char_start").alias("bs"), F.col("char_end").alias("be"))
    met = ranges.join(b, "doc_id").filter((F.col("bs") < F.col("char_end")) & (F.col("be") > F.col("char_start")))
    per = met.groupBy("doc_id", "chunk_index", "char_start", "char_end").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.bool_or(F.col("block_type") == "table").alias("has_table"), F.min("section_path").alias("lo"), F.max("section_path").alias("hi")
    )
    n = F.least(F.size("lo"), F.size("hi"))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.element_at("lo", i) == F.element_at("hi", i)), i).otherwise(k))
    return per.withColumn("section_path", F.when(n > 0, F.slice("lo", 1, same)).otherwise(F.array().cast("array<string>"))).drop("lo", "hi")


def with_blocks(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, blocks``: each document with its blocks in reading order (none: an empty list), as bounded as the document."""
    b = blocks.dropDuplicates(["block_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "block_id", "block_type", "text"))).alias("blocks"))
    none = F.from_json(F.lit("[]"), b.schema["blocks"].dataType.simpleString())
    return documents.select("doc_id").distinct().join(b, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", none))


def validate_blocks(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks whose text isn't the document's text at their offsets, or whose document is missing (none: the input is sound)."""
    b = blocks.join(documents.select("doc_id", "full_text"), "doc_id", "left")
    there = F.substring(F.col("full_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return b.filter(F.col("full_text").isNull() | (there != F.col("text"))).select("doc_id", "block_id")
