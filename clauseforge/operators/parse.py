"""Documents out of their pages: classification of laid-out text, section paths, offsets and isolated failures.

Layout comes from HTML pages here (``sources.files.html_blocks``) or from any
reader that gives the same columns; a document is one row until it is parsed,
so a bad one becomes a failure row and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import frame, materialise
from ..sources import files

VERSION = "1"
# Patterns of clause numbers, list marks, contents lines and defined terms, and words that stay small in a heading.
CLAUSE = re.compile(r"((?:section\s+)?\d+(?:\.\d+)*\.?|article\s+(?:[-–—]\s*)?(?:[ivxlcdm]+|\d+))\s+(.+)", re.IGNORECASE | re.DOTALL)
LIST_MARK = re.compile(r"(?:[-•▪‣◦]\s+|\([a-zivxlcdm]+\)\s+|[a-z]\)\s+)", re.IGNORECASE)
CONTENTS = re.compile(r"\.{5,}(?:\s*\d+)?\s*$")
DEFINED = re.compile(r"([“\"][^”\"]{1,80}[”\"])(\s+means\b.*)", re.IGNORECASE | re.DOTALL)
CAPITALS = re.compile(r"([A-Z][A-Z0-9 &/()-]{2,80})(\s+.*)", re.DOTALL)
SMALL = frozenset("a an and by for in of on or the to upon with".split())


@dataclass(frozen=True)
class Unit:
    """A classified text; ``level`` is that of a heading."""

    kind: str
    text: str
    level: int | None = None


def is_title(text: str) -> bool:
    """Whether every word but the small ones begins with a capital."""
    words = re.findall(r"[A-Za-z][A-Za-z'’-]*", text)
    return bool(words) and all(w[0].isupper() or w.lower() in SMALL for w in words)


def upper_share(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(map(str.isupper, letters)) / len(letters) if letters else 0.0


def heading_of(text: str) -> tuple[str, str, int] | None:
    """(heading, what follows it, level) of a numbered text; None where no number, or no section's number, stands in front.

    Articles are of level 1, other numbers of as many levels as they have parts. Whole numbers of three digits or over 60 are no sections.
    """
    m = CLAUSE.match(text)
    if not m or not_a_section(m[1]):
        return None
    label, body = m[1], m[2].strip()
    level = 1 if label.lower().startswith("article") else len(label.rstrip(".").split("."))
    short = lambda s: len(s) <= 100 and len(s.split()) <= 12
    title = lambda s: is_title(s.rstrip(".:").strip()) or s.endswith(":")
    if short(body) and (title(body) or upper_share(body) >= 0.8):
        return text, "", level
    head, *rest = re.split(r"(?<=[.;:])\s+", body, maxsplit=1)
    if rest and short(head) and (title(head) or head.rstrip(".:").isupper()):
        return f"{label} {head}", rest[0], level
    for pattern in (DEFINED, CAPITALS):
        if found := pattern.match(body):
            return f"{label} {found[1].strip()}", found[2].strip(), level
    return label, body, level


def not_a_section(label: str) -> bool:
    digits = re.sub(r"(?i)^section\s+", "", label).rstrip(".")
    return digits.isdigit() and (len(digits) > 2 or int(digits) > 60)


def looks_like_heading(text: str, bold: float, size: float, body: float) -> bool:
    """Whether a text stands out: bold, larger than the body, or short and in capitals, and isn't a sentence."""
    words = len(text.split())
    if len(text) > 180 or words > 24 or text.endswith(("?", "!")) or (text.endswith(".") and words > 12):
        return False
    return bold >= 0.45 or size >= 1.15 * body or (words <= 16 and upper_share(text) >= 0.85)


def classify(text: str, table: bool = False, bold: float = 0.0, size: float = 0.0, body: float = 10.0, tag: tuple[str, int | None] | None = None) -> list[Unit]:
    """Units of one laid-out text. ``tag``: what its markup says it is, where markup does; a heading's text gives its level if it is numbered."""
    if table:
        return [Unit("table", text)]
    if CONTENTS.search(text):
        return [Unit("other", text)]
    if tag and tag[0] == "heading":
        found = heading_of(text)
        return [Unit("heading", text, found[2] if found and not found[1] else tag[1] or 1)]
    found = heading_of(text)
    if found:
        return [Unit("heading", found[0], found[2])] + ([Unit("paragraph", found[1])] if found[1] else [])
    if (m := CLAUSE.match(text)) and not_a_section(m[1]):
        return [Unit("paragraph", text)]
    if LIST_MARK.match(text):
        return [Unit("list_item", text)]
    if tag and tag[0] != "other":
        return [Unit(tag[0], text)]
    if looks_like_heading(text, bold, size, body):
        return [Unit("heading", text, 1)]
    return [Unit("paragraph", text)]


def assemble(doc_id: str, units: list[tuple[Unit, int]]) -> tuple[str, list[tuple]]:
    """(full text, block rows) of units with their pages: texts parted by an empty line, section paths as a stack cut to each heading's level."""
    texts, rows, path, at = [], [], [], 0
    for i, (u, page) in enumerate(units):
        if u.kind == "heading":
            path = [*path[: (u.level or 1) - 1], u.text]
        rows.append((f"{doc_id}::b{i:05d}", u.kind, u.text, page, list(path), at, at + len(u.text)))
        texts.append(u.text)
        at += len(u.text) + 2
    return "\n\n".join(texts), rows


def markdown_of(rows: list[list[str]]) -> str:
    """Markdown of a table's cells: pipes escaped, short rows filled up, the first row as the header; empty for no cells."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    line = lambda r: "| " + " | ".join([" ".join(c.split()).replace("|", r"\|") for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


_PARSED = "doc_id string, error string, full_text string, num_pages int, blocks array<struct<block_id:string,block_type:string,text:string,page:int,section_path:array<string>,char_start:int,char_end:int>>"


def parse_html(pages: DataFrame, least_chars: int = 20) -> DataFrame:
    """``doc_id, error, full_text, num_pages, blocks`` of documents ``doc_id, html`` (a page, or pages parted by form feeds).

    A document that can't be read, or has fewer than ``least_chars`` characters,
    keeps its row with an error and no text. Repeated documents are parsed as often as they stand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h in zip(b["d"], b["h"]):
                try:
                    sheets = (h or "").split("\f")
                    units = []
                    for n, sheet in enumerate(sheets, 1):
                        for kind, level, text, cells in files.page_blocks(sheet):
                            text = markdown_of(cells) if kind == "table" else text
                            units += [(u, n) for u in classify(text, kind == "table", tag=(kind, level)) if u.text]
                    text, rows = assemble(d, units)
                    error = None if len(text.strip()) >= least_chars else f"only {len(text.strip())} characters of text"
                except Exception as x:  # a bad document never fails the others
                    error, text, rows, sheets = f"{type(x).__name__}: {x}", "", [], []
                out.append((d, error, None if error else text, len(sheets), [] if error else [dict(zip(("block_id", "block_type", "text", "page", "section_path", "char_start", "char_end"), r)) for r in rows]))
            yield frame(out, ["doc_id", "error", "full_text", "num_pages", "blocks"])

    return pages.select(F.col("doc_id").cast("string").alias("d"), F.col("html").alias("h")).filter("d is not null").mapInPandas(run, _PARSED)


def tables_of(parsed: DataFrame, parser: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, failures ``doc_id, error``) of parsed rows."""
    good = parsed.filter("error is null").dropDuplicates(["doc_id"])
    documents = good.select("doc_id", F.col("doc_id").alias("title"), F.lit(None).cast("string").alias("source_path"), "num_pages", F.lit(None).cast("string").alias("contract_type"), "full_text", F.lit(parser).alias("parser"))
    blocks = good.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    return documents, blocks, parsed.filter("error is not null").select("doc_id", "error").distinct()


def parse_corpus(pages: DataFrame, cache: str, options: dict[str, str] | None = None, least_chars: int = 20, force: bool = False) -> DataFrame:
    """Parsed rows of all pages: those that an earlier run left under the same version and options are read, the others parsed and added.

    ``cache`` is a folder; results stand under the hash of version and options. ``force`` parses everything again.
    """
    spark = pages.sparkSession
    at = f"{cache}/{files.cache_key(VERSION, str(least_chars), *[f'{k}={v}' for k, v in sorted((options or {}).items())])}"
    there = not force and files.path_exists(spark, at)
    todo = pages if not there else pages.join(spark.read.schema(_PARSED).parquet(at).select("doc_id").distinct(), "doc_id", "left_anti")
    done = materialise(parse_html(todo, least_chars), "parsed")
    done.write.mode("append" if there else "overwrite").parquet(at)
    return spark.read.schema(_PARSED).parquet(at)
