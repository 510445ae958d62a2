"""Sources and sinks: typed JSON lines, CSV, nested JSON, HTML pages, checksums, caches and run folders."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import frame



#: Records exchanged as JSON lines; reading with one of them refuses malformed lines.
SCHEMAS = {
    "document": "doc_id string, title string, source_path string, num_pages int, contract_type string, full_text string, parser string",
    "block": "doc_id string, block_id string, block_type string, text string, page int, section_path array<string>, char_start int, char_end int",
    "chunk": "chunk_id string, doc_id string, strategy string, text string, context_text string, section_path array<string>, page_start int, page_end int, char_start int, char_end int, token_count int, has_table boolean",
    "question": "qid string, question string, doc_id string, qtype string, category string, reference_answer string, evidence_spans array<string>, answerable boolean, split string, source string, notes string, contract_name string",
    "ranked": "config_id string, qid string, stage string, chunk_id string, score double, rank int",
    "generation": "qid string, config_id string, model string, answer string, cited_chunk_ids array<string>, abstained boolean, prompt_tokens int, completion_tokens int, cost_usd double, latency_ms double, invalid_citations int, raw_output string, truncated boolean",
    "scores": "qid string, config_id string, recall_at map<int,double>, mrr double, ndcg_at_10 double, context_precision double, context_recall double, faithfulness double, citation_validity double, answer_relevance double, answer_correctness double, abstention_correct boolean, judge_model string, judge_rationale string",
    "manifest": "doc_id string, title string, contract_type string, part string, pdf_path string, txt_path string, pdf_sha256 string, pdf_size_bytes bigint",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, record: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines of a declared record; a malformed line fails the read. With ``missing_ok`` an absent path is an empty table."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[record])
    return spark.read.schema(SCHEMAS[record]).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    """JSON lines, replaced as a whole by the job's commit (or appended)."""
    w = df.write.mode(mode)
    (w.option("compression", "gzip") if gzip else w).json(path)


def write_rankings(lists: DataFrame, path: str, most: int = 20) -> None:
    """Ranked lists as gzip JSON lines, cut at ``most`` places; the final list stays whole."""
    write_jsonl(lists.filter((F.col("rank") <= most) | (F.col("stage") == "final")), path, gzip=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as strings; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def read_squad(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested question sets (data → paragraphs → qas → answers): ``title, context, qa_id, question, answer, answer_start``; questions without answers keep a row. ``lines``: an article a line."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:bigint>>>>>>>>"
    d = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode("data").alias("d"))
    p = d.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    a = p.select("title", "context", F.col("q.id").alias("qa_id"), F.col("q.question").alias("question"), F.explode_outer("q.answers").alias("a"))
    return a.select("title", "context", "qa_id", "question", F.col("a.text").alias("answer"), F.col("a.answer_start").alias("answer_start"))


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, md5, sha256`` of files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


class _Blocks(HTMLParser):
    """Blocks of a page: headings, paragraphs, list items and tables; scripts, styles and navigation are left out."""

    KINDS = {"p": "paragraph", "li": "list_item", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading"}
    SKIP = {"script", "style", "nav", "head", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str, list[list[str]]]] = []
        self.skip, self.kind, self.level, self.text = 0, None, None, []
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            self.text = []
        elif tag in self.KINDS:
            self.flush()
            self.kind, self.level = self.KINDS[tag], int(tag[1]) if tag[0] == "h" else None

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            if any(self.rows):
                self.out.append(("table", None, "", self.rows))
            self.rows, self.text = None, []
        elif self.rows is not None and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag in self.KINDS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.rows is None:
            self.out.append((self.kind or "other", self.level, text, []))
        self.kind, self.level, self.text = None, None, []


def page_blocks(html: str | None) -> list[tuple[str, int | None, str, list[list[str]]]]:
    """(kind, heading level, text, cells of a table) of the blocks of a page in reading order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, block_type, level, text, rows`` of HTML pages in reading order; null and broken pages give what can be read."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b["k"], b["h"]):
                out += [(k, i, *x) for i, x in enumerate(page_blocks(h))]
            yield frame(out, ["k", "pos", "block_type", "level", "text", "rows"])

    src = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return src.mapInPandas(run, f"k {kind}, pos long, block_type string, level int, text string, rows array<array<string>>").withColumnRenamed("k", key)


def cache_key(*parts: str) -> str:
    """First 12 hex digits of the hash of a parser's version and options: its results are kept under it."""
    import hashlib

    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:12]


def embedding_key(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def write_index(index, path: str) -> None:
    """A search index as three tables; chunks are clustered by document, so that a scope reads few files."""
    index.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "chunk_id").write.mode("overwrite").parquet(f"{path}/docs")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str):
    from ..operators.retrieval import Index

    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("docs", "terms", "totals")])


def collection(strategy: str, model: str) -> str:
    """Name of the vectors of a chunking by a model."""
    return f"{strategy}__{model}"


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors by model, sorted by document, so that a model or a document is read alone."""
    vectors.sortWithinPartitions(*[c for c in ("doc_id", "key") if c in vectors.columns]).write.mode(mode).partitionBy("model").parquet(path)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Markdown of a small result that has been collected for a report."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)).replace("|", "\\|") for c in columns) + " |" for r in rows])


def append_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("phase", "config_id")) -> None:
    """Rows added to a run's folder, parted by phase and setting, so that a run taken up again reads and adds single parts."""
    df.write.mode("append").partitionBy(*by).json(path)


def log_requests(rows: DataFrame, path: str) -> None:
    """Adds rows to the request log, one JSON line each (``streaming.events.request_log`` reads it as a stream)."""
    rows.select("ts", "request_id", "doc_id", "status", "latency_ms").write.mode("append").json(path)
