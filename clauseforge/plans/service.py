"""Asking one question of one contract, over tables that were read once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import judge, retrieval


class UnknownDocument(ValueError):
    """The question names a contract that isn't there."""


@dataclass
class QuestionService:
    """Answers questions in the scope of a contract with the raw question: search, injected generator, citations as excerpts."""

    spark: SparkSession
    documents: DataFrame
    chunks: DataFrame
    generator: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = judge.extractive_answer
    k: int = 8

    def __post_init__(self) -> None:
        self.chunks = retrieval.distinct_chunks(self.chunks, "fixed")
        self.index = retrieval.build_index(self.chunks)

    def contracts(self) -> DataFrame:
        """Contracts by title, for a list to choose from."""
        shown = self.documents.select("doc_id", "title", F.col("num_pages").alias("pages"), T.display_title(F.coalesce("source_path", "title")).alias("source"))
        return shown.orderBy(F.lower("title"), "doc_id")

    def ask(self, doc_id: str, question: str, request_id: str = "") -> dict:
        """``answer``, ``abstained``, ``citations`` (number, pages, section, excerpt), ``invalid_citations`` and times of one question."""
        if not self.documents.filter(F.col("doc_id") == doc_id).limit(1).count():
            raise UnknownDocument(doc_id)
        began = time.perf_counter()
        q = self.spark.createDataFrame([(request_id or "q", question, doc_id)], "qid string, question string, doc_id string")
        own = retrieval.Index(self.index.docs.filter(F.col("doc_id") == doc_id), self.index.terms, self.index.totals)
        ranked = retrieval.bm25(own, retrieval.query_terms(q), self.k)
        searched = time.perf_counter()
        got = self.generator(q, ranked, self.chunks).withColumn("n", T.citations("answer")).first()
        shown = ranked.join(self.chunks.filter(F.col("doc_id") == doc_id), "chunk_id").filter(F.col("rank").isin([int(x) for x in got["n"]] or [-1]))
        rows = {r["rank"]: r for r in shown.select("rank", "page_start", "page_end", T.section_label("section_path").alias("section"), T.excerpt_text("context_text", "text").alias("text")).collect()}
        cites = [{"n": n, **{k: rows[n][k] for k in ("page_start", "page_end", "section", "text")}} for n in got["n"] if n in rows]
        done = time.perf_counter()
        return {
            "request_id": request_id, "doc_id": doc_id, "answer": got["answer"], "abstained": got["abstained"], "citations": cites,
            "invalid_citations": len(got["n"]) - len(cites),
            "latency_ms": {"retrieval": 1e3 * (searched - began), "generation": 1e3 * (done - searched), "total": 1e3 * (done - began)},
        }
