"""Evidence labels: where spans stand in their documents, and which chunks hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import NormalText, locate
from ..session import frame, hot_keys, salted_join

#: Spans of a document that travel with one copy of its text.
GROUP = 500


def spans_of(questions: DataFrame) -> DataFrame:
    """``qid, doc_id, span_index (from 0), span`` of answerable questions; repeated questions count once."""
    q = questions.filter("answerable").select("qid", "doc_id", "evidence_spans").distinct()
    return q.select("qid", "doc_id", F.posexplode("evidence_spans").alias("span_index", "span")).withColumn("span_index", F.col("span_index").cast("bigint"))


def locate_exact(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Normalised spans in normalised documents: ``qid, doc_id, span_index, found, occurrences``; JVM only.

    Missing documents and empty spans are not found. Occurrences don't overlap.
    """
    docs = documents.select("doc_id", T.normalize("full_text").alias("hay"))
    s = salted_join(spans_of(questions).withColumn("needle", T.normalize("span")), docs, "doc_id", "left")
    found = (F.col("needle") != "") & F.contains(F.col("hay"), F.col("needle"))
    n = (F.length("hay") - F.length(F.replace(F.col("hay"), F.col("needle"), F.lit("")))) / F.length("needle")
    return s.select("qid", "doc_id", "span_index", F.coalesce(found, F.lit(False)).alias("found"), F.when(found, n.cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("occurrences"))


def align(questions: DataFrame, documents: DataFrame, least: float = 85.0) -> DataFrame:
    """``qid, doc_id, span_index, char_start, char_end, score, method, occurrences``; nulls where a span can't be placed.

    The normalised search decides first, then the fuzzy one. Spans travel in
    groups of about ``GROUP`` of one document, so a text is sent and normalised
    once a group, however many spans ask for it. Spans without a document are not placed.
    """
    s = spans_of(questions)
    counts = s.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    hot = hot_keys(s, "doc_id")
    groups = salted_join(s.filter("doc_id is not null"), counts, "doc_id", hot=hot)
    part = F.pmod(F.xxhash64("qid", "span_index"), F.ceil(F.col("n") / GROUP))
    groups = groups.groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("qid", "span_index", "span")).alias("spans"))
    met = salted_join(groups, documents.select("doc_id", "full_text"), "doc_id", "left", hot=hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, spans, t in b[["doc_id", "spans", "full_text"]].itertuples(index=False):
                known = NormalText(t) if t else None
                rows += [(x["qid"], d, x["span_index"], *(locate(x["span"], t, least, known) or (None,) * 5)) for x in spans]
            yield frame(rows, ["qid", "doc_id", "span_index", "char_start", "char_end", "score", "method", "occurrences"])

    placed = met.mapInPandas(run, "qid string, doc_id string, span_index long, char_start long, char_end long, score double, method string, occurrences long")
    lost = s.filter("doc_id is null").select("qid", "doc_id", "span_index")
    return placed.unionByName(lost, allowMissingColumns=True)


def relevant_chunks(alignments: DataFrame, chunks: DataFrame, share: float = 0.5) -> DataFrame:
    """``qid, span_index, strategy, chunk_id``: chunks that cover a placed span; a span no chunk covers keeps a row with a null chunk for each strategy.

    Joined on the document, the ranges compared inside it.
    """
    placed = alignments.filter("char_start is not null").select("qid", "doc_id", "span_index", "char_start", "char_end")
    c = chunks.select("chunk_id", "doc_id", "strategy", F.col("char_start").alias("c_start"), F.col("char_end").alias("c_end")).dropDuplicates(["chunk_id"])
    met = placed.join(c, "doc_id").filter(T.covers(F.col("c_start"), F.col("c_end"), F.col("char_start"), F.col("char_end"), share))
    held = met.select("qid", "span_index", "strategy", "chunk_id")
    # One row, whose size is that of the set of strategies.
    known = chunks.agg(F.collect_set("strategy").alias("known"))
    wanted = placed.select("qid", "span_index").join(F.broadcast(known)).select("qid", "span_index", F.explode("known").alias("strategy"))
    return wanted.join(held, ["qid", "span_index", "strategy"], "left")


def alignment_report(questions: DataFrame, alignments: DataFrame, span_chunks: DataFrame) -> DataFrame:
    """One row per strategy: questions, spans by method, ambiguous, unaligned and uncovered spans, aligned rate (0 without spans)."""
    a = alignments.agg(
        F.count(F.when(F.col("method") == "exact", 1)).alias("exact_spans"),
        F.count(F.when(F.col("method") == "fuzzy", 1)).alias("fuzzy_spans"),
        F.count(F.when(F.col("occurrences") > 1, 1)).alias("ambiguous_spans"),
        F.count(F.when(F.col("char_start").isNull(), 1)).alias("unaligned_spans"),
    )
    n = questions.agg(F.countDistinct("qid").alias("questions"))
    per = span_chunks.groupBy("strategy", "qid", "span_index").agg(F.count("chunk_id").alias("held")).groupBy("strategy").agg(F.count(F.when(F.col("held") == 0, 1)).alias("uncovered_spans"))
    total = F.col("exact_spans") + F.col("fuzzy_spans") + F.col("unaligned_spans")
    rate = F.when(total > 0, (total - F.col("unaligned_spans")) / total).otherwise(F.lit(0.0))
    return per.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(n)).withColumn("aligned_rate", F.round(rate, 6))
