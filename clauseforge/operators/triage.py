"""Failure triage: how far each piece of evidence got, and the first stage that lost it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from .labels import align, relevant_chunks

RETRIEVAL = ("lost_in_chunking", "retrieval_miss", "ranking_miss", "reranker_demotion", "partial_evidence")
KEY = ["config_id", "qid"]


def shown_ranges(final: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``config_id, qid, doc_id, s, e`` of the text shown for each final chunk: its context window where that stands around the chunk, else the chunk."""
    c = chunks.select("chunk_id", "doc_id", "char_start", "char_end", "context_text").dropDuplicates(["chunk_id"])
    met = final.select(*KEY, "chunk_id").join(c, "chunk_id")
    plain = met.filter("context_text is null or context_text = ''").select(*KEY, "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    win = met.filter("context_text is not null and context_text <> ''").join(documents.select("doc_id", "full_text"), "doc_id", "left")
    n = F.length("context_text")
    at = F.call_function("locate", F.col("context_text"), F.col("full_text"), F.greatest(F.lit(1), F.col("char_start") - n + 1).cast("int")) - 1
    win = win.withColumn("at", F.coalesce(at, F.lit(-1)))
    fits = (F.col("at") >= 0) & (F.col("at") <= F.col("char_start")) & (F.col("char_end") <= F.col("at") + n)
    shown = win.select(*KEY, "doc_id", F.when(fits, F.col("at")).otherwise(F.col("char_start")).alias("s"), F.when(fits, F.col("at") + n).otherwise(F.col("char_end")).alias("e"))
    return plain.unionByName(shown)


def trace_spans(lists: DataFrame, span_chunks: DataFrame, alignments: DataFrame, shown: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """``config_id, qid, span_index, covered, candidate_rank, prerank_rank, final_rank, delivered``; ranks are null where never ranked.

    ``lists``: all stages in long form. Before the reranker, only the places that the final cut has count.
    ``covers`` (``config_id, qid, span_index``) tells what is covered where settings have different chunks.
    """
    stages = lists.groupBy(*KEY).agg(F.collect_set("stage").alias("stages"), F.count(F.when(F.col("stage") == "final", 1)).alias("k"))
    has = lambda s: F.array_contains("stages", s)
    source = F.when(has("fusion"), "fusion").when(has("dense"), "dense").when(has("bm25"), "bm25").otherwise("final")
    wanted = alignments.filter("char_start is not null").select("qid", "doc_id", "span_index", "char_start", "char_end")
    base = stages.withColumn("source", F.when(has("rerank"), source).otherwise(F.lit("final"))).withColumn("first", has("bm25") | has("dense")).join(wanted, "qid")
    held = span_chunks.filter("chunk_id is not null").select("qid", "span_index", "chunk_id")
    got = lists.join(held, ["qid", "chunk_id"]).join(stages.withColumn("source", F.when(has("rerank"), source).otherwise(F.lit("final"))).withColumn("first", has("bm25") | has("dense")), KEY)
    stage, rank = F.col("stage"), F.col("rank")
    ranks = got.groupBy(*KEY, "span_index").agg(
        F.min(F.when(F.when(F.col("first"), stage.isin("bm25", "dense")).otherwise(stage == "final"), rank)).alias("candidate_rank"),
        F.min(F.when((stage == F.col("source")) & (rank <= F.col("k")), rank)).alias("prerank_rank"),
        F.min(F.when(stage == "final", rank)).alias("final_rank"),
    )
    cover = held.select("qid", "span_index").distinct() if covers is None else covers.select(*KEY, "span_index").distinct()
    on = [c for c in (*KEY, "span_index") if c in cover.columns]
    cover = cover.withColumn("covered", F.lit(True))
    seen = base.select(*KEY, "doc_id", "span_index", "char_start", "char_end").join(shown, [*KEY, "doc_id"])
    seen = seen.filter(T.covers(F.col("s"), F.col("e"), F.col("char_start"), F.col("char_end"))).select(*KEY, "span_index").distinct().withColumn("delivered", F.lit(True))
    out = base.select(*KEY, "span_index").join(ranks, [*KEY, "span_index"], "left").join(cover, on, "left").join(seen, [*KEY, "span_index"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select(*KEY, "span_index", no("covered"), "candidate_rank", "prerank_rank", "final_rank", no("delivered"))


def triage(answers: DataFrame, traces: DataFrame) -> DataFrame:
    """One row per answer with its ``category``: ``correct`` or the first stage that failed.

    ``answers``: ``config_id, qid, qtype, answerable, declined, correctness, faithfulness, reranked``.
    Recalls are null without spans.
    """
    per = traces.groupBy(*KEY).agg(
        F.count("*").alias("spans"),
        *[F.max(c.cast("int")).alias(n) for n, c in (("any_d", F.col("delivered")), ("any_c", F.col("covered")), ("any_r", F.col("candidate_rank").isNotNull()), ("any_p", F.col("prerank_rank").isNotNull()))],
        F.min(F.col("delivered").cast("int")).alias("all_d"),
        F.avg(F.col("final_rank").isNotNull().cast("double")).alias("final_recall"),
        F.avg(F.col("delivered").cast("double")).alias("delivered_recall"),
    )
    a = answers.join(per, KEY, "left").withColumn("spans", F.when(F.col("answerable"), F.coalesce("spans", F.lit(0))).otherwise(F.lit(0)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    category = (
        F.when(~F.col("answerable"), F.when(F.col("declined"), "correct").otherwise("answered_unanswerable"))
        .when(F.col("correctness") == 1.0, "correct")
        .when(F.col("spans") == 0, "lost_in_chunking")
        .when(~yes("any_d") & ~yes("any_c"), "lost_in_chunking")
        .when(~yes("any_d") & ~yes("any_r"), "retrieval_miss")
        .when(~yes("any_d") & F.col("reranked") & yes("any_p"), "reranker_demotion")
        .when(~yes("any_d"), "ranking_miss")
        .when(~yes("all_d"), "partial_evidence")
        .when(F.col("declined"), "refused_with_evidence")
        .when(F.col("faithfulness") < 1.0, "unsupported_claims")
        .otherwise("misread_evidence")
    )
    some = F.col("spans") > 0
    return a.select(*KEY, "qtype", "answerable", category.alias("category"), "correctness", "faithfulness", F.col("declined").alias("abstained"), F.when(some, F.col("final_recall")).alias("final_recall"), F.when(some, F.col("delivered_recall")).alias("delivered_recall"))


def stage_of(category: Column) -> Column:
    """Stage a failure belongs to; null for ``correct``."""
    return F.when(category.isin(*RETRIEVAL), "retrieval").when(category != "correct", "generation")


def declined_as_scored(answer: Column | str, abstained: Column | str, answerable: Column | str) -> Column:
    """Whether an answer counts as declined: on an answerable question by its flag, else by its text too."""
    flag = F.coalesce(F.col(abstained) if isinstance(abstained, str) else abstained, F.lit(False))
    return F.when(F.col(answerable) if isinstance(answerable, str) else answerable, flag).otherwise(T.declines(answer, abstained))


def triage_run(run: dict[str, DataFrame], questions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Triage of every row of an answer run (``retrieval``, ``generation``, ``scores``), chunking by chunking."""
    q = questions.select("qid", "qtype", "answerable").dropDuplicates(["qid"])
    lists, final = run["retrieval"], run["retrieval"].filter("stage = 'final'")
    placed = materialise(align(questions, documents).filter("char_start is not null"), "placed")
    # A chunk's id tells its strategy, so lists of different chunkings don't meet.
    held = materialise(relevant_chunks(placed, chunks).filter("chunk_id is not null"), "held")
    strategy = F.split("config_id", "__")[0]
    own = lists.select("config_id").distinct().select("config_id", strategy.alias("strategy"))
    reranked = lists.groupBy(*KEY).agg(F.bool_or(F.col("stage") == "rerank").alias("reranked"))
    traces = trace_spans(lists, held.drop("strategy"), placed, shown_ranges(final, chunks, documents), covered_by(own, held))
    s = run["scores"].select(*KEY, F.col("answer_correctness").alias("correctness"), "faithfulness")
    a = run["generation"].select(*KEY, "answer", "abstained").join(q, "qid").join(s, KEY).join(reranked, KEY, "left")
    a = a.withColumn("declined", declined_as_scored("answer", "abstained", "answerable")).withColumn("reranked", F.coalesce("reranked", F.lit(False)))
    return triage(a, traces)


def covered_by(configs: DataFrame, held: DataFrame) -> DataFrame:
    """``config_id, qid, span_index`` of spans that some chunk of the setting's own strategy holds."""
    return configs.join(held.select("strategy", "qid", "span_index").distinct(), "strategy").select("config_id", "qid", "span_index")


def summary(rows: DataFrame) -> DataFrame:
    """Failures by stage, category and question type, with subtotals (``level`` tells which)."""
    f = rows.filter("category <> 'correct'").withColumn("stage", stage_of(F.col("category")))
    out = None
    for level, c in (("category", "category"), ("stage", "stage"), ("qtype", "qtype")):
        part = f.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("failures")).select(F.lit(level).alias("level"), "name", "failures")
        out = part if out is None else out.unionByName(part)
    return out


def summary_by_config(rows: DataFrame) -> DataFrame:
    """``config_id, category, rows, final_recall, delivered_recall``; the row of category ``all`` has the means, nulls left out."""
    per = rows.groupBy("config_id", "category").agg(F.count("*").alias("rows")).withColumns({c: F.lit(None).cast("double") for c in ("final_recall", "delivered_recall")})
    all_ = rows.groupBy("config_id").agg(F.count("*").alias("rows"), *[F.round(F.avg(c), 4).alias(c) for c in ("final_recall", "delivered_recall")])
    return per.unionByName(all_.withColumn("category", F.lit("all")))


def without_evidence(rows: DataFrame) -> DataFrame:
    """One row: how many answers are correct although none of the evidence was delivered."""
    return rows.agg(F.count(F.when((F.col("category") == "correct") & F.col("answerable") & (F.col("delivered_recall") == 0), 1)).alias("correct_without_evidence"))


def grader_reasons(reasons: DataFrame) -> DataFrame:
    """``category, not_correct, cites_extra_detail`` of grades (``category, grade, reason``) that aren't correct: how many fault detail outside the clause."""
    bad = reasons.filter(F.col("grade").isNotNull() & (F.col("grade") != "correct"))
    return bad.groupBy("category").agg(F.count("*").alias("not_correct"), F.count(F.when(F.col("reason").rlike(T.EXTRA_DETAIL), 1)).alias("cites_extra_detail"))


def hardest(rows: DataFrame, most: float = 0.25) -> DataFrame:
    """Answerable questions whose mean correctness is at most ``most``, hardest first; an unknown mean is listed last."""
    m = rows.filter("answerable").groupBy("qid").agg(F.min("qtype").alias("qtype"), F.round(F.avg("correctness"), 4).alias("mean_correctness"), F.count("*").alias("rows"))
    return m.filter(F.coalesce("mean_correctness", F.lit(0.0)) <= most).orderBy(F.coalesce("mean_correctness", F.lit(1.0)), "qid")
