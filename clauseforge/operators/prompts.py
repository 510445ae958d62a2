"""What a model is shown: numbered excerpts and messages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The answer that stands for an abstention without text, and the instructions to the answering model.
ABSTAIN = "The provided contract excerpts do not contain the answer."
SYSTEM = (
    "Answer the question about a contract from the numbered excerpts alone. End every sentence with the numbers of the excerpts that support it, like [2] or [1][3]. "
    "Keep the contract's wording for dates, amounts, periods and law. If the excerpts don't hold the answer, set \"abstained\" to true and don't guess. "
    "Say only what was asked for, in at most four sentences. Reply as JSON: {\"answer\": \"...\", \"abstained\": false}"
)
JUDGE_SYSTEM = (
    "For each numbered statement decide from its own excerpts alone whether they support all of it, and whether it is about the question. "
    "Reply as JSON: {\"verdicts\": [{\"id\": 1, \"supported\": true, \"on_topic\": true, \"reason\": \"...\"}]}"
)
GRADER_SYSTEM = (
    "Compare the answer with the reference and the highlighted clauses. Grade it correct, partial or incorrect. "
    "Reply as JSON: {\"correctness\": \"...\", \"reason\": \"...\"}"
)


def pages(start: Column | str, end: Column | str) -> Column:
    """``p.3`` or ``pp.3-5``; ``p.?`` where it isn't known."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    one = F.concat(F.lit("p."), F.coalesce(s.cast("string"), F.lit("?")))
    return F.when(s.isNull() | e.isNull() | (s == e), one).otherwise(F.concat(F.lit("pp."), s.cast("string"), F.lit("-"), e.cast("string")))


def excerpts(ranked: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, excerpts``: the chunks of each list (``by, rank, chunk_id``) in rank order, as structs; a list is bounded by its cut."""
    by = by or ["qid"]
    optional = [c if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("context_text",)]
    c = chunks.select("chunk_id", "text", *optional, "section_path", "page_start", "page_end").dropDuplicates(["chunk_id"])
    met = ranked.select(*by, "rank", "chunk_id").join(c, "chunk_id")
    one = F.struct(F.col("rank").cast("bigint").alias("rank"), "chunk_id", T.excerpt_text("context_text", "text").alias("text"), "section_path", "page_start", "page_end")
    return met.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("excerpts"))


def format_context(shown: Column | str) -> Column:
    """Excerpts as a model reads them: ``[i] (whole section path, pages)`` above each trimmed text; i is the place, from 1."""
    x = F.col(shown) if isinstance(shown, str) else shown
    where = lambda e: F.coalesce(F.nullif(F.array_join(e["section_path"], " > "), F.lit("")), F.lit("no section"))
    part = lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), where(e), F.lit(", "), pages(e["page_start"], e["page_end"]), F.lit(")\n"), F.trim(e["text"]))
    return F.array_join(F.transform(x, part), "\n\n")


def build_messages(question: Column | str, shown: Column | str) -> Column:
    """Messages to the answering model: the instructions, then excerpts and question."""
    q = F.col(question) if isinstance(question, str) else question
    user = F.concat(F.lit("Context excerpts:\n\n"), format_context(shown), F.lit("\n\nQuestion: "), q)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(SYSTEM)), message("user", user))


def label_items(questions: DataFrame, shown: DataFrame, answers: DataFrame) -> DataFrame:
    """What a person who labels sees, without any verdict: question, reference, evidence, excerpts (number, section, page, text) and answer."""
    cut = F.transform("excerpts", lambda e, i: F.struct((i + 1).alias("n"), F.array_join(F.when(F.size(e["section_path"]) > 2, F.slice(e["section_path"], -2, 2)).otherwise(e["section_path"]), " > ").alias("section"), e["page_start"].alias("page"), e["text"].alias("text")))
    q = questions.select("qid", "qtype", "question", F.col("reference_answer").alias("reference"), F.col("evidence_spans").alias("evidence")).dropDuplicates(["qid"])
    return q.join(shown.select("qid", cut.alias("excerpts")), "qid").join(answers.select("qid", "answer", "abstained", "truncated"), "qid")
