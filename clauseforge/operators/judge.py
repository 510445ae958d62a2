"""Judging answers: statements, figures, verdicts and scores. Model calls are injected; the defaults need none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import split_statements
from .prompts import ABSTAIN

VERDICTS = "struct<verdicts:array<struct<id:int,supported:boolean,on_topic:boolean,reason:string>>>"
GRADES = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def answer_statements(answers: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, pos (from 1), statement, cited`` of every clause of ``answer``; repeated answers of a key count once."""
    a = answers.select(key, "answer").dropDuplicates([key]).withColumn("st", split_statements("answer"))
    return a.select(key, F.posexplode("st").alias("pos", "st")).select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("st.text").alias("statement"), F.col("st.cited").alias("cited"))


def cited_excerpts(statements: DataFrame, citations: DataFrame, key: str = "request_id") -> DataFrame:
    """Statements with the joined text of the excerpts they cite and the number of those that exist.

    ``citations``: ``key, n, text``. A number without an excerpt is invalid; a statement without citations keeps an empty text.
    """
    c = citations.select(key, F.col("n").cast("bigint").alias("n"), "text").dropDuplicates([key, "n"])
    each = statements.select(key, "pos", F.explode("cited").alias("n")).join(c, [key, "n"], "left")
    per = each.groupBy(key, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("excerpts"), F.count("text").alias("valid"))
    return statements.join(per, [key, "pos"], "left").withColumn("excerpts", F.coalesce("excerpts", F.lit(""))).withColumn("valid", F.coalesce("valid", F.lit(0)))


def lexical_support(statement: Column, excerpts: Column, least: float = 0.5) -> Column:
    """Default judge, no model: at least this share of the statement's meaning words stand in its excerpts."""
    words = T.content_words(statement)
    return (F.size(words) > 0) & (F.size(F.array_intersect(words, T.content_words(excerpts))) >= least * F.size(words))


def check_statements(cited: DataFrame, judge: Callable[[Column, Column], Column] = lexical_support) -> DataFrame:
    """Adds ``missing`` (figures the excerpts never mention) and ``supported``: the judge's yes, citations that all exist, and no missing figure."""
    s = cited.withColumn("missing", T.unsupported_numbers("statement", "excerpts"))
    sound = (F.size("cited") > 0) & (F.col("valid") == F.size("cited"))
    return s.withColumn("supported", sound & F.coalesce(judge(F.col("statement"), F.col("excerpts")), F.lit(False)) & (F.size("missing") == 0))


def faithfulness(checked: DataFrame, key: str = "request_id") -> DataFrame:
    """Share of supported statements; answers without statements have no row (the score is null). Unjudged statements are left out."""
    return checked.groupBy(key).agg(F.count("*").alias("statements"), F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def relevance(checked: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, answer_relevance``: share of an answer's judged statements that are about the question."""
    return checked.groupBy(key).agg(F.avg(F.col("on_topic").cast("double")).alias("answer_relevance"))


def citation_validity(answer: Column, valid: Column, invalid: Column, abstained: Column) -> Column:
    """Share of citation marks that point at an excerpt; without marks null for an abstention, else 0."""
    total = valid + invalid
    return F.when(total > 0, valid / total).when(abstained, F.lit(None).cast("double")).otherwise(F.lit(0.0))


def parse_verdicts(raw: Column, n: Column) -> Column:
    """Verdicts of a judge's JSON by statement, the first of an id wins; null if the JSON or any id is missing."""
    v = F.filter(F.from_json(raw, VERDICTS)["verdicts"], lambda x: x["id"].isNotNull() & x["supported"].isNotNull())
    pick = lambda i: F.element_at(F.filter(v, lambda x: x["id"] == i), 1)
    ids = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    got = F.transform(ids, lambda i: F.when(F.exists(v, lambda x: x["id"] == i), pick(i)))
    return F.when(v.isNotNull() & ~F.exists(got, lambda x: x.isNull()), got)


def grade_score(grade: Column) -> Column:
    g = F.lower(F.trim(grade))
    out = F.lit(None).cast("double")
    for name, value in GRADES.items():
        out = F.when(g == name, F.lit(value)).otherwise(out)
    return out


def parse_output(raw: Column, abstain: str = ABSTAIN) -> Column:
    """A generator's output: JSON ``{answer, abstained}``, or the raw text as the answer; an abstention without text gets the default answer."""
    j = F.from_json(raw, "answer string, abstained boolean")
    is_json = j["answer"].isNotNull() | j["abstained"].isNotNull()
    off = F.coalesce(j["abstained"], F.lit(False))
    text = F.trim(F.when(is_json, F.coalesce(j["answer"], F.lit(""))).otherwise(F.coalesce(raw, F.lit(""))))
    return F.struct(F.when(off & (text == ""), F.lit(abstain)).otherwise(text).alias("answer"), off.alias("abstained"))


def score_answers(answers: DataFrame, checked: DataFrame, grades: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """``key, declined, abstention_correct, citation_validity, faithfulness, answer_correctness``.

    ``answers``: ``key, answer, abstained, answerable, valid_citations, invalid_citations``. On an
    unanswerable question the text may decline; on an answerable one the flag
    decides. A refusal without citations isn't judged and scores 0 if the question was answerable.
    """
    declines, flag = T.declines("answer", "abstained"), F.coalesce("abstained", F.lit(False))
    text = F.trim(F.coalesce("answer", F.lit("")))
    unjudged = (text == "") | (declines & ~F.coalesce(F.col("answer"), F.lit("")).rlike(T.CITATION))
    a = answers.withColumn("declined", F.when(F.col("answerable"), flag).otherwise(declines)).withColumn("_skip", unjudged)
    a = a.join(faithfulness(checked, key).select(key, "faithfulness"), key, "left")
    a = a.join(grades.select(key, grade_score(F.col("grade")).alias("_g")), key, "left") if grades is not None else a.withColumn("_g", F.lit(None).cast("double"))
    return a.select(
        key,
        "declined",
        (F.col("declined") == ~F.col("answerable")).alias("abstention_correct"),
        citation_validity(F.col("answer"), F.col("valid_citations"), F.col("invalid_citations"), flag).alias("citation_validity"),
        F.when(~F.col("_skip"), F.col("faithfulness")).alias("faithfulness"),
        F.when(F.col("answerable"), F.when(F.col("_skip"), F.lit(0.0)).otherwise(F.col("_g"))).alias("answer_correctness"),
    )


def reuse(new: DataFrame, prior: DataFrame, key: list[str], rubric: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose result exists already, rows still to do), by key; the result of a repeated key is taken once.

    With ``rubric``, only results made under it (column ``rubric``) serve again.
    """
    known = (prior if rubric is None else prior.filter(F.col("rubric") == rubric)).dropDuplicates(key)
    return new.join(known, key), new.join(known.select(*key), key, "left_anti")


def extractive_answer(questions: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Default generator, no model: the first sentence of the best chunk with its citation; an abstention where the list is empty."""
    best = ranked.filter("rank = 1").join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", F.element_at(F.split("text", T.SENTENCE_GAP, 2), 1).alias("s"))
    out = questions.select("qid").distinct().join(best, "qid", "left")
    return out.select("qid", F.when(F.col("s").isNotNull(), F.concat("s", F.lit(" [1]"))).otherwise(F.lit(ABSTAIN)).alias("answer"), F.col("s").isNull().alias("abstained"))
