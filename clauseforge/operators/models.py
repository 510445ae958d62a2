"""Model calls over tables: answering, checking statements and grading, with injected clients.

A client is a function of a list of requests to a list of replies of the same
length, made once for each task by a factory (so that it may hold a connection
or a model). A request is ``{"messages": [...], "schema": name, "budget": n}``;
a reply is ``{"content": text}`` with, if known, ``prompt_tokens``,
``completion_tokens``, ``done_reason`` and ``latency_ms``. Requests are sent in
batches, so nothing here calls a model row by row unless its client does.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import statements
from ..session import frame
from . import judge, prompts

Client = Callable[[list[dict]], list[dict]]
Factory = Callable[[], Client]
#: Requests sent to a client at a time; output tokens of an answer, and of one that is reasoned out first.
BATCH, ANSWER_TOKENS, THINKING_TOKENS = 32, 400, 2048
#: Characters of evidence that a grader sees.
EVIDENCE_CHARS = 3000
_REPLY = "content string, prompt_tokens long, completion_tokens long, done_reason string, latency_ms double"


def call(requests: DataFrame, factory: Factory, schema: str, budget: int) -> DataFrame:
    """``key, content, prompt_tokens, completion_tokens, done_reason, latency_ms`` of requests ``key, messages``.

    A reply that has no time of its own gets its batch's share of the time taken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            out = []
            for a in range(0, len(b), BATCH):
                part = b.iloc[a : a + BATCH]
                asked = [{"messages": [{"role": m["role"], "content": m["content"]} for m in ms], "schema": schema, "budget": budget} for ms in part["messages"]]
                began = time.perf_counter()
                replies = client(asked)
                each = 1e3 * (time.perf_counter() - began) / len(asked)
                if len(replies) != len(asked):
                    raise ValueError("a client must reply to every request")
                out += [(k, r.get("content"), r.get("prompt_tokens") or 0, r.get("completion_tokens") or 0, r.get("done_reason"), float(r.get("latency_ms", each))) for k, r in zip(part["key"], replies)]
            yield frame(out, ["key", "content", "prompt_tokens", "completion_tokens", "done_reason", "latency_ms"])

    return requests.select(F.col("key").cast("string").alias("key"), "messages").mapInPandas(run, "key string, " + _REPLY)


def generate(questions: DataFrame, shown: DataFrame, factory: Factory, config_id: str, model: str, thinking: bool = False) -> DataFrame:
    """Answers to questions over their excerpts (``prompts.excerpts``): one row per question that has any, in the generation record's columns.

    Output is JSON or, failing that, plain text; marks that cite no excerpt are
    counted; ``truncated`` is the client's word that it ran out of tokens.
    """
    met = questions.select("qid", "question").dropDuplicates(["qid"]).join(shown.select("qid", "excerpts"), "qid")
    requests = met.select(F.col("qid").alias("key"), prompts.build_messages("question", "excerpts").alias("messages"))
    replies = call(requests, factory, "answer", THINKING_TOKENS if thinking else ANSWER_TOKENS)
    out = replies.select(F.col("key").alias("qid"), judge.parse_output(F.col("content"), prompts.ABSTAIN).alias("o"), "content", "prompt_tokens", "completion_tokens", "done_reason", "latency_ms")
    n = T.citations("answer")
    out = out.select("qid", "o.*", "content", "prompt_tokens", "completion_tokens", "done_reason", "latency_ms").join(shown.select("qid", "excerpts"), "qid").withColumn("n", n)
    marks = F.flatten(F.transform(F.regexp_extract_all("answer", F.lit(T.CITATION), F.lit(1)), lambda g: F.split(g, r"\s*,\s*")))
    known = lambda i: (i >= 1) & (i <= F.size("excerpts"))
    cited = F.array_distinct(F.transform(F.filter("n", known), lambda i: F.element_at("excerpts", i.cast("int"))["chunk_id"]))
    return out.select(
        "qid", F.lit(config_id).alias("config_id"), F.lit(model).alias("model"), "answer", cited.alias("cited_chunk_ids"), "abstained", F.col("prompt_tokens").cast("int").alias("prompt_tokens"),
        F.col("completion_tokens").cast("int").alias("completion_tokens"), F.lit(0.0).alias("cost_usd"), "latency_ms",
        F.size(F.filter(marks, lambda x: ~known(F.coalesce(F.try_to_number(x, F.lit("999999999999999999")).cast("bigint"), F.lit(0))))).alias("invalid_citations"),
        F.col("content").alias("raw_output"), F.coalesce(F.col("done_reason") == "length", F.lit(False)).alias("truncated"),
    )


def extractive_client() -> Client:
    """Default answering client, no model: the first sentence of the first excerpt, or an abstention where there is none."""

    def reply(requests: list[dict]) -> list[dict]:
        out = []
        for r in requests:
            body = r["messages"][-1]["content"]
            m = re.search(r"\[1\] \([^\n]*\)\n(.*?)(?:\n\n\[2\] |\n\nQuestion: )", body, re.S)
            first = re.split(T.SENTENCE_GAP, m[1], maxsplit=1)[0].strip() if m else ""
            out.append({"content": json.dumps({"answer": f"{first} [1]" if first else "", "abstained": not first}), "latency_ms": 0.0})
        return out

    return reply


def lexical_judge() -> Client:
    """Default judging client, no model: a statement is supported by excerpts that hold half of its meaning words; a grade goes by the reference's words."""
    stop = set(T.CONTENT_STOPWORDS)

    def words(text: str) -> set[str]:
        return {w for w in re.findall(r"[a-z]+", text.lower()) if len(w) > 2 and w not in stop}

    def verdicts(body: str) -> str:
        out = []
        for part in body.split("\n\n---\n\n"):
            m = re.search(r"Statement (\d+): (.*?)\nExcerpts cited by statement \d+:\n(.*)", part, re.S)
            have = words(m[2])
            out.append({"id": int(m[1]), "supported": bool(have) and len(have & words(m[3])) >= len(have) / 2, "on_topic": True, "reason": "words"})
        return json.dumps({"verdicts": out})

    def grade(body: str) -> str:
        m = re.search(r"Reference answer: (.*?)\n\n.*Answer to grade:\n(.*)", body, re.S)
        want = words(m[1])
        share = len(want & words(m[2])) / len(want) if want else 0.0
        return json.dumps({"correctness": "correct" if share >= 0.8 else "partial" if share >= 0.3 else "incorrect", "reason": "words"})

    return lambda requests: [{"content": (verdicts if r["schema"] == "verdicts" else grade)(r["messages"][-1]["content"]), "latency_ms": 0.0} for r in requests]


_STATEMENTS = "key string, messages array<struct<role:string,content:string>>, n int, cited array<array<long>>, statements array<string>, excerpts array<string>"


def check_answers(answers: DataFrame, shown: DataFrame, factory: Factory) -> DataFrame:
    """Statements of each answer (``key, question, answer``) with the judge's verdicts: ``key, pos, statement, cited, valid, excerpts, missing, judged, on_topic, supported``.

    One request an answer, in which each statement stands with the excerpts it
    cites and no others. ``shown``: ``key, excerpts``. Where the judge's output
    lacks a statement, the whole answer's verdicts are null, and so is ``supported``.
    """
    met = answers.select(F.col("key").cast("string").alias("key"), "question", "answer").join(shown.select(F.col("key").cast("string").alias("key"), "excerpts"), "key", "left")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, q, a, ex in b[["key", "question", "answer", "excerpts"]].itertuples(index=False):
                said, ex = statements(a), list(ex) if ex is not None else []
                if not said:
                    continue
                texts, parts = [], []
                for i, (text, cited) in enumerate(said, 1):
                    own = [ex[n - 1] for n in cited if 1 <= n <= len(ex)]
                    texts.append(" ".join(e["text"] or "" for e in own))
                    listed = [f"[{n}] {' > '.join(list(ex[n - 1]['section_path'] if ex[n - 1]['section_path'] is not None else [])[-2:]) or 'no section'}\n{ex[n - 1]['text']}" for n in cited if 1 <= n <= len(ex)]
                    parts.append(f"Statement {i}: {text}\nExcerpts cited by statement {i}:\n" + ("\n\n".join(listed) or "(no excerpts cited)"))
                messages = [{"role": "system", "content": prompts.JUDGE_SYSTEM}, {"role": "user", "content": f"Question: {q}\n\n" + "\n\n---\n\n".join(parts)}]
                out.append((k, messages, len(ex), [c for _, c in said], [t for t, _ in said], texts))
            yield frame(out, ["key", "messages", "n", "cited", "statements", "excerpts"])

    asked = met.mapInPandas(ask, _STATEMENTS)
    replies = call(asked, factory, "verdicts", ANSWER_TOKENS).select("key", "content")
    each = asked.drop("messages").join(replies, "key").withColumn("v", judge.parse_verdicts(F.col("content"), F.size("statements")))
    rows = each.select("key", "n", F.posexplode(F.arrays_zip("statements", "cited", "excerpts")).alias("pos", "s"), "v")
    rows = rows.select(
        "key", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("s.statements").alias("statement"), F.col("s.cited").alias("cited"),
        F.size(F.filter("s.cited", lambda i: (i >= 1) & (i <= F.col("n")))).alias("valid"), F.col("s.excerpts").alias("excerpts"), F.get("v", F.col("pos")).alias("verdict"),
    )
    rows = rows.withColumn("missing", T.unsupported_numbers("statement", "excerpts")).withColumn("judged", F.col("verdict.supported")).withColumn("on_topic", F.col("verdict.on_topic"))
    sound = (F.size("cited") > 0) & (F.col("valid") == F.size("cited")) & (F.size("missing") == 0)
    return rows.withColumn("supported", F.when(F.col("judged").isNotNull(), F.col("judged") & sound)).drop("verdict")


def grade_answers(answers: DataFrame, questions: DataFrame, factory: Factory) -> DataFrame:
    """``key, grade`` of answers (``key, qid, answer``) against the question's reference and evidence; null where the grader's word isn't one of the grades."""
    q = questions.select("qid", "question", "reference_answer", "evidence_spans").dropDuplicates(["qid"])
    clauses = F.substring(F.array_join(F.transform(F.coalesce("evidence_spans", F.array().cast("array<string>")), lambda s: F.concat(F.lit("- "), s)), "\n"), 1, EVIDENCE_CHARS)
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    user = F.concat(
        F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n\nReference answer: "), none(F.col("reference_answer")), F.lit("\n\nLawyer-highlighted clause text:\n"), none(clauses),
        F.lit("\n\nAnswer to grade:\n"), T.strip_citations(F.coalesce("answer", F.lit(""))),
    )
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = answers.select("key", "qid", "answer").join(q, "qid").select(F.col("key").cast("string").alias("key"), F.array(message("system", F.lit(prompts.GRADER_SYSTEM)), message("user", user)).alias("messages"))
    word = F.lower(F.trim(F.get_json_object("content", "$.correctness")))
    return call(asked, factory, "grade", ANSWER_TOKENS).select("key", F.when(word.isin(*judge.GRADES), word).alias("grade"), F.get_json_object("content", "$.reason").alias("reason"))
