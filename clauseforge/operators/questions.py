"""Question sets out of annotated contracts: contracts with their evidence, candidates by type, selection and numbering.

Templates are data (``qtype, key, categories, template``), so the wording of a
question set is its user's. Spans are placed by exact normalised search first
and fuzzily where that fails.
"""

from __future__ import annotations

from collections import Counter
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import materialise
from . import labels, sampling

QTYPES = ("multi_span", "numeric", "unanswerable", "derived")
FAR_APART = 1500
#: Between the categories of a key.
JOINED = " + "
_TEMPLATES = "qtype string, key string, categories array<string>, template string"


def annotated_spans(articles: DataFrame) -> DataFrame:
    """``doc_id, category, text`` of annotated answers (``doc_id, question, answer``): the category in quotes, white space squeezed; each span once."""
    category = F.regexp_extract("question", r'related to "([^"]+)"', 1)
    rows = articles.select("doc_id", category.alias("category"), T.squeeze("answer").alias("text"))
    return rows.filter("category <> '' and text <> ''").distinct()


def place_spans(spans: DataFrame, documents: DataFrame, least: float = 85.0) -> DataFrame:
    """``doc_id, category, text, position``: spans that are found in their document and don't stand inside another of the same category.

    Spans with fewer than three letters and digits (redaction marks) aren't looked for.
    """
    some = spans.filter(sampling.enough_letters("text")).select("doc_id", "category", "text").distinct()
    asked = some.groupBy("doc_id", "category").agg(F.array_sort(F.collect_set("text")).alias("evidence_spans"))
    asked = materialise(asked.withColumns({"qid": F.sha1(F.concat_ws("\x1f", "doc_id", "category")), "answerable": F.lit(True)}), "spans")
    at = labels.align(asked, documents, least).filter("char_start is not null").select("qid", "span_index", F.col("char_start").alias("position"))
    each = asked.select("qid", "doc_id", "category", F.posexplode("evidence_spans").alias("span_index", "text"))
    placed = each.join(at.withColumn("span_index", F.col("span_index").cast("int")), ["qid", "span_index"]).select("doc_id", "category", "text", "position")
    return sampling.drop_contained(materialise(placed, "placed"))


def contracts(placed: DataFrame, spans: DataFrame, sheet: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per contract: ``doc_id, name, present, answers map, spans map, positions map, dropped``.

    ``spans``: all annotated spans, found or not; ``sheet``: ``doc_id, column,
    value`` of the answer sheet. The name comes from the sheet's document name and parties, else from the contract's type.
    """
    order = F.array_sort(F.collect_list(F.struct("position", "text")))
    per = placed.groupBy("doc_id", "category").agg(order.alias("s")).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", F.col("s.text").alias("v")))).alias("spans"),
        F.map_from_entries(F.collect_list(F.struct("category", F.col("s.position").alias("v")))).alias("positions"),
    )
    found = placed.select("doc_id", "category", "text").distinct().withColumn("_f", F.lit(1))
    present = spans.join(found, ["doc_id", "category", "text"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_set("category")).alias("present"), F.count(F.when(F.col("_f").isNull(), 1)).alias("dropped"))
    name = F.trim(F.regexp_replace("column", r"(?i)\s*-\s*answer$", ""))
    answers = sheet.filter(F.col("column").rlike(r"(?i)-\s*answer$")).groupBy("doc_id", name.alias("c")).agg(F.max(T.squeeze(F.coalesce("value", F.lit("")))).alias("v"))
    answers = answers.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("answers"))
    d = documents.select("doc_id", F.coalesce("contract_type", F.lit("Agreement")).alias("contract_type")).dropDuplicates(["doc_id"])
    out = d.join(answers, "doc_id", "left").join(present, "doc_id", "left").join(per, "doc_id", "left")
    some = lambda c, kind: F.coalesce(c, F.from_json(F.lit("{}"), kind))
    out = out.withColumns({
        "answers": some("answers", "map<string,string>"), "spans": some("spans", "map<string,array<string>>"), "positions": some("positions", "map<string,array<bigint>>"),
        "present": F.coalesce("present", F.array().cast("array<string>")), "dropped": F.coalesce("dropped", F.lit(0)),
    })
    who = T.parse_parties(F.coalesce(F.col("answers")["Parties"], F.lit("")))
    return out.withColumn("name", T.agreement_name(F.coalesce(F.col("answers")["Document Name"], F.lit("")), who, "contract_type"))


def candidates(found: DataFrame, templates: DataFrame) -> DataFrame:
    """Questions each contract could be asked: ``doc_id, qtype, key, categories, question, reference, evidence, name``.

    derived: the category has evidence. numeric: one of its spans has an amount
    and no redaction. multi_span: its spans, or those of its two categories, are
    more than ``FAR_APART`` characters apart. unanswerable: nothing is annotated
    and the sheet says nothing or no. The templates are a small fixed table and sent to all tasks.
    """
    met = found.crossJoin(F.broadcast(templates))
    spans = lambda c: F.coalesce(F.col("spans")[c], F.array().cast("array<string>"))
    at = lambda c: F.coalesce(F.col("positions")[c], F.array().cast("array<bigint>"))
    first, second = F.get("categories", F.lit(0)), F.get("categories", F.lit(1))
    all_there = F.forall("categories", lambda c: F.size(F.coalesce(F.col("spans")[c], F.array().cast("array<string>"))) > 0)
    apart = F.array_min(F.flatten(F.transform(at(first), lambda x: F.transform(at(second), lambda y: F.abs(x - y)))))
    spread = F.when(F.size("categories") > 1, apart).otherwise(F.when(F.size(at(first)) > 1, F.array_max(at(first)) - F.array_min(at(first))))
    amount = F.exists(spans(first), lambda s: s.rlike(sampling.AMOUNT) & ~s.rlike(sampling.REDACTED))
    silent = F.lower(F.trim(F.coalesce(F.col("answers")[first], F.lit("")))).isin("", "no")
    absent = ~F.array_contains("present", first) & silent
    fits = (
        F.when(F.col("qtype") == "unanswerable", absent)
        .when(F.col("qtype") == "numeric", all_there & amount)
        .when(F.col("qtype") == "multi_span", all_there & F.coalesce(spread > FAR_APART, F.lit(False)))
        .otherwise(all_there)
    )
    none = F.col("qtype") == "unanswerable"
    return met.filter(fits).select(
        "doc_id", "qtype", "key", "categories", F.replace("template", F.lit("{name}"), F.col("name")).alias("question"),
        F.when(none, "").otherwise(sampling.reference_answer(F.col("categories"), F.col("answers"), F.col("spans"))).alias("reference"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.flatten(F.transform("categories", lambda c: F.col("spans")[c]))).alias("evidence"), "name",
    )


def pickable(pool: DataFrame, quota: int, used: int, seed: str = "0", per_doc: int = 2) -> DataFrame:
    """The candidates that a selection of ``quota`` can reach: of each key, the first in draw order by document.

    A key gives at most ``quota`` picks, and each pick made before, or made now
    for another key, can stand in the way of one candidate of a document; so
    more than ``quota`` + picks · ``per_doc`` candidates of a key are never looked at.
    """
    draw = F.md5(F.concat_ws("~", F.lit(seed), "doc_id", "key"))
    most = quota + (used + quota) * per_doc
    return pool.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(draw, "doc_id"))).filter(F.col("_r") <= most).drop("_r")


def _records(picked: DataFrame) -> DataFrame:
    """Picked candidates (``doc_id, qtype, key, categories, question, reference, evidence, name, split``) as question records, numbered in order of split, type, document and key."""
    types = F.create_map(*[F.lit(x) for i, q in enumerate(QTYPES) for x in (q, i)])
    place = F.row_number().over(W.orderBy(F.col("split") != "dev", types[F.col("qtype")], "doc_id", "key"))
    rows = picked.withColumn("qid", F.concat(F.lit("q"), F.lpad(place.cast("string"), 4, "0")))
    return rows.select(
        "qid", "question", "doc_id", "qtype", F.col("key").alias("category"), F.col("reference").alias("reference_answer"), F.col("evidence").alias("evidence_spans"),
        (F.col("qtype") != "unanswerable").alias("answerable"), "split", F.lit("annotations").alias("source"), F.lit("").alias("notes"), F.nullif("name", F.lit("")).alias("contract_name"),
    )


def build_questions(pool: DataFrame, splits: DataFrame, quotas: dict[str, dict[str, int]], seed: str = "0", per_doc: int = 2) -> tuple[DataFrame, DataFrame]:
    """(questions, shortfalls ``split, qtype, missing``): candidates picked for each split and type up to ``quotas[split][qtype]``.

    What can be picked depends on what was picked before, over types and splits, so picking
    runs in the driver, on the candidates it can reach; the quotas bound them.
    """
    met = materialise(pool.join(splits, "doc_id"), "candidates")
    docs, pairs = Counter(), set()
    got: list[pd.DataFrame] = []
    missing: list[tuple[str, str, int]] = []
    for split, qtype in product(("dev", "test"), QTYPES):
        if quota := int(quotas.get(split, {}).get(qtype, 0)):
            reach = pickable(met.filter((F.col("split") == split) & (F.col("qtype") == qtype)), quota, sum(map(len, got)), seed, per_doc)
            got.append(sampling.select_round_robin(reach.toPandas(), quota, seed, per_doc, docs, pairs))
            missing += [(split, qtype, quota - len(got[-1]))] if len(got[-1]) < quota else []
    plain = lambda v: list(v) if hasattr(v, "tolist") else v  # noqa: E731 - arrays come from pandas as numpy's
    picked = pool.sparkSession.createDataFrame([tuple(map(plain, r)) for part in got for r in part[met.columns].itertuples(index=False)], met.schema)
    return _records(picked), pool.sparkSession.createDataFrame(missing, "split string, qtype string, missing int")


def replace_questions(asked: DataFrame, pool: DataFrame, splits: DataFrame, reasons: dict[str, str], seed: str = "0", per_doc: int = 2) -> DataFrame:
    """``asked`` with the questions named in ``reasons`` (id to reason) swapped for others of the same split and type, under their ids.

    All other questions stay. What a replaced question asked doesn't come back,
    and no document gets more than ``per_doc`` questions. The reason is noted.
    """
    rows = {r["qid"]: r.asDict() for r in asked.collect()}
    if unknown := sorted(set(reasons) - set(rows)):
        raise ValueError(f"no questions {unknown} to replace")
    docs = Counter(r["doc_id"] for r in rows.values())
    pairs = {(r["doc_id"], c) for r in rows.values() for c in r["category"].split(JOINED)}
    met = materialise(pool.join(splits, "doc_id"), "candidates")
    for qid in sorted(reasons):
        old = rows[qid]
        docs[old["doc_id"]] -= 1
        reach = pickable(met.filter((F.col("split") == old["split"]) & (F.col("qtype") == old["qtype"])), 1, len(rows) + len(reasons), f"{seed}:{qid}", per_doc)
        new = sampling.select_round_robin(reach.toPandas(), 1, f"{seed}:{qid}", per_doc, docs, pairs)
        if new.empty:
            raise ValueError(f"nothing to replace {qid} with")
        (n,) = new.to_dict("records")
        rows[qid] = old | {"doc_id": n["doc_id"], "category": n["key"], "question": n["question"], "reference_answer": n["reference"], "evidence_spans": list(n["evidence"]), "contract_name": n["name"] or None, "notes": f"replaced: {reasons[qid]}"}
    return asked.sparkSession.createDataFrame([tuple(r[c] for c in asked.columns) for r in rows.values()], asked.schema)


def templates(spark, rows: list[tuple[str, tuple[str, ...], str]]) -> DataFrame:
    """A template table of (qtype, categories, template with ``{name}``); the key joins the categories."""
    out = pd.DataFrame([(q, JOINED.join(c), list(c), t) for q, c, t in rows], columns=["qtype", "key", "categories", "template"])
    return spark.createDataFrame(out, _TEMPLATES)
