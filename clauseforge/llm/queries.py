"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from . import leakage, packing, pairs, readability, sentences, spans, vectors, visual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Brute force over every window of 300 characters, and over every pair of vectors of a model.
ORACLE["p1_found"] = """WITH d AS (SELECT DISTINCT doc_id, full_text FROM contracts WHERE length(full_text) >= 300), i AS (SELECT doc_id, full_text, unnest(range(0, length(full_text) - 299)) AS a FROM d),
w AS (SELECT doc_id, a, md5(substr(full_text, a + 1, 300)) AS h FROM i), m AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, a FROM w JOIN m USING (h)),
g AS (SELECT doc_id, a, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id ORDER BY a) <= 300 THEN 0 ELSE 1 END AS o FROM s), k AS (SELECT doc_id, a, sum(o) OVER (PARTITION BY doc_id ORDER BY a) AS r FROM g)
SELECT doc_id, min(a)::INT AS char_start, (max(a) + 300)::INT AS char_end FROM k GROUP BY doc_id, r"""
ORACLE["p1_share"] = f"""WITH f AS ({ORACLE["p1_found"]}), o AS (SELECT doc_id, sum(char_end - char_start)::BIGINT AS n FROM f GROUP BY doc_id), a AS (SELECT DISTINCT doc_id, coalesce(length(full_text), 0) AS n_chars FROM contracts)
SELECT doc_id, n_chars::INT AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(n, 0) / nullif(n_chars, 0), 6) AS shared_share FROM a LEFT JOIN o USING (doc_id)"""
ORACLE["p2_found"] = """WITH u AS (SELECT DISTINCT model, key, vector::DOUBLE[] AS v FROM vectors WHERE vector IS NOT NULL AND len(vector) > 0 AND NOT list_bool_or([isnan(x) OR isinf(x) FOR x IN vector]) AND list_bool_or([x <> 0 FOR x IN vector])),
n AS (SELECT model, len(vector) AS w, count(*) AS c FROM vectors WHERE len(vector) > 0 GROUP BY ALL), t AS (SELECT model, arg_max(w, c) AS w FROM n GROUP BY model), o AS (SELECT u.model, key, v, sqrt(list_inner_product(v, v)) AS l FROM u JOIN t ON t.model = u.model AND len(v) = w),
c AS (SELECT a.model, a.key AS x, b.key AS y, list_inner_product(a.v, b.v) / (a.l * b.l) AS s FROM o a JOIN o b ON a.model = b.model AND a.key <> b.key), r AS (SELECT *, row_number() OVER (PARTITION BY model, x ORDER BY round(s, 13) DESC, y) AS k FROM c)
SELECT DISTINCT model, least(x, y) AS key_a, greatest(x, y) AS key_b FROM r WHERE k <= 5"""


@_query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "contracts"))


@_query
def p1_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each contract is shared."""
    contracts = table(spark, d, "contracts")
    return spans.shared_share(spans.shared_spans(contracts), contracts)


@_query
def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    """Collinear chains of each contract with the partners of its seeds."""
    return spans.shared_passages(table(spark, d, "contracts"))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_pairs(table(spark, d, "vectors"))


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.hidden_evidence(table(spark, d, "questions"), table(spark, d, "contracts"))


@_query
def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every contract and every evidence span."""
    return visual.forms(table(spark, d, "contracts"), table(spark, d, "questions"))


@_query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").filter(F.col("block_type").isin("paragraph", "list_item"))
    return sentences.sentence_units(blocks, "block_id", "text")


@_query
def p4_context_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the context windows of chunks."""
    return sentences.sentence_units(table(spark, d, "chunks"), "chunk_id", "context_text")


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "ask_responses"))


@_query
def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container of each text, or of each part of a text that is larger than the container, for every capacity."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


@_query
def p6_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and wasted share for every capacity."""
    return packing.utilisation(p6_packed(spark, d))


@_query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


@_query
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every run that counts, as a range of the document's text."""
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "heldout_items"))


@_query
def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Characters that are left of, and were removed from, each document once the runs are cut out."""
    clean = leakage.remove_leaks(table(spark, d, "documents").select("doc_id", "text"), materialise(p7_spans(spark, d), "leaks"))
    return clean.select("doc_id", F.length("text").alias("n_chars"), "removed_chars")


@_query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "band")


@_query
def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean difficulty by language and band."""
    n = _levels(spark, d).groupBy("language", "band")
    return n.agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("difficulty"), 4).alias("difficulty"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return readability.reading_levels(documents, readability.fit_levels(documents, table(spark, d, "reading_labels")))
