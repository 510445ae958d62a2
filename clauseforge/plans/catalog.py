"""Registered queries of the engine's own operators, each with its SQL where SQL can say the same.

Every query runs over its whole tables. Names begin with the family of the
operator they show (ret, lbl, met, agg, chk, txt, jdg, tri, smp, sel, src, str).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import udfs
from ..operators import ablation, chunking, ingest, judge, labels, metrics, retrieval, sampling, triage
from ..session import materialise, scratch_path, table
from ..sources import files
from ..streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MODEL, WIDTH = "clause-small", 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# ---------- SQL pieces ----------

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _toks(c: str) -> str:
    return rf"[x FOR x IN regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]{{2,}}') IF NOT list_contains({_STOP}, x)]"


_FIXED = "c AS (SELECT DISTINCT chunk_id, doc_id, text, char_start, char_end FROM chunks WHERE strategy = 'fixed')"
_QS = "qs AS (SELECT DISTINCT qid, question, doc_id, contract_name FROM questions)"
_INDEX = f"""{_FIXED}, t0 AS (SELECT chunk_id, doc_id, {_toks("text")} AS toks FROM c), t1 AS (SELECT chunk_id, doc_id, len(toks) AS dl, unnest(toks) AS term FROM t0),
post AS (SELECT term, chunk_id, doc_id, dl, count(*) AS tf FROM t1 GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t0)"""
_SCOPED_Q = "CASE WHEN contract_name IS NOT NULL AND contract_name <> '' THEN replace(question, contract_name, 'the agreement') ELSE question END"


def _bm25(question: str, scope: str, k: int, name: str = "bm") -> str:
    return f"""{_INDEX}, {_QS}, qt AS (SELECT qid, doc_id, unnest({_toks(question)}) AS term FROM qs), qn AS (SELECT qid, doc_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
qw AS (SELECT qid, qn.doc_id, qn.term, qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w, avgdl FROM qn JOIN df USING (term), tot),
sc AS (SELECT qid, chunk_id, sum(w * (tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score FROM post p JOIN qw ON p.term = qw.term {scope} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT qid, 'bm25' AS stage, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank, chunk_id, score FROM sc) WHERE rank <= {k})"""


_IN_DOC = "AND (qw.doc_id IS NULL OR qw.doc_id = p.doc_id)"
_DENSE = f"""v AS (SELECT DISTINCT key, vector FROM vectors WHERE model = '{MODEL}' AND len(vector) = {WIDTH} AND NOT list_bool_or([isnan(x) OR isinf(x) FOR x IN vector]) AND list_bool_or([x <> 0 FOR x IN vector])),
cv AS (SELECT chunk_id, doc_id, vector::DOUBLE[] AS vec FROM c JOIN v ON sha256(text) = key),
qv AS (SELECT qid, doc_id, vec AS qvec FROM qs JOIN (SELECT doc_id, arg_min(vec, chunk_id) AS vec FROM cv GROUP BY doc_id) USING (doc_id)),
dsc AS (SELECT qid, chunk_id, list_inner_product(vec, qvec) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(qvec, qvec))) AS score FROM cv JOIN qv USING (doc_id)),
dn AS (SELECT * FROM (SELECT qid, 'dense' AS stage, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank, chunk_id, score FROM dsc) WHERE rank <= 50)"""
_RRF = """both_ AS (SELECT * FROM bm UNION ALL SELECT * FROM dn), fsc AS (SELECT qid, chunk_id, sum(1::DOUBLE / (60 + rank)) AS score, min(rank) AS best FROM both_ GROUP BY ALL),
fu AS (SELECT * FROM (SELECT qid, 'fusion' AS stage, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, best, chunk_id) AS rank, chunk_id, score FROM fsc) WHERE rank <= 50)"""
_WORDS = r"list_distinct([x FOR x IN regexp_split_to_array(lower(coalesce({c}, '')), '\s+') IF x <> ''])"


def _rerank(source: str, question: str) -> str:
    return f"""rsc AS (SELECT l.qid, l.chunk_id, l.rank AS before, len(list_intersect({_WORDS.format(c=question)}, {_WORDS.format(c="c.text")}))::DOUBLE AS score FROM {source} l JOIN c USING (chunk_id) JOIN qs USING (qid)),
rr AS (SELECT qid, 'rerank' AS stage, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank, chunk_id, score FROM rsc)"""


def _lists(name: str) -> str:
    return f"SELECT qid, stage, rank, chunk_id, round(score, 6) AS score FROM {name}"


# ---------- shared inputs ----------


def _fixed(s: SparkSession, d: str) -> DataFrame:
    return retrieval.distinct_chunks(table(s, d, "chunks"), "fixed")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").dropDuplicates(["qid"])


_INDEXES: dict[tuple, retrieval.Index] = {}


def _index(s: SparkSession, d: str, stemmed: bool = False) -> retrieval.Index:
    """The index of a folder's fixed chunks: built once, kept in the shared folder and read by all queries of a session."""
    key = (s.sparkContext.applicationId, d, stemmed)
    if key not in _INDEXES or not files.path_exists(s, _INDEXES[key].docs.inputFiles()[0]):
        _INDEXES[key] = retrieval.build_index(_fixed(s, d), stemmed=stemmed)
    return _INDEXES[key]


def _bm25_list(s: SparkSession, d: str, k: int, scoped: bool = True) -> DataFrame:
    return retrieval.bm25(_index(s, d), retrieval.query_terms(_questions(s, d)), k, scoped=scoped)


def _chunk_vectors(s: SparkSession, d: str) -> DataFrame:
    sound = F.expr(f"size(vector) = {WIDTH} and forall(vector, x -> not isnan(x) and abs(x) < float('inf')) and exists(vector, x -> x <> 0)")
    v = table(s, d, "vectors").filter((F.col("model") == MODEL) & sound).select("key", F.col("vector").alias("vec")).dropDuplicates(["key"])
    return _fixed(s, d).select("chunk_id", "doc_id", files.embedding_key("text").alias("key")).join(v, "key").drop("key")


def _dense_list(s: SparkSession, d: str) -> DataFrame:
    """More like the contract's first chunk: a query vector that every engine can look up."""
    v = _chunk_vectors(s, d)
    first = v.groupBy("doc_id").agg(F.min_by("vec", "chunk_id").alias("qvec"))
    return retrieval.dense(v, _questions(s, d).select("qid", "doc_id").join(first, "doc_id"), on=["doc_id"])


def _shown(lists: DataFrame) -> DataFrame:
    return lists.withColumn("score", F.round("score", 6))


# ---------- search ----------


@query(f"""WITH t0 AS (SELECT DISTINCT strategy, chunk_id, text FROM chunks), t1 AS (SELECT strategy, chunk_id, {_toks("text")} AS toks FROM t0),
p AS (SELECT strategy, chunk_id, unnest(toks) AS term FROM t1), v AS (SELECT strategy, count(DISTINCT term) AS vocabulary, count(DISTINCT (term, chunk_id)) AS postings FROM p GROUP BY ALL)
SELECT strategy, count(*) AS chunks, round(avg(len(toks)), 6) AS avgdl, any_value(vocabulary) AS vocabulary, any_value(postings) AS postings FROM t1 JOIN v USING (strategy) GROUP BY strategy""")
def ret0_index_report(s: SparkSession, d: str) -> DataFrame:
    """Index statistics of every chunking strategy."""
    t = retrieval.distinct_chunks(table(s, d, "chunks")).select("strategy", "chunk_id", T.tokens("text").alias("toks"))
    n = t.groupBy("strategy").agg(F.count("*").alias("chunks"), F.round(F.avg(F.size("toks")), 6).alias("avgdl"))
    p = t.select("strategy", "chunk_id", F.explode("toks").alias("term")).distinct().groupBy("strategy", "term").agg(F.count("*").alias("df"))
    return n.join(p.groupBy("strategy").agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings")), "strategy")


@query(f"WITH {_INDEX} SELECT term, df FROM df")
def ret0_term_df(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).terms


@query(f"WITH {_bm25('question', '', 8)} {_lists('bm')}")
def ret1_bm25_corpus(s: SparkSession, d: str) -> DataFrame:
    return _shown(_bm25_list(s, d, 8, scoped=False))


@query(f"WITH {_bm25('question', _IN_DOC, 8)} {_lists('bm')}")
def ret1_bm25_scoped(s: SparkSession, d: str) -> DataFrame:
    return _shown(_bm25_list(s, d, 8))


@query()
def ret1_bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    """BM25 with the English stemmer on both sides."""
    return _shown(retrieval.bm25(_index(s, d, True), retrieval.query_terms(_questions(s, d), stemmed=True), 8))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS chunk_id,
list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS score FROM e, (SELECT * FROM e WHERE vec_id % 50 = 0) q)
SELECT qid, 'dense' AS stage, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s) WHERE rank <= 8""")
def ret2_dense(s: SparkSession, d: str) -> DataFrame:
    """Cosine search of every fiftieth embedding over all of them."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return _shown(retrieval.dense(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), q, 8))


@query(f"WITH {_FIXED}, {_QS}, {_DENSE} {_lists('dn')}")
def ret2_dense_scoped(s: SparkSession, d: str) -> DataFrame:
    return _shown(_dense_list(s, d))


@query(f"WITH {_bm25('question', _IN_DOC, 50)}, {_DENSE}, {_RRF} {_lists('fu')}")
def ret3_rrf(s: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.rrf(_bm25_list(s, d, 50).unionByName(_dense_list(s, d))))


@query(f"""WITH {_bm25('question', _IN_DOC, 50)}, {_DENSE}, l AS (SELECT *, 0.4::DOUBLE AS w FROM bm UNION ALL SELECT *, 0.6::DOUBLE FROM dn),
m AS (SELECT qid, chunk_id, w, score, min(score) OVER (PARTITION BY qid, stage) AS lo, max(score) OVER (PARTITION BY qid, stage) AS hi FROM l),
x AS (SELECT qid, chunk_id, sum(w * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS score FROM m GROUP BY ALL),
fu AS (SELECT * FROM (SELECT qid, 'fusion' AS stage, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank, chunk_id, score FROM x) WHERE rank <= 50) {_lists('fu')}""")
def ret5_weighted(s: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.weighted(_bm25_list(s, d, 50), _dense_list(s, d), 0.6))


@query(f"WITH {_bm25('question', _IN_DOC, 50)}, {_rerank('bm', 'question')} {_lists('rr')}")
def ret6_rerank(s: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.rerank(_bm25_list(s, d, 50), _questions(s, d), _fixed(s, d)))


PIPELINE = retrieval.Config(dense_model=MODEL, fusion="rrf", reranker="overlap")


@query(f"""WITH {_bm25(_SCOPED_Q, _IN_DOC, 50)}, {_DENSE}, {_RRF}, {_rerank('fu', _SCOPED_Q)},
al AS (SELECT * FROM bm UNION ALL SELECT * FROM dn UNION ALL SELECT * FROM fu UNION ALL SELECT * FROM rr UNION ALL SELECT qid, 'final', rank, chunk_id, score FROM rr WHERE rank <= 8)
SELECT '{PIPELINE.config_id}' AS config_id, qid, stage, rank, chunk_id, round(score, 6) AS score FROM al""")
def ret7_pipeline(s: SparkSession, d: str) -> DataFrame:
    """All stages of the hybrid pipeline with reranking."""
    return _shown(_pipeline(s, d))


def _pipeline(s: SparkSession, d: str) -> DataFrame:
    chunks = _fixed(s, d)
    return retrieval.run_pipeline(PIPELINE, _questions(s, d), chunks, _index(s, d), _dense_list(s, d))


@query(f"WITH {_QS} SELECT qid, {_SCOPED_Q} AS question FROM qs")
def ret8_scoped_question(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("qid", retrieval.scoped_question("question", "contract_name").alias("question"))


@query()
def ret11_encode(s: SparkSession, d: str) -> DataFrame:
    """Deterministic vectors of all distinct fixed chunk texts, only those a cache doesn't hold."""
    texts = _fixed(s, d).select(files.embedding_key("text").alias("key"), "text").dropDuplicates(["key"])
    return texts.select("key", udfs.encoder()("text").alias("vector"))


@query("""WITH t AS (SELECT DISTINCT sha256(text) AS key FROM chunks WHERE strategy IN ('fixed', 'section') AND text IS NOT NULL)
SELECT model, count(*) AS missing FROM (SELECT 'clause-small' AS model, key FROM t UNION ALL SELECT 'clause-base', key FROM t) w WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.model = w.model AND v.key = w.key) GROUP BY model""")
def snk5_cache_misses(s: SparkSession, d: str) -> DataFrame:
    """Distinct chunk texts that each model's cache doesn't hold yet."""
    t = table(s, d, "chunks").filter(F.col("strategy").isin("fixed", "section") & F.col("text").isNotNull()).select("text")
    v = table(s, d, "vectors")
    parts = [ingest.cache_misses(t, v, m).agg(F.count("*").alias("missing")).select(F.lit(m).alias("model"), "missing") for m in ("clause-small", "clause-base")]
    return parts[0].unionByName(parts[1]).filter("missing > 0")


# ---------- labels ----------

_NORM = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SPANS = "q0 AS (SELECT DISTINCT qid, doc_id, evidence_spans FROM questions WHERE answerable), sp AS (SELECT qid, doc_id, generate_subscripts(evidence_spans, 1) - 1 AS span_index, unnest(evidence_spans) AS span FROM q0)"
_PLACED = f"{_SPANS}, pl AS (SELECT qid, sp.doc_id, span_index, instr(full_text, span) - 1 AS char_start, instr(full_text, span) - 1 + length(span) AS char_end FROM sp JOIN contracts USING (doc_id) WHERE instr(full_text, span) > 0 AND span <> '')"
_COVERS = """greatest(0, least(c.char_end, pl.char_end) - greatest(c.char_start, pl.char_start)) > 0
AND greatest(0, least(c.char_end, pl.char_end) - greatest(c.char_start, pl.char_start)) >= 0.5::DOUBLE * least(c.char_end - c.char_start, pl.char_end - pl.char_start)"""


def _placed(s: SparkSession, d: str) -> DataFrame:
    """Spans that stand in their contract letter for letter."""
    sp = labels.spans_of(table(s, d, "questions")).filter("span <> ''")
    met = sp.join(table(s, d, "contracts").select("doc_id", "full_text").dropDuplicates(["doc_id"]), "doc_id")
    at = F.instr("full_text", F.col("span"))
    return met.filter(at > 0).select("qid", "doc_id", "span_index", (at - 1).cast("bigint").alias("char_start"), (at - 1 + F.length("span")).cast("bigint").alias("char_end"))


@query(f"""WITH {_SPANS}, n AS (SELECT qid, sp.doc_id, span_index, {_NORM.format(c="span")} AS needle, {_NORM.format(c="full_text")} AS hay FROM sp LEFT JOIN contracts USING (doc_id))
SELECT qid, doc_id, span_index, coalesce(needle <> '' AND contains(hay, needle), false) AS found,
CASE WHEN coalesce(needle <> '' AND contains(hay, needle), false) THEN ((length(hay) - length(replace(hay, needle, ''))) / length(needle))::BIGINT ELSE 0 END AS occurrences FROM n""")
def lbl_locate(s: SparkSession, d: str) -> DataFrame:
    return labels.locate_exact(table(s, d, "questions"), table(s, d, "contracts").dropDuplicates(["doc_id"]))


@query(f"""WITH {_PLACED}, c AS (SELECT DISTINCT chunk_id, doc_id, strategy, char_start, char_end FROM chunks), w AS (SELECT qid, span_index, strategy FROM pl, (SELECT DISTINCT strategy FROM chunks)),
h AS (SELECT qid, span_index, strategy, chunk_id FROM pl JOIN c USING (doc_id) WHERE {_COVERS}) SELECT qid, span_index, strategy, chunk_id FROM w LEFT JOIN h USING (qid, span_index, strategy)""")
def lbl_relevant_chunks(s: SparkSession, d: str) -> DataFrame:
    return labels.relevant_chunks(_placed(s, d), table(s, d, "chunks"))


@query()
def lbl_align(s: SparkSession, d: str) -> DataFrame:
    """Every evidence span placed exactly or fuzzily."""
    return labels.align(table(s, d, "questions"), table(s, d, "contracts").dropDuplicates(["doc_id"]))


@query()
def lbl_alignment_report(s: SparkSession, d: str) -> DataFrame:
    a = materialise(lbl_align(s, d), "align")
    return labels.alignment_report(table(s, d, "questions"), a, labels.relevant_chunks(a, table(s, d, "chunks")))


# ---------- metrics ----------

# Metrics of lists ``ls (config_id, qid, rank, chunk_id)`` over chunks ``c``.
_SCORES = f"""{_PLACED}, h AS (SELECT qid, span_index, chunk_id FROM pl JOIN c USING (doc_id) WHERE {_COVERS}), nd AS (SELECT pl.qid, count(DISTINCT pl.span_index) AS spans, count(DISTINCT h.chunk_id) AS relevant FROM pl LEFT JOIN h ON pl.qid = h.qid AND pl.span_index = h.span_index GROUP BY pl.qid),
n AS (SELECT config_id, qid, count(*) AS budget FROM ls GROUP BY ALL), be AS (SELECT config_id, ls.qid, span_index, min(rank) AS best FROM ls JOIN h ON ls.qid = h.qid AND ls.chunk_id = h.chunk_id GROUP BY ALL),
rc AS (SELECT config_id, qid, count(*) FILTER (best <= 1) AS s1, count(*) FILTER (best <= 3) AS s3, count(*) FILTER (best <= 5) AS s5, count(*) FILTER (best <= 8) AS s8 FROM be GROUP BY ALL),
hi AS (SELECT DISTINCT config_id, ls.qid, rank FROM ls JOIN h ON ls.qid = h.qid AND ls.chunk_id = h.chunk_id), hn AS (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY rank) AS nth FROM hi),
hg AS (SELECT config_id, qid, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg, avg(nth / rank) AS cp, count(*) AS hits FROM hn GROUP BY ALL),
sc2 AS (SELECT config_id, qid, coalesce(s1, 0) / spans AS recall_1, coalesce(s3, 0) / spans AS recall_3, coalesce(s5, 0) / spans AS recall_5, coalesce(s8, 0) / spans AS context_recall,
CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant END AS chunk_recall, CASE WHEN relevant > 0 THEN (coalesce(hits, 0) > 0)::INT::DOUBLE END AS hit,
CASE WHEN relevant > 0 THEN coalesce(1 / first, 0)::DOUBLE END AS mrr, CASE WHEN relevant > 0 THEN coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(relevant, 10) + 1)]) END AS ndcg_at_10,
CASE WHEN relevant > 0 THEN coalesce(cp, 0)::DOUBLE END AS context_precision FROM n LEFT JOIN nd USING (qid) LEFT JOIN rc USING (config_id, qid) LEFT JOIN hg USING (config_id, qid))"""
_LABELLED = f"{_bm25('question', _IN_DOC, 8)}, {_rerank('bm', 'question')}, ls AS (SELECT 'bm25' AS config_id, qid, rank, chunk_id FROM bm UNION ALL SELECT 'rerank', qid, rank, chunk_id FROM rr), {_SCORES}"
_METRICS = ("recall_1", "recall_3", "recall_5", "context_recall", "chunk_recall", "hit", "mrr", "ndcg_at_10", "context_precision")
_LONG = "lg AS (UNPIVOT (SELECT config_id, qid, recall_1::DOUBLE AS \"recall@1\", recall_3::DOUBLE AS \"recall@3\", recall_5::DOUBLE AS \"recall@5\", mrr, ndcg_at_10, context_precision, context_recall::DOUBLE AS context_recall FROM sc2) ON COLUMNS(* EXCLUDE (config_id, qid)) INTO NAME metric VALUE value)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    bm = materialise(_bm25_list(s, d, 8), "bm25")
    rr = retrieval.rerank(bm, _questions(s, d), _fixed(s, d))
    lists = materialise(bm.withColumn("config_id", F.lit("bm25")).unionByName(rr.withColumn("config_id", F.lit("rerank"))), "lists")
    held = materialise(labels.relevant_chunks(_placed(s, d), table(s, d, "chunks").filter("strategy = 'fixed'")), "held")
    return metrics.score_lists(lists, held, ks=(1, 3, 5))


@query(f"WITH {_LABELLED} SELECT config_id, qid, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM sc2")
def met_scores(s: SparkSession, d: str) -> DataFrame:
    """Every metric of the sparse and the reranked list of each question."""
    x = _scored(s, d).withColumns({f"recall_{k}": F.element_at("recall_at", k) for k in (1, 3, 5)})
    return x.select("config_id", "qid", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in _METRICS])


@query(f"WITH {_LABELLED}, {_LONG} SELECT config_id, metric, round(avg(value), 6) AS mean, count(*) AS n FROM lg GROUP BY ALL")
def met_summary(s: SparkSession, d: str) -> DataFrame:
    t = metrics.metric_table(_scored(s, d))
    return t.groupBy("config_id", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


_WEIGHT = " + ".join(f"(u >= {x})::INT" for x in udfs.POISSON_STEPS)


def _boot(source: str, group: str, value: str, key: str, rounds: int = 2000) -> str:
    return f"""dr AS (SELECT {key}, 8 * k + i AS r, {_WEIGHT} AS w FROM (SELECT {key}, k, i, concat('0x', substr(md5(concat(k, '~', {key})), 4 * i + 1, 4))::INT AS u FROM (SELECT DISTINCT {key} FROM {source}), range(0, {-(-rounds // 8)}) a(k), range(0, 8) b(i)) WHERE 8 * k + i < {rounds}),
mm AS (SELECT {group}, r, sum(w * {value}) / sum(w) AS m FROM {source} JOIN dr USING ({key}) GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT {group}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM mm GROUP BY {group}), mn AS (SELECT {group}, avg({value}) AS mean, count(*) AS n FROM {source} GROUP BY {group})"""


_ENDS = ", ".join(f"round({c}, {n}) AS {c}" for c, n in (("mean", 6), ("ci_low", 7), ("ci_high", 7))) + ", n"


def _rounded(b: DataFrame) -> DataFrame:
    return b.withColumns({"mean": F.round("mean", 6), "ci_low": F.round("ci_low", 7), "ci_high": F.round("ci_high", 7)})


@query(f"WITH {_LABELLED}, {_LONG}, {_boot('lg', 'config_id, metric', 'value', 'qid')} SELECT config_id, metric, {_ENDS} FROM mn JOIN ci USING (config_id, metric)")
def met_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Intervals of every metric by 2000 rounds."""
    t = materialise(metrics.metric_table(_scored(s, d)), "metrics")
    return _rounded(metrics.bootstrap_native(t, ["config_id", "metric"], "value", "qid"))


@query(f"""WITH {_LABELLED}, {_LONG}, df2 AS (SELECT a.metric, a.qid, b.value - a.value AS diff FROM lg a JOIN lg b ON a.metric = b.metric AND a.qid = b.qid AND a.config_id = 'bm25' AND b.config_id = 'rerank'),
{_boot('df2', 'metric', 'diff', 'qid')} SELECT metric, {_ENDS}, ci_low > 0 OR ci_high < 0 AS significant FROM mn JOIN ci USING (metric)""")
def met_paired_difference(s: SparkSession, d: str) -> DataFrame:
    """Paired differences with intervals by 2000 rounds."""
    t = materialise(metrics.metric_table(_scored(s, d)), "metrics")
    return _rounded(metrics.paired_difference(t, "bm25", "rerank"))


@query()
def met_bootstrap_exact(s: SparkSession, d: str) -> DataFrame:
    """Intervals with numpy's generator."""
    return metrics.bootstrap_exact(materialise(metrics.metric_table(_scored(s, d)), "metrics"), ["config_id", "metric"], "value", "qid")


@query()
def met_paired_difference_exact(s: SparkSession, d: str) -> DataFrame:
    """Paired differences of 2000 rounds with numpy's generator."""
    return metrics.paired_difference_exact(materialise(metrics.metric_table(_scored(s, d)), "metrics"), "bm25", "rerank")


_DECL = r"(does|do|did) not (explicitly |expressly |specifically )?(contain|specify|mention|include|state|provide|address|define|set out)"


@query("""WITH a AS (SELECT DISTINCT request_id, model, abstained, truncated FROM ask_responses), c AS (SELECT model, abstained AS x, truncated AS y, count(*) AS k FROM a WHERE abstained IS NOT NULL AND truncated IS NOT NULL GROUP BY ALL),
t AS (SELECT model, sum(k)::BIGINT AS n, sum(CASE WHEN x = y THEN k ELSE 0 END) AS same FROM c GROUP BY model), l AS (SELECT model, x, sum(k) AS k FROM c GROUP BY ALL), r AS (SELECT model, y, sum(k) AS k FROM c GROUP BY ALL),
e AS (SELECT l.model, sum(l.k * r.k) AS cr FROM l JOIN r ON l.model = r.model AND l.x = r.y GROUP BY l.model), z AS (SELECT model, n, same / n AS po, coalesce(cr, 0) / (n * n) AS pe FROM t LEFT JOIN e USING (model)),
k AS (SELECT model, n, round(po, 6) AS percent_agreement, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kp FROM z)
SELECT model, n, percent_agreement, round(kp, 6) AS kappa, CASE WHEN kp <= 0 THEN 'poor' WHEN kp <= 0.2 THEN 'slight' WHEN kp <= 0.4 THEN 'fair' WHEN kp <= 0.6 THEN 'moderate' WHEN kp <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def agg20_agreement(s: SparkSession, d: str) -> DataFrame:
    """Agreement of two flags of the responses, by model."""
    a = table(s, d, "ask_responses").select("request_id", "model", "abstained", "truncated").distinct()
    r = metrics.agreement(a, "abstained", "truncated", ["model"])
    return r.withColumn("percent_agreement", F.round("percent_agreement", 6)).withColumn("kappa", F.round("kappa", 6))


# ---------- aggregations ----------


@query("""WITH c AS (SELECT DISTINCT strategy, chunk_id, token_count, has_table FROM chunks), x AS (SELECT strategy, list_sort(list(token_count)) AS l, count(*) AS n, avg(CASE WHEN has_table THEN 1 ELSE 0 END) AS t FROM c GROUP BY strategy)
SELECT strategy, n, l[round_even((n - 1) * 0.1, 0)::INT + 1] AS p10, l[round_even((n - 1) * 0.5, 0)::INT + 1] AS p50, l[round_even((n - 1) * 0.9, 0)::INT + 1] AS p90, l[1] AS p0, l[n] AS p100, round(t, 6) AS table_share FROM x""")
def agg2_chunk_stats(s: SparkSession, d: str) -> DataFrame:
    c = retrieval.distinct_chunks(table(s, d, "chunks"))
    p = metrics.nearest_rank_by(c, ["strategy"], "token_count", (0.0, 0.1, 0.5, 0.9, 1.0))
    return p.join(c.groupBy("strategy").agg(F.round(F.avg(F.col("has_table").cast("int")), 6).alias("table_share")), "strategy")


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS l, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, l[round_even((n - 1) * 0.25, 0)::INT + 1] AS p25, l[round_even((n - 1) * 0.5, 0)::INT + 1] AS p50, l[round_even((n - 1) * 0.75, 0)::INT + 1] AS p75 FROM x""")
def agg2_nearest_rank_lineitem(s: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank_by(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.25, 0.5, 0.75))


@query("WITH b AS (SELECT DISTINCT doc_id, block_id, block_type, page FROM blocks) SELECT block_type, count(*) AS blocks, count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, page)) AS pages FROM b GROUP BY block_type")
def agg3_parse_report(s: SparkSession, d: str) -> DataFrame:
    return ingest.parse_report(table(s, d, "blocks").dropDuplicates(["block_id"]))


@query("""WITH q AS (SELECT DISTINCT qid, split, qtype, category, doc_id FROM questions) SELECT split, qtype, category, count(*) AS questions, count(DISTINCT doc_id) AS documents FROM q GROUP BY GROUPING SETS ((split, qtype), (category), ())""")
def agg4_question_report(s: SparkSession, d: str) -> DataFrame:
    q = _questions(s, d)
    out = q.groupingSets([["split", "qtype"], ["category"], []], "split", "qtype", "category")
    return out.agg(F.count("*").alias("questions"), F.countDistinct("doc_id").alias("documents"))


@query("""WITH p AS (SELECT strategy, doc_id, count(DISTINCT chunk_id) AS c FROM chunks GROUP BY ALL), x AS (SELECT strategy, list_sort(list(c)) AS l, count(*) AS n, count(*) FILTER (c <= 50) AS k FROM p GROUP BY strategy)
SELECT strategy, n AS documents, l[n // 2 + 1] AS median_chunks, round(k / n, 6) AS share_within FROM x""")
def agg5_candidate_pool(s: SparkSession, d: str) -> DataFrame:
    return ablation.candidate_pool(table(s, d, "chunks"))


_MARGIN = r"regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\d+', '#', 'g')"
_MARGINS = f"""b AS (SELECT DISTINCT doc_id, block_id, block_type, page, text, char_start, char_end FROM blocks), mb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY char_start, char_end, block_id) AS f, row_number() OVER (PARTITION BY doc_id, page ORDER BY char_start DESC, char_end DESC, block_id DESC) AS l FROM b),
kp AS (SELECT DISTINCT doc_id, page, {_MARGIN} AS key FROM mb WHERE length(text) <= 200 AND (f = 1 OR l = 1)), ap AS (SELECT doc_id, count(DISTINCT page) AS a FROM b GROUP BY doc_id),
mg AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM kp GROUP BY ALL), ok AS (SELECT mg.doc_id, key, pages FROM mg JOIN ap USING (doc_id) WHERE pages >= greatest(2, ceil(a * 0.5)))"""


@query(f"WITH {_MARGINS} SELECT doc_id, key, pages FROM ok")
def agg6_repeated_margins(s: SparkSession, d: str) -> DataFrame:
    return ingest.repeated_margins(table(s, d, "blocks").dropDuplicates(["block_id"]))


@query(rf"""WITH {_MARGINS} SELECT block_type, count(*) AS blocks FROM b WHERE NOT regexp_matches(text, '(?i)^(?:page\s*)?[-–—]?\s*\d+\s*[-–—]?$')
AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = b.doc_id AND ok.key = {_MARGIN.replace("(text", "(b.text")}) GROUP BY block_type""")
def flt7_without_margins(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks").dropDuplicates(["block_id"])
    return ingest.drop_margins(b, ingest.repeated_margins(b)).groupBy("block_type").agg(F.count("*").alias("blocks"))


@query("""SELECT component, count(*) AS n, round(median(ms), 4) AS median_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM (SELECT e.key AS component, e.value AS ms FROM (SELECT unnest(map_entries(latency_ms)) AS e FROM
(SELECT request_id, any_value(latency_ms) AS latency_ms FROM ask_responses GROUP BY request_id))) GROUP BY component""")
def agg26_latency(s: SparkSession, d: str) -> DataFrame:
    r = ablation.latency(table(s, d, "ask_responses").dropDuplicates(["request_id"]))
    return r.withColumn("median_ms", F.round("median_ms", 4)).withColumn("p95_ms", F.round("p95_ms", 4))


# ---------- chunkers, offsets, windows ----------


@query(r"""WITH d AS (SELECT DISTINCT doc_id, full_text FROM contracts WHERE full_text <> ''), t AS (SELECT doc_id, string_split(full_text, chr(10) || chr(10)) AS l FROM d), p AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM t),
o AS (SELECT doc_id, pos, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM p)
SELECT doc_id, pos, text, char_start, char_start + length(text) AS char_end FROM o WHERE text <> ''""")
def win7_text_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the contracts' texts with their running offsets."""
    return ingest.text_blocks(table(s, d, "contracts").dropDuplicates(["doc_id"]))


@query("""WITH b AS (SELECT DISTINCT doc_id, block_id, text, char_start, char_end FROM blocks) SELECT count(*) AS blocks, count(*) FILTER (full_text IS NULL OR substr(full_text, char_start + 1, char_end - char_start) <> text) AS broken FROM b LEFT JOIN contracts USING (doc_id)""")
def chk0_offsets(s: SparkSession, d: str) -> DataFrame:
    b, c = table(s, d, "blocks").dropDuplicates(["block_id"]), table(s, d, "contracts").dropDuplicates(["doc_id"])
    return b.agg(F.count("*").alias("blocks")).crossJoin(chunking.validate_blocks(b, c).agg(F.count("*").alias("broken")))


_TOKENS = r"""x AS (SELECT doc_id, regexp_extract_all(full_text, '\S+') AS tk, regexp_split_to_array(full_text, '\S+') AS gp FROM (SELECT DISTINCT doc_id, full_text FROM contracts WHERE full_text IS NOT NULL)),
e AS (SELECT doc_id, generate_subscripts(tk, 1) - 1 AS i, unnest(tk) AS t, unnest(gp[1:len(tk)]) AS g FROM x WHERE len(tk) > 0),
o AS MATERIALIZED (SELECT doc_id, i, length(t) AS tl, sum(length(t) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS e, count(*) OVER (PARTITION BY doc_id) AS n FROM e),
w AS (SELECT *, CASE WHEN n <= 512 THEN 0 ELSE ceil((n - 512) / 448) END AS last FROM o), f AS (SELECT doc_id, i // 448 AS chunk_index, e - tl AS s, i AS a, n FROM w WHERE i % 448 = 0 AND i // 448 <= last),
fw AS (SELECT f.doc_id, f.chunk_index, f.s::BIGINT AS char_start, o.e::BIGINT AS char_end, o.i - f.a + 1 AS token_count FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = least(f.a + 511, f.n - 1))"""


@query(f"WITH {_TOKENS} SELECT * FROM fw")
def chk1_fixed(s: SparkSession, d: str) -> DataFrame:
    """Windows of 512 tokens that share 64."""
    return chunking.fixed_windows(table(s, d, "contracts").dropDuplicates(["doc_id"]))


@query()
def chk2_sentence_windows(s: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_windows(table(s, d, "blocks"), table(s, d, "contracts"))


_PACKED = r"""b AS (SELECT DISTINCT doc_id, block_id, block_type, text, char_start, char_end FROM blocks WHERE doc_id IN (SELECT doc_id FROM contracts)),
l AS (SELECT *, CASE WHEN block_type = 'heading' AND coalesce(lag(block_type) OVER w, 'heading') <> 'heading' THEN 1 ELSE 0 END AS o FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end, block_id)),
sx AS (SELECT *, (sum(o) OVER (PARTITION BY doc_id ORDER BY char_start, char_end, block_id ROWS UNBOUNDED PRECEDING))::BIGINT AS sec, regexp_extract_all(text, '\S+') AS tk, regexp_split_to_array(text, '\S+') AS gp FROM l),
tt AS MATERIALIZED (SELECT *, len(tk) AS n, row_number() OVER w AS i, (sum(len(tk)) OVER w)::BIGINT AS tb FROM sx WHERE len(tk) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end, block_id)),
t AS MATERIALIZED (SELECT doc_id, i, sec, n, tb, block_type = 'heading' AS hd FROM tt),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, -1::BIGINT AS sec, NULL::BIGINT AS a, NULL::BIGINT AS b, true AS heads, []::STRUCT(s BIGINT, e BIGINT)[] AS done FROM t UNION ALL
SELECT doc_id, i, sec, CASE WHEN fits THEN begin WHEN cut THEN NULL ELSE ta END, CASE WHEN cut THEN NULL ELSE tb END, CASE WHEN fits THEN heads AND hd WHEN cut THEN true ELSE hd END,
CASE WHEN fits THEN done WHEN cut THEN list_concat(done, [{'s': x, 'e': least(x + 512, tb)} FOR x IN range(begin, tb, 512)]) ELSE list_append(done, {'s': begin, 'e': b}) END
FROM (SELECT *, tb - begin <= 512 AS fits, tb - begin > 512 AND (n > 512 OR heads) AS cut FROM (SELECT *, coalesce(a, ta) AS begin FROM (SELECT t.doc_id, t.i, t.sec, t.n, t.tb - t.n AS ta, t.tb, t.hd, CASE WHEN t.sec = r.sec THEN r.a END AS a, CASE WHEN t.sec = r.sec THEN r.b END AS b, t.sec <> r.sec OR r.heads AS heads,
CASE WHEN t.sec <> r.sec AND r.a IS NOT NULL THEN list_append(r.done, {'s': r.a, 'e': r.b}) ELSE r.done END AS done FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + 1)))),
fin AS (SELECT doc_id, CASE WHEN a IS NULL THEN done ELSE list_append(done, {'s': a, 'e': b}) END AS done FROM r WHERE i = (SELECT max(i) FROM t WHERE t.doc_id = r.doc_id)),
ex0 AS (SELECT doc_id, generate_subscripts(done, 1) - 1 AS chunk_index, unnest(done) AS d FROM fin), ex AS MATERIALIZED (SELECT doc_id, chunk_index, d.s AS s, d.e - 1 AS z, d.e - d.s AS token_count FROM ex0), tx AS (SELECT doc_id, tb - n AS ta, char_start, generate_subscripts(tk, 1) - 1 AS k, unnest(tk) AS w, unnest(gp[1:len(tk)]) AS g FROM tt),
tp AS MATERIALIZED (SELECT doc_id, ta + k AS gi, char_start + (sum(length(w) + length(g)) OVER (PARTITION BY doc_id, ta ORDER BY k))::BIGINT AS e, length(w) AS n FROM tx), pl AS MATERIALIZED (SELECT doc_id, list(e - n ORDER BY gi) AS ss, list(e ORDER BY gi) AS es FROM tp GROUP BY doc_id)"""


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, chunk_index, ss[s + 1] AS char_start, es[z + 1] AS char_end, token_count FROM ex JOIN pl USING (doc_id)")
def chk3_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.section_chunks(table(s, d, "blocks"), table(s, d, "contracts"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, doc_id, char_start, char_end FROM chunks WHERE strategy = 'fixed'), b AS (SELECT DISTINCT block_id, doc_id, page, block_type, section_path, char_start, char_end FROM blocks),
m AS (SELECT chunk_id, page, block_type, section_path AS p FROM c JOIN b ON c.doc_id = b.doc_id AND b.char_start < c.char_end AND b.char_end > c.char_start), g AS (SELECT chunk_id, min(page) AS page_start, max(page) AS page_end, bool_or(block_type = 'table') AS has_table, min(p) AS lo, max(p) AS hi FROM m GROUP BY chunk_id)
SELECT chunk_id, page_start, page_end, has_table, array_to_string(lo[1:len([i FOR i IN range(1, least(len(lo), len(hi)) + 1) IF lo[1:i] = hi[1:i]])], ' > ') AS section FROM g""")
def chk4_roll_up(s: SparkSession, d: str) -> DataFrame:
    """Pages, tables and common section path of the blocks under each fixed chunk."""
    c = _fixed(s, d).select("doc_id", F.col("chunk_id").alias("chunk_index"), "char_start", "char_end")
    r = chunking.roll_up(c, table(s, d, "blocks"))
    return r.select(F.col("chunk_index").alias("chunk_id"), "page_start", "page_end", "has_table", F.array_join("section_path", " > ").alias("section"))


@query("""WITH b AS (SELECT DISTINCT doc_id, block_id, block_type, char_start, char_end FROM blocks), l AS (SELECT *, CASE WHEN block_type = 'heading' AND coalesce(lag(block_type) OVER w, 'heading') <> 'heading' THEN 1 ELSE 0 END AS o FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end, block_id))
SELECT doc_id, block_id, (sum(o) OVER (PARTITION BY doc_id ORDER BY char_start, char_end, block_id ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM l""")
def win4_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.sections(table(s, d, "blocks").dropDuplicates(["block_id"])).select("doc_id", "block_id", "section")


@query("""WITH b AS (SELECT DISTINCT doc_id, block_id, char_start AS s, char_end AS e FROM blocks), u AS (SELECT doc_id, block_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, block_id) - 1 AS unit FROM b)
SELECT doc_id, block_id, min(s) OVER w AS context_start, max(e) OVER w AS context_end FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def win3_neighbourhoods(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks").dropDuplicates(["block_id"]).select("doc_id", "block_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    u = b.withColumn("unit", F.row_number().over(W.partitionBy("doc_id").orderBy("s", "e", "block_id")) - 1)
    return chunking.neighbourhoods(u).select("doc_id", "block_id", "context_start", "context_end")


@query("""WITH c AS (SELECT DISTINCT chunk_id, doc_id, char_start, char_end, context_text FROM chunks WHERE context_text <> ''), x AS (SELECT c.*, greatest(1, char_start - length(context_text) + 1) AS f, full_text FROM c JOIN contracts USING (doc_id)),
y AS (SELECT *, CASE WHEN instr(substr(full_text, f), context_text) > 0 THEN instr(substr(full_text, f), context_text) + f - 2 ELSE -1 END AS pos FROM x)
SELECT chunk_id, CASE WHEN pos >= 0 AND pos <= char_start AND char_end <= pos + length(context_text) THEN pos ELSE char_start END::BIGINT AS s, CASE WHEN pos >= 0 AND pos <= char_start AND char_end <= pos + length(context_text) THEN pos + length(context_text) ELSE char_end END::BIGINT AS e FROM y""")
def prj3_shown_range(s: SparkSession, d: str) -> DataFrame:
    """Range of the text shown for each chunk with a context window."""
    c = retrieval.distinct_chunks(table(s, d, "chunks")).filter("context_text <> ''")
    f = c.select(F.lit("all").alias("config_id"), F.col("chunk_id").alias("qid"), "chunk_id")
    r = triage.shown_ranges(f, c, table(s, d, "contracts").dropDuplicates(["doc_id"]))
    return r.select(F.col("qid").alias("chunk_id"), F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))


# ---------- text ----------


@query(r"SELECT DISTINCT block_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized, len(regexp_extract_all(text, '\S+')) AS tokens FROM blocks")
def txt4_normalize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "blocks").select("block_id", T.normalize("text").alias("normalized"), T.token_count("text").alias("tokens")).distinct()


_CW = "[" + ", ".join(f"'{w}'" for w in T.CONTENT_STOPWORDS) + "]"


@query(f"SELECT qid, len(w) AS words, array_to_string(list_sort(w), ' ') AS content FROM (SELECT DISTINCT qid, list_distinct([x FOR x IN regexp_extract_all(lower(question), '[a-z]+') IF length(x) > 2 AND NOT list_contains({_CW}, x)]) AS w FROM questions)")
def txt7_content_words(s: SparkSession, d: str) -> DataFrame:
    w = T.content_words("question")
    return _questions(s, d).select("qid", F.size(w).cast("bigint").alias("words"), F.array_join(F.array_sort(w), " ").alias("content"))


_CITES = r"""a AS (SELECT DISTINCT request_id, answer, abstained FROM ask_responses), g AS (SELECT request_id, unnest(regexp_extract_all(coalesce(answer, ''), '\[(\d+(?:\s*,\s*\d+)*)\]', 1)) AS g FROM a),
n AS (SELECT DISTINCT request_id, unnest([x::BIGINT FOR x IN regexp_split_to_array(g, '\s*,\s*')]) AS n FROM g), ex AS (SELECT DISTINCT request_id, n::BIGINT AS n, chunk_id, text FROM ask_citations)"""


def _cited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(s, d, "ask_responses").select("request_id", "answer", "abstained").dropDuplicates(["request_id"])
    return a, a.select("request_id", F.explode(T.citations("answer")).alias("n"))


@query(f"WITH {_CITES} SELECT request_id, n, ex.n IS NOT NULL AS valid, chunk_id FROM n LEFT JOIN ex USING (request_id, n)".replace("ex.n IS NOT NULL", "chunk_id IS NOT NULL"))
def txt17_citations(s: SparkSession, d: str) -> DataFrame:
    """Every cited number with the excerpt it points at, if any."""
    c = table(s, d, "ask_citations").select("request_id", F.col("n").cast("bigint").alias("n"), "chunk_id").distinct()
    return _cited(s, d)[1].join(c, ["request_id", "n"], "left").select("request_id", "n", F.col("chunk_id").isNotNull().alias("valid"), "chunk_id")


@query(f"""WITH {_CITES}, v AS (SELECT request_id, count(chunk_id) AS valid, count(*) - count(chunk_id) AS invalid FROM n LEFT JOIN ex USING (request_id, n) GROUP BY request_id)
SELECT a.request_id, coalesce(valid, 0) AS valid, coalesce(invalid, 0) AS invalid, round(CASE WHEN coalesce(valid + invalid, 0) > 0 THEN valid / (valid + invalid) WHEN abstained THEN NULL ELSE 0 END, 6)::DOUBLE AS validity FROM a LEFT JOIN v USING (request_id)""")
def agg22_citation_validity(s: SparkSession, d: str) -> DataFrame:
    return agg22_citation_validity_raw(s, d).withColumn("validity", F.round("validity", 6))


def agg22_citation_validity_raw(s: SparkSession, d: str) -> DataFrame:
    a, _ = _cited(s, d)
    v = txt17_citations(s, d).groupBy("request_id").agg(F.count("chunk_id").alias("valid"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"))
    j = a.join(v, "request_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("valid", "invalid")})
    return j.select("request_id", "valid", "invalid", judge.citation_validity(F.col("answer"), F.col("valid"), F.col("invalid"), F.col("abstained")).alias("validity"))


_NUMS = r"[regexp_replace(replace(x, ',', ''), '\.00$', '') FOR x IN regexp_extract_all({c}, '\d[\d,]*(?:\.\d+)?')]"
_NUMWORDS = "[x FOR x IN [" + ", ".join(rf"CASE WHEN regexp_matches({{c}}, '(?i)\b{w}\b') THEN '{n}' END" for w, n in T.NUMBER_WORDS.items()) + "] IF x IS NOT NULL]"


@query(rf"""WITH {_CITES}, t AS (SELECT request_id, string_agg(text, ' ' ORDER BY n) AS ex FROM n JOIN ex USING (request_id, n) GROUP BY request_id), x AS (SELECT a.request_id, regexp_replace(coalesce(answer, ''), '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g') AS s, coalesce(ex, '') AS ex FROM a LEFT JOIN t USING (request_id)),
y AS (SELECT request_id, list_distinct({_NUMS.format(c="s")}) AS a, list_concat({_NUMS.format(c="ex")}, {_NUMWORDS.format(c="ex")}) AS b FROM x)
SELECT request_id, array_to_string(list_sort([v FOR v IN a IF NOT list_contains(b, v)]), ' ') AS missing FROM y""")
def txt10_unsupported_numbers(s: SparkSession, d: str) -> DataFrame:
    """Figures of each answer that none of its cited excerpts mentions."""
    a, n = _cited(s, d)
    c = table(s, d, "ask_citations").select("request_id", F.col("n").cast("bigint").alias("n"), "text").distinct()
    per = n.join(c, ["request_id", "n"]).groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("ex"))
    j = a.join(per, "request_id", "left")
    m = T.unsupported_numbers(T.strip_citations(F.coalesce("answer", F.lit(""))), F.coalesce("ex", F.lit("")))
    return j.select("request_id", F.array_join(m, " ").alias("missing"))


_DECLINES_SQL = repr(T.DECLINES).replace("doesn't", "doesn''t").replace("don't", "don''t").replace("didn't", "didn''t").replace(chr(92) * 2, chr(92)).replace('"', "'")


@query(rf"""WITH a AS (SELECT request_id, any_value(model) AS model, trim(coalesce(any_value(answer), ''), chr(32)) AS t, coalesce(any_value(abstained), false) AS f FROM ask_responses GROUP BY request_id),
x AS (SELECT model, f OR t = '' OR regexp_matches(regexp_split_to_array(regexp_replace(t, '([.!?])\s+([A-Z("''“])', '\1' || chr(1) || '\2', 'g'), chr(1))[1], {_DECLINES_SQL}) AS declined FROM a)
SELECT model, declined, count(*) AS answers FROM x GROUP BY ALL""")
def txt11_declines(s: SparkSession, d: str) -> DataFrame:
    """Answers that refuse, by flag or by their first sentence, counted by model."""
    a = table(s, d, "ask_responses").dropDuplicates(["request_id"]).withColumn("declined", T.declines("answer", "abstained"))
    return a.groupBy("model", "declined").agg(F.count("*").alias("answers"))


@query("SELECT DISTINCT sha256(text) AS key, md5(text) AS short FROM chunks WHERE text IS NOT NULL")
def txt18_hashes(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunks").filter("text is not null")
    return t.select(files.embedding_key("text").alias("key"), F.md5("text").alias("short")).distinct()


# ---------- joins, sampling, selection ----------


@query("""WITH q AS (SELECT DISTINCT qid, contract_name FROM questions WHERE contract_name IS NOT NULL), c AS (SELECT DISTINCT doc_id, title FROM contracts WHERE title IS NOT NULL)
SELECT qid, c.doc_id FROM q JOIN c ON regexp_replace(lower(contract_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(title), '[^a-z0-9]', '', 'g')""")
def join3_names(s: SparkSession, d: str) -> DataFrame:
    """Questions joined to contracts on the normalised name."""
    q = _questions(s, d).filter("contract_name is not null").select("qid", T.match_key("contract_name").alias("k"))
    return q.join(table(s, d, "contracts").filter("title is not null").select("doc_id", T.match_key("title").alias("k")).distinct(), "k").select("qid", "doc_id")


@query(f"""WITH {_LABELLED}, ck AS (SELECT config_id, qid, sha256(concat_ws('::', qid, string_agg(chunk_id, '|' ORDER BY rank))) AS content_key FROM ls GROUP BY config_id, qid)
SELECT content_key, count(*) AS settings FROM ck GROUP BY content_key""")
def join19_content_reuse(s: SparkSession, d: str) -> DataFrame:
    """How many settings one answer can serve: those with the same question and the same chunks in the same order."""
    bm = materialise(_bm25_list(s, d, 8), "bm25")
    lists = bm.withColumn("config_id", F.lit("bm25")).unionByName(retrieval.rerank(bm, _questions(s, d), _fixed(s, d)).withColumn("config_id", F.lit("rerank")))
    return ablation.content_key(lists).groupBy("content_key").agg(F.count("*").alias("settings"))


@query("""WITH d AS (SELECT DISTINCT doc_id FROM contracts), h AS (SELECT doc_id, row_number() OVER (ORDER BY concat('0x', substr(md5(concat('0~', doc_id)), 1, 8))::BIGINT, doc_id) AS r, count(*) OVER () AS n FROM d)
SELECT doc_id, CASE WHEN r <= round_even(n * 0.3, 0) THEN 'dev' ELSE 'test' END AS split FROM h""")
def smp2_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.split_documents(table(s, d, "contracts"))


_STRATA = """d AS (SELECT DISTINCT doc_id, contract_type AS t FROM contracts WHERE contract_type IS NOT NULL), c AS (SELECT t, count(*) AS n FROM d GROUP BY t), z AS (SELECT *, least(40, sum(n) OVER ()) AS size, count(*) OVER () AS strata, 40 * n / sum(n) OVER () AS quota FROM c),
a0 AS (SELECT *, least(n, greatest(floor(quota), CASE WHEN size >= strata THEN 1 ELSE 0 END)) AS got FROM z), a1 AS (SELECT *, size - sum(got) OVER () AS open FROM a0),
a2 AS (SELECT *, row_number() OVER (ORDER BY quota - got DESC, t) AS up, row_number() OVER (ORDER BY got <= CASE WHEN size >= strata THEN 1 ELSE 0 END, quota - got, t) AS down FROM a1),
al AS (SELECT t, got + CASE WHEN open > 0 AND up <= open THEN 1 WHEN open < 0 AND down <= -open THEN -1 ELSE 0 END AS take FROM a2)"""


@query(f"""WITH {_STRATA}, r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY concat('0x', substr(md5(concat('0~', doc_id)), 1, 8))::BIGINT, doc_id) AS r FROM d) SELECT doc_id, t AS contract_type FROM r JOIN al USING (t) WHERE r <= take""")
def smp1_stratified(s: SparkSession, d: str) -> DataFrame:
    """A sample of contracts in proportion to their types."""
    return sampling.stratified(table(s, d, "contracts").select("doc_id", "contract_type").distinct(), "contract_type", "doc_id", 40)


_POS = f"{_PLACED}, ct AS (SELECT DISTINCT qid, category FROM questions), ps AS (SELECT DISTINCT doc_id, category, char_start AS position FROM pl JOIN ct USING (qid))"


def _positions(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "questions").select("qid", "category").distinct()
    return _placed(s, d).join(c, "qid").select("doc_id", "category", F.col("char_start").alias("position")).distinct()


@query(f"""WITH {_POS}, pr AS (SELECT a.doc_id, a.category AS category_a, b.category AS category_b, min(abs(a.position - b.position)) AS distance FROM ps a JOIN ps b ON a.doc_id = b.doc_id AND a.category < b.category GROUP BY ALL
UNION ALL SELECT doc_id, category, category, max(position) - min(position) FROM ps GROUP BY doc_id, category HAVING count(*) >= 2) SELECT * FROM pr WHERE distance > 1500""")
def sel3_far_apart(s: SparkSession, d: str) -> DataFrame:
    return sampling.far_apart(_positions(s, d))


_SPAN_ROWS = f"{_SPANS}, ct AS (SELECT DISTINCT qid, category FROM questions), st AS (SELECT DISTINCT doc_id, category, span AS text FROM sp JOIN ct USING (qid) WHERE doc_id IS NOT NULL)"


def _span_rows(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "questions").select("qid", "category").distinct()
    return labels.spans_of(table(s, d, "questions")).filter("doc_id is not null").join(c, "qid").select("doc_id", "category", F.col("span").alias("text")).distinct()


@query(f"""WITH {_SPAN_ROWS} SELECT DISTINCT doc_id, category FROM st WHERE regexp_matches(text, '{sampling.AMOUNT}') AND NOT regexp_matches(text, '{sampling.REDACTED}')""")
def sel3_numeric(s: SparkSession, d: str) -> DataFrame:
    return sampling.numeric_candidates(_span_rows(s, d))


@query(f"WITH {_SPAN_ROWS} SELECT doc_id, category, text FROM st t WHERE NOT EXISTS (SELECT 1 FROM st o WHERE o.doc_id = t.doc_id AND o.category = t.category AND o.text <> t.text AND contains(o.text, t.text))")
def join20_uncontained(s: SparkSession, d: str) -> DataFrame:
    return sampling.drop_contained(_span_rows(s, d))


@query(f"""WITH {_PLACED}, b AS (SELECT DISTINCT doc_id, block_id, block_type, text, char_start, char_end FROM blocks), ev AS (SELECT DISTINCT qid, block_id FROM pl JOIN b ON b.doc_id = pl.doc_id AND b.char_start < pl.char_end AND b.char_end > pl.char_start),
q AS (SELECT DISTINCT qid, doc_id, answerable FROM questions WHERE doc_id IS NOT NULL), k AS (SELECT qid, block_id, answerable, row_number() OVER (PARTITION BY qid ORDER BY concat('0x', substr(md5(concat('0~', qid, '~', block_id)), 1, 8))::BIGINT, block_id) AS n
FROM q JOIN b USING (doc_id) WHERE block_type <> 'heading' AND length(text) >= 80 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.qid = q.qid AND ev.block_id = b.block_id)) SELECT qid, block_id, n FROM k WHERE n <= CASE WHEN answerable THEN 3 ELSE 5 END""")
def chk6_distractors(s: SparkSession, d: str) -> DataFrame:
    """Blocks of each question's contract that aren't its evidence, in hash order."""
    b = table(s, d, "blocks").dropDuplicates(["block_id"])
    met = _placed(s, d).join(b.select("doc_id", "block_id", F.col("char_start").alias("s"), F.col("char_end").alias("e")), "doc_id")
    return sampling.distractors(b, met.filter("s < char_end and e > char_start").select("qid", "block_id"), _questions(s, d))


# ---------- comparing settings ----------


def _alpha_scores(s: SparkSession, d: str) -> DataFrame:
    bm, dn = materialise(_bm25_list(s, d, 50), "bm25"), materialise(_dense_list(s, d), "dense")
    lists = None
    for alpha in (0.0, 0.25, 0.5, 0.75, 1.0):
        part = retrieval.weighted(bm, dn, alpha, 8).withColumn("config_id", F.lit(f"{alpha:g}"))
        lists = part if lists is None else lists.unionByName(part)
    held = materialise(labels.relevant_chunks(_placed(s, d), table(s, d, "chunks").filter("strategy = 'fixed'")), "held")
    return metrics.score_lists(materialise(lists, "lists"), held)


_ALPHAS = f"""{_bm25('question', _IN_DOC, 50)}, {_DENSE}, l0 AS (SELECT * FROM bm UNION ALL SELECT * FROM dn), m0 AS (SELECT qid, chunk_id, stage, score, min(score) OVER (PARTITION BY qid, stage) AS lo, max(score) OVER (PARTITION BY qid, stage) AS hi FROM l0),
x0 AS (SELECT alpha, qid, chunk_id, sum(CASE WHEN stage = 'dense' THEN alpha ELSE 1 - alpha END * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS score FROM m0, (SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS alpha) GROUP BY ALL),
ls AS (SELECT * FROM (SELECT replace(alpha::VARCHAR, '.0', '') AS config_id, qid, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(score, 12) DESC, chunk_id) AS rank, chunk_id FROM x0) WHERE rank <= 8), {_SCORES},
sq AS (SELECT DISTINCT qid, split FROM questions), ss AS (SELECT sc2.*, split FROM sc2 JOIN sq USING (qid))"""


@query(f"""WITH {_ALPHAS}, m9 AS (SELECT config_id::DOUBLE AS alpha, round(avg(mrr), 4) AS mrr, round(avg(context_recall), 4) AS recall FROM ss WHERE split = 'dev' GROUP BY config_id)
SELECT 'fixed' AS chunking, '{MODEL}' AS model, alpha, mrr, recall FROM m9 ORDER BY mrr DESC, recall DESC, alpha LIMIT 1""")
def agg25_tune_alpha(s: SparkSession, d: str) -> DataFrame:
    """Best weight of the dense list on dev questions."""
    x = _alpha_scores(s, d).join(_questions(s, d).select("qid", "split"), "qid")
    return ablation.tune_alpha(x.select("split", F.lit("fixed").alias("chunking"), F.lit(MODEL).alias("model"), F.col("config_id").cast("double").alias("alpha"), "mrr", F.col("context_recall").alias("recall")))


@query(f"WITH {_ALPHAS} SELECT config_id, split, count(*) AS n, round(avg(context_recall), 4) AS context_recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg_at_10), 4) AS ndcg_at_10 FROM ss GROUP BY ALL")
def agg24_config_summary(s: SparkSession, d: str) -> DataFrame:
    return ablation.summarise(_alpha_scores(s, d), _questions(s, d))


@query(f"""WITH {_ALPHAS}, g0 AS (SELECT config_id, config_id::DOUBLE AS o, list((qid, context_recall, mrr) ORDER BY qid)::VARCHAR AS sig, round(avg(context_recall), 10) AS cr, round(avg(mrr), 10) AS m FROM ss WHERE split = 'dev' GROUP BY config_id),
g1 AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY o) AS r, count(*) OVER (PARTITION BY sig) - 1 AS folded FROM g0) SELECT config_id, row_number() OVER (ORDER BY cr DESC, m DESC, o) AS place, folded FROM g1 WHERE r = 1""")
def top2_select_configs(s: SparkSession, d: str) -> DataFrame:
    """Settings chosen on dev, those with equal scores on every question folded."""
    x = _alpha_scores(s, d).join(_questions(s, d).filter("split = 'dev'").select("qid"), "qid")
    return ablation.select_configs(x, x.select("config_id", F.col("config_id").cast("double").alias("grid_order")).distinct())


@query("""WITH c AS (SELECT unnest(['fixed', 'section']) AS ch), v AS (SELECT * FROM (VALUES ('bm25', 'nodense', 'none'), ('nosparse', 'clause-small', 'none'), ('bm25', 'clause-small', 'rrf'), ('bm25', 'clause-small', 'weighted0.5')) t(s, d, f)),
r AS (SELECT unnest(['norerank', 'overlap']) AS rr), x AS (SELECT unnest(['doc', 'corpus']) AS sc) SELECT concat_ws('__', ch, s, d, f, rr, 'k8', sc) AS config_id, ch AS chunking, sc = 'doc' AS doc_filter FROM c, v, r, x
UNION ALL SELECT concat_ws('__', ch, s, d, f, 'norerank', 'k8', 'doc', 'rawq'), ch, true FROM c, v WHERE f = 'none'""")
def join13_grid(s: SparkSession, d: str) -> DataFrame:
    """Every setting of a grid, by way of its id and back."""
    rows = [retrieval.parse_config(c.config_id) for c in retrieval.grid(["fixed", "section"], [MODEL], ["overlap"])]
    return s.createDataFrame([(c.config_id, c.chunking, c.doc_filter) for c in rows], "config_id string, chunking string, doc_filter boolean")


# ---------- judging and triage ----------


@query()
def jdg_statements(s: SparkSession, d: str) -> DataFrame:
    """Every clause of every answer, checked against the excerpts it cites."""
    st = judge.answer_statements(table(s, d, "ask_responses"))
    c = judge.check_statements(judge.cited_excerpts(st, table(s, d, "ask_citations")))
    return c.select("request_id", "pos", "statement", "valid", "supported")


@query()
def jdg_faithfulness(s: SparkSession, d: str) -> DataFrame:
    st = judge.answer_statements(table(s, d, "ask_responses"))
    return judge.faithfulness(judge.check_statements(judge.cited_excerpts(st, table(s, d, "ask_citations"))))


_TRIAGE = f"""{_bm25(_SCOPED_Q, _IN_DOC, 50)}, {_DENSE}, {_RRF}, {_rerank('fu', _SCOPED_Q)},
al AS (SELECT * FROM bm UNION ALL SELECT * FROM dn UNION ALL SELECT * FROM fu UNION ALL SELECT * FROM rr UNION ALL SELECT qid, 'final', rank, chunk_id, score FROM rr WHERE rank <= 8), {_PLACED}, h AS (SELECT qid, span_index, chunk_id FROM pl JOIN c USING (doc_id) WHERE {_COVERS}),
kk AS (SELECT qid, count(*) AS k FROM al WHERE stage = 'final' GROUP BY qid), tr AS (SELECT pl.qid, pl.span_index, count(h.chunk_id) > 0 AS cov, min(CASE WHEN al.stage IN ('bm25', 'dense') THEN al.rank END) AS cr, min(CASE WHEN al.stage = 'fusion' AND al.rank <= k THEN al.rank END) AS pr, min(CASE WHEN al.stage = 'final' THEN al.rank END) AS fr
FROM pl JOIN kk ON kk.qid = pl.qid LEFT JOIN h ON h.qid = pl.qid AND h.span_index = pl.span_index LEFT JOIN al ON al.qid = pl.qid AND al.chunk_id = h.chunk_id GROUP BY pl.qid, pl.span_index),
ps AS (SELECT qid, count(*) AS spans, bool_or(fr IS NOT NULL) AS any_d, bool_or(cov) AS any_c, bool_or(cr IS NOT NULL) AS any_r, bool_or(pr IS NOT NULL) AS any_p, bool_and(fr IS NOT NULL) AS all_d, avg((fr IS NOT NULL)::INT) AS recall FROM tr GROUP BY qid),
qq AS (SELECT DISTINCT qid, qtype, answerable FROM questions), an AS (SELECT qq.*, kk.qid IS NULL AS declined, CASE WHEN EXISTS (SELECT 1 FROM al JOIN h ON h.qid = al.qid AND h.chunk_id = al.chunk_id WHERE al.stage = 'final' AND al.rank = 1 AND al.qid = qq.qid) THEN 1.0 ELSE 0.0 END::DOUBLE AS correctness FROM qq LEFT JOIN kk ON kk.qid = qq.qid),
tg AS (SELECT '{PIPELINE.config_id}' AS config_id, an.qid, qtype, answerable, CASE WHEN NOT answerable THEN CASE WHEN declined THEN 'correct' ELSE 'answered_unanswerable' END WHEN correctness = 1 THEN 'correct' WHEN spans IS NULL THEN 'lost_in_chunking' WHEN NOT any_d AND NOT any_c THEN 'lost_in_chunking' WHEN NOT any_d AND NOT any_r THEN 'retrieval_miss'
WHEN NOT any_d AND any_p THEN 'reranker_demotion' WHEN NOT any_d THEN 'ranking_miss' WHEN NOT all_d THEN 'partial_evidence' WHEN declined THEN 'refused_with_evidence' ELSE 'misread_evidence' END AS category, correctness, declined AS abstained, CASE WHEN answerable AND spans IS NOT NULL THEN recall END AS final_recall FROM an LEFT JOIN ps ON ps.qid = an.qid)"""


@query(f"WITH {_TRIAGE} SELECT config_id, qid, qtype, answerable, category, correctness, abstained, round(final_recall, 6) AS final_recall, round(final_recall, 6) AS delivered_recall FROM tg")
def tri_triage(s: SparkSession, d: str) -> DataFrame:
    """First failing stage over the hybrid pipeline's lists, where a question counts as answered right if the first chunk holds evidence."""
    return _triaged(s, d).drop("faithfulness").withColumns({c: F.round(c, 6) for c in ("final_recall", "delivered_recall")})


def _triaged(s: SparkSession, d: str) -> DataFrame:
    lists = materialise(_pipeline(s, d), "lists")
    chunks, placed = _fixed(s, d), materialise(_placed(s, d), "placed")
    final = lists.filter("stage = 'final'")
    held = materialise(labels.relevant_chunks(placed, table(s, d, "chunks").filter("strategy = 'fixed'")), "held")
    traces = triage.trace_spans(lists, held, placed, triage.shown_ranges(final, chunks, table(s, d, "contracts").dropDuplicates(["doc_id"])))
    right = final.filter("rank = 1").join(held.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_semi").select("qid").withColumn("right", F.lit(1.0))
    q = _questions(s, d).select("qid", "qtype", "answerable").join(final.select("qid").distinct().withColumn("listed", F.lit(True)), "qid", "left").join(right, "qid", "left")
    rows = q.select(F.lit(PIPELINE.config_id).alias("config_id"), "qid", "qtype", "answerable", F.col("listed").isNull().alias("declined"), F.coalesce("right", F.lit(0.0)).alias("correctness"), F.lit(None).cast("double").alias("faithfulness"), F.lit(True).alias("reranked"))
    return materialise(triage.triage(rows, traces), "triage")


_STAGE = "CASE WHEN category IN ('lost_in_chunking', 'retrieval_miss', 'ranking_miss', 'reranker_demotion', 'partial_evidence') THEN 'retrieval' ELSE 'generation' END"


@query(f"""WITH {_TRIAGE}, fl AS (SELECT * FROM tg WHERE category <> 'correct') SELECT 'category' AS level, category AS name, count(*) AS failures FROM fl GROUP BY category
UNION ALL SELECT 'stage', {_STAGE}, count(*) FROM fl GROUP BY 2 UNION ALL SELECT 'qtype', qtype, count(*) FROM fl GROUP BY qtype""")
def agg27_triage_summary(s: SparkSession, d: str) -> DataFrame:
    """Failures by category, stage and question type."""
    return triage.summary(_triaged(s, d))


@query(f"""WITH {_TRIAGE} SELECT config_id, category, count(*) AS rows, NULL::DOUBLE AS final_recall, NULL::DOUBLE AS delivered_recall FROM tg GROUP BY ALL
UNION ALL SELECT config_id, 'all', count(*), round(avg(final_recall), 4), round(avg(final_recall), 4) FROM tg GROUP BY config_id""")
def agg27_by_config(s: SparkSession, d: str) -> DataFrame:
    """Categories and mean recalls of each setting."""
    return triage.summary_by_config(_triaged(s, d))


@query(f"WITH {_TRIAGE}, m AS (SELECT qid, min(qtype) AS qtype, round(avg(correctness), 4) AS mean_correctness, count(*) AS rows FROM tg WHERE answerable GROUP BY qid) SELECT * FROM m WHERE coalesce(mean_correctness, 0) <= 0.25")
def top6_hardest(s: SparkSession, d: str) -> DataFrame:
    """Questions that hardly any answer gets right."""
    return triage.hardest(_triaged(s, d))


@query(f"""WITH q AS (SELECT DISTINCT qid, question, contract_name, qtype, answerable, evidence_spans FROM questions), x AS (SELECT qtype, CASE WHEN contract_name <> '' THEN replace(question, contract_name, ' ') ELSE question END AS t, unnest(evidence_spans) AS span FROM q WHERE answerable),
w AS (SELECT qtype, list_distinct([x FOR x IN regexp_extract_all(lower(t), '[a-z]+') IF length(x) > 2 AND NOT list_contains({_CW}, x)]) AS a, list_distinct([x FOR x IN regexp_extract_all(lower(span), '[a-z]+') IF length(x) > 2 AND NOT list_contains({_CW}, x)]) AS b FROM x)
SELECT qtype, count(*) AS pieces, round(avg(len([x FOR x IN a IF list_contains(b, x)]) / len(a)), 6) AS shared_words FROM w WHERE len(a) > 0 GROUP BY qtype""")
def agg28_shared_words(s: SparkSession, d: str) -> DataFrame:
    """Share of a question's meaning words that stand in its evidence, by question type."""
    q = _questions(s, d).filter("answerable")
    text = F.when(F.coalesce("contract_name", F.lit("")) != "", F.replace("question", F.col("contract_name"), F.lit(" "))).otherwise(F.col("question"))
    x = q.select("qtype", T.content_words(text).alias("a"), F.explode("evidence_spans").alias("span")).filter(F.size("a") > 0)
    share = F.size(F.array_intersect("a", T.content_words("span"))) / F.size("a")
    return x.groupBy("qtype").agg(F.count("*").alias("pieces"), F.round(F.avg(share), 6).alias("shared_words"))


@query(rf"""WITH a AS (SELECT request_id, any_value(model) AS model, coalesce(any_value(answer), '') AS t FROM ask_responses GROUP BY request_id)
SELECT model, count(*) AS answers, count(*) FILTER (regexp_matches(t, {"'" + T.SAYS_NOT_FOUND.replace("'", "''") + "'"})) AS says_not_found, count(*) FILTER (regexp_matches(t, {"'" + T.EXTRA_DETAIL + "'"})) AS extra_detail, count(*) FILTER (contains(t, '[***]') OR contains(lower(t), 'redact')) AS redacted FROM a GROUP BY model""")
def agg28_patterns(s: SparkSession, d: str) -> DataFrame:
    """Answers that say that the text has nothing, and answers that report a redaction."""
    a = table(s, d, "ask_responses").dropDuplicates(["request_id"]).withColumn("t", F.coalesce("answer", F.lit("")))
    red = F.contains("t", F.lit("[***]")) | F.contains(F.lower("t"), F.lit("redact"))
    return a.groupBy("model").agg(F.count("*").alias("answers"), F.count(F.when(F.col("t").rlike(T.SAYS_NOT_FOUND), 1)).alias("says_not_found"), F.count(F.when(F.col("t").rlike(T.EXTRA_DETAIL), 1)).alias("extra_detail"), F.count(F.when(red, 1)).alias("redacted"))


# ---------- sources, sinks, streaming ----------


@query("SELECT DISTINCT qid, doc_id, question, answerable, len(evidence_spans) AS spans FROM questions")
def src1_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Questions written as gzip JSON lines and read back with their declared schema."""
    path = scratch_path(s, "questions")
    files.write_jsonl(table(s, d, "questions").distinct(), path, gzip=True)
    return files.read_jsonl(s, path, "question").select("qid", "doc_id", "question", "answerable", F.size("evidence_spans").cast("bigint").alias("spans"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def str1_hourly(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type; the same plan runs on a stream."""
    e = streaming.windowed_counts(table(s, d, "events"))
    return e.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM g GROUP BY user_id, k""")
def str1_sessions(s: SparkSession, d: str) -> DataFrame:
    e = streaming.sessions(table(s, d, "events"))
    return e.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")
