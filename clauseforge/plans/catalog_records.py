"""More registered queries: sources and sinks, records, selection, prompts, verdicts and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ablation, chunking, ingest, judge, metrics, models, parse, prompts, questions, retrieval, sampling, triage
from ..session import materialise, scratch_path, table
from ..sources import files
from . import catalog as C
from . import runs
from .catalog import query

# ---------- sources and sinks ----------


@query("""WITH d AS (SELECT DISTINCT doc_id FROM contracts), b AS (SELECT DISTINCT doc_id, block_id, char_start FROM blocks)
SELECT d.doc_id, count(block_id) AS blocks, arg_min(block_id, char_start) AS first_block, arg_max(block_id, char_start) AS last_block FROM d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""")
def src2_documents_blocks(s: SparkSession, d: str) -> DataFrame:
    """Documents with their blocks in order."""
    got = chunking.with_blocks(table(s, d, "contracts"), table(s, d, "blocks"))
    return got.select("doc_id", F.size("blocks").cast("bigint").alias("blocks"), F.get("blocks", F.lit(0))["block_id"].alias("first_block"), F.get("blocks", F.size("blocks") - 1)["block_id"].alias("last_block"))


@query("SELECT DISTINCT qid, coalesce(question, '') AS question, coalesce(category, '') AS category FROM questions")
def src5_csv(s: SparkSession, d: str) -> DataFrame:
    """Questions written as CSV and read back as strings."""
    path = scratch_path(s, "csv")
    q = table(s, d, "questions").select("qid", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("category", F.lit("")).alias("category")).distinct()
    q.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return files.read_csv(s, path).select("qid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "category")])


@query("""WITH q AS (SELECT DISTINCT qid, doc_id, question, evidence_spans FROM questions WHERE doc_id IS NOT NULL), a AS (SELECT doc_id AS title, qid AS qa_id, question, unnest(CASE WHEN len(evidence_spans) = 0 THEN [NULL] ELSE evidence_spans END) AS answer FROM q)
SELECT title, qa_id, question, answer, count(*) AS n FROM a GROUP BY ALL""")
def src6_nested_json(s: SparkSession, d: str) -> DataFrame:
    """Questions nested as data, paragraphs, questions and answers, written and flattened again."""
    path = scratch_path(s, "squad")
    q = table(s, d, "questions").filter("doc_id is not null").select("qid", "doc_id", "question", "evidence_spans").distinct()
    qa = F.struct(F.col("qid").alias("id"), "question", F.transform("evidence_spans", lambda x: F.struct(x.alias("text"), F.lit(0).cast("bigint").alias("answer_start"))).alias("answers"))
    per = q.groupBy("doc_id").agg(F.collect_list(qa).alias("qas"))
    art = per.select(F.array(F.struct(F.col("doc_id").alias("title"), F.array(F.struct(F.lit("").alias("context"), "qas")).alias("paragraphs"))).alias("data"))
    art.write.json(path)
    return files.read_squad(s, path, lines=True).groupBy("title", "qa_id", "question", "answer").agg(F.count("*").alias("n"))


_LISTED = r"""l AS (SELECT DISTINCT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM contracts WHERE title IS NOT NULL AND regexp_replace(lower(title), '[^a-z0-9]', '', 'g') <> ''),
f AS (SELECT DISTINCT regexp_replace(lower(doc_id), '[^a-z0-9]', '', 'g') AS fk, doc_id AS path FROM contracts UNION SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]', '', 'g')[:12], 'title/' || doc_id FROM contracts WHERE title IS NOT NULL AND doc_id < 'h')"""


@query(f"""WITH {_LISTED}, e AS (SELECT doc_id, count(*) AS n, min(path) AS path FROM l JOIN f ON key = fk GROUP BY doc_id), r AS (SELECT * FROM l WHERE doc_id NOT IN (SELECT doc_id FROM e)),
p AS (SELECT r.doc_id, count(DISTINCT path) AS n, min(path) AS path FROM r LEFT JOIN f ON fk <> '' AND (starts_with(fk, key) OR starts_with(key, fk)) GROUP BY r.doc_id)
SELECT doc_id, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS how FROM e UNION ALL SELECT doc_id, CASE WHEN n = 1 THEN path END, CASE WHEN n = 1 THEN 'prefix' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END FROM p""")
def src13_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Titles against file names, whole or cut: equal keys, else the one key that begins the other."""
    c = table(s, d, "contracts")
    listed = c.filter("title is not null").select("doc_id", T.match_key("title").alias("key")).filter("key <> ''").distinct()
    f = c.select(T.match_key("doc_id").alias("key"), F.col("doc_id").alias("path")).unionByName(
        c.filter("title is not null and doc_id < 'h'").select(F.substring(T.match_key("title"), 1, 12).alias("key"), F.concat(F.lit("title/"), "doc_id").alias("path"))
    )
    return ingest.reconcile(listed, f.distinct())


@query("""WITH d AS (SELECT DISTINCT doc_id, contract_type, length(full_text) AS size FROM contracts WHERE contract_type IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY contract_type ORDER BY size, doc_id) AS r FROM d)
SELECT doc_id, contract_type, size FROM r WHERE r = 1 ORDER BY size, doc_id LIMIT 3""")
def src14_smallest_by_type(s: SparkSession, d: str) -> DataFrame:
    """A fixture: the smallest contracts of three types."""
    return ingest.smallest_of_each(table(s, d, "contracts").select("doc_id", "contract_type", F.length("full_text").alias("size")).distinct(), "contract_type", "size", "doc_id")


@query("WITH r AS (SELECT DISTINCT request_id, model FROM ask_responses) SELECT 'generation' AS phase, model AS config_id, count(*) AS rows FROM r GROUP BY model UNION ALL SELECT 'scores', model, count(*) FROM r GROUP BY model")
def snk2_append(s: SparkSession, d: str) -> DataFrame:
    """Rows of two phases appended to one folder by phase and setting, and counted there."""
    path = scratch_path(s, "run")
    r = table(s, d, "ask_responses").select("request_id", F.col("model").alias("config_id")).distinct()
    for phase in ("generation", "scores"):
        files.append_partitioned(r.withColumn("phase", F.lit(phase)), path)
    return s.read.schema("request_id string, phase string, config_id string").json(path).groupBy("phase", "config_id").agg(F.count("*").alias("rows"))


@query(f"WITH {C._bm25('question', C._IN_DOC, 8)}, {C._rerank('bm', 'question')}, al AS (SELECT * FROM bm WHERE rank <= 3 UNION ALL SELECT qid, 'final', rank, chunk_id, score FROM rr) SELECT qid, stage, chunk_id, rank FROM al")
def snk3_rankings(s: SparkSession, d: str) -> DataFrame:
    """Ranked lists as gzip JSON lines: stages cut, the final list whole."""
    bm = materialise(C._bm25_list(s, d, 8), "bm25")
    rr = retrieval.rerank(bm, C._questions(s, d), C._fixed(s, d), stage="final")
    path = scratch_path(s, "rankings")
    files.write_rankings(bm.unionByName(rr).withColumn("config_id", F.lit("x")), path, 3)
    return files.read_jsonl(s, path, "ranked").select("qid", "stage", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT model, count(*) AS vectors, count(DISTINCT key) AS keys FROM (SELECT DISTINCT model, key, vector FROM vectors WHERE vector IS NOT NULL) GROUP BY model")
def snk6_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors stored by model and counted from there."""
    path = scratch_path(s, "store")
    files.write_vectors(table(s, d, "vectors").filter("vector is not null").distinct(), path)
    return s.read.parquet(path).groupBy("model").agg(F.count("*").alias("vectors"), F.countDistinct("key").alias("keys"))


@query(f"WITH {C._INDEX} SELECT doc_id, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM post GROUP BY doc_id")
def snk7_index(s: SparkSession, d: str) -> DataFrame:
    """The stored index, read back: postings and tokens of each document."""
    path = scratch_path(s, "stored")
    files.write_index(C._index(s, d), path)
    return files.read_index(s, path).postings.groupBy("doc_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


# ---------- filters and projections ----------


@query("SELECT qid, split FROM (SELECT DISTINCT qid, split FROM questions WHERE split = 'dev') ORDER BY qid LIMIT 10")
def flt5_first_of_split(s: SparkSession, d: str) -> DataFrame:
    """The first ten dev questions."""
    return sampling.first_of_split(table(s, d, "questions"), "dev", 10).select("qid", "split")


@query(rf"WITH {C._SPANS} SELECT qid, span_index FROM sp WHERE length(regexp_replace(span, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3")
def flt9_enough_letters(s: SparkSession, d: str) -> DataFrame:
    return C.labels.spans_of(table(s, d, "questions")).filter(sampling.enough_letters("span")).select("qid", "span_index")


_SHEET = "sh AS (SELECT DISTINCT c.doc_id, k.category, (SELECT max(reference_answer) FROM questions q WHERE q.doc_id = c.doc_id AND q.category = k.category) AS answer FROM (SELECT DISTINCT doc_id FROM contracts) c, (SELECT DISTINCT category FROM questions WHERE category IS NOT NULL) k)"


@query(f"WITH {_SHEET}, pr AS (SELECT DISTINCT doc_id, category FROM questions WHERE answerable AND len(evidence_spans) > 0 AND doc_id IS NOT NULL) SELECT doc_id, category FROM sh WHERE lower(trim(coalesce(answer, ''))) IN ('', 'no') AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id = sh.doc_id AND pr.category = sh.category)")
def flt11_absent(s: SparkSession, d: str) -> DataFrame:
    """Categories of a contract that have no evidence and whose sheet says nothing, or no."""
    q = table(s, d, "questions")
    sheet = q.filter("doc_id is not null").groupBy("doc_id", "category").agg(F.max("reference_answer").alias("answer"))
    kinds = q.filter("category is not null").agg(F.collect_set("category").alias("k"))
    pairs = table(s, d, "contracts").select("doc_id").distinct().join(F.broadcast(kinds)).select("doc_id", F.explode("k").alias("category"))
    present = q.filter("answerable and size(evidence_spans) > 0 and doc_id is not null")
    return sampling.absent_categories(pairs.join(sheet, ["doc_id", "category"], "left"), present)


@query("SELECT qtype, count(*) FILTER (lower(trim(coalesce(reference_answer, ''))) NOT IN ('', 'yes', 'no')) AS informative, count(*) AS questions FROM (SELECT DISTINCT qid, qtype, reference_answer FROM questions) GROUP BY qtype")
def flt12_informative(s: SparkSession, d: str) -> DataFrame:
    return C._questions(s, d).groupBy("qtype").agg(F.count(F.when(sampling.informative("reference_answer"), 1)).alias("informative"), F.count("*").alias("questions"))


@query("SELECT DISTINCT chunk_id, md5(CASE WHEN coalesce(context_text, '') = '' THEN text ELSE context_text END) AS shown FROM chunks")
def prj4_excerpt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.md5(T.excerpt_text("context_text", "text")).alias("shown")).distinct()


_LATENCY = {"bm25": 0.5, C.MODEL: 14.25, "overlap": 100.0}


@query("""WITH c AS (SELECT unnest(['fixed', 'section']) AS ch), v AS (SELECT * FROM (VALUES ('bm25', 'nodense', 'none', 0.5), ('nosparse', 'clause-small', 'none', 14.25), ('bm25', 'clause-small', 'rrf', 14.75), ('bm25', 'clause-small', 'weighted0.5', 14.75)) t(s, d, f, ms)),
r AS (SELECT * FROM (VALUES ('norerank', 0.0), ('overlap', 100.0)) t(rr, m2)), x AS (SELECT unnest(['doc', 'corpus']) AS sc), al AS (SELECT concat_ws('__', ch, s, d, f, rr, 'k8', sc) AS config_id, ms + m2 AS ms FROM c, v, r, x UNION ALL SELECT concat_ws('__', ch, s, d, f, 'norerank', 'k8', 'doc', 'rawq'), ms FROM c, v WHERE f = 'none')
SELECT config_id, round_even(ms, 1)::DOUBLE AS estimated_ms FROM al""")
def prj6_estimated_latency(s: SparkSession, d: str) -> DataFrame:
    """Times of every setting of a grid from its components' times."""
    got = runs.estimated_latency(retrieval.grid(["fixed", "section"], [C.MODEL], ["overlap"]), _LATENCY)
    return s.createDataFrame(list(got.items()), "config_id string, estimated_ms double")


@query(r"SELECT DISTINCT chunk_id, regexp_replace(chunk_id, '^.*?::', '') AS short FROM chunks")
def txt19_short_id(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", T.short_id("chunk_id").alias("short")).distinct()


@query(r"SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM contracts WHERE title IS NOT NULL AND NOT contains(title, '.')")
def txt12_slugs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "contracts").filter("title is not null and not contains(title, '.')")
    return c.select("doc_id", T.slug("title").alias("slug"), T.match_key("title").alias("key")).distinct()


@query(r"SELECT DISTINCT block_id, trim(regexp_replace(text, '\s+', ' ', 'g')) = trim(regexp_replace(replace(text, chr(10), '  '), '\s+', ' ', 'g')) AS same, trim(regexp_replace(text, '\s+', ' ', 'g')) = text AS tidy FROM blocks")
def txt3_whitespace(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks")
    return b.select("block_id", T.whitespace_equivalent("text", F.replace("text", F.lit("\n"), F.lit("  "))).alias("same"), (T.squeeze("text") == F.col("text")).alias("tidy")).distinct()


@query(r"""WITH q AS (SELECT DISTINCT chunk_id, strategy, coalesce(regexp_replace(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), '\|', '\\|', 'g'), '') AS t FROM chunks WHERE strategy = 'section')
SELECT chunk_id, '| id | ' || strategy || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' |  |' AS markdown FROM q""")
def txt14_table_markdown(s: SparkSession, d: str) -> DataFrame:
    """Small tables as Markdown: pipes escaped, short rows filled up."""
    c = retrieval.distinct_chunks(table(s, d, "chunks"), "section")
    rows = F.array(F.array(F.lit("id"), F.col("strategy")), F.array(F.substring_index("text", "\n", 1)))
    return c.select("chunk_id", T.table_markdown(rows).alias("markdown"))


@query("SELECT DISTINCT doc_id, CASE WHEN contains(title, '_') THEN 'file' ELSE title END AS shown FROM contracts WHERE title IS NOT NULL")
def prj7_display_title(s: SparkSession, d: str) -> DataFrame:
    """Titles as shown; names that aren't file names stay."""
    c = table(s, d, "contracts").filter("title is not null").select("doc_id", "title").distinct()
    return c.select("doc_id", F.when(F.contains("title", F.lit("_")), "file").otherwise(T.display_title("title")).alias("shown"))


# ---------- joins ----------


@query(r"""WITH q AS (SELECT DISTINCT qid, lower(regexp_replace(contract_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM questions WHERE contract_name IS NOT NULL), c AS (SELECT DISTINCT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k, num_pages FROM contracts WHERE title IS NOT NULL),
l AS (SELECT k, max(doc_id) AS doc_id FROM c GROUP BY k) SELECT qid, doc_id FROM q LEFT JOIN l USING (k)""")
def join3_last_wins(s: SparkSession, d: str) -> DataFrame:
    """Questions with the contract of their name, if any; of contracts with one key the last counts."""
    q = C._questions(s, d).filter("contract_name is not null").select("qid", T.match_key("contract_name").alias("k"))
    c = table(s, d, "contracts").filter("title is not null").select(T.match_key("title").alias("k"), "doc_id")
    return q.join(c.groupBy("k").agg(F.max("doc_id").alias("doc_id")), "k", "left").select("qid", "doc_id")


@query("SELECT DISTINCT qid FROM questions q WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT qid FROM questions WHERE split = 'dev') x WHERE x.qid = q.qid)")
def join6_to_do(s: SparkSession, d: str) -> DataFrame:
    """Questions a run that has done the dev split still has to do."""
    q = C._questions(s, d)
    return ingest.to_do(q, q.filter("split = 'dev'"), ["qid"]).select("qid")


@query("""WITH c AS (SELECT unnest(['a', 'b', 'c']) AS config_id), q AS (SELECT DISTINCT qid FROM questions), d AS (SELECT config_id, qid FROM c, q WHERE config_id = 'a' OR (config_id = 'b' AND qid < 'q0000050')), n AS (SELECT config_id FROM d GROUP BY config_id HAVING count(*) = (SELECT count(*) FROM q)) SELECT config_id FROM c WHERE config_id NOT IN (SELECT config_id FROM n)""")
def join6_settings(s: SparkSession, d: str) -> DataFrame:
    """Settings that aren't finished; one with some of its questions isn't."""
    q, c = C._questions(s, d).select("qid"), s.createDataFrame([("a",), ("b",), ("c",)], "config_id string")
    done = q.withColumn("config_id", F.explode(F.when(F.col("qid") < "q0000050", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    return ingest.settings_to_do(c, done, q.count())


_BOXES = "b AS (SELECT DISTINCT doc_id, block_id, page, block_type, char_start, char_end, length(text) AS n FROM blocks), tb AS (SELECT doc_id, page, 0.0 AS x0, char_start - 40.0 AS y0, 10.0 AS x1, char_end + 60.0 AS y1 FROM b WHERE block_type = 'table')"


@query(f"""WITH {_BOXES} SELECT doc_id, block_id FROM b WHERE block_type <> 'table' AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = b.doc_id AND tb.page = b.page AND greatest(0, least(10.0, tb.x1) - greatest(0.0, tb.x0)) * greatest(0, least(b.char_end, tb.y1) - greatest(b.char_start, tb.y0)) >= 0.5 * greatest(1.0, 10.0 * (b.char_end - b.char_start)))""")
def join8_outside_tables(s: SparkSession, d: str) -> DataFrame:
    """Texts of which less than half lies in a table, with boxes made of offsets."""
    b = table(s, d, "blocks").dropDuplicates(["block_id"])
    box = lambda a, e: {"x0": F.lit(0.0), "y0": F.col("char_start") + F.lit(float(a)), "x1": F.lit(10.0), "y1": F.col("char_end") + F.lit(float(e))}
    return ingest.outside_tables(b.filter("block_type <> 'table'").withColumns(box(0, 0)), b.filter("block_type = 'table'").withColumns(box(-40, 60))).select("doc_id", "block_id")


@query("SELECT split, count(*) * 3 AS pairs FROM (SELECT DISTINCT qid, split FROM questions) GROUP BY split")
def join14_settings_questions(s: SparkSession, d: str) -> DataFrame:
    """Every setting with every question."""
    c = s.createDataFrame([(k,) for k in ("a", "b", "c")], "config_id string")
    return C._questions(s, d).select("qid", "split").join(F.broadcast(c)).groupBy("split").agg(F.count("*").alias("pairs"))


@query("SELECT doc_id, count(*) AS blocks FROM (SELECT DISTINCT doc_id, block_id FROM blocks) b WHERE doc_id IN (SELECT doc_id FROM questions WHERE split = 'dev') GROUP BY doc_id")
def join15_wanted(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the contracts that dev questions ask about."""
    b = table(s, d, "blocks").select("doc_id", "block_id").distinct()
    return b.join(table(s, d, "questions").filter("split = 'dev'").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("blocks"))


_EVIDENCE = f"""{C._PLACED}, b AS (SELECT DISTINCT doc_id, block_id, block_type, text, page, char_start, char_end FROM blocks), e0 AS (SELECT DISTINCT qid, block_id, b.char_start AS s, b.char_end AS e FROM pl JOIN b ON b.doc_id = pl.doc_id AND b.char_start < pl.char_end AND b.char_end > pl.char_start),
ev AS (SELECT qid, block_id, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s, e, block_id) AS n FROM e0) WHERE n <= 6)"""


@query(f"WITH {_EVIDENCE} SELECT qid, block_id, n FROM ev")
def join16_evidence_blocks(s: SparkSession, d: str) -> DataFrame:
    """The first six blocks that each question's evidence touches."""
    return sampling.evidence_blocks(table(s, d, "blocks"), C._placed(s, d))


@query(f"""WITH {_EVIDENCE}, q AS (SELECT DISTINCT qid, doc_id, answerable FROM questions WHERE doc_id IS NOT NULL), ds AS (SELECT qid, block_id, answerable, row_number() OVER (PARTITION BY qid ORDER BY concat('0x', substr(md5(concat('0~', qid, '~', block_id)), 1, 8))::BIGINT, block_id) AS n
FROM q JOIN b USING (doc_id) WHERE block_type <> 'heading' AND length(text) >= 80 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.qid = q.qid AND ev.block_id = b.block_id)),
pk AS (SELECT qid, block_id FROM ev UNION ALL SELECT qid, block_id FROM ds WHERE n <= CASE WHEN answerable THEN 3 ELSE 5 END), rk AS (SELECT pk.qid, doc_id, page, char_start, left(text, 2500) AS text, row_number() OVER (PARTITION BY pk.qid ORDER BY concat('0x', substr(md5(concat('0~order~', pk.qid, '~', pk.block_id)), 1, 8))::BIGINT, pk.block_id) AS rank FROM pk JOIN b USING (block_id))
SELECT qid, rank, concat(doc_id, '::oracle::', lpad((rank - 1)::VARCHAR, 5, '0')) AS chunk_id, md5(text) AS text, page AS page_start, char_start, char_start + length(text)::INT AS char_end FROM rk""")
def chk6_oracle_context(s: SparkSession, d: str) -> DataFrame:
    """Evidence and distractors of each question, in hash order."""
    c = sampling.oracle_context(table(s, d, "blocks").dropDuplicates(["block_id"]), C._placed(s, d), C._questions(s, d))
    return c.select("qid", "rank", "chunk_id", F.md5("text").alias("text"), "page_start", "char_start", "char_end")


@query("WITH r AS (SELECT DISTINCT request_id, model, answer FROM ask_responses), p AS (SELECT request_id, md5(coalesce(answer, '')) AS verdict FROM r WHERE request_id < 'r5') SELECT model, count(*) AS answers, count(verdict) AS reused FROM r LEFT JOIN p USING (request_id) GROUP BY model")
def join21_prior_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Answers whose verdict an earlier run has."""
    r = table(s, d, "ask_responses").select("request_id", "model", "answer").distinct()
    prior = r.filter("request_id < 'r5'").select("request_id", F.md5(F.coalesce("answer", F.lit(""))).alias("verdict"))
    have, todo = judge.reuse(r, prior, ["request_id"])
    both = have.select("model", "verdict").unionByName(todo.select("model", F.lit(None).cast("string").alias("verdict")))
    return both.groupBy("model").agg(F.count("*").alias("answers"), F.count("verdict").alias("reused"))


# ---------- search ----------


@query(f"WITH {C._bm25('question', C._IN_DOC, 8)}, {C._PLACED}, h AS (SELECT qid, span_index, chunk_id FROM pl JOIN c USING (doc_id) WHERE {C._COVERS}) SELECT pl.qid, pl.span_index, min(bm.rank) AS best FROM pl LEFT JOIN h ON h.qid = pl.qid AND h.span_index = pl.span_index LEFT JOIN bm ON bm.qid = pl.qid AND bm.chunk_id = h.chunk_id GROUP BY ALL")
def win2_best_rank(s: SparkSession, d: str) -> DataFrame:
    """Best rank of any chunk that holds a piece of evidence."""
    placed = materialise(C._placed(s, d), "placed")
    held = C.labels.relevant_chunks(placed, table(s, d, "chunks").filter("strategy = 'fixed'")).filter("chunk_id is not null")
    best = held.join(C._bm25_list(s, d, 8), ["qid", "chunk_id"]).groupBy("qid", "span_index").agg(F.min("rank").alias("best"))
    return placed.select("qid", "span_index").join(best, ["qid", "span_index"], "left")


@query()
def ret2_encoded(s: SparkSession, d: str) -> DataFrame:
    """Vector search with encoded questions over encoded chunks, in the question's contract, or in all for corpus-wide ones."""
    res = runs.Resources(C._questions(s, d), table(s, d, "chunks"), {"crc": _encoded(s, d)})
    return C._shown(res.dense(retrieval.Config(sparse=False, dense_model="crc")))


def _encoded(s: SparkSession, d: str) -> DataFrame:
    return materialise(ingest.encode_missing(C._fixed(s, d).select("text"), s.createDataFrame([], "model string, key string, vector array<float>"), "crc"), "encoded")


@query("WITH t AS (SELECT DISTINCT sha256(text) AS key FROM chunks WHERE strategy = 'section' AND text IS NOT NULL), v AS (SELECT DISTINCT key FROM vectors WHERE model = 'clause-small') SELECT count(*) AS texts, count(v.key) AS cached FROM t LEFT JOIN v USING (key)")
def ret10_encode_missing(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all section chunks, from the cache where it has them."""
    cache = table(s, d, "vectors").filter("model = 'clause-small'").select("model", "key", F.array(F.lit(-7.0).cast("float")).alias("vector"))
    got = ingest.encode_missing(retrieval.distinct_chunks(table(s, d, "chunks"), "section").select("text"), cache, "clause-small")
    return got.agg(F.count("*").alias("texts"), F.count(F.when(F.get("vector", F.lit(0)) == -7.0, 1)).alias("cached"))


@query(f"WITH {C._TOKENS}, b AS (SELECT DISTINCT block_id, doc_id, page, block_type, char_start AS bs, char_end AS be FROM blocks) SELECT concat(fw.doc_id, '::fixed::', lpad(chunk_index::VARCHAR, 5, '0')) AS chunk_id, md5(substr(full_text, char_start + 1, char_end - char_start)) AS text, token_count, min(page) AS page_start, max(page) AS page_end, bool_or(block_type = 'table') AS has_table FROM fw JOIN (SELECT DISTINCT doc_id, full_text FROM contracts) USING (doc_id) JOIN b ON b.doc_id = fw.doc_id AND bs < char_end AND be > char_start GROUP BY ALL")
def chk5_run_chunking(s: SparkSession, d: str) -> DataFrame:
    """Chunk rows of the fixed windows."""
    c = chunking.run_chunking(table(s, d, "contracts"), table(s, d, "blocks"), ["fixed"])
    return c.select("chunk_id", F.md5("text").alias("text"), F.col("token_count").cast("bigint").alias("token_count"), "page_start", "page_end", "has_table")


# ---------- aggregations ----------


@query("WITH d AS (SELECT DISTINCT doc_id, length(trim(coalesce(full_text, ''), chr(32))) AS n FROM contracts) SELECT count(*) AS documents, count(*) FILTER (n < 20) AS failures, round(count(*) FILTER (n < 20) / count(*), 6) AS failure_rate FROM d")
def agg3_failures(s: SparkSession, d: str) -> DataFrame:
    r = ingest.failure_report(table(s, d, "contracts").dropDuplicates(["doc_id"]))
    return r.withColumn("failure_rate", F.round("failure_rate", 6))


@query("WITH b AS (SELECT DISTINCT block_id, doc_id, block_type, text FROM blocks), m AS (SELECT doc_id, median(round_even((8.02 + length(text) % 7 / 10.0)::DOUBLE, 1)) AS m FROM b WHERE length(text) >= 40 AND block_type <> 'table' GROUP BY doc_id) SELECT DISTINCT b.doc_id, round(coalesce(m, 10.0), 4)::DOUBLE AS body_size FROM b LEFT JOIN m USING (doc_id)")
def agg7_body_font(s: SparkSession, d: str) -> DataFrame:
    """Body size of each contract, with sizes made of the texts' lengths."""
    b = table(s, d, "blocks").dropDuplicates(["block_id"]).withColumn("font_size", F.lit(8.02) + (F.length("text") % 7) / 10)
    return ingest.body_font(b).select("doc_id", F.round(F.col("body_size").cast("double"), 4).alias("body_size"))


@query("SELECT model, abstained, truncated, count(*) AS n FROM (SELECT DISTINCT request_id, model, abstained, truncated FROM ask_responses) WHERE abstained IS NOT NULL AND truncated IS NOT NULL GROUP BY ALL")
def agg20_confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(table(s, d, "ask_responses").select("request_id", "model", "abstained", "truncated").distinct(), "abstained", "truncated", ["model"])


_VALIDITY = f"""WITH {C._CITES}, v AS (SELECT request_id, count(chunk_id) AS valid, count(*) - count(chunk_id) AS invalid FROM n LEFT JOIN ex USING (request_id, n) GROUP BY request_id),
sc AS (SELECT a.request_id AS qid, model AS config_id, CASE WHEN coalesce(valid + invalid, 0) > 0 THEN valid / (valid + invalid) WHEN r.abstained THEN NULL ELSE 0 END::DOUBLE AS value, r.abstained, r.truncated, r.latency_ms FROM a LEFT JOIN v USING (request_id) JOIN (SELECT request_id, any_value(model) AS model, any_value(abstained) AS abstained, any_value(truncated) AS truncated, any_value(latency_ms) AS latency_ms FROM ask_responses GROUP BY request_id) r USING (request_id))"""


def _answer_scores(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "ask_responses").select("request_id", "model", "abstained", "truncated", "latency_ms").dropDuplicates(["request_id"])
    v = C.agg22_citation_validity_raw(s, d)
    none = F.lit(None).cast("double")
    out = r.join(v, "request_id").select(F.col("request_id").alias("qid"), F.col("model").alias("config_id"), F.col("validity").alias("citation_validity"), "abstained", "truncated", "latency_ms")
    return out.withColumns({m: none for m in ("faithfulness", "answer_relevance", "answer_correctness", "abstention_correct")})


@query(f"""{_VALIDITY}, {C._boot('sv', 'config_id', 'value', 'qid')} SELECT config_id, 'citation_validity' AS metric, round(mean, 6) AS mean, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high, n FROM mn JOIN ci USING (config_id)
UNION ALL SELECT config_id, 'median_generation_ms', round_even(median(latency_ms['generation']), 1), NULL, NULL, count(*) FROM sc WHERE latency_ms['generation'] IS NOT NULL GROUP BY config_id""".replace(", dr AS", ", sv AS (SELECT * FROM sc WHERE value IS NOT NULL), dr AS", 1))
def agg23_matrix_summary(s: SparkSession, d: str) -> DataFrame:
    """Mean citation validity with its interval, and median time, of each model's answers."""
    x = materialise(_answer_scores(s, d), "scores")
    g = x.select("config_id", "qid", F.col("latency_ms")["generation"].alias("latency_ms"))
    out = runs.matrix_summary(x, g)
    return out.withColumns({"mean": F.when(F.col("metric").startswith("median"), F.col("mean")).otherwise(F.round("mean", 6)), "ci_low": F.round("ci_low", 7), "ci_high": F.round("ci_high", 7)})


@query(f"{_VALIDITY} SELECT count(*) AS questions, count(*) FILTER (abstained) AS abstained, count(*) FILTER (truncated) AS truncated, round(avg(value), 3) AS citation_validity FROM sc")
def agg29_calibration_summary(s: SparkSession, d: str) -> DataFrame:
    x = materialise(_answer_scores(s, d), "scores")
    return runs.calibration_summary(x, x).select("questions", "abstained", "truncated", "citation_validity")


# ---------- judging ----------

_LEX = "len([x FOR x IN w IF list_contains(e, x)]) >= 0.5::DOUBLE * len(w) AND len(w) > 0"


def _cw(c: str) -> str:
    return f"list_distinct([x FOR x IN regexp_extract_all(lower({c}), '[a-z]+') IF length(x) > 2 AND NOT list_contains({C._CW}, x)])"


@query(rf"""WITH {C._CITES}, cn AS (SELECT request_id, count(*) AS cited, count(chunk_id) AS valid, coalesce(string_agg(text, ' ' ORDER BY n), '') AS ex FROM n LEFT JOIN ex USING (request_id, n) GROUP BY request_id),
x AS (SELECT a.request_id, regexp_replace(coalesce(answer, ''), '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g') AS s, coalesce(cited, 0) AS cited, coalesce(valid, 0) AS valid, coalesce(cn.ex, '') AS ex FROM a LEFT JOIN cn USING (request_id)),
y AS (SELECT *, list_distinct({C._NUMS.format(c="s")}) AS na, list_concat({C._NUMS.format(c="ex")}, {C._NUMWORDS.format(c="ex")}) AS nb, {_cw('s')} AS w, {_cw('ex')} AS e FROM x)
SELECT request_id, cited > 0 AND valid = cited AND len([v FOR v IN na IF NOT list_contains(nb, v)]) = 0 AND {_LEX} AS supported FROM y""")
def jdg3_whole_answers(s: SparkSession, d: str) -> DataFrame:
    """Whether all an answer cites supports all it says: citations that exist, figures that are there, and words enough."""
    a, n = C._cited(s, d)
    st = a.select("request_id", F.lit(1).cast("bigint").alias("pos"), T.strip_citations(F.coalesce("answer", F.lit(""))).alias("statement"), T.citations("answer").alias("cited"))
    return judge.check_statements(judge.cited_excerpts(st, table(s, d, "ask_citations"))).select("request_id", "supported")


_SCORE_ROWS = f"""{_VALIDITY}, dc AS (SELECT request_id, any_value(model) AS model, trim(coalesce(any_value(answer), ''), chr(32)) AS t, coalesce(any_value(abstained), false) AS f FROM ask_responses GROUP BY request_id),
dd AS (SELECT request_id, t, f, request_id < 'r5' AS answerable, f OR t = '' OR regexp_matches(regexp_split_to_array(regexp_replace(t, '([.!?])\\s+([A-Z("''“])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1], {C._DECLINES_SQL}) AS says FROM dc),
de AS (SELECT *, CASE WHEN answerable THEN f ELSE says END AS declined, t = '' OR (says AND NOT regexp_matches(t, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]')) AS skip FROM dd)"""


@query(f"{_SCORE_ROWS} SELECT request_id, declined, declined = NOT answerable AS abstention_correct, round(value, 6) AS citation_validity, CASE WHEN answerable THEN CASE WHEN skip THEN 0 ELSE 0.5 END END::DOUBLE AS answer_correctness FROM de JOIN sc ON sc.qid = request_id")
def jdg5_score_answers(s: SparkSession, d: str) -> DataFrame:
    """Scores of answers whose grades are given: refusals without citations aren't judged."""
    a = table(s, d, "ask_responses").select("request_id", "answer", "abstained").dropDuplicates(["request_id"])
    v = C.agg22_citation_validity_raw(s, d).select("request_id", F.col("valid").alias("valid_citations"), F.col("invalid").alias("invalid_citations"))
    rows = a.join(v, "request_id").withColumn("answerable", F.col("request_id") < "r5")
    none = s.createDataFrame([], "request_id string, supported boolean")
    got = judge.score_answers(rows, none, a.select("request_id", F.lit("partial").alias("grade")))
    return got.select("request_id", "declined", "abstention_correct", F.round("citation_validity", 6).alias("citation_validity"), "answer_correctness")


@query(f"{_SCORE_ROWS} SELECT answerable, declined, count(*) AS answers FROM de GROUP BY ALL")
def tri3_declined(s: SparkSession, d: str) -> DataFrame:
    """Answers that count as declined, by flag on answerable questions and by text on others."""
    a = table(s, d, "ask_responses").select("request_id", "answer", "abstained").dropDuplicates(["request_id"]).withColumn("answerable", F.col("request_id") < "r5")
    return a.withColumn("declined", triage.declined_as_scored("answer", "abstained", "answerable")).groupBy("answerable", "declined").agg(F.count("*").alias("answers"))


@query("""SELECT DISTINCT request_id, CASE WHEN abstained AND trim(coalesce(answer, ''), chr(32)) = '' THEN 'The provided contract excerpts do not contain the answer.' ELSE trim(coalesce(answer, ''), chr(32)) END AS answer, coalesce(abstained, false) AS abstained FROM ask_responses""")
def arr1_parse_output(s: SparkSession, d: str) -> DataFrame:
    """Answers out of a model's JSON, or out of plain text where it isn't JSON."""
    r = table(s, d, "ask_responses").select("request_id", "answer", "abstained").distinct()
    plain = F.when(F.coalesce("abstained", F.lit(False)) | F.coalesce("answer", F.lit("")).startswith("{"), F.to_json(F.struct(F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("abstained", F.lit(False)).alias("abstained")))).otherwise(F.coalesce("answer", F.lit("")))
    return r.select("request_id", judge.parse_output(plain).alias("o")).select("request_id", "o.*")


# ---------- prompts ----------

_CONTEXT = f"""{C._bm25('question', C._IN_DOC, 3)}, ch AS (SELECT DISTINCT chunk_id, text, context_text, section_path, page_start, page_end FROM chunks WHERE strategy = 'fixed'),
pt AS (SELECT qid, rank, concat('[', rank, '] (', CASE WHEN len(section_path) = 0 OR section_path IS NULL THEN 'no section' ELSE array_to_string(section_path, ' > ') END, ', ', CASE WHEN page_start = page_end THEN concat('p.', page_start) ELSE concat('pp.', page_start, '-', page_end) END, ')', chr(10), trim(CASE WHEN coalesce(context_text, '') = '' THEN text ELSE context_text END, chr(32))) AS t FROM bm JOIN ch USING (chunk_id))"""


@query(f"WITH {_CONTEXT}, cx AS (SELECT qid, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS t FROM pt GROUP BY qid) SELECT qid, md5(concat('Context excerpts:', chr(10), chr(10), t, chr(10), chr(10), 'Question: ', question)) AS message FROM cx JOIN (SELECT DISTINCT qid, question FROM questions) USING (qid)")
def txt16_messages(s: SparkSession, d: str) -> DataFrame:
    """The message to the model for each question and its three best chunks."""
    shown = prompts.excerpts(C._bm25_list(s, d, 3), C._fixed(s, d))
    m = prompts.build_messages("question", "excerpts")
    return C._questions(s, d).select("qid", "question").join(shown, "qid").select("qid", F.md5(F.element_at(m, 2)["content"]).alias("message"))


@query(f"WITH {_CONTEXT} SELECT q.qid, q.qtype, q.reference_answer AS reference, count(pt.t) AS excerpts FROM pt JOIN (SELECT DISTINCT qid, qtype, reference_answer FROM questions) q USING (qid) GROUP BY ALL")
def prj5_label_items(s: SparkSession, d: str) -> DataFrame:
    """What a person labels: no verdict is shown."""
    shown = materialise(prompts.excerpts(C._bm25_list(s, d, 3), C._fixed(s, d)), "shown")
    a = shown.select("qid", F.lit("x").alias("answer"), F.lit(False).alias("abstained"), F.lit(False).alias("truncated"))
    return prompts.label_items(C._questions(s, d), shown, a).select("qid", "qtype", "reference", F.size("excerpts").cast("bigint").alias("excerpts"))


# ---------- selection ----------


@query(f"""WITH {C._SPAN_ROWS}, o AS (SELECT doc_id, category, string_agg(text, ' … ' ORDER BY text) AS spans FROM st GROUP BY ALL), an AS (SELECT doc_id, category, max(reference_answer) AS answer FROM questions WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, category, left(CASE WHEN lower(trim(coalesce(answer, ''))) NOT IN ('', 'yes', 'no') THEN answer ELSE spans END, 800) AS reference FROM o JOIN an USING (doc_id, category)""")
def sel4_reference_answer(s: SparkSession, d: str) -> DataFrame:
    """Reference answers: the sheet's value where it says something, else the evidence."""
    spans = C._span_rows(s, d).groupBy("doc_id", "category").agg(F.array_sort(F.collect_set("text")).alias("s"))
    a = table(s, d, "questions").filter("doc_id is not null").groupBy("doc_id", "category").agg(F.max("reference_answer").alias("a"))
    met = spans.join(a, ["doc_id", "category"])
    one = lambda v: F.map_from_arrays(F.array("category"), F.array(v))
    return met.select("doc_id", "category", sampling.reference_answer(F.array("category"), one("a"), one("s")).alias("reference"))


@query(f"""WITH {C._SPAN_ROWS}, lo AS (SELECT st.*, instr(full_text, text) - 1 AS position FROM st JOIN contracts USING (doc_id) WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3 AND instr(full_text, text) > 0)
SELECT DISTINCT doc_id, category, text FROM lo t WHERE NOT EXISTS (SELECT 1 FROM lo o WHERE o.doc_id = t.doc_id AND o.category = t.category AND o.text <> t.text AND contains(o.text, t.text))""")
def sel5_placed_spans(s: SparkSession, d: str) -> DataFrame:
    """Annotated spans that stand in their contract letter for letter, without those inside another."""
    rows = C._span_rows(s, d).filter(sampling.enough_letters("text")).join(table(s, d, "contracts").select("doc_id", "full_text").dropDuplicates(["doc_id"]), "doc_id")
    return sampling.drop_contained(rows.filter(F.contains("full_text", "text")).drop("full_text")).distinct()


@query()
def sel2_build_questions(s: SparkSession, d: str) -> DataFrame:
    """A question set out of the evidence of the questions themselves: contracts, candidates, selection, numbering."""
    q, docs = table(s, d, "questions"), table(s, d, "contracts").dropDuplicates(["doc_id"])
    spans = materialise(C._span_rows(s, d), "annotated")
    sheet = q.filter("doc_id is not null").select("doc_id", F.concat("category", F.lit("-Answer")).alias("column"), F.col("reference_answer").alias("value")).distinct()
    found = questions.contracts(questions.place_spans(spans, docs), spans, sheet, docs)
    kinds = sorted(r[0] for r in q.select("category").distinct().collect() if r[0])
    rows = [(t, (k,), f"About {k.lower()}: what does {{name}} say ({t})?") for k in kinds for t in ("derived", "numeric", "unanswerable", "multi_span")]
    pool = questions.candidates(found, questions.templates(s, rows))
    return questions.build_questions(pool, sampling.split_documents(docs), {x: {"derived": 20, "numeric": 10, "unanswerable": 10, "multi_span": 5} for x in ("dev", "test")})[0]


@query(f"""WITH {C._ALPHAS}, m9 AS (SELECT config_id, round(avg(context_recall), 6) AS cr, round(avg(mrr), 6) AS m FROM ss WHERE split = 'dev' GROUP BY config_id), g AS (SELECT *, CASE WHEN config_id::DOUBLE < 0.4 THEN 'sparse' ELSE 'dense' END AS kind FROM m9)
SELECT kind, config_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cr DESC, m DESC, config_id::DOUBLE) AS r FROM g) WHERE r = 1""")
def top3_best_per(s: SparkSession, d: str) -> DataFrame:
    """The best weight among the smaller and among the larger ones, on dev."""
    x = C._alpha_scores(s, d).join(C._questions(s, d).filter("split = 'dev'").select("qid"), "qid")
    m = x.groupBy("config_id").agg(F.round(F.avg("context_recall"), 6).alias("context_recall"), F.round(F.avg("mrr"), 6).alias("mrr")).withColumn("grid_order", F.col("config_id").cast("double"))
    return ablation.best_per(m.withColumn("kind", F.when(F.col("grid_order") < 0.4, "sparse").otherwise("dense")), "kind").select("kind", "config_id")


@query("SELECT category, count(*) AS questions, row_number() OVER (ORDER BY count(*) DESC, category) AS place FROM (SELECT DISTINCT qid, category FROM questions) GROUP BY category")
def top5_categories(s: SparkSession, d: str) -> DataFrame:
    """Categories by the number of their questions."""
    n = C._questions(s, d).groupBy("category").agg(F.count("*").alias("questions"))
    return n.withColumn("place", F.row_number().over(C.W.orderBy(F.desc("questions"), "category")).cast("bigint"))


@query(f"""WITH t AS (SELECT DISTINCT qid, question, qtype FROM questions), u AS (SELECT qid AS key, 0 AS list, row_number() OVER (ORDER BY qid) AS place FROM t WHERE qtype = 'numeric' UNION ALL SELECT qid, 1, row_number() OVER (ORDER BY qid DESC) FROM t WHERE length(question) < 60)
SELECT key, list, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list, place) AS r FROM u) WHERE r = 1""")
def set2_ordered_union(s: SparkSession, d: str) -> DataFrame:
    """Two lists in turn, each key at its first place."""
    q = C._questions(s, d)
    rank = lambda x, *o: x.select(F.col("qid").alias("key"), F.row_number().over(C.W.orderBy(*o)).cast("bigint").alias("place"))
    return ablation.ordered_union([rank(q.filter("qtype = 'numeric'"), "qid"), rank(q.filter(F.length("question") < 60), F.desc("qid"))], "key")


# ---------- parsing ----------


@query("SELECT DISTINCT doc_id, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT doc_id, block_id, text FROM blocks WHERE block_type = 'paragraph' AND text = trim(regexp_replace(text, '\\s+', ' ', 'g'), chr(32)) AND NOT regexp_matches(text, '[<>&]') AND NOT regexp_matches(text, '\\.{5,}') AND regexp_matches(text, '^[A-Za-z][a-z]+ [a-z]') AND NOT regexp_matches(text, '^(?i)(article|section)') AND regexp_full_match(text, '[\\x20-\\x7e]+')) GROUP BY doc_id HAVING sum(length(text)) >= 40")
def src9_parse_html(s: SparkSession, d: str) -> DataFrame:
    """Plain paragraphs put into pages and parsed out of them again."""
    b = table(s, d, "blocks").filter("block_type = 'paragraph'").select("doc_id", "block_id", "text").distinct()
    plain = (F.col("text") == T.squeeze("text")) & ~F.col("text").rlike("[<>&]") & ~F.col("text").rlike(r"\.{5,}") & F.col("text").rlike("^[A-Za-z][a-z]+ [a-z]") & ~F.col("text").rlike("^(?i)(article|section)") & F.col("text").rlike(r"^[\x20-\x7e]+$")
    pages = b.filter(plain).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: F.concat(F.lit("<p>"), x["text"], F.lit("</p>"))), "\n").alias("html"))
    _, blocks, _ = parse.tables_of(parse.parse_html(pages))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars")).filter("chars >= 40")


# ---------- runs ----------


@query()
def run1_ablation(s: SparkSession, d: str) -> DataFrame:
    """Every setting of a grid over every answerable question, summarised."""
    res = runs.Resources(C._questions(s, d), table(s, d, "chunks"), {"crc": _encoded(s, d)})
    configs = [c for c in retrieval.grid(["fixed"], ["crc"], ["overlap"]) if not c.raw_query]
    return runs.run_ablation(res, table(s, d, "contracts").dropDuplicates(["doc_id"]), scratch_path(s, "ablation"), configs)["summary"]


@query()
def run2_matrix(s: SparkSession, d: str) -> DataFrame:
    """Answers and verdicts of two settings over the test questions, with the clients that need no model, summarised."""
    res = runs.Resources(C._questions(s, d), table(s, d, "chunks"))
    keys = [runs.BASELINE.format(chunking="fixed"), "fixed__bm25__nodense__none__overlap__k8__doc"]
    got = runs.run_matrix(res, table(s, d, "contracts").dropDuplicates(["doc_id"]), scratch_path(s, "matrix"), keys)
    return runs.matrix_summary(got["scores"], got["generation"]).filter(~F.col("metric").startswith("median"))


@query()
def run3_calibration(s: SparkSession, d: str) -> DataFrame:
    """Answers over the evidence itself, judged without a model, summarised."""
    return runs.run_calibration(C._questions(s, d), table(s, d, "contracts").dropDuplicates(["doc_id"]), table(s, d, "blocks").dropDuplicates(["block_id"]), scratch_path(s, "calibration"))["summary"]


@query()
def gen1_generate(s: SparkSession, d: str) -> DataFrame:
    """Answers of the client that needs no model over each question's best chunks."""
    shown = materialise(prompts.excerpts(C._bm25_list(s, d, 8), C._fixed(s, d)), "shown")
    return models.generate(C._questions(s, d), shown, models.extractive_client, "bm25", "extractive").drop("latency_ms")
