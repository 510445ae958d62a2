"""Runs over many settings: the ablation grid, the answer matrix and the calibration of a judge.

A run has a folder in shared storage with one table per phase, parted by
setting. A run that is taken up again reads what is there and does the rest; a
setting counts as done only with a row for every question. Each distinct list
(chunking, retriever, question text, scope) is computed once and shared by the
settings that use it, and identical contexts share one answer and one verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ablation, ingest, judge, labels, metrics, models, prompts, retrieval, sampling
from ..session import materialise
from ..sources.files import path_exists

KEY = ["config_id", "qid"]
BASELINE = "{chunking}__bm25__nodense__none__norerank__k8__doc"


@dataclass
class Resources:
    """What settings share: chunks and index of each chunking, vector lists of each (chunking, model, question text, scope), made when first asked for."""

    questions: DataFrame
    chunks: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    encode: dict[str, Callable | None] = field(default_factory=dict)
    scorers: dict[str, Callable[[Column, Column], Column]] = field(default_factory=lambda: {"overlap": retrieval.overlap_score})
    _made: dict = field(default_factory=dict)

    def _once(self, key: tuple, make: Callable):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def of(self, chunking: str) -> DataFrame:
        return self._once(("chunks", chunking), lambda: materialise(retrieval.distinct_chunks(self.chunks, chunking), "chunks"))

    def index(self, chunking: str) -> retrieval.Index:
        return self._once(("index", chunking), lambda: retrieval.build_index(self.of(chunking)))

    def asked(self, config: retrieval.Config) -> DataFrame:
        """Questions as the setting asks them: ``qid, doc_id, question``."""
        q = self.questions.select("qid", "doc_id", "question", "contract_name").dropDuplicates(["qid"])
        if not config.raw_query:
            q = q.withColumn("question", retrieval.scoped_question("question", "contract_name", config.doc_filter))
        return q.withColumn("doc_id", F.col("doc_id") if config.doc_filter else F.lit(None).cast("string"))

    def sparse(self, config: retrieval.Config) -> DataFrame:
        key = ("bm25", config.chunking, config.raw_query, config.doc_filter, config.k_candidates)
        return self._once(key, lambda: materialise(retrieval.bm25(self.index(config.chunking), retrieval.query_terms(self.asked(config)), config.k_candidates, scoped=config.doc_filter), "sparse"))

    def dense(self, config: retrieval.Config) -> DataFrame:
        """Cosine list of the encoded questions over the chunks' vectors (``model, key``: sha256 of a text)."""

        def make() -> DataFrame:
            v = self.vectors[config.dense_model].select("key", F.col("vector").alias("vec")).dropDuplicates(["key"])
            c = self.of(config.chunking).select("chunk_id", "doc_id", F.sha2("text", 256).alias("key")).join(v, "key").select("chunk_id", "doc_id", "vec")
            q = materialise(retrieval.encode_questions(self.asked(config), self.encode.get(config.dense_model)), "encoded")
            # In a contract's scope only its chunks are met; questions without a contract meet all.
            own = retrieval.dense(c, q.filter("doc_id is not null"), config.k_candidates, on=["doc_id"])
            return materialise(own.unionByName(retrieval.dense(c, q.filter("doc_id is null").drop("doc_id"), config.k_candidates)), "dense")

        return self._once(("dense", config.dense_model, config.chunking, config.raw_query, config.doc_filter, config.k_candidates), make)

    def lists(self, config: retrieval.Config) -> DataFrame:
        """All stages of a setting: ``config_id, qid, stage, rank, chunk_id, score``."""
        stages = [self.sparse(config)] if config.sparse else []
        stages += [self.dense(config)] if config.dense_model else []
        last = stages[-1]
        if config.fusion:
            key = ("fusion", config.chunking, config.dense_model, config.fusion, config.alpha, config.raw_query, config.doc_filter, config.k_candidates)
            fuse = lambda: retrieval.rrf(stages[0].unionByName(stages[1]), cut=config.k_candidates) if config.fusion == "rrf" else retrieval.weighted(*stages, config.alpha, config.k_candidates)
            last = self._once(key, lambda: materialise(fuse(), "fusion"))
            stages.append(last)
        if config.reranker:
            last = materialise(retrieval.rerank(last, self.asked(config), self.of(config.chunking), self.scorers[config.reranker]), "rerank")
            stages.append(last)
        out = last.filter(F.col("rank") <= config.k_final).withColumn("stage", F.lit("final"))
        for s in stages:
            out = out.unionByName(s)
        return out.select(F.lit(config.config_id).alias("config_id"), "*")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _done(spark: SparkSession, path: str, questions: int) -> set[str]:
    """Settings whose rows are complete: as many as a run has settings."""
    d = _read(spark, path)
    if d is None:
        return set()
    full = d.groupBy("config_id").agg(F.countDistinct("qid").alias("n")).filter(F.col("n") >= questions)
    return {r["config_id"] for r in full.select("config_id").collect()}


def span_labels(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed spans, ``qid, span_index, strategy, chunk_id``), each written once."""
    placed = materialise(labels.align(questions, documents), "align")
    return placed, materialise(labels.relevant_chunks(placed, chunks), "held")


def tune_alphas(res: Resources, held: DataFrame, splits: DataFrame, chunkings: Sequence[str], dense_models: Sequence[str], alphas: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> dict[tuple[str, str], float]:
    """Best weight of each (chunking, model) on dev questions."""
    out: dict[tuple[str, str], float] = {}
    for c in chunkings:
        for m in dense_models:
            base = retrieval.Config(c, dense_model=m, fusion="rrf")
            lists = None
            for a in alphas:
                part = retrieval.weighted(res.sparse(base), res.dense(base), a, base.k_final).withColumn("config_id", F.lit(f"{a:g}"))
                lists = part if lists is None else lists.unionByName(part)
            s = metrics.score_lists(materialise(lists, "alphas"), held.filter(F.col("strategy") == c).drop("strategy"))
            x = s.join(splits, "qid").select("split", F.lit(c).alias("chunking"), F.lit(m).alias("model"), F.col("config_id").cast("double").alias("alpha"), "mrr", F.col("context_recall").alias("recall"))
            best = ablation.tune_alpha(x).first()
            out[c, m] = best["alpha"] if best else 0.5
    return out


def run_ablation(res: Resources, documents: DataFrame, run_dir: str, configs: Sequence[retrieval.Config], ks: tuple[int, ...] = (1, 3, 5, 8, 10, 20)) -> dict[str, DataFrame]:
    """Every setting over every answerable question: ``lists``, ``scores`` and ``summary``.

    Writes a setting's lists (stages cut to 20, the final one whole) and scores
    when it is done; a setting with a row for every question isn't run again.
    """
    spark = documents.sparkSession
    questions = res.questions.filter("answerable").dropDuplicates(["qid"])
    res = Resources(questions, res.chunks, res.vectors, res.encode, res.scorers)
    _, held = span_labels(questions, documents, res.chunks)
    n = questions.count()
    done = _done(spark, f"{run_dir}/scores", n)
    for c in configs:
        if c.config_id in done:
            continue
        lists = materialise(res.lists(c), "lists")
        final = lists.filter("stage = 'final'").select(*KEY, "rank", "chunk_id")
        scores = metrics.score_lists(final, held.filter(F.col("strategy") == c.chunking).drop("strategy"), ks)
        every = questions.select(F.lit(c.config_id).alias("config_id"), "qid").join(scores, KEY, "left")
        kept = lists.filter("stage = 'final' or rank <= 20")
        for table, part in (("lists", kept), ("scores", _unfound(every, questions, held.filter(F.col("strategy") == c.chunking)))):
            part.drop("config_id").write.mode("overwrite").parquet(f"{run_dir}/{table}/config_id={c.config_id}")
    scores = spark.read.parquet(f"{run_dir}/scores")
    return {"lists": spark.read.parquet(f"{run_dir}/lists"), "scores": scores, "summary": ablation.summarise(scores, questions)}


def _unfound(scores: DataFrame, questions: DataFrame, held: DataFrame) -> DataFrame:
    """Scores with zeros where a question with placed evidence got no list at all."""
    known = held.groupBy("qid").agg(F.count("chunk_id").alias("_r"))
    met = scores.join(known, "qid", "left")
    zero = lambda c, on: F.when(F.col(c).isNull() & on, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    spans, some = F.col("_r").isNotNull(), F.col("_r") > 0
    return met.select(*KEY, "recall_at", *[zero(c, some) for c in ("chunk_recall", "hit", "mrr", "ndcg_at_10", "context_precision")], zero("context_recall", spans))


def choose_configs(selected: DataFrame, best: DataFrame, known: Sequence[str], baselines: bool = True, extra: Sequence[str] = (), top: int | None = None) -> list[str]:
    """Settings to answer with: the first ``top`` selected on dev, the best of each chunking, a BM25 baseline of each chunking named so far, extras; each once."""
    first = [r["config_id"] for r in selected.orderBy("place").collect()][:top]
    keys = first + [r["config_id"] for r in best.orderBy("chunking").collect()]
    if baselines:
        keys += [b for c in sorted({retrieval.parse_config(k).chunking for k in keys}) if (b := BASELINE.format(chunking=c)) in known]
    return list(dict.fromkeys([*keys, *extra]))


def run_matrix(res: Resources, documents: DataFrame, run_dir: str, keys: Sequence[str], generator: models.Factory = models.extractive_client, verifier: models.Factory = models.lexical_judge, model: str = "extractive", split: str | None = "test") -> dict[str, DataFrame]:
    """Retrieve, answer and judge every question with every setting: ``retrieval``, ``generation``, ``scores``.

    Three phases, each complete before the next, so that answering and judging
    models are never needed at a time. A phase does only what its table lacks.
    Answers are made once for each question and list of chunks, verdicts once
    for each of those and answer, and copied to every setting that shares them.
    """
    spark = documents.sparkSession
    questions = res.questions if split is None else sampling.first_of_split(res.questions, split)
    questions = materialise(questions.dropDuplicates(["qid"]), "questions")
    res = Resources(questions, res.chunks, res.vectors, res.encode, res.scorers)
    wanted = questions.select("qid").join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "config_id string")))

    have = _read(spark, f"{run_dir}/retrieval")
    for k in keys:
        if have is None or not have.filter(F.col("config_id") == k).limit(1).count():
            res.lists(retrieval.parse_config(k)).drop("config_id").write.mode("overwrite").parquet(f"{run_dir}/retrieval/config_id={k}")
    lists = spark.read.parquet(f"{run_dir}/retrieval")
    final = materialise(lists.filter("stage = 'final'").select(*KEY, "rank", "chunk_id"), "final")
    context = wanted.join(ablation.content_key(final), KEY, "left").withColumn("content_key", F.coalesce("content_key", F.sha2(F.concat(F.lit("none::"), "qid"), 256)))
    context = materialise(context, "contexts")

    chunks = res.chunks.dropDuplicates(["chunk_id"])
    one = context.groupBy("content_key").agg(F.min("config_id").alias("config_id"), F.first("qid").alias("qid"))
    shown = materialise(one.select("content_key", *KEY).join(final, KEY, "left").transform(lambda d: _shown(d, chunks)), "shown")
    at = f"{run_dir}/generation"
    made = _read(spark, at)
    todo = one if made is None else one.join(made.select("content_key").distinct(), "content_key", "left_anti")
    asked = todo.select("content_key", "qid").join(questions.select("qid", "question"), "qid").select(F.col("content_key").alias("qid"), "question")
    fresh = models.generate(asked, shown.select(F.col("content_key").alias("qid"), "excerpts"), generator, "", model).withColumnRenamed("qid", "content_key").drop("config_id")
    fresh.write.mode("append").parquet(at)
    answers = spark.read.parquet(at).dropDuplicates(["content_key"])

    at = f"{run_dir}/verdicts"
    made = _read(spark, at)
    rows = materialise(one.select("content_key", "qid").join(answers, "content_key").join(questions.select("qid", "question", "answerable"), "qid"), "answers")
    todo = rows if made is None else rows.join(made.select("content_key").distinct(), "content_key", "left_anti")
    judged_once(todo, shown, questions, verifier).write.mode("append").parquet(at)
    verdicts = spark.read.parquet(at).dropDuplicates(["content_key"])

    _, held = span_labels(questions, documents, res.chunks)
    found = None
    for c in sorted({retrieval.parse_config(k).chunking for k in keys}):
        own = [k for k in keys if retrieval.parse_config(k).chunking == c]
        part = metrics.score_lists(final.filter(F.col("config_id").isin(own)), held.filter(F.col("strategy") == c).drop("strategy"))
        found = part if found is None else found.unionByName(part)
    scores = context.join(verdicts, "content_key").join(found, KEY, "left")
    generation = context.join(answers, "content_key")
    return {"retrieval": lists, "generation": generation, "scores": materialise(scores, "scores")}


def _shown(final: DataFrame, chunks: DataFrame) -> DataFrame:
    """``content_key, excerpts``; an empty list where nothing was found."""
    got = prompts.excerpts(final.filter("chunk_id is not null"), chunks, ["content_key"])
    none = F.from_json(F.lit("[]"), got.schema["excerpts"].dataType.simpleString())
    return final.select("content_key").distinct().join(got, "content_key", "left").withColumn("excerpts", F.coalesce("excerpts", none))


def judged_once(answers: DataFrame, shown: DataFrame, questions: DataFrame, verifier: models.Factory) -> DataFrame:
    """Scores of answers ``content_key, qid, question, answer, abstained, answerable, cited_chunk_ids, invalid_citations``: one row each, with the judge's reasons as JSON.

    A refusal without citations isn't sent to the judge.
    """
    skip = (F.trim("answer") == "") | (T.declines("answer", "abstained") & ~F.col("answer").rlike(T.CITATION))
    a = materialise(answers.withColumn("_skip", skip), "judging")
    asked = a.filter(~F.col("_skip"))
    keyed = asked.select(F.col("content_key").alias("key"), "qid", "question", "answer")
    checked = materialise(models.check_answers(keyed, shown.select(F.col("content_key").alias("key"), "excerpts"), verifier), "checked")
    grades = materialise(models.grade_answers(keyed.join(asked.filter("answerable").select(F.col("content_key").alias("key")), "key"), questions, verifier), "grades")
    base = a.select(F.col("content_key").alias("key"), "answer", "abstained", "answerable", F.size("cited_chunk_ids").alias("valid_citations"), "invalid_citations")
    scored = judge.score_answers(base, checked, grades, "key").join(judge.relevance(checked, "key"), "key", "left")
    notes = checked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "statement", "supported", "missing"))).alias("statements"))
    why = F.to_json(F.struct(F.col("statements"), F.struct("grade", "reason").alias("grade")))
    return scored.join(notes, "key", "left").join(grades, "key", "left").select(F.col("key").alias("content_key"), "declined", "abstention_correct", "citation_validity", "faithfulness", "answer_relevance", "answer_correctness", why.alias("judge_rationale"))


ANSWER_METRICS = ("faithfulness", "citation_validity", "answer_relevance", "answer_correctness", "abstention_correct")


def matrix_summary(scores: DataFrame, generation: DataFrame, latency: DataFrame | None = None, n_boot: int = 2000) -> DataFrame:
    """``config_id, metric, mean, ci_low, ci_high, n`` of the answer metrics, and the median times as metrics without interval.

    ``latency``: ``config_id, qid, retrieval_ms``, where it was measured.
    """
    long = metrics.metric_table(scores.withColumn("abstention_correct", F.col("abstention_correct").cast("double")).withColumn("recall_at", F.lit(None).cast("map<int,double>")), ANSWER_METRICS)
    out = metrics.bootstrap_native(long, ["config_id", "metric"], "value", "qid", n_boot).select("config_id", "metric", "mean", "ci_low", "ci_high", "n")
    times = [(generation, "latency_ms", "median_generation_ms")] + ([(latency, "retrieval_ms", "median_retrieval_ms")] if latency is not None else [])
    for d, c, name in times:
        m = d.filter(F.col(c).isNotNull()).groupBy("config_id").agg(F.bround(F.median(c), 1).alias("mean"), F.count("*").alias("n"))
        none = F.lit(None).cast("double")
        out = out.unionByName(m.select("config_id", F.lit(name).alias("metric"), "mean", none.alias("ci_low"), none.alias("ci_high"), "n"))
    return out


def compare_with_baselines(scores: DataFrame, keys: Sequence[str], n_boot: int = 2000, of: tuple[str, ...] = ("answer_correctness", "faithfulness")) -> DataFrame | None:
    """Each setting against the BM25 baseline of its chunking: ``candidate, baseline, metric, mean, n, ci_low, ci_high, significant``; None without a pair."""
    table = materialise(metrics.metric_table(scores.withColumn("recall_at", F.lit(None).cast("map<int,double>")), of), "metrics")
    out = None
    for k in keys:
        base = BASELINE.format(chunking=retrieval.parse_config(k).chunking)
        if k == base or base not in keys:
            continue
        part = metrics.paired_difference(table, base, k, n_boot).select(F.lit(k).alias("candidate"), F.lit(base).alias("baseline"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def run_calibration(questions: DataFrame, documents: DataFrame, blocks: DataFrame, run_dir: str, generator: models.Factory = models.extractive_client, verifier: models.Factory = models.lexical_judge, model: str = "extractive", split: str = "dev", most: int | None = None, k: int = 3, seed: str = "0") -> dict[str, DataFrame]:
    """Answers over the evidence itself, judged, with the items a person labels blind: ``answers``, ``scores``, ``items``, ``summary``.

    Answers and scores stand in ``run_dir`` and are only made where they lack.
    """
    spark = questions.sparkSession
    q = materialise(sampling.first_of_split(questions, split, most), "questions")
    own = blocks.join(q.select("doc_id").distinct(), "doc_id", "left_semi")
    placed = materialise(labels.align(q, documents).filter("char_start is not null"), "placed")
    context = materialise(sampling.oracle_context(own, placed, q, k, seed), "context")
    one = F.struct("rank", "chunk_id", "text", "section_path", "page_start", "page_end")
    shown = materialise(context.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("excerpts")), "shown")
    made = _read(spark, f"{run_dir}/answers")
    todo = q if made is None else ingest.to_do(q, made, ["qid"])
    models.generate(todo, shown, generator, "oracle-context", model).write.mode("append").parquet(f"{run_dir}/answers")
    answers = spark.read.parquet(f"{run_dir}/answers").dropDuplicates(["qid"])
    made = _read(spark, f"{run_dir}/scores")
    todo = answers if made is None else ingest.to_do(answers, made.withColumnRenamed("content_key", "qid"), ["qid"])
    rows = todo.join(q.select("qid", "question", "answerable"), "qid").withColumn("content_key", F.col("qid"))
    judged_once(rows, shown.withColumn("content_key", F.col("qid")), q, verifier).write.mode("append").parquet(f"{run_dir}/scores")
    scores = spark.read.parquet(f"{run_dir}/scores").withColumnRenamed("content_key", "qid").dropDuplicates(["qid"])
    return {"answers": answers, "scores": scores, "items": prompts.label_items(q, shown, answers), "summary": calibration_summary(answers, scores)}


def calibration_summary(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: questions, abstained and truncated answers, and the mean of each answer metric, nulls left out."""
    n = answers.agg(F.count("*").alias("questions"), F.count(F.when(F.col("abstained"), 1)).alias("abstained"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"))
    return n.crossJoin(scores.agg(*[F.round(F.avg(F.col(m).cast("double")), 3).alias(m) for m in ANSWER_METRICS]))


def estimated_latency(configs: Sequence[retrieval.Config], latency: dict[str, float]) -> dict[str, float]:
    """Milliseconds a setting takes: those of the components it uses, to a tenth; unknown ones count nothing."""
    parts = lambda c: [latency.get("bm25", 0.0) if c.sparse else 0.0, latency.get(c.dense_model or "", 0.0), latency.get(c.reranker or "", 0.0)]
    return {c.config_id: round(sum(parts(c)), 1) for c in configs}
