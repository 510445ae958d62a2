"""Search: index tables, BM25, vectors, fusion, reranking and the pipeline, all as ranked lists in long form.

A ranked list is ``(qid, stage, rank, chunk_id, score)``, rank from 1. Scores are
rounded to 12 digits before they are ranked, so that near-ties break on keys and
not on the order of a sum. Statistics of the index are tables of their own, so a
scope filter never changes them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.udfs import encoder, stems
from ..session import materialise

K1, B, CANDIDATES, FINAL = 1.5, 0.75, 50, 8
#: Rows of questions' terms, or query vectors, that are sent to every task at a time; more of them take a pass each.
BLOCK_ROWS, BLOCK_VECTORS = 200_000, 10_000
#: Candidates that a task keeps before it cuts them to the best k of each question.
KEPT = 1 << 20
#: Numbers in a task's matrix of questions and chunks.
CELLS = 1 << 22


def distinct_chunks(chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    """One row per ``chunk_id``; repeated rows count once."""
    rows = chunks.filter(F.col("strategy") == strategy) if strategy else chunks
    return rows.dropDuplicates(["chunk_id"])


@dataclass(frozen=True)
class Index:
    """``docs (chunk_id, doc_id, dl, toks)``, ``terms (term, df)`` and ``totals (n, avgdl)``.

    Tokens stand with their chunk, so a chunk's score is summed where the chunk
    is, and only the best few of each task are shuffled.
    """

    docs: DataFrame
    terms: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``term, chunk_id, doc_id, dl, tf``: the same, turned to terms."""
        each = self.docs.select("chunk_id", "doc_id", "dl", F.explode("toks").alias("term"))
        return each.groupBy("term", "chunk_id", "doc_id", "dl").agg(F.count("*").alias("tf"))


def build_index(chunks: DataFrame, stopwords: list[str] | None = T.STOPWORDS, stemmed: bool = False) -> Index:
    """Index of ``chunk_id, doc_id, text``. Lengths count tokens after stop words, with repeats; chunks without tokens count in ``n``.

    Writes the tokens once; statistics are read from there.
    """
    toks = T.tokens("text", stopwords)
    docs = materialise(chunks.select("chunk_id", "doc_id", (stems(toks) if stemmed else toks).alias("toks")).withColumn("dl", F.size("toks").cast("bigint")), "index")
    terms = docs.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Index(docs, materialise(terms, "terms"), docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def query_terms(questions: DataFrame, stopwords: list[str] | None = T.STOPWORDS, stemmed: bool = False) -> DataFrame:
    """``qid, doc_id, term, qtf``: terms of each question (``qid, question, doc_id``), repeats counted."""
    toks = T.tokens("question", stopwords)
    q = questions.select("qid", "doc_id", F.explode(stems(toks) if stemmed else toks).alias("term"))
    return q.groupBy("qid", "doc_id", "term").agg(F.count("*").alias("qtf"))


def _ranked(scored: DataFrame, stage: str, k: int, *ties: Column) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), *ties)
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("qid", F.lit(stage).alias("stage"), F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score")


def _cut(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The best ``k`` rows of each ``q``: by score to 12 digits, then by ``chunk_id``."""
    x = pd.concat(parts, ignore_index=True)
    x["r"] = -x["score"].round(12)
    return x.sort_values(["q", "r", "chunk_id"], kind="stable").groupby("q", sort=False).head(k)[["q", "chunk_id", "score"]]


def _blocks(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """``df`` in parts of about ``rows`` rows by a hash of ``key``; one part if it is no larger."""
    n = -(-df.count() // rows)
    return [df] if n <= 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25(index: Index, terms: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B, scoped: bool = True) -> DataFrame:
    """BM25 list of each question, positive scores only; ties go to the smaller ``chunk_id``.

    ``terms`` comes from ``query_terms``. Scoped, a question with a ``doc_id``
    meets only chunks of that document (unknown: none), others the whole corpus.
    Unknown terms drop out. The question side carries idf and is written once.
    Blocks of ``BLOCK_ROWS`` of it go to the tasks; each scores its chunks in
    full and hands on its ``k`` best of each question, so what is shuffled
    grows with questions and tasks, not with the chunks that share a term.
    """
    n = F.col("n").cast("double")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scope = F.col("doc_id") if scoped else F.lit(None).cast("string")
    weighted = terms.join(index.terms, "term").crossJoin(F.broadcast(index.totals)).select("qid", scope.alias("scope"), "term", (idf * F.col("qtf")).alias("w"), "avgdl")
    weighted = materialise(weighted, "terms")
    kind = terms.schema["qid"].dataType.simpleString()
    parts = []
    for block in _blocks(weighted, "qid", BLOCK_ROWS):
        w = block.toPandas()
        names = pd.Index(w["qid"].unique())
        side = pd.DataFrame({"q": names.get_indexer(w["qid"]), "term": w["term"], "w": w["w"].astype(float)})
        bound = w["scope"].notna().to_numpy()
        avgdl = float(w["avgdl"].iloc[0] or 1.0) if len(w) else 1.0
        shared = terms.sparkSession.sparkContext.broadcast((side[~bound], side[bound].assign(doc_id=w["scope"][bound]), names.to_numpy(dtype=object), avgdl))
        parts.append(index.docs.mapInPandas(_scorer(shared, k, k1, b), f"qid {kind}, chunk_id string, score double"))
    return _ranked(_union(parts), "bm25", k, F.asc("chunk_id"))


def _free_scores(rows: pd.DataFrame, ids: np.ndarray, free: dict[str, tuple[np.ndarray, np.ndarray]], questions: int, k: int) -> Iterator[pd.DataFrame]:
    """The best ``k`` chunks of each question, a part of the batch at a time: each term adds its weights times its frequencies to a matrix of questions and chunks."""
    rows = rows[rows["term"].isin(free.keys())]
    if not len(rows):
        return
    # Columns in the order of ids, so that a stable sort leaves ties with the smaller one.
    place = np.empty(len(ids), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    place[order] = np.arange(len(ids))
    column, tf = place[rows["c"].to_numpy()], rows["tf"].to_numpy()
    width = max(1, CELLS // max(1, questions))
    for low in range(0, len(ids), width):
        mine = np.flatnonzero((column >= low) & (column < low + width))
        if not len(mine):
            continue
        m = np.zeros((questions, min(width, len(ids) - low)))
        for term, at in rows.iloc[mine].groupby("term", sort=False).indices.items():
            q, w = free[term]
            own = mine[at]
            m[np.ix_(q, column[own] - low)] += np.outer(w, tf[own])
        asked = np.flatnonzero(m.any(1))
        m = m[asked]
        best = np.argsort(-m.round(12), axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(m, best, 1)
        hit = score > 0
        yield pd.DataFrame({"q": np.repeat(asked, best.shape[1])[hit.ravel()], "chunk_id": ids[order[low + best[hit]]], "score": score[hit]})


def _scorer(shared, k: int, k1: float, b: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free, bound, names, avgdl = shared.value
        kept: list[pd.DataFrame] = []
        of_term = {t: (x["q"].to_numpy(), x["w"].to_numpy()) for t, x in free.groupby("term", sort=False)}
        known_docs = set(bound["doc_id"]) if len(bound) else set()
        size = 0
        for batch in batches:
            ids = batch["chunk_id"].to_numpy(dtype=object)
            rows = [(i, d, t, n) for i, (d, c) in enumerate(zip(batch["doc_id"], batch["toks"])) for t, n in Counter(c).items() if t in of_term or d in known_docs]
            if not rows:
                continue
            tf = pd.DataFrame(rows, columns=["c", "doc_id", "term", "n"])
            dl = batch["dl"].to_numpy(dtype=float)[tf["c"]]
            tf["tf"] = tf["n"] / (tf["n"] + k1 * (1 - b + b * dl / avgdl))
            parts = list(_free_scores(tf, ids, of_term, len(names), k)) if of_term else []
            if known_docs and len(m := tf.merge(bound, on=["doc_id", "term"])):
                m["score"] = m["tf"] * m["w"]
                x = m.groupby(["q", "c"], sort=False)["score"].sum().reset_index()
                x["chunk_id"] = ids[x["c"]]
                parts.append(x[["q", "chunk_id", "score"]])
            if not parts:
                continue
            kept.append(_cut(parts, k))
            size += len(kept[-1])
            if size > KEPT:
                kept = [_cut(kept, k)]
                size = len(kept[0])
        if kept:
            out = _cut(kept, k)
            yield pd.DataFrame({"qid": names[out["q"]], "chunk_id": out["chunk_id"].to_numpy(dtype=object), "score": out["score"].to_numpy()})

    return score


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in order."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def dense(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, on: list[str] | None = None) -> DataFrame:
    """Cosine list of each query (``qid, qvec``) over ``chunk_id, vec``, no score floor; ties go to the smaller ``chunk_id``.

    ``on`` names columns (a scope or model) both sides must agree in. Without
    it every query meets every row: blocks of ``BLOCK_VECTORS`` queries go to the
    tasks, each multiplies its rows with them and hands on its ``k`` best of each
    query. Null, empty and all-zero vectors, and rows of another width than the query, take no part.
    """
    v = vectors.filter("vec is not null and size(vec) > 0").withColumn("vnorm", norm(F.col("vec"))).filter("vnorm > 0")
    q = queries.filter("qvec is not null and size(qvec) > 0").withColumn("qnorm", norm(F.col("qvec"))).filter("qnorm > 0")
    if on:
        met = v.join(q, on)
        scored = met.select("qid", "chunk_id", (dot(F.col("vec"), F.col("qvec")) / (F.col("vnorm") * F.col("qnorm"))).alias("score"))
        return _ranked(scored, "dense", k, F.asc("chunk_id"))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    parts = []
    for block in _blocks(q.select("qid", "qvec"), "qid", BLOCK_VECTORS):
        own = block.toPandas()
        shared = vectors.sparkSession.sparkContext.broadcast((own["qid"].to_numpy(dtype=object), [np.asarray(x, dtype=float) for x in own["qvec"]]))
        parts.append(v.select("chunk_id", "vec").mapInPandas(_multiplier(shared, k), kinds))
    return _ranked(_union(parts), "dense", k, F.asc("chunk_id"))


def _multiplier(shared, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = shared.value
        widths = np.array([len(x) for x in queries])
        kept: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            of = b["vec"].map(len).to_numpy()
            for width in np.unique(of):
                at, asked = np.flatnonzero(of == width), np.flatnonzero(widths == width)
                if not len(asked):
                    continue
                x, y = np.stack([np.asarray(z, dtype=float) for z in b["vec"].to_numpy()[at]]), np.stack([queries[i] for i in asked])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                for a in range(0, len(at), 1024):
                    s = y @ x[a : a + 1024].T
                    frames = pd.DataFrame({"q": np.repeat(asked, s.shape[1]), "chunk_id": np.tile(b["chunk_id"].to_numpy()[at[a : a + 1024]], len(asked)), "score": s.ravel()})
                    kept.append(_cut([frames], k))
                    size += len(kept[-1])
                    if size > KEPT:
                        kept = [_cut(kept, k)]
                        size = len(kept[0])
        if kept:
            out = _cut(kept, k)
            yield pd.DataFrame({"qid": names[out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()})

    return run


def encode_questions(questions: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None, prefix: str = "") -> DataFrame:
    """``qid, doc_id, qvec``: each distinct question encoded once, with the model's ``prefix`` before it."""
    texts = questions.select("question").distinct().withColumn("qvec", encoder(encode)(F.concat(F.lit(prefix), F.coalesce("question", F.lit("")))))
    return questions.select("qid", "doc_id", "question").join(texts, "question").select("qid", "doc_id", "qvec")


def rrf(lists: DataFrame, k: int = 60, cut: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion of all stages in ``lists``; ties go to the better rank, then to the smaller ``chunk_id``."""
    scored = lists.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min("rank").alias("best"))
    return _ranked(scored, "fusion", cut, F.asc("best"), F.asc("chunk_id"))


def min_max(lists: DataFrame) -> DataFrame:
    """Scores of each list scaled to 0..1; a list of equal scores becomes 1."""
    w = W.partitionBy("qid", "stage")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("score", F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def weighted(sparse: DataFrame, dense_: DataFrame, alpha: float = 0.5, cut: int = CANDIDATES) -> DataFrame:
    """alpha · dense + (1 - alpha) · sparse of scaled scores; a chunk missing in a list has 0 there."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    both = min_max(sparse).select("qid", "chunk_id", (F.col("score") * (1 - alpha)).alias("s")).unionByName(
        min_max(dense_).select("qid", "chunk_id", (F.col("score") * alpha).alias("s"))
    )
    return _ranked(both.groupBy("qid", "chunk_id").agg(F.sum("s").alias("score")), "fusion", cut, F.asc("chunk_id"))


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer, no model: distinct lower-case words that both share."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    return F.size(F.array_intersect(words(query), words(text))).cast("double")


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, stage: str = "rerank") -> DataFrame:
    """The whole list reordered by ``scorer(question, text)``; ties keep the incoming order. Only candidates reach the scorer."""
    met = candidates.select("qid", "chunk_id", F.col("rank").alias("before")).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    scored = met.select("qid", "chunk_id", "before", scorer(F.col("question"), F.col("text")).alias("score"))
    return _ranked(scored, stage, 1 << 30, F.asc("before"))


def scoped_question(question: Column | str, name: Column | str, scoped: Column | bool = True) -> Column:
    """The contract's name, wherever it stands, replaced by "the agreement" when the search is scoped to it."""
    q, n = (F.col(c) if isinstance(c, str) else c for c in (question, name))
    use = F.lit(scoped) if isinstance(scoped, bool) else scoped
    return F.when(use & n.isNotNull() & (n != ""), F.replace(q, n, F.lit("the agreement"))).otherwise(q)


@dataclass(frozen=True)
class Config:
    """One search setting; ``config_id`` joins its parts and ``parse_config`` takes them apart."""

    chunking: str = "fixed"
    sparse: bool = True
    dense_model: str | None = None
    fusion: str | None = None
    alpha: float | None = None
    reranker: str | None = None
    k_candidates: int = CANDIDATES
    k_final: int = FINAL
    doc_filter: bool = True
    raw_query: bool = False

    def __post_init__(self) -> None:
        if not self.sparse and not self.dense_model:
            raise ValueError("a setting needs a sparse or a dense list")
        if bool(self.fusion) != (self.sparse and bool(self.dense_model)):
            raise ValueError("fusion is for two lists, and two lists need it")
        if self.fusion not in (None, "rrf", "weighted"):
            raise ValueError(f"unknown fusion {self.fusion}")
        if (self.fusion == "weighted") != (self.alpha is not None):
            raise ValueError("alpha is for weighted fusion")
        if not 0 < self.k_final <= self.k_candidates:
            raise ValueError("k_final must be positive and at most k_candidates")

    @property
    def config_id(self) -> str:
        fusion = f"weighted{self.alpha:g}" if self.fusion == "weighted" else self.fusion or "none"
        parts = [self.chunking, "bm25" if self.sparse else "nosparse", self.dense_model or "nodense", fusion, self.reranker or "norerank", f"k{self.k_final}", "doc" if self.doc_filter else "corpus"]
        return "__".join(parts) + ("__rawq" if self.raw_query and self.doc_filter else "")


def parse_config(key: str) -> Config:
    """Inverse of ``config_id``; a corpus-wide setting always searches with the raw question."""
    p = key.split("__")
    if len(p) not in (7, 8) or not p[5].startswith("k"):
        raise ValueError(f"not a setting: {key}")
    alpha = float(p[3].removeprefix("weighted")) if p[3].startswith("weighted") else None
    return Config(
        p[0], p[1] == "bm25", None if p[2] == "nodense" else p[2], None if p[3] == "none" else "weighted" if alpha is not None else p[3], alpha,
        None if p[4] == "norerank" else p[4], CANDIDATES, int(p[5][1:]), p[6] == "doc", len(p) == 8 or p[6] == "corpus",
    )


def run_pipeline(config: Config, questions: DataFrame, chunks: DataFrame, index: Index, dense_list: DataFrame | None = None, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """All lists of one setting, each kept: ``config_id, qid, stage, rank, chunk_id, score``; the last stage is ``final``.

    ``dense_list`` is the vector stage, computed once for all settings that share it.
    A stage feeds the next one and the result, so each is written to the shared folder once it is made.
    """
    q = questions.select("qid", "doc_id", "question", "contract_name")
    if not config.raw_query:
        q = q.withColumn("question", scoped_question("question", "contract_name", config.doc_filter))
    if not config.doc_filter:
        q = q.withColumn("doc_id", F.lit(None).cast("string"))
    stages = []
    if config.sparse:
        stages.append(materialise(bm25(index, query_terms(q), config.k_candidates, scoped=config.doc_filter), "sparse"))
    if config.dense_model:
        stages.append(materialise(dense_list.filter(F.col("rank") <= config.k_candidates), "dense"))
    last = stages[-1]
    if config.fusion:
        last = rrf(stages[0].unionByName(stages[1]), cut=config.k_candidates) if config.fusion == "rrf" else weighted(*stages, config.alpha, config.k_candidates)
        last = materialise(last, "fusion")
        stages.append(last)
    if config.reranker:
        last = materialise(rerank(last, q, chunks, scorer), "rerank")
        stages.append(last)
    stages.append(last.filter(F.col("rank") <= config.k_final).withColumn("stage", F.lit("final")))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out.select(F.lit(config.config_id).alias("config_id"), "*")


def grid(chunkings: list[str], dense_models: list[str], rerankers: list[str], scopes: tuple[bool, ...] = (True, False)) -> list[Config]:
    """Every setting: chunking × (sparse, each dense, each fusion of both) × (no reranker, each) × scope, then the raw-question controls."""
    variants: list[dict] = [{}] + [{"sparse": False, "dense_model": m} for m in dense_models]
    variants += [{"dense_model": m, "fusion": f, "alpha": a} for m in dense_models for f, a in (("rrf", None), ("weighted", 0.5))]
    out = [
        Config(c, reranker=r, doc_filter=s, raw_query=not s, **v)
        for c in chunkings for v in variants for r in [None, *rerankers] for s in scopes
    ]
    controls = [{}] + [{"sparse": False, "dense_model": m} for m in dense_models]
    return out + [Config(c, doc_filter=True, raw_query=True, **v) for c in chunkings for v in controls]
