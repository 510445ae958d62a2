"""Comparing many settings: tuning, selection with folding, summaries and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tune_alpha(scores: DataFrame) -> DataFrame:
    """Best ``alpha`` per (chunking, model) on dev questions: by mean mrr, then recall, rounded to 4 digits; ties go to the smaller alpha."""
    m = scores.filter("split = 'dev'").groupBy("chunking", "model", "alpha").agg(F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("recall"), 4).alias("recall"))
    w = W.partitionBy("chunking", "model").orderBy(F.desc("mrr"), F.desc("recall"), "alpha")
    return m.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def summarise(scores: DataFrame, splits: DataFrame) -> DataFrame:
    """``config_id, split, n, context_recall, mrr, ndcg_at_10``: means rounded to 4 digits, nulls skipped."""
    s = scores.join(splits.select("qid", "split"), "qid")
    return s.groupBy("config_id", "split").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in ("context_recall", "mrr", "ndcg_at_10")])


def select_configs(scores: DataFrame, order: DataFrame, most: int = 8) -> DataFrame:
    """Settings chosen on dev, best first: ``config_id, place, folded``. Settings with the same scores on every question fold into the first of them.

    ``scores``: dev rows ``config_id, qid, context_recall, mrr``; ``order``: ``config_id, grid_order`` for ties.
    """
    # A signature that is summed up needs no list of a setting's questions: two sums of hashes of each row.
    row = lambda k: F.sum(F.pmod(F.xxhash64(F.lit(k), "qid", "context_recall", "mrr"), F.lit(1 << 40)))
    per = scores.groupBy("config_id").agg(
        F.concat_ws("-", row(1), row(2), F.count("*")).alias("sig"), F.round(F.avg("context_recall"), 10).alias("cr"), F.round(F.avg("mrr"), 10).alias("m"),
    ).join(order, "config_id")
    best = W.partitionBy("sig").orderBy("grid_order")
    kept = per.withColumn("r", F.row_number().over(best)).withColumn("folded", F.count("*").over(W.partitionBy("sig")) - 1).filter("r = 1")
    top = kept.orderBy(F.desc("cr"), F.desc("m"), "grid_order").limit(most)
    place = F.row_number().over(W.orderBy(F.desc("cr"), F.desc("m"), "grid_order"))
    return top.withColumn("place", place.cast("bigint")).select("config_id", "place", "folded")


def best_per(scores: DataFrame, group: str) -> DataFrame:
    """Best setting of each group by (context_recall, mrr), nulls last, then grid order: one row per group."""
    w = W.partitionBy(group).orderBy(F.desc_nulls_last("context_recall"), F.desc_nulls_last("mrr"), "grid_order")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def ordered_union(lists: list[DataFrame], key: str) -> DataFrame:
    """Rows of all lists in turn, each key once at its first place; lists are ``key, place``."""
    out = None
    for k, d in enumerate(lists):
        part = d.select(key, F.struct(F.lit(k).alias("list"), F.col("place").cast("bigint").alias("place")).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("at").alias("at")).orderBy("at").select(key, "at.list", "at.place")


def candidate_pool(chunks: DataFrame, k: int = 50) -> DataFrame:
    """Per strategy: documents, upper median of chunks per document, share of documents with at most ``k`` chunks.

    Counts of counts come first, so the median needs no sort of all documents.
    """
    per = chunks.groupBy("strategy", "doc_id").agg(F.countDistinct("chunk_id").alias("c"))
    hist = per.groupBy("strategy", "c").agg(F.count("*").alias("d"))
    w = W.partitionBy("strategy").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    h = hist.withColumn("end", F.sum("d").over(w)).withColumn("n", F.sum("d").over(W.partitionBy("strategy")))
    return h.groupBy("strategy").agg(
        F.max("n").alias("documents"),
        F.min(F.when(F.col("end") >= F.floor(F.col("n") / 2) + 1, F.col("c"))).alias("median_chunks"),
        F.round(F.sum(F.when(F.col("c") <= k, F.col("d")).otherwise(0)) / F.max("n"), 6).alias("share_within"),
    )


def content_key(lists: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``config_id, qid, content_key``: equal keys have the same question and the same chunks in the same order, so one answer serves them all."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    per = lists.groupBy("config_id", "qid", *(extra or [])).agg(ids.alias("ids"))
    return per.select("config_id", "qid", F.sha2(F.concat_ws("::", "qid", *(extra or []), F.array_join("ids", "|")), 256).alias("content_key"))


def latency(runs: DataFrame) -> DataFrame:
    """Median, 95th percentile and count of each component of ``latency_ms``; one row per component."""
    each = runs.select(F.explode("latency_ms").alias("component", "ms"))
    return each.groupBy("component").agg(F.count("*").alias("n"), F.median("ms").alias("median_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
