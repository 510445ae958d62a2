"""Retrieval metrics, their uncertainty, comparisons and rater agreement. Undefined metrics are null, never 0, and means skip nulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.udfs import bootstrap, poisson_rounds

KS = (1, 3, 5, 10, 20)
KEY = ["config_id", "qid"]


def score_lists(ranked: DataFrame, span_chunks: DataFrame, ks: tuple[int, ...] = KS, budgets: DataFrame | None = None) -> DataFrame:
    """Metrics of each list (``config_id, qid, rank, chunk_id``) against ``qid, span_index, chunk_id`` (null chunk: an uncovered span).

    ``config_id, qid, recall_at map, chunk_recall, hit, mrr, ndcg_at_10, context_precision, context_recall``.
    Questions without placed evidence have nulls. Context metrics use the number
    of rows returned as their budget, or ``budgets`` (``config_id, qid, budget``)
    where a stage is judged by its final list's. One pass over the lists, one over the hits.
    """
    n = ranked.groupBy(*KEY).agg(F.count("*").alias("budget")) if budgets is None else budgets
    lists = ranked.select(*KEY, "rank", "chunk_id").distinct().join(n, KEY)
    need = span_chunks.groupBy("qid").agg(F.countDistinct("span_index").alias("spans"), F.countDistinct("chunk_id").alias("relevant"))
    held = span_chunks.filter("chunk_id is not null").select("qid", "span_index", "chunk_id").distinct()
    best = lists.join(held, ["qid", "chunk_id"]).groupBy(*KEY, "span_index", "budget").agg(F.min("rank").alias("best"))
    recall = best.groupBy(*KEY).agg(
        *[F.sum((F.col("best") <= k).cast("long")).alias(f"s{k}") for k in ks], F.sum((F.col("best") <= F.col("budget")).cast("long")).alias("sb")
    )
    hits = lists.join(held.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"])
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy("rank"))
    h = hits.withColumn("nth", nth).groupBy(*KEY).agg(
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.avg(F.when(F.col("rank") <= F.col("budget"), F.col("nth") / F.col("rank"))).alias("cp"),
        F.sum((F.col("rank") <= F.col("budget")).cast("long")).alias("hits"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = n.select(*KEY).join(need, "qid", "left").join(recall, KEY, "left").join(h, KEY, "left")
    known, some = F.col("spans") > 0, F.col("relevant") > 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *KEY,
        F.when(known, F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[zero(F.col(f"s{k}")) / F.col("spans") for k in ks]))).alias("recall_at"),
        F.when(some, zero(F.col("hits")) / F.col("relevant")).alias("chunk_recall"),
        F.when(some, (zero(F.col("hits")) > 0).cast("double")).alias("hit"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, zero(F.col("dcg")) / ideal).alias("ndcg_at_10"),
        F.when(some, F.coalesce("cp", F.lit(0.0))).alias("context_precision"),
        F.when(known, zero(F.col("sb")) / F.col("spans")).alias("context_recall"),
    )


FLOATS = ("mrr", "ndcg_at_10", "context_precision", "context_recall")


def metric_table(scores: DataFrame, floats: tuple[str, ...] = FLOATS) -> DataFrame:
    """Long form ``config_id, qid, metric, value``; nulls are left out, ``recall_at[k]`` becomes ``recall@k``."""
    wide = scores.select(*KEY, F.explode(F.map_concat(
        F.coalesce(F.transform_keys("recall_at", lambda k, _: F.concat(F.lit("recall@"), k.cast("string"))), F.create_map().cast("map<string,double>")),
        F.create_map(*[x for f in floats for x in (F.lit(f), F.col(f))]),
    )).alias("metric", "value"))
    return wide.filter("value is not null")


def bootstrap_native(values: DataFrame, group: list[str], value: str, key: str, n_boot: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Mean, interval and count per group by a percentile bootstrap that weights rows, so that no group is gathered.

    In each round a row counts as often as a Poisson number of mean 1, drawn
    from the round and ``key``, says; a round's mean is the weighted one. Tasks
    sum all rounds of their rows, and those sums are added up: what is shuffled
    grows with groups, rounds and tasks, not with rows. Equal keys draw equal
    numbers in every group, so paired groups are resampled alike. Rounds without weight drop.
    """
    kinds = ", ".join(f"{g} {values.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*g, x[0].tolist(), x[1].tolist()) for g, x in sums.items()], columns=[*group, "w", "v"])
            sums.clear()
            return out

        for b in batches:
            keys, codes = np.unique(b[key].astype(str), return_inverse=True)
            of = b.groupby(group, sort=False, dropna=False).indices
            x = b[value].to_numpy(dtype=float)
            for a in range(0, len(keys), 512):
                weights = np.stack([poisson_rounds(k, n_boot) for k in keys[a : a + 512]]).astype(float)
                for g, rows in of.items():
                    rows = rows[(codes[rows] >= a) & (codes[rows] < a + 512)]
                    if len(rows):
                        w = weights[codes[rows] - a]
                        own = sums.setdefault(g if isinstance(g, tuple) else (g,), np.zeros((2, n_boot)))
                        own += np.stack([w.sum(0), x[rows] @ w])
            if len(sums) > 4096:
                yield flush()
        yield flush()

    some = values.filter(F.col(value).isNotNull()).select(*group, F.col(key).cast("string").alias(key), F.col(value).cast("double").alias(value))
    part = some.mapInPandas(run, f"{kinds}, w array<double>, v array<double>")
    rounds = part.select(*group, F.posexplode(F.arrays_zip("w", "v")).alias("_round", "x")).groupBy(*group, "_round").agg(F.sum("x.w").alias("w"), F.sum("x.v").alias("v"))
    means = rounds.filter("w > 0").withColumn("_m", F.col("v") / F.col("w"))
    ends = means.groupBy(*group).agg(F.percentile("_m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("ci_high"))
    mean = some.groupBy(*group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return mean.join(ends, group)


def bootstrap_exact(values: DataFrame, group: list[str], value: str, key: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The same with numpy's generator, for parity with published intervals; a group (one metric's questions) is one Python call."""
    kinds = ", ".join(f"{g} {values.schema[g].dataType.simpleString()}" for g in group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[value].to_numpy(dtype=float)
        mean, low, high = bootstrap(x, n_boot, alpha, seed)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "mean": [mean], "ci_low": [low], "ci_high": [high], "n": [len(x)]})

    return values.filter(F.col(value).isNotNull()).select(*group, key, value).groupBy(*group).applyInPandas(run, f"{kinds}, mean double, ci_low double, ci_high double, n long")


def paired(table: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """``metric, qid, diff``: candidate minus baseline on the questions both have a value for."""
    a = table.filter(F.col("config_id") == baseline).select("metric", "qid", F.col("value").alias("a"))
    b = table.filter(F.col("config_id") == candidate).select("metric", "qid", F.col("value").alias("b"))
    return a.join(b, ["metric", "qid"]).select("metric", "qid", (F.col("b") - F.col("a")).alias("diff"))


def paired_difference(table: DataFrame, baseline: str, candidate: str, n_boot: int = 2000) -> DataFrame:
    """Mean difference with its interval per metric; ``significant`` when the interval leaves out 0."""
    return _significant(bootstrap_native(paired(table, baseline, candidate), ["metric"], "diff", "qid", n_boot))


def paired_difference_exact(table: DataFrame, baseline: str, candidate: str, n_boot: int = 2000) -> DataFrame:
    """The same with numpy's generator."""
    return _significant(bootstrap_exact(paired(table, baseline, candidate), ["metric"], "diff", "qid", n_boot))


def _significant(d: DataFrame) -> DataFrame:
    return d.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def agreement(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Agreement of two raters' labels per group: ``n, percent_agreement, kappa, band``; rows with a null on either side drop.

    Kappa is 1 when chance alone agrees fully. Counted per label pair first, so rows are shuffled as counts.
    """
    by = by or []
    c = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    total = c.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    left, right = (c.groupBy(*by, F.col(x).alias("_l")).agg(F.sum("_n").alias(y)) for x, y in (("_a", "_ka"), ("_b", "_kb")))
    chance = left.join(right, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_ka") * F.col("_kb")).alias("_cross"))
    out = total.join(chance, by, "left") if by else total.crossJoin(chance)
    po, pe = F.col("_same") / F.col("n"), F.coalesce("_cross", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    return out.select(*by, F.col("n").cast("bigint").alias("n"), po.alias("percent_agreement"), kappa.alias("kappa"), kappa_band(kappa).alias("band"))


def confusion(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """How often each pair of labels was given: ``by, a, b, n``; rows with a null on either side drop."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), a, b).agg(F.count("*").alias("n"))


def judge_labels(scores: DataFrame) -> DataFrame:
    """``qid, faithful, correct`` as a person would label them: yes and no, yes, partial and no; unknown scores are null."""
    faithful = F.when(F.col("faithfulness") == 1.0, "yes").when(F.col("faithfulness").isNotNull(), "no")
    correct = F.when(F.col("answer_correctness") == 1.0, "yes").when(F.col("answer_correctness") == 0.5, "partial").when(F.col("answer_correctness") == 0.0, "no")
    return scores.select("qid", faithful.alias("faithful"), correct.alias("correct"))


def agreement_report(human: DataFrame, judged: DataFrame, fields: tuple[str, ...] = ("faithful", "correct")) -> DataFrame:
    """``field, n, percent_agreement, kappa, band, confusion`` of people's labels and a judge's (``qid`` and the fields each)."""
    met = human.select("qid", *[F.col(f).alias(f"h_{f}") for f in fields]).join(judged.select("qid", *[F.col(f).alias(f"j_{f}") for f in fields]), "qid")
    each = met.select("qid", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"h_{f}").alias("human"), F.col(f"j_{f}").alias("judge")) for f in fields])).alias("x"))
    rows = each.select("x.*").filter("human <> ''")
    n = confusion(rows, "human", "judge", ["field"]).groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(" -> ", "human", "judge").alias("k"), "n")))).alias("confusion"))
    return agreement(rows, "human", "judge", ["field"]).join(n, "field")


def score_stages(lists: DataFrame, span_chunks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``score_lists`` of every stage of long-form lists, under ``config_id@stage`` but for the final one; each is judged by its final list's length."""
    budget = lists.filter("stage = 'final'").groupBy(*KEY).agg(F.count("*").alias("budget"))
    name = F.when(F.col("stage") == "final", F.col("config_id")).otherwise(F.concat_ws("@", "config_id", "stage"))
    each = lists.withColumn("_name", name)
    budgets = each.select(*KEY, "_name").distinct().join(budget, KEY).select(F.col("_name").alias("config_id"), "qid", "budget")
    return score_lists(each.select(F.col("_name").alias("config_id"), "qid", "rank", "chunk_id"), span_chunks, ks, budgets)


def kappa_band(k: Column) -> Column:
    """Verbal band of a kappa, upper bounds included."""
    # The usual bands of agreement.
    return (
        F.when(k <= 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")
    )


def nearest_rank(values: Column, p: float) -> Column:
    """Element of the sorted values at the rounded (half to even) place ``(n - 1) · p``; null for none."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(p), 0) + 1).cast("int")))


def nearest_rank_by(df: DataFrame, group: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles of a group without gathering it: distinct values are counted and ranked by running sums."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*group).orderBy("_v")
    ends = counts.withColumn("_end", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*group)))
    at = lambda p: F.bround((F.col("_n") - 1) * F.lit(p), 0) + 1
    return ends.groupBy(*group).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_end") >= at(p), F.col("_v"))).alias(f"p{round(p * 100)}") for p in ps])
