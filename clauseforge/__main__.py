"""Commands over tables in a folder: ``python -m clauseforge COMMAND --data DIR --out DIR [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, ingest, parse, retrieval, sampling, triage
from .plans import runs
from .plans.service import QuestionService
from .session import local_session, table
from .sources import files


def manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Files of a folder with their checksums."""
    return files.checksums(spark, a.data)


def parse_command(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Documents, blocks and failures of ``pages.parquet`` (``doc_id, html``); what an earlier run parsed is kept unless ``--force``."""
    documents, blocks, failures = parse.tables_of(parse.parse_corpus(table(spark, a.data, "pages"), f"{a.out}/parse_cache", force=a.force))
    documents.write.mode("overwrite").parquet(f"{a.out}/contracts.parquet")
    blocks.write.mode("overwrite").parquet(f"{a.out}/blocks.parquet")
    failures.write.mode("overwrite").parquet(f"{a.out}/failures.parquet")
    return ingest.parse_report(spark.read.parquet(f"{a.out}/blocks.parquet"))


def chunk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chunks of every ``--strategy`` (all without one)."""
    out = chunking.run_chunking(table(spark, a.data, "contracts"), table(spark, a.data, "blocks").dropDuplicates(["block_id"]), a.strategy or chunking.STRATEGIES)
    out.write.mode("overwrite").partitionBy("strategy").parquet(f"{a.out}/chunks.parquet")
    return spark.read.parquet(f"{a.out}/chunks.parquet").groupBy("strategy").agg(F.count("*").alias("chunks"))


def index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A search index of every ``--strategy``, and the cache of their vectors for every ``--model``."""
    chunks, out = table(spark, a.data, "chunks"), []
    for s in a.strategy or chunking.STRATEGIES:
        own = retrieval.distinct_chunks(chunks, s)
        files.write_index(retrieval.build_index(own), f"{a.out}/index/{s}")
        for m in a.model or []:
            cache = spark.createDataFrame([], "model string, key string, vector array<float>")
            ingest.encode_missing(own.select("text"), cache, m).write.mode("overwrite").parquet(f"{a.out}/vectors/{files.collection(s, m)}")
        ix = files.read_index(spark, f"{a.out}/index/{s}")
        out.append(ix.totals.crossJoin(ix.terms.agg(F.count("*").alias("vocabulary"))).withColumn("strategy", F.lit(s)))
    report = out[0]
    for d in out[1:]:
        report = report.unionByName(d)
    return report


def split(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Dev and test documents."""
    return sampling.split_documents(table(spark, a.data, "contracts"), seed=a.seed)


def _resources(spark: SparkSession, a: argparse.Namespace) -> runs.Resources:
    return runs.Resources(table(spark, a.data, "questions"), table(spark, a.data, "chunks"))


def ablate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Every setting of the grid over every answerable question; a run in ``--out`` is taken up again."""
    configs = retrieval.grid(a.strategy or ["fixed"], [], ["overlap"])
    return runs.run_ablation(_resources(spark, a), table(spark, a.data, "contracts").dropDuplicates(["doc_id"]), a.out, configs)["summary"]


def matrix(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Answers and scores of the settings named by ``--config``, with the clients that need no model."""
    keys = a.config or [runs.BASELINE.format(chunking="fixed")]
    got = runs.run_matrix(_resources(spark, a), table(spark, a.data, "contracts").dropDuplicates(["doc_id"]), a.out, keys)
    return runs.matrix_summary(got["scores"], got["generation"])


def calibrate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Answers over the evidence itself, judged, and the items to label."""
    got = runs.run_calibration(table(spark, a.data, "questions"), table(spark, a.data, "contracts").dropDuplicates(["doc_id"]), table(spark, a.data, "blocks"), a.out, seed=a.seed)
    got["items"].write.mode("overwrite").json(f"{a.out}/label_items")
    return got["summary"]


def failures(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """First failing stage of every answer of a matrix run in ``--out``."""
    documents = table(spark, a.data, "contracts").dropDuplicates(["doc_id"])
    res = _resources(spark, a)
    lists = spark.read.parquet(f"{a.out}/retrieval")
    keys = [r[0] for r in lists.select("config_id").distinct().collect()]
    got = runs.run_matrix(res, documents, a.out, keys)
    return triage.summary(triage.triage_run(got, res.questions, res.chunks, documents))


def ask(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The answer to one question of one contract."""
    service = QuestionService(spark, table(spark, a.data, "contracts"), table(spark, a.data, "chunks"))
    got = service.ask(a.doc, a.question)
    return spark.createDataFrame([(got["answer"], got["abstained"], len(got["citations"]))], "answer string, abstained boolean, citations int")


COMMANDS = {"manifest": manifest, "parse": parse_command, "chunk": chunk, "index": index, "split": split, "ablation": ablate, "matrix": matrix, "calibrate": calibrate, "triage": failures, "ask": ask}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="clauseforge", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", required=True)
    p.add_argument("--out", default="")
    for name in ("strategy", "model", "config"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("--seed", default="0")
    p.add_argument("--doc", default="")
    p.add_argument("--question", default="")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    COMMANDS[a.command](spark, a).show(truncate=False)


if __name__ == "__main__":
    main()
