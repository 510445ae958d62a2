"""Session helpers: table access, cutting lineage in shared storage, skew handling."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this many rows on, and from the rows of one of at least ``LEAST_TASKS`` tasks on (or of as many
#: as the session shuffles to). So there are no more hot keys than tasks, and a task never gets more than its share twice.
HOT_ROWS, LEAST_TASKS = 20_000, 1000
#: Pieces that a hot key is cut into by ``salted_join``.
SALTS = 32


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session that names none (tests, a laptop) gets a temporary folder,
    once for the application; on a cluster a folder of one machine would lose
    what others write, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='clauseforge-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_SCRATCH: list[str] = []


def _sweep() -> None:
    """At the end of the process: what it wrote to the shared folder is of no more use."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):
            drop_scratch(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; it stays until ``drop_scratch``, or until the process ends with its session still there."""
    if not _SCRATCH:
        atexit.unregister(_sweep)
        atexit.register(_sweep)
    _SCRATCH.append(f"{shared_dir(spark)}/clauseforge/{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder; results that read it can't be used afterwards. The number of tables."""
    n = 0
    while _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def materialise(df: DataFrame, label: str = "t", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but stays columnar, so later reads
    prune columns and push filters. Survives the loss of executors. Runs one job.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    """Rows for Spark; plain objects, since inferred string types of an empty or all-null column don't convert."""
    return pd.DataFrame(rows, columns=list(names), dtype=object)


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS, tasks: int | None = None) -> list:
    """Keys that hold at least ``rows`` rows and the rows of a task; at most as many keys as tasks.

    One narrow pass over ``key`` with map-side counting; null is never returned.
    """
    tasks = tasks or max(LEAST_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.select(F.col(key).alias("k")).groupBy("k").count()
    big = counts.filter((F.col("count") >= rows) & F.col("k").isNotNull())
    found = big.orderBy(F.desc("count")).limit(tasks).collect()
    if not found:
        return []
    total = df.select(key).count()
    return [r["k"] for r in found if r["count"] * tasks >= total]


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", salts: int = SALTS, hot: list | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (``key`` unique in ``one``), cutting hot keys of ``many`` into pieces.

    Rows of hot keys get one of ``salts`` salts and only the matching rows of
    ``one`` are repeated per salt, so no task gets a whole hot group and the
    rest of ``one`` isn't copied. ``how`` is ``inner`` or ``left``. A null key
    matches nothing. Without hot keys this is the plain join. ``hot`` gives the
    keys where the caller could count them on something cheaper than ``many``.
    """
    hot = hot_keys(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    # No more keys than tasks, so the list is small enough for every task.
    names = many.sparkSession.createDataFrame([(k,) for k in hot], f"`{key}` {many.schema[key].dataType.simpleString()}").withColumn("_hot", F.lit(True))
    # From the row's values, not rand(): a recomputed task must give every row the same salt.
    plain = [F.col(f.name) for f in many.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    left = many.join(F.broadcast(names), key, "left")
    left = left.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = one.join(F.broadcast(names), key, "left")
    right = right.withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
