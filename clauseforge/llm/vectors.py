"""The k most similar vectors of every vector.

Vectors are projected to a few dimensions with a 2-stable (Gaussian) random
matrix, and the projections are indexed by a kd-tree whose leaves are cells of
rows. Around a vector, cells are taken in the order of their distance in the
projection and their rows are verified with the full vectors, until the
chi-square test holds: the squared projected distance of a vector at distance d
is d² times a chi-square variable with as many degrees of freedom as the
projection has dimensions, so once the next cell is farther than the quantile
``confidence`` of it for the current k-th distance, a nearer vector that was
missed is unlikely.

The tree is fitted on a bounded sample (the rows whose key's hash falls in a
share, ``SAMPLE_PER_CELL`` for each cell and ``MAX_SAMPLE`` in all), but every
usable row is indexed and asked. Cells grow in number with a model's rows, in
size from where there are more than ``CELL_ROWS``² / 4 rows on (then as their
square root), so a query's work grows as the square root, not as the rows. The index
is a table in the shared folder with one file per cell; a search task reads the
cells it needs, nearest to its block of queries first, and each query stops by
its own test. So vectors are shuffled once (to their cells) however many cells a search visits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, lgamma, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import frame, hot_keys, salted_join, scratch_path

#: Dimensions of the projection, confidence of the stopping test, neighbours.
DIMS, CONFIDENCE, K = 8, 0.7, 5
#: Rows wanted in a cell; rows that the trees are fitted on: for each cell, of a model at least, of all models at most.
CELL_ROWS, SAMPLE_PER_CELL, LEAST_SAMPLE, MAX_SAMPLE = 1024, 16, 4096, 250_000
#: Queries taken at a time (fewer where there are many cells: ``BOX_NUMBERS`` distances at a time), rows of a cell read at a
#: time, bytes of cells that a worker keeps.
QUERY_BLOCK, BOX_NUMBERS, ROW_BLOCK, KEPT_BYTES = 2048, 1 << 25, 8192, 96 << 20
#: Candidates kept beyond k before they are ordered in double precision.
SLACK = 8
#: Models whose trees are in the driver at a time; more are taken in groups.
MAX_MODELS = 1000


def chi2_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution, by bisection on the series of its incomplete gamma function."""

    def below(x: float) -> float:
        a, x = dims / 2, x / 2
        total = term = 1 / a
        k = 0
        while term > 1e-14 * total:
            k += 1
            term *= x / (a + k)
            total += term
        return total * exp(-x + a * log(x) - lgamma(a))

    low, high = 1e-12, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def cells_of(rows: int) -> float:
    """Cells wanted for so many rows of a model."""
    return max(1.0, min(rows / CELL_ROWS, 2 * rows**0.5))


class ProjectionTree:
    """Complete kd-tree over projections; ``low`` and ``high`` are the boxes of its leaves."""

    def __init__(self, sample: np.ndarray, width: int, rows: int, dims: int, seed: int = 11) -> None:
        self.matrix = np.random.default_rng(seed).normal(size=(width, dims)).astype(np.float32)
        p = unit(sample).astype(np.float32) @ self.matrix
        cells = min(cells_of(rows), max(1, len(p) / 4))
        self.depth = max(0, ceil(log2(cells)))
        inner = 2**self.depth - 1
        self.dim, self.cut = np.zeros(inner, dtype=np.int64), np.zeros(inner, dtype=np.float32)
        low, high = np.full((2 * inner + 1, dims), -np.inf, np.float32), np.full((2 * inner + 1, dims), np.inf, np.float32)
        part = {0: np.arange(len(p))}
        for node in range(inner):
            own = part.pop(node)
            d = int(p[own].std(0).argmax()) if len(own) else 0
            c = np.median(p[own, d]) if len(own) else 0.0
            self.dim[node], self.cut[node] = d, c
            a, b = 2 * node + 1, 2 * node + 2
            right = p[own, d] > c
            part[a], part[b] = own[~right], own[right]
            low[a], high[a], low[b], high[b] = low[node], high[node], low[node], high[node]
            high[a, d] = low[b, d] = c
        self.low, self.high = low[inner:], high[inner:]

    @property
    def cells(self) -> int:
        return 2**self.depth

    def cell(self, projected: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(projected), dtype=np.int64), np.arange(len(projected))
        for _ in range(self.depth):
            node = 2 * node + 1 + (projected[rows, self.dim[node]] > self.cut[node])
        return node - (self.cells - 1)

    def distances(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance of each projection to the box of each cell."""
        out = np.zeros((len(projected), self.cells), dtype=np.float32)
        for d in range(projected.shape[1]):
            x = projected[:, d, None]
            e = np.maximum(np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d]), 0)
            out += e * e
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Rows that take part (``model, key, vector``), and the width of each model: the one most of its vectors have.

    Null keys and models, null, all-zero and wrong-length vectors and those with
    a null, NaN or infinite number take no part.
    """
    v = vectors.select("model", "key", "vector").filter("model is not null and key is not null and size(vector) > 0")
    widths = v.groupBy("model", F.size("vector").alias("w")).count().groupBy("model").agg(F.max_by("w", F.struct("count", "w")).alias("w"))
    found = {r["model"]: r["w"] for r in widths.collect()}
    if not found:
        return v.limit(0), {}
    width = F.create_map(*[F.lit(x) for kv in found.items() for x in kv])[F.col("model")]
    sound = F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < float('inf'))") & F.expr("exists(vector, x -> x != 0)")
    return v.filter((F.size("vector") == width) & sound), found


def _matrix(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(-1, width)


#: Names that Arrow has for the file systems of Hadoop's schemes.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs", "viewfs": "hdfs"}


def arrow_path(path: str) -> str:
    """A Hadoop path as Arrow reads it: schemes renamed, mounted folders as local ones."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return "/" + (rest or path).lstrip("/")
    if scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def open_folder(path: str):
    """(Arrow file system, folder) of a Hadoop path."""
    from pyarrow import fs

    at = arrow_path(path)
    return fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)


class _Cells:
    """Reads cells of the index; small ones are kept while they fit."""

    def __init__(self, path: str, widths: list[int]) -> None:
        self.fs, self.root = open_folder(path)
        self.widths, self.kept, self.bytes = widths, OrderedDict(), 0

    def _files(self, slot: int) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/slot={slot}", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".parquet"))

    def blocks(self, slot: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, vectors as stored, unit vectors) of a cell, block after block in a fixed order."""
        if slot in self.kept:
            self.kept.move_to_end(slot)
            yield from self.kept[slot]
            return
        seen, size, keep = [], 0, True
        for name in self._files(slot):
            with self.fs.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(ROW_BLOCK, columns=["key", "vector"]):
                    x = _matrix(b.column("vector"), width)
                    block = (b.column("key").to_numpy(zero_copy_only=False), x, unit(x).astype(np.float32))
                    size += 2 * x.nbytes + 120 * len(x)
                    keep = keep and size <= KEPT_BYTES // 3
                    if keep:
                        seen.append(block)
                    yield block
        if keep:
            self.kept[slot] = seen
            self.bytes += size
            while self.bytes > KEPT_BYTES and len(self.kept) > 1:
                old = self.kept.popitem(last=False)[1]
                self.bytes -= sum(2 * x.nbytes + 120 * len(x) for _, x, _ in old)


def _search(cells: _Cells, tree: ProjectionTree, first: int, width: int, keys: np.ndarray, x: np.ndarray, limit: float, k: int) -> list[tuple[str, str]]:
    """Neighbours of one block of queries: cells nearest first, until the stopping test holds for every query."""
    q = unit(x).astype(np.float32)
    box = tree.distances(q @ tree.matrix)
    wide = k + 1 + SLACK
    sim = np.full((len(q), wide), -2, np.float32)
    name, vec = np.empty((len(q), wide), dtype=object), np.zeros((len(q), wide, width), np.float32)
    for c in np.argsort(box.mean(0), kind="stable"):
        # The query itself is among the first k + 1, so the last of them is at the k-th distance or nearer than it.
        kth = np.partition(sim, wide - k - 1, axis=1)[:, wide - k - 1] if wide > k + 1 else sim.min(1)
        active = np.flatnonzero(box[:, c] < limit * (2 - 2 * kth))
        if not len(active):
            continue
        for bkeys, bx, bu in cells.blocks(first + int(c), width):
            s = q[active] @ bu.T
            hit = np.flatnonzero((s > sim[active].min(1)[:, None]).any(1))
            if not len(hit):
                continue
            a, s = active[hit], s[hit]
            n = min(wide, s.shape[1])
            best = np.argpartition(s, s.shape[1] - n, axis=1)[:, -n:]
            both = np.concatenate([sim[a], np.take_along_axis(s, best, 1)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :wide]
            sim[a] = np.take_along_axis(both, order, 1)
            name[a] = np.take_along_axis(np.concatenate([name[a], bkeys[best]], axis=1), order, 1)
            vec[a] = np.take_along_axis(np.concatenate([vec[a], bx[best]], axis=1), order[:, :, None], 1)
    out = []
    exact = x.astype(np.float64)
    norm = np.sqrt((exact * exact).sum(1))
    for i, key in enumerate(keys):
        there = [j for j in range(wide) if name[i, j] is not None and name[i, j] != key]
        v = vec[i, there].astype(np.float64)
        cos = v @ exact[i] / (np.sqrt((v * v).sum(1)) * norm[i]) if there else []
        for j in sorted(range(len(there)), key=lambda j: (-cos[j], name[i, there[j]]))[:k]:
            out.append((key, name[i, there[j]]))
    return out


def nearest_pairs(vectors: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """``model, key_a, key_b`` (``key_a < key_b``): at least one is among the other's ``k`` nearest by cosine.

    Ties go to the smaller key. Runs jobs: the widths, counts and sample of the
    models, and the writing of the index. Of vectors that are equal number for number,
    only the ``k + 1`` smallest keys are indexed, which is all that any
    neighbour list can hold; the other keys of such a group have the group's
    ``k`` smallest keys as neighbours.
    """
    spark = vectors.sparkSession
    groups = ceil(vectors.agg(F.countDistinct("model")).first()[0] / MAX_MODELS)
    if groups > 1:
        parts = [nearest_pairs(vectors.filter(F.pmod(F.xxhash64("model"), F.lit(groups)) == i), k, dims, confidence) for i in range(groups)]
        return reduce(DataFrame.unionByName, parts)
    rows, widths = usable(vectors)
    schema = "model string, key_a string, key_b string"
    if not widths:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("same", F.concat_ws("-", F.xxhash64("model", "vector"), F.xxhash64(F.lit(1), "model", "vector")))
    counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    models = sorted(counts)
    # Each model gets its share of the sample's bound; by hash, so that a row's part in it doesn't depend on partitioning.
    wanted = {m: max(LEAST_SAMPLE, SAMPLE_PER_CELL * cells_of(n)) for m, n in counts.items()}
    shrink = min(1.0, MAX_SAMPLE / sum(wanted.values()))
    every = {m: max(1, ceil(n / (shrink * wanted[m]))) for m, n in counts.items()}
    step = F.create_map(*[F.lit(x) for kv in every.items() for x in kv])[F.col("model")]
    sample = rows.filter(F.pmod(F.xxhash64("key", F.lit(5)), step) == 0).select("model", "vector").limit(2 * MAX_SAMPLE).toArrow()
    names = np.asarray(sample.column("model").to_pylist(), dtype=object)
    trees: list[ProjectionTree] = []
    first = [0]
    for m in models:
        own = np.flatnonzero(names == m)
        x = _matrix(sample.column("vector").take(pa.array(own)), widths[m]) if len(own) else np.zeros((0, widths[m]), np.float32)
        trees.append(ProjectionTree(x, widths[m], counts[m], dims))
        first.append(first[-1] + trees[-1].cells)

    members = rows.select("model", "same", "key").distinct()
    heavy = members.groupBy("same").count().filter(F.col("count") > k + 1).select("same")
    rest = None
    if heavy.limit(1).count():
        # Only the first few keys of a group leave a task, and a group as large as a task's share is cut into pieces.
        hot = hot_keys(members, "same")
        members = salted_join(members, heavy, "same", hot=hot)
        smallest = members.withColumn("r", F.row_number().over(W.partitionBy("same").orderBy("key"))).filter(F.col("r") <= k + 1)
        ends = smallest.groupBy("same").agg(F.max("key").alias("last"), F.slice(F.array_sort(F.collect_list("key")), 1, k).alias("near"))
        rest = salted_join(members, ends, "same", hot=hot).filter(F.col("key") > F.col("last")).select("model", "key", "near")
        rows = salted_join(rows, ends.select("same", "last"), "same", "left", hot=hot).filter(F.col("last").isNull() | (F.col("key") <= F.col("last")))
    shared = spark.sparkContext.broadcast((models, trees, first, [widths[m] for m in models]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, start, width = shared.value
        for b in batches:
            at = {m: i for i, m in enumerate(names)}
            which = np.array([at[m] for m in b.column("model").to_pylist()], dtype=np.int64)
            slot = np.zeros(len(which), dtype=np.int32)
            for i in np.unique(which):
                rows_of = np.flatnonzero(which == i)
                x = _matrix(b.column("vector").take(pa.array(rows_of)), width[i])
                slot[rows_of] = start[i] + own[i].cell(unit(x).astype(np.float32) @ own[i].matrix)
            yield pa.RecordBatch.from_arrays([pa.array(slot), b.column("key"), b.column("vector")], names=["slot", "key", "vector"])

    path = scratch_path(spark, "vectors")
    placed = rows.select("model", "key", "vector").mapInArrow(place, "slot int, key string, vector array<float>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), first[-1] // 32)
    # Repeated rows meet in their cell, so they are dropped after the one shuffle that brings cells together.
    placed.repartition(parts, "slot").dropDuplicates(["slot", "key"]).write.partitionBy("slot").parquet(path)
    index = spark.read.schema("key string, vector array<float>, slot int").parquet(path)
    limit = chi2_quantile(confidence, dims)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own, start, width = shared.value
        cells = _Cells(path, width)
        for units in batches:
            for slot, chunk in units.itertuples(index=False):
                i = int(np.searchsorted(start, slot, side="right")) - 1
                begin, passed, found = chunk * block, 0, []
                for keys, x, _ in cells.blocks(slot, width[i]):
                    a, b = max(begin - passed, 0), min(begin + block - passed, len(keys))
                    passed += len(keys)
                    if a < b:
                        found += _search(cells, own[i], start[i], width[i], keys[a:b], x[a:b], limit, k)
                    if passed >= begin + block:
                        break
                yield frame([(names[i], min(p), max(p)) for p in found], ["model", "key_a", "key_b"])

    block = max(32, min(QUERY_BLOCK, BOX_NUMBERS // max(t.cells for t in trees)))
    sizes = index.groupBy("slot").count()
    units = sizes.select("slot", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / block).cast("int"))).alias("chunk"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, first[-1] // 16)
    pairs = units.repartitionByRange(min(tasks, max(1, first[-1])), "slot", "chunk").sortWithinPartitions("slot", "chunk").mapInPandas(search, schema)
    if rest is not None:
        near = rest.select("model", "key", F.explode("near").alias("other"))
        pairs = pairs.unionByName(near.select("model", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")))
    return pairs.distinct()
