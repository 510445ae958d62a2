"""Filling containers of fixed capacity with texts sized in tokens.

The histogram of piece sizes (global, at most one bin per token of capacity) is
cut into at most ``BUCKETS`` length buckets by dynamic programming that
minimises the padding up to each bucket's upper bound. Batches within the token
budget are then formed over the buckets: a batch opens in the longest bucket
that has pieces left and fills the rest of its budget with the longest pieces
that still fit, from its own bucket or shorter ones. Filling from shorter
buckets departs from batches that stay inside one bucket, which would leave
nearly half of a container empty wherever pieces are longer than half of it.

All of that works on the histogram in the driver, whose size depends on the
capacities only. Pieces then get their containers by their rank in their
bucket, which is found without a task that holds a whole bucket.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import materialise

#: Length buckets of a capacity, largest capacity (the histogram has a bin per token), pieces ranked in one task.
BUCKETS, MAX_CAPACITY, RANK_BLOCK = 512, 1 << 17, 100_000
#: Public tokenizer: file of ranks in tiktoken's format (see ``vocabulary``).
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a vocabulary file of the installed public tokenizers; pass your own path instead where they lie elsewhere."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens`` of every row with a text; null texts give no row, empty ones have 0 tokens."""
    at = path or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(at).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(encode(t)) for t in b["t"]]})

    kind = documents.schema[key].dataType.simpleString()
    src = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    return src.mapInPandas(run, f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def length_buckets(histogram: dict[int, int], most: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``most`` buckets over the sizes of a histogram, with the least padding.

    Exact dynamic program for a price per bucket (its lines are met in order of
    slope, so a step is constant time); the price is found by bisection.
    """
    sizes = sorted(s for s, n in histogram.items() if n)
    if len(sizes) <= most:
        return sizes
    count, total = [0], [0]
    for s in sizes:
        count.append(count[-1] + histogram[s])
        total.append(total[-1] + histogram[s] * s)

    def solve(price: float) -> list[int]:
        # cost(j) = price + s_j * count_j - total_j + min_i (cost(i) + total_i - s_j * count_i)
        back = [0] * (len(sizes) + 1)
        hull: list[tuple[float, float, int]] = [(0.0, 0.0, 0)]
        head = 0
        for j in range(1, len(sizes) + 1):
            x = sizes[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            m, c, i = hull[head]
            cost = price + x * count[j] - total[j] + m * x + c
            back[j] = i
            m, c = -float(count[j]), cost + total[j]
            while len(hull) - head >= 2:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):
                    hull.pop()
                else:
                    break
            hull.append((m, c, j))
        bounds, j = [], len(sizes)
        while j:
            bounds.append(sizes[j - 1])
            j = back[j]
        return bounds[::-1]

    low, high = 0.0, float(sizes[-1] * count[-1] + 1)
    best = solve(high)
    for _ in range(60):
        mid = (low + high) / 2
        got = solve(mid)
        if len(got) <= most:
            best, high = got, mid
        else:
            low = mid
        if len(best) == most:
            break
    return best


@dataclass(frozen=True)
class Segment:
    """Pieces of rank ``start`` to ``end`` of a bucket: ``each`` of them go to a container, from container ``first`` on."""

    bucket: int
    start: int
    end: int
    each: int
    first: int


def fill(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Batches over a bucket histogram, as segments of ranks, and the number of containers.

    The same batch is repeated until one of its buckets runs out, so the work
    depends on the number of buckets, not on the number of pieces.
    """
    left = {b: n for b, n in counts.items() if n}
    open_sizes = sorted(left)
    used = dict.fromkeys(left, 0)
    out, container = [], 0
    while open_sizes:
        room, batch = capacity, {}
        while open_sizes and room >= open_sizes[0]:
            k = bisect_right(open_sizes, room) - 1
            while k >= 0 and left[open_sizes[k]] <= batch.get(open_sizes[k], 0):
                k -= 1
            if k < 0:
                break
            size = open_sizes[k]
            batch[size] = batch.get(size, 0) + min(room // max(size, 1) if size else left[size], left[size] - batch.get(size, 0))
            room = capacity - sum(s * n for s, n in batch.items())
            if size == 0:
                break
        times = min(left[s] // n for s, n in batch.items())
        for s, n in batch.items():
            out.append(Segment(s, used[s], used[s] + n * times, n, container))
            used[s] += n * times
            left[s] -= n * times
            if not left[s]:
                open_sizes.remove(s)
        container += times
    return out, container


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Containers of every piece: ``capacity_id, capacity_tokens, container_id, key, part, token_start, n_tokens``.

    ``sizes`` has unique ``key`` and ``n_tokens``; ``capacities`` is a small
    table ``capacity_id, capacity_tokens``. A text of more tokens than the
    capacity is split into full containers and one rest; no other is split. Texts
    without tokens take no room and go with others. Null and non-positive
    capacities and capacities beyond ``MAX_CAPACITY`` are refused. Runs two
    jobs (the histogram, and the writing of the ranked pieces' counts).
    """
    spark = sizes.sparkSession
    caps = [(r["capacity_id"], r["capacity_tokens"]) for r in capacities.select("capacity_id", "capacity_tokens").distinct().orderBy("capacity_id").limit(1001).collect()]
    if len(caps) > 1000 or any(c is None or not 0 < c <= MAX_CAPACITY for _, c in caps):
        raise ValueError(f"capacities must be 1 to {MAX_CAPACITY} tokens, and at most 1000")
    kind = sizes.schema[key].dataType
    result = T.StructType(
        [T.StructField("capacity_id", T.IntegerType()), T.StructField("capacity_tokens", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField(key, kind)]
        + [T.StructField(n, T.LongType()) for n in ("part", "token_start", "n_tokens")]
    )
    if not caps:
        return spark.createDataFrame([], result)
    each = F.array(*[F.struct(F.lit(int(i)).alias("capacity_id"), F.lit(int(c)).alias("cap")) for i, c in caps])
    per = sizes.select(F.col(key), F.col("n_tokens").alias("n"), F.explode(each).alias("c")).select(key, "n", "c.capacity_id", "c.cap")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("cap")) - 1)
    pieces = per.select(key, "capacity_id", "cap", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    pieces = pieces.withColumn("size", F.least("cap", F.col("n") - F.col("part") * F.col("cap")))

    # A full piece is counted where it arises, not once per part.
    full, rest = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("cap"))), F.col("n") - F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("cap"))) * F.col("cap")
    tallied = per.select("capacity_id", F.explode(F.array(F.struct(F.col("cap").cast("long").alias("size"), full.cast("long").alias("k")), F.struct(rest.cast("long").alias("size"), F.lit(1).cast("long").alias("k")))).alias("p"))
    rows = tallied.groupBy("capacity_id", "p.size").agg(F.sum("p.k").alias("k")).filter("k > 0").collect()

    bins, segments, total = [], [], 0
    for cid, cap in caps:
        hist = {int(r["size"]): int(r["k"]) for r in rows if r["capacity_id"] == cid}
        total += sum(hist.values())
        bounds = length_buckets(hist)
        counts: dict[int, int] = {}
        at = 0
        for s in sorted(hist):
            while bounds[at] < s:
                at += 1
            counts[bounds[at]] = counts.get(bounds[at], 0) + hist[s]
            bins.append((int(cid), s, bounds[at]))
        segments += [(int(cid), g.bucket, g.start, g.end, g.each, g.first) for g in fill(counts, cap)[0]]
    bin_table = spark.createDataFrame(bins, "capacity_id int, size long, bucket long")
    segment_table = spark.createDataFrame(segments, "capacity_id int, bucket long, start long, end long, each long, first long")

    blocks = max(1, total // RANK_BLOCK)
    # Both tables are bounded by the capacities: a row per token, and per bucket of a batch.
    ready = pieces.withColumn("size", F.col("size").cast("long")).join(F.broadcast(bin_table), ["capacity_id", "size"])
    ready = ready.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.col("part")), F.lit(blocks)))
    group = ["capacity_id", "bucket", "block"]
    if blocks > 1:
        per_block = ready.groupBy(*group).count()
        before = F.sum("count").over(W.partitionBy("capacity_id", "bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        offsets = per_block.select(*group, F.coalesce(before, F.lit(0)).alias("offset"))
        own = F.row_number().over(W.partitionBy(*group).orderBy(F.col(key), "part"))
        ranked = ready.withColumn("own", own).join(offsets, group).withColumn("rank", F.col("own") - 1 + F.col("offset"))
    else:
        ranked = ready.withColumn("rank", (F.row_number().over(W.partitionBy(*group).orderBy(F.col(key), "part")) - 1).cast("long"))
    s = F.broadcast(segment_table)
    met = ranked.join(s, (ranked["capacity_id"] == s["capacity_id"]) & (ranked["bucket"] == s["bucket"]) & (ranked["rank"] >= s["start"]) & (ranked["rank"] < s["end"]))
    return met.select(
        ranked["capacity_id"],
        F.col("cap").cast("int").alias("capacity_tokens"),
        (F.col("first") + F.floor((F.col("rank") - F.col("start")) / F.col("each"))).cast("long").alias("container_id"),
        ranked[key],
        F.col("part").cast("long").alias("part"),
        (F.col("part") * F.col("cap")).cast("long").alias("token_start"),
        ranked["size"].alias("n_tokens"),
    )


def pack_documents(documents: DataFrame, capacities: DataFrame, path: str | None = None) -> DataFrame:
    """``pack`` of the texts of ``documents``; each text is tokenised once, repeated rows count once."""
    sizes = materialise(token_sizes(documents.select("doc_id", "text"), path=path), "tokens").dropDuplicates(["doc_id"])
    return pack(sizes, capacities)


def utilisation(packed: DataFrame) -> DataFrame:
    """``capacity_id, capacity_tokens, containers, pieces, tokens, wasted_share`` of a packing."""
    per = packed.groupBy("capacity_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    out = per.groupBy("capacity_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return out.withColumn("wasted_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
