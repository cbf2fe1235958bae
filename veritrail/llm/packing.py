"""Filling containers of fixed capacity with texts of varying length: optimal length buckets.

1. Sizes in tokens; a text larger than the capacity is split into full pieces and one rest, no other text is.
2. The histogram of sizes, at most `capacity` rows, goes to the driver. Dynamic programming over it places BUCKETS
   boundaries so that the padding, the sum of boundary minus size, is least.
3. Batches form inside each bucket: as many items as fit the token budget at the bucket's boundary. What a batch of a large
   bucket leaves is topped up with items of smaller buckets; this plan needs the counts of the buckets only.
4. Items are numbered within their bucket, over shards of it whose counts are summed up first, so that no bucket
   meets in one task; an item's number gives its container by arithmetic. The shards grow with the items, up to SHARDS.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.session import materialize

#: A shard of a bucket should hold at most SHARE items; BUCKETS x SHARDS counts are broadcast at most, some 9 MB.
BUCKETS, SHARDS, SHARE = 96, 4096, 100_000


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, size) of rows (doc_id, tokens): pieces of at most `capacity`; a text without tokens is one piece of size 0."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0))
    start = F.col("piece").cast("long") * capacity
    rows = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("int").alias("size"))


def _layer(best: np.ndarray, sizes: np.ndarray, n: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size j the least padding with one bucket more, and the size at which the bucket before the last ends.

    That size never falls as j grows, so that a j only looks between the results of its neighbours among those done before, which are twice as far apart.
    """
    m = len(sizes)
    at, new = np.full(m, k - 1), best.copy()
    step = 1 << (m - 1).bit_length()
    while step:
        j = np.arange(step - 1, m, 2 * step)
        j = j[j >= k]
        if len(j):
            lo = np.where(j >= step, at[np.maximum(j - step, 0)], k - 1)
            hi = np.minimum(np.where(j + step < m, at[np.minimum(j + step, m - 1)], m - 1), j - 1)
            many = hi - lo + 1
            first = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(first - lo, many)
            jj = np.repeat(j, many)
            cost = best[i] + sizes[jj] * (n[jj + 1] - n[i + 1]) - (w[jj + 1] - w[i + 1])
            least = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == np.repeat(least, many))
            at[j], new[j] = i[hit[np.searchsorted(hit, first)]], least
        step //= 2
    return new, at


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper ends of at most `buckets` buckets over these rising sizes with the least padding."""
    m = len(sizes)
    if m <= buckets:
        return sizes.tolist()
    n, w = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64), np.concatenate([[0], np.cumsum(counts * sizes)]).astype(np.float64)
    best = sizes * n[1:] - w[1:]  # one bucket for the first j + 1 sizes
    cut = np.zeros((buckets, m), np.int64)
    for k in range(1, buckets):
        best, at = _layer(best, sizes, n, w, k)
        cut[k] = at + 1
    ends, j, k = [], m - 1, buckets - 1
    while j >= 0:
        ends.append(int(sizes[j]))
        k = min(k, j)
        j, k = (int(cut[k, j]) - 1, k - 1) if k else (-1, 0)
    return ends[::-1]


def plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first item, items a container, first container, containers) for each share of a bucket.

    From the largest bucket down: a batch of as many items as fit, topped up from the largest smaller bucket that fits what is left.
    """
    left, used, rows, container = list(counts), [0] * len(counts), [], 0
    for b in range(len(bounds) - 1, -1, -1):
        while left[b]:
            room, batch = capacity, {}
            for x in range(b, -1, -1):
                if left[x] and bounds[x] <= room:
                    batch[x] = min(room // bounds[x], left[x])
                    room -= batch[x] * bounds[x]
            times = min(left[x] // k for x, k in batch.items())
            for x, k in batch.items():
                rows.append((x, used[x], k, container, times))
                used[x] += k * times
                left[x] -= k * times
            container += times
    return rows


def pack(sizes: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, piece, start, size, bucket, container): every piece with the boundary of its bucket and its container.

    sizes are rows (doc_id, tokens); null tokens count as 0. Pieces of size 0 fill nothing and have bucket 0 and a null container.
    Repeated rows of a doc_id are items of their own.
    """
    spark = sizes.sparkSession
    items = materialize(pieces(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")), capacity), "pieces")
    rows = items.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
    if not rows:
        return items.select("doc_id", "piece", "start", "size", F.lit(0).alias("bucket"), F.lit(None).cast("long").alias("container"))
    size, n = np.array([r["size"] for r in rows]), np.array([r["n"] for r in rows])
    ends = boundaries(size, n, buckets)
    of = np.searchsorted(ends, size)
    shares = plan(ends, np.bincount(of, n, len(ends)).astype(np.int64).tolist(), capacity)
    shards = int(min(SHARDS, max(16, n.sum() // SHARE)))
    of_size = ",".join(map(str, np.searchsorted(ends, np.arange(max(ends) + 1)).tolist()))
    bucket_of = F.get(F.split(F.lit(of_size), ",").cast("array<int>"), F.col("size"))
    full = items.filter("size > 0").withColumn("b", bucket_of).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    held = full.groupBy("b", "shard").agg(F.count("*").alias("n"))  # at most BUCKETS x shards rows
    before = F.sum("n").over(Window.partitionBy("b").orderBy("shard")) - F.col("n")
    held = held.select("b", "shard", before.alias("before"))
    numbered = full.withColumn("r", F.row_number().over(Window.partitionBy("b", "shard").orderBy("doc_id", "piece")))
    numbered = numbered.join(F.broadcast(held), ["b", "shard"]).withColumn("r", F.col("r") - 1 + F.col("before"))
    # at most a few shares for each pair of buckets
    share = spark.createDataFrame([(*map(int, s), int(ends[s[0]])) for s in shares], "b int, first long, k long, container0 long, times long, bucket int")
    inside = (F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("k") * F.col("times"))
    met = numbered.join(F.broadcast(share), "b").filter(inside)
    container = F.col("container0") + F.floor((F.col("r") - F.col("first")) / F.col("k"))
    done = met.select("doc_id", "piece", "start", "size", "bucket", container.cast("long").alias("container"))
    none = items.filter("size <= 0").select("doc_id", "piece", "start", "size", F.lit(0).alias("bucket"), F.lit(None).cast("long").alias("container"))
    return done.unionByName(none)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, items, tokens, fill): how full the containers are together."""
    n = F.countDistinct("container")
    return packed.agg(n.alias("containers"), F.count("container").alias("items"), F.sum("size").alias("tokens"), (F.sum("size") / (n * capacity)).alias("fill"))
