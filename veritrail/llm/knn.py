"""Most similar vectors for every vector: NN-descent by Spark joins, and greedy search on the graph it leaves.

1. Usable vectors are reduced to one per direction (unit vectors equal to six decimals): copies, of which one group may
   hold a third of all rows, get their neighbours from their representative and from each other.
2. Start: for each of TREES sets of 63 random hyperplanes, the vectors are sorted by their sign bits, which is the order
   of the leaves of a random projection tree, and each meets the vectors up to half a BLOCK before and after it.
3. Descent: every vector w joins its neighbours and those it is a neighbour of, pairwise, as far as one side is new since the
   last round; pairs that beat the K-th neighbour of either side become its neighbours. The work is co-partitioned by the block
   that w has in the first tree, so that a vector is sent once to a block rather than once to each list it is in.
   Ends when fewer than SETTLED of all entries are new, or after ROUNDS.
Blocks have a bounded size, and the lists have at most K and REVERSE entries, so that no dense region makes a large task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.skew import skewed_lookup
from veritrail.session import materialize

DIM, TREES, BLOCK, K, REVERSE, ROUNDS, SETTLED = 64, 8, 1024, 14, 12, 4, 0.01
#: Edges of a smaller cosine don't enter the graph of nearest_pairs: they lead no neighbour of 0.85 to another. That of search has no such floor.
FLOOR = 0.75

#: Leaf blocks of the first tree that make a block of the descent.
HOME = 4
#: Cosines are screened in single precision, this much below what counts, and then taken in double.
SLACK = 1e-5

LISTS = "u long, home long, nbrs array<struct<s:double,v:long,f:boolean>>"
_NBR = pa.struct([("s", pa.float64()), ("v", pa.int64()), ("f", pa.bool_())])
_SCHEMA = pa.schema([("u", pa.int64()), ("home", pa.int64()), ("nbrs", pa.list_(_NBR))])


def usable(vec: Column, dim: int = DIM) -> Column:
    """Exactly dim finite values, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list or binary column of float32 as unit rows in double."""
    if pa.types.is_binary(column.type):
        x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)
    else:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = np.random.default_rng(11).integers(0, 2**63, DIM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        if b.num_rows:
            q = np.round(_matrix(b.column("embedding")) * 1e6).astype(np.int64).view(np.uint64)
            h = (q * a).sum(axis=1, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id_hex"), pa.array(h.view(np.int64)), pa.array([r.tobytes() for r in raw], pa.binary())], ["id_hex", "u", "vec"])


def members(node_vec: DataFrame) -> DataFrame:
    """(id_hex, u, vec): one row per usable id; u stands for its direction. Of different rows of one id the smallest vector counts."""
    ok = node_vec.filter(F.col("id").isNotNull() & usable(F.col("embedding")))
    one = ok.groupBy(F.lower(F.hex("id")).alias("id_hex")).agg(F.min("embedding").alias("embedding"))
    return one.mapInArrow(_directions, "id_hex string, u long, vec binary")


def _codes(tree: int, x: np.ndarray) -> np.ndarray:
    r = np.random.default_rng(1000 + tree).standard_normal((x.shape[1], 63))
    return ((x @ r > 0).astype(np.int64) << np.arange(62, -1, -1)).sum(axis=1)


def _planted(trees: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(_codes(t, x)), *b.columns], ["tree", "code", *b.schema.names])

    return run


def _top(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by u, the k largest s of each u, without repeated (u, v)."""
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    fresh = np.ones(len(u), bool)
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[fresh], v[fresh], s[fresh]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    keep = rank < k
    return u[keep], v[keep], s[keep]


def _lists(ids: np.ndarray, u: np.ndarray, v: np.ndarray, s: np.ndarray, home: int | None) -> pa.RecordBatch:
    """Entries sorted by u (row numbers into ids) as one list per row number in range(len(ids)); home goes into each."""
    offsets = np.searchsorted(u, np.arange(len(ids) + 1)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(s), pa.array(ids[v]), pa.array(np.ones(len(v), bool))], fields=list(_NBR))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([home] * len(ids), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), entries)], schema=_SCHEMA)


def _cosines(x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows of a matrix of unit rows, in double, rounded to 9 decimals."""
    return np.round(np.einsum("ij,ij->i", x[u], x[v]), 9) if len(u) else np.zeros(0)


def _leaves(batches: Iterator[pa.RecordBatch], floor: float = FLOOR, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows (tree, u, vec) sorted by (tree, code) to lists; the first tree gives each u its home block."""
    part, seq = TaskContext.get().partitionId(), 0
    half = size // 2
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block(t: int, ids: np.ndarray, x: np.ndarray, old: int) -> Iterator[pa.RecordBatch]:
        """The first `old` rows were in the block before; pairs of two of them are done."""
        near = x.astype(np.float32)
        s = near @ near.T
        np.fill_diagonal(s, -2)
        s[:old, :old] = -2
        n, k = len(ids), min(K, len(ids) - 1)
        if k > 0:
            v = np.argpartition(s, n - k, axis=1)[:, n - k :].ravel()
            u = np.repeat(np.arange(n), k)
            ok = s[u, v] >= max(floor - SLACK, -1.5)
            u, v = u[ok], v[ok]
            sim = _cosines(x, u, v)
            ok = sim >= floor
            u, v, sim = _top(u[ok], v[ok], sim[ok], K)
        else:
            u, v, sim = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        home = part * 2**32 + seq // HOME if t == 0 else None
        out = _lists(ids, u, v, sim, home)
        if old:
            out = pa.RecordBatch.from_arrays([out.column(0), pa.array([None] * old + [home] * (len(ids) - old), pa.int64()), out.column(2)], schema=_SCHEMA)
        yield out if t == 0 else out.filter(pa.compute.greater(pa.compute.list_value_length(out.column(2)), 0))

    import pyarrow.compute  # noqa: F401

    old, tree = 0, -1
    ids, x = np.zeros(0, np.int64), np.zeros((0, DIM))
    del held
    for b in batches:
        trees, uid, mat = b.column("tree").to_numpy(), b.column("u").to_numpy(), _matrix(b.column("vec")) if b.num_rows else None
        for t in np.unique(trees):
            at = trees == t
            if t != tree:
                if len(ids) > old:
                    yield from block(tree, ids, x, old)
                    seq += 1
                tree, old, ids, x = int(t), 0, uid[at], mat[at]
            else:
                ids, x = np.concatenate([ids, uid[at]]), np.concatenate([x, mat[at]])
            while len(ids) > size + half:
                yield from block(tree, ids[:size], x[:size], old)
                seq += 1
                ids, x, old = ids[half:], x[half:], half
    if len(ids) > old:
        yield from block(tree, ids, x, old)


def _merged(lists: DataFrame, k: int = K) -> DataFrame:
    """One list per u: the k best of all its entries, those known before (f false) before new ones."""
    g = lists.groupBy("u").agg(F.max("home").alias("home"), F.sort_array(F.flatten(F.collect_list("nbrs")), asc=False).alias("n"))
    last = lambda x, i: F.coalesce(x["v"] != F.get("n", i + 1)["v"], F.lit(True))
    return g.select("u", "home", F.slice(F.filter("n", last), 1, k).alias("nbrs"))


def _local_join(batches: Iterator[pa.RecordBatch], floor: float = FLOOR) -> Iterator[pa.RecordBatch]:
    """Rows of a block, vectors first, then the lists of its centres; to new entries of the vectors' lists."""
    block = None
    vec, mid, kth, rows = [], [], [], []

    def run() -> Iterator[pa.RecordBatch]:
        if not rows or not mid:
            return
        ids = np.concatenate(mid)
        x, low = np.concatenate(vec), np.concatenate(kth)
        order = np.argsort(ids)
        ids, x, low = ids[order], x[order], low[order]
        near, least = x.astype(np.float32), np.maximum(low, floor).astype(np.float32) - np.float32(SLACK)
        width = max(len(m) for m, _ in rows)
        found = []
        for c in range(0, len(rows), 256):
            part = rows[c : c + 256]
            at, new = np.zeros((len(part), width), np.int64), np.zeros((len(part), width), bool)
            there = np.zeros((len(part), width), bool)
            for i, (m, f) in enumerate(part):
                at[i, : len(m)], new[i, : len(m)], there[i, : len(m)] = np.searchsorted(ids, m), f, True
            some = near[at]
            s = np.matmul(some, some.transpose(0, 2, 1))
            ok = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (s > least[at][:, :, None])
            ok &= ~np.eye(width, dtype=bool)
            r, i, j = np.nonzero(ok)
            u, v = at[r, i], at[r, j]
            exact = _cosines(x, u, v)
            keep = (exact >= floor) & (exact > low[u])
            found.append((u[keep], v[keep], exact[keep]))
        u, v, s = (np.concatenate(p) for p in zip(*found, strict=True))
        ok = u != v
        u, v, s = _top(u[ok], v[ok], s[ok], K)
        if len(u):
            out = _lists(ids, u, v, s, None)
            yield out.filter(pa.compute.greater(pa.compute.list_value_length(out.column(2)), 0))

    import pyarrow.compute  # noqa: F401

    for b in batches:
        blocks, has = b.column("b").to_numpy(), b.column("vec").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            if lo == hi:
                continue
            if blocks[lo] != block:
                yield from run()
                block, vec, mid, kth, rows = blocks[lo], [], [], [], []
            n = int(has[lo:hi].sum())
            if n:
                p = b.slice(lo, n)
                vec.append(_matrix(p.column("vec")))
                mid.append(p.column("m").to_numpy())
                kth.append(p.column("kth").to_numpy())
            for ms in b.slice(lo + n, hi - lo - n).column("ms").to_pylist():
                rows.append((np.fromiter((e["m"] for e in ms), np.int64, len(ms)), np.fromiter((e["f"] for e in ms), bool, len(ms))))
    yield from run()


def _reverse(graph: DataFrame) -> DataFrame:
    """(v, u, f): each entry turned round, at most REVERSE for a v, new ones first."""
    flat = graph.select("u", F.inline("nbrs")).select("u", "v", "f")
    pick = Window.partitionBy("v").orderBy(F.desc("f"), F.xxhash64("u", "v"), "u")
    return flat.withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= REVERSE).drop("r")


def _round(graph: DataFrame, vectors: DataFrame, floor: float = FLOOR) -> DataFrame:
    flat = graph.select("u", "home", F.inline("nbrs"))
    forward = flat.select(F.col("u").alias("w"), F.col("home").alias("b"), F.col("v").alias("m"), "f")
    homes = graph.select(F.col("u").alias("v"), "home")
    back = _reverse(graph).join(homes, "v").select(F.col("v").alias("w"), F.col("home").alias("b"), F.col("u").alias("m"), "f")
    each = forward.unionByName(back).groupBy("w", "b", "m").agg(F.max("f").alias("f"))
    centres = each.groupBy("w", "b").agg(F.collect_list(F.struct("m", "f")).alias("ms")).filter(F.exists("ms", lambda e: e["f"]) & (F.size("ms") > 1))
    centres = materialize(centres.select("b", "ms"), "centres")
    need = centres.select("b", F.explode("ms").alias("e")).select("b", F.col("e.m").alias("m")).distinct()
    full = graph.select(F.col("u").alias("m"), F.when(F.size("nbrs") >= K, F.element_at("nbrs", -1)["s"]).otherwise(F.lit(-2.0)).alias("kth"))
    sent = need.join(vectors.withColumnRenamed("u", "m"), "m").join(full, "m").select("b", F.lit(0).alias("tag"), "m", "vec", "kth")
    both = sent.unionByName(centres.select("b", F.lit(1).alias("tag"), "ms"), allowMissingColumns=True)
    n = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(n, "b").sortWithinPartitions("b", "tag").mapInArrow(partial(_local_join, floor=floor), LISTS)
    known = graph.withColumn("nbrs", F.transform("nbrs", lambda e: F.struct(e["s"].alias("s"), e["v"].alias("v"), F.lit(False).alias("f"))))
    return _merged(known.unionByName(found))


def nn_descent(vectors: DataFrame, rounds: int = ROUNDS, trees: int = TREES, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """(u, home, nbrs): the neighbour graph over vectors (u, vec), which must be distinct; nbrs are (s, v, f) by falling cosine s, of floor or more."""
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planted = vectors.mapInArrow(_planted(trees), "tree int, code long, u long, vec binary")
    leaves = planted.repartitionByRange(n * 2, "tree", "code").sortWithinPartitions("tree", "code", "u").mapInArrow(partial(_leaves, floor=floor, size=block), LISTS)
    graph = materialize(_merged(leaves), "graph")
    for _ in range(rounds):
        graph = materialize(_round(graph, vectors, floor), "graph")
        new, entries = graph.agg(F.sum(F.size(F.filter("nbrs", lambda e: e["f"]))), F.sum(F.size("nbrs"))).first()
        if not entries or new < SETTLED * entries:
            break
    return graph


def nearest_pairs(node_vec: DataFrame, k: int = 10, least: float = 0.85) -> DataFrame:
    """(id_a, id_b), smaller first: at least one is among the k nearest of the other, at a cosine of `least` or more.

    Cosines are taken in double and rounded to 9 decimals; ties go to the smaller hex id. Null, empty, all-zero,
    non-finite vectors and those of another length take no part; k must be below K.
    """
    rows = materialize(members(node_vec), "vectors")
    vectors = rows.groupBy("u").agg(F.min_by("vec", "id_hex").alias("vec"))
    vectors = materialize(vectors, "directions")
    graph = nn_descent(vectors)
    w = Window.partitionBy("u").orderBy("id_hex")
    head = rows.select("u", "id_hex").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("u", "id_hex")
    near = graph.select("u", F.inline("nbrs")).filter(F.col("s") >= least).select("u", "s", "v")
    near = near.join(head.select(F.col("u").alias("v"), F.col("id_hex").alias("other")), "v").select("u", (-F.col("s")).alias("d"), "other")
    near = near.unionByName(head.select("u", F.lit(-1.0).alias("d"), F.col("id_hex").alias("other")))
    best = near.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("best"))
    own = skewed_lookup(rows.select("u", "id_hex"), materialize(best, "best"), ["u"], "inner")
    others = F.slice(F.filter(F.col("best.other"), lambda o: o != F.col("id_hex")), 1, k)
    pairs = own.select("id_hex", F.explode(others).alias("other"))
    return pairs.select(F.least("id_hex", "other").alias("id_a"), F.greatest("id_hex", "other").alias("id_b")).distinct()


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, qvec, v, vec) to (q, v, s)."""
    for b in batches:
        if b.num_rows:
            s = np.round((_matrix(b.column("qvec")) * _matrix(b.column("vec"))).sum(axis=1), 9)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(s)], ["q", "v", "s"])


def graph_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = 64, step: int = 16) -> DataFrame:
    """(q, v, s): about the k nearest vectors of each query (q, qvec), by greedy search on the graph.

    A query enters at the vectors beside its own place in the order of the first TREES trees, then, round after round, opens the `step` best
    vectors it has not opened, scores their neighbours, and keeps the `beam` best; it ends when nothing is left to open, as what is
    opened stays so and what fell out of the beam can't come back. Edges are followed both ways. Bounded lists only; vectors are (u, vec).
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = vectors.select("u", "vec", F.lit(None).cast("string").alias("q")).unionByName(queries.select(F.lit(None).cast("long").alias("u"), F.col("qvec").alias("vec"), "q"))
    planted = both.mapInArrow(_planted(TREES), "tree int, code long, u long, vec binary, q string").drop("vec")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, waiting = [], []  # the last vectors, and queries that still look ahead
        for b in batches:
            qs, vs = [], []
            for u, q in zip(b.column("u").to_pylist(), b.column("q").to_pylist(), strict=True):
                if q is None:
                    near = [*near[-3:], u]
                    qs += [w[0] for w in waiting]
                    vs += [u] * len(waiting)
                    waiting = [(w, left - 1) for w, left in waiting if left > 1]
                else:
                    qs += [q] * len(near)
                    vs += near
                    waiting.append((q, 4))
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.string()), pa.array(vs, pa.int64())], ["q", "v"])

    seeds = planted.repartitionByRange(n, "tree", "code").sortWithinPartitions("tree", "code").mapInArrow(beside, "q string, v long").distinct()
    score = lambda c: c.join(queries, "q").join(vectors.withColumnRenamed("u", "v"), "v").select("q", "qvec", "v", "vec").mapInArrow(_scored, "q string, v long, s double")
    entry = lambda c, opened: c.select("q", F.struct("s", "v", F.lit(opened).alias("open")).alias("e"))
    keep = lambda c: c.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("e"), asc=False), 1, beam).alias("best"))
    both = graph.select("u", F.explode("nbrs.v").alias("v")).unionByName(_reverse(graph).select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = materialize(both.groupBy("u").agg(F.collect_set("v").alias("vs")), "links")  # at most K + REVERSE each
    state = materialize(keep(entry(score(seeds), True)), "beam")
    while True:
        opening = state.select("q", F.slice(F.filter("best", lambda e: e["open"]), 1, step).alias("now"), F.transform("best", lambda e: e["v"]).alias("seen"))
        opening = opening.filter(F.size("now") > 0)
        if opening.isEmpty():
            break
        next_ = opening.select("q", "seen", F.explode("now.v").alias("u")).join(links, "u").select("q", "seen", F.explode("vs").alias("v"))
        fresh = score(next_.filter(~F.array_contains("seen", F.col("v"))).select("q", "v").distinct())
        rank = F.transform(F.filter("best", lambda e: e["open"]), lambda e: e["v"])
        closed = F.transform("best", lambda e: F.struct(e["s"].alias("s"), e["v"].alias("v"), (e["open"] & ~F.array_contains(F.slice(rank, 1, step), e["v"])).alias("open")))
        old = state.select("q", F.explode(closed).alias("e"))
        state = materialize(keep(old.unionByName(entry(fresh, True))), "beam")
    return state.select("q", F.inline(F.slice("best", 1, k))).select("q", "v", "s")


def search(node_vec: DataFrame, k: int = 10) -> DataFrame:
    """(id_hex, other_hex, cosine): the k nearest other ids of every usable vector whose id is divisible by 20, by greedy graph search against all.

    There is no lowest cosine, so that the graph keeps the best edges of every vector, and starts from more trees than that of nearest_pairs, as in data without
    close neighbours the leaves find more than the descent. Copies of a direction are ids of their own; ties go to the smaller hex id.
    """
    rows = materialize(members(node_vec), "vectors")
    vectors = materialize(rows.groupBy("u").agg(F.min_by("vec", "id_hex").alias("vec")), "directions")
    graph = nn_descent(vectors, rounds=2, trees=12, floor=-1.0)
    ask = rows.filter(F.conv("id_hex", 16, 10).cast("decimal(20,0)") % 20 == 0).select(F.col("id_hex").alias("q"), F.col("vec").alias("qvec"), F.col("u").alias("own"))
    ask = materialize(ask, "queries")
    each = ask.groupBy("own").agg(F.min("q").alias("q"), F.min_by("qvec", "q").alias("qvec"))  # copies ask once
    found = graph_search(graph, vectors, each.select("q", "qvec"), k + 1)
    w = Window.partitionBy("u").orderBy("id_hex")
    head = rows.select("u", "id_hex").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select(F.col("u").alias("v"), F.col("id_hex").alias("other"))
    near = found.join(each.select("q", "own"), "q").filter("v <> own").select("own", "v", "s").unionByName(each.select("own", F.col("own").alias("v"), F.lit(1.0).alias("s")))
    entry = F.struct((-F.col("s")).alias("d"), "other")
    best = near.join(head, "v").groupBy("own").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("best"))
    own = skewed_lookup(ask.select("own", F.col("q").alias("id_hex")), materialize(best, "best"), ["own"], "inner")
    others = F.slice(F.filter("best", lambda e: e["other"] != F.col("id_hex")), 1, k)
    return own.select("id_hex", F.explode(others).alias("e")).select("id_hex", F.col("e.other").alias("other_hex"), (-F.col("e.d")).alias("cosine"))
