"""Near-duplicate records with small edits: minhash banding, sketch comparison, verification, components.

1. Each record becomes the sorted array of its words' 64-bit hashes; records with equal word sets are one set from here
   on, so that a group of copies of any size costs one entry (one a task until the buckets).
2. BANDS × ROWS universal hash minima of each set (numpy, in Arrow batches). A band's minima form one bucket key. Two
   sets of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS: 0.993 at s = 0.7, 0.9997 at 0.77.
3. Buckets are co-partitioned and sorted. Each member carries a 128-bit sketch (one bit of each of 128 more minima);
   two sets agree in (1 + s) / 2 of the bits, so fewer than 90 of 128 has a probability of 2e-6 at s = 0.7 and is dropped.
   First every member meets all the members of its bucket in the same block of BLOCK rows; of those that pass it keeps the LINKS most
   alike before it. The blocks of a longer bucket are tied by their first members, which all the rows of the bucket meet; a bucket of more than HOT rows
   is spread over tasks in parts, and counts as one in which pairs were left out.
4. These links are verified with the words of both sets, and connected by large-star and small-star.
5. The buckets in which step 3 left out a pair are finished exactly: their members meet block against block, each two blocks in
   a task of their own and with all words, except blocks that step 4 made one component. What is found joins the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.components import connected_components
from veritrail.operators.skew import skewed_lookup
from veritrail.session import materialize

BANDS, ROWS, SKETCH = 40, 6, 128
#: Bits of 128 that two sets must agree in to be verified.
AGREE = 90
#: Links that a member keeps to earlier members of its bucket at first, and rows that are compared with each other at a time.
LINKS, BLOCK = 8, 2048
#: Rows of a bucket that are met in one task at first.
HOT = 262_144


def words(title: Column, body: Column) -> Column:
    """The distinct maximal runs of letters and digits in lower(title, blank, body)."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_sets(nodes: DataFrame, least: int = 20) -> DataFrame:
    """(id_hex, set_id, words): one row per row of nodes with at least `least` different words.

    set_id is a hash of the whole set, equal for equal sets. Null title or body counts as empty; null ids are left out.
    """
    w = nodes.filter("id is not null").select(F.lower(F.hex("id")).alias("id_hex"), words(F.col("title"), F.col("body")).alias("w"))
    w = w.filter(F.size("w") >= least).select("id_hex", F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("words"))
    return w.select("id_hex", F.xxhash64("words").alias("set_id"), "words")


def _coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minima(values: np.ndarray, offsets: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n × sets: the minimum of each of n universal hashes (multiply-shift, 32 bits) over each set."""
    a, b = _coefficients(n, seed)
    out = np.empty((n, len(offsets) - 1), np.uint32)
    x = values.astype(np.uint64)
    for i in range(n):
        h = ((x * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
        out[i] = np.minimum.reduceat(h, offsets[:-1])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, words) to (set_id, low, high, bands): the sketch in two longs and a bucket key per band. A set is signed once a task."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column("set_id").to_numpy()
        keep = []
        for i, s in enumerate(ids.tolist()):
            if s not in seen:
                seen.add(s)
                keep.append(i)
        if not keep:
            continue
        lists = batch.column("words").take(pa.array(keep))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        m = minima(values, offsets - offsets[0], BANDS * ROWS + SKETCH)
        keys = np.empty((BANDS, len(keep)), np.uint64)
        for b in range(BANDS):
            k = np.full(len(keep), b + 1, np.uint64)
            for r in range(ROWS):
                k = _mix(k ^ m[b * ROWS + r].astype(np.uint64)) + np.uint64(r)
            keys[b] = k
        bits = (m[BANDS * ROWS :] & np.uint32(1)).astype(np.uint64)
        low, high = (np.bitwise_or.reduce(bits[j : j + 64] << np.arange(64, dtype=np.uint64)[:, None], axis=0) for j in (0, 64))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * BANDS + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(keys.T).ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), bands], ["set_id", "low", "high", "bands"])


def _agree(low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    differ = [np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int16) for x in (low, high)]
    return SKETCH - differ[0] - differ[1]


def _links(key: np.ndarray, sid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one block of rows sorted by key that share the key and pass the sketch; of each row the LINKS most alike before it, and the keys where that left out a pair."""
    at, before, agree = [], [], []
    rows = np.arange(len(key))
    for lag in range(1, len(key)):
        rows = rows[rows >= lag]
        rows = rows[key[rows] == key[rows - lag]]  # who has no mate at this lag has none at the next
        if not len(rows):
            break
        n = _agree(low, high, rows, rows - lag)
        ok = (n >= AGREE) & (sid[rows] != sid[rows - lag])
        at.append(rows[ok])
        before.append(rows[ok] - lag)
        agree.append(n[ok])
    if not at:
        return sid[:0], sid[:0], key[:0]
    i, j, n = np.concatenate(at), np.concatenate(before), np.concatenate(agree)
    order = np.lexsort((-n, i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    cut = np.unique(key[i[rank >= LINKS]])
    i, j = i[rank < LINKS], j[rank < LINKS]
    return sid[i], sid[j], cut


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, set_id, low, high) sorted by key to candidate links (null, a, b), a < b, and the members (key, a, null) of buckets in which a pair was left out.

    A set that several tasks signed counts once in a bucket, where its rows lie together. Holds one block of rows and the first rows of its last bucket. A bucket longer than a block counts as one in which a pair was left out.
    """
    pivots = rest = last_row = None
    done: set[tuple[int, int]] = set()

    def flush(x: np.ndarray, old: int, long: bool) -> pa.RecordBatch:
        """The first `old` rows were given out before; long if all rows are of a bucket longer than a block."""
        a, b, cut = _links(*x)
        a, b = np.minimum(a, b), np.maximum(a, b)
        new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in done]
        if len(done) > 2_000_000:
            done.clear()
        done.update(new)
        new = list(dict.fromkeys(new))
        key, sid = x[0, old:], x[1, old:]
        # the bucket of the pivots may go on in a batch that ends with others
        at = np.ones(len(key), bool) if long else np.isin(key, np.append(cut, x[0, :old][:1]))
        n, m = len(new), int(at.sum())
        keys = pa.array([None] * n + key[at].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([keys, pa.array([p[0] for p in new] + sid[at].tolist(), pa.int64()), pa.array([p[1] for p in new] + [None] * m, pa.int64())], ["key", "a", "b"])

    for batch in batches:
        x = np.stack([batch.column(c).to_numpy() for c in ("key", "set_id")])
        x = np.vstack([x, *(batch.column(c).to_numpy()[None] for c in ("low", "high"))])
        if not x.shape[1]:
            continue
        fresh = (np.diff(x[:2], axis=1, prepend=x[:2, :1] if last_row is None else last_row) != 0).any(axis=0)
        fresh[0] |= last_row is None
        last_row = x[:2, -1:]
        x = x[:, fresh]
        rest = x if rest is None else np.hstack([rest, x])
        while rest.shape[1] > BLOCK:
            last = rest[0, -1]
            start = int(np.searchsorted(rest[0], last))  # the last bucket may go on in the next batch
            if start:
                head, rest = rest[:, :start], rest[:, start:]
            else:  # one bucket longer than a block
                head, rest = rest[:, :BLOCK], rest[:, BLOCK:]
            old = 0
            if pivots is not None and pivots[0, 0] == head[0, 0]:
                old = pivots.shape[1]
                head = np.hstack([pivots, head])
            pivots = None if start else (pivots if pivots is not None and pivots[0, 0] == head[0, 0] else head[:, :64])
            # several small buckets go together, in pieces that end with a bucket
            yield flush(head, old, not start)
    if rest is not None and rest.shape[1]:
        old = 0
        if pivots is not None and pivots[0, 0] == rest[0, 0]:
            old = pivots.shape[1]
            rest = np.hstack([pivots, rest])
        yield flush(rest, old, False)


def _both_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """n × m: the words in common of each row of x with each of y, given as words and their rows. Frequent words are counted by products of matrices, the others pair by pair."""
    known = np.intersect1d(x[0], y[0])
    out = np.zeros((n, m), np.float32)
    if not len(known):
        return out
    sides = []
    for values, rows in (x, y):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        ok = known[at] == values
        order = np.argsort(at[ok], kind="stable")
        sides.append((at[ok][order], rows[ok][order]))
    (wx, rx), (wy, ry) = sides
    times = np.bincount(wx, minlength=len(known)) * np.bincount(wy, minlength=len(known))
    often = np.flatnonzero(times > 16384)
    for c in range(0, len(often), 512):
        part = often[c : c + 512]
        dense = []
        for (w, r), rows in ((sides[0], n), (sides[1], m)):
            at = np.minimum(np.searchsorted(part, w), len(part) - 1)
            ok = part[at] == w
            d = np.zeros((rows, len(part)), np.float32)
            d[r[ok], at[ok]] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    rare = times[wx] <= 16384
    wx, rx = wx[rare], rx[rare]
    lo = np.searchsorted(wy, wx)
    size = np.searchsorted(wy, wx, "right") - lo
    ends = np.cumsum(size)
    begin = 0
    while begin < len(wx):  # a few million pairs at a time
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 4_000_000, "right")))
        s = size[begin:end]
        at = np.repeat(lo[begin:end] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        out += np.bincount(np.repeat(rx[begin:end], s) * m + ry[at], minlength=n * m).reshape(n, m)
        begin = end
    return out


def _tile_links(threshold: float):
    """Rows (key, i, j, side, set_id, comp, words) sorted by tile (key, i, j) and side to links (a, b) of the alike sets of a tile's two blocks, one for each two components."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        side, sid, comp = (rows.column(c).to_numpy() for c in ("side", "set_id", "comp"))
        n = int((side == 0).sum())
        lists = rows.column("words").chunk(0)
        if n < len(side):
            a, b = lists.slice(0, n), lists.slice(n)
            ca, cb, sa, sb = comp[:n], comp[n:], sid[:n], sid[n:]
        else:  # a block against itself
            a = b = lists
            ca = cb = comp
            sa = sb = sid
        c = _common(_both_lists(a), _both_lists(b), len(sa), len(sb)).astype(np.float64)
        size = a.value_lengths().to_numpy(zero_copy_only=False)[:, None] + b.value_lengths().to_numpy(zero_copy_only=False)[None]
        i, j = np.nonzero((c >= (size - c) * threshold - 1e-9) & (ca[:, None] != cb[None]))
        low, high = np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])
        _, first = np.unique(np.stack([low, high]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        i, j = i[first], j[first]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(sa[i], sb[j])), pa.array(np.maximum(sa[i], sb[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = (np.flatnonzero((np.diff(at, axis=1) != 0).any(axis=0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and tuple(at[:, lo]) != tile:
                    yield links(pa.Table.from_batches(held))
                    held = []
                tile = tuple(at[:, lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


_SIGNED = "set_id long, low long, high long, bands array<long>"


def _hot_buckets(sets: DataFrame, count: int) -> DataFrame | None:
    """(key, parts): the bucket keys with about HOT rows or more and in how many parts they are met, found by the signatures of a sample of sets; fewer than
    BANDS x count / HOT x 2. None where no bucket can be that long. The sample, 64 of HOT rows, only decides how the work is spread.
    """
    if count < HOT:
        return None
    share = 64 / HOT
    some = sets.sample(share, 17).select("set_id", "words").mapInArrow(signatures, _SIGNED).dropDuplicates(["set_id"])
    n = F.col("count") / F.lit(share)
    return some.select(F.explode("bands").alias("key")).groupBy("key").count().filter(n >= HOT / 2).select("key", F.ceil(n / HOT * 2).cast("int").alias("parts"))


def _signed_rows(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, set_id, low, high), co-partitioned and sorted by key; and the members (key, set_id) of the buckets that were met in parts, under a key for each part."""
    signed = sets.select("set_id", "words").mapInArrow(signatures, _SIGNED)
    rows = signed.select(F.explode("bands").alias("key"), "set_id", "low", "high")
    hot, members = _hot_buckets(sets, sets.count()), None
    if hot is not None:
        hot = materialize(hot, "hot")
        marked = rows.join(F.broadcast(hot), "key", "left")
        part = F.xxhash64("key", F.pmod(F.xxhash64("set_id"), F.col("parts")))
        rows = marked.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(part).alias("key"), "set_id", "low", "high")
        members = marked.filter("parts is not null").select("key", "set_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "low", "high", "set_id"), members


def first_links(sets: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(a, b) set ids of verified links: the words in common are at least `threshold` of the words in either; and the members (key, set_id) of the buckets in which pairs were left out."""
    rows, parted = _signed_rows(sets)
    met = materialize(rows.mapInArrow(bucket_links, "key long, a long, b long"), "pairs")
    pairs = met.filter("key is null").select("a", "b").distinct()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    known = sets.select("set_id", "words").join(ids, "set_id", "left_semi").groupBy("set_id").agg(F.first("words").alias("words"))
    x, y = known.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), known.select(F.col("set_id").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    links = both.select("a", "b", common.alias("c"), (F.size("wa") + F.size("wb") - common).alias("u")).filter(F.col("c") >= F.col("u") * threshold - 1e-9).select("a", "b")
    open_ = met.filter("key is not null").select("key", F.col("a").alias("set_id"))
    return links, (open_ if parted is None else open_.unionByName(parted)).distinct()


def left_out_links(sets: DataFrame, open_: DataFrame, part: DataFrame, threshold: float = 0.7) -> DataFrame | None:
    """(a, b): for the buckets open_ (key, set_id), a link for each two components (node, component) that hold alike sets of one bucket; None where every bucket is in one component.

    The work grows with the square of a bucket, without the blocks that are of one component; a task has two blocks.
    """
    rows = open_.join(part.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rows = materialize(rows.join(mixed, "key", "left_semi"), "mixed")
    if rows.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("key").orderBy("comp", "set_id")) - 1
    rows = materialize(rows.withColumn("i", F.floor(number / BLOCK).cast("long")), "blocks")
    blocks = rows.groupBy("key", "i").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    others = blocks.select("key", F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tiles = blocks.join(others, "key").filter("i <= j and not (lo = hi and lo2 = hi2 and lo = lo2)").select("key", "i", "j")
    tiles = materialize(tiles, "tiles")
    sides = tiles.select("key", F.col("i").alias("at"), "i", "j", F.lit(0).alias("side")).unionByName(tiles.filter("i < j").select("key", F.col("j").alias("at"), "i", "j", F.lit(1).alias("side")))
    known = sets.select("set_id", "words").join(rows.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("words").alias("words"))
    full = rows.withColumnRenamed("i", "at").join(known, "set_id").join(sides, ["key", "at"]).select("key", "i", "j", "side", "set_id", "comp", "words")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return full.mapInArrow(_tile_links(threshold), "a long, b long")


def alike_components(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(node, component) of the sets that are alike, directly or through others: component is the smallest set id."""
    links, open_ = first_links(sets, threshold)
    part = connected_components(links)
    more = left_out_links(sets, open_, part, threshold)
    if more is None:
        return part
    return connected_components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(nodes: DataFrame, threshold: float = 0.7, least: int = 20) -> DataFrame:
    """(id_hex, group_hex, members): one row per record in a group of two or more; group_hex is the group's smallest id.

    Records with fewer than `least` words take no part. Repeated rows of an id count once (of several texts of one id
    the one with the smallest hash counts). Groups are closed: what is alike through others belongs together.
    """
    sets = materialize(word_sets(nodes, least), "sets")
    part = alike_components(sets, threshold)
    rows = sets.groupBy("id_hex").agg(F.min("set_id").alias("set_id"))
    part = part.select(F.col("node").alias("set_id"), "component")
    rows = skewed_lookup(rows, part, ["set_id"]).select("id_hex", F.coalesce("component", "set_id").alias("component"))
    rows = materialize(rows, "members")
    groups = rows.groupBy("component").agg(F.min("id_hex").alias("group_hex"), F.count("*").alias("members")).filter("members > 1")
    return skewed_lookup(rows, groups, ["component"], "inner").select("id_hex", "group_hex", "members")
