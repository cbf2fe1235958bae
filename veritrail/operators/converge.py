"""Convergence of the index towards what is on disk: dirty sets, classification, ownership, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import paths as P


def collapse_hints(hints: DataFrame) -> DataFrame:
    """(path, enqueued_at, reason, generation): one row per hinted path with the last time, the first reason and the number of hints.

    hints are rows (path, reason, at, seq); equal times are put in order by seq. Relative and null paths are dropped.
    """
    ok = hints.filter(F.col("path").startswith("/"))
    return ok.groupBy("path").agg(F.max("at").alias("enqueued_at"), F.min_by("reason", F.struct("at", "seq")).alias("reason"), F.count("*").alias("generation"))


def queue_batch(queue: DataFrame, limit: int = 256) -> DataFrame:
    """The paths that have waited longest."""
    return queue.orderBy("enqueued_at", "path").limit(limit)


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("queued"))


def bootstrap(disk: DataFrame, index: DataFrame, home: str | None = None, force: bool = False) -> DataFrame:
    """Hints (path, reason) for a first scan: every path of disk that isn't skipped, if the index (path) is empty or the scan is forced; else none."""
    want = disk.filter(~P.skipped(F.col("path"), home)).select("path", F.lit("scan").alias("reason"))
    return want if force else want.join(F.broadcast(index.select(F.lit(1).alias("_i")).limit(1)), F.lit(True), "left_anti")


def held(dirty: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, pending: DataFrame) -> DataFrame:
    """(path, state, generation, nodes, edges, pending): what the index holds of each dirty path; distinct nodes, edges and dangling edges."""
    one = lambda df, keys, name: df.join(dirty, "path", "left_semi").select("path", *keys).distinct().groupBy("path").agg(F.count("*").alias(name))
    out = dirty.join(paths.groupBy("path").agg(F.max_by("state", "generation").alias("state"), F.max("generation").alias("generation")), "path", "left")
    parts = ((nodes, ["node_id"], "nodes"), (edges, ["src", "dst", "relation"], "edges"), (pending, ["src", "dst_symbol", "relation"], "pending"))
    for part in parts:
        out = out.join(one(*part), "path", "left")
    return out.na.fill(0, [p[2] for p in parts])


def ranked_generations(paths: DataFrame) -> DataFrame:
    """paths with `age`: 1 for the row of the highest generation of a path, 2 for the one before, and so on."""
    return paths.withColumn("age", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("generation"))))


def current(paths: DataFrame) -> DataFrame:
    return ranked_generations(paths).filter("age = 1").drop("age")


def before_last(paths: DataFrame) -> DataFrame:
    """The row that the index held before the last one came."""
    return ranked_generations(paths).filter("age = 2").drop("age")


def _both(prior: DataFrame, disk: DataFrame, how: str) -> DataFrame:
    p = prior.select("path", *(F.col(c).alias(f"p_{c}") for c in ("hash", "size", "mtime_ms", "depth", "state", "cap_max")))
    d = disk.select("path", *(F.col(c).alias(f"d_{c}") for c in ("hash", "size", "mtime_ms", "depth", "state", "cap_max")))
    return p.join(d, "path", how)


def actions(prior: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action) for every path of disk: retracted, absent, unchanged, indexed or updated.

    unchanged needs a present prior row with the same hash and depth; indexed is a path without a prior hash.
    """
    both = _both(prior, disk, "right")
    here = F.col("d_state") == "present"
    same = (F.col("p_state") == "present") & F.col("p_hash").eqNullSafe(F.col("d_hash")) & F.col("p_depth").eqNullSafe(F.col("d_depth"))
    action = (
        F.when(~here & (F.col("p_state") == "present"), "retracted").when(~here, "absent").when(same, "unchanged").when(F.col("p_hash").isNull(), "indexed").otherwise("updated")
    )
    return both.select("path", action.alias("action"))


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("action").agg(F.count("*").alias("n"))


def split_by_generation(commits: DataFrame, paths: DataFrame) -> DataFrame:
    """commits (path, generation at their start, ...) with `outcome`: committed if the generation still stands, else stale: to be queued again."""
    now = paths.groupBy("path").agg(F.max("generation").alias("now"))
    out = F.when(F.col("generation").eqNullSafe(F.col("now")), "committed").otherwise("stale")
    return commits.join(now, "path", "left").withColumn("outcome", out).drop("now")


_ORDER = ("committed_at", "path", "kind", "symbol", "line", "label", "sink_id")


def owned(owned_nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes the index owns now: of each node_id the last delivery, only of paths that are present."""
    w = Window.partitionBy("node_id").orderBy(*(F.desc_nulls_last(c) for c in _ORDER))
    last = owned_nodes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.join(current(paths).filter("state = 'present'").select("path"), "path", "left_semi")


def first_owned(owned_nodes: DataFrame) -> DataFrame:
    """Of each node_id the first delivery."""
    w = Window.partitionBy("node_id").orderBy(*(F.asc_nulls_first(c) for c in _ORDER))
    return owned_nodes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def desired_diff(prior: DataFrame, desired: DataFrame) -> DataFrame:
    """(node_id, change): insert, delete, reproject (line or label differs) or keep."""
    p = prior.select("node_id", F.col("line").alias("pl"), F.col("label").alias("pb"), F.lit(1).alias("p"))
    d = desired.select("node_id", F.col("line").alias("dl"), F.col("label").alias("db"), F.lit(1).alias("d"))
    same = F.col("pl").eqNullSafe(F.col("dl")) & F.col("pb").eqNullSafe(F.col("db"))
    change = F.when(F.col("p").isNull(), "insert").when(F.col("d").isNull(), "delete").when(same, "keep").otherwise("reproject")
    return p.join(d, "node_id", "full").select("node_id", change.alias("change"))


def replace_owned(existing: DataFrame, fresh: DataFrame, dirty: DataFrame, key: str = "path") -> DataFrame:
    """Ownership-exact replacement: all rows of the dirty paths go, the fresh rows come."""
    return existing.join(dirty.select(key).distinct(), key, "left_anti").unionByName(fresh)


def drift(journal: DataFrame, disk: DataFrame, roots: dict[str, str] | None = None, cap: str | None = "graph", deep: bool = False, untracked: bool = False) -> DataFrame:
    """(path, why): how the index differs from disk; one path can give two rows.

    missing and reappeared; for paths present on both sides mtime/size (shallow) or hash (deep; a file that can't be read, whose hash is null, is passed over);
    and a depth that the machine's capability `cap` would raise by the rules `roots`, unless the row has seen this capability. A row without one is
    flagged; a null depth counts as the lowest. Only paths of the journal are looked at, unless untracked ones are asked for.
    """
    both = _both(journal, disk, "full" if untracked else "left")
    j, d = F.col("p_state") == "present", F.coalesce(F.col("d_state") == "present", F.lit(False))
    if deep:
        differ = F.col("d_hash").isNotNull() & ~F.col("p_hash").eqNullSafe(F.col("d_hash"))
    else:
        differ = ~(F.col("p_mtime_ms").eqNullSafe(F.col("d_mtime_ms")) & F.col("p_size").eqNullSafe(F.col("d_size")))
    both = both.withColumn("to", P.depth_for(F.col("path"), roots or {}, "max", cap or "file")["effective"])
    seen = F.col("p_cap_max").eqNullSafe(F.lit(cap)) & F.col("p_cap_max").isNotNull()
    raised = (P.rank_of(F.col("to")) > P.rank_of(F.coalesce("p_depth", F.lit("path")))) & ~seen
    whys = [
        F.when(F.col("p_state").isNull() & d, "untracked"),
        F.when(j & ~d, "missing"),
        F.when((F.col("p_state") == "absent") & d, "reappeared"),
        F.when(j & d & differ, "hash" if deep else "mtime/size"),
        F.when(j & d & raised, P.drift_label(F.coalesce("p_depth", F.lit("null")), F.col("to"))),
    ]
    return both.select("path", F.explode(F.array_compact(F.array(*whys))).alias("why"))


def audit_hints(found: DataFrame, at: int) -> DataFrame:
    """Drift (path, why) as hints (path, reason, at, seq): `audit:<why>`; a changed depth comes after what else a path has."""
    return found.select("path", F.concat(F.lit("audit:"), "why").alias("reason"), F.lit(at).cast("bigint").alias("at"), F.startswith("why", F.lit("depth")).cast("bigint").alias("seq"))


def drained(prior: DataFrame, disk: DataFrame, sink_ok: bool = True) -> DataFrame:
    """(path, action) of a drained batch: what `actions` tells, and error, deferred or stale where the path couldn't be converged.

    disk has, beside the columns of `actions`, `error` (not null where the content could not be read or parsed), `started` and `generation` (of the path when its
    reading began and now). A path that can't be read is an error and its old row stays; a changed one is deferred while the sink is down; one that was hinted again meanwhile is stale and goes
    back to the queue. Absent paths need no reading and no sink but can be stale.
    """
    known = actions(prior, disk)
    late = ~F.col("started").eqNullSafe(F.col("generation"))
    kind = F.when((F.col("state") == "present") & F.col("error").isNotNull(), "error").when(F.lit(not sink_ok) & F.col("action").isin("indexed", "updated"), "deferred").when(late & (F.col("action") != "unchanged"), "stale").otherwise(F.col("action"))
    return known.join(disk.select("path", "state", "error", "started", "generation"), "path").select("path", kind.alias("action"))
