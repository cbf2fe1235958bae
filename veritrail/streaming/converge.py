"""Convergence as a stream: hints come in micro-batches; each batch looks at its paths anew, extracts what changed and commits one snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.functions import paths as P
from veritrail.operators import converge, edges
from veritrail.operators.extract import extract
from veritrail.session import materialize
from veritrail.sources import logs
from veritrail.store import TABLES, Store

Disk = Callable[[DataFrame], DataFrame]


@dataclass
class Plan:
    """What a batch would do: one row for each dirty path, and the nodes, edges and dangling edges of those whose content changed."""

    looked: DataFrame
    nodes: DataFrame
    edges: DataFrame
    pending: DataFrame
    touched: list[int]


def plan(store: Store, hints: DataFrame, disk: Disk, roots: dict[str, str] | None = None, cap: str = "graph") -> Plan:
    """Look at the hinted paths. disk takes the dirty paths and gives (path, size, mtime_ms, content) of those that are there; a null content can't be read.

    A hint says look, not what: repeated, late and wrong ones are harmless. Each one raises the generation of its path. Only changed files are extracted,
    all of a batch together, and only as deep as the rules and the capability allow.
    """
    dirty = hints.filter(F.col("path").startswith("/")).groupBy("path").agg(F.count("*").alias("hints"))
    dirty = materialize(dirty.withColumn("bucket", store.bucket(F.col("path"))), "dirty")
    touched = [r[0] for r in dirty.select("bucket").distinct().collect()]  # at most a row for each bucket
    old = store.read("paths", touched).select("path", *(F.col(c).alias(f"p_{c}") for c in ("hash", "size", "mtime_ms", "depth", "state", "cap_max", "generation")))
    found = disk(dirty.select("path")).select("path", "size", "mtime_ms", "content", F.lit(True).alias("there"))
    can = P.has_extractor(F.col("path"))
    depth = P.depth_for(F.col("path"), roots or {}, "max", cap)["effective"]
    depth = F.when((P.rank_of(depth) >= P.rank_of(F.lit("symbol"))) & ~can, "file").otherwise(depth)
    now = dirty.join(old, "path", "left").join(found, "path", "left").withColumn("hash", F.sha2("content", 256)).withColumn("depth", F.when(F.col("there"), depth))
    now = now.withColumn("state", F.when(F.col("there"), "present").otherwise("absent")).withColumn("started", F.coalesce("p_generation", F.lit(0)))
    now = now.withColumn("error", F.when(F.col("there") & F.col("content").isNull(), "unreadable"))
    same = (F.col("p_state") == "present") & F.col("p_hash").eqNullSafe(F.col("hash")) & F.col("p_depth").eqNullSafe(F.col("depth"))
    now = materialize(now.withColumn("changed", F.col("there") & F.col("error").isNull() & ~F.coalesce(same, F.lit(False))), "looked")
    deep = P.rank_of(F.col("depth")) >= P.rank_of(F.lit("symbol"))
    rows = materialize(extract(now.filter("changed").select("path", F.when(deep, F.col("content")).alias("content"))), "extracted")
    pick = lambda kind, *c: rows.filter(F.col("kind").isin(*kind)).select("path", *c)
    sink = F.substring(F.sha2("node_id", 256), 1, 16)  # the same each time, so that a repeated projection changes nothing
    nodes = pick(("file", "symbol"), "node_id", "kind", "symbol", "label", "line").withColumn("sink_id", sink)
    return Plan(now.drop("content"), nodes, pick(("edge",), "src", "dst", "relation", "line"), pick(("pending",), "src", F.col("dst").alias("dst_symbol"), "relation", "line"), touched)


def commit(store: Store, what: Plan, batch: int | None = None, cap: str = "graph", sink_ok: bool = True) -> DataFrame:
    """Commit a plan; (path, action) of what was done. Ownership is exact: all rows of a committed path go, the new ones come.

    A path whose generation in the store is no longer the one the plan began with is stale: it is left alone and to be hinted again. Paths in error keep their rows, so
    do changed ones while the sink is down (deferred). An unchanged path keeps its nodes; its generation and capability are stamped anew.
    """
    batch = store.committed() + 1 if batch is None else batch
    rows = store.read("paths", what.touched)
    latest = rows.select("path", F.col("generation").alias("g"))
    disk = what.looked.join(latest, "path", "left").withColumn("generation", F.coalesce("g", F.lit(0))).drop("g").withColumn("cap_max", F.lit(cap))
    prior = what.looked.filter("p_state is not null").select("path", *(F.col(f"p_{c}").alias(c) for c in ("hash", "size", "mtime_ms", "depth", "state", "cap_max")))
    acts = materialize(converge.drained(prior, disk, sink_ok), "actions")
    done = acts.filter(F.col("action").isin("indexed", "updated", "retracted", "absent", "unchanged"))
    moved = done.filter("action <> 'unchanged'").select("path")
    fresh = what.looked.join(done.select("path"), "path", "left_semi").select(
        "path", "hash", "size", "mtime_ms", "depth", F.lit(cap).alias("cap_max"), (F.col("started") + F.col("hints")).alias("generation"), "state", F.unix_millis(F.current_timestamp()).alias("reconciled_at")
    )
    tables = {"paths": converge.replace_owned(rows, fresh, done)}
    for name in ("nodes", "edges", "pending"):
        new = getattr(what, name).join(moved, "path", "left_semi")
        tables[name] = converge.replace_owned(store.read(name, what.touched), new.select(*(c.split()[0] for c in TABLES[name].split(", "))), moved)
    tables["actions"] = converge.replace_owned(store.read("actions", what.touched), acts, acts)
    store.commit(tables, what.touched, batch)
    return acts


def converge_batch(store: Store, hints: DataFrame, disk: Disk, batch: int | None = None, roots: dict[str, str] | None = None, cap: str = "graph", sink_ok: bool = True) -> DataFrame:
    """Plan and commit. A batch that was committed before, as when a stream replays it, changes nothing and gives no action."""
    if batch is not None and batch <= store.committed():
        return store.spark.createDataFrame([], TABLES["actions"])
    return commit(store, plan(store, hints, disk, roots, cap), batch, cap, sink_ok)


def resolved(store: Store) -> DataFrame:
    """The edges that hold now: those within files, and the dangling ones whose symbol is indexed; a view, so that the order of arrival doesn't matter."""
    waiting = store.read("pending").withColumn("committed_at", F.lit(None).cast("timestamp"))
    found = edges.resolved(waiting, store.read("nodes")).select("path", "src", "dst", "relation", "line")
    return store.read("edges").unionByName(found)


def audit(store: Store, disk: DataFrame, at: int, roots: dict[str, str] | None = None, cap: str = "graph", deep: bool = False) -> DataFrame:
    """Hints for everything that drifted; run by a timer beside the stream, whose source folder they are appended to. disk is (path, size, mtime_ms, hash)."""
    there = disk.select("path", "hash", "size", "mtime_ms", F.lit(None).cast("string").alias("depth"), F.lit("present").alias("state"), F.lit(cap).alias("cap_max"))
    return converge.audit_hints(converge.drift(store.read("paths"), there, roots, cap, deep), at)


def rebuild(store: Store, files: DataFrame, roots: dict[str, str] | None = None, cap: str = "graph", home: str | None = None) -> DataFrame:
    """Every file anew: one batch over all that is there and all that the index holds, so that what is gone is retracted."""
    known = store.read("paths").select("path").unionByName(converge.bootstrap(files, files, home, force=True).select("path")).distinct()
    return converge_batch(store, known, lambda dirty: files.join(dirty, "path", "left_semi"), None, roots, cap)


def start(
    hints: DataFrame, store: Store, disk: Disk, checkpoint: str, once: bool = False, again: str | None = None, roots: dict[str, str] | None = None, cap: str = "graph",
    audit_every: float | None = None, full: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Start the stream. once takes what is there and ends; else a batch begins every 2 seconds, when there are hints.

    again is a folder that the stream reads: stale and deferred paths are appended to it as hints, and, every audit_every seconds, whatever `audit` finds
    by the file list that full gives (path, size, mtime_ms, hash).
    """
    last = [time.time()]

    def run(batch: DataFrame, number: int) -> None:
        acts = converge_batch(store, batch, disk, number, roots, cap)
        now = int(time.time() * 1000)
        if again:
            logs.append_hints(acts.filter(F.col("action").isin("stale", "deferred")).select("path", F.col("action").alias("reason"), F.lit(now).alias("at")), again)
        if again and full and audit_every is not None and time.time() - last[0] >= audit_every:
            logs.append_hints(audit(store, full(), now, roots, cap), again)
            last[0] = time.time()

    w = hints.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()
