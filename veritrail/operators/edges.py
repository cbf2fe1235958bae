"""Edges between nodes: resolution of dangling edges by symbol, as views over the whole snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.skew import skewed_lookup
from veritrail.session import materialize


def symbols(nodes: DataFrame) -> DataFrame:
    """(symbol, dst): the node a symbol stands for, of several the smallest by path and id, so that the order of arrival doesn't matter."""
    return nodes.filter("symbol is not null").groupBy("symbol").agg(F.min_by("node_id", F.struct("path", "node_id")).alias("dst"))


def waiting(pending: DataFrame) -> DataFrame:
    """(path, src, symbol, relation, line): one row per dangling edge, the last delivery, blanks around the symbol stripped."""
    p = pending.withColumn("symbol", F.regexp_replace("dst_symbol", r"^[ \t]+|[ \t]+$", ""))
    w = Window.partitionBy("path", "src", "symbol", "relation").orderBy(F.desc_nulls_last("committed_at"), F.desc_nulls_last("line"))
    return p.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("path", "src", "symbol", "relation", "line")


def resolved(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, src, dst, relation, line): the dangling edges whose symbol is indexed. A hot symbol is looked up by broadcast."""
    return skewed_lookup(materialize(waiting(pending), "waiting"), symbols(nodes), ["symbol"], "inner").select("path", "src", "dst", "relation", "line")


def unresolved(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    return skewed_lookup(materialize(waiting(pending), "waiting"), symbols(nodes), ["symbol"]).filter("dst is null").select("path", "src", "symbol", "relation", "line")


def pending_union(pending: DataFrame, dirty_paths: DataFrame, fresh_symbols: DataFrame) -> DataFrame:
    """The dangling edges to try after a commit: those of the dirty paths and those that wait for a fresh symbol, each once."""
    w = waiting(pending)
    return w.join(dirty_paths, "path", "left_semi").unionByName(w.join(fresh_symbols, "symbol", "left_semi").select(w.columns)).distinct()


def local_split(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with `place`: local if the target is a node of the same path, else remote."""
    own = nodes.select("path", F.col("node_id").alias("dst"), F.lit("local").alias("place")).distinct()
    return edges.join(own, ["path", "dst"], "left").na.fill({"place": "remote"})


def beam_walk(edges: DataFrame, starts: DataFrame, depth: int = 2, beam: int = 6) -> DataFrame:
    """(start, hop, node, weight): from each start, hop by hop, the `beam` best nodes not seen before on this walk.

    A node's weight in a hop is the number of different edges that lead to it from the last beam; ties go to the smaller id. edges are (src, dst, relation).
    """
    e = materialize(edges.select("src", "dst", "relation").distinct(), "edges")  # so that a hot node lies right under the join, where it can be split
    front = starts.select("start", F.col("start").alias("node"))
    seen, out = front, None
    for hop in range(1, depth + 1):
        step = front.join(e, front.node == e.src).groupBy("start", F.col("dst").alias("node")).agg(F.count("*").alias("weight"))
        step = step.join(seen, ["start", "node"], "left_anti")
        w = Window.partitionBy("start").orderBy(F.desc("weight"), "node")
        step = step.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= beam).select("start", F.lit(hop).cast("bigint").alias("hop"), "node", "weight")
        out = step if out is None else out.unionByName(step)
        front = step.select("start", "node")
        seen = seen.unionByName(front)
    return out
