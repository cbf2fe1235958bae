"""References to records that do not exist: missing, deleted or late parents, per table and day.

References and parent keys are both reduced to one row per key, co-partitioned on (kind, key), sorted, and merged
linearly: the sort-merge join. A parent row carries its validity interval (valid_from, valid_to); comparing the reference's
first day with it tells missing (no parent row at all), deleted (the interval has ended: only rows whose path is gone, or a deleted
record) and late (the interval begins on a later day).

Hot keys go the way of `skew.skewed_lookup`: fewer than 512 keys can hold more than 1/512 of the references each, so that
their parents fit a broadcast; all other keys go through the sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.skew import skewed_lookup
from veritrail.session import materialize


#: The end of an interval that ended on an unknown day.
EVER = "0000-00-00"


def _day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def references(owned_edges: DataFrame, pending_edges: DataFrame, owned_nodes: DataFrame) -> DataFrame:
    """(tbl, path, src, target, relation, period, key_kind), one row per reference.

    Blanks and tabs around a target are stripped; sink_id loses its letter case; null and empty sink_id are no
    references. A null path, src or relation stays null and counts as a value of its own. A null target of an edge is a
    reference to nothing: it stays and is missing. period is the earliest UTC day; null when no row has a time.
    """
    strip = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    e = owned_edges.select(F.lit("owned_edges").alias("tbl"), "path", "src", strip("dst").alias("target"), "relation", "committed_at")
    p = pending_edges.select(F.lit("pending_edges").alias("tbl"), "path", "src", strip("dst_symbol").alias("target"), "relation", "committed_at")
    n = owned_nodes.select(
        F.lit("owned_nodes").alias("tbl"), "path", F.col("node_id").alias("src"), F.lower(strip("sink_id")).alias("target"), F.lit("").alias("relation"), "committed_at"
    ).filter("target <> ''")
    return e.unionByName(p).unionByName(n).groupBy("tbl", "path", "src", "target", "relation").agg(_day(F.min("committed_at")).alias("period"))


def parents(owned_nodes: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tbl, key, valid_from, valid_to): one row per key that exists or existed, with the days from and to which it is valid; valid_to is null while it exists.

    A key exists while one of its rows does (a live one without a day never became available and counts as deleted): then valid_from is the earliest day of those. reconciled_at of paths and last_access of nodes are optional. Of a key that is gone, valid_from is its earliest day and valid_to the last
    day on which one of its paths was seen to be absent, or its record was used last; EVER where that is unknown. The current row of a path is the one of the highest generation; a path without a row counts as gone.
    """
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("bigint")
    paths = paths.select("path", "state", "generation", optional(paths, "reconciled_at").alias("reconciled_at"))
    current = paths.groupBy("path").agg(F.max_by(F.struct("state", "reconciled_at"), "generation").alias("_r")).select(F.col("path").alias("_p"), "_r.state", F.timestamp_millis("_r.reconciled_at").alias("seen"))
    # one row per (node, symbol, path) before the join, so that redelivered rows don't travel
    rows = owned_nodes.groupBy("path", "node_id", "symbol").agg(F.min("committed_at").alias("at"))
    here = F.coalesce(F.col("state") == "present", F.lit(False))
    rows = rows.join(current, rows.path == current._p, "left").withColumn("here", here)
    one = lambda tbl, c: F.struct(F.lit(tbl).alias("tbl"), F.col(c).alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("here"), F.col("seen"))
    keys = rows.select(F.inline(F.array(one("owned_edges", "node_id"), one("pending_edges", "symbol")))).filter("key is not null")
    sink = nodes.filter("id is not null").select(
        F.lit("owned_nodes").alias("tbl"), F.lower(F.hex("id")).alias("key"), F.timestamp_seconds("created_at").alias("at"), (F.col("state") == 0).alias("here"), F.timestamp_seconds(F.greatest(F.col("created_at"), optional(nodes, "last_access"))).alias("seen")
    )
    every = keys.unionByName(sink).groupBy("tbl", "key").agg(
        F.min(F.when(F.col("here"), F.col("at"))).alias("live"), F.coalesce(F.max("here"), F.lit(False)).alias("here"), F.min("at").alias("first"), F.max("seen").alias("last")
    )
    ended = F.when(~F.col("here"), F.coalesce(_day("last"), F.lit(EVER)))
    return every.select("tbl", "key", F.when(F.col("here"), _day("live")).otherwise(_day("first")).alias("valid_from"), ended.alias("valid_to"))


def orphans(owned_edges: DataFrame, pending_edges: DataFrame, owned_nodes: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tbl, period, path, src, target, relation, status), one row per orphan reference; status is missing, deleted or late.

    Empty tables give an empty result or, for empty parents, only missing ones. Extra columns are ignored. A reference
    without a period cannot be late: it is an orphan only when its parent is missing or deleted.
    """
    refs = materialize(references(owned_edges, pending_edges, owned_nodes), "refs")
    par = parents(owned_nodes, paths, nodes).select("tbl", F.col("key").alias("target"), "valid_from", "valid_to", F.lit(True).alias("known"))
    met = skewed_lookup(refs, par, ["tbl", "target"])
    status = F.when(F.col("known").isNull(), "missing").when(F.col("valid_to").isNotNull() | F.col("valid_from").isNull(), "deleted").when(F.col("valid_from") > F.col("period"), "late")
    return met.select("tbl", "period", "path", "src", "target", "relation", status.alias("status")).filter("status is not null")


def orphan_report(found: DataFrame) -> DataFrame:
    """(tbl, period, status, refs, targets): how many orphan references and different targets per table and day."""
    return found.groupBy("tbl", "period", "status").agg(F.count("*").alias("refs"), F.countDistinct("target").alias("targets"))
