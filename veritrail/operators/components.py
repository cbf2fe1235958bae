"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.session import materialize


#: Edges of one node that meet in a task; a node with more is met in parts.
STAR = 500_000


def _with_lowest(edges: DataFrame, low: DataFrame, several: bool) -> DataFrame:
    """edges (u, v) with the m of their u; low is (u, m, n), n the edges of u. With `several` a node of more than STAR edges is met in parts, of which there are fewer than edges / STAR in all."""
    if not several:
        return edges.join(low.drop("n"), "u")
    hot = low.filter(F.col("n") > STAR).select("u", F.floor(F.col("n") / STAR).alias("_top"))
    left = edges.join(F.broadcast(hot), "u", "left").withColumn("_part", F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("_top") + 1))).drop("_top")
    right = low.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / STAR)))).drop("n")
    return left.join(right, ["u", "_part"]).drop("_part")


def _star(edges: DataFrame, large: bool, several: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: large links the larger neighbours of each node to its smallest neighbour or itself, small the smaller ones and itself."""
    lowest = lambda e: e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).withColumn("m", F.least("u", "m"))
        out = _with_lowest(both.filter("v > u"), low, several).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = _with_lowest(edges, lowest(edges), several).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return out.filter("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links: component is the smallest node reachable.

    links may hold repeated rows, both directions and loops; a link with a null end is dropped, a node that only has
    loops gets no row. Each round is written to the shared folder, so that the plan stays short; the driver sees two
    numbers a round. Stops when a round changes nothing: O(log² n) rounds. A star of any size is spread over tasks.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialize(_star(_star(edges, True, before[0] > STAR), False, before[0] > STAR), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
