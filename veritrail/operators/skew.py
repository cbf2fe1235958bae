"""Lookups whose left side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; so there are fewer hot keys than this, whatever the data.
HOT_SHARE = 512


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than 1/share of the rows: fewer than `share` rows by arithmetic. Null keys are left out."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share > F.col("_total")).select(*keys)
    return hot.na.drop(subset=keys)


def skewed_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has at most one row per key; how is left or inner.

    The rows of hot keys meet a broadcast of the hot parents (fewer than HOT_SHARE rows) where they lie; the rest is
    co-partitioned, sorted and merged. Null keys match nothing.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    mark = hot.select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(mark), keys, "left")
    some = right.join(F.broadcast(hot), keys, "left_semi")
    a = marked.filter("_hot").drop("_hot").join(F.broadcast(some), keys, how)
    b = marked.filter("_hot is null").drop("_hot").join(right.hint("merge"), keys, how)
    return a.unionByName(b)


def frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the largest counts, about `most` of them at most, whatever the number of rows.

    Cut at a sixteenth of an octave, found from a histogram of at most 1,008 rows; so that no task sends more than its
    share of the result to the driver. Of the step that would exceed `most` a part is taken by a hash of the rows, as otherwise even counts would give nothing.
    """
    step = F.floor(F.log2(n) * 16)
    held, cut, share = 0, 0, 1.0
    for r in sorted(counts.filter(F.col(n) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        if held + r["rows"] > most:
            cut, share = r["step"], (most - held) / r["rows"]
            break
        held += r["rows"]
    plain = [c for c, t in counts.dtypes if not t.startswith("map")]
    part = F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) < int(share * (1 << 20))
    return counts.filter((F.col(n) > 0) & ((step > cut) | ((step == cut) & part)))
