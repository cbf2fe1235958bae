"""Snapshots of the index tables in buckets of paths: a batch writes the buckets it touches anew, and one row makes it visible.

<root>/<table>/bucket=<b>/batch=<n>/ holds parquet, <root>/commits the numbers of the finished batches. A reader takes of each bucket the
last batch that is finished, so that it sees whole batches only; what a broken attempt left under its number is removed before the batch is written again.
Batches come from one streaming query, whose checkpoint hands out the numbers; everything is read and written by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.session import exists, remove

TABLES = {
    "paths": "path string, hash string, size long, mtime_ms long, depth string, cap_max string, generation long, state string, reconciled_at long",
    "nodes": "path string, node_id string, kind string, symbol string, label string, line long, sink_id string",
    "edges": "path string, src string, dst string, relation string, line long",
    "pending": "path string, src string, dst_symbol string, relation string, line long",
    "actions": "path string, action string",
}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def committed(self) -> int:
        """The number of the last finished batch, -1 before the first."""
        at = f"{self.root}/commits"
        return self.spark.read.schema("batch long").parquet(at).agg(F.max("batch")).first()[0] if exists(self.spark, at) else -1

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The current rows of a table, of all or some buckets."""
        schema, at = TABLES[table], f"{self.root}/{table}"
        empty = self.spark.createDataFrame([], schema)
        if not exists(self.spark, at):
            return empty
        every = self.spark.read.schema(f"{schema}, bucket int, batch long").parquet(at)
        last = every.filter(F.col("batch") <= self.committed())
        if buckets is not None:
            last = last.filter(F.col("bucket").isin(*buckets))
        here = last.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most a row for each bucket
        if not here:
            return empty
        folders = [f"{at}/bucket={r.bucket}/batch={r.batch}" for r in here]
        return self.spark.read.schema(schema).parquet(*folders).filter("path is not null")

    def commit(self, tables: dict[str, DataFrame], touched: list[int], batch: int) -> None:
        """Write the touched buckets of the tables, whole, and make them visible together. An empty bucket keeps a row without a path."""
        for name, df in tables.items():
            remove(self.spark, f"{self.root}/{name}/bucket=*/batch={batch}")
            mark = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
            rows = df.withColumn("bucket", self.bucket(F.col("path"))).unionByName(mark, allowMissingColumns=True).withColumn("batch", F.lit(batch).cast("bigint"))
            rows = rows.repartition("bucket").select(*(c.split()[0] for c in TABLES[name].split(", ")), "bucket", "batch")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/{name}")
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
