"""Duplicates hidden by formatting: canonical keys, and the incremental ledger of how many copies each had."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators.skew import HOT_SHARE, skewed_lookup
from veritrail.session import exists, materialize, remove, work_dir

_WORD = r"[\p{L}\p{N}_.\-]+"
#: A field: an optional list dash, a name of up to three words, and the first colon or equals sign.
_FIELD = rf"(?sU)^(?:[-*•–]\s*)?({_WORD}(?:\s+{_WORD}){{0,2}})\s*[:=](.*)$"
_MAYBE = rf"(?U)^\s*(?:\{{|(?:[-*•–]\s*)?{_WORD}(?:\s+{_WORD}){{0,2}}\s*[:=])"


def bare(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _sorted_fields(pairs: Column) -> Column:
    return F.concat(F.lit("F\u0001"), F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(bare(p["name"]), F.lit("="), bare(p["value"])))), "\u0001"))


def _listed(body: Column, separator: str) -> Column:
    """The canonical form of a body that is a list of three or more fields with this separator, else null."""
    parts = F.filter(F.transform(F.split(body, separator), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, _FIELD, 1).alias("name"), F.regexp_extract(x, _FIELD, 2).alias("value")))
    return F.when((F.size(parts) >= 3) & F.forall(parts, lambda x: x.rlike(_FIELD)), _sorted_fields(pairs))


def _object(body: Column) -> Column:
    """The canonical form of a body that is a flat JSON object, else null."""
    read = F.from_json(body, "map<string,string>", {"allowSingleQuotes": "false"})
    pairs = F.transform(F.map_entries(read), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("null")).alias("value")))
    flat = F.forall(F.map_values(read), lambda v: ~F.coalesce(v.rlike(r"^[{\[]"), F.lit(False)))
    return F.when(body.rlike(r"(?s)^\s*\{.*\}\s*$") & read.isNotNull() & (F.size(read) > 0) & flat, _sorted_fields(pairs))


def canonical_body(body: Column) -> Column:
    """Fields sorted by name and value where the body consists of fields, else its letters and digits."""
    fields = F.when(body.rlike(_MAYBE), F.coalesce(_object(body), _listed(body, r"\r\n|\n|\r"), _listed(body, ";"), _listed(body, r"\|")))
    return F.coalesce(fields, F.concat(F.lit("T\u0001"), bare(body)))


def canonical_keys(nodes: DataFrame) -> DataFrame:
    """(id_hex, key, created_at), one row per row of nodes: equal keys are copies.

    A null title or body counts as an empty one; rows without an id are left out, extra columns ignored.
    """
    body = F.coalesce("body", F.lit(""))
    key = F.unhex(F.md5(F.concat(bare(F.coalesce("title", F.lit(""))), F.lit("\u0000"), canonical_body(body)).cast("binary")))
    return nodes.filter("id is not null").select(F.lower(F.hex("id")).alias("id_hex"), key.alias("key"), "created_at")


class Ledger:
    """Counts of copies by canonical key, kept by bucket in a shared folder; a ledger opened there again goes on where the last one ended.

    <root>/counts/bucket=<b>/batch=<n>/ holds (key, copies, rep_hex, earliest_hex, first_seen), <root>/members/... (key, id_hex, first_seen), <root>/commits
    (batch, buckets) the finished batches. A batch touches only its own buckets: their counts are full-outer-joined with the batch's and written anew, the other
    buckets stay where they are; members are only added. What counts of a bucket is its last finished batch; what a broken attempt left is removed
    by the next one. The number of buckets follows the first batch, one for each SHARE rows, and stays; one writer at a time.
    """

    COUNTS = "key binary, copies long, rep_hex string, earliest_hex string, first_seen long"
    MEMBERS = "key binary, id_hex string, first_seen long"
    SHARE, FEWEST, MOST = 500_000, 16, 4096

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{work_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}"
        self.batch, self.buckets = -1, 0
        if exists(spark, f"{self.root}/commits"):
            last = self._rows("commits", "batch long, buckets int").agg(F.max("batch").alias("batch"), F.max("buckets").alias("buckets")).first()
            self.batch, self.buckets = last.batch, last.buckets

    def _rows(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if exists(self.spark, f"{self.root}/{table}") else self.spark.createDataFrame([], schema)

    def _finished(self, table: str, schema: str) -> DataFrame:
        return self._rows(table, f"{schema}, bucket int, batch long").filter(F.col("batch") <= self.batch)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, copies, rep_hex, earliest_hex, first_seen): rep_hex is the smallest id, earliest_hex that of the earliest copy."""
        every = self._finished("counts", self.COUNTS)
        if buckets is not None:
            every = every.filter(F.col("bucket").isin(buckets))
        last = every.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most a row for each bucket
        if not last:
            return self.spark.createDataFrame([], self.COUNTS)
        return self.spark.read.schema(self.COUNTS).parquet(*(f"{self.root}/counts/bucket={r.bucket}/batch={r.batch}" for r in last))

    def members(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, id_hex, first_seen), one row for each id that was counted."""
        every = self._finished("members", self.MEMBERS)
        return (every if buckets is None else every.filter(F.col("bucket").isin(buckets))).drop("bucket", "batch")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        rows = df.withColumn("bucket", self.bucket()).withColumn("batch", F.lit(batch).cast("bigint"))
        remove(self.spark, f"{self.root}/{table}/bucket=*/batch={batch}")
        # a bucket with a hot key is written by several tasks
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/{table}")

    def add(self, batch: DataFrame) -> None:
        """Take in one batch of canonical keys. Ids that were counted before, in this batch or an earlier one, count once."""
        number = self.batch + 1
        if not self.buckets:
            self.buckets = min(self.MOST, max(self.FEWEST, batch.count() // self.SHARE))
        fresh = batch.groupBy("key", "id_hex").agg(F.min("created_at").alias("first_seen"))
        if number:
            touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]
            fresh = fresh.join(self.members(touched), ["key", "id_hex"], "left_anti")
        self._write(fresh, "members", number)
        new = self._rows("members", f"{self.MEMBERS}, bucket int, batch long").filter(F.col("batch") == number)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # without buckets that got nothing new
        if touched:
            first = F.struct(F.coalesce("first_seen", F.lit(-(2**62))).alias("at"), "id_hex")
            new = new.groupBy("key").agg(F.count("*").alias("n"), F.min("id_hex").alias("r"), F.min(first).alias("e"), F.min("first_seen").alias("f"))
            if number:
                old = self.counts(touched)
                earlier = F.least(F.when(F.col("earliest_hex").isNotNull(), F.struct(F.coalesce("first_seen", F.lit(-(2**62))).alias("at"), F.col("earliest_hex").alias("id_hex"))), F.col("e"))
                new = old.join(new, "key", "full_outer").select(
                    "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("rep_hex", "r").alias("rep_hex"), earlier["id_hex"].alias("earliest_hex"), F.least("first_seen", "f").alias("first_seen")
                )
            else:
                new = new.select("key", F.col("n").alias("copies"), F.col("r").alias("rep_hex"), F.col("e.id_hex").alias("earliest_hex"), F.col("f").alias("first_seen"))
            self._write(new, "counts", number)
        self.spark.createDataFrame([(number, self.buckets)], "batch long, buckets int").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        self.batch = number


def ledger_of(nodes: DataFrame, batches: int = 3, root: str | None = None) -> Ledger:
    """The ledger of a whole table, taken in by as many batches in order of created_at (rows without one come first)."""
    keys = materialize(canonical_keys(nodes), "keys")
    at = F.coalesce("created_at", F.lit(-(2**62)))
    cuts = keys.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    book = Ledger(nodes.sparkSession, root)
    bounds = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = keys
        if low is not None:
            part = part.filter(at > low)
        if high is not None:
            part = part.filter(at <= high)
        book.add(part)
    return book


def copies(book: Ledger) -> DataFrame:
    """(rep_hex, id_hex): each member of a group of copies but the smallest id, with the smallest id."""
    several = book.counts().filter("copies > 1").select("key", "rep_hex", "copies")
    total = several.agg(F.sum("copies").alias("_t"))
    hot = several.crossJoin(F.broadcast(total)).filter(F.col("copies") * HOT_SHARE > F.col("_t")).select("key")
    found = skewed_lookup(book.members().select("key", "id_hex"), several.drop("copies"), ["key"], "inner", hot)
    return found.filter("id_hex <> rep_hex").select("rep_hex", "id_hex")
