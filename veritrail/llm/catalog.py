"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, canonical, garbled, knn, neardup, packing
from veritrail.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest_pairs(table(spark, sf_dir, "node_vec"))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy graph search: the queries are the vectors whose id is divisible by 20."""
    return knn.search(table(spark, sf_dir, "node_vec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "nodes"))
    return found.filter("id_hex <> group_hex").selectExpr("group_hex as rep_hex", "id_hex")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(canonical.ledger_of(table(spark, sf_dir, "nodes")))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record after collapsing: the smallest and the earliest id, the number of copies, and when it was first seen."""
    return canonical.ledger_of(table(spark, sf_dir, "nodes")).counts().select("rep_hex", "earliest_hex", "copies", "first_seen")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids: the round trip."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


def _packed(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, int]:
    capacity = table(spark, sf_dir, "containers").filter(F.col("container_kind") == kind).agg(F.max("capacity_tokens")).first()[0]
    return packing.pack(bpe.token_counts(table(spark, sf_dir, "documents")), capacity), capacity


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "standard")[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(*_packed(spark, sf_dir, "standard"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.found(table(spark, sf_dir, "documents")).select("doc_id")


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repaired(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p2_found": p2_found, "p4_found": p4_found, "p4_counts": p4_counts, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_repaired": p8_repaired}
#: The round trip gives back the texts.
SQL: dict[str, str] = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
