"""Line formats: hint logs, inventories, telemetry logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.paths import skipped

HINT = "path string, reason string, at long, _bad string"
TELEMETRY = (
    "epoch long", "iso string", "daemon int", "nodes long", "edges long", "keywords long", "insert_p50 double", "query_p50 double", "sync_age_h long", "gates int",
    "calls_24h long", "hit_rate double", "errors_24h long", "est_saved_h double",
)


def _good(df: DataFrame, home: str | None) -> DataFrame:
    """Torn lines, relative paths and, if a home folder is given, paths that are never indexed are dropped."""
    ok = df.filter(F.col("_bad").isNull() & F.col("path").startswith("/")).drop("_bad")
    return ok if home is None else ok.filter(~skipped(F.col("path"), home))


def hints(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    return _good(spark.read.schema(HINT).option("columnNameOfCorruptRecord", "_bad").json(path), home)


def hint_stream(spark: SparkSession, folder: str, files: int = 256, home: str | None = None) -> DataFrame:
    """The hints of a folder as a stream; a batch takes at most so many files."""
    return _good(spark.readStream.schema(HINT).option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files).json(folder), home)


def append_hints(hints: DataFrame, folder: str) -> None:
    """Add hints (path, reason, at) to a folder that `hints` and `hint_stream` read: new files, no lock."""
    hints.select("path", "reason", "at").write.mode("append").json(folder)


def session_files(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """(session_file, line_no, raw) of the logs of a folder, of all or those modified after an ISO time. Line numbers are in order within a file, not dense."""
    r = spark.read.option("recursiveFileLookup", "true")
    lines = (r.option("modifiedAfter", modified_after) if modified_after else r).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("session_file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))


def append_telemetry(rows: DataFrame, folder: str) -> None:
    """Add rows with the columns of TELEMETRY to a log that `telemetry` reads."""
    names = [c.split()[0] for c in TELEMETRY]
    rows.select(F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)).alias("value")).write.mode("append").text(folder)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, purpose, keywords) of a tab-separated inventory; blank lines and lines from # are left out."""
    raw = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    p = F.split("value", "\t")
    return raw.select(F.get(p, F.lit(0)).alias("path"), F.get(p, F.lit(1)).alias("purpose"), F.filter(F.split(F.coalesce(F.get(p, F.lit(2)), F.lit("")), ","), lambda k: k != "").alias("keywords"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The typed columns of a telemetry log; lines that don't start with a number are left out."""
    raw = spark.read.text(path).filter(F.col("value").rlike(r"^[0-9]+ \|"))
    p = F.split("value", r" \| ")
    return raw.select(*(F.trim(F.get(p, F.lit(i))).try_cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(TELEMETRY)))
