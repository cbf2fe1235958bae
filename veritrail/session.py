"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster session brings its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench, with as many shuffle partitions as cores."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("veritrail").config("spark.driver.memory", memory)
    for k, v in (LOCAL | {"spark.sql.shuffle.partitions": str(cpus)} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def work_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, for what is written between steps; it is removed when the session ends."""
    path = f"{shared_dir(spark)}/veritrail-{spark.sparkContext.applicationId}"
    if path not in _MADE:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _MADE.add(path)
    return path


_MADE: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts the lineage and survives lost executors.

    Unlike a cached frame, nothing is recomputed when an executor goes; unlike Dataset.checkpoint, the plan runs once
    and the columns stay prunable.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    for inner in _WRITTEN:
        inner.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: For each `settled` that is at work, what was written meanwhile.
_WRITTEN: list[list[str]] = []


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile removes its shuffle files when it ends, else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`materialize` of what build gives; the tables that build itself wrote for it are removed, as nothing else reads them."""
    _WRITTEN.append(written := [])
    try:
        df = build()
        inner = [*written]
        out = materialize(df, name)
    finally:
        _WRITTEN.pop()
    for path in inner:
        remove(df.sparkSession, path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, pattern: str) -> None:
    """Remove the folders that a pattern names, such as what a broken attempt left behind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(at) or []:
        fs.delete(found.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
