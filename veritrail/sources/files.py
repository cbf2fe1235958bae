"""A file tree as a DataFrame: a Python data source that, unlike binaryFile, keeps empty files and names that start with _ or a dot.

spark.read.format("tree").option("roots", "/a,/b").option("mode", "stat" | "bytes").load()
One partition per entry of the roots, or of folders below them where these are few; content is read in mode bytes only, up to option maxBytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrail.functions.paths import SKIPPED

STAT = "path string, size long, mtime_ms long"
_SKIP = re.compile("/(" + "|".join(map(re.escape, SKIPPED)) + ")(/|$)")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return STAT + (", content binary" if self.options.get("mode", "stat") == "bytes" else "")

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _Part(InputPartition):
    def __init__(self, path: str, level: int = 1):
        super().__init__(path)
        self.path, self.level = path, level


def _entries(path: str) -> list[str]:
    """What lies in a folder; nothing, where it can't be read."""
    try:
        return sorted(e.path for e in os.scandir(path))
    except OSError:
        return []


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split(",") if r]
        self.bytes = options.get("mode", "stat") == "bytes"
        self.most = int(options.get("maxbytes", options.get("maxBytes", 1 << 62)))
        self.depth = int(options.get("depth", 24))
        self.parts = int(options.get("parts", 64))

    def partitions(self) -> list[InputPartition]:
        """The entries of the roots; while there are fewer than `parts`, folders are replaced by their entries, level by level."""
        level, here = 1, [p for root in self.roots for p in _entries(root)]
        while level < self.depth and len(here) < self.parts:
            below = [q for p in here for q in (_entries(p) if os.path.isdir(p) and not os.path.islink(p) and not _SKIP.search(p + "/") else [p])]
            if below == here:
                break
            level, here = level + 1, below
        return [_Part(p, level) for p in here] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.path:
            yield from self._walk(partition.path, partition.level)

    def _walk(self, path: str, depth: int) -> Iterator[tuple]:
        if depth > self.depth or _SKIP.search(path + "/") or os.path.islink(path):
            return
        if os.path.isdir(path):
            for p in _entries(path):
                yield from self._walk(p, depth + 1)
        elif os.path.isfile(path):
            try:
                s = os.stat(path)
                row = (path, s.st_size, s.st_mtime_ns // 1_000_000)
                if self.bytes:
                    with open(path, "rb") as f:
                        row += (f.read(min(self.most, s.st_size)),)
            except OSError:
                return  # gone meanwhile
            yield row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
