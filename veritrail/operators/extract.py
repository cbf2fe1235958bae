"""Symbols and edges of source files: Python by its own parser, everything else at file level."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, node_id string, symbol string, label string, line long, src string, dst string, relation string, error string"


def _id(path: str, raw: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:12] + ":" + raw


def _file(path: str, content: bytes) -> list[dict]:
    name = path.rsplit("/", 1)[-1]
    top = _id(path, "__file__")
    rows = [{"path": path, "kind": "file", "node_id": top, "symbol": name, "label": None, "line": None}]
    if not name.lower().endswith(".py"):
        return rows
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:  # kept at file level
        return [rows[0] | {"error": type(e).__name__}]
    own: dict[str, str] = {}

    def visit(node: ast.AST, inside: str, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                raw = f"{inside}.{child.name}" if inside else child.name
                me = _id(path, raw)
                if raw not in own:  # of repeated definitions the first line stands
                    label = child.name if isinstance(child, ast.ClassDef) else f"{child.name}()"
                    rows.append({"path": path, "kind": "symbol", "node_id": me, "symbol": raw, "label": label, "line": child.lineno})
                    rows.append({"path": path, "kind": "edge", "src": owner, "dst": me, "relation": "contains", "line": child.lineno})
                    own[raw] = me
                visit(child, raw, me)
            else:
                if isinstance(child, ast.Call) and isinstance(child.func, ast.Name):
                    rows.append({"path": path, "kind": "edge", "src": owner, "dst": child.func.id, "relation": "calls", "line": child.lineno})
                visit(child, inside, owner)

    visit(tree, "", top)
    for r in rows:
        if r["kind"] == "edge" and r["relation"] == "calls":
            if r["dst"] in own:
                r["dst"] = own[r["dst"]]
            else:
                r["kind"] = "pending"
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Node, edge and pending rows of files (path, content); content null or unparsable gives the file node, the latter with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in _file(p, c or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
