"""Deeply nested JSON lines into flat tables with parent-child links, by vectorised structural indexing.

A batch of lines is one byte buffer. Bitmaps of quotes, escapes, brackets and delimiters are built with whole-array
operations; prefix sums give what lies inside strings and the nesting depth; one sort by (line, depth, position) pairs
the brackets and gives each token its container and its place there; grammar is checked on adjacent tokens. Spans are
then cut for keys and scalars only, and paths are put together level by level. `arguments` strings that hold JSON objects
form the next buffer, until there are none left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "log_id long, node_path string, parent_path string"
VALUES = "log_id long, node_path string, field string, kind string, value string"

OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COLON, COMMA, STRING, SCALAR = range(1, 9)
_CODE = np.zeros(256, np.uint8)
for _b, _c in zip(b"{[}]:,", (OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COLON, COMMA), strict=True):
    _CODE[_b] = _c
_SPACE, _HEX, _ESCAPE = (np.isin(np.arange(256), list(s)) for s in (b" \t\n\r", b"0123456789abcdefABCDEF", b'"\\/bfnrtu'))
_LEXEME = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


class Index:
    """Tokens of a list of texts: line, kind, start, end (exclusive), container (token number or -1), place (commas before it there), ok by line."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        self.buffer = b"\n".join([*texts, b""])
        B = np.frombuffer(self.buffer, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, n)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.ok = np.ones(n, bool)
        line_of = lambda at: np.searchsorted(first, at, "right") - 1

        def fail(at: np.ndarray) -> None:
            self.ok[line_of(at)] = False

        # escapes: a byte is escaped when an odd run of backslashes ends before it
        back = B == 92
        where = np.arange(len(B))
        run = where - np.maximum.accumulate(np.where(back, -1, where))  # backslashes up to here, in this run
        escaped = np.zeros(len(B), bool)
        escaped[1:] = (run[:-1] & 1).astype(bool)
        quote = (B == 34) & ~escaped
        count = np.cumsum(quote)
        base = np.where(first > 0, count[first - 1], 0) if n else np.zeros(0, np.int64)
        ends = count[first + size] if n else base  # the separator after each line
        self.ok &= (ends - base) % 2 == 0
        inside = ((count - np.repeat(base, size + 1)) & 1).astype(bool)  # from the opening quote to before the closing one
        intro = np.flatnonzero(back & ~escaped & inside)
        fail(intro[~_ESCAPE[B[np.minimum(intro + 1, len(B) - 1)]]])
        u = intro[B[np.minimum(intro + 1, len(B) - 1)] == 117]
        for k in range(2, 6):
            fail(u[~_HEX[B[np.minimum(u + k, len(B) - 1)]]])
        fail(np.flatnonzero((B < 32) & inside & (where != np.repeat(first + size, size + 1))))

        plain = ~inside & ~quote & ~_SPACE[B]
        code = np.where(plain, _CODE[B], 0)
        loose = plain & (code == 0)
        edge = np.diff(np.concatenate([[0], loose.view(np.int8), [0]]))
        s0, s1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        known: dict[bytes, bool] = {}
        for a, b in zip(s0.tolist(), s1.tolist(), strict=True):
            w = self.buffer[a:b]
            good = known.get(w)
            if good is None:
                good = known[w] = bool(_LEXEME.fullmatch(w))
            if not good:
                fail(np.array([a]))
        opens = quote & inside
        q0 = np.flatnonzero(opens)
        q1 = np.flatnonzero(quote & ~inside)
        if len(q0) != len(q1):  # a line ended inside a string: pair within the lines that are whole
            whole = self.ok[line_of(q0)]
            q0, q1 = q0[whole], q1[self.ok[line_of(q1)]]
        b0 = np.flatnonzero(code)
        start = np.concatenate([b0, q0, s0])
        kind = np.concatenate([code[b0], np.full(len(q0), STRING), np.full(len(s0), SCALAR)]).astype(np.int8)
        end = np.concatenate([b0 + 1, q1 + 1, s1])
        order = np.argsort(start, kind="stable")
        start, kind, end = start[order], kind[order], end[order]
        keep = self.ok[line_of(start)] if n else np.zeros(0, bool)
        self.start, self.kind, self.end = start[keep], kind[keep], end[keep]
        self.line = line_of(self.start)
        self._nest()

    def _nest(self) -> None:
        kind, line = self.kind, self.line
        m, n = len(kind), len(self.ok)
        opening, closing = (kind == OPEN_O) | (kind == OPEN_A), (kind == CLOSE_O) | (kind == CLOSE_A)
        depth = np.cumsum(opening.astype(np.int64) - closing)
        head = np.searchsorted(line, np.arange(n))
        tail = np.searchsorted(line, np.arange(n), "right")
        before = np.where(head > 0, depth[np.maximum(head, 1) - 1], 0) if m else np.zeros(n, np.int64)
        depth = depth - before[line]  # after the token
        has = tail > head
        self.ok &= has
        if m:
            self.ok[line[depth < 0]] = False
            self.ok[has & (depth[np.maximum(tail, 1) - 1] != 0)] = False
        # the level of the container that a token belongs to; an opening bracket heads the level below
        level = np.where(opening, depth, np.where(closing, depth + 1, depth))
        number = np.arange(m)
        order = np.lexsort((number, level, line))
        lv, ln, op = level[order], line[order], opening[order]
        last = np.maximum.accumulate(np.where(op, np.arange(m), -1))
        fresh = np.ones(m, bool)
        fresh[1:] = (lv[1:] != lv[:-1]) | (ln[1:] != ln[:-1])
        group = np.maximum.accumulate(np.where(fresh, np.arange(m), 0)) if m else np.zeros(0, np.int64)
        holder = np.where(last >= group, order[np.maximum(last, 0)], -1)  # the bracket that heads a token's level
        mate = np.full(m, -1)
        mate[order] = holder
        shut = number[closing]
        pair_ok = (mate[shut] >= 0) & (kind[np.maximum(mate[shut], 0)] == kind[shut] - 2)
        self.ok[line[shut[~pair_ok]]] = False
        # an opening bracket is itself a value in the level above; sort the values there once more
        upper = np.where(opening, depth - 1, level)
        at = np.concatenate([number, number[opening]])
        lev = np.concatenate([upper, depth[opening]])
        is_head = np.concatenate([np.zeros(m, bool), np.ones(int(opening.sum()), bool)])
        order = np.lexsort((is_head, at, lev, line[at]))
        at, lev, is_head = at[order], lev[order], is_head[order]
        k = np.arange(len(at))
        last = np.maximum.accumulate(np.where(is_head, k, -1))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (lev[1:] != lev[:-1]) | (line[at[1:]] != line[at[:-1]])
        group = np.maximum.accumulate(np.where(fresh, k, 0)) if m else k
        inside = last >= group
        commas = np.cumsum((kind[at] == COMMA) & ~is_head)
        self.container, self.place = np.full(m, -1), np.zeros(m, np.int64)
        own = ~is_head
        self.container[at[own]] = np.where(inside, at[np.maximum(last, 0)], -1)[own]
        self.place[at[own]] = (commas - np.where(inside, commas[np.maximum(last, 0)], 0))[own]
        self.depth = depth
        self.opening = opening
        self._grammar(head, tail, has)

    def _grammar(self, head: np.ndarray, tail: np.ndarray, has: np.ndarray) -> None:
        kind, line, m = self.kind, self.line, len(self.kind)
        prev = np.zeros(m, np.int8)
        prev[1:] = kind[:-1]
        prev[head[has]] = 0
        inside = np.where(self.container >= 0, kind[np.maximum(self.container, 0)], 0)  # 0 at the top
        self.is_key = (kind == STRING) & (inside == OPEN_O) & ((prev == OPEN_O) | (prev == COMMA))
        prev_key = np.zeros(m, bool)
        prev_key[1:] = self.is_key[:-1]
        value_end = (kind == CLOSE_O) | (kind == CLOSE_A) | (kind == SCALAR) | ((kind == STRING) & ~self.is_key)
        prev_end = np.zeros(m, bool)
        prev_end[1:] = value_end[:-1]
        prev_end[head[has]] = False
        value = self.opening | (kind == SCALAR) | ((kind == STRING) & ~self.is_key)
        good = np.ones(m, bool)
        may = ((inside == 0) & (prev == 0)) | ((inside == OPEN_A) & ((prev == OPEN_A) | (prev == COMMA))) | ((inside == OPEN_O) & (prev == COLON))
        good[value] = may[value]
        good[kind == COLON] = prev_key[kind == COLON]
        good[kind == COMMA] = (prev_end & (inside != 0))[kind == COMMA]
        good[kind == CLOSE_O] = (prev_end | (prev == OPEN_O))[kind == CLOSE_O]
        good[kind == CLOSE_A] = (prev_end | (prev == OPEN_A))[kind == CLOSE_A]
        self.ok[line[~good]] = False
        if m:
            self.ok[has & ~value_end[np.maximum(tail, 1) - 1]] = False
        self.value = value & self.ok[line]

    def text(self, i: int) -> str:
        """The value of the string token i."""
        raw = self.buffer[self.start[i] : self.end[i]]
        if b"\\" in raw:
            return json.loads(raw).encode("utf-8", "surrogatepass").decode("utf-8", "replace")  # half a pair can't be stored
        return raw[1:-1].decode("utf-8", "replace")


def _index(texts: list[bytes], base: list[str], above: list[str], values: bool) -> tuple[list, list, list]:
    """(node rows, value rows, arguments to go on with) of one buffer; each with the text's number first."""
    ix = Index(texts)
    v = np.flatnonzero(ix.value)
    inside = np.where(ix.container[v] >= 0, ix.kind[np.maximum(ix.container[v], 0)], 0)
    keyed = v[inside == OPEN_O]
    names: dict[int, str] = {i: ix.text(i - 2) for i in keyed.tolist()}
    path: dict[int, str] = {}
    around: dict[int, str] = {}  # path of the nearest object that is an element, itself included
    nodes, cells, more = [], [], []
    opened = v[ix.opening[v]]
    # level by level, so that each container's path is there before its members need it
    for i in opened[np.argsort(ix.depth[opened], kind="stable")].tolist():
        c, ln = int(ix.container[i]), int(ix.line[i])
        under, near = (path[c], around[c]) if c >= 0 else (base[ln], above[ln])
        element = False
        if i in names:
            under = f"{under}.{names[i]}"
            if names[i] == "content" and ix.kind[i] == OPEN_O:
                under, element = under + "[0]", True
        elif c >= 0:
            under, element = f"{under}[{ix.place[i]}]", ix.kind[i] == OPEN_O
        path[i] = under
        if element:
            nodes.append((ln, under, near))
            near = under
        around[i] = near
    strings = keyed[(ix.kind[keyed] == STRING)]
    for i in strings[[names[i] == "arguments" for i in strings.tolist()]].tolist() if len(strings) else []:
        t = ix.text(i).strip(" \t\r\n")
        if t.startswith("{"):
            c = int(ix.container[i])
            more.append((int(ix.line[i]), i, t, path[c] + ".arguments", around[c]))
    if values:
        for i in v[~ix.opening[v]].tolist():
            c, ln = int(ix.container[i]), int(ix.line[i])
            under, near = (path[c], around[c]) if c >= 0 else (base[ln], above[ln])
            full = f"{under}.{names[i]}" if i in names else f"{under}[{ix.place[i]}]" if c >= 0 else under
            s = ix.kind[i] == STRING
            cells.append((ln, near, full[len(near) :].removeprefix("."), "string" if s else "scalar", ix.text(i) if s else ix.buffer[ix.start[i] : ix.end[i]].decode()))
    return nodes, cells, more


def flatten(ids: list[int], raw: list[str | None], values: bool = False) -> tuple[list, list]:
    """Node rows (log_id, node_path, parent_path) and value rows (log_id, node_path, field, kind, value) of a batch of lines."""
    texts = [(r or "").encode("utf-8", "surrogatepass") for r in raw]
    owner, base, above = list(ids), [""] * len(ids), [""] * len(ids)
    shown = lambda p: p.removeprefix(".") or "$"
    nodes, cells = [], []
    while texts:
        n, c, more = _index(texts, base, above, values)
        nodes += [(owner[i], shown(p), shown(q)) for i, p, q in n]
        cells += [(owner[i], shown(p), f, k, x) for i, p, f, k, x in c]
        texts = [t.encode("utf-8", "surrogatepass") for _, _, t, _, _ in more]
        owner, base, above = [owner[i] for i, *_ in more], [m[3] for m in more], [m[4] for m in more]
    return nodes, cells


def _batches(batches: Iterator[pa.RecordBatch], values: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            rows = flatten(part.column("log_id").to_pylist(), part.column("raw").to_pylist(), values)[values]
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nested_nodes(session_logs: DataFrame) -> DataFrame:
    """(log_id, node_path, parent_path), one row per object that is an element of an array, at any depth.

    A lone object as `content` is element 0 of an array; an `arguments` string that is a complete JSON object counts as
    that object. parent_path is the nearest enclosing such object, or `$`. Null, blank, torn and otherwise invalid
    lines give no row; a line delivered more than once gives its rows once. Of repeated keys all count.
    """
    schema = pa.schema([("log_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string())])
    return session_logs.select("log_id", "raw").mapInArrow(lambda it: _batches(it, False, schema), NODES).distinct()


def nested_values(session_logs: DataFrame) -> DataFrame:
    """(log_id, node_path, field, kind, value): every string and scalar with the row it belongs to; field is its path within that row."""
    schema = pa.schema([("log_id", pa.int64()), *((c, pa.string()) for c in ("node_path", "field", "kind", "value"))])
    return session_logs.select("log_id", "raw").mapInArrow(lambda it: _batches(it, True, schema), VALUES).distinct()
