import json

import pytest

from veritrail.operators.nested import flatten, nested_nodes


def truth(i, raw):
    out = []

    def walk(x, path, near):
        if isinstance(x, dict):
            for k, v in x.items():
                p = f"{path}.{k}" if path else k
                if k == "arguments" and isinstance(v, str):
                    try:
                        o = json.loads(v)
                    except ValueError:
                        o = None
                    if isinstance(o, dict):
                        v = o
                if k == "content" and isinstance(v, dict):
                    v = [v]
                walk(v, p, near)
        elif isinstance(x, list):
            for n, v in enumerate(x):
                p = f"{path}[{n}]"
                if isinstance(v, dict):
                    out.append((i, p, near))
                    walk(v, p, p)
                else:
                    walk(v, p, near)

    try:
        o = json.loads(raw)
    except (ValueError, TypeError):
        return set()
    walk(o, "", "$")
    return set(out)


LINES = [
    '{"a":[{},{"b":[{"c":1}]}]}', '[{"b":[{}]}]', '{"a":[[{}],{}]}', '{"content":{"x":[{}]}}', '{"arguments":"{\\"q\\":[{}]}"}', '{"arguments":" {\\"content\\":{}} "}',
    '{"a":[{"b":"}]"}]}', '{"a":[{"b":"\\\\"},{}]}', ' {"a":[{}]}\r', '{"é":[{"x":"\\u00e9"}]}', '{"a":[{"n":-1.5e3,"t":true,"z":null}]}', "[]", "{}", '{"":[{}]}',
    '{"a":[{}]}}', '{"a":[{}', '{"a" 1}', '{"a":}', "{,}", "[1,]", '{"a":[{},{}],}', '{"a":01}', '{"a":[{}] "b":1}', '{"a":"\t"}', '{"a":[{"x":"\\x"}]}', "nul", '"', "", "   ", "[}", "[{}] [{}]",
]


@pytest.mark.parametrize("raw", LINES)
def test_line(raw):
    assert set(flatten([1], [raw])[0]) == truth(1, raw)


def test_all_lines_at_once():
    got = set(flatten(list(range(len(LINES) + 1)), [*LINES, None])[0])
    assert got == set().union(*(truth(i, r) for i, r in enumerate(LINES)))


def test_values_belong_to_the_row_around_them():
    cells = flatten([7], ['{"k":"v","a":[{"m":{"n":2}}]}'], True)[1]
    assert set(cells) == {(7, "$", "k", "string", "v"), (7, "a[0]", "m.n", "scalar", "2")}


def test_table(spark, sf):
    t = spark.read.parquet(f"{sf}/session_logs.parquet")
    got = [tuple(r) for r in nested_nodes(t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set().union(*(truth(r.log_id, r.raw) for r in t.select("log_id", "raw").collect()))


def test_empty_and_redelivered(spark):
    t = spark.createDataFrame([(1, '{"a":[{}]}'), (1, '{"a":[{}]}'), (None, None)], "log_id long, raw string")
    assert [tuple(r) for r in nested_nodes(t).collect()] == [(1, "a[0]", "$")]
    assert nested_nodes(t.limit(0)).count() == 0


def test_long_and_deep():
    deep = "[" * 400 + '{"x":[{}]}' + "]" * 400
    long = '{"a":[' + ",".join("{}" for _ in range(5000)) + "]}"
    assert len(flatten([1], [deep])[0]) == 2
    assert flatten([1], [long])[0][-1] == (1, "a[4999]", "$")
