import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import paths as P
from veritrail.functions import text as T
from veritrail.operators import components, converge, edges, orphans, retrieve, sessions, stale
from veritrail.operators.components import connected_components
from veritrail.operators.extract import extract
from veritrail.operators.skew import skewed_lookup
from veritrail.sources import files, logs
from veritrail.store import Store
from veritrail.streaming.converge import audit, commit, converge_batch, plan, rebuild, resolved, start
from veritrail.streaming.guard import guard_stream


def values(df):
    return {tuple(r) for r in df.collect()}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_path_functions(spark):
    r = one(spark, P.suffix(F.lit("/a/.b")), P.suffix(F.lit("/a/x.PY")), P.rank_of(F.lit("graph")), P.rank_of(F.lit("none")), P.expand_home(F.lit("~/x"), "/h"), P.line_of(F.lit("L12")), P.line_of(F.lit("x")))
    assert tuple(r) == ("", ".py", 3, -1, "/h/x", 12, None)
    assert P.watch_roots({"~/a/**": "max", "/b/": "file", "/b/*/c": "file", "*": "path"}, "/h") == ["/h/a", "/b"]
    r = one(spark, P.rewrite_path(F.lit("see /a/b and /a/bc, /a/b/d"), F.lit("/a/b"), F.lit("/$1")))
    assert r[0] == "see /$1 and /a/bc, /$1/d"
    assert one(spark, P.quoted_paths(F.lit('{"a":"/x/y","b":"~/z","c":"no"}'), "/h"))[0] == ["/x/y", "/h/z"]
    assert one(spark, P.command_paths(F.lit("cat '/a b/c' /d > ~/e x/y"), "/h"))[0] == ["/a b/c", "/d", "/h/e", "/y"]


@pytest.mark.parametrize(("path", "want"), [("/x/a", ("file", "file", False)), ("/x/deep/b", ("graph", "file", True)), ("/y", ("path", "path", False)), ("/xy", ("path", "path", False))])
def test_depth(spark, path, want):
    d = P.depth_for(F.lit(path), {"/x": "file", "/x/deep": "graph", "/y": "bogus"}, "path", "file")
    assert tuple(one(spark, d.alias("d"))[0]) == want


def test_text_functions(spark):
    q = F.array(F.lit("alpha"), F.lit("beta"))
    r = one(spark, T.coverage(q, F.lit("Alphabet")), T.content_score(q, F.lit("a\u0000b")), T.content_score(q, F.lit(None).cast("string")), T.percent(F.lit(0.999)), T.verdict(F.lit(False), F.lit(True), F.lit(1.0)))
    assert tuple(r) == (0.5, None, None, 99, "STALE")
    assert one(spark, T.store_id(F.lit("stored 0123456789abcdef ok")), T.store_id(F.lit('{"result":{"id_hex":"ab"}}')))[:] == ("0123456789abcdef", "ab")
    assert one(spark, T.sync_age(F.lit(7300), F.lit(0)), T.sync_age(F.lit(7300), F.lit(10)), T.hit_rate(F.lit(0), F.lit(0), F.lit(0)))[:] == (-1, 2, 0.0)


def test_lookup_with_a_hot_key(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.filter("k is not null").select("k").distinct().withColumn("v", F.length("k"))
    got = skewed_lookup(left, right, ["k"])
    assert got.count() == 2000
    assert values(got.select("id", "v")) == values(left.join(right, "k", "left").select("id", "v"))


def test_blocks_of_a_session_give_the_same(spark):
    r = random.Random(6)
    calls = spark.createDataFrame([(i % 3, i, r.choice(["grep", "grep", "grep", "other", "reset"])) for i in range(300)], "session int, seq int, class string")
    whole = values(sessions.guard(calls).select("seq", "chain", "warn"))
    for size in (1, 7, 50):
        assert values(sessions.guard(calls, F.floor(F.col("seq") / size)).select("seq", "chain", "warn")) == whole
    lines = spark.createDataFrame([("f", i, r.choice([None, None, None, f"d{i}"])) for i in range(200)] + [("g", 5, None)], "session_file string, line_no int, cwd string")
    whole = values(sessions.carried(lines, "cwd"))
    for block in (1, 9, 64):
        assert values(sessions.carried(lines, "cwd", block)) == whole


def test_stars_in_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "STAR", 20)
    links = [(0, i) for i in range(1, 150)] + [(500, i) for i in range(100, 220)] + [(900, 901)]
    got = values(connected_components(spark.createDataFrame(links, "a long, b long")))
    assert got == {(i, 0) for i in [*range(220), 500]} | {(900, 900), (901, 900)}


def test_medians(spark):
    r = random.Random(4)
    rows = [("a", r.choice([1.0, 2.0, 1e9])) for _ in range(101)] + [("b", float(i)) for i in range(10)] + [("c", 5.0)] * 4 + [("d", None), ("e", -3.0), (None, 7.0)] + [("f", r.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {}
    for g in "abcef":
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    got = {r.g: r.median for r in sessions.median_by(df, "g", "x", 16).collect() if r.g is not None}
    assert got == pytest.approx(want)
    assert sessions.median_by(df.limit(0), "g", "x").count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = values(connected_components(spark.createDataFrame(links, "a long, b long")))
    assert got == {(x, find(x)) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_orphans(spark):
    ts = "2031-03-0{} 10:00:00".format
    e = spark.createDataFrame([("p", "s", " n1\t", "uses", ts(1), 0), ("p", "s", "n1", "uses", ts(3), 1), ("p", "s", "n2", "uses", ts(2), 0), ("p", "s", "gone", "uses", ts(2), 0), (None, None, None, None, None, 0)], "path string, src string, dst string, relation string, committed_at string, extra int")
    w = spark.createDataFrame([("p", "s", "Sym", "calls", ts(2)), ("p", "s", "sym", "calls", ts(2))], "path string, src string, dst_symbol string, relation string, committed_at string")
    n = spark.createDataFrame([("n1", "p", "Sym", "AB", ts(1)), ("n2", "p", None, "", ts(4)), ("gone", "q", None, None, ts(1))], "node_id string, path string, symbol string, sink_id string, committed_at string")
    e, w, n = (t.withColumn("committed_at", F.to_timestamp_ntz("committed_at")) for t in (e, w, n))
    p = spark.createDataFrame([("p", 1, "absent"), ("p", 2, "present"), ("q", 1, "present"), ("q", 2, "absent")], "path string, generation long, state string")
    d = spark.createDataFrame([(bytearray(b"\xab"), 1, 0)], "id binary, state int, created_at long")
    got = {(r.tbl, r.target, r.status) for r in orphans.orphans(e, w, n, p, d).collect()}
    assert got == {("owned_edges", "n2", "late"), ("owned_edges", "gone", "deleted"), ("owned_edges", None, "missing"), ("pending_edges", "sym", "missing"), ("owned_nodes", "ab", "deleted")}
    assert orphans.orphans(*(t.limit(0) for t in (e, w, n, p, d))).count() == 0


def test_edges_dont_depend_on_order(spark):
    nodes = [("a:f", "A", "a::f"), ("b:g", "B", "b::g"), ("c:g", "C", "b::g")]
    w = spark.createDataFrame([("A", "a:f", "b::g", "calls", None, None)], "path string, src string, dst_symbol string, relation string, line long, committed_at timestamp")
    want = {("A", "a:f", "b:g", "calls", None)}
    for order in (nodes, nodes[::-1]):
        n = spark.createDataFrame(order, "node_id string, path string, symbol string")
        assert values(edges.resolved(w, n)) == want
        assert edges.unresolved(w, n).count() == 0
    assert edges.unresolved(w, n.limit(0)).count() == 1


def test_guard(spark):
    kinds = ["grep", "grep", "other", "grep", "grep", "reset", "grep"]
    c = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "session long, seq long, class string")
    got = [(r.chain, r.warn) for r in sessions.guard(c).orderBy("seq").collect()]
    assert got == [(1, False), (2, False), (2, False), (3, True), (4, True), (0, False), (1, False)]


def test_guard_stream(spark, tmp_path):
    src = tmp_path / "in"
    kinds = ["grep", "grep", "other", "grep", "grep", "reset", "grep"]
    for i, part in enumerate((kinds[:4], kinds[4:])):
        spark.createDataFrame([(1, i * 4 + j, k) for j, k in enumerate(part)], "session long, seq long, class string").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("session long, seq long, class string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = guard_stream(s).writeStream.format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = values(spark.table("chains").select("seq", "warn"))
    assert got == {(i, i in (3, 4)) for i in range(7)}


FILES = "path string, size long, mtime_ms long, content binary"


def disk_of(spark, **files):
    rows = [(f"/{k}.py", len(v or ""), 1, None if v is None else v.encode()) for k, v in files.items()]
    df = spark.createDataFrame(rows, FILES)
    return lambda dirty: df.join(dirty, "path", "left_semi")


def hint(spark, *paths):
    return spark.createDataFrame([(p, "x", i) for i, p in enumerate(paths)], "path string, reason string, at long")


def snapshot(store):
    parts = {"paths": ("hash", "size", "depth", "cap_max", "state"), "nodes": ("node_id", "symbol", "line", "sink_id"), "edges": ("src", "dst", "relation"), "pending": ("src", "dst_symbol", "relation")}
    return {t: values(store.read(t).select("path", *c)) for t, c in parts.items()}


def test_converge_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    hints = tmp_path / "hints"
    hints.mkdir()
    (hints / "1.json").write_text('{"path":"/a.py","reason":"x","at":1}\n{"path":"/a.py","reason":"y","at":2}\nnot json\n{"path":"rel","at":1}\n{"path":"/b.py","at":3}\n')
    disk = disk_of(spark, a="def f():\n    g()\n", b="def g():\n    pass\n")
    full = spark.createDataFrame([("/a.py", 0, 1, "other")], "path string, size long, mtime_ms long, hash string")
    q = start(logs.hint_stream(spark, str(hints)), store, disk, str(tmp_path / "cp"), once=True, again=str(hints), audit_every=0, full=lambda: full)
    assert q.awaitTermination(120)
    assert {(r.path, r.reason) for r in logs.hints(spark, str(hints)).filter("startswith(reason, 'audit')").collect()} == {("/a.py", "audit:mtime/size"), ("/b.py", "audit:missing")}
    assert values(store.read("actions")) == {("/a.py", "indexed"), ("/b.py", "indexed")}
    assert values(store.read("paths").select("path", "generation", "state", "depth")) == {("/a.py", 2, "present", "graph"), ("/b.py", 1, "present", "graph")}
    before = snapshot(store)
    assert not converge_batch(store, hint(spark, "/a.py"), disk_of(spark), store.committed()).count()  # a replay
    assert snapshot(store) == before
    assert values(converge_batch(store, hint(spark, "/a.py", "/b.py"), disk)) == {("/a.py", "unchanged"), ("/b.py", "unchanged")}
    assert snapshot(store) == before
    assert values(converge_batch(store, hint(spark, "/a.py", "/b.py"), disk_of(spark, b="def h():\n    pass\n"))) == {("/a.py", "retracted"), ("/b.py", "updated")}
    assert values(store.read("nodes").select("path", "symbol")) == {("/b.py", "b.py"), ("/b.py", "h")}
    assert values(converge_batch(store, hint(spark, "/a.py"), disk_of(spark))) == {("/a.py", "absent")}


def test_hot_file(spark, tmp_path):
    """Forty versions of one file, seen at a few of them, end as the last one."""
    store = Store(spark, str(tmp_path), 4)
    for v in (6, 13, 39):
        converge_batch(store, hint(spark, *["/hot.py"] * 7), disk_of(spark, hot=f"x = {v}\n"))
    assert values(store.read("nodes").select("path", "kind")) == {("/hot.py", "file")}
    [row] = store.read("paths").collect()
    assert row.generation == 21 and row.hash == hashlib.sha256(b"x = 39\n").hexdigest()


def test_order_does_not_matter(spark, tmp_path):
    disk = disk_of(spark, a="def f():\n    g()\n", b="def g():\n    pass\n")
    seen = []
    for order in (("/a.py", "/b.py"), ("/b.py", "/a.py")):
        store = Store(spark, str(tmp_path / order[0][1]), 4)
        for p in order:
            converge_batch(store, hint(spark, p), disk)
        seen.append((snapshot(store), values(resolved(store))))
    assert seen[0] == seen[1]
    f, g = (hashlib.sha256(f"/{x}.py".encode()).hexdigest()[:12] for x in "ab")
    assert ("/a.py", f"{f}:f", f"{g}:g", "calls", 2) in seen[0][1]


def test_commits_of_an_old_plan_are_stale(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    converge_batch(store, hint(spark, "/a.py", "/b.py"), disk_of(spark, a="1", b="1"))
    old = plan(store, hint(spark, "/a.py", "/b.py"), disk_of(spark, a="2", b="2"))
    converge_batch(store, hint(spark, "/a.py"), disk_of(spark, a="3", b="1"))
    assert values(commit(store, old)) == {("/a.py", "stale"), ("/b.py", "updated")}
    assert {(r.path, r.hash) for r in store.read("paths").collect()} == {("/a.py", hashlib.sha256(b"3").hexdigest()), ("/b.py", hashlib.sha256(b"2").hexdigest())}


def test_errors_and_deferred_keep_their_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    converge_batch(store, hint(spark, "/a.py", "/b.py", "/c.py"), disk_of(spark, a="1", b="def f():\n    pass\n", c="1"))
    before = snapshot(store)
    acts = converge_batch(store, hint(spark, "/a.py", "/b.py", "/c.py"), disk_of(spark, a=None, b="def (", c="1"), sink_ok=False)
    assert values(acts) == {("/a.py", "error"), ("/b.py", "deferred"), ("/c.py", "unchanged")}
    assert snapshot(store) == before
    converge_batch(store, hint(spark, "/b.py"), disk_of(spark, b="def ("), cap="file")  # can't be parsed, kept at file level
    assert values(store.read("nodes").filter("path = '/b.py'").select("kind")) == {("file",)}


def test_rebuild_and_audit(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    converge_batch(store, hint(spark, "/a.py", "/gone.py"), disk_of(spark, a="1", gone="1"))
    files = disk_of(spark, a="2", new="1")(spark.createDataFrame([("/a.py",), ("/new.py",)], "path string"))
    disk = files.select("path", "size", F.lit(5).cast("long").alias("mtime_ms"), F.sha2("content", 256).alias("hash"))
    assert values(audit(store, disk, 9)) == {("/a.py", "audit:mtime/size", 9, 0), ("/gone.py", "audit:missing", 9, 0)}
    assert values(audit(store, disk, 9, deep=True)) == {("/a.py", "audit:hash", 9, 0), ("/gone.py", "audit:missing", 9, 0)}
    assert values(rebuild(store, files)) == {("/a.py", "updated"), ("/gone.py", "retracted"), ("/new.py", "indexed")}


def test_drift_and_stale_commits(spark):
    cols = "path string, generation long, hash string, size long, mtime_ms long, depth string, state string, cap_max string"
    j = [("a", 1, "h", 1, 1, "file", "present", None), ("b", 1, "h", 1, 1, "file", "absent", None), ("c", 1, "h", 1, 1, "file", "present", None)]
    j += [("down", 1, "h", 1, 1, "graph", "present", None), ("seen", 1, "h", 1, 1, "file", "present", "graph"), ("low", 1, "h", 1, 1, None, "present", "file"), ("dark", 1, "h", 1, 1, "graph", "present", "graph")]
    d = [("a", 2, "x", 1, 1, "graph", "present", "graph"), ("b", 2, "h", 1, 1, "file", "present", None), ("d", 1, "h", 1, 1, "file", "present", None)]
    d += [("down", 1, "h", 1, 1, "file", "present", "file"), ("seen", 1, "h", 1, 1, "graph", "present", "graph"), ("low", 1, "h", 1, 1, "graph", "present", "graph"), ("dark", 1, None, 2, 1, "graph", "present", "graph")]
    j, d = spark.createDataFrame(j, cols), spark.createDataFrame(d, cols)
    always = {("a", "depth file -> graph"), ("b", "reappeared"), ("c", "missing"), ("low", "depth null -> graph")}
    assert values(converge.drift(j, d)) == always | {("dark", "mtime/size")}
    assert values(converge.drift(j, d, deep=True, untracked=True)) == always | {("a", "hash"), ("d", "untracked")}
    assert values(converge.drift(j, d, cap="file")) == {("b", "reappeared"), ("c", "missing"), ("dark", "mtime/size")}
    c = spark.createDataFrame([("a", 1), ("a", 2)], "path string, generation long")
    assert values(converge.split_by_generation(c, d)) == {("a", 1, "stale"), ("a", 2, "committed")}


def test_paths_in_prose(spark):
    live = spark.createDataFrame([("/home/u/My Notes (Sep 2024)",), ("/home/u/x.md",)], "path string")
    texts = [("1", "see '/home/u/x.md', or /home/u/My Notes (Sep 2024) and more"), ("2", "~/a.{md,yaml}; /srv/q.py:12."), ("3", None), ("4", "no path /usr/x"), ("5", "/home/u/x.md /home/u/x.md")]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {(r.id, r.path, r.alive) for r in retrieve.anchors(df, live, ["id"], F.col("text")).collect()}
    assert got == {("1", "/home/u/x.md", True), ("1", "/home/u/My Notes (Sep 2024)", True), ("2", "~/a.md", False), ("2", "~/a.yaml", False), ("2", "/srv/q.py", False), ("5", "/home/u/x.md", True)}
    assert one(spark, P.selftest_path(F.lit("selftest:/a:b/c.py:x")), P.selftest_path(F.lit("ab12")))[:] == ("/a:b/c.py", None)


def test_stale_notes(spark):
    paths = spark.createDataFrame([("/home/u/new/moved.py", "present", 1), ("/home/u/p/same.py", "present", 1), ("/srv/q/same.py", "present", 1), ("/home/u/dir/x.py", "present", 1), ("/data/gone.py", "absent", 2)], "path string, state string, generation long")
    rows = [(b"1", "old/moved.py — edited by x", "at /home/u/old/moved.py and /home/u/old/zzz.py"), (b"2", "t", "/data/same.py"), (b"3", "t", "/opt/dir and"), (b"4", "t", "/data/gone.py /home/u/dir/x.py"), (b"5", "/data/none.py", ""), (b"6", "new/moved.py — edited by y", "body"), (b"7", None, None)]
    nodes = spark.createDataFrame([(*r, 0) for r in rows], "id binary, title string, body string, state int")
    m = stale.mentions(nodes, paths)
    found = stale.outcomes(m, paths)
    got = {(r.id_hex, r.path, r.outcome, r.new_path) for r in found.collect()}
    assert got == {("31", "/home/u/old/moved.py", "REBUILT", "/home/u/new/moved.py"), ("32", "/data/same.py", "AMBIGUOUS", None), ("33", "/opt/dir", "NOTFOUND", None), ("35", "/data/none.py", "NOTFOUND", None)}
    assert values(stale.totals(nodes, found)) == {(7, 4, 1, 3, 1)}
    assert values(stale.rewritten(nodes, found)) == {("31", "new/moved.py — edited by x", "at /home/u/new/moved.py and /home/u/old/zzz.py")}
    assert values(stale.replaced_edits(nodes, found)) == {("36", "31")}
    inv = spark.createDataFrame([("/home/u/dir/x.py", "p", []), ("# c", "p", []), ("/data/gone.py", "p", []), ("/srv/q/same.py", "an auto-sync note", [])], "path string, purpose string, keywords array<string>")
    assert [r.path for r in stale.inventory_rows(inv, stale.live_paths(paths)).collect()] == ["/home/u/dir/x.py"]


def test_verified_search(spark):
    notes = spark.createDataFrame([("a", "alpha beta", "in /home/x.py"), ("b", "alpha", "/home/gone.py"), ("c", "beta alpha gamma", "none"), ("d", "unclassified alpha", ""), ("selftest:/home/x.py:q", "alpha beta", "self"), ("e", "x.py edited", "/home/x.py alpha"), ("f", "beta", "low")], "id_hex string, title string, body string")
    hits = notes.select(F.lit(1).alias("query_id"), "id_hex", "title", F.lit("hit body").alias("more")).join(spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.8), ("d", 5.0), ("selftest:/home/x.py:q", 0.7), ("e", 2.0), ("f", 0.1)], "id_hex string, score double"), "id_hex")
    asked = spark.createDataFrame([(1, "alpha beta delta")], "query_id int, text string")
    live = spark.createDataFrame([("/home/x.py",)], "path string")
    lines = spark.createDataFrame([("/home/x.py", "def ALPHA"), ("/home/x.py", "delta = 1")], "path string, text string")
    run = lambda **k: [(r.id_hex, r.verdict, r.path, r.cov_pct, r.content_pct) for r in retrieve.verified_search(hits, notes, asked, live, lines, **k).orderBy("rnk").collect()]
    # one hit per path: the note that isn't an edit; junk and what is below the floor are left out
    assert run() == [("a", "STRONG", "/home/x.py", 66, 66), ("b", "STALE", "/home/gone.py", 33, None), ("c", "NOPATH", None, 66, None)]
    assert run(n=1) == [("a", "STRONG", "/home/x.py", 66, 66)] and run(n=0) == [] and run(n=-3) == []
    assert [x[0] for x in run(scope="GAMMA")] == ["c"]
    big = lines.unionByName(spark.createDataFrame([("/home/x.py", "x" * 300_000)], "path string, text string"))
    assert retrieve.verified_search(hits, notes, asked, live, big).filter("id_hex = 'a'").select("verdict", "content_pct").collect() == [("STRONG", None)]
    assert retrieve.verified_search(hits.limit(0), notes, asked, live, lines).count() == 0


def test_inserts_and_logs(spark, tmp_path):
    none = spark.createDataFrame([], "id_hex string, title string, body string, keywords array<string>")
    once = stale.insert_note(none, "t", "b", "k2, k1,,k2")
    assert [(r.title, r.keywords) for r in once.collect()] == [("t", ["k1", "k2"])] and stale.insert_note(once, "t", "b", "k1").count() == 1
    with pytest.raises(ValueError):
        stale.insert_note(none, " ", "b")
    folder = str(tmp_path / "h")
    for i in range(2):
        logs.append_hints(spark.createDataFrame([(f"/p{i}", "x", i)], "path string, reason string, at long"), folder)
    logs.append_hints(spark.createDataFrame([("/w/node_modules/x", "x", 2), ("/h/.rc", "x", 3)], "path string, reason string, at long"), folder)
    assert values(logs.hints(spark, folder, "/h").select("path", "at")) == {("/p0", 0), ("/p1", 1)} and logs.hints(spark, folder).count() == 4
    row = (1, "iso", 1, 10, 20, 3, 0.5, 0.6, 2, 0, 7, 0.9, 0, None)
    logs.append_telemetry(spark.createDataFrame([row], ", ".join(logs.TELEMETRY)), str(tmp_path / "t"))
    assert [tuple(r) for r in logs.telemetry(spark, str(tmp_path / "t")).collect()] == [row]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.jsonl").write_text("{}\n[]\n")
    assert [r.raw for r in logs.session_files(spark, str(tmp_path / "s")).orderBy("line_no").collect()] == ["{}", "[]"]
    assert logs.session_files(spark, str(tmp_path / "s"), "2999-01-01T00:00:00").count() == 0


def test_file_tree_and_extraction(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("1")
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / ".dot").write_text("d")
    (tmp_path / "pkg" / "mod.py").write_text("def alpha():\n    beta()\n\nclass Gamma:\n    def m(self):\n        alpha()\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    files.register(spark)
    load = lambda mode, parts=64: spark.read.format("tree").option("roots", str(tmp_path)).option("mode", mode).option("parts", parts).load()
    assert values(load("stat")) == values(load("stat", 1)) and load("stat").rdd.getNumPartitions() > load("stat", 1).rdd.getNumPartitions()
    assert {r.path.rsplit("/", 1)[1]: r.size for r in load("stat").collect()} == {"__init__.py": 0, ".dot": 1, "mod.py": 71, "bad.py": 5}
    rows = extract(load("bytes")).collect()
    mod = [r for r in rows if r.path.endswith("mod.py")]
    assert {(r.label, r.line) for r in mod if r.kind == "symbol"} == {("alpha()", 1), ("Gamma", 4), ("m()", 5)}
    assert [(r.dst, r.line) for r in mod if r.kind == "pending"] == [("beta", 2)]
    assert [r.error for r in rows if r.path.endswith("bad.py")] == ["SyntaxError"]


def test_line_formats(spark, tmp_path):
    (tmp_path / "inv.tsv").write_text("# c\n\n/a/b_c.md\tnotes_on x\tk1,k2\n/d\n")
    got = logs.inventory(spark, str(tmp_path / "inv.tsv")).collect()
    assert [(r.path, r.purpose, r.keywords) for r in got] == [("/a/b_c.md", "notes_on x", ["k1", "k2"]), ("/d", None, [])]
    (tmp_path / "t.log").write_text("junk\n1 | iso | 1 | 10 | 20 | 3 | 0.5 | 0.6 | 2 | 0 | 7 | 0.9 | 0 | 1.5\n5 | x | bad\n")
    got = logs.telemetry(spark, str(tmp_path / "t.log")).collect()
    assert [(r.epoch, r.nodes, r.daemon, r.est_saved_h) for r in got] == [(1, 10, 1, 1.5), (5, None, None, None)]
