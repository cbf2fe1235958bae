"""Searches whose words or vectors are shared by all: what leaves the tasks must not grow with the pairs."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import retrieve
from veritrail.plans.catalog import QUERIES
from veritrail.plans.sql import SQL
from veritrail.session import work_dir


def shuffled(spark, run):
    """What run gives, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext
    none = lambda: sc._jvm.java.util.ArrayList()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    got = run()
    return got, sum(n for k, n in stages().items() if k > before)


def scores(docs, queries):
    """BM25 of each query and document with a common term, by the formula."""
    words = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        for i, w in words.items():
            if terms := set(text.split()) & set(w):
                out[q, i] = round(sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms), 6)
    return out


def test_bm25_keeps_pairs_inside_tasks(spark):
    r = np.random.default_rng(3)
    word = lambda n: " ".join(["queue", *(f"w{x}" + "x" * 3 for x in r.integers(0, 300, n))])
    docs = [(i, word(int(r.integers(0, 9)))) for i in range(1500)]
    queries = [(i, word(2)) for i in range(0, 1500, 4)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got, rows = shuffled(spark, lambda: retrieve.bm25(d, q, 12).collect())
    want = {}
    for (a, b), s in scores(docs, queries).items():
        want.setdefault(a, []).append((-s, b))
    assert {(x.query_id, x.doc_id, x.score, x["rank"]) for x in got} == {(a, b, -s, n + 1) for a, v in want.items() for n, (s, b) in enumerate(sorted(v)[:12])}
    assert rows < 100_000 < len(docs) * len(queries)


def test_bm25_of_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("b", "Émile queue queue"), ("b", "queue other"), ("a", None), ("c", ""), (None, "queue"), ("a", "none here")], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "queue emile"), ("q", "QUEUE"), ("r", ""), ("s", "absent")], "query_id string, text string")
    got = [tuple(x) for x in retrieve.bm25(docs, queries, 3).orderBy("rank").collect()]
    idf = lambda df: np.log(1 + (6 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (8 / 6)))
    b = idf(3) * (part(2, 3) + part(1, 2)) + idf(1) * part(1, 3)
    assert got == [("q", "b", round(b, 6), 1), ("q", None, round(idf(3) * part(1, 1), 6), 2)]
    monkeypatch.setattr(retrieve, "FEW", 1)
    assert [tuple(x) for x in retrieve.bm25(docs, queries, 3).orderBy("rank").collect()] == got
    assert retrieve.bm25(docs.limit(0), queries, 3).count() == retrieve.bm25(docs, queries.limit(0), 3).count() == 0


def test_blocks_of_postings_hold_whole_documents(spark):
    met = spark.range(500).select((F.col("id") % 7).alias("doc_id"), F.lit(3).alias("len"), (F.col("id") % 5 - 1).alias("tid"))
    rows = retrieve._postings(met, "bigint", 20).collect()
    ids = [i for r in rows for i in r.ids]
    assert sorted(ids) == list(range(7)) and all(r.ids == sorted(r.ids) for r in rows)
    assert sum(r.rows for r in rows) == 100 and sum(sum(r.held) for r in rows) == 28


def test_cosine_of_many_small_blocks(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((1200, 64))
    x[7::100] = x[7]  # equal vectors: ties go to the smaller id
    x = x.astype(np.float32)
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)] + [(-1, [0.0] * 64), (-2, None), (-3, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = retrieve.cosine(v, v.filter("vec_id % 3 = 1"), 10, rows=16).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(q, int(d), s[q, d], n + 1) for q in range(1, 1200, 3) for n, d in enumerate(np.argsort(-s[q], kind="stable")[:10])}
    assert {(g.query_id, g.doc_id, g.score, g["rank"]) for g in got} == want


def test_fused_is_rounded_as_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    hits = spark.range(2000).select(F.lit("q").alias("query_id"), F.lit("d").alias("doc_id"), ((2 * F.col("id") + 19001) / 1e6).alias("vec"))
    docs, asked = spark.createDataFrame([("d", "queue")], "doc_id string, text string"), spark.createDataFrame([("q", "queue other")], "query_id string, text string")
    got = {(r.vec, r.fused) for r in retrieve.measured(hits, docs, asked).collect()}
    assert got == set(duckdb.sql("SELECT vec, round((0.5::DOUBLE + vec) / 2, 6) FROM (SELECT (2 * i + 19001) / 1e6::DOUBLE AS vec FROM range(2000) t(i))").fetchall())


def test_hit_line_is_that_of_printf(spark):
    df = spark.range(1000, 3000).select((F.col("id") * 5 / 1000).alias("x")).select("x", T.hit_line(F.lit("t"), F.col("x")).alias("line"))
    assert [r for r in df.collect() if r.line != "t [%.2f]" % r.x] == []


def stored(spark, folder, n=1200):
    """Tables of n notes that share a word, all with a vector; a quarter of their ids is divisible by 20."""
    r = np.random.default_rng(5)
    ident = lambda i: (5 * i).to_bytes(8, "big")
    x = r.standard_normal((n, 64))
    notes = [(ident(i), f"queue w{r.integers(0, 200)}xxx", f"body b{r.integers(0, 200)}xxx of /srv/work/f{i % 50}", 0) for i in range(n)]
    spark.createDataFrame(notes, "id binary, title string, body string, state int").write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(ident(i), x[i].tolist()) for i in range(n)], "id binary, embedding array<float>").write.parquet(f"{folder}/node_vec.parquet")
    spark.createDataFrame([(f"/srv/work/f{i}", 1, "present") for i in range(30)], "path string, generation long, state string").write.parquet(f"{folder}/paths.parquet")
    spark.createDataFrame([(f"/srv/work/f{i}", f"w{i}xxx") for i in range(30)], "path string, symbol string").write.parquet(f"{folder}/owned_nodes.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["verified_search", "cache_gate", "fused_gate", "strict_gate", "rrf_topk", "top1_query"])
def test_shuffled_rows_of_searches(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    at = stored(spark, tmp_path)
    df, rows = shuffled(spark, lambda: (d := QUERIES[name](spark, at), [tuple(r) for r in d.collect()]))
    db = duckdb.connect()
    for t in ("nodes", "node_vec", "paths", "owned_nodes"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    rel = db.sql(SQL[name])
    at = [rel.columns.index(c) for c in df[0].columns]
    assert sorted(df[1], key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert rows < 150_000  # 360,000 pairs of a search and a note share a word


@pytest.mark.parametrize("name", ["strict_gate", "rrf_topk"])
def test_steps_of_hybrid_search_leave_little_on_disk(spark, tmp_path, name):
    at = stored(spark, tmp_path)
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f for f in str(env.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    folder = work_dir(spark)
    shuffles, tables = kept(), set(os.listdir(folder))
    QUERIES[name](spark, at)
    assert {t.split("-")[0] for t in set(os.listdir(folder)) - tables} == {"words", "near"}  # the blocks they were made from are gone
    size = lambda: sum(os.path.getsize(f) for f in kept() - shuffles if os.path.exists(f))
    for _ in range(50):
        if size() < 20_000:
            break
        time.sleep(0.2)
    assert size() < 20_000  # the vectors alone are 300,000 bytes
