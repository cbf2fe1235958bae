"""Ranked retrieval: BM25, cosine, reciprocal rank fusion, gates, and the verified search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import paths as P
from veritrail.functions import text as T
from veritrail.session import materialize, settled

#: BM25 parameters; fixed values: the constant of the reciprocal ranks, and the thresholds of the gates.
K1, B, RRF = 1.2, 0.75, 60
STRONG, WEAK, LEX_STRONG, SEM_STRONG, MARGIN = 0.62, 0.42, 0.7, 0.75, 0.015
CACHE_LEX, CACHE_VEC, CACHE_OVERLAP = 0.15, 0.75, 0.05

#: Different terms of all queries that are broadcast at most, some 5 MB.
FEW = 100_000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for each of a list of queries.

    docs are (doc_id, text), queries (query_id, text); diacritics don't count. Scores are rounded to 6 decimals, ties go to the
    smaller doc_id. Up to FEW different terms of the queries are broadcast, so that only their occurrences leave the scan; beyond that they are met by a shuffle. The
    occurrences lie in blocks of whole documents, by term; blocks of queries meet them, and of what a query's terms hold only the k best of a block that may still count leave the task.
    """
    kind, ident = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", F.explode(T.terms(F.col("text"))).alias("term"))
    row = docs.sparkSession.range(1).select(F.lit("").alias("term"))  # no term is empty: it stands for the row of a document itself
    number = F.when(F.col("term") == "", F.lit(-1).cast("bigint")).otherwise(F.monotonically_increasing_id())
    terms = materialize(q.select("term").unionByName(row).distinct().withColumn("tid", number), "terms")
    d = docs.select("doc_id", T.terms(F.col("text")).alias("w"))
    few = terms.count() <= FEW
    words = d.select("doc_id", F.size("w").alias("len"), F.explode(F.concat(F.array(F.lit("")), "w") if few else F.col("w")).alias("term"))
    met = words.join(F.broadcast(terms) if few else terms, "term").select("doc_id", "len", "tid")
    if not few:
        met = met.unionByName(d.select("doc_id", F.size("w").alias("len"), F.lit(-1).cast("bigint").alias("tid")))
    blocks = materialize(_postings(met, kind), "postings")
    n = blocks.agg(F.sum("rows").alias("n"), (F.sum("words") / F.sum("rows")).alias("avg"))
    df = blocks.select(F.explode(F.arrays_zip("tids", "held")).alias("e")).groupBy("e.tids").agg(F.sum("e.held").alias("df")).withColumnRenamed("tids", "tid")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = q.join(terms, "term").select("query_id", "tid").distinct().join(df, "tid").crossJoin(F.broadcast(n))
    each = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tid", idf.alias("idf")))).alias("t"), F.first("avg").alias("avg"))
    asked = materialize(_asked(each.select("query_id", "t.tid", "t.idf", "avg"), ident).withColumn("no", F.monotonically_increasing_id()), "asked")
    return top(_grid(blocks.drop("rows", "words"), asked).mapInArrow(_scored(k), f"query_id {ident}, doc_id {kind}, score double"), k)


def _grid(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row of blocks beside every row of asked. A task has few rows of asked and meets many blocks one by one, so that what it found for a query in one of them bounds what leaves it from the next."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n, asked.count()))
    return blocks.coalesce(-(-2 * n // parts)).crossJoin(asked.repartition(parts).hint("shuffle_replicate_nl"))


def _postings(met: DataFrame, kind: str, most: int = 1 << 20) -> DataFrame:
    """Occurrences (doc_id, len, tid) in blocks of whole documents, of about `most` rows: ids in order, for each term of tids how many it holds, and for each (document, length) that it holds the position of the id, the length and the count.

    The rows of tid -1 stand for the documents: rows is their number, words the sum of their lengths.
    """

    def block(t: pa.Table) -> pa.RecordBatch:
        ids = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        doc, size, tid = (x.to_numpy(zero_copy_only=False) for x in (ids.indices, t.column(1).combine_chunks(), t.column(2).combine_chunks()))
        rows = tid < 0
        own = [int(rows.sum()), int(size[rows].sum(dtype=np.int64))]
        doc, size, tid = doc[~rows], size[~rows], tid[~rows]
        at = np.lexsort((size, doc, tid))
        doc, size, tid = doc[at], size[at], tid[at]
        first = np.flatnonzero(np.r_[True, (np.diff(tid) != 0) | (np.diff(doc) != 0) | (np.diff(size) != 0)][: len(tid)])
        tf = np.diff(first, append=len(tid))
        tids, held = np.unique(tid[first], return_counts=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        data = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (doc[first], size[first], tf)]
        return pa.RecordBatch.from_arrays([one(ids.dictionary), one(pa.array(tids, pa.int64())), one(pa.array(held, pa.int64())), *data, *(pa.array([x], pa.int64()) for x in own)], ["ids", "tids", "held", "doc", "size", "tf", "rows", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            if kept and sum(x.num_rows for x in kept) >= most:
                same = int(pc.sum(pc.equal(b.column(0), last)).as_py() or 0) if last.is_valid else b.column(0).null_count  # in order: what goes on with the last document
                kept.append(b.slice(0, same))
                b = b.slice(same)
                if not b.num_rows:
                    continue
                yield block(pa.Table.from_batches(kept))
                kept = []
            kept.append(b)
            last = b.column(0)[b.num_rows - 1]
        if kept:
            yield block(pa.Table.from_batches(kept))

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"ids array<{kind}>, tids array<bigint>, held array<bigint>, doc binary, size binary, tf binary, rows bigint, words bigint")


def _asked(each: DataFrame, kind: str, rows: int = 1024) -> DataFrame:
    """Queries (query_id, tid, idf, avg) in blocks of at most `rows`: their ids, and the terms of all one after another from `start` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                s = b.slice(i, rows)
                tid, idf = s.column(1).flatten().to_numpy(), s.column(2).flatten().to_numpy()
                start = np.r_[0, np.cumsum(pc.list_value_length(s.column(1)).to_numpy())]
                ids = pa.ListArray.from_arrays(pa.array([0, s.num_rows], pa.int32()), s.column(0))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (start.astype(np.int64), tid, idf)), s.column(3).slice(0, 1)], ["qi", "start", "tid", "idf", "avg"])

    return each.mapInArrow(run, f"qi array<{kind}>, start binary, tid binary, idf binary, avg double")


def _scored(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of `_postings` beside those of `_asked`: the k best documents of a block for each query, without those that k earlier ones exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # by block of queries: the scores of the k best so far, falling
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, kind: np.frombuffer(b.column(c)[r].as_py(), kind)  # noqa: B023, E731
                ids, tids, qi = (b.column(c)[r].values for c in ("ids", "tids", "qi"))
                most = best.setdefault(b.column("no")[r].as_py(), np.full((len(qi), k), -np.inf))
                if not len(tids):
                    continue
                doc, tf = get("doc", np.int32).astype(np.intp), get("tf", np.int32)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * get("size", np.int32) / b.column("avg")[r].as_py()))
                ends = np.cumsum(b.column("held")[r].values.to_numpy())
                start, tid, idf = get("start", np.int64), get("tid", np.int64), get("idf", np.float64)
                at = np.minimum(np.searchsorted(tids.to_numpy(), tid), len(tids) - 1)
                at[tids.to_numpy()[at] != tid] = -1
                s, found = np.zeros(len(ids)), []
                for i in range(len(qi)):
                    spans = [(slice(ends[a - 1] if a else 0, ends[a]), w) for a, w in zip(at[start[i] : start[i + 1]], idf[start[i] : start[i + 1]]) if a >= 0]
                    if not spans:
                        continue
                    for x, w in spans:
                        np.add.at(s, doc[x], w * part[x])
                    every = np.concatenate([doc[x] for x, _ in spans])
                    value, least = s[every], most[i, -1]
                    if least == -np.inf:
                        every = np.unique(every)
                        value = s[every]
                        least = np.partition(value, -k)[-k] if len(value) > k else least
                    some = np.unique(every[value >= least - 1e-6])
                    score = np.round(s[some], 6)
                    s[every] = 0
                    order = np.argsort(-score, kind="stable")[:k]
                    order = order[score[order] >= most[i, -1]]
                    if len(order):
                        most[i] = -np.sort(-np.r_[most[i], score[order]])[:k]
                        found.append((np.full(len(order), i), some[order], score[order]))
                if found:
                    i, j, v = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([qi.take(pa.array(i)), ids.take(pa.array(j)), pa.array(v)], ["query_id", "doc_id", "score"])

    return run


def top(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def usable(vec: Column, dim: int) -> Column:
    """Exactly dim finite values, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _packed(vectors: DataFrame, ident: str, vec: str, rows: int, dim: int, spread: bool = True) -> DataFrame:
    """Blocks of at most `rows` vectors in the order of their ids as (ids, data), single precision as they are stored. spread: they are dealt out to the tasks evenly first, by a shuffle of all of them."""
    kind = vectors.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                s = b.slice(i, rows)
                s = s.take(pc.sort_indices(s.column(0), null_placement="at_start"))
                ids = pa.ListArray.from_arrays(pa.array([0, s.num_rows], pa.int32()), s.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.column(1).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["ids", "data"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = vectors.filter(usable(F.col(vec), dim)).select(ident, vec)
    return (some.repartition(n) if spread else some).mapInArrow(run, f"ids array<{kind}>, data binary")


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, ident: str = "vec_id", vec: str = "embedding", rows: int = 2048, dim: int = 64, spread: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors for each query vector, itself left out.

    A stated query set against all rows, in blocks: pairs of blocks meet, never pairs of rows, and each keeps its k best
    of a query, without those that k of earlier blocks exceed. Single precision says which may be among them. Cosines are rounded to 6 decimals, ties go to the smaller id. Null, empty, all-zero and non-finite vectors and those
    of another length take no part. spread is False for vectors that a shuffle dealt out already.
    """
    single = {"float": np.float32, "double": np.float64}
    stored = [single[x.schema[vec].dataType.elementType.simpleString()] for x in (queries, vectors)]
    slack = 1e-6 + 2.4e-7 * dim  # rounding to 6 decimals, and what a sum of dim products in single precision is wrong by

    def units(data: bytes, kind: type) -> np.ndarray:
        x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # by block of queries: the cosines of the k best so far, falling
        for b in batches:
            for r in range(b.num_rows):
                qi, di = (b.column(c)[r].values for c in ("qi", "di"))
                q, d = (units(b.column(c)[r].as_py(), kind) for c, kind in zip(("qd", "dd"), stored))
                most = best.setdefault(b.column("no")[r].as_py(), np.full((len(q), k), -np.inf))
                s = q.astype(np.float32) @ d.astype(np.float32).T
                least = most[:, -1] - slack
                new = np.flatnonzero(np.isinf(least))
                if len(new) and len(d) > k + 1:  # one more, for the query itself
                    least[new] = np.partition(s[new], -k - 1, axis=1)[:, -k - 1] - 2 * slack
                at = np.flatnonzero(s >= least.astype(np.float32)[:, None])
                i, j = np.divmod(at, len(d))
                score = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", q[i[x : x + 65536]], d[j[x : x + 65536]]), 6) for x in range(0, len(i), 65536))])
                ok = (score >= most[i, -1]) & pc.fill_null(pc.not_equal(qi.take(pa.array(i)), di.take(pa.array(j))), False).to_numpy(zero_copy_only=False)
                i, j, score = i[ok], j[ok], score[ok]
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, score, nth = (x[nth < k] for x in (i, j, score, nth))
                fresh = np.full(most.shape, -np.inf)
                fresh[i, nth] = score
                most[:] = -np.sort(-np.hstack([most, fresh]), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(i)), di.take(pa.array(j)), pa.array(score)], ["query_id", "doc_id", "score"])

    kind = vectors.schema[ident].dataType.simpleString()
    a = _packed(queries, ident, vec, min(rows, 512), dim, spread).select(F.col("ids").alias("qi"), F.col("data").alias("qd"))
    a = materialize(a.withColumn("no", F.monotonically_increasing_id()), "queries")
    b = materialize(_packed(vectors, ident, vec, rows, dim, spread).select(F.col("ids").alias("di"), F.col("data").alias("dd")), "blocks")
    return top(_grid(b, a).mapInArrow(run, f"query_id {kind}, doc_id {kind}, score double"), k)


def fuse(*ranked: DataFrame, k: int = 12, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    both = ranked[0].select("query_id", "doc_id", "rank")
    for r in ranked[1:]:
        both = both.unionByName(r.select("query_id", "doc_id", "rank"))
    return top(both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score")), k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, doc_id, score, rank, vec): lexical and vector ranking of one id space, fused; vec is the cosine, where it is among the k best, else null.

    docs are (doc_id, text), vectors (doc_id, embedding), queries (query_id, text); a query's vector is that of the row of its id. The row itself is no hit, nor is a vector without a document.
    """
    words = settled(lambda: bm25(docs, queries, k + 1).filter("doc_id <> query_id"), "words")
    vectors = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    near = settled(lambda: cosine(vectors, vectors.join(queries.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi"), k, "doc_id", spread=False), "near")
    return fuse(words, near, k=k).join(near.select("query_id", "doc_id", F.col("score").alias("vec")), ["query_id", "doc_id"], "left")


def measured(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with lex, the share of the query's tokens that the document holds, and fused, the mean of lex and vec (0 where it is null)."""
    q = queries.select("query_id", T.tokens(F.col("text")).alias("_q"))
    lex = T.coverage(F.col("_q"), F.col("text"))
    both = hits.join(q, "query_id").join(docs, "doc_id").withColumn("lex", lex).drop("text", "_q")  # in this order the texts are not shuffled again by query
    mean = (F.col("lex") + F.greatest(F.coalesce("vec", F.lit(0.0)), F.lit(0.0))) / 2
    return both.withColumn("fused", F.round(mean * 1e6) / 1e6)  # half of a cosine of 6 decimals often ends in 5: rounded as the SQL does, from the binary value


def gate(measures: DataFrame, fused: bool = True) -> DataFrame:
    """The class of each hit (query_id, doc_id, rank, lex, vec, fused): strong, weak or miss.

    With the fused gate by the fused measure alone. Without it a hit is strong if it is among the lexically best of its query at a cosine of
    LEX_STRONG, or if it is within MARGIN of the lexically best at a cosine of SEM_STRONG; weak if only one of both measures is that high.
    """
    if fused:
        g = F.when(F.col("fused") >= STRONG, "strong").when(F.col("fused") >= WEAK, "weak").otherwise("miss")
        return measures.withColumn("class", g)
    best = F.max("lex").over(Window.partitionBy("query_id"))
    vec = F.coalesce("vec", F.lit(0.0))
    strong = ((F.col("lex") >= best) & (vec >= LEX_STRONG)) | ((F.col("lex") >= best - MARGIN) & (vec >= SEM_STRONG))
    g = F.when(strong, "strong").when((F.col("lex") >= best) | (vec >= SEM_STRONG), "weak").otherwise("miss")
    return measures.withColumn("class", g)


def cache_gate(measures: DataFrame) -> DataFrame:
    """The class of each hit if it were an answer kept for reuse: none below a lexical overlap of CACHE_OVERLAP, strong at CACHE_LEX and CACHE_VEC, weak at one of them."""
    lex, vec = F.col("lex") >= CACHE_LEX, F.coalesce("vec", F.lit(0.0)) >= CACHE_VEC
    g = F.when(F.col("lex") < CACHE_OVERLAP, "miss").when(lex & vec, "strong").when(lex | vec, "weak").otherwise("miss")
    return measures.withColumn("class", g)


def score_floor(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """The hits of each query whose absolute score is at least a share of the largest."""
    most = F.max(F.abs("score")).over(Window.partitionBy("query_id"))
    return hits.withColumn("_m", most).filter(F.abs("score") >= share * F.col("_m")).drop("_m")


def in_scope(hits: DataFrame, scope: str | None) -> DataFrame:
    """The hits whose title or body holds the scope, whatever the case; all of them without one."""
    held = [F.coalesce(c, F.lit("")) for c in ("title", "body") if c in hits.columns]
    return hits.filter(F.contains(F.lower(F.concat_ws(" ", *held)), F.lit(scope.lower()))) if scope else hits


def drop_junk(hits: DataFrame, words: tuple[str, ...] = ("unclassified", "auto-sync")) -> DataFrame:
    """Without junk titles, unless nothing else would be left of a query's hits."""
    junk = F.lit(False)
    for w in words:
        junk = junk | F.lower(F.coalesce("title", F.lit(""))).contains(w)
    some = F.max(~F.col("_junk")).over(Window.partitionBy("query_id"))
    return hits.withColumn("_junk", junk).withColumn("_some", some).filter("not _junk or not _some").drop("_junk", "_some")


def dedup_hits(hits: DataFrame) -> DataFrame:
    """One hit per query and path, or title where there is no path: the first that isn't an edit note, else the first. hits have ord."""
    key = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("title"))
    w = Window.partitionBy("query_id", key).orderBy(F.lower(F.coalesce("title", F.lit(""))).contains("edited"), "ord")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_detail(hits: DataFrame, notes: DataFrame, key: str = "id_hex") -> DataFrame:
    """Hits with the columns of their notes; a column that the hits have is theirs, even where it is null."""
    return hits.join(notes.select(key, *(c for c in notes.columns if c not in hits.columns)), key, "left")


def anchors(texts: DataFrame, live: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, pos, path, alive): the paths that each text names, in order, each once, and whether they are live (path).

    A path with blanks is found by joining up to 8 following words: the longest live form counts, else the word itself.
    """
    named = texts.select(*keys, F.posexplode(P.prose_anchors(text)).alias("pos", "a"))
    wide = F.transform("a.words", lambda w, i: F.struct((i + 1).alias("k"), F.regexp_replace(F.concat_ws(" ", F.array(F.col("a.base")), F.slice("a.words", F.lit(1), i + 1)), "[.,;:]+$", "").alias("form")))
    longer = named.select(*keys, "pos", F.inline(wide)).join(live.filter(F.contains("path", F.lit(" "))).select(F.col("path").alias("form")), "form", "left_semi")
    longer = longer.groupBy(*keys, "pos").agg(F.max_by("form", "k").alias("form"))
    best = named.join(longer, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("form", "a.base").alias("path"))
    one = best.groupBy(*keys, "path").agg(F.min("pos").alias("pos"))
    return one.join(live.select("path", F.lit(True).alias("alive")), "path", "left").select(*keys, "pos", "path", F.coalesce("alive", F.lit(False)).alias("alive"))


def content_cover(hits: DataFrame, contents: DataFrame, limit: int = 262144) -> DataFrame:
    """(query_id, id_hex, content): how far the text at a hit's path covers the query's tokens; no row where it can't be read.

    hits are (query_id, id_hex, path, tokens), contents (path, text) with a row for each line of a file, which may be many: they are met line by line.
    A file over the limit, with a NUL, or a query without tokens counts as unreadable.
    """
    met = contents.join(hits.select("query_id", "id_hex", "path", "tokens"), "path")
    line = met.select("query_id", "id_hex", F.size("tokens").alias("n"), F.octet_length("text").alias("size"), F.contains("text", F.lit("\u0000")).alias("nul"), F.posexplode("tokens").alias("at", "t"), "text")
    each = line.groupBy("query_id", "id_hex", "n", "at").agg(F.max(F.contains(F.lower("text"), F.col("t"))).alias("has"), F.sum("size").alias("size"), F.max("nul").alias("nul"))
    return each.groupBy("query_id", "id_hex", "n").agg(F.count_if("has").alias("c"), F.max("size").alias("size"), F.max("nul").alias("nul")).filter((F.col("size") <= limit) & ~F.col("nul")).select("query_id", "id_hex", (F.col("c") / F.col("n")).alias("content"))


def verified_search(hits: DataFrame, notes: DataFrame, queries: DataFrame, live: DataFrame, contents: DataFrame, n: int = 6, scope: str | None = None) -> DataFrame:
    """(query_id, rnk, id_hex, verdict, path, title, score, cov_pct, content_pct): the n best hits of each query with a verdict on each.

    hits are (query_id, id_hex, title, body, score), notes (id_hex, ...), queries (query_id, text), live (path), contents (path, text). In this order:
    scope, junk titles, score floor, the max(2n, 8) best candidates, their notes, the paths they name, liveness, verdict, one hit per path, the n best by
    score and then verdict. STRONG and WEAK have a live path and cover half the query or less than that, by the path's content where it can be read, else
    by title and body; STALE names dead paths only, NOPATH none. Nothing is written: healing stale notes is `stale.outcomes`. n of 0 or less gives no row.
    """
    n = max(0, n)
    kept = score_floor(drop_junk(in_scope(hits, scope)))
    few = top(kept, max(2 * n, 8), item="id_hex").withColumnRenamed("rank", "ord")
    q = queries.select("query_id", T.tokens(F.col("text")).alias("tokens"))
    few = materialize(with_detail(few, notes).join(q, "query_id"), "candidates")
    named = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("title"))
    found = anchors(few.filter("not startswith(id_hex, 'selftest:')"), live, ["query_id", "id_hex"], named)
    own = few.select("query_id", "id_hex", F.lit(0).alias("pos"), P.selftest_path(F.col("id_hex")).alias("path")).filter("path is not null")
    found = found.unionByName(own.join(live.select("path", F.lit(True).alias("alive")), "path", "left").select("query_id", "id_hex", "pos", "path", F.coalesce("alive", F.lit(False)).alias("alive")))
    best = found.groupBy("query_id", "id_hex").agg(F.min_by("path", F.struct(~F.col("alive"), F.col("pos"))).alias("path"), F.max("alive").alias("alive"))
    met = few.join(best, ["query_id", "id_hex"], "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    content = content_cover(met.filter("alive"), contents)
    cov = T.coverage(F.col("tokens"), F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    met = met.join(content, ["query_id", "id_hex"], "left").withColumn("cov", cov)
    met = met.withColumn("verdict", T.verdict(F.col("alive"), F.col("path").isNotNull(), F.coalesce("content", "cov")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), T.verdict_rank(F.col("verdict")), "ord")
    out = dedup_hits(met).withColumn("rnk", F.row_number().over(order).cast("bigint")).filter(F.col("rnk") <= n)
    return out.select("query_id", "rnk", "id_hex", "verdict", "path", "title", "score", T.percent(F.col("cov")).alias("cov_pct"), T.percent(F.col("content")).alias("content_pct"))
