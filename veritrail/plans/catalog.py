"""Every registered query of the core. Their SQL is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import paths as P
from veritrail.functions import text as T
from veritrail.operators import converge, edges, nested, orphans, retrieve, sessions, stale
from veritrail.plans.sql import SQL  # noqa: F401
from veritrail.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROOTS = {"/srv/work": "symbol", "/opt/mono/**": "graph", "/home/dev/*/**": "file", "/data": "path", "/srv/work/**/internal/**": "graph"}
SEARCHES = {
    1: "pending retry of the resolver", 2: "stale manifest and torn journal", 3: "timeout checked by the scheduler", 4: "duplicate coverage of the daemon",
    5: "open question about a frozen cursor", 6: "migration rejected the oversized queue", 7: "unreadable capability in the audit", 8: "which parser keeps the lock open",
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _millis(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (doc_id, path, text)."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    ext = F.get(F.array(*map(F.lit, (".py", ".md", ".ts", ".yaml", ".go", ".bin"))), (F.col("doc_id") % 6).cast("int"))
    path = F.concat(F.lit("/home/u/"), F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("path"), "text")


# functions over whole tables


@query
def content_hash(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("path", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))


@query
def node_ids(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    return p.select("path").distinct().select("path", P.namespace(F.col("path")).alias("ns"), P.node_id(F.col("path")).alias("node_id"))


@query
def language_of(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    return converge.current(p).groupBy(P.language_of(F.col("path")).alias("language"), P.has_extractor(F.col("path")).alias("extracted")).agg(F.count("*").alias("n"))


@query
def depth_for(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    d = P.depth_for(F.col("path"), ROOTS, "max", "symbol")
    return p.select("path").distinct().select("path", d.alias("d")).select("path", "d.requested", "d.effective", "d.clamped")


@query
def skip_filter(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    return p.select("path").distinct().select("path", P.skipped(F.col("path"), "/home/dev").alias("skip"))


@query
def line_parse(spark, sf_dir):
    (n,) = _t(spark, sf_dir, "owned_nodes")
    place = F.when(F.col("kind") == "file", F.col("line").cast("string")).otherwise(F.concat(F.lit("L"), F.col("line").cast("string")))
    return n.groupBy("kind", P.line_of(place).alias("line")).agg(F.count("*").alias("n"))


@query
def rendered_nodes(spark, sf_dir):
    """The projection of every owned node: title, body and keywords."""
    n, p = _t(spark, sf_dir, "owned_nodes", "paths")
    c = [F.col(x) for x in ("kind", "path", "symbol", "label", "line")]
    lang = P.language_of(F.col("path"))
    return converge.owned(n, p).select("node_id", T.render_title(*c).alias("title"), T.render_body(*c, lang).alias("body"), F.array_join(T.render_keywords(F.col("kind"), lang), ",").alias("keywords"))


@query
def hint_paths(spark, sf_dir):
    """The quoted paths of all log lines, home expanded."""
    (l,) = _t(spark, sf_dir, "session_logs")
    return l.select(F.explode(P.quoted_paths(F.col("raw"), "/home/dev")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query
def command_paths(spark, sf_dir):
    """The paths that documents would touch, were they commands."""
    (d,) = _t(spark, sf_dir, "documents")
    return d.select(F.explode(P.command_paths(F.col("text"), "/home/dev")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query
def reply_ids(spark, sf_dir):
    """The id in a store's reply to each projected node: in a sentence, or as JSON."""
    (n,) = _t(spark, sf_dir, "owned_nodes")
    reply = F.when(F.col("kind") == "file", F.concat(F.lit('{"result": {"id_hex": "'), "sink_id", F.lit('"}}'))).otherwise(F.concat(F.lit("stored as "), "sink_id", F.lit(".")))
    return n.select(T.store_id(reply).alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))


@query
def selftest_paths(spark, sf_dir):
    """Selftest ids of owned nodes and the paths in them."""
    (n,) = _t(spark, sf_dir, "owned_nodes")
    id_ = F.concat(F.lit("selftest:"), "path", F.lit(":"), "kind")
    return n.select(P.selftest_path(id_).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query
def saved_hours(spark, sf_dir):
    """By day: hours of the summed values, and how many hours before its last event the last purchase was."""
    (e,) = _t(spark, sf_dir, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    g = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 2).alias("s"), F.max(sec).alias("now"), F.coalesce(F.max(F.when(F.col("event_type") == "purchase", sec)), F.lit(0)).alias("last"))
    return g.select("day", T.hours(F.col("s")).alias("hours"), T.sync_age(F.col("now"), F.col("last")).alias("age"))


# convergence


def _hints(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/home/u/f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("reason"), _millis("ts").alias("at"), F.col("event_id").alias("seq"))


@query
def hint_collapse(spark, sf_dir):
    return converge.collapse_hints(_hints(spark, sf_dir))


@query
def queue_batch(spark, sf_dir):
    return converge.queue_batch(converge.collapse_hints(_hints(spark, sf_dir)))


@query
def reconcile_actions(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    return converge.actions(converge.before_last(p), converge.current(p))


@query
def action_tally(spark, sf_dir):
    return converge.tally(reconcile_actions(spark, sf_dir))


@query
def aba_split(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "paths")
    return converge.split_by_generation(p.select("path", "generation"), p)


@query
def ownership_replace(spark, sf_dir):
    n, p = _t(spark, sf_dir, "owned_nodes", "paths")
    first = converge.first_owned(n).select("node_id", "path", "line", "label")
    now = converge.owned(n, p).select("node_id", "path", "line", "label")
    late = n.groupBy("path").agg((F.max("committed_at") > F.min("committed_at")).alias("again")).filter("again")
    return converge.replace_owned(first, now.join(late, "path", "left_semi").select(first.columns), late)


@query
def desired_diff(spark, sf_dir):
    n, p = _t(spark, sf_dir, "owned_nodes", "paths")
    return converge.desired_diff(converge.first_owned(n), converge.owned(n, p))


@query
def index_stats(spark, sf_dir):
    p, n, e, w = _t(spark, sf_dir, "paths", "owned_nodes", "owned_edges", "pending_edges")
    s = converge.current(p).agg(F.count_if(F.col("state") == "present").alias("present"), F.count_if(F.col("state") == "absent").alias("absent"))
    own = n.agg(F.countDistinct("node_id").alias("nodes"))
    ed = e.select("path", "src", "dst", "relation").distinct().agg(F.count("*").alias("edges"))
    pe = edges.waiting(w).agg(F.count("*").alias("pending"))
    return s.crossJoin(own).crossJoin(ed).crossJoin(pe).crossJoin(converge.queue_depth(converge.collapse_hints(_hints(spark, sf_dir))))


@query
def path_order(spark, sf_dir):
    """Every path of the index in order, with its current row."""
    return converge.current(_t(spark, sf_dir, "paths")[0]).orderBy("path").select("path", "state", "generation")


@query
def dirty_lookup(spark, sf_dir):
    """What the index holds of each dirty path: one join with the dirty set instead of a lookup for each path."""
    p, n, e, w = _t(spark, sf_dir, "paths", "owned_nodes", "owned_edges", "pending_edges")
    return converge.held(p.filter("generation > 3").select("path").distinct(), p, n, e, w)


@query
def bootstrap_scan(spark, sf_dir):
    """The hints of a forced first scan: every file on disk that isn't skipped."""
    (p,) = _t(spark, sf_dir, "paths")
    now = converge.current(p).filter("state = 'present'")
    return converge.bootstrap(now, p, "/home/dev", force=True)


@query
def edges_resolved(spark, sf_dir):
    w, n, p = _t(spark, sf_dir, "pending_edges", "owned_nodes", "paths")
    return edges.resolved(w, converge.owned(n, p))


@query
def edges_pending(spark, sf_dir):
    w, n, p = _t(spark, sf_dir, "pending_edges", "owned_nodes", "paths")
    return edges.unresolved(w, converge.owned(n, p))


@query
def pending_union(spark, sf_dir):
    w, n, p = _t(spark, sf_dir, "pending_edges", "owned_nodes", "paths")
    dirty = p.filter("generation > 3").select("path").distinct()
    fresh = n.filter("kind = 'symbol'").join(dirty, "path", "left_semi").select("symbol").distinct()
    return edges.pending_union(w, dirty, fresh)


@query
def edge_places(spark, sf_dir):
    e, n = _t(spark, sf_dir, "owned_edges", "owned_nodes")
    return edges.local_split(e.select("path", "src", "dst", "relation").distinct(), n).groupBy("relation", "place").agg(F.count("*").alias("n"))


def _audit(spark, sf_dir, **how):
    (p,) = _t(spark, sf_dir, "paths")
    return converge.drift(converge.before_last(p), converge.current(p), ROOTS, "graph", **how)


@query
def audit_shallow(spark, sf_dir):
    return _audit(spark, sf_dir)


@query
def audit_deep(spark, sf_dir):
    return _audit(spark, sf_dir, deep=True, untracked=True)


@query
def drift_counts(spark, sf_dir):
    return audit_deep(spark, sf_dir).groupBy("why").agg(F.count("*").alias("n"))


@query
def audit_queue(spark, sf_dir):
    """What an audit puts into the queue, a row for each path."""
    return converge.collapse_hints(converge.audit_hints(audit_shallow(spark, sf_dir), 0)).select("path", "reason", "generation")


@query
def drain_outcomes(spark, sf_dir):
    """A drain while the sink is down: a row that was never reconciled can't be read, and paths of later generations were hinted again meanwhile."""
    (p,) = _t(spark, sf_dir, "paths")
    now = converge.current(p).withColumn("error", F.when(F.col("reconciled_at").isNull(), "unreadable"))
    started = F.when(F.col("generation") % 3 == 0, F.col("generation") - 1).otherwise(F.col("generation"))
    return converge.drained(converge.before_last(p), now.withColumn("started", started), sink_ok=False)


# retrieval and verification


@query
def query_tokens(spark, sf_dir):
    (n,) = _t(spark, sf_dir, "nodes")
    t = stale.notes(n).select("id_hex", T.tokens(F.col("title")).alias("t"))
    return t.select("id_hex", F.size("t").cast("bigint").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query
def coverage(spark, sf_dir):
    """How far each note's body covers its title, and the verdict with the liveness of the paths it names."""
    n, p = _t(spark, sf_dir, "nodes", "paths")
    c = T.coverage(T.tokens(F.col("title")), F.col("body"))
    named = stale.mentions(n, p).groupBy("id_hex").agg(F.max("alive").alias("alive"))
    both = stale.notes(n).join(named, "id_hex", "left").withColumn("c", c)
    v = T.verdict(F.coalesce("alive", F.lit(False)), F.col("alive").isNotNull(), F.col("c"))
    return both.select("id_hex", F.round("c", 6).alias("cov"), v.alias("verdict"), T.percent(F.col("c")).alias("pct"), T.result_line(v, F.col("c"), F.col("title")).alias("line"))


def _texts(spark, sf_dir):
    (n,) = _t(spark, sf_dir, "nodes")
    return stale.notes(n).select(F.col("id_hex").alias("doc_id"), F.concat_ws(" ", "title", "body").alias("text"))


def _asked(spark, sf_dir):
    """The titles of the notes whose id is divisible by 20, as searches."""
    (n,) = _t(spark, sf_dir, "nodes")
    number = F.conv("id_hex", 16, 10).cast("decimal(20,0)")
    return stale.notes(n).filter((number % 20 == 0) & (F.trim("title") != "")).select(F.col("id_hex").alias("query_id"), F.col("title").alias("text"))


def _vectors(spark, sf_dir):
    (v,) = _t(spark, sf_dir, "node_vec")
    ok = v.filter(F.col("id").isNotNull() & retrieve.usable(F.col("embedding"), 64))
    return ok.groupBy(F.lower(F.hex("id")).alias("doc_id")).agg(F.min("embedding").alias("embedding"))


@query
def verified_search(spark, sf_dir):
    """The searches over all notes, each hit with a verdict. The symbols of a file, one a line, stand for its content."""
    n, p, o = _t(spark, sf_dir, "nodes", "paths", "owned_nodes")
    notes = stale.notes(n)
    asked = _asked(spark, sf_dir)
    found = retrieve.bm25(_texts(spark, sf_dir), asked, 25).select("query_id", F.col("doc_id").alias("id_hex"), "score")
    hits = retrieve.with_detail(found, notes)
    lines = o.filter("symbol is not null").select("path", F.col("symbol").alias("text")).distinct()
    return retrieve.verified_search(hits, notes, asked, stale.live_paths(p), lines)


def _searches(spark):
    return spark.createDataFrame([(k, v) for k, v in SEARCHES.items()], "query_id long, text string")


@query
def bm25_topk(spark, sf_dir):
    return retrieve.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _searches(spark), 25)


@query
def score_floor(spark, sf_dir):
    return retrieve.score_floor(bm25_topk(spark, sf_dir), 0.9)


@query
def cosine_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieve.cosine(e, e.filter("vec_id % 20 = 0"), 10)


@query
def rrf_topk(spark, sf_dir):
    """Hybrid search: the words and the vector of each note whose id is divisible by 20 against all notes, fused."""
    return retrieve.hybrid(_texts(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir), 12).drop("vec")


def _measured(spark, sf_dir):
    t, q = _texts(spark, sf_dir), _asked(spark, sf_dir)
    return retrieve.measured(retrieve.hybrid(t, _vectors(spark, sf_dir), q, 12), t, q)


@query
def fused_gate(spark, sf_dir):
    return retrieve.gate(_measured(spark, sf_dir)).select("query_id", "doc_id", "fused", "class")


@query
def strict_gate(spark, sf_dir):
    """The gate by both measures apart."""
    return retrieve.gate(_measured(spark, sf_dir), fused=False).select("query_id", "doc_id", "vec", "class")


@query
def cache_gate(spark, sf_dir):
    return retrieve.cache_gate(_measured(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


@query
def top1_query(spark, sf_dir):
    """The best hit of each search, if the gate lets it pass."""
    return retrieve.gate(_measured(spark, sf_dir).filter("rank = 1")).filter("class <> 'miss'").select("query_id", "doc_id", "class", T.hit_line(F.col("doc_id"), F.col("fused")).alias("line"))


def _hits(spark, sf_dir):
    (n,) = _t(spark, sf_dir, "nodes")
    q = F.array(*map(F.lit, ("migration", "scheduler", "duplicate", "edited")))
    found = F.get(P.prose_anchors(F.col("title")), F.lit(0))["base"]
    h = stale.notes(n).select(F.lit(1).alias("query_id"), "id_hex", "title", found.alias("path"), T.coverage(q, F.col("title"), F.col("body")).alias("score"))
    return h.filter("score > 0").withColumn("ord", F.concat(F.format_string("%05d", F.lit(100000) - F.floor(F.col("score") * 1000).cast("int")), F.col("id_hex")))


@query
def junk_filter(spark, sf_dir):
    return retrieve.drop_junk(_hits(spark, sf_dir), ("note on", "orphaned")).select("id_hex", "title", "score")


@query
def dedup_hits(spark, sf_dir):
    return retrieve.dedup_hits(_hits(spark, sf_dir)).select("id_hex", "title", "path", "score")


@query
def beam_walk(spark, sf_dir):
    e, n = _t(spark, sf_dir, "owned_edges", "owned_nodes")
    starts = n.filter("kind = 'file'").select(F.col("node_id").alias("start")).distinct()
    return edges.beam_walk(e, starts)


# stale notes, sessions, telemetry


def _mentioned(spark, sf_dir):
    n, p = _t(spark, sf_dir, "nodes", "paths")
    return n, p, stale.mentions(n, p)


def _outcomes(spark, sf_dir):
    n, p, m = _mentioned(spark, sf_dir)
    return n, stale.outcomes(m, p)


@query
def note_paths(spark, sf_dir):
    """Every path that a note names, in order, and whether it is live."""
    return _mentioned(spark, sf_dir)[2].select("id_hex", F.col("pos").cast("bigint").alias("pos"), "path", "alive")


@query
def stale_candidates(spark, sf_dir):
    return stale.candidates(_mentioned(spark, sf_dir)[2])


@query
def rehome_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir)[1]


@query
def rehome_rewrite(spark, sf_dir):
    return stale.rewritten(*_outcomes(spark, sf_dir))


@query
def rehome_replaced(spark, sf_dir):
    """Edit notes that a rebuilt note of the same path replaces."""
    return stale.replaced_edits(*_outcomes(spark, sf_dir))


@query
def removal_log(spark, sf_dir):
    return stale.removal_log(*_outcomes(spark, sf_dir))


@query
def sweep_totals(spark, sf_dir):
    return stale.totals(*_outcomes(spark, sf_dir))


@query
def seed_replace(spark, sf_dir):
    """Every file that the index ever owned as an inventory; those still present are seeded."""
    n, p, o = _t(spark, sf_dir, "nodes", "paths", "owned_nodes")
    rows = o.filter("kind = 'file'").select("path", P.basename(F.col("path")).alias("purpose"), F.array(P.language_of(F.col("path"))).alias("keywords")).distinct()
    fresh = stale.inventory_rows(rows, stale.live_paths(p)).select(F.col("path").alias("title"), T.seed_body(F.col("purpose")).alias("body"))
    return stale.seed(stale.notes(n).select("title", "body"), fresh)


@query
def node_dump(spark, sf_dir):
    (n,) = _t(spark, sf_dir, "nodes")
    k = stale.notes(n).select("id_hex", F.explode(T.tokens(F.col("title"))).alias("keyword"))
    return stale.dump(n, k)


@query
def session_edits(spark, sf_dir):
    return sessions.edits(sessions.tool_calls(table(spark, sf_dir, "session_logs")))


@query
def edit_paths(spark, sf_dir):
    return session_edits(spark, sf_dir).filter("path is not null").groupBy("path").agg(F.count("*").alias("edits"))


@query
def usage_count(spark, sf_dir):
    return sessions.usage(table(spark, sf_dir, "session_logs"))


def _calls(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "grep").when(F.col("event_type") == "signup", "reset").otherwise("other")
    return e.select(F.col("user_id").alias("session"), F.struct(_millis("ts").alias("at"), "event_id").alias("seq"), "event_id", kind.alias("class"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def guard_chain(spark, sf_dir):
    return sessions.guard(_calls(spark, sf_dir), F.col("day")).select("session", "event_id", "chain", "warn")


@query
def guard_warnings(spark, sf_dir):
    return sessions.guard(_calls(spark, sf_dir), F.col("day")).groupBy("session").agg(F.count_if("warn").alias("warnings"), F.max("chain").alias("longest"))


@query
def first_prompt(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("/"), "event_type")).when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.concat("event_type", F.lit(" "), "props"))
    inputs = e.select(F.col("user_id").alias("session"), F.struct(_millis("ts"), "event_id").alias("seq"), "event_id", text.alias("text"))
    return sessions.first_prompt(inputs).select("session", "event_id", "text")


@query
def telemetry_rollup(spark, sf_dir):
    return sessions.snapshots(table(spark, sf_dir, "events"))


@query
def telemetry_trend(spark, sf_dir):
    return sessions.trend(telemetry_rollup(spark, sf_dir))


@query
def tail_snapshots(spark, sf_dir):
    return telemetry_rollup(spark, sf_dir).orderBy(F.desc("day")).limit(14)


@query
def hit_rate(spark, sf_dir):
    return sessions.hit_rates(table(spark, sf_dir, "events"))


@query
def p50_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.groupBy("event_type").agg(F.count("value").alias("n"))
    return n.join(sessions.median_by(e, "event_type", "value"), "event_type", "left").select("event_type", F.round("median", 6).alias("p50"), "n")


@query
def answer_classes(spark, sf_dir):
    """Answers by class and day, one column a class."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day").pivot("event_type", ["purchase", "view", "error"]).agg(F.count("event_id")).na.fill(0).selectExpr("day", "purchase as strong", "view as weak", "error as miss")


@query
def orient_hits(spark, sf_dir):
    """What a session is shown first: the three best notes of live files, then what a walk over the edges from their files finds, each title once, six in all."""
    p, e, o = _t(spark, sf_dir, "paths", "owned_edges", "owned_nodes")
    best = _hits(spark, sf_dir).join(stale.live_paths(p), "path", "left_semi").orderBy(F.desc("score"), "id_hex").limit(3).select("id_hex", "title", "path", F.lit(0).alias("src"), "score")
    starts = best.filter("path is not null").select(P.node_id(F.col("path")).alias("start"), "score").groupBy("start").agg(F.max("score").alias("score"))
    walk = edges.beam_walk(e, starts.select("start"), depth=2, beam=4).join(starts, "start")
    node = F.min_by(F.coalesce("label", "symbol"), F.struct("path", "committed_at", "line", "label"))
    names = o.join(F.broadcast(walk.select("node").distinct()), o.node_id == F.col("node"), "left_semi").groupBy("node_id").agg(node.alias("title"))  # at most 3 starts, 8 nodes each
    near = walk.join(names, walk.node == names.node_id).groupBy("node_id", "title").agg(F.max(F.col("score") / (F.col("hop") + 1)).alias("score"))
    both = best.drop("path").unionByName(near.select(F.col("node_id").alias("id_hex"), "title", F.lit(1).alias("src"), "score"))
    key = F.split("title", r" \[")[0]
    w = Window.partitionBy(key).orderBy("src", F.desc("score"), "id_hex")
    one = both.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return one.orderBy("src", F.desc("score"), "id_hex").limit(6).select("id_hex", "title", F.col("src").cast("bigint").alias("src"), F.round("score", 6).alias("score"))


@query
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


@query
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return e.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


# numbered problems of the core


@query
def p3_found(spark, sf_dir):
    return nested.nested_nodes(table(spark, sf_dir, "session_logs"))


@query
def p3_values(spark, sf_dir):
    return nested.nested_values(table(spark, sf_dir, "session_logs"))


def _orphans(spark, sf_dir):
    return orphans.orphans(*_t(spark, sf_dir, "owned_edges", "pending_edges", "owned_nodes", "paths", "nodes"))


@query
def p5_found(spark, sf_dir):
    return _orphans(spark, sf_dir).drop("status")


@query
def p5_report(spark, sf_dir):
    return orphans.orphan_report(_orphans(spark, sf_dir))
