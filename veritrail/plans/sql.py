"""SQL with the same results as the queries, for an independent engine."""

from __future__ import annotations

from veritrail.functions.paths import EXTRACTED, LANGUAGES
from veritrail.functions.text import STOP_WORDS

_CURRENT = "(SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY path ORDER BY generation DESC) = 1)"
_PRIOR = "(SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY path ORDER BY generation DESC) = 2)"
_DESC = "committed_at DESC NULLS LAST, path DESC NULLS LAST, kind DESC NULLS LAST, symbol DESC NULLS LAST, line DESC NULLS LAST, label DESC NULLS LAST, sink_id DESC NULLS LAST"
_ASC = _DESC.replace("DESC NULLS LAST", "ASC NULLS FIRST")
_OWNED = f"(SELECT * FROM (SELECT * FROM owned_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {_DESC}) = 1) WHERE path IN (SELECT path FROM {_CURRENT} WHERE state = 'present'))"
_FIRST = f"(SELECT * FROM owned_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {_ASC}) = 1)"
_WAITING = (
    "(SELECT path, src, symbol, relation, line FROM (SELECT *, trim(dst_symbol, chr(32) || chr(9)) AS symbol FROM pending_edges) "
    "QUALIFY row_number() OVER (PARTITION BY path, src, symbol, relation ORDER BY committed_at DESC NULLS LAST, line DESC NULLS LAST) = 1)"
)
_SYMBOLS = f"(SELECT symbol, arg_min(node_id, (path, node_id)) AS dst FROM {_OWNED} WHERE symbol IS NOT NULL GROUP BY symbol)"
_NOTES = "(SELECT lower(hex(id)) AS id_hex, min(title) AS title, min(body) AS body FROM nodes WHERE state = 0 AND id IS NOT NULL GROUP BY id)"
_STOP = f"[{', '.join(map(repr, STOP_WORDS))}]"


def _tokens(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-Z0-9_\\-\\./]{{3,}}')), lambda t: NOT list_contains({_STOP}, t))"


def _anchors(text: str) -> str:
    """The paths that a text names, in order; no path of the tables holds a blank, so that none is extended over following words."""
    words = f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \\t\\r\\n\\f\"]+'), lambda w: w <> '')"
    clean = "regexp_replace(regexp_replace(regexp_extract(w, '(?s)(?:~|/(?:home|srv|opt|data))/.*\\z'), '[''.,;:)\\]`]+\\z', ''), ':[0-9]+\\z', '')"
    brace = "'(?s)^([^{]*)\\{([^}]*)\\}?(.*)\\z'"
    forms = f"CASE WHEN contains(p, '{{') THEN list_transform(string_split(regexp_extract(p, {brace}, 2), ','), lambda x: concat(regexp_extract(p, {brace}, 1), x, regexp_extract(p, {brace}, 3))) ELSE [p] END"
    return f"flatten(list_transform(list_filter(list_transform({words}, lambda w: {clean}), lambda p: p <> ''), lambda p: {forms}))"


_LIVE = f"(SELECT path FROM {_CURRENT} WHERE state = 'present')"
_NAMED = f"(SELECT id_hex, unnest(a) AS path, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT id_hex, {_anchors("coalesce(nullif(body, ''), title)")} AS a FROM {_NOTES}))"
_MENTIONS = f"(SELECT id_hex, min(pos) AS pos, path, path IN {_LIVE} AS alive FROM {_NAMED} GROUP BY id_hex, path)"
_CANDIDATES = f"(SELECT id_hex, count(*) AS dead, arg_min(path, pos) AS first_dead FROM {_MENTIONS} GROUP BY id_hex HAVING NOT bool_or(alive))"
_SEARCHED = (
    "(" + " OR ".join(f"(starts_with(path, '{r}/') AND len(string_split(path, '/')) - 2 <= 8)" for r in ("/home", "/srv", "/opt", "/data")) + ") "
    "AND NOT regexp_matches(path, '/(node_modules|\\.git|\\.build|\\.venv|venv|Pods|DerivedData)/')"
)
_ABOVE = f"(SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS i FROM {_LIVE}))"
_HOMES = f"(SELECT regexp_extract(path, '([^/]*)$', 1) AS name, count(*) AS n, sum(f) AS files, min(path) AS home FROM (SELECT path, 1 AS f FROM {_LIVE} UNION ALL SELECT path, 0 FROM {_ABOVE}) WHERE {_SEARCHED} GROUP BY 1)"
_OUTCOMES = (
    f"(SELECT c.id_hex, c.first_dead AS path, CASE WHEN n = 1 AND files = 1 THEN 'REBUILT' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOTFOUND' END AS outcome, CASE WHEN n = 1 AND files = 1 THEN home END AS new_path "
    f"FROM {_CANDIDATES} c LEFT JOIN {_HOMES} f ON regexp_extract(c.first_dead, '([^/]*)$', 1) = f.name)"
)
_HINTS = "(SELECT '/home/u/f' || user_id AS path, event_type AS reason, epoch_us(ts) AS hinted, event_id AS seq FROM events)"
_COLLAPSED = f"(SELECT path, max(hinted) AS enqueued_at, arg_min(reason, (hinted, seq)) AS reason, count(*) AS generation FROM {_HINTS} GROUP BY path)"
_SAME = "p.state = 'present' AND p.hash IS NOT DISTINCT FROM d.hash AND p.depth IS NOT DISTINCT FROM d.depth"
_ACTIONS = (
    "(SELECT d.path, CASE WHEN d.state <> 'present' AND p.state = 'present' THEN 'retracted' WHEN d.state <> 'present' THEN 'absent' "
    f"WHEN {_SAME} THEN 'unchanged' WHEN p.hash IS NULL THEN 'indexed' ELSE 'updated' END AS action FROM {_CURRENT} d LEFT JOIN {_PRIOR} p ON p.path = d.path)"
)
_LANG = "{" + ", ".join(f"{k!r}: {v!r}" for k, v in LANGUAGES.items()) + "}"
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"
_LANGUAGE = f"coalesce((MAP {_LANG})[{_EXT}], 'text')"


def _depth(cap: str) -> tuple[str, str]:
    """The depth that the rules ask for a path, and what the capability allows of it."""
    asked = (
        "CASE WHEN regexp_matches(path, '^/srv/work/.*/internal/.*$') THEN 'graph' WHEN regexp_matches(path, '^/home/dev/[^/]*/.*$') THEN 'file' WHEN regexp_matches(path, '^/opt/mono/.*$') THEN 'graph' "
        "WHEN regexp_matches(path, '^/srv/work(/|$)') THEN 'symbol' WHEN regexp_matches(path, '^/data(/|$)') THEN 'path' ELSE 'max' END"
    )
    return asked, f"CASE WHEN {_rank(asked)} BETWEEN 0 AND {('path', 'file', 'symbol', 'graph').index(cap)} THEN {asked} ELSE '{cap}' END"


def _rank(level: str) -> str:
    return f"(coalesce(list_position(['path', 'file', 'symbol', 'graph'], {level}), 0) - 1)"


def _drift(deep: bool) -> str:
    differ = "(d.hash IS NOT NULL AND p.hash IS DISTINCT FROM d.hash)" if deep else "(p.mtime_ms IS DISTINCT FROM d.mtime_ms OR p.size IS DISTINCT FROM d.size)"
    join = "FULL JOIN" if deep else "LEFT JOIN"
    rows = f"SELECT coalesce(p.path, d.path) AS path, p.state AS ps, coalesce(d.state = 'present', false) AS here, {differ} AS differ, p.depth AS pd, coalesce(p.cap_max = 'graph', false) AS seen FROM {_PRIOR} p {join} {_CURRENT} d ON p.path = d.path"
    first = "SELECT path, 'untracked' AS why FROM r WHERE ps IS NULL AND here UNION ALL " if deep else ""
    up = _depth("graph")[1]
    return (
        f"WITH r AS ({rows}) {first}SELECT path, 'missing' AS why FROM r WHERE ps = 'present' AND NOT here UNION ALL SELECT path, 'reappeared' FROM r WHERE ps = 'absent' AND here "
        f"UNION ALL SELECT path, '{'hash' if deep else 'mtime/size'}' FROM r WHERE ps = 'present' AND here AND differ "
        f"UNION ALL SELECT path, 'depth ' || coalesce(pd, 'null') || ' -> ' || {up} FROM r WHERE ps = 'present' AND here AND NOT seen AND {_rank(up)} > {_rank("coalesce(pd, 'path')")}"
    )


_QUERIES = {
    1: "pending retry of the resolver", 2: "stale manifest and torn journal", 3: "timeout checked by the scheduler", 4: "duplicate coverage of the daemon",
    5: "open question about a frozen cursor", 6: "migration rejected the oversized queue", 7: "unreadable capability in the audit", 8: "which parser keeps the lock open",
}
_TOKEN = "'[a-zA-Z0-9_\\-\\./]{3,}'"


def _bm25(docs: str, queries: str, k: int) -> str:
    return f"""(
WITH q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(strip_accents(text)), {_TOKEN})) AS term FROM {queries}),
w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), {_TOKEN}) AS w FROM {docs}),
n AS (SELECT count(*) AS n, avg(len(w)) AS av FROM w),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.l / n.av))), 6) AS score
FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY q.query_id, tf.doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


_BM25 = _bm25("documents", f"(VALUES {', '.join(f"({k}::BIGINT, '{v}')" for k, v in _QUERIES.items())}) v(query_id, text)", 25)
_TEXTS = f"(SELECT id_hex AS doc_id, concat_ws(' ', title, body) AS text FROM {_NOTES})"
_ASKED = f"(SELECT id_hex AS query_id, title AS text FROM {_NOTES} WHERE ('0x' || id_hex)::UBIGINT % 20 = 0 AND trim(title) <> '')"
_VECTORS = (
    "(SELECT lower(hex(id)) AS doc_id, min(embedding) AS embedding FROM node_vec WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 "
    "AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND id IN (SELECT id FROM nodes WHERE state = 0) GROUP BY id)"
)


def _cosine(vectors: str, ident: str, where: str, k: int) -> str:
    return (
        f"(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.{ident} AS query_id, d.{ident} AS doc_id, "
        "round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score "
        f"FROM {vectors} q JOIN {vectors} d ON q.{ident} <> d.{ident} WHERE {where}) QUALIFY rank <= {k})"
    )


_COSINE = _cosine("embeddings", "vec_id", "q.vec_id % 20 = 0", 10)
_MEASURED = f"""(WITH notes_ AS {_TEXTS}, asked_ AS {_ASKED}, vectors_ AS {_VECTORS}, l AS {_bm25('notes_', 'asked_', 13)}, v AS {_cosine('vectors_', 'doc_id', 'q.doc_id IN (SELECT query_id FROM asked_)', 12)},
f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM
(SELECT query_id, doc_id, rank FROM l WHERE query_id <> doc_id UNION ALL SELECT query_id, doc_id, rank FROM v) GROUP BY 1, 2) QUALIFY rank <= 12),
m AS (SELECT f.*, v.score AS vec, {_tokens('a.text')} AS t, lower(n.text) AS hay FROM f JOIN notes_ n ON f.doc_id = n.doc_id JOIN asked_ a ON f.query_id = a.query_id LEFT JOIN v ON f.query_id = v.query_id AND f.doc_id = v.doc_id),
c AS (SELECT query_id, doc_id, score, rank, vec, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(hay, x)))::DOUBLE / len(t) ELSE 0 END AS lex FROM m)
SELECT *, round((lex + greatest(coalesce(vec, 0), 0)) / 2, 6) AS fused, max(lex) OVER (PARTITION BY query_id) AS best FROM c)"""
_FUSED = "CASE WHEN fused >= 0.62 THEN 'strong' WHEN fused >= 0.42 THEN 'weak' ELSE 'miss' END"
_HIT_SCORE = " + ".join(f"contains(lower(concat_ws(' ', title, body)), '{t}')::INT" for t in ("migration", "scheduler", "duplicate", "edited"))
_HITS = f"(SELECT id_hex, title, {_anchors('title')}[1] AS path, ({_HIT_SCORE}) / 4.0::DOUBLE AS score FROM {_NOTES} WHERE ({_HIT_SCORE}) > 0)"
_SHOTS = (
    "(SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS nodes, count(DISTINCT user_id) AS edges, count(*) FILTER (event_type = 'click') AS hits, "
    "count(*) FILTER (event_type = 'error') AS errors, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY 1)"
)
_CHAIN = """(SELECT session, event_id, class, CAST(sum((class = 'grep')::INT) OVER (PARTITION BY session, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM (
SELECT *, sum((class = 'reset')::INT) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT user_id AS session, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'grep' WHEN event_type = 'signup' THEN 'reset' ELSE 'other' END AS class FROM events)))"""
_LINES = "(SELECT session_file, line_no, raw FROM session_logs QUALIFY row_number() OVER (PARTITION BY session_file, line_no ORDER BY ingested_at DESC NULLS LAST, raw DESC NULLS LAST) = 1)"
_EDITS = f"""(WITH v AS (SELECT session_file, line_no, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM {_LINES} WHERE regexp_matches(raw, '^\\s*\\{{')),
c AS (SELECT session_file, line_no, v, last_value(json_extract_string(v, '$.cwd') IGNORE NULLS) OVER (PARTITION BY session_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS cwd FROM v),
i AS (SELECT session_file, line_no, cwd, unnest(from_json(v->'$.message.content', '["JSON"]')) AS c, generate_subscripts(from_json(v->'$.message.content', '["JSON"]'), 1) - 1 AS pos FROM c WHERE json_type(v, '$.message.content') = 'ARRAY'),
t AS (SELECT session_file, line_no, pos, cwd, c->>'$.name' AS name, c->>'$.arguments.path' AS path FROM i WHERE json_type(c) = 'OBJECT' AND c->>'$.type' = 'toolCall')
SELECT session_file, line_no::BIGINT AS line_no, pos::BIGINT AS pos, cwd, CASE WHEN starts_with(path, '/') THEN path ELSE cwd || '/' || path END AS path
FROM t WHERE name IN ('write', 'edit', 'hashline_edit') AND path IS NOT NULL)"""

_STRIP = "trim({}, chr(32) || chr(9))"
_REFS = f"""(SELECT tbl, path, src, target, relation, strftime(min(committed_at), '%Y-%m-%d') AS period FROM (
SELECT 'owned_edges' AS tbl, path, src, {_STRIP.format("dst")} AS target, relation, committed_at FROM owned_edges
UNION ALL SELECT 'pending_edges', path, src, {_STRIP.format("dst_symbol")}, relation, committed_at FROM pending_edges
UNION ALL SELECT 'owned_nodes', path, node_id, lower({_STRIP.format("sink_id")}), '', committed_at FROM owned_nodes WHERE {_STRIP.format("sink_id")} <> '') GROUP BY ALL)"""
_PARENTS = f"""(SELECT tbl, key, strftime(min(since0), '%Y-%m-%d') AS since FROM (
SELECT 'owned_edges' AS tbl, node_id AS key, CASE WHEN path IN (SELECT path FROM {_CURRENT} WHERE state = 'present') THEN committed_at END AS since0 FROM owned_nodes
UNION ALL SELECT 'pending_edges', symbol, CASE WHEN path IN (SELECT path FROM {_CURRENT} WHERE state = 'present') THEN committed_at END FROM owned_nodes
UNION ALL SELECT 'owned_nodes', lower(hex(id)), CASE WHEN state = 0 THEN make_timestamp(created_at * 1000000) END FROM nodes) WHERE key IS NOT NULL GROUP BY tbl, key)"""
_ORPHANS = f"""(SELECT * FROM (SELECT r.tbl, r.period, r.path, r.src, r.target, r.relation,
CASE WHEN p.key IS NULL THEN 'missing' WHEN p.since IS NULL THEN 'deleted' WHEN p.since > r.period THEN 'late' END AS status
FROM {_REFS} r LEFT JOIN {_PARENTS} p ON r.tbl = p.tbl AND r.target = p.key) WHERE status IS NOT NULL)"""



def _moved(text: str, old: str, new: str) -> str:
    return f"left(replace(replace({text} || ' ', {old} || '/', {new} || '/'), {old} || ' ', {new} || ' '), -1)"


def _rel(path: str) -> str:
    return f"regexp_replace({path}, '^/home/[^/]+/', '')"


_REBUILT = f"(SELECT n.id_hex, n.title, n.body, m.path AS old, m.new_path AS new FROM {_NOTES} n JOIN {_OUTCOMES} m ON n.id_hex = m.id_hex WHERE m.outcome = 'REBUILT')"
_QUOTED = "'\"((?:/|~/)[^\"\\\\]+)\"'"
_COMMAND = "'\"([^\"]*/[^\"]*)\"|''([^'']*/[^'']*)''|([~/][a-zA-Z0-9_\\-./]+)'"
_COVERED = f"(SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(lower(coalesce(body, '')), x)))::DOUBLE / len(t) ELSE 0 END AS c FROM (SELECT id_hex, title, body, {_tokens('title')} AS t FROM {_NOTES}))"
_VERIFIED = f"""WITH notes_ AS {_NOTES}, texts_ AS {_TEXTS}, asked_ AS {_ASKED}, live_ AS {_LIVE},
l AS (SELECT query_id, doc_id AS id_hex, score FROM {_bm25('texts_', 'asked_', 25)}),
h AS (SELECT l.*, n.title, n.body, contains(lower(coalesce(title, '')), 'unclassified') OR contains(lower(coalesce(title, '')), 'auto-sync') AS junk FROM l JOIN notes_ n USING (id_hex)),
j AS (SELECT * FROM h QUALIFY NOT junk OR NOT bool_or(NOT junk) OVER (PARTITION BY query_id)),
f AS (SELECT * FROM j QUALIFY abs(score) >= 0.3 * max(abs(score)) OVER (PARTITION BY query_id)),
k AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id_hex) AS ord, {_tokens('a.text')} AS t FROM f JOIN asked_ a USING (query_id) QUALIFY ord <= 12),
p AS (SELECT id_hex, path, pos, path IN (SELECT path FROM live_) AS alive FROM {_NAMED}),
b AS (SELECT id_hex, arg_min(path, (NOT alive, pos)) AS path, bool_or(alive) AS alive FROM p GROUP BY id_hex),
o AS (SELECT path, lower(string_agg(DISTINCT symbol, chr(10))) AS content, sum(octet_length(encode(symbol))) AS size FROM (SELECT DISTINCT path, symbol FROM owned_nodes WHERE symbol IS NOT NULL) GROUP BY path),
m AS (SELECT k.*, b.path, coalesce(b.alive, false) AS alive, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS hay, CASE WHEN o.size <= 262144 AND len(t) > 0 THEN o.content END AS content FROM k LEFT JOIN b USING (id_hex) LEFT JOIN o ON b.alive AND o.path = b.path),
c AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(hay, x)))::DOUBLE / len(t) ELSE 0 END AS cov, CASE WHEN content IS NOT NULL THEN len(list_filter(t, lambda x: contains(content, x)))::DOUBLE / len(t) END AS con FROM m),
v AS (SELECT *, CASE WHEN alive THEN CASE WHEN coalesce(con, cov) >= 0.5 THEN 'STRONG' ELSE 'WEAK' END WHEN path IS NOT NULL THEN 'STALE' ELSE 'NOPATH' END AS verdict FROM c),
d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(nullif(path, ''), title) ORDER BY contains(lower(coalesce(title, '')), 'edited'), ord) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['STRONG', 'WEAK', 'STALE', 'NOPATH'], verdict), ord) AS rnk, id_hex, verdict, path, title, score,
floor(cov * 100)::BIGINT AS cov_pct, floor(con * 100)::BIGINT AS content_pct FROM d QUALIFY rnk <= 6"""


SQL: dict[str, str] = {
    "content_hash": "SELECT '/home/u/' || coalesce(source, 'none') || '/d' || doc_id || (['.py', '.md', '.ts', '.yaml', '.go', '.bin'])[doc_id % 6 + 1] AS path, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL",
    "node_ids": "SELECT DISTINCT path, substr(sha256(path), 1, 12) AS ns, substr(sha256(path), 1, 12) || ':__file__' AS node_id FROM paths",
    "language_of": f"SELECT {_LANGUAGE} AS language, {_EXT} IN ({', '.join(map(repr, EXTRACTED))}) AS extracted, count(*) AS n FROM {_CURRENT} GROUP BY 1, 2",
    "depth_for": f"SELECT path, {_depth('symbol')[0]} AS requested, {_depth('symbol')[1]} AS effective, {_depth('symbol')[0]} = 'graph' AS clamped FROM (SELECT DISTINCT path FROM paths)",
    "skip_filter": "SELECT DISTINCT path, (NOT starts_with(path, '/') OR starts_with(path, '/tmp/') OR starts_with(path, '/private/tmp/') OR starts_with(path, '/home/dev/.') OR starts_with(path, '/home/dev/Library/') "
    "OR regexp_matches(path, '/(node_modules|\\.git|__pycache__|\\.venv|venv|dist|build|DerivedData|Pods|\\.build)/')) AS skip FROM paths",
    "line_parse": "SELECT kind, CASE WHEN kind = 'file' THEN NULL ELSE line END AS line, count(*) AS n FROM owned_nodes GROUP BY 1, 2",
    "rendered_nodes": f"SELECT node_id, CASE WHEN kind = 'file' THEN path ELSE coalesce(label, symbol) || ' — ' || CASE WHEN coalesce(line, 0) <> 0 THEN path || ':' || line ELSE path END END AS title, "
    f"CASE WHEN kind = 'file' THEN path || ' — ' || {_LANGUAGE} ELSE coalesce(label, symbol) || ' defined at ' || CASE WHEN coalesce(line, 0) <> 0 THEN path || ':' || line ELSE path END END AS body, "
    f"CASE WHEN kind = 'file' THEN 'index,file,' || {_LANGUAGE} ELSE 'index,symbol' END AS keywords FROM {_OWNED}",
    "hint_collapse": f"SELECT * FROM {_COLLAPSED}",
    "queue_batch": f"SELECT * FROM {_COLLAPSED} ORDER BY enqueued_at, path LIMIT 256",
    "reconcile_actions": f"SELECT * FROM {_ACTIONS}",
    "action_tally": f"SELECT action, count(*) AS n FROM {_ACTIONS} GROUP BY action",
    "aba_split": "SELECT path, generation, CASE WHEN generation = max(generation) OVER (PARTITION BY path) THEN 'committed' ELSE 'stale' END AS outcome FROM paths",
    "ownership_replace": f"WITH late AS (SELECT path FROM owned_nodes GROUP BY path HAVING max(committed_at) > min(committed_at)) SELECT node_id, path, line, label FROM {_FIRST} WHERE path NOT IN (SELECT path FROM late) "
    f"UNION ALL SELECT node_id, path, line, label FROM {_OWNED} WHERE path IN (SELECT path FROM late)",
    "desired_diff": f"SELECT coalesce(p.node_id, d.node_id) AS node_id, CASE WHEN p.node_id IS NULL THEN 'insert' WHEN d.node_id IS NULL THEN 'delete' WHEN p.line IS NOT DISTINCT FROM d.line AND p.label IS NOT DISTINCT FROM d.label THEN 'keep' ELSE 'reproject' END AS change "
    f"FROM {_FIRST} p FULL JOIN {_OWNED} d ON p.node_id = d.node_id",
    "index_stats": f"SELECT count(*) FILTER (state = 'present') AS present, count(*) FILTER (state = 'absent') AS absent, (SELECT count(DISTINCT node_id) FROM owned_nodes) AS nodes, "
    f"(SELECT count(*) FROM (SELECT DISTINCT path, src, dst, relation FROM owned_edges)) AS edges, (SELECT count(*) FROM {_WAITING}) AS pending, (SELECT count(*) FROM {_COLLAPSED}) AS queued FROM {_CURRENT}",
    "edges_resolved": f"SELECT w.path, w.src, s.dst, w.relation, w.line FROM {_WAITING} w JOIN {_SYMBOLS} s ON w.symbol = s.symbol",
    "edges_pending": f"SELECT w.* FROM {_WAITING} w LEFT JOIN {_SYMBOLS} s ON w.symbol = s.symbol WHERE s.dst IS NULL",
    "pending_union": f"WITH dirty AS (SELECT DISTINCT path FROM paths WHERE generation > 3) SELECT * FROM {_WAITING} WHERE path IN (SELECT path FROM dirty) "
    "OR symbol IN (SELECT symbol FROM owned_nodes WHERE kind = 'symbol' AND path IN (SELECT path FROM dirty) AND symbol IS NOT NULL)",
    "edge_places": "SELECT relation, CASE WHEN n.node_id IS NULL THEN 'remote' ELSE 'local' END AS place, count(*) AS n FROM (SELECT DISTINCT path, src, dst, relation FROM owned_edges) e "
    "LEFT JOIN (SELECT DISTINCT path, node_id FROM owned_nodes) n ON e.path = n.path AND e.dst = n.node_id GROUP BY 1, 2",
    "audit_shallow": _drift(False),
    "audit_deep": _drift(True),
    "drift_counts": f"SELECT why, count(*) AS n FROM ({_drift(True)}) GROUP BY why",
    "query_tokens": f"SELECT id_hex, len(t)::BIGINT AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT id_hex, {_tokens('title')} AS t FROM {_NOTES})",
    "coverage": f"SELECT id_hex, round(c, 6) AS cov, v AS verdict, floor(c * 100)::BIGINT AS pct, printf('[%-6s] cov%02d%% %s', v, floor(c * 100)::BIGINT, coalesce(title, 'null')) AS line FROM (SELECT *, "
    f"CASE WHEN alive THEN CASE WHEN c >= 0.5 THEN 'STRONG' ELSE 'WEAK' END WHEN alive IS NOT NULL THEN 'STALE' ELSE 'NOPATH' END AS v FROM {_COVERED} LEFT JOIN (SELECT id_hex, bool_or(alive) AS alive FROM {_MENTIONS} GROUP BY 1) USING (id_hex))",
    "verified_search": _VERIFIED,
    "bm25_topk": f"SELECT * FROM {_BM25}",
    "score_floor": f"SELECT * FROM {_BM25} QUALIFY abs(score) >= 0.9 * max(abs(score)) OVER (PARTITION BY query_id)",
    "cosine_topk": f"SELECT * FROM {_COSINE}",
    "fused_gate": f"SELECT query_id, doc_id, fused, {_FUSED} AS class FROM {_MEASURED}",
    "rrf_topk": f"SELECT query_id, doc_id, score, rank FROM {_MEASURED}",
    "junk_filter": f"SELECT id_hex, title, score FROM {_HITS} WHERE NOT (contains(lower(coalesce(title, '')), 'note on') OR contains(lower(coalesce(title, '')), 'orphaned')) "
    f"OR NOT EXISTS (SELECT 1 FROM {_HITS} WHERE NOT (contains(lower(coalesce(title, '')), 'note on') OR contains(lower(coalesce(title, '')), 'orphaned')))",
    "dedup_hits": f"SELECT id_hex, title, path, score FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(path, ''), title) ORDER BY contains(lower(coalesce(title, '')), 'edited'), score DESC, id_hex) = 1",
    "beam_walk": """WITH e AS (SELECT DISTINCT src, dst, relation FROM owned_edges), s AS (SELECT DISTINCT node_id AS start FROM owned_nodes WHERE kind = 'file'),
a0 AS (SELECT start, dst AS node, count(*) AS weight FROM s JOIN e ON s.start = e.src WHERE dst <> start GROUP BY 1, 2),
a AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, node) <= 6),
b0 AS (SELECT a.start AS start, dst AS node, count(*) AS weight FROM a JOIN e ON a.node = e.src WHERE dst <> a.start AND NOT EXISTS (SELECT 1 FROM a x WHERE x.start = a.start AND x.node = dst) GROUP BY 1, 2),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, node) <= 6)
SELECT start, 1::BIGINT AS hop, node, weight FROM a UNION ALL SELECT start, 2, node, weight FROM b""",
    "stale_candidates": f"SELECT * FROM {_CANDIDATES}",
    "rehome_outcome": f"SELECT * FROM {_OUTCOMES}",
    "rehome_rewrite": f"SELECT id_hex, {_moved(_moved('title', _rel('old'), _rel('new')), 'old', 'new')} AS title, {_moved('body', 'old', 'new')} AS body FROM {_REBUILT}",
    "sweep_totals": f"SELECT (SELECT count(*) FROM {_NOTES}) AS total, count(*) AS stale, count(*) FILTER (outcome = 'REBUILT') AS rebuilt, count(*) FILTER (outcome <> 'REBUILT') AS removed, count(*) FILTER (outcome = 'AMBIGUOUS') AS ambiguous FROM {_OUTCOMES}",
    "seed_replace": f"WITH f AS (SELECT DISTINCT path AS title, regexp_extract(path, '([^/]*)$', 1) AS b FROM owned_nodes WHERE kind = 'file' AND path IN {_LIVE}) SELECT title, body FROM {_NOTES} n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.title = n.title) "
    "UNION ALL SELECT title, CASE WHEN contains(b, '_') THEN b || ' ' || replace(b, '_', ' ') ELSE b END FROM f",
    "node_dump": f"SELECT id_hex, title, array_to_string(list_sort({_tokens('title')}), ',') AS keywords FROM {_NOTES}",
    "session_edits": f"SELECT * FROM {_EDITS}",
    "edit_paths": f"SELECT path, count(*) AS edits FROM {_EDITS} WHERE path IS NOT NULL GROUP BY path",
    "usage_count": "SELECT strftime(ingested_at, '%Y-%m-%d') AS day, CAST(coalesce(sum(len(regexp_extract_all(raw, '\"name\": ?\"kb_(search|insert|sync)\"'))), 0) AS BIGINT) AS calls FROM session_logs GROUP BY 1",
    "guard_chain": f"SELECT session, event_id, chain, class = 'grep' AND chain >= 3 AS warn FROM {_CHAIN}",
    "guard_warnings": f"SELECT session, count(*) FILTER (class = 'grep' AND chain >= 3) AS warnings, max(chain) AS longest FROM {_CHAIN} GROUP BY session",
    "first_prompt": "SELECT user_id AS session, event_id, event_type || ' ' || props AS text FROM events WHERE event_type NOT IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "telemetry_rollup": f"SELECT * FROM {_SHOTS}",
    "telemetry_trend": f"SELECT first_nodes, last_nodes, days, last_nodes - first_nodes AS delta, CAST(round((last_nodes - first_nodes)::DOUBLE / days) AS BIGINT) AS per_day FROM (SELECT arg_min(nodes, day) AS first_nodes, arg_max(nodes, day) AS last_nodes, greatest(date_diff('day', min(day)::DATE, max(day)::DATE), 1) AS days FROM {_SHOTS})",
    "tail_snapshots": f"SELECT * FROM {_SHOTS} ORDER BY day DESC LIMIT 14",
    "hit_rate": "SELECT day, coalesce(round(s::DOUBLE / nullif(s + w + m, 0), 3), 0) AS rate FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS s, count(*) FILTER (event_type = 'view') AS w, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY 1)",
    "p50_values": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, count(value) AS n FROM events GROUP BY event_type",
    "answer_classes": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS strong, count(*) FILTER (event_type = 'view') AS weak, count(*) FILTER (event_type = 'error') AS miss FROM events GROUP BY 1",
    "orient_hits": f"""WITH best AS (SELECT * FROM {_HITS} WHERE path IN {_LIVE} ORDER BY score DESC, id_hex LIMIT 3), e AS (SELECT DISTINCT src, dst, relation FROM owned_edges),
s AS (SELECT left(sha256(path), 12) || ':__file__' AS start, max(score) AS score FROM best WHERE path IS NOT NULL GROUP BY 1),
a0 AS (SELECT start, dst AS node, count(*) AS weight FROM s JOIN e ON s.start = e.src WHERE dst <> start GROUP BY 1, 2),
a AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, node) <= 4),
b0 AS (SELECT a.start AS start, dst AS node, count(*) AS weight FROM a JOIN e ON a.node = e.src WHERE dst <> a.start AND NOT EXISTS (SELECT 1 FROM a x WHERE x.start = a.start AND x.node = dst) GROUP BY 1, 2),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, node) <= 4),
w AS (SELECT start, node, 1 AS hop FROM a UNION ALL SELECT start, node, 2 FROM b),
t AS (SELECT node_id, coalesce(label, symbol) AS title FROM owned_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY path NULLS FIRST, committed_at NULLS FIRST, line NULLS FIRST, label NULLS FIRST) = 1),
u AS (SELECT id_hex, title, 0 AS src, score FROM best UNION ALL SELECT t.node_id, t.title, 1, max(s.score / (hop + 1)) FROM w JOIN s USING (start) JOIN t ON w.node = t.node_id GROUP BY 1, 2),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY split_part(title, ' [', 1) ORDER BY src, score DESC, id_hex) = 1)
SELECT id_hex, title, src::BIGINT AS src, round(score, 6) AS score FROM o ORDER BY src, score DESC, id_hex LIMIT 6""",
    "tumbling_windows": "SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_windows": "WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) "
    "SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL '6 hours') AS \"end\", count(*) AS n FROM g GROUP BY user_id, s",
    "p5_found": f"SELECT tbl, period, path, src, target, relation FROM {_ORPHANS}",
    "p5_report": f"SELECT tbl, period, status, count(*) AS refs, count(DISTINCT target) AS targets FROM {_ORPHANS} GROUP BY 1, 2, 3",
    "path_order": f"SELECT path, state, generation FROM {_CURRENT} ORDER BY path",
    "dirty_lookup": f"SELECT path, state, generation, (SELECT count(DISTINCT node_id) FROM owned_nodes n WHERE n.path = c.path) AS nodes, (SELECT count(DISTINCT (src, dst, relation)) FROM owned_edges e WHERE e.path = c.path) AS edges, "
    f"(SELECT count(DISTINCT (src, dst_symbol, relation)) FROM pending_edges w WHERE w.path = c.path) AS pending FROM {_CURRENT} c WHERE generation > 3",
    "bootstrap_scan": f"SELECT path, 'scan' AS reason FROM {_LIVE} WHERE NOT (starts_with(path, '/tmp/') OR starts_with(path, '/private/tmp/') OR starts_with(path, '/home/dev/.') OR starts_with(path, '/home/dev/Library/') "
    "OR regexp_matches(path, '/(node_modules|\\.git|__pycache__|\\.venv|venv|dist|build|DerivedData|Pods|\\.build)/'))",
    "audit_queue": f"SELECT path, 'audit:' || arg_min(why, starts_with(why, 'depth')) AS reason, count(*) AS generation FROM ({_drift(False)}) GROUP BY path",
    "drain_outcomes": f"SELECT path, CASE WHEN action NOT IN ('retracted', 'absent') AND reconciled_at IS NULL THEN 'error' WHEN action IN ('indexed', 'updated') THEN 'deferred' WHEN generation % 3 = 0 AND action <> 'unchanged' THEN 'stale' ELSE action END AS action "
    f"FROM {_ACTIONS} JOIN {_CURRENT} c USING (path)",
    "strict_gate": f"SELECT query_id, doc_id, vec, CASE WHEN (lex >= best AND coalesce(vec, 0) >= 0.7) OR (lex >= best - 0.015 AND coalesce(vec, 0) >= 0.75) THEN 'strong' WHEN lex >= best OR coalesce(vec, 0) >= 0.75 THEN 'weak' ELSE 'miss' END AS class FROM {_MEASURED}",
    "cache_gate": f"SELECT CASE WHEN lex < 0.05 THEN 'miss' WHEN lex >= 0.15 AND coalesce(vec, 0) >= 0.75 THEN 'strong' WHEN lex >= 0.15 OR coalesce(vec, 0) >= 0.75 THEN 'weak' ELSE 'miss' END AS class, count(*) AS n FROM {_MEASURED} GROUP BY 1",
    "top1_query": f"SELECT query_id, doc_id, {_FUSED} AS class, printf('%s [%.2f]', doc_id, fused) AS line FROM {_MEASURED} WHERE rank = 1 AND fused >= 0.42",
    "note_paths": f"SELECT id_hex, pos, path, alive FROM {_MENTIONS}",
    "rehome_replaced": f"SELECT n.id_hex, m.rebuilt_hex FROM {_NOTES} n JOIN (SELECT {_rel('new')} AS rel, min(id_hex) AS rebuilt_hex FROM {_REBUILT} GROUP BY 1) m ON starts_with(n.title, m.rel || ' — edited ') WHERE n.id_hex <> m.rebuilt_hex",
    "removal_log": f"SELECT id_hex, CASE WHEN outcome = 'REBUILT' THEN path || ' -> ' || new_path ELSE path END AS path, outcome, CASE WHEN outcome <> 'REBUILT' THEN title END AS title, CASE WHEN outcome <> 'REBUILT' THEN replace(coalesce(body, ''), chr(10), ' ⏎ ') END AS body FROM {_NOTES} JOIN {_OUTCOMES} USING (id_hex)",
    "hint_paths": f"SELECT CASE WHEN starts_with(p, '~/') THEN '/home/dev' || substr(p, 2) ELSE p END AS path, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(raw, {_QUOTED}, 1), lambda x: CASE WHEN starts_with(x, '~/') THEN '/home/dev' || substr(x, 2) ELSE x END))) AS p FROM session_logs) GROUP BY 1",
    "command_paths": f"SELECT p AS path, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(list_zip(regexp_extract_all(text, {_COMMAND}, 1), regexp_extract_all(text, {_COMMAND}, 2), regexp_extract_all(text, {_COMMAND}, 3)), "
    "lambda x: CASE WHEN starts_with(concat(x[1], x[2], x[3]), '~/') THEN '/home/dev' || substr(concat(x[1], x[2], x[3]), 2) ELSE concat(x[1], x[2], x[3]) END), lambda x: starts_with(x, '/')))) AS p FROM documents) GROUP BY 1",
    "reply_ids": "SELECT sink_id AS id, count(*) AS n FROM owned_nodes WHERE regexp_matches(sink_id, '^[0-9a-fA-F]{16,}$') OR (kind = 'file' AND sink_id IS NOT NULL) GROUP BY 1",
    "selftest_paths": "SELECT path, count(*) AS n FROM owned_nodes GROUP BY path",
    "saved_hours": "SELECT day, round(s / 3600, 1) AS hours, CASE WHEN last = 0 THEN -1 ELSE (now - last) // 3600 END AS age FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS s, max(epoch_us(ts) // 1000000) AS now, coalesce(max(epoch_us(ts) // 1000000) FILTER (event_type = 'purchase'), 0) AS last FROM events GROUP BY 1)",
}
