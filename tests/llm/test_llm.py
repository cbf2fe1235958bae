import json
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import bpe, canonical, catalog, garbled, knn, neardup, packing

TOKENIZERS = bpe.TOKENIZERS
needs_files = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files here")


def groups(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {(find(i), i) for i in ids if find(i) != i}


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


# 1


def exact(ids, x, k=10, least=0.85):
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in best}
    return out


def usable(rows):
    return {bytes(r[0]).hex(): r[1] for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 64 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])}


def test_pairs_on_the_table(spark, sf):
    t = spark.read.parquet(f"{sf}/node_vec.parquet")
    ok = usable(t.collect())
    ids = sorted(ok)
    want = exact(ids, [ok[i] for i in ids])
    got = pairs(catalog.p1_found(spark, sf), "id_a", "id_b")
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.03 * len(want)


def test_copies_scaled_and_broken_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(64)
    rows = [(i.to_bytes(8, "big"), (base * 2 ** (i % 3)).astype(np.float32).tolist()) for i in range(40)]  # a hot group of copies
    rows += [((100 + i).to_bytes(8, "big"), (base + 0.2 * r.standard_normal(64)).astype(np.float32).tolist()) for i in range(30)]
    rows += [((200 + i).to_bytes(8, "big"), r.standard_normal(64).astype(np.float32).tolist()) for i in range(10)]
    bad = [(b"\x01" * 8, None), (b"\x02" * 8, []), (b"\x03" * 8, [0.0] * 64), (b"\x04" * 8, [float("nan")] * 64), (b"\x05" * 8, [1.0] * 63), (None, [1.0] * 64), (b"\x06" * 8, [None] * 64)]
    t = spark.createDataFrame(rows + rows[:5] + bad, "id binary, embedding array<float>").withColumn("u", F.lit("clash"))
    ok = usable(rows)
    ids = sorted(ok)
    assert pairs(knn.nearest_pairs(t), "id_a", "id_b") == exact(ids, [ok[i] for i in ids])
    assert knn.nearest_pairs(t.limit(0)).count() == 0


def test_graph_search_finds_the_nearest(spark, sf):
    t = spark.read.parquet(f"{sf}/node_vec.parquet")
    ok = usable(t.collect())
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in knn.search(t).collect():
        got.setdefault(r.id_hex, []).append(r.cosine)
    asked = [i for i in ids if int(i, 16) % 20 == 0]
    hit = total = 0
    for q in asked:
        s = np.unique(np.round(x @ x[ids.index(q)], 6))[::-1]
        want = [v for v in s if v < 0.999999][:5]
        want = [v for v in want if v >= 0.85]
        have = np.round(got.get(q, []), 6)
        hit += sum(np.isclose(have, v, atol=2e-6).any() for v in want)
        total += len(want)
    assert hit >= 0.9 * total


def test_graph_search_has_no_lowest_cosine(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 64)).astype(np.float32)  # hardly any cosine of 0.6
    x[1:15] = x[0]  # copies are ids of their own
    rows = [(i.to_bytes(8, "big"), v.tolist()) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "id binary, embedding array<float>")
    got = {}
    for row in knn.search(t).collect():
        got.setdefault(int(row.id_hex, 16), []).append(int(row.other_hex, 16))
    assert set(got) == set(range(0, 1500, 20)) and all(len(v) == len(set(v)) == 10 for v in got.values())
    assert sorted(got[0]) == list(range(1, 11))
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hit = 0
    for q, have in got.items():
        s = np.round(x @ x[q], 9)
        s[q] = -2
        hit += len(set(np.lexsort((np.arange(1500), -s))[:10].tolist()) & set(have))
    assert hit >= 0.9 * 10 * len(got)


# 2 and 4


def words(t, b):
    return frozenset(re.findall(r"[^\W_]+", f"{t or ''} {b or ''}".lower()))


def test_near_duplicates_on_the_table(spark, sf):
    rows = {bytes(r.id).hex(): words(r.title, r.body) for r in spark.read.parquet(f"{sf}/nodes.parquet").collect()}
    ok = {i: w for i, w in rows.items() if len(w) >= 20}
    ids = sorted(ok)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(ok[a] & ok[b]) >= 0.7 * len(ok[a] | ok[b]) - 1e-9]
    assert pairs(catalog.p2_found(spark, sf), "rep_hex", "id_hex") == groups(links, ids)


def test_near_duplicates_in_hot_buckets(spark):
    r = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    rows = [(i.to_bytes(8, "big"), "t", " ".join(base)) for i in range(300)]  # copies
    for i in range(300, 700):  # small edits of one text
        w = base[:]
        for _ in range(3):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        r.shuffle(w)
        rows.append((i.to_bytes(8, "big"), None, " ".join(w)))
    rows += [((9000 + i).to_bytes(8, "big"), "few", "words only") for i in range(3)] + [(b"\xff" * 8, None, None), (None, "a", "b"), (b"\xfe" * 8, "", " ".join(f"solo{i}" for i in range(5000)))]
    t = spark.createDataFrame(rows + rows[:2], "id binary, title string, body string").withColumn("set_id", F.lit("clash"))
    got = pairs(neardup.near_duplicates(t), "id_hex", "group_hex")
    assert got == {(i.to_bytes(8, "big").hex(), (0).to_bytes(8, "big").hex()) for i in range(700)}
    assert neardup.near_duplicates(t.limit(0)).count() == 0


def test_banding_recall():
    r = np.random.default_rng(2)
    n, hits = 400, 0
    values, offsets = [], [0]
    for _ in range(n):  # pairs of similarity 0.7: 70 of 100 words
        common, a, b = r.integers(0, 2**63, 70), r.integers(0, 2**63, 15), r.integers(0, 2**63, 15)
        for own in (a, b):
            values.append(np.concatenate([common, own]))
            offsets.append(offsets[-1] + 85)
    m = neardup.minima(np.concatenate(values), np.array(offsets), neardup.BANDS * neardup.ROWS)
    bands = m.reshape(neardup.BANDS, neardup.ROWS, -1)
    hits = (bands[:, :, 0::2] == bands[:, :, 1::2]).all(axis=1).any(axis=0).mean()
    assert hits >= 0.97


def test_partners_among_many_rivals_of_one_template(spark, monkeypatch):
    r = random.Random(11)
    core = [f"core{i}" for i in range(79)]  # 79 of 100 words: any two at 0.65
    ids = [f"{i:016x}" for i in range(500)]
    own = [[f"w{i}x{k}" for k in range(21)] for i in range(460)]
    for i in range(40):  # partners at 0.7 to 0.8
        same = r.randrange(5, 10)
        own.append(own[i][:same] + [f"p{i}x{k}" for k in range(21 - same)])
    w = [frozenset(core + x) for x in own]
    links = [(ids[i], ids[460 + i]) for i in range(40)]
    assert all(len(w[a] & w[b]) < 0.7 * len(w[a] | w[b]) for a in range(500) for b in range(a) if a - b != 460)
    assert all(0.7 <= len(w[i] & w[460 + i]) / len(w[i] | w[460 + i]) <= 0.8 for i in range(40))
    rows = [(bytes.fromhex(ids[i]), "", " ".join(sorted(x))) for i, x in enumerate(w)]
    r.shuffle(rows)
    t = spark.createDataFrame(rows, "id binary, title string, body string")
    for block in (2048, 64):  # within a block, and block against block
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {p for p in pairs(neardup.near_duplicates(t), "group_hex", "id_hex") if p[0] != p[1]}
        assert got <= groups(links, ids)
        assert len(got) >= 39  # each is missed by the bands with a probability of 0.007 at most


def test_a_long_bucket_is_met_in_parts(spark, monkeypatch):
    """Alike records far apart in the order of a bucket that is longer than what a task meets at first: all groups come out."""
    monkeypatch.setattr(neardup, "HOT", 64)  # so that the sample is all
    monkeypatch.setattr(neardup, "BLOCK", 256)
    r = random.Random(3)
    core = [f"core{i}" for i in range(82)]  # 82 of 100 words: any two of different families below 0.7
    rows, groups_, n = [], {}, 0
    for fam in range(300):
        own = [f"f{fam}x{k}" for k in range(18)]
        for _ in range(2):
            w = core + own[:16] + [f"u{n}a", f"u{n}b"]
            r.shuffle(w)
            rows.append((n.to_bytes(8, "big"), "", " ".join(w)))
            groups_.setdefault(fam, []).append(n.to_bytes(8, "big").hex())
            n += 1
    r.shuffle(rows)
    got = pairs(neardup.near_duplicates(spark.createDataFrame(rows, "id binary, title string, body string")), "group_hex", "id_hex")
    assert {(min(g), i) for g in groups_.values() for i in g} == got


def test_a_set_signed_by_several_tasks_counts_once_in_a_bucket():
    import pyarrow as pa

    def links(rows, cut):
        columns = list(zip(*rows, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "set_id", "low", "high"])
        out = [r for b in neardup.bucket_links(iter([batch.slice(0, cut), batch.slice(cut)])) for r in b.to_pylist()]
        return sorted((r["a"], r["b"]) for r in out if r["key"] is None), [r for r in out if r["key"] is not None]

    rows = [(1, 10, 0, 7), *[(1, 20, 1, 7)] * 12, (1, 30, 2, 7)]  # 20 was signed by 12 tasks and would fill all the links of 30
    for cut in (0, 5, 13):
        assert links(rows, cut) == ([(10, 20), (10, 30), (20, 30)], [])


def bare(x):
    return "".join(c for c in x.lower() if unicodedata.category(c)[0] in "LN")


FORMS = [
    "owner: Ann Lee\nqueue: A-1\nlast seen: 3 days", "- Owner: ann lee\n- Last Seen : 3 Days\n- Queue: a1", "queue=A1; owner=Ann  Lee; last seen=3 days", "last seen: 3-days | owner: annlee | queue: a 1",
    '{"owner": "Ann Lee", "queue": "A1", "last seen": "3 days"}',
]


def test_forms_of_fields_are_copies(spark):
    t = spark.createDataFrame([(bytes([i]) * 8, "Title!", b, 100 - i) for i, b in enumerate(FORMS)], "id binary, title string, body string, created_at long")
    book = canonical.ledger_of(t)
    assert pairs(canonical.copies(book), "rep_hex", "id_hex") == {("00" * 8, f"{i:02x}" * 8) for i in range(1, 5)}
    assert [(r.copies, r.first_seen) for r in book.counts().collect()] == [(5, 96)]


def test_what_is_no_copy(spark):
    rows = ["a: 1\nb: 2", "b: 2\na: 1", "a: 1\nb: 2\nc: 3", "a: 1\nb: 2\nc: 4", '{"a": {"b": 1}}', '{"a": [1]}', None, "", "x" * 100_000, "X" * 100_000]
    t = spark.createDataFrame([(bytes([i]) * 8, None, b, None) for i, b in enumerate(rows)] + [(None, "t", "b", 1)], "id binary, title string, body string, created_at long").withColumn("key", F.lit("clash"))
    assert pairs(canonical.copies(canonical.ledger_of(t)), "rep_hex", "id_hex") == {("06" * 8, "07" * 8), ("08" * 8, "09" * 8)}
    assert canonical.copies(canonical.ledger_of(t.limit(0))).count() == 0


def test_ledger_takes_batches_in_any_cut(spark):
    r = random.Random(7)
    rows = [(i.to_bytes(8, "big"), f"T{r.randrange(20)}", "same" if i % 3 else f"b{i % 5}", r.randrange(1000)) for i in range(200)]
    t = spark.createDataFrame(rows + rows[:30], "id binary, title string, body string, created_at long")
    want = pairs(canonical.ledger_of(t, 1).counts(), "key", "copies", "rep_hex", "first_seen")
    assert pairs(canonical.ledger_of(t, 4).counts(), "key", "copies", "rep_hex", "first_seen") == want
    book = canonical.Ledger(spark)
    keys = canonical.canonical_keys(t)
    book.add(keys)
    at = book.counts().inputFiles()
    book.add(keys)  # a redelivered batch changes nothing
    assert book.counts().inputFiles() == at
    assert sum(r.copies for r in book.counts().collect()) == 200


def test_ledger_can_be_opened_again(spark, sf, tmp_path):
    """Batches taken in by different ledgers over one folder, after a broken attempt, count like one run."""
    t = spark.read.parquet(f"{sf}/nodes.parquet")
    columns = "key", "copies", "rep_hex", "earliest_hex", "first_seen"
    want = pairs(canonical.ledger_of(t, 1).counts(), *columns)
    keys = canonical.canonical_keys(t)
    part = lambda i: keys.filter(F.pmod(F.xxhash64("id_hex"), F.lit(3)) == i)
    for i in (2, 0):
        canonical.Ledger(spark, str(tmp_path)).add(part(i))
    broken = canonical.Ledger(spark, str(tmp_path))
    broken._write(keys.select("key", "id_hex", F.col("created_at").alias("first_seen")), "members", broken.batch + 1)
    canonical.Ledger(spark, str(tmp_path)).add(part(1).unionByName(part(0)))
    book = canonical.Ledger(spark, str(tmp_path))
    assert pairs(book.counts(), *columns) == want and book.members().count() == keys.select("id_hex").distinct().count()
    book.add(keys.limit(0))
    assert pairs(book.counts(), *columns) == want


def test_copies_on_the_table(spark, sf):
    rows = {bytes(r.id).hex(): (r.title or "", r.body or "") for r in spark.read.parquet(f"{sf}/nodes.parquet").collect()}

    def form(b):
        s = b.strip()
        if s.startswith("{"):
            try:
                o = json.loads(s)
                if isinstance(o, dict) and o and not any(isinstance(v, dict | list) for v in o.values()):
                    return "F" + "\1".join(sorted(f"{bare(k)}={bare(str(v))}" for k, v in o.items()))
            except ValueError:
                pass
        field = re.compile(r"^(?:-\s*)?([^:=]{1,40}?)\s*[:=](.*)$", re.S)
        for sep in ("\n", ";", "|"):
            parts = [p.strip() for p in b.replace("\r", "\n").split(sep) if p.strip()]
            if len(parts) >= 3 and all((m := field.match(p)) and len(m[1].split()) <= 3 for p in parts):
                return "F" + "\1".join(sorted(f"{bare(field.match(p)[1])}={bare(field.match(p)[2])}" for p in parts))
        return "T" + bare(b)

    by = {}
    for i, (t, b) in rows.items():
        by.setdefault((bare(t), form(b)), []).append(i)
    want = {(min(v), i) for v in by.values() for i in v if i != min(v)}
    assert pairs(catalog.p4_found(spark, sf), "rep_hex", "id_hex") == want


# 6 and 7

TEXTS = [
    "Hello world", "", None, "  two  blanks \n\n\ttab nbsp", "it's we'll I'VE", "naïve façade Größe", "日本語のテキスト", "👩‍💻🧭", "\u0000\u0001\x7f", "1234567 89", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "ab" * 400,
    "─" * 100, "<|endoftext|> is text", "Ünïcödé" * 30, "áé", "�﻿", "def f(x):\n        return x\n", "0" * 300 + "é" * 200,
]


@needs_files
def test_ids_and_round_trip(spark):
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    t = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for hot in (4, bpe.HOT):
        enc = bpe.encode(t, hot=hot)
        got = {r.doc_id: list(r.ids) for r in enc.collect()}
        assert got == {i: tk.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in bpe.decode(enc).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.tokens for r in bpe.token_counts(t).collect()} == {i: len(v) for i, v in got.items()}
    assert bpe.encode(t.limit(0)).count() == 0


@needs_files
def test_long_words(spark):
    """Words beyond the map, short, cut and in long parts, against the public library."""
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    r = np.random.default_rng(5)
    letters = lambda n, top: "".join(chr(97 + i) for i in r.integers(0, top, n))
    texts = [letters(n, top) for n in (1, 2, 7, 63, 64, 65, 130, 900, 4000) for top in (2, 26)]
    texts += ["".join(chr(c) for c in r.integers(0x4E00, 0x5E00, 900)), "=" * 6000, "aAaA" * 500, "é" * 65, "\u200d" * 100]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(t, hot=1).collect()}
    for i, x in enumerate(texts):
        assert got[i] == tk.encode(x, add_special_tokens=False).ids, x[:40]


@needs_files
def test_both_folds_agree(spark):
    w = spark.createDataFrame([(x,) for x in (" the", "kleandzom", "ÄÖÜß", "aaaaaaa", "ababababab", "…", "\n\n\n")], "w string")
    codes = F.transform(F.split(F.decode(F.col("w").cast("binary"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
    both = bpe.with_rank_map(lambda book: F.array(*(fold(book, F.transform(codes, lambda x: F.get(book, x))) for fold in (bpe._fold, bpe._fold_all))))
    for r in w.select("w", both.alias("x")).collect():
        assert r.x[0] == r.x[1], r.w


def check_packing(rows, sizes, capacity):
    by, parts = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by[r.container] = by.get(r.container, 0) + r.size
            assert r.size <= r.bucket <= capacity
    assert all(v <= capacity for v in by.values())
    for d, s in sizes.items():
        p = sorted(parts[d], key=lambda r: r.piece)
        assert sum(r.size for r in p) == (s or 0) and [r.start for r in p] == [i * capacity for i in range(len(p))]
        assert len(p) == max(1, -(-(s or 0) // capacity))
    return sum(by.values()) / (len(by) * capacity) if by else 1.0


def test_packing(spark):
    r = random.Random(9)
    sizes = {i: min(9000, int(r.lognormvariate(5.5, 1.1))) for i in range(3000)} | {5000: 0, 5001: None, 5002: 2048, 5003: 2049, 5004: 9000}
    t = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    rows = packing.pack(t, 2048).collect()
    assert check_packing(rows, sizes, 2048) > 0.95
    same = spark.createDataFrame([(i, 700) for i in range(200)], "doc_id long, tokens long")
    assert check_packing(packing.pack(same, 2048).collect(), dict.fromkeys(range(200), 700), 2048) > 0.65
    assert packing.pack(t.limit(0), 2048).count() == 0


def test_boundaries_are_optimal():
    r = np.random.default_rng(4)
    sizes, counts = np.arange(1, 13), r.integers(1, 50, 12)

    def padding(ends):
        at = np.searchsorted(ends, sizes)
        return int(((np.array(ends)[at] - sizes) * counts).sum())

    from itertools import combinations

    best = min(padding([*c, 12]) for c in combinations(range(1, 12), 3))
    assert padding(packing.boundaries(sizes, counts, 4)) == best


@needs_files
def test_table_is_packed_full(spark, sf):
    r = catalog.p7_report(spark, sf).first()
    assert r.fill > 0.9


# 8

CLEAN = {
    "de": "Für den Größten Schlüssel wurde die Änderung zurückgezogen, übergangsweise gehört er künftig überall.", "fr": "Même si le schéma paraît périmé, le réseau a été rejoué après l’échec déjà signalé.",
    "ru": "После запуска журнал показал новых ссылок, потому что указатель уже сломанный и ждёт проверки.", "pl": "Zażółcony węzeł świadczy, że źle policzył krawędzi, więc wciąż się nie zgadzał łącznik.",
    "ja": "次の監査までに履歴を検証する必要がある。経路を比べると差があった。",
}
GARBLE = {
    "utf8 as cp1252": ("de", lambda t: t.encode().decode("cp1252", "replace")), "utf8 as latin1": ("fr", lambda t: t.encode().decode("latin-1")), "utf8 as cp437": ("de", lambda t: t.encode().decode("cp437")),
    "utf8 as mac": ("fr", lambda t: t.encode().decode("mac_roman")), "utf8 as cp1251": ("de", lambda t: t.encode().decode("cp1251", "replace")), "twice": ("de", lambda t: t.encode().decode("latin-1").encode().decode("latin-1")),
    "cp1251 as cp1252": ("ru", lambda t: t.encode("cp1251").decode("cp1252")), "cp1250 as cp1252": ("pl", lambda t: t.encode("cp1250").decode("cp1252")), "koi8 as cp1251": ("ru", lambda t: t.encode("koi8_r").decode("cp1251")),
    "sjis as cp1252": ("ja", lambda t: "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode("cp932"))), "lost": ("de", lambda t: t.encode("latin-1").decode("utf-8", "replace")),
}


@pytest.fixture(scope="module")
def mixed(spark):
    rows, bad = [], {}
    for _ in range(30):
        rows += [(len(rows) + i, t) for i, t in enumerate(CLEAN.values())]
    for name, (lang, f) in GARBLE.items():
        bad[len(rows)] = name
        rows.append((len(rows), "Start of the note. " + f(CLEAN[lang])))
    rows += [(9000, None), (9001, ""), (9002, "ASCII only"), (9003, "The importer once printed `Ã¼` here, kept as an example."), (9004, "```\na/\n├── b\n└── c\n```"), (9005, "été 👩‍💻 ﻿x"), (9006, "ü" * 20000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit("clash")), bad


def test_garbled_texts_are_found(mixed):
    t, bad = mixed
    got = {r.doc_id for r in garbled.found(t).collect()}
    assert {bad.get(i, i) for i in got} == set(bad.values())
    assert garbled.found(t.limit(0)).count() == 0


def test_garbled_texts_are_restored(mixed):
    t, bad = mixed
    got = {bad.get(r.doc_id): r.text for r in garbled.repaired(t).collect()}
    for name in ("utf8 as latin1", "utf8 as cp437", "utf8 as mac", "cp1251 as cp1252", "cp1250 as cp1252", "twice", "sjis as cp1252"):
        assert got[name] == "Start of the note. " + CLEAN[GARBLE[name][0]], name


def test_little_dirt_of_any_single_byte_pair_is_no_clean_text(spark):
    for written, read in (("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("koi8_r", "cp1251")):
        clean = "xжy" if written == "koi8_r" else "xéy"
        bad = clean.encode(written).decode(read)
        model = garbled.fit(spark.createDataFrame([(clean, 1000), (bad, 5)], "token string, n long"))
        assert model.alone(np.array([ord(clean[1]), ord(bad[1])])).tolist() == [1000, 0], (written, read)


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{root}/veritrail"):
        if not folder.endswith("/llm"):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}", encoding="utf-8") as f:
                        assert "veritrail.llm" not in f.read(), n
