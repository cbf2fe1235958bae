"""Text decoded with the wrong encoding: a hidden Markov model labels characters, labelled spans are inverted.

States: clean, one per encoding pair (written in, read as), and one for characters that were lost and replaced. A pair that reads single bytes as other single bytes
restores character by character; one that reads UTF-8 bytes as single characters restores whole sequences, and can only be
entered and left at their ends. The emission of a state is the probability of the restored character after the restored
one before it, under one bigram model of clean text; so that a span counts as garbled where its restoration reads like
the corpus and it itself doesn't. Texts garbled twice are labelled again until nothing changes.

The model is counted over all tokens of the corpus that can't be read as UTF-8 sequences under any pair. The chain starts anew at
ASCII blanks, which are the same under every pair; so it runs once over each distinct token, and the labels go back to
the texts by a join. Text between backquotes is an example, not a case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.skew import frequent, skewed_lookup
from veritrail.session import materialize

#: Read as; the bytes are UTF-8.
SEQUENCES = ("cp1252", "iso8859_15", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "koi8_r")
#: (written in, read as), byte by byte.
SINGLES = (
    ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"),
)
#: Written in; double bytes read as cp1252.
DOUBLES = ("cp932",)
#: Priors, stated rather than fitted: the share of the text that may be garbled, the characters that a garbled span has on average, and how sure a document of single-byte
#: garbling must be. A pair of characters that is by the first share rarer than its restoration is no evidence of clean text.
DIRT, SPAN, LEVEL = 0.05, 8, 0.999
#: Pairs of characters that the model keeps, the most frequent ones; others are judged by the single characters.
PAIRS = 100_000
#: What the priors say of the costs of entering and leaving a state, and of the log odds that the tokens of a single-byte pair must reach together in a document.
ENTER = float(np.log(DIRT / (len(SEQUENCES) + len(SINGLES) + len(DOUBLES) + 1)))
LEAVE = float(np.log(1 / SPAN))
LEAST = float(np.log(LEVEL / (1 - LEVEL)) - np.log(DIRT / len(SINGLES) / (1 - DIRT / len(SINGLES))))
FORBIDDEN = -60.0
_CYRILLIC = ("cp1251", "koi8_r")
_LOST, LOST = 0xFFFD, "lost"


@lru_cache(maxsize=None)
def _high(encoding: str) -> np.ndarray:
    """The characters of bytes 0..255; undefined ones stand for the control character of the same number."""
    return np.array([ord(bytes([b]).decode(encoding, "ignore") or chr(b)) for b in range(256)])


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> np.ndarray:
    """The byte of each character below U+10000 or -1; cp1252 also takes the control characters of latin-1."""
    t = np.full(0x10000, -1, np.int32)
    chars = _high(encoding)
    if encoding == "cp1252":
        t[0x80:0xA0] = np.arange(0x80, 0xA0)
    t[chars] = np.arange(256)
    t[:128] = np.arange(128)
    return t


#: Blocks of the characters that a sequence may stand for: Latin, Greek, Cyrillic, Hebrew, Arabic, symbols, East Asian scripts, emoji.
BLOCKS = ((0x80, 0x250), (0x2B0, 0x300), (0x370, 0x530), (0x590, 0x700), (0x1E00, 0x27C0), (0x2E80, 0xA000), (0xAC00, 0xD7B0), (0xFB00, 0xFB10), (0xFE00, 0xFE70), (0xFEFF, 0x10000), (0x1F000, 0x1FB00))


@lru_cache(maxsize=1)
def _plausible() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    for a, b in BLOCKS:
        t[a:b] = True
    return t


class Model:
    """log P(b | a) of clean text, from counts of pairs and of single characters; a pair that isn't kept is judged by the single ones."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, chars: np.ndarray | None = None, count: np.ndarray | None = None):
        key = a.astype(np.int64) << 21 | b
        order = np.argsort(key)
        self.key, self.n = key[order], n[order].astype(np.float64)
        self.key = np.append(self.key, np.int64(2**62))
        self.n = np.append(self.n, 0.0)
        if chars is None:
            chars, at = np.unique(b, return_inverse=True)
            count = np.bincount(at, n, len(chars)) if len(n) else np.zeros(0)
        self.chars, self.count = np.append(chars, 2**30), np.append(count, 0.0)
        self.total = max(1.0, float(count.sum()))

    def alone(self, c: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.chars, c)
        return np.where(self.chars[i] == c, self.count[i], 0.0)

    def __call__(self, a: np.ndarray, b: np.ndarray, weight: float = 5.0) -> np.ndarray:
        key = a.astype(np.int64) << 21 | b
        i = np.searchsorted(self.key, key)
        n = np.where(self.key[i] == key, self.n[i], 0.0)
        share = (self.alone(b) + 0.01) / (self.total + 1000.0)
        return np.log((n + weight * share) / (self.alone(a) + weight))


def _restorations(cp: np.ndarray, encodings: tuple[str, ...] = SEQUENCES):
    """For each sequence pair: (restored, part): the character that each position belongs to, and 1 at the start of a sequence, 2 inside one, 0 elsewhere, 3 where the pair can't be."""
    small = np.minimum(cp, 0xFFFF)
    for encoding in encodings:
        byte = np.where(cp < 0x10000, _bytes_of(encoding)[small], -1)
        cont = (byte >= 0x80) & (byte < 0xC0)
        pad = np.concatenate([byte, [-1, -1, -1]])
        c = np.concatenate([cont, [False] * 3])
        n = len(byte)
        b1, b2, b3 = pad[1 : n + 1] & 63, pad[2 : n + 2] & 63, pad[3 : n + 3] & 63
        c1, c2, c3 = c[1 : n + 1], c[2 : n + 2], c[3 : n + 3]
        two = (byte >= 0xC2) & (byte <= 0xDF) & c1
        v3 = (byte & 15) << 12 | b1 << 6 | b2
        three = (byte >= 0xE0) & (byte <= 0xEF) & c1 & c2 & (v3 >= 0x800) & ~((v3 >= 0xD800) & (v3 < 0xE000))
        v4 = (byte & 7) << 18 | b1 << 12 | b2 << 6 | b3
        four = (byte >= 0xF0) & (byte <= 0xF4) & c1 & c2 & c3 & (v4 >= 0x10000) & (v4 < 0x110000)
        restored, part = cp.copy(), np.where(cp < 128, 0, 3)
        known = _plausible()
        for at, value, size in ((two, (byte & 31) << 6 | b1, 2), (three, v3, 3), (four, v4, 4)):
            i = np.flatnonzero(at & known[np.minimum(value, 0x10FFFF)])
            part[i] = 1
            for k in range(size):
                restored[i + k] = value[i]
                if k:
                    part[i + k] = 2
        yield restored, part


def _doubles(tokens: list[str], cp: np.ndarray, first: np.ndarray):
    """The same for double bytes read as cp1252; sought where a token has three characters above 127."""
    table = {int(c): b for b, c in enumerate(_high("cp1252"))} | {c: c for c in range(0x80, 0xA0)}
    for encoding in DOUBLES:
        restored, part = cp.copy(), np.full(len(cp), 3)
        for t, s in zip(tokens, first.tolist(), strict=True):
            if sum(x > "\x7f" for x in t) < 3:
                continue
            try:
                raw = bytes(ord(x) if x < "\x80" else table[ord(x)] for x in t)
            except (KeyError, ValueError):
                continue
            i = 0
            try:
                while i < len(raw):
                    k = 1 if raw[i] < 0x80 or 0xA1 <= raw[i] <= 0xDF else 2
                    ch = raw[i : i + k].decode(encoding)
                    restored[s + i : s + i + k] = ord(ch)
                    part[s + i] = 1 if k == 2 else 0
                    if k == 2:
                        part[s + i + 1] = 2
                    i += k
            except (UnicodeDecodeError, TypeError):
                restored[s : s + len(t)], part[s : s + len(t)] = cp[s : s + len(t)], 3
        yield restored, part


def _points(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the tokens, each after a blank; the place of each token's first character."""
    text = " " + " ".join(tokens) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return cp, np.concatenate([[1], 1 + np.cumsum(size + 1)])[:-1].astype(np.int64)


def readable_as_utf8(tokens: list[str]) -> np.ndarray:
    """Which tokens hold a UTF-8 sequence under some pair, a lost character or a control character of latin-1: left out of the model.

    koi8_r is passed over, as common Russian letters form sequences there.
    """
    cp, first = _points(tokens)
    bad = (cp == _LOST) | ((cp >= 0x80) & (cp < 0xA0))
    for _, part in _restorations(cp, SEQUENCES[:-1]):
        bad |= part == 1
    return np.add.reduceat(bad, first) > 0 if len(tokens) else np.zeros(0, bool)


def label(tokens: list[str], model: Model) -> list[tuple[str, str, float]]:
    """(restored, names of the pairs, log odds of the best path against the clean one) of each token; the token itself and '' if it is clean."""
    cp, first = _points(tokens)
    prev = np.concatenate([[32], cp[:-1]])
    names, emit, rest, parts = ["clean"], [model(prev, cp)], [cp], [np.zeros(len(cp), int)]
    sequences = [*zip((f"utf_8>{e}" for e in SEQUENCES), _restorations(cp), strict=True), *zip((f"{e}>cp1252" for e in DOUBLES), _doubles(tokens, cp, first), strict=True)]
    for name, (restored, part) in sequences:
        if not (part == 1).any():
            continue
        e = model(np.concatenate([[32], restored[:-1]]), restored)
        e[part == 2] = 0.0
        e[part == 3] = FORBIDDEN
        names.append(name), emit.append(e), rest.append(restored), parts.append(part)
    small = np.minimum(cp, 0xFFFF)
    # where characters were lost, single bytes are no guide
    lost = np.zeros(len(cp), bool)
    if len(tokens):
        gone = np.add.reduceat(cp == _LOST, first) > 0
        lost[first[0] :] = np.repeat(gone, np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)))
    # a word is of one script
    latin = np.zeros(len(cp), bool)
    if len(tokens):
        letters = ((cp | 32) >= 97) & ((cp | 32) <= 122)
        latin[first[0] :] = np.repeat(np.add.reduceat(letters, first) > 0, np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens)))
    for written, read in SINGLES:
        byte = np.where((cp < 0x10000) & (cp > 127), _bytes_of(read)[small], -1)
        restored = np.where(byte >= 128, _high(written)[byte], cp)
        if (restored == cp).all():
            continue
        e = model(np.concatenate([[32], restored[:-1]]), restored)
        e[((cp > 127) & (byte < 0)) | lost | (latin if written in _CYRILLIC else False)] = FORBIDDEN
        names.append(f"{written}>{read}"), emit.append(e), rest.append(restored), parts.append(np.where((cp > 127) & (byte < 0), 3, 0))
    gone_here = cp == _LOST
    if gone_here.any():  # a state that gives nothing but lost characters
        names.append(LOST), emit.append(np.where(gone_here, 0.0, FORBIDDEN)), rest.append(cp), parts.append(np.zeros(len(cp), int))
    E, P = np.stack(emit), np.stack(parts)
    inside = P == 2
    states = len(names)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out: list[tuple[str, str, float]] = [(t, "", 0.0) for t in tokens]
    order = np.argsort(size, kind="stable")
    group = 0
    while group < len(order):
        top = int(size[order[group]])
        hi = int(np.searchsorted(size[order], max(top + 4, top * 5 // 4), "right"))
        hi = min(hi, group + max(64, 400_000 // max(1, states * int(size[order[hi - 1]]))))
        rows = order[group:hi]
        group = hi
        length = int(size[rows].max())
        score = np.full((states, len(rows)), ENTER)
        score[0] = 0.0
        came = np.zeros((length, states, len(rows)), np.int8)  # 0 stayed, 1 entered from clean; for clean the state it came from
        best, final = np.zeros(len(rows), int), np.full((states, len(rows)), FORBIDDEN)
        for i in range(length):
            at = np.minimum(first[rows] + i, len(cp) - 1)
            mid = inside[:, at]
            if i:
                leave = score + LEAVE
                leave[0] = score[0]
                leave[mid] = -np.inf  # not in the midst of a sequence
                source = leave.argmax(axis=0)
                clean = leave[source, np.arange(len(rows))]
                enter = np.where(mid, -np.inf, score[0] + ENTER)
                entered = enter > score
                new = np.where(entered, enter, score)
                came[i] = entered
                new[0], came[i, 0] = clean, source
                score = new
            else:
                score = np.where(mid, -np.inf, score)
            score = score + E[:, at]
            ends = size[rows] == i + 1
            final[:, ends] = score[:, ends]
        best = final.argmax(axis=0)
        for r in np.flatnonzero((best > 0) | came[:, 0].any(axis=0)).tolist():  # the others never left clean
            n, s = int(size[rows[r]]), int(best[r])
            path = [0] * n
            for i in range(n - 1, -1, -1):
                path[i] = s
                s = int(came[i, 0, r]) if s == 0 else (0 if came[i, s, r] else s)
            start = int(first[rows[r]])
            text = "".join(chr(rest[s][start + i]) for i, s in enumerate(path) if P[s, start + i] != 2)
            if text != tokens[rows[r]] or any(names[s] == LOST for s in path):
                clean = float(E[0, start : start + n].sum())
                out[rows[r]] = (text, ",".join(sorted({names[s] for s in path if s})), float(final[best[r], r]) - clean)
    return out


def restore(tokens: list[str], model: Model, rounds: int = 4) -> list[tuple[str, str, float]]:
    """label, and again on what changed; (restored, pairs of all rounds, outermost first, log odds of the first)."""
    done = label(tokens, model)
    open_ = [i for i, (t, how, _) in enumerate(done) if how and t != tokens[i]]
    for _ in range(rounds - 1):
        if not open_:
            break
        again = label([done[i][0] for i in open_], model)
        open_ = [(i, t, how) for i, (t, how, _) in zip(open_, again, strict=True) if how and t != done[i][0]]
        for i, t, how in open_:
            done[i] = (t, f"{done[i][1]};{how}", done[i][2])
        open_ = [i for i, *_ in open_]
    return done


_TOKEN = r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*"


def tokens_of(text: Column) -> Column:
    """The tokens with a character beyond ASCII, outside backquotes on one line."""
    return F.regexp_extract_all(F.regexp_replace(text, r"`[^`\n]+`", " "), F.lit(_TOKEN), F.lit(0))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, n = b.column("token").to_pylist(), b.column("n").to_numpy()
        keep = np.flatnonzero(~readable_as_utf8(tokens))
        if len(keep):
            kept = [tokens[i] for i in keep]
            cp, _ = _points(kept)
            weight = np.concatenate([np.repeat(n[keep], np.fromiter(map(len, kept), np.int64, len(kept)) + 1)])
            key, at = np.unique(cp[:-1] << 21 | cp[1:], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, weight, len(key)).astype(np.int64))], ["key", "n"])


def fit(tokens: DataFrame) -> Model:
    """The bigram model over (token, n). The driver gets at most PAIRS pairs, and each single character, of all pairs, once."""
    pairs = materialize(tokens.mapInArrow(_count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    rows = frequent(pairs, PAIRS).toPandas()
    singles = pairs.groupBy((F.col("key") % (1 << 21)).alias("c")).agg(F.sum("n").alias("n")).orderBy("c").toPandas()
    key, n = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    a, b = key >> 21, key & (2**21 - 1)
    count = dict(zip(key.tolist(), n.tolist(), strict=True))
    clean = np.ones(len(key), bool)
    for written, read in SINGLES:  # what a little dirt explains is no clean text
        byte, high = _bytes_of(read), _high(written)
        turn = lambda c: np.where((c > 127) & (c < 0x10000) & (byte[np.minimum(c, 0xFFFF)] >= 128), high[byte[np.minimum(c, 0xFFFF)]], c)  # noqa: E731, B023
        other = (turn(a) << 21 | turn(b)).tolist()
        clean &= np.array([o == k or count.get(o, 0) * DIRT < m for o, k, m in zip(other, key.tolist(), n.tolist(), strict=True)], bool)
    chars, left = singles["c"].to_numpy(np.int64), singles["n"].to_numpy(np.int64)
    np.subtract.at(left, np.searchsorted(chars, b[~clean]), n[~clean])
    return Model(a[clean], b[clean], n[clean], chars, left)


def garbled_tokens(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, restored, pairs, odds) of the garbled tokens, (doc_id, token) of all tokens). A token whose restoration the corpus holds nowhere counts half."""
    each = materialize(documents.filter("text is not null").select("doc_id", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("token")), "each")
    tokens = materialize(each.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    model = fit(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column("token").to_pylist()
            rows = [(t, r, how, odds) for t, (r, how, odds) in zip(ts, restore(ts, model), strict=True) if how]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.float64())], ["token", "restored", "pairs", "odds"])

    spread = tokens.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("token")
    bad = materialize(spread.mapInArrow(run, "token string, restored string, pairs string, odds double"), "garbled")
    known = tokens.select(F.col("token").alias("restored"), F.lit(True).alias("known"))
    bad = bad.join(known, "restored", "left").withColumn("odds", F.when(F.col("known"), F.col("odds")).otherwise(F.col("odds") / 2))
    return bad.select("token", "restored", "pairs", "odds"), each


def _cases(documents: DataFrame) -> DataFrame:
    """(doc_id, how, tokens): the garbled tokens of each document by the first round's pair; tokens are (token, restored).

    A UTF-8 sequence, a double byte or a lost character is a case by itself; single bytes are when their tokens reach LEAST.
    """
    bad, each = garbled_tokens(documents)
    met = skewed_lookup(each, bad, ["token"], "inner").dropDuplicates(["doc_id", "token"])
    names = F.split(F.substring_index("pairs", ";", 1), ",")
    one_byte = [f"{a}>{b}" for a, b in SINGLES]
    sure = F.filter(names, lambda x: ~x.isin(one_byte))
    how = F.when(F.array_contains(names, LOST), LOST).when(F.size(sure) > 0, sure[0]).otherwise(names[0])
    by = met.withColumn("how", how).groupBy("doc_id", "how").agg(F.sum("odds").alias("odds"), F.collect_list(F.struct("token", "restored")).alias("tokens"))
    single = F.col("how").isin(one_byte)
    return by.filter(~single | (F.col("odds") >= LEAST)).select("doc_id", "how", "tokens")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens, pairs): the documents with a garbled token, how many different ones, and the pairs seen.

    Null, empty and ASCII texts give no row; repeated rows of one doc_id give one.
    """
    return _cases(documents).groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("tokens"), F.array_sort(F.collect_set("how")).alias("pairs"))


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the garbled documents with every restorable token replaced where it stands; lost characters stay."""
    swaps = _cases(documents).select("doc_id", F.explode("tokens").alias("t")).filter("t.token <> t.restored")
    swaps = swaps.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("t.token", "t.restored"))).alias("swap"))
    both = documents.select("doc_id", "text").join(swaps, "doc_id")
    pieces = F.split(F.regexp_replace("text", r"(`[^`\n]+`)|([\x00-\x20]+)", "\u0001$0\u0001"), "\u0001")
    return both.select("doc_id", F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("swap")[p], p)), "").alias("text"))
