"""Byte-level BPE of a whole corpus with Spark's higher-order functions.

1. The distinct words of the corpus are counted; partial counts are combined before the shuffle.
2. A word is encoded by a fold over its byte array: each turn merges the adjacent pair of the lowest rank, looked up in a literal
   rank map, until no pair has a rank.
3. The HOT most frequent words (a fixed number) are encoded once and become a literal word map. The texts are encoded where they lie:
   a word of the map takes its ids from there, any other one is folded on the spot. A word beyond the map holds less than 1/HOT of
   all occurrences, most hold a single one, so that a fold costs less than a shuffle of the word and of the text's ids would.
No text, word or id is shuffled but for the counts. The rank map and the word map are literal arrays, read by position, and stand once in a plan.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.skew import frequent
from veritrail.session import materialize

#: Where the files of the public tokenizers lie; a parameter of each function that reads them.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the split of texts into words before the merges, as published with the vocabulary; (?U) for Unicode blanks.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT = 16384
#: Bytes of a word up to which it is folded whole; a longer one is cut first. Bytes of a part up to which one pair is merged a turn.
SHORT, PART = 64, 1024
_MOST = 1 << 20
#: Token ids as single characters, for long parts: the code point of id 0.
_PLANE = 0x100
#: No token, beside the first and the last one.
_NONE = 0xFFFF
#: The rank of a pair that merges is _FIRST | id, a negative number; a pair that doesn't merge has the rank _AFTER or more.
_FIRST, _AFTER = -(1 << 31), (1 << 16) - (1 << 31)
_NEVER, _LAST = _AFTER << 32, (1 << 31) - 1
#: An empty place of the rank map: no left id.
_EMPTY = (_NONE - 1 << 16) + _FIRST


@lru_cache(maxsize=2)
def rank_table(folder: str, name: str = "byte_bpe_50k") -> tuple[list[int], np.ndarray, list[bytes]]:
    """(id of each byte, merges as rows (left id, right id, id) by rank, bytes of each id)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    v = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = np.array([(v[a], v[b], v[a + b]) for a, b in pairs], np.int64)
    pieces = [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        pieces[i] = piece
    return [ids[bytes([b])] for b in range(256)], merges, pieces


#: Where the bits, the pairs of bytes and the displacements begin in the rank map.
_BITS, _BYTES, _MOVES = 256, 256 + 2048, 256 + 2048 + 65536


@lru_cache(maxsize=2)
def rank_map(folder: str) -> str:
    """The literal rank map as text: ids of the 256 bytes, then which pairs of bytes stand beside each other in some token (a bit each,
    32 a number, by left * 256 + right), then what each pair of bytes merges into or -1, by their ids, then a displacement for each left id, then the shared rows.

    The pairs of one left id are one sparse row by right id; the rows are laid into one array, displaced so that no two entries
    meet. The entry of a pair is left << 16 ^ (_FIRST | id), in 32 bits, where id is what the pair merges into: with left << 16 taken off it is the rank, and any other left leaves _AFTER or more.
    """
    byte_ids, merges, pieces = rank_table(folder)
    if len(pieces) >= _NONE - 1:
        raise ValueError("ids of 16 bits only")
    if max(byte_ids) > 255:
        raise ValueError("ids of bytes below 256 only")
    order = np.lexsort((merges[:, 1], merges[:, 0]))
    left, right, into = merges[order].T
    starts = np.flatnonzero(np.diff(left, prepend=-1))
    ends = np.append(starts[1:], len(left))
    held = np.zeros(16 * len(pieces), np.int64)
    held[_NONE - len(pieces)] = _NONE - 1 << 16  # the displacement of _NONE would lie here: it points beyond the end
    move = np.full(len(pieces), 1 << 30, np.int64)  # a left id without pairs points beyond the end
    free = 0
    for i in np.argsort(starts - ends, kind="stable").tolist():  # the longest row first
        row = right[starts[i] : ends[i]] - right[starts[i]]
        while held[free]:
            free += 1
        at = free
        while len(row) > 1:
            fits = np.ones(4096, bool)
            for x in row:
                fits &= held[at + x : at + x + 4096] == 0
            if fits.any():
                at += int(fits.argmax())
                break
            at += 4096
        held[at + row] = left[starts[i]] << 16 | into[starts[i] : ends[i]]
        move[left[starts[i]]] = at - int(right[starts[i]])
    held = held[: int(np.flatnonzero(held)[-1]) + 1]
    held[held == 0] = (_NONE - 1) << 16  # no left id; 0 would pass for one of id 0
    below = np.flatnonzero(move < 0)  # small right ids of these meet displacements instead of rows
    move = np.minimum(move + _MOVES + len(move), 2**31 - 1 - _NONE)
    if np.isin(below ^ 0x8000, move >> 16).any():
        raise ValueError("a displacement would pass for a pair")
    beside = np.zeros(65536, np.int64)
    for p in pieces:
        b = np.frombuffer(p, np.uint8).astype(np.int64)
        beside[b[:-1] << 8 | b[1:]] = 1
    bits = (beside.reshape(-1, 32) << np.arange(32)).sum(axis=1)
    of_bytes = np.full(65536, -1)  # short as text: with _FIRST taken off it is _LAST
    two = (merges[:, :2] < 256).all(axis=1)
    of_bytes[merges[two, 0] * 256 + merges[two, 1]] = merges[two, 2]
    numbers = [np.array(byte_ids), bits.astype(np.uint32).view(np.int32), of_bytes, move, (held ^ 1 << 31).astype(np.uint32).view(np.int32)]
    return ",".join(map(str, np.concatenate(numbers).tolist()))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _given(value: Column, kind: str, body) -> Column:
    """The same where it is called for each word and turn: kind is the type of what body gives. A transform would copy that, and look up its type in the whole plan of body each time."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def with_rank_map(body, folder: str = TOKENIZERS) -> Column:
    """body(rank map): the literal stands once, whatever body does with it."""
    return _let(F.split(F.lit(rank_map(folder)), ",").cast("array<int>"), body)


def _rank(book: Column, left: Column, right: Column) -> Column:
    """The rank of a pair of ids, or any number from _AFTER on. Without a variable or a condition: most of the time goes here."""
    return F.coalesce(F.get(book, F.get(book, left + _MOVES) + right), F.lit(_EMPTY)).bitwiseXOR(F.shiftleft(left, 16))


def _code(rank: Column, left: Column, right: Column) -> Column:
    """rank << 32 | left << 16 | right, a long."""
    return F.shiftleft(rank.cast("bigint"), 32).bitwiseOR(F.shiftleft(left.cast("bigint"), 16)).bitwiseOR(right.cast("bigint"))


def _bytes(book: Column, tokens: Column) -> Column:
    """`_start` for the ids of single bytes: a pair is one look into the table of pairs of bytes."""
    never, none = F.lit(_LAST), F.lit(_NONE)
    after = lambda t, i: F.get(t, i + 1)
    inner = lambda t: F.transform(t, lambda a, i: _code(F.coalesce(F.get(book, a * 256 + after(t, i) + _BYTES).bitwiseXOR(F.lit(_FIRST)), never), a, F.coalesce(after(t, i), none)))
    return F.flatten(F.array(F.array(_code(never, none, F.coalesce(F.get(tokens, F.lit(0)), none))), inner(tokens)))


def _start(book: Column, tokens: Column) -> Column:
    """The pairs of adjacent tokens, one before the first and one after the last token included."""
    after = lambda t, i: F.coalesce(F.get(t, i + 1), F.lit(_NONE))
    rank = lambda r: F.when(r >= _AFTER, F.lit(_LAST)).otherwise(r)
    pair = lambda t: lambda a, i: _code(rank(_rank(book, a, after(t, i))), a, after(t, i))
    return _let(F.concat(F.array(F.lit(_NONE)), tokens), lambda t: F.transform(t, pair(t)))


def _tokens(pairs: Column) -> Column:
    return F.transform(F.slice(pairs, 2, _MOST), lambda e: F.shiftright(e, 16).bitwiseAND(F.lit(_NONE).cast("bigint")).cast("int"))


def _beside(book: Column, before: Column, token: Column, after: Column) -> Column:
    """The two pairs that a new token makes with its neighbours."""
    left = F.shiftright(before, 16).bitwiseAND(F.lit(_NONE).cast("bigint")).cast("int")
    right = after.bitwiseAND(F.lit(_NONE).cast("bigint")).cast("int")
    return F.zip_with(F.array(left, token), F.array(token, right), lambda a, b: _code(_rank(book, a, b), a, b))


def _fold(book: Column, tokens: Column, end=_tokens) -> Column:
    """Ranked merges over an array of the ids of bytes; a turn merges the leftmost pair of the lowest rank, and only the pairs beside it change. end gives the result from the last pairs."""

    def step(s: Column, _: Column) -> Column:
        def merged(p: Column) -> Column:
            m = F.get(s, p - 1)
            token = F.shiftright(m, 32).bitwiseAND(F.lit(_NONE).cast("bigint")).cast("int")
            new = F.flatten(F.array(F.slice(s, F.lit(1), p - 2), _beside(book, F.get(s, p - 2), token, F.get(s, p)), F.slice(s, p + 2, F.lit(_MOST))))
            return F.when(m >= _NEVER, s).otherwise(new)

        return _given(F.array_position(s, F.array_min(s)).cast("int"), "array<bigint>", merged)

    return F.aggregate(tokens, _bytes(book, tokens), step, end)


def _sign(token: Column) -> Column:
    """A token as one character."""
    return F.decode(F.unhex(F.lpad(F.hex(token.cast("bigint") + _PLANE), 4, "0")), "UTF-16BE")


def _fold_all(book: Column, tokens: Column) -> Column:
    """The same for long arrays: the state is a string with a character per token, and a turn merges all occurrences of the pair."""
    ids = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c) - _PLANE)
    state = lambda t, done: F.struct(t.alias("t"), F.lit(done).alias("done"))
    half = lambda m, bits: F.shiftright(m, bits).bitwiseAND(F.lit(_NONE).cast("bigint"))

    def step(s: Column, _: Column) -> Column:
        new = lambda m: F.when(m >= _NEVER, state(s["t"], True)).otherwise(state(F.replace(s["t"], F.concat(_sign(half(m, 16)), _sign(half(m, 0))), _sign(half(m, 32))), False))
        return F.when(s["done"], s).otherwise(_let(F.array_min(_start(book, ids(s["t"]))), new))

    return F.aggregate(tokens, state(F.array_join(F.transform(tokens, _sign), ""), False), step, lambda s: ids(s["t"]))


def _cut(book: Column, codes: Column) -> Column:
    """The codes of a word's bytes in parts: cut where no token holds the two bytes beside each other, which no merge can bridge."""
    key = lambda a, b: a * 256 + b
    bridged = lambda k: F.shiftright(F.get(book, F.shiftright(k, 5) + _BITS), 0).bitwiseAND(F.get(F.array(*(F.lit(1 << i if i < 31 else -(2**31)) for i in range(32))), k.bitwiseAND(F.lit(31)))) != 0
    at = F.transform(codes, lambda a, i: F.when((i == 0) | ~_let(key(F.get(codes, i - 1), a), bridged), i + 1))
    begin = F.array_compact(at)
    return _let(begin, lambda c: F.transform(c, lambda b, i: F.slice(codes, b, F.coalesce(F.get(c, i + 1), F.size(codes) + 1) - b)))


def encode_word(book: Column, word: Column) -> Column:
    """The ids of one word of any length."""
    return _encoded(book, word, "array<int>", _tokens, lambda ids: ids)


def word_size(book: Column, word: Column) -> Column:
    """The number of ids of one word, without the list of them where it is short."""
    return _encoded(book, word, "int", lambda pairs: F.size(pairs) - 1, F.size)


def _encoded(book: Column, word: Column, kind: str, end, of_ids) -> Column:
    """For a short word end(its last pairs), for others of_ids(their ids), of the type kind."""
    each = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    codes = F.transform(each, lambda c: F.ascii(c))
    tokens = lambda c: F.transform(c, lambda x: F.get(book, x))
    part = lambda c: F.when(F.size(c) <= PART, _fold(book, tokens(c))).otherwise(_fold_all(book, tokens(c)))
    long_ = _let(codes, lambda c: F.flatten(F.transform(_cut(book, c), part)))
    short = F.transform(each, lambda c: F.get(book, F.ascii(c)))
    return F.when(F.octet_length(word) <= SHORT, _given(short, kind, lambda t: _fold(book, t, end))).otherwise(of_ids(long_))


class WordMap:
    """A literal map of words to their ids: a word lies at one of two places by hash; of too many that meet, the most frequent stay and the others are left out."""

    SLOTS = 1 << 16

    def __init__(self, rows: list):
        words, lists = [""] * self.SLOTS, [None] * self.SLOTS
        for r in sorted(rows, key=lambda r: (-r.n, r.word)):
            for at in (r.h & (self.SLOTS - 1), r.h >> 16 & (self.SLOTS - 1)):
                if lists[at] is None:
                    words[at], lists[at] = r.word, r.ids
                    break
        self.words = F.from_json(F.lit(json.dumps(words, ensure_ascii=False)), "array<string>")
        self.lists = F.from_json(F.lit(json.dumps(lists, separators=(",", ":"))), "array<array<int>>")

    @staticmethod
    def hashed(word: Column) -> Column:
        return F.hash(word)

    def bound(self, body) -> Column:
        """body(ids), where ids(word) is null for a word that isn't in the map; the literals stand once, whatever body does with it."""

        def ids(words: Column, lists: Column, word: Column) -> Column:
            first = self.hashed(word).bitwiseAND(F.lit(self.SLOTS - 1))
            second = F.shiftrightunsigned(self.hashed(word), 16)
            return F.when(F.get(words, first) == word, F.get(lists, first)).when(F.get(words, second) == word, F.get(lists, second))

        return _let(self.words, lambda w: _let(self.lists, lambda i: body(lambda word: ids(w, i, word))))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def hot_words(documents: DataFrame, folder: str = TOKENIZERS, hot: int = HOT) -> WordMap:
    """The map of the most frequent words of the corpus; the driver gets at most `hot` rows."""
    words = documents.select(F.explode(split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(words.filter("word <> ''"), "words")
    ids = with_rank_map(lambda book: encode_word(book, F.col("word")), folder)
    return WordMap(frequent(words, hot).select("word", "n", WordMap.hashed(F.col("word")).alias("h"), ids.alias("ids")).collect())


def encoded(text: Column, known: WordMap, folder: str = TOKENIZERS) -> Column:
    """The ids of a text; none for a null one."""
    words = split_words(F.coalesce(text, F.lit("")))
    return with_rank_map(lambda book: known.bound(lambda ids: F.flatten(F.transform(words, lambda w: F.coalesce(ids(w), encode_word(book, w))))), folder)


def counted(text: Column, known: WordMap, folder: str = TOKENIZERS) -> Column:
    """The number of ids of a text, without the list of them; 0 for a null one."""
    words = split_words(F.coalesce(text, F.lit("")))
    size = lambda w, ids, book: F.coalesce(F.array_size(ids(w)), word_size(book, w)).cast("long")
    return with_rank_map(lambda book: known.bound(lambda ids: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + size(w, ids, book))), folder)


def encode(documents: DataFrame, folder: str = TOKENIZERS, hot: int = HOT) -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens. An empty or null text has an empty list.

    Each row is encoded by itself: repeated rows of one doc_id give repeated rows. Other columns are ignored.
    """
    return documents.select("doc_id", encoded(F.col("text"), hot_words(documents, folder, hot), folder).alias("ids"))


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens): how many ids each text has; 0 for an empty or null text. One row per row of documents."""
    return documents.select("doc_id", counted(F.col("text"), hot_words(documents, folder), folder).alias("tokens"))


def decode(encoded: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the pieces of the ids, concatenated as binary and read as UTF-8. Null ids give null, no ids the empty text."""
    *_, pieces = rank_table(folder)
    book = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")
    return encoded.select("doc_id", F.unhex(F.array_join(F.transform("ids", lambda i: F.get(book, i)), "")).cast("string").alias("text"))
