"""Tokens, coverage, verdicts and formats as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no query tokens.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "have", "are", "was",
    "you", "your", "not", "but", "its", "all", "can", "has", "had", "she",
    "her", "him", "his", "our", "their", "them", "who", "whom", "which",
    "what", "when", "where", "why", "how", "into", "than", "then", "they",
)
# What a query token is, and the verdicts by rank.
TOKEN = r"[a-zA-Z0-9_\-\./]{3,}"
VERDICTS = {"STRONG": 0, "REBUILT": 0, "WEAK": 1, "STALE": 2, "REMOVED": 2, "NOPATH": 3}


def _marked() -> tuple[str, str]:
    """The characters that are an ASCII letter with marks, and these letters."""
    pairs = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2130))
    pairs = [(c, d[0]) for c, d in pairs if len(d) and d[0] < "\x80" and d[0].isalpha() and (len(d) > 1 or d != c) and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED = _marked()


def plain(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_MARKED))


def terms(text: Column) -> Column:
    """The tokens of a text for lexical search, in order and with repetitions; none for null."""
    return F.regexp_extract_all(plain(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """The distinct tokens of three or more characters, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def coverage(query_tokens: Column, *parts: Column) -> Column:
    """The share of the query's tokens that are substrings of the parts, joined by blanks; 0 without tokens."""
    hay = F.lower(F.concat_ws(" ", *parts))
    hits = F.size(F.filter(query_tokens, lambda t: F.contains(hay, t)))
    return F.when(F.size(query_tokens) > 0, hits / F.size(query_tokens)).otherwise(F.lit(0.0))


def content_score(query_tokens: Column, content: Column, limit: int = 262144) -> Column:
    """Coverage by a file's text; null for an unreadable, overlong or binary file and for a query without tokens."""
    ok = content.isNotNull() & (F.octet_length(content) <= limit) & (F.size(query_tokens) > 0) & (F.instr(F.substring(content, 1, 1024), "\u0000") == 0)
    return F.when(ok, coverage(query_tokens, content))


def verdict(alive: Column, any_path: Column, score: Column) -> Column:
    return F.when(alive, F.when(score >= 0.5, "STRONG").otherwise("WEAK")).when(any_path, "STALE").otherwise("NOPATH")


def verdict_rank(v: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))[v].cast("bigint")


def percent(share: Column) -> Column:
    """Truncated, not rounded."""
    return F.floor(share * 100).cast("bigint")


def result_line(v: Column, share: Column, title: Column) -> Column:
    return F.format_string("[%-6s] cov%02d%% %s", v, percent(share), title)


def hit_line(title: Column, score: Column) -> Column:
    """The score with two decimals, rounded from its binary value as printf does; format_string rounds its decimal form."""
    return F.format_string("%s [%s]", title, F.replace(F.format_number(score, 2), F.lit(","), F.lit("")))


def hit_rate(strong: Column, weak: Column, miss: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(strong, strong + weak + miss), 3), F.lit(0.0))


def hours(seconds: Column) -> Column:
    return F.round(seconds / 3600, 1)


def sync_age(now: Column, last: Column) -> Column:
    """Whole hours; -1 when never."""
    return F.when(last == 0, F.lit(-1).cast("bigint")).otherwise(F.floor((now - last) / 3600).cast("bigint"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\n", " ⏎ ")


def store_id(reply: Column) -> Column:
    """The id in a store's reply: the first run of 16 or more hex digits, else the JSON id_hex."""
    run = F.regexp_extract(reply, r"\b([0-9a-fA-F]{16,})\b", 1)
    return F.coalesce(F.nullif(run, F.lit("")), F.get_json_object(reply, "$.result.id_hex"), F.get_json_object(reply, "$.id_hex"))


def seed_body(purpose: Column) -> Column:
    """The purpose, and again with blanks for underscores where that differs."""
    plain = F.translate(purpose, "_", " ")
    return F.when(plain != purpose, F.concat(purpose, F.lit(" "), plain)).otherwise(purpose)


def render_body(kind: Column, path: Column, symbol: Column, label: Column, line: Column, language: Column) -> Column:
    where = F.when(line.isNotNull() & (line != 0), F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)
    return F.when(kind == "file", F.concat_ws(" — ", path, language)).otherwise(F.concat(F.coalesce(label, symbol), F.lit(" defined at "), where))


def render_keywords(kind: Column, language: Column) -> Column:
    """Keywords of a projected node, null ones left out."""
    return F.when(kind == "file", F.array_compact(F.array(F.lit("index"), F.lit("file"), language))).otherwise(F.array(F.lit("index"), F.lit("symbol")))


def render_title(kind: Column, path: Column, symbol: Column, label: Column, line: Column) -> Column:
    name = F.coalesce(label, symbol)
    where = F.when(line.isNotNull() & (line != 0), F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)
    return F.when(kind == "file", path).otherwise(F.concat(name, F.lit(" — "), where))
