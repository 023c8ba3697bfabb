"""Text functions as Columns: analysis, globs, paths, subtitles."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes from which a token is left out of the index.
LONG_TOKEN = 40
#: What stands between tokens: anything but letters, vowel signs and the like (Unicode Alphabetic) and numbers, for Java and here.
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _runs(text: Column | str) -> Column:
    parts = F.split(F.coalesce(_col(text), F.lit("")), _SPLIT)
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) < LONG_TOKEN))


def tokens(text: Column | str) -> Column:
    """array<string>: runs of letters and digits under LONG_TOKEN bytes, lower-cased; nulls have none."""
    return F.transform(_runs(text), F.lower)


def n_tokens(text: Column | str) -> Column:
    """How many tokens() a text has."""
    return F.size(_runs(text))


def words(text: str) -> list[str]:
    """A text's tokens of any length in order, as they stand."""
    return _WORDS.findall(text)


def ordered_tokens(text: str) -> list[str]:
    """tokens() of a query string, repeats included; `*` at either end of a word is ignored."""
    return [t.lower() for t in words(" ".join(strip_wildcards(text))) if len(t.encode()) < LONG_TOKEN]


def query_tokens(text: str) -> list[str]:
    """ordered_tokens() without repeats."""
    return list(dict.fromkeys(ordered_tokens(text)))


def strip_wildcards(text: str) -> list[str]:
    return [w for w in (word.strip("*") for word in text.split()) if w]


def symbol_terms(text: str) -> list[str]:
    """Whole lower-cased symbol names of a query; names aren't split."""
    return list(dict.fromkeys(w.lower() for w in strip_wildcards(text)))


def glob(column: Column, pattern: str, ignore_case: bool) -> Column:
    """Whether column matches a pattern in which only `*` is special. Runs as LIKE, linear in the text."""
    if ignore_case:
        column, pattern = F.lower(column), pattern.lower()
    if "*" not in pattern:
        return column == F.lit(pattern)
    like = re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%")
    return column.like(like)


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-cased extension of a file name; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(name), r"^.+\.([^.]*)$", 1))


def parent(path: Column | str) -> Column:
    """The directory above a path; the root's is the root."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(path), r"^(.+)/[^/]*$", 1), F.lit("")), F.lit("/"))


def ancestors(path: Column | str) -> Column:
    """array<string>: the path and each directory above it, without the root."""
    parts = F.split(F.ltrim(_col(path), F.lit("/")), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))
    )


def percent_decode(text: Column | str) -> Column:
    """%XX as bytes, + as a blank; a % without two hexadecimal digits stands for itself."""
    return F.try_url_decode(F.regexp_replace(_col(text), "%(?![0-9A-Fa-f]{2})", "%25"))


def strip_subtitles(text: Column | str) -> Column:
    """Spoken lines of SRT or WebVTT: no blank, timing, counter, WEBVTT or NOTE lines; lines trimmed."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    spoken = F.filter(
        lines,
        lambda x: (x != "")
        & ~F.contains(x, F.lit("-->"))
        & ~x.rlike("^[0-9]+$")
        & ~F.startswith(x, F.lit("WEBVTT"))
        & ~F.startswith(x, F.lit("NOTE")),
    )
    return F.array_join(spoken, "\n")


def truncate_bytes(text: Column | str, limit: int) -> Column:
    """The longest prefix of at most limit UTF-8 bytes that ends between characters."""
    text = _col(text)
    raw = text.cast("binary")
    last = F.hex(F.substring(raw, limit + 1, 1))
    # a continuation byte (80..BF) after the cut means that it falls inside a character of up to four bytes
    inside = [F.hex(F.substring(raw, limit + 1 - k, 1)).rlike("^[89AB]") for k in range(4)]
    back = F.when(~inside[0] | (last == ""), 0).when(~inside[1], 1).when(~inside[2], 2).otherwise(3)
    cut = F.call_function("substring", raw, F.lit(1), F.lit(limit) - back).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)
