"""Excerpts around a query's first word, by UTF-8 byte offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = 60, 140


def _fold(raw: bytes) -> bytes:
    return raw.lower()  # ASCII letters only


def span(text: str, query: str) -> tuple[int, int]:
    """Byte range around the first word: an exact hit, else one that ignores ASCII case, else the start of the text."""
    raw = text.encode()
    words = query.split()
    needle = (words[0] if words else query).encode()
    at = raw.find(needle)
    if at < 0:
        at = _fold(raw).find(_fold(needle))
    at = max(at, 0)
    start, end = max(0, at - BEFORE), min(at + AFTER, len(raw))
    while start and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def excerpt(text: str, query: str) -> tuple[int, int, str]:
    start, end = span(text, query)
    return start, end, " ".join(text.encode()[start:end].decode().split())


def snippet(text: Column | str, query: str) -> Column:
    """struct(start, end, text)."""

    @F.pandas_udf("struct<start:int,end:int,text:string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([excerpt(t or "", query) for t in texts], columns=["start", "end", "text"])

    return cut(text)
