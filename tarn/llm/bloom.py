"""Blocked Bloom filters as tables. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
WORDS = 4
#: Bytes of filter words up to which the filter is sent to every executor; beyond it the probe is a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Columns of a filter; named so that they clash with none of the rows'.
_BLOCK, _WORDS = "tarn bloom block", [f"tarn bloom word {i}" for i in range(WORDS)]


def _blocks(n_keys: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n_keys * BITS_PER_KEY / (64 * WORDS)))))


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """keys -> (_BLOCK, _WORDS): a key sets one bit in each 64-bit word of its one block.

    Blocks number a power of two so that keys get BITS_PER_KEY bits each; words are merged by bit_or on the map side.
    """
    block = F.pmod(F.xxhash64(key), F.lit(_blocks(n_keys))).alias(_BLOCK)
    words = [F.bit_or(_mask(F.col(key), i)).alias(_WORDS[i]) for i in range(WORDS)]
    return keys.groupBy(block).agg(*words)


def possible_hits(rows: DataFrame, key: str, filter_words: DataFrame, n_keys: int) -> DataFrame:
    """Adds `possible` (replacing one that is there) to rows: false only if their key is surely not in the filter of n_keys keys."""
    blocks = _blocks(n_keys)
    size = blocks * 8 * (WORDS + 1)
    words = F.broadcast(filter_words) if size <= BROADCAST_BYTES else filter_words
    rows = rows.withColumn(_BLOCK, F.pmod(F.xxhash64(key), F.lit(blocks))).join(words, _BLOCK, "left")
    all_set = F.lit(True)
    for i in range(WORDS):
        mask = _mask(F.col(key), i)
        all_set = all_set & F.coalesce(F.col(_WORDS[i]).bitwiseAND(mask) == mask, F.lit(False))
    return rows.withColumn("possible", all_set).drop(_BLOCK, *_WORDS)
