"""The content-addressed store of extraction records, and the gates before extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import extension
from tarn.schema import CONTENT_KEY

#: Failures after which a file is quarantined.
MAX_FAILURES = 3


def content_hash(raw: Column | str) -> Column:
    return F.sha2(raw, 256)


def hints_hash(path: Column | str, truncated: Column, processor: Column) -> Column:
    """Of what besides the bytes decides an extraction: extension, truncation, processor."""
    return F.sha2(F.concat_ws("\x1f", extension(path), truncated.cast("string"), processor), 256)


def storage_key(*columns: str) -> Column:
    """One digest of the five parts of a content key; all parts tell records apart."""
    return F.sha2(F.to_json(F.struct(*(columns or CONTENT_KEY))), 256)


def misses(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct keys that the store has no record of: all that is ever extracted, however many files share a content."""
    return wanted.dropDuplicates(CONTENT_KEY).join(store.select(CONTENT_KEY), CONTENT_KEY, "left_anti")


def lookup(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store, CONTENT_KEY, "left")


def put(store: DataFrame, records: DataFrame) -> DataFrame:
    """The store with records added; for a key that it has, the new one holds."""
    kept = store.join(records.select(CONTENT_KEY), CONTENT_KEY, "left_anti")
    return kept.unionByName(records.dropDuplicates(CONTENT_KEY))


def evict(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select(CONTENT_KEY), CONTENT_KEY, "left_anti")


def gate(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, size, mtime_ns) with `action`: skip if size and mtime are as indexed and a state is set, else index.

    known: path, size, mtime_ns, index_state.
    """
    before = known.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("index_state").alias("_state"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")) & F.col("_state").isNotNull()
    rows = files.join(before, "path", "left")
    return rows.withColumn("action", F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("index")).drop("_size", "_mtime", "_state")


def quarantine(records: DataFrame, failures: DataFrame) -> DataFrame:
    """records (content_hash, status) with the status after MAX_FAILURES failed attempts: failures (content_hash, n)."""
    rows = records.join(failures.select("content_hash", "n"), "content_hash", "left")
    return rows.withColumn("status", F.when(F.col("n") >= MAX_FAILURES, "quarantined").otherwise(F.col("status"))).drop("n")


def index(
    files: DataFrame, known: DataFrame, store: DataFrame, extract: Callable[[DataFrame], DataFrame], failed: Sequence[str] = ("corrupt",)
) -> tuple[DataFrame, DataFrame]:
    """One round of indexing: the gate, a lookup, extraction of what is missing, and the records put into the store.

    files: path, size, mtime_ns, the content key and what extract needs; known: see gate(); store: the content key, `failures`
    and what extract returns besides the key, `status` included. Returns the files that the gate lets through and the store
    afterwards; write that one, then lookup() gives each file its record. A record is reused unless its last attempt failed
    (a status of `failed`); attempts are counted in the store, and at MAX_FAILURES the status is quarantined for good. A
    content is extracted once, however many files have it.
    """
    due = gate(files, known).where("action = 'index'").drop("action")
    settled = store.where((F.coalesce("failures", F.lit(0)) == 0) | (F.col("failures") >= MAX_FAILURES))
    found = extract(misses(due, settled)).join(store.select(*CONTENT_KEY, F.col("failures").alias("_before")), CONTENT_KEY, "left")
    again = F.coalesce("_before", F.lit(0)) + 1
    found = found.withColumn("failures", F.when(F.col("status").isin(*failed), again).otherwise(0).cast("int")).drop("_before")
    stop = F.col("failures") >= MAX_FAILURES
    return due, put(store, found.withColumn("status", F.when(stop, "quarantined").otherwise(F.col("status"))))


def still_current(changes: DataFrame, stats: DataFrame) -> DataFrame:
    """Content changes whose file still has the size, mtime and identity it had when it was read."""
    keys = ["path", "size", "mtime_ns", "dev", "ino", "birthtime_ns"]
    return changes.join(stats.select(*keys), keys, "left_semi")
