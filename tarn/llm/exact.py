"""Exact deduplication over an extendible-hash index in shared files. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.bloom import bloom_filter, possible_hits
from tarn.llm.shared import cut

#: Keys that a bucket holds before the directory doubles.
BUCKET_ENTRIES = 16_384
MAX_DEPTH = 48
#: Times that the directory may double beyond the depth at which its buckets would hold all keys if these were spread evenly.
DOUBLINGS = 16
#: Directory rows up to which the directory is sent to every executor; beyond it the lookup is a shuffled join.
BROADCAST_BUCKETS = 100_000
_KEY, _BODY, _PREFIX = "tarn key hash", "tarn body", "tarn prefix"


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """keys (_KEY, distinct) -> the directory and its depth: a row (_PREFIX, bucket, depth) for each first `depth` bits of a key.

    The directory starts at one bucket that would hold all keys if they were few, at the depth that their number asks for
    otherwise, and doubles while a bucket is overfull. As in extendible hashing, only overfull buckets split: the slots
    below a bucket that was not overfull at a smaller depth all point to it. A bucket is a range of keys.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count() / bucket_entries))))
    bits = min(MAX_DEPTH, depth + DOUBLINGS)
    counted = cut(keys.groupBy(_prefix(F.col(_KEY), bits).alias("p")).count(), "key-ranges")
    levels = []
    while True:
        level = counted.groupBy(F.shiftrightunsigned("p", bits - depth).alias(f"p{depth}")).agg(F.sum("count").alias(f"n{depth}"))
        levels.append((depth, level))
        if (level.agg(F.max(f"n{depth}")).first()[0] or 0) <= bucket_entries or depth >= bits:
            break
        depth += 1
    slots = counted.select(F.shiftrightunsigned("p", bits - depth).alias(_PREFIX)).distinct()
    local, bucket = F.lit(depth), F.col(_PREFIX)
    for d, level in reversed(levels[:-1]):
        slots = slots.withColumn(f"p{d}", F.shiftrightunsigned(_PREFIX, depth - d)).join(level, f"p{d}")
        local = F.when(F.col(f"n{d}") <= bucket_entries, F.lit(d)).otherwise(local)
        bucket = F.when(F.col(f"n{d}") <= bucket_entries, F.col(f"p{d}")).otherwise(bucket)
    return cut(slots.select(_PREFIX, bucket.alias("bucket"), local.alias("depth")), "directory"), depth


def _looked_up(rows: DataFrame, directory: tuple[DataFrame, int]) -> DataFrame:
    """rows (_KEY) with their bucket and depth."""
    slots, depth = directory
    slots = F.broadcast(slots) if depth <= math.log2(BROADCAST_BUCKETS) else slots
    return rows.withColumn(_PREFIX, _prefix(F.col(_KEY), depth)).join(slots, _PREFIX).drop(_PREFIX)


def build_chains(rows: DataFrame) -> DataFrame:
    """rows (bucket, depth, _KEY, _BODY, doc_id) -> a bucket's chains: bucket, depth, _KEY, _BODY, group_size, keep_id, chain.

    Texts with one key are told apart by their bytes, as grouping compares them, and chained in that order; `chain` is a text's
    place, 0 nearly always. Copies meet on the map side, so a hot text is a row per task. The task that owns a range of
    buckets, which is one of keys, writes their chains to the shared folder, in order.
    """
    entries = rows.groupBy("bucket", "depth", _KEY, _BODY).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    entries = entries.repartitionByRange(F.col("bucket") / F.pow(F.lit(2.0), "depth"), _KEY)
    chains = Window.partitionBy("bucket", "depth", _KEY).orderBy(_BODY)
    return cut(entries.withColumn("chain", F.row_number().over(chains) - 1), "chains")


def exact_dedup(docs: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """All columns of docs, and keep_id, group_size, kept, text_sha256, bucket, depth, chain; one row per input row.

    A row's key, the XXH64 of its text, leads through the directory to its bucket. Keys that only one row has are settled
    there: nothing else can be equal. A Bloom filter of the other keys picks the rows that need more; these go to their
    bucket's owner and along the chain of their key, whose texts are compared with theirs byte by byte.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays; rows whose doc_id is null stay only
    if all of their group are null. Repeated rows (same doc_id and text) all carry kept = true, as they can't be told
    apart; keep_documents() leaves one of them. Columns of docs that are named like an added one are replaced, others stay.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256", "bucket", "depth", "chain"]
    body = F.coalesce("text", F.lit(""))
    keys = cut(docs.select(F.xxhash64(body).alias(_KEY)).groupBy(_KEY).agg(F.count("*").alias("n")), "keys")
    directory = build_directory(keys.select(_KEY), bucket_entries)
    several = keys.where("n > 1").select(_KEY)
    n = several.count()
    rows = docs.drop(*added).withColumnRenamed("possible", "tarn possible").withColumns({_KEY: F.xxhash64(body), "text_sha256": F.sha2(body, 256)})
    rows = possible_hits(_looked_up(rows, directory), _KEY, bloom_filter(several, _KEY, n), n)
    single = rows.where(~F.col("possible")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "chain": F.lit(0)})
    again = rows.where("possible").withColumn(_BODY, body)
    chains = build_chains(again).select("bucket", "depth", _KEY, F.col(_BODY).alias("tarn entry"), "group_size", "keep_id", "chain")
    found = again.join(chains, ["bucket", "depth", _KEY]).where(F.col(_BODY) == F.col("tarn entry"))
    out = single.unionByName(found.select(*single.columns)).drop("possible", _KEY)
    out = out.withColumnRenamed("tarn possible", "possible")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    kept = exact_dedup(docs).where("kept").select(*docs.columns)
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
