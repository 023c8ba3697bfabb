"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Sample:
    texts: list[str]
    labels: list[int]
    #: Labelled rows of class 0 and 1 that may be learned from, sampled or not.
    totals: tuple[int, int]


def fold(modulus: int) -> Column:
    """crc32 of the doc_id's decimal digits, modulo modulus."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int, max_bytes: int, seed: int = 42
) -> Sample:
    """At most per_class texts of either class, in a seeded order of their doc_id, of at most max_bytes / (2 * per_class) * 8
    bytes each and max_bytes in all.

    Only rows of `labels` that may_learn holds for are read; labels other than 0 and 1 are ignored, repeated rows count
    once. Of rows with one doc_id the smallest text counts. A text over the bound of one is skipped and those after it are
    still taken; the total is kept within bounds by ending each class where half of max_bytes is full. The chosen doc_ids, at
    most 2 * per_class, are all that is broadcast, and their texts all that is collected.
    """
    longest = max(1, max_bytes * 4 // per_class)
    known = labels.where(may_learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    chosen = known.where("y = 0").orderBy("draw", "doc_id").limit(per_class)
    chosen = chosen.unionByName(known.where("y = 1").orderBy("draw", "doc_id").limit(per_class))
    body = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select("doc_id", body).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "draw", "y").agg(F.min("text").alias("text")).where(F.octet_length("text") <= longest)
    upto = Window.partitionBy("y").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = texts.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= max_bytes // 2)
    rows = texts.orderBy("draw", "doc_id").select("text", "y").collect()
    return Sample([r["text"] for r in rows], [r["y"] for r in rows], (totals.get(0, 0), totals.get(1, 0)))
