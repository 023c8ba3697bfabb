"""The tables of a test folder as a catalog, a vector plane and a journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import extension

EPOCH_NS, HOUR_NS = 1_704_067_200_000_000_000, 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as catalog rows: oid, path, kind, size, mtime_ns, index_state, content_hash, text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = F.when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 1, "complete").when(F.col("quality").isNotNull(), "partial")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("oid"),
        path.alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(EPOCH_NS) + F.col("doc_id") * HOUR_NS).alias("mtime_ns"),
        state.alias("index_state"),
        F.sha2("text", 256).alias("content_hash"),
        "text",
    )


def entries(rows: DataFrame) -> DataFrame:
    return rows.select("path", "oid", F.col("oid").alias("attach_lsn"))


def objects(rows: DataFrame) -> DataFrame:
    return rows.select(
        "oid", "kind", F.lit(1).cast("long").alias("dev"), F.col("oid").alias("ino"), F.lit(0).cast("long").alias("birthtime_ns"),
        "size", "mtime_ns", F.lit(1).cast("long").alias("nlink"), F.array("path").alias("entry_paths"),
        F.lit(None).cast("long").alias("orphaned_at_ns"), "content_hash", F.sha2(extension("path"), 256).alias("hints_hash"), "index_state",
    )


def content(rows: DataFrame) -> DataFrame:
    """oid, text, symbols of the corpus; a document's first word and its language are its symbols."""
    first = F.regexp_extract("text", r"[A-Za-z]+", 0)
    lang = F.element_at(F.split("path", "/"), 4)
    symbol = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(1).alias("line"))
    return rows.select("oid", "text", F.array(symbol(first, "function"), symbol(lang, "type")).alias("symbols"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("oid"), F.lit(0).alias("chunk_offset"), F.lit("given").alias("embedder_id"), F.lit(1).alias("embedder_version"), F.col("embedding").alias("vec")
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes: error removes, purchase sets content, others upsert. Their ids number them in the order of ts, so
    lsn is event_id + 1."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "content").otherwise("upsert")
    one = F.lit(1).cast("long")
    stat = F.struct(
        F.lit("file").alias("kind"), one.alias("dev"), k.alias("ino"), (k + 100).alias("size"),
        F.when(F.col("event_id") % 7 == 0, 2).otherwise(1).cast("long").alias("mtime_ns"),
        F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).cast("long").alias("birthtime_ns"), one.alias("nlink"),
    )
    is_content = op == "content"
    return events.select(
        (F.col("event_id") + 1).alias("lsn"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("wall_time_ns"),
        F.lit("events").alias("source"),
        op.alias("op"),
        F.concat(F.lit("/ev/u"), F.col("user_id").cast("string"), F.lit(".dat")).alias("path"),
        F.when(op == "upsert", stat).alias("stat"),
        F.when(is_content, F.concat(F.lit("h"), F.col("event_id").cast("string"))).alias("content_hash"),
        F.when(is_content, F.lit("x")).alias("hints_hash"),
        F.when(is_content, F.lit("complete")).alias("state"),
    )
