"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Makes Spark remove the shuffle files of a query on all executors when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What is to be deleted: path -> session, and the name under which a bucketed table is in the session's catalog.
_written: dict[str, tuple[SparkSession, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the context's; without either there is no folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = tempfile.mkdtemp(prefix="tarn-shared-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(folder)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


@contextmanager
def _no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, as nothing reads them again; Spark would keep them until
    the driver collects garbage. While a query runs they stay, so a lost executor costs its tasks only."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    with _no_leftovers(spark):
        df.write.parquet(path)
    _written[path] = spark, None
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    return out


def cut_slices(part: Callable[[int], DataFrame], slices: int, name: str, **options: str) -> DataFrame:
    """cut() of part(0), part(1), ... in one table, one after the other: the shuffle files of a slice go before the next one begins,
    so that no more than a slice's are there at a time."""
    path = None
    for i in range(max(slices, 1)):
        df = part(i)
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
        _written[path] = spark, None
        with _no_leftovers(spark):
            df.write.options(**options).mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    return out


def cut_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """cut() into as many buckets of key as shuffles have partitions: joins on key then leave this side where it is."""
    spark = df.sparkSession
    run = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/tarn-{name}-{run}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tarn_{name.replace('-', '_')}_{run}"
    with _no_leftovers(spark):
        df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    _written[path] = spark, table
    out = spark.table(table)
    out._tarn_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_tarn_path", None)
    if path in _written:
        _delete(path)


def _delete(path: str) -> None:
    spark, table = _written.pop(path)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def drop_all() -> None:
    """Deletes every table that cut() wrote and drop() didn't; also runs when the driver ends."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may have ended first; the shared folder's owner then cleans up
            continue


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges (a, b: long) -> (node, component), component being the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round moves as many rows as there are
    edges, never pairs of a group, and ends in a table of the shared folder. Nodes without an edge aren't returned.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = cut(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        drop(links)
        links, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """connected_components() over the edges that found (node, component) comes from and the edges more (a, b)."""
    for end in ("a", "b"):
        more = more.join(found.select(F.col("node").alias(end), F.col("component").alias("of")), end, "left")
        more = more.withColumn(end, F.coalesce("of", end)).drop("of")
    joined = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("all"))
    alone = joined.join(found, "component", "left_anti").select(F.col("component").alias("node"), F.col("all").alias("component"))
    return found.join(joined, "component", "left").select("node", F.coalesce("all", "component").alias("component")).unionByName(alone)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1_000_003)).first())
