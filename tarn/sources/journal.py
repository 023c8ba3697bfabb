"""The change journal as Parquet segments with a manifest: append, replay, scoped repair, cursors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.schema import JOURNAL


class JournalError(RuntimeError):
    pass


class Journal:
    """A folder of segments, one folder per append, and one small manifest row each: segment, first, last, batch.

    An append is visible once its manifest row is written, which comes last. It is written under a name with an underscore, which
    readers of folders pass over, and renamed when it is whole; what a writer that died in between has left is hidden again by
    recover(), which each append and stream() begin with. Appends have one writer. The distinct paths of a segment are kept beside it
    in a table of their own, so that a segment that can't be read any more still tells which paths to look at again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def manifest(self) -> DataFrame:
        schema = "segment string, first long, last long, batch long"
        fs, path = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/manifest")

    def last_lsn(self) -> int:
        return self.manifest().agg(F.max("last")).first()[0] or 0

    def append(self, changes: DataFrame, batch: int | None = None) -> tuple[int, int]:
        """Numbers changes (column `seq` orders them) after the last lsn and commits them; returns the range.

        A batch number that the manifest already has is not appended again. An empty append is an error.
        """
        self.recover()
        done = self.manifest()
        if batch is not None and (row := done.where(F.col("batch") == batch).select("first", "last").first()):
            return row["first"], row["last"]
        base = self.last_lsn()
        count = changes.count()
        if not count:
            raise JournalError("empty append")
        staging = f"{self.root}/_staging"
        numbered = _number(changes, base, staging)
        segment = f"segment-{base + 1:020d}-{uuid.uuid4().hex[:8]}"
        numbered.write.parquet(f"{self.root}/_new-{segment}")
        written = self.spark.read.schema(JOURNAL).parquet(f"{self.root}/_new-{segment}")
        written.select("path").distinct().write.parquet(f"{self.root}/_paths-{segment}")
        fs, path = self._fs(f"{self.root}/_new-{segment}")
        fs.rename(path, self._fs(f"{self.root}/{segment}")[1])
        row = json.dumps({"segment": segment, "first": base + 1, "last": base + count, "batch": batch})
        fs, path = self._fs(staging)
        fs.delete(path, True)
        fs, path = self._fs(f"{self.root}/manifest/{segment}.json")
        out = fs.create(path, False)
        out.write(bytearray(row.encode()))
        out.close()
        return base + 1, base + count

    def recover(self) -> list[str]:
        """Hides segments that no manifest row names, and returns their names."""
        fs, path = self._fs(self.root)
        if not fs.exists(path):
            return []
        there = [x.getPath().getName() for x in fs.listStatus(path)]
        there = [name for name in there if name.startswith("segment-")]
        named = {r["segment"] for r in self.manifest().select("segment").collect()} if there else set()
        torn = [name for name in there if name not in named]
        for name in torn:
            fs.rename(self._fs(f"{self.root}/{name}")[1], self._fs(f"{self.root}/_torn-{name}")[1])
        return torn

    def read(self, from_lsn: int = 1, to_lsn: int | None = None) -> DataFrame:
        """Records of a range; segments outside it aren't opened."""
        rows = self.manifest().where(F.col("last") >= from_lsn)
        rows = rows if to_lsn is None else rows.where(F.col("first") <= to_lsn)
        paths = [f"{self.root}/{r['segment']}" for r in rows.collect()]
        if not paths:
            return self.spark.createDataFrame([], JOURNAL)
        out = self.spark.read.schema(JOURNAL).parquet(*paths).where(F.col("lsn") >= from_lsn)
        return out if to_lsn is None else out.where(F.col("lsn") <= to_lsn)

    def replay(self, from_lsn: int = 1) -> DataFrame:
        return self.read(from_lsn).orderBy("lsn")

    def gaps(self) -> DataFrame:
        """lsn after which numbers are missing or doubled; empty for a sound journal."""
        edges = self.manifest().select("first", "last").withColumn("prev", F.lag("last", 1, 0).over(Window.orderBy("first")))
        return edges.where("first <> prev + 1").select(F.col("prev").alias("lsn"))

    def paths(self, segment: str) -> DataFrame:
        """The distinct paths that a segment was written with; the segment itself isn't opened."""
        return self.spark.read.schema("path string").parquet(f"{self.root}/_paths-{segment}")

    def quarantine(self, segment: str, paths: DataFrame | None, current: DataFrame) -> DataFrame:
        """Drops a corrupt segment, fills its numbers with removals of the paths it named (those kept at its append, unless others
        are given), and returns what must be appended to bring those paths up to date: their present state, nothing for those
        that are gone."""
        row = self.manifest().where(F.col("segment") == segment).first()
        if row is None:
            raise JournalError(f"no segment {segment}")
        paths = self.paths(segment) if paths is None else paths
        filler = paths.select("path").distinct().withColumns({"op": F.lit("remove"), "source": F.lit("repair"), "seq": F.col("path")})
        n = row["last"] - row["first"] + 1
        filler = _number(filler, row["first"] - 1, f"{self.root}/_staging").where(F.col("lsn") <= row["last"])
        short = n - filler.count()
        if short > 0:
            pad = self.spark.range(short).select((F.lit(row["last"] - short + 1) + F.col("id")).alias("lsn"), F.lit("remove").alias("op"), F.lit("").alias("path"), F.lit("repair").alias("source"))
            filler = filler.unionByName(pad, allowMissingColumns=True)
        filler = filler.select(*[f.name for f in self.spark.createDataFrame([], JOURNAL).schema])
        fs, path = self._fs(f"{self.root}/{segment}")
        fs.rename(path, self._fs(f"{self.root}/_quarantine-{segment}")[1])
        filler.write.parquet(f"{self.root}/{segment}")
        return current.join(paths.select("path").distinct(), "path", "left_semi")

    def stream(self) -> DataFrame:
        """Committed segments as a stream, in the order of their commits' files; staged, torn and quarantined ones are hidden."""
        self.recover()
        return self.spark.readStream.schema(JOURNAL).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").parquet(self.root)


def _number(changes: DataFrame, base: int, staging: str) -> DataFrame:
    """lsn = base + place by seq, without one task that orders everything: partitions are ranged by seq and numbered within,
    written, and moved on by the sizes of those before, one row per partition."""
    spark = changes.sparkSession
    ranged = changes.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)
    ranged.write.mode("overwrite").parquet(staging)
    ranged = spark.read.schema(ranged.schema).parquet(staging)
    sizes = ranged.groupBy("_p").agg(F.max("_i").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    out = ranged.join(F.broadcast(sizes), "_p").withColumn("lsn", (F.lit(base) + F.col("_at") + F.col("_i")).cast("long"))
    have = set(out.columns)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], JOURNAL).schema}
    return out.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


class Cursor:
    """A durable source position; missing or unreadable reads as None, so that events are delivered again."""

    def __init__(self, journal: Journal, name: str = "cursor") -> None:
        self.journal, self.path = journal, f"{journal.root}/{name}.json"

    def get(self) -> int | None:
        fs, path = self.journal._fs(self.path)
        if not fs.exists(path):
            return None
        try:
            rows = self.journal.spark.read.schema("position long").json(self.path).collect()
            return rows[0]["position"] if rows else None
        except Exception:  # any damage means: deliver again
            return None

    def set(self, position: int) -> None:
        fs, path = self.journal._fs(self.path)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"position": position}).encode()))
        out.close()
