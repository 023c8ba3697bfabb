"""Directory listings as a Spark data source, event flags, exclusions, and work resolution."""

from __future__ import annotations

import os
import stat as st

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarn.functions.text import parent

#: Names of folders whose contents are left out (fixed values).
EXCLUDED = (
    ".git", "node_modules", ".venv", ".build", ".Trash", ".cache", "Caches", "DerivedData", ".npm", ".cargo", ".rustup", "Library",
)

#: Bits of an event's flags (public FSEvents constants).
FLAGS = {
    "must_scan": 0x00000001,
    "user_dropped": 0x00000002,
    "kernel_dropped": 0x00000004,
    "wrapped": 0x00000008,
    "history_done": 0x00000010,
    "root_changed": 0x00000020,
    "created": 0x00000100,
    "removed": 0x00000200,
    "renamed": 0x00000800,
    "modified": 0x00001000,
    "is_file": 0x00010000,
    "is_dir": 0x00020000,
    "is_symlink": 0x00040000,
}
PROBE, SHALLOW, RECURSIVE = 0, 1, 2


def excluded(path: Column | str) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def has_flag(flags: Column | str, name: str) -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return flags.bitwiseAND(FLAGS[name]) != 0


def ingest_events(events: DataFrame) -> DataFrame:
    """events (path, flags, event_id, ...) without excluded paths, with rescan_recursive and source_cursor."""
    whole = has_flag("flags", "must_scan") | has_flag("flags", "user_dropped") | has_flag("flags", "kernel_dropped")
    whole = whole | (has_flag("flags", "is_dir") & (has_flag("flags", "created") | has_flag("flags", "renamed")))
    rows = events.where(~excluded("path"))
    return rows.withColumns({"rescan_recursive": whole, "source_cursor": F.col("event_id")})


_SCHEMA = "path string, kind string, dev bigint, ino bigint, size bigint, mtime_ns bigint, birthtime_ns bigint, nlink bigint"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def _row(path: str) -> tuple | None:
    try:
        s = os.lstat(path)
    except FileNotFoundError:
        return None
    kind = "dir" if st.S_ISDIR(s.st_mode) else "symlink" if st.S_ISLNK(s.st_mode) else "file"
    born = int(getattr(s, "st_birthtime", 0) * 1e9)
    return path, kind, s.st_dev, s.st_ino, s.st_size if kind == "file" else 0, s.st_mtime_ns, born, s.st_nlink


def _walk(folder: str, deep: bool):
    try:
        names = sorted(os.listdir(folder))
    except (FileNotFoundError, NotADirectoryError):
        return
    for name in names:
        row = None if name in EXCLUDED else _row(os.path.join(folder, name))
        if row:
            yield row
            if deep and row[1] == "dir":
                yield from _walk(row[0], True)


class _Listing(DataSourceReader):
    def __init__(self, root: str, deep: bool) -> None:
        self.root, self.deep = root, deep

    def partitions(self) -> list[InputPartition]:
        below = [r[0] for r in _walk(self.root, False) if r[1] == "dir"] if self.deep else []
        return [_Folder(self.root, False), *[_Folder(p, True) for p in below]]

    def read(self, partition: _Folder):
        if partition.path == self.root and not partition.deep and (own := _row(self.root)):
            yield own
        yield from _walk(partition.path, partition.deep)


class FileListing(DataSource):
    """spark.read.format("tarn_files").option("recursive", ...).load(folder): lstat of a folder and what is in it.

    Links aren't followed, and excluded names are left out. Each folder of the first level is a partition. For folders that
    every executor can reach."""

    @classmethod
    def name(cls) -> str:
        return "tarn_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Listing:
        return _Listing(self.options["path"].rstrip("/") or "/", self.options.get("recursive", "true") == "true")


class _Events(DataSourceStreamReader):
    """Rows of an append-only event log in text lines: event_id, flags and path, tab-separated; the offset is a byte."""

    def __init__(self, path: str, since: int) -> None:
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        return {"at": os.path.getsize(self.path) if os.path.exists(self.path) else self.since}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Folder(f"{start['at']}:{end['at']}", False)]

    def read(self, partition: _Folder):
        start, end = map(int, partition.path.split(":"))
        if end <= start:
            return
        with open(self.path, "rb") as f:
            f.seek(start)
            for line in f.read(end - start).decode("utf-8", "replace").splitlines():
                event_id, flags, path = line.split("\t", 2)
                yield int(event_id), int(flags), path

    def commit(self, end: dict) -> None:
        return None


class EventLog(DataSource):
    """spark.readStream.format("tarn_events").load(file): file-system events, resumed from the checkpoint's offset."""

    @classmethod
    def name(cls) -> str:
        return "tarn_events"

    def schema(self) -> str:
        return "event_id bigint, flags bigint, path string"

    def streamReader(self, schema) -> _Events:
        return _Events(self.options["path"], int(self.options.get("since", "0")))


def register(spark) -> None:
    spark.dataSource.register(FileListing)
    spark.dataSource.register(EventLog)


def removals(gone: DataFrame, entries_now: DataFrame, objects_now: DataFrame) -> DataFrame:
    """path of every entry that goes with the paths in `gone`: themselves, and for folders all that is below.

    Each entry is joined by its ancestors, so no range join is needed."""
    from tarn.functions.text import ancestors

    kinds, entries_now = objects_now.select("oid", "kind"), entries_now.select("path", "oid")
    tops = gone.select("path").distinct().join(entries_now, "path").join(kinds, "oid").select(F.col("path").alias("top"), "kind")
    each = entries_now.select("path", F.explode(ancestors("path")).alias("top"))
    return each.join(tops, "top").where((F.col("kind") == "dir") | (F.col("path") == F.col("top"))).select("path").distinct()


def reconcile(listed: DataFrame, folders: DataFrame, entries_now: DataFrame, objects_now: DataFrame) -> DataFrame:
    """op, path, stat for the folders that were listed: an upsert for each listed path, and a removal for each cataloged
    child that is gone, with all below it. listed: path and lstat columns; folders: path of each folder that was read."""
    ups = listed.where(~excluded("path")).select(
        F.lit("upsert").alias("op"), "path", F.struct("kind", "dev", "ino", "size", "mtime_ns", "birthtime_ns", "nlink").alias("stat")
    )
    known = entries_now.withColumn("folder", parent("path")).join(folders.select(F.col("path").alias("folder")), "folder", "left_semi")
    missing = known.join(listed.select("path"), "path", "left_anti").select("path")
    gone = removals(missing, entries_now, objects_now)
    none = F.lit(None).cast(ups.schema["stat"].dataType)
    return ups.unionByName(gone.select(F.lit("remove").alias("op"), "path", none.alias("stat")))


def resolve(work: DataFrame, stats: DataFrame, entries_now: DataFrame, objects_now: DataFrame) -> DataFrame:
    """work (path, kind) with `action`: skip, remove, upsert, shallow or recursive.

    A probed folder is read one level if it is the one cataloged there, and whole otherwise. stats: lstat rows of the work
    paths that exist."""
    now = stats.select("path", F.col("kind").alias("fs_kind"), "dev", "ino")
    known = entries_now.select("path", "oid").join(objects_now.select("oid", "kind", "dev", "ino"), "oid").where("kind = 'dir'")
    known = known.select("path", F.col("dev").alias("k_dev"), F.col("ino").alias("k_ino"))
    rows = work.join(now, "path", "left").join(known, "path", "left")
    same = F.coalesce((F.col("dev") == F.col("k_dev")) & (F.col("ino") == F.col("k_ino")), F.lit(False))
    action = (
        F.when(excluded("path"), "skip")
        .when(F.col("fs_kind").isNull(), "remove")
        .when(F.col("fs_kind") != "dir", "upsert")
        .when(F.col("kind") == RECURSIVE, "recursive")
        .when((F.col("kind") == SHALLOW) | same, "shallow")
        .otherwise("recursive")
    )
    return rows.select("path", "kind", action.alias("action"))
