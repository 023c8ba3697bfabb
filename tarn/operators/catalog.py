"""The catalog: a window fold of the change journal into objects and entries, and scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.plans.scope import under


def _by_path() -> Window:
    return Window.partitionBy("path").orderBy("lsn")


def _by_file() -> Window:
    return Window.partitionBy("dev", "ino").orderBy("lsn")


def _later(value: Column, *keys: str) -> Column:
    """The first value that isn't null in the rows after this one, by lsn. Rows are taken from the last one on, in frames that grow:
    one that ends with the partition is summed up anew for each row, the square of the partition's rows in all."""
    backwards = Window.partitionBy(*keys).orderBy(F.desc("lsn")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(backwards)


# ---------------------------------------------------------------- fold


def generations(journal: DataFrame) -> DataFrame:
    """Upserts with the object they belong to: oid, ends (lsn at which the object is replaced, or null), clears.

    A file identity (dev, ino) is a new object when its birth time or kind changes. oid is the lsn that started the object,
    so no global numbering is needed. `clears` marks upserts that drop indexed content: the first, and changes of size or
    mtime. One shuffle by identity.
    """
    ups = journal.where("op = 'upsert'").select("lsn", "wall_time_ns", "path", "stat.*")
    born = F.struct("birthtime_ns", "kind")
    ups = ups.withColumn("fresh", ~born.eqNullSafe(F.lag(born).over(_by_file())))
    changed = ~F.struct("size", "mtime_ns").eqNullSafe(F.lag(F.struct("size", "mtime_ns")).over(_by_file()))
    start = F.when(F.col("fresh"), F.col("lsn"))
    return ups.withColumns(
        {
            "oid": F.last(start, ignorenulls=True).over(_by_file().rowsBetween(Window.unboundedPreceding, 0)),
            "ends": _later(start, "dev", "ino"),
            "clears": F.col("fresh") | changed,
        }
    )


def bindings(journal: DataFrame, gens: DataFrame | None = None) -> DataFrame:
    """Every upsert, removal and content change with what its path names after it: lsn, op, path, oid, ends, until, before.

    oid is null after a removal; content rows carry the binding as of their lsn. A binding lasts from lsn to `until`
    (exclusive; null: still). `before` is the object that the path named just before. One shuffle by path.
    """
    gens = generations(journal) if gens is None else gens
    events = gens.select("lsn", "wall_time_ns", F.lit("upsert").alias("op"), "path", F.struct("oid", "ends").alias("b"))
    gone = F.struct(F.lit(None).cast("long").alias("oid"), F.lit(None).cast("long").alias("ends"))
    events = events.unionByName(
        journal.where("op = 'remove'").select("lsn", "wall_time_ns", "op", "path", gone.alias("b"))
    ).unionByName(
        journal.where("op = 'content'").select("lsn", "wall_time_ns", "op", "path", F.lit(None).cast("struct<oid:long,ends:long>").alias("b"))
    )
    moves = F.when(F.col("op") != "content", F.struct("lsn", "wall_time_ns"))
    events = events.withColumns(
        {
            "now": F.last("b", ignorenulls=True).over(_by_path().rowsBetween(Window.unboundedPreceding, 0)),
            "was": F.last("b", ignorenulls=True).over(_by_path().rowsBetween(Window.unboundedPreceding, -1)),
            "next": _later(moves, "path"),
        }
    )
    live = lambda b: F.when(b["ends"].isNull() | (b["ends"] > F.col("lsn")), b["oid"])
    events = events.withColumns(
        {
            "oid": live(F.col("now")),
            "ends": F.col("now.ends"),
            "until": F.least("next.lsn", "now.ends"),
            "next_wall": F.col("next.wall_time_ns"),
            "before": live(F.col("was")),
        }
    )
    # a run of the same object on a path starts where the object before it differs
    run = F.when((F.col("op") != "content") & ~F.col("oid").eqNullSafe(F.col("was.oid")), F.col("lsn"))
    events = events.withColumn("attach_lsn", F.last(run, ignorenulls=True).over(_by_path().rowsBetween(Window.unboundedPreceding, 0)))
    return events.select("lsn", "wall_time_ns", "op", "path", "oid", "ends", "until", "next_wall", "before", "attach_lsn")


def entries(journal: DataFrame) -> DataFrame:
    """path, oid, attach_lsn of the paths that are bound now."""
    bound = bindings(journal).where("op = 'upsert' AND until IS NULL AND oid IS NOT NULL")
    return bound.select("path", "oid", "attach_lsn")


def objects(journal: DataFrame) -> DataFrame:
    """Objects that exist now, orphans (without any path) among them, with the content that still holds for them."""
    gens = generations(journal)
    binds = bindings(journal, gens)
    attrs = F.struct("kind", "dev", "ino", "birthtime_ns", "size", "mtime_ns", "nlink")
    base = gens.where("ends IS NULL").groupBy("oid").agg(
        F.max_by(attrs, "lsn").alias("a"), F.max(F.when(F.col("clears"), F.col("lsn"))).alias("cleared")
    )
    ups = binds.where("op = 'upsert' AND ends IS NULL AND oid IS NOT NULL")
    here = F.when(F.col("until").isNull(), F.struct("attach_lsn", "path"))
    paths = ups.groupBy("oid").agg(
        F.transform(F.array_sort(F.collect_list(here)), lambda s: s["path"]).alias("entry_paths"), F.max("next_wall").alias("left_at")
    )
    sets = binds.where("op = 'content' AND oid IS NOT NULL").select("lsn", "oid").join(
        journal.where("op = 'content'").select("lsn", "content_hash", "hints_hash", "state"), "lsn"
    )
    content = sets.groupBy("oid").agg(F.max_by(F.struct("content_hash", "hints_hash", "state"), "lsn").alias("c"), F.max("lsn").alias("set_at"))
    whole = base.join(paths, "oid", "left").join(content, "oid", "left")
    holds = F.col("set_at") > F.col("cleared")
    return whole.select(
        "oid",
        "a.*",
        "entry_paths",
        F.when(F.size("entry_paths") == 0, F.col("left_at")).alias("orphaned_at_ns"),
        F.when(holds, F.col("c.content_hash")).alias("content_hash"),
        F.when(holds, F.col("c.hints_hash")).alias("hints_hash"),
        F.when(holds, F.col("c.state")).alias("index_state"),
    )


def deltas(journal: DataFrame, after_lsn: int = 0) -> DataFrame:
    """lsn, path, old_oid, new_oid, and the new record's kind, size and mtime, of the changes after a watermark."""
    gens = generations(journal)
    record = gens.select("lsn", F.col("kind"), "size", "mtime_ns")
    rows = bindings(journal, gens).where("op <> 'content'").select("lsn", "path", F.col("before").alias("old_oid"), F.col("oid").alias("new_oid"))
    return rows.where(F.col("lsn") > after_lsn).join(record, "lsn", "left")


def as_of(journal: DataFrame, lsn: int) -> DataFrame:
    """The journal as it was after lsn: fold this for the catalog of that moment."""
    return journal.where(F.col("lsn") <= lsn)


def changed_since(journal: DataFrame, lsn: int) -> DataFrame:
    """Paths whose binding changed after lsn, with the last such change."""
    moved = bindings(journal).where((F.col("lsn") > lsn) & ~F.col("before").eqNullSafe(F.col("oid")) & (F.col("op") != "content"))
    return moved.groupBy("path").agg(F.max("lsn").alias("lsn"))


def touched_oids(delta_rows: DataFrame, objects_now: DataFrame) -> DataFrame:
    """oid, action of projections after a batch: `remove` if the object is gone or its content was cleared, else `refresh`."""
    ids = delta_rows.select(F.explode(F.array("old_oid", "new_oid")).alias("oid")).where("oid IS NOT NULL").distinct()
    now = objects_now.select("oid", F.col("content_hash").isNotNull().alias("has"))
    return ids.join(now, "oid", "left").select("oid", F.when(F.coalesce("has", F.lit(False)), "refresh").otherwise("remove").alias("action"))


def sweep(objects_now: DataFrame, now_ns: int, grace_ns: int) -> DataFrame:
    """Objects without those orphaned for longer than the grace."""
    return objects_now.where(F.col("orphaned_at_ns").isNull() | (F.col("orphaned_at_ns") > now_ns - grace_ns))


def invariant_violations(objects_now: DataFrame, entries_now: DataFrame) -> DataFrame:
    """rule, n of each broken rule; empty when the fold is sound. Each table is taken once: an object is a row for its identity and
    one for each path it lists, an entry is one, and rows of the same meet."""
    row = lambda what, a, b, path, **n: F.struct(
        F.lit(what).alias("what"), a.alias("a"), b.alias("b"), path.alias("path"),
        *[F.lit(n.get(k, 0)).cast("long").alias(k) for k in ("listed", "entry", "wrong")],
    )
    none = F.lit(None)
    orphan = F.coalesce(F.col("orphaned_at_ns").isNotNull() != (F.size("entry_paths") == 0), F.lit(False))
    identity = row("file", F.col("dev"), F.col("ino"), none.cast("string"), wrong=orphan.cast("long"))
    paths = F.coalesce("entry_paths", F.array().cast("array<string>"))
    listed = F.transform(paths, lambda p: row("path", F.col("oid"), none.cast("long"), p, listed=1))
    rows = objects_now.select(F.explode(F.concat(F.array(identity), listed)).alias("r"))
    rows = rows.unionByName(entries_now.select(row("path", F.col("oid"), none.cast("long"), F.col("path"), entry=1).alias("r"))).select("r.*")
    met = rows.groupBy("what", "a", "b", "path").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("listed", "entry", "wrong")])
    known = F.col("a").isNotNull() & F.col("path").isNotNull()  # nulls are equal to nothing
    rules = {
        "orphan has entries": F.sum("wrong"),
        "listed path maps elsewhere": F.sum(F.when(~known | (F.col("entry") == 0), F.col("listed"))),
        "entry not listed": F.sum(F.when(~known | (F.col("listed") == 0), F.col("entry"))),
        "identity not unique": F.count(F.when((F.col("what") == "file") & (F.col("n") > 1), 1)),
    }
    found = met.agg(F.array(*[F.struct(F.lit(rule).alias("rule"), n.alias("n")) for rule, n in rules.items()]).alias("r"))
    return found.select(F.explode("r").alias("r")).select("r.*").where("n > 0")


# ---------------------------------------------------------------- scans


def listing(entries_now: DataFrame, objects_now: DataFrame) -> DataFrame:
    """Live bindings with their objects, in byte order of the path."""
    return entries_now.join(objects_now.drop("entry_paths"), "oid").orderBy("path")


def subtree(entries_now: DataFrame, prefix: str) -> DataFrame:
    return entries_now.where(under(F.col("path"), prefix))


def children(entries_now: DataFrame, folder: str) -> DataFrame:
    """Entries one level below a folder."""
    skip = len(folder.rstrip("/")) + 2
    below = F.call_function("substring", F.col("path"), F.lit(skip))
    return subtree(entries_now, folder).where((below != "") & ~F.contains(below, F.lit("/")))


def by_path(entries_now: DataFrame, path: str) -> DataFrame:
    return entries_now.where(F.col("path") == path)


def by_oid(objects_now: DataFrame, oid: int) -> DataFrame:
    return objects_now.where(F.col("oid") == oid)


def by_file_id(objects_now: DataFrame, dev: int, ino: int) -> DataFrame:
    return objects_now.where((F.col("dev") == dev) & (F.col("ino") == ino))


def content_bindings(objects_now: DataFrame) -> DataFrame:
    """oid, content_hash, hints_hash of live objects with known content; hard links count once."""
    has = F.col("content_hash").isNotNull() & F.col("hints_hash").isNotNull() & (F.size("entry_paths") > 0)
    return objects_now.where(has).select("oid", "content_hash", "hints_hash")


def orphans(objects_now: DataFrame, now_ns: int, grace_ns: int) -> DataFrame:
    return objects_now.where(F.col("orphaned_at_ns") <= now_ns - grace_ns).select("oid")


def counts(entries_now: DataFrame, objects_now: DataFrame) -> DataFrame:
    """entry_count, object_count (with orphans)."""
    n_entries = entries_now.agg(F.count("*").alias("entry_count"))
    return n_entries.crossJoin(F.broadcast(objects_now.agg(F.count("*").alias("object_count"))))


def scoped_counts(entries_now: DataFrame, allowed: Column) -> DataFrame:
    """Distinct paths and objects that a scope shows."""
    return entries_now.where(allowed).agg(F.count("path").alias("entries"), F.countDistinct("oid").alias("objects"))
