"""The window fold against a sequential model, on random changelogs."""

import random

from pyspark.sql import functions as F

from tarn.operators import catalog
from tarn.schema import JOURNAL


def changelog(seed: int, n: int = 60):
    rng = random.Random(seed)
    rows = []
    for lsn in range(1, n + 1):
        path, op = f"/r/d{rng.randrange(3)}/f{rng.randrange(5)}", rng.choices(["upsert", "remove", "content"], [6, 2, 2])[0]
        stat = None
        if op == "upsert":
            stat = ("file", 1, rng.randrange(6), rng.randrange(2), rng.randrange(2), int(rng.random() < 0.1), 1)
        content = ("h%d" % lsn, "x", "complete") if op == "content" else (None, None, None)
        rows.append((lsn, lsn * 10, "t", op, path, stat, *content))
    return rows


def sequential(rows):
    """Applies one change after the other."""
    objects, by_path, by_file = {}, {}, {}

    def unbind(path, wall):
        oid = by_path.pop(path, None)
        if oid is not None:
            o = objects[oid]
            o["paths"].remove(path)
            if not o["paths"]:
                o["orphaned"] = wall

    for lsn, wall, _, op, path, stat, h, _, _ in rows:
        if op == "remove":
            unbind(path, wall)
        elif op == "content":
            if path in by_path:
                objects[by_path[path]]["content"] = h
        else:
            kind, dev, ino, size, mtime, birth, _ = stat
            oid = by_file.get((dev, ino))
            if oid is not None and (objects[oid]["birth"], objects[oid]["kind"]) != (birth, kind):
                for p in objects[oid]["paths"]:
                    del by_path[p]
                del objects[oid]
                oid = None
            if oid is None:
                oid = by_file[dev, ino] = lsn
                objects[oid] = {"birth": birth, "kind": kind, "size": size, "mtime": mtime, "paths": [], "content": None, "orphaned": None}
            o = objects[oid]
            if (o["size"], o["mtime"]) != (size, mtime):
                o["size"], o["mtime"], o["content"] = size, mtime, None
            if by_path.get(path) != oid:
                unbind(path, wall)
                by_path[path] = oid
                o["paths"].append(path)
            o["orphaned"] = None
    return objects, by_path


def test_fold_equals_sequential_application(spark):
    for seed in range(8):
        rows = changelog(seed)
        journal = spark.createDataFrame(rows, JOURNAL).cache()
        objects, by_path = sequential(rows)
        got = {
            r["oid"]: {"birth": r["birthtime_ns"], "kind": r["kind"], "size": r["size"], "mtime": r["mtime_ns"], "paths": r["entry_paths"], "content": r["content_hash"], "orphaned": r["orphaned_at_ns"]}
            for r in catalog.objects(journal).collect()
        }
        assert got == objects, seed
        assert {r["path"]: r["oid"] for r in catalog.entries(journal).collect()} == by_path
        assert catalog.invariant_violations(catalog.objects(journal), catalog.entries(journal)).count() == 0
        half = {r["path"]: r["oid"] for r in catalog.entries(catalog.as_of(journal, 30)).collect()}
        assert half == sequential(rows[:30])[1]


def test_no_frame_is_summed_up_anew_for_each_row(spark):
    """Frames that end with their partition cost the square of its rows, and an identity or a path has many."""
    journal = spark.createDataFrame(changelog(3), JOURNAL)
    for fold in (catalog.objects, catalog.entries, catalog.deltas):
        assert "unboundedfollowing" not in fold(journal)._jdf.queryExecution().optimizedPlan().toString().lower(), fold


def test_deltas_replay_to_the_catalog(spark):
    rows = changelog(99)
    journal = spark.createDataFrame(rows, JOURNAL)
    state = {}
    for r in catalog.deltas(journal).orderBy("lsn").collect():
        state[r["path"]] = r["new_oid"]
    live = {r["path"]: r["oid"] for r in catalog.entries(journal).collect()}
    assert {p: o for p, o in state.items() if p in live} == live


def test_invariants_take_each_table_once(spark):
    objects = spark.createDataFrame(
        [(1, 1, 1, ["/a", "/b"], None), (2, 1, 1, [], None), (3, 1, 2, ["/c"], 5), (4, None, None, None, None), (5, None, None, [None], None)],
        "oid long, dev long, ino long, entry_paths array<string>, orphaned_at_ns long",
    )
    entries = spark.createDataFrame([("/a", 1), ("/b", 2), ("/c", 3), ("/d", 1), (None, 5)], "path string, oid long")
    found = catalog.invariant_violations(objects, entries)
    want = {"orphan has entries": 2, "listed path maps elsewhere": 2, "entry not listed": 3, "identity not unique": 2}
    assert {r["rule"]: r["n"] for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_empty_journal(spark):
    empty = spark.createDataFrame([], JOURNAL)
    assert catalog.objects(empty).count() == 0 and catalog.entries(empty).count() == 0 and catalog.deltas(empty).count() == 0


def test_scans(spark):
    entries = spark.createDataFrame([("/a", 1, 1), ("/a/b", 2, 2), ("/a/b/c", 3, 3), ("/ab", 4, 4)], "path string, oid long, attach_lsn long")
    names = lambda df: {r["path"] for r in df.collect()}
    assert names(catalog.subtree(entries, "/a")) == {"/a", "/a/b", "/a/b/c"}
    assert names(catalog.children(entries, "/a")) == {"/a/b"} and names(catalog.children(entries, "/")) == {"/a", "/ab"}
    assert catalog.scoped_counts(entries, F.lit(True)).first()["objects"] == 4
