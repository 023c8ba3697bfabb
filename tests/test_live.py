"""Standing queries and debouncing: batch, streams, and their agreement with recomputation."""

import random
from datetime import datetime, timedelta


from pyspark.sql import functions as F

from tarn.engine import Engine
from tarn.functions.vectors import HashEmbedder, embed_chunks
from tarn.operators.lexical import LexicalPlane
from tarn.operators.vector import VectorPlane, fuse
from tarn.plans.scope import Scope
from tarn.streaming import coalesce, live

_KIND = (
    "lsn long, path string, old_oid long, new_oid long, kind string, size long, mtime_ns long, index_state string, text string, "
    "symbols array<struct<name:string,kind:string,line:int>>"
)


def deltas(spark, n=200, seed=3):
    rng, rows, bound = random.Random(seed), [], {}
    for lsn in range(1, n + 1):
        path = f"/d{rng.randrange(3)}/p{rng.randrange(6)}"
        new = None if rng.random() < 0.25 else int(path[-1]) * 10 + int(path[2])
        kind = "dir" if rng.random() < 0.1 else "file"
        rows.append((lsn, path, bound.get(path), new, kind if new else None, rng.randrange(100), lsn, None, rng.choice(["alpha beta", "gamma", None]), []))
        bound[path] = new
    return spark.createDataFrame(rows, _KIND), rows


def test_incremental_equals_fresh(spark):
    frame, rows = deltas(spark)
    views = [live.View.of("big", "kMDItemFSSize >= 50"), live.View.of("text", '"alpha"', Scope.of("/d1")), live.View.of("never", 'semantic("x")')]
    observed = live.observations(frame, views).cache()
    members = {"big": set(), "text": set(), "never": set()}
    want = []
    for lsn, path, old, new, kind, size, _, _, text, _ in rows:
        there = new is not None and kind != "dir"
        oid = new if there else old
        if oid is None:
            continue
        for view, hit in (("big", size >= 50), ("text", "alpha" in (text or ""))):
            if view == "text" and not path.startswith("/d1/"):
                continue
            if there and hit and oid not in members[view]:
                members[view].add(oid)
                want.append((view, oid, lsn, "enter"))
            elif not (there and hit) and oid in members[view]:
                members[view].remove(oid)
                want.append((view, oid, lsn, "leave"))
    got = [(r["view_id"], r["oid"], r["lsn"], r["event"]) for r in live.events(observed).collect()]
    assert sorted(got) == sorted(want)
    now = {(r["view_id"], r["oid"]) for r in live.membership(observed).collect()}
    assert now == {(v, o) for v, s in members.items() for o in s}


def test_snapshot_then_stream_of_events(spark, tmp_path):
    frame, _ = deltas(spark, 120)
    observed = live.observations(frame, [live.View.of("big", "kMDItemFSSize >= 50")])
    whole = live.events(observed)
    start = live.membership(observed.where("lsn <= 60"))
    late = live.events(observed.where("lsn > 60"), start)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, whole.where("lsn > 60").collect()))
    for i, part in enumerate((observed.where("lsn <= 60"), observed.where("lsn > 60"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = []
    found = live.stream_events(stream)
    live.subscribe(found, lambda b: out.extend(map(tuple, b.select("view_id", "oid", "lsn", "event").collect())), 4096, str(tmp_path / "cp")).awaitTermination()
    assert sorted(out) == sorted(map(tuple, whole.select("view_id", "oid", "lsn", "event").collect()))


def test_resync(spark):
    rows = [("v", i, i, "/p", "enter") for i in range(40)] + [("w", 1, 1, "/p", "enter")]
    found = spark.createDataFrame(rows, "view_id string, oid long, lsn long, path string, event string")
    got = live.deliver(found, 1).collect()
    assert {(r["view_id"], r["event"]) for r in got} == {("v", "resync"), ("w", "enter")}


def test_search_and_alerts(spark):
    docs = spark.createDataFrame(
        [(1, "/c/harbour.txt", "ferry timetable for winter crossings harbour"), (2, "/c/orchard.txt", "pear grafting ladders"), (3, "/d/telescope.txt", "mirror lens tripod"), (4, "/d/empty.txt", "...")],
        "oid long, path string, text string",
    )
    catalog = docs.select("oid", F.lit("file").alias("kind"), F.length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(None).cast("string").alias("index_state"), F.array("path").alias("entry_paths"))
    embedder = HashEmbedder()
    content = docs.select("oid", "text", F.array(F.struct(F.lit("Main").alias("name"), F.lit("type").alias("kind"), F.lit(1).alias("line"))).alias("symbols"))
    engine = Engine(docs.select("path", "oid", F.col("oid").alias("attach_lsn")), catalog, content, LexicalPlane.build(content), VectorPlane(embed_chunks(content, embedder), embedder))
    assert engine.vectors.chunks.count() == 3
    first = lambda df: df.first()["path"]
    assert first(engine.query('semantic("ferry timetable for")')) == "/c/harbour.txt" and first(engine.query('"pear"')) == "/c/orchard.txt"
    top = engine.hybrid("ferry timetable", 3).collect()
    assert top[0]["provenance"] == "both" and top[0]["path"] == "/c/harbour.txt" and {r["provenance"] for r in top[1:]} == {"meaning"}
    assert engine.hybrid("mirror", 5, scope=Scope.of("/c")).where("path LIKE '/d%'").count() == 0
    assert engine.query('kRSDSymbols == "main" && kMDItemFSSize > 0').count() == 4
    assert engine.count('"pear" || "mirror"').first()["n"] == 2 and engine.search("", "lexical").count() == 0
    assert first(engine.search('"mirror"', "anything")) == "/d/telescope.txt" and first(engine.search("tripod lens", "hybrid")) == "/d/telescope.txt"
    assert engine.snippets("GRAFTING", 1).first()["text"] == "pear grafting ladders"
    view = engine.alert("a", "ferry timetable winter harbour", 0.25)
    rows = docs.select(F.col("oid").alias("lsn"), "path", F.lit(None).cast("long").alias("old_oid"), F.col("oid").alias("new_oid"), F.lit("file").alias("kind"), "text")
    assert [r["oid"] for r in live.events(live.observations(rows, [view])).collect()] == [1]


def test_plane_on_disk_reads_only_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "oid long, text string")
    LexicalPlane.build(docs).write(str(tmp_path / "lex"))
    plane = LexicalPlane.read(spark, str(tmp_path / "lex"))
    assert [r["oid"] for r in plane.top("word7", 5).collect()] == [7] and plane.count("common").first()["n"] == 50
    assert "PartitionFilters: [" in plane.of_terms(["word7"])._jdf.queryExecution().toString()


def test_fusion(spark):
    lists = [spark.createDataFrame([(o, 1.0 - i / 10) for i, o in enumerate(x)], "oid long, score double") for x in ([1, 2, 3], [3, 4, 5])]
    got = fuse(*lists, 10).collect()
    assert got[0]["oid"] == 3 and got[0]["provenance"] == "both" and len(got) == 5


def at(ms):
    return datetime(2024, 1, 1) + timedelta(milliseconds=ms)


def test_coalescer(spark):
    rows = [("/a", at(0), False), ("/a", at(300), True), ("/a", at(900), False), *[("/b", at(400 * i), False) for i in range(20)]]
    events = spark.createDataFrame(rows, "path string, ts timestamp, rescan_recursive boolean")
    got = [(r["path"], r["kind"], r["n"], r["last_ms"] - r["first_ms"], r["due_ms"] - r["first_ms"]) for r in coalesce.work_items(events).orderBy("path", "first_ms").collect()]
    assert got == [("/a", 2, 2, 300, 800), ("/a", 0, 1, 0, 500), ("/b", 0, 13, 4800, 5000), ("/b", 0, 7, 2400, 2900)]
    items = coalesce.work_items(events)
    cursors = spark.createDataFrame([(5,), (9,)], "source_cursor long")
    assert [r["source_cursor"] for r in coalesce.fence(items, cursors, 0).where("source_cursor IS NOT NULL").collect()] == [9]
    assert coalesce.fence(items, cursors, 3).where("source_cursor IS NOT NULL").count() == 0


def test_coalescer_stream(spark, tmp_path):
    rows = [("/a", at(0), False), ("/a", at(1), True), ("/b", at(2), False)]
    spark.createDataFrame(rows, "path string, ts timestamp, rescan_recursive boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, rescan_recursive boolean").parquet(str(tmp_path / "in"))
    query = coalesce.stream_work(stream, 50, 100).writeStream.format("memory").queryName("work").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if query.awaitTermination(0.5) or spark.table("work").count() == 2:
                break
    finally:
        query.stop()
    assert {(r["path"], r["kind"], r["n"]) for r in spark.table("work").collect()} == {("/a", 2, 2), ("/b", 0, 1)}
