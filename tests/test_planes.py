"""Planes that are kept up to date equal planes built anew; the command line."""

from pyspark.sql import functions as F

from tarn.__main__ import main, rql
from tarn.functions.vectors import HashEmbedder, embed_chunks
from tarn.operators.lexical import LexicalPlane
from tarn.operators.vector import VectorPlane

ROWS = "array<struct<name:string,kind:string,line:int>>"


def test_refresh_equals_rebuild(spark):
    before = spark.createDataFrame([(i, f"common word{i}", []) for i in range(6)], f"oid long, text string, symbols {ROWS}")
    after = before.where("oid <> 2").withColumn("text", F.when(F.col("oid") == 3, "other words").otherwise(F.col("text")))
    plan = spark.createDataFrame([(2, "remove"), (3, "refresh")], "oid long, action string")
    got, want = LexicalPlane.build(before).refreshed(plan, after), LexicalPlane.build(after)
    for a, b in ((got.postings, want.postings), (got.lengths, want.lengths)):
        a = a.select(*b.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    e = HashEmbedder()
    vectors = VectorPlane(embed_chunks(before, e), e).refreshed(plan, after)
    assert sorted(map(str, vectors.chunks.collect())) == sorted(map(str, embed_chunks(after, e).collect()))


def test_command_line(spark, tmp_path, capsys):
    entries = spark.createDataFrame([("/a/Note.txt", 1, 1), ("/b/x.rs", 2, 2)], "path string, oid long, attach_lsn long")
    objects = spark.createDataFrame([(1, "file", 10, 1, None, ["/a/Note.txt"]), (2, "file", 20, 1, None, ["/b/x.rs"])], "oid long, kind string, size long, mtime_ns long, index_state string, entry_paths array<string>")
    entries.write.parquet(str(tmp_path / "entries"))
    objects.write.parquet(str(tmp_path / "objects"))
    assert rql("n", "s", "kMDItemFSSize > 1") == 'kMDItemFSName == "*n*"c && semantic("s") && kMDItemFSSize > 1'
    assert main([str(tmp_path), "-name", "note"]) == 0 and capsys.readouterr().out == "/a/Note.txt\n"
    assert main([str(tmp_path), "kMDItemFSSize > 1", "-count", "-onlyin", "/b"]) == 0 and capsys.readouterr().out == "1\n"
    assert main([str(tmp_path), "kMDItemFSSize > 1", "--explain"]) == 0 and "CatalogScan" in capsys.readouterr().out


def test_tokens_that_no_query_asks_for_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, "three"), (4, None)], "oid long, text string")
    asked = spark.createDataFrame([("a", "two"), ("b", "two"), ("b", "three"), ("c", "none")], "query string, term string")
    plane = LexicalPlane.build(docs)
    found = plane.top_each(asked, 5)
    assert {(r["query"], r["oid"]) for r in found.collect()} == {("a", 1), ("a", 2), ("b", 2)}
    assert found.where("query = 'a'").orderBy("oid").select("oid", "score").collect() == plane.top("two", 5).orderBy("oid").collect()
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Aggregate [oid") < tree.index("LeftSemi")
