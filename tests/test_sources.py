"""Extraction, the journal, the content store, directory listings and reconciliation."""

import os

import pytest
from pyspark.sql import functions as F

from tarn.sources import content, extract, filesystem
from tarn.sources.extract import Budgets, Extraction, Processor, Registry
from tarn.sources.journal import Cursor, Journal, JournalError

GOLDEN = {
    "shelf.rs": (
        "// fn hidden() is only a comment\nuse std::fmt;\n\npub(crate) struct Shelf<T> {\n    rows: Vec<T>,\n}\n\npub async fn restock<T>(s: &mut Shelf<T>) {}\n\nmod inner {\n    pub enum Size { Small, Large }\n    pub(super) fn measure() -> u8 { 3 }\n}\n",
        {("type", "Shelf"), ("function", "restock"), ("type", "Size"), ("function", "measure")},
    ),
    "garden.py": (
        "import os\n\n\nclass Bed:\n    class Row:\n        async def water(self, litres: int = 2):\n            def drip():\n                return litres\n            return drip\n\n\ndef harvest(*beds): return beds\n",
        {("type", "Bed"), ("type", "Row"), ("function", "water"), ("function", "drip"), ("function", "harvest")},
    ),
    "ferry.js": ("export default class Ferry extends Boat {\n  depart(hour) {\n    return hour\n  }\n}\nasync function board(list) {\n  return list\n}\n", {("type", "Ferry"), ("function", "board")}),
    "mill.go": ("package mill\n\ntype Grain interface{}\n\ntype Wheel struct {\n\tteeth int\n}\n\nfunc (w Wheel) Turn(n int) error { return nil }\n\nfunc grind() {}\n", {("type", "Grain"), ("type", "Wheel"), ("function", "Turn"), ("function", "grind")}),
    "kiln.c": ("struct kiln { int heat; };\n\nstatic int stoke(struct kiln *k, int by) {\n    return k->heat += by;\n}\n", {("type", "kiln"), ("function", "stoke")}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_symbols(name):
    source, want = GOLDEN[name]
    got = extract.extract(name, source.encode())
    assert got.status == "complete" and want <= {(k, n) for n, k, _ in got.symbols}


def test_symbol_lines():
    assert ("restock", "function", 8) in extract.extract("shelf.rs", GOLDEN["shelf.rs"][0].encode()).symbols


def test_encodings_and_budgets():
    assert extract.extract("u.txt", b"\xff\xfe" + "héllo wörld".encode("utf-16-le")).text == "héllo wörld"
    assert extract.extract("blob.bin", bytes([0, 159, 146, 150])).status == "unsupported"
    big = extract.extract("big.txt", b"x" * 1000, 10_000_000)
    assert big.status == "budget-exceeded" and len(big.text) == 1000 and ("partial_reason", "input_budget") in big.attrs
    cut = extract.extract("t.txt", ("é" * 10_000).encode(), budgets=Budgets(max_output_bytes=1001))
    assert cut.status == "partial" and len(cut.text.encode()) == 1000 and set(cut.text) == {"é"}
    many = "".join(f"fn f{i}() {{}}\n" for i in range(100)).encode()
    assert len(extract.extract("many.rs", many, budgets=Budgets(max_symbols=10)).symbols) == 10
    assert "unclosed" in extract.extract("bad.rs", "fn broken( {{{{ 中文 unclosed".encode()).text
    assert extract.extract("bad.py", b"def broken(:\n  pass\nclass Odd(").symbols[0][0] == "broken"
    assert extract.extract("x.pdf", b"%PDF-1.7").status == "unsupported"
    assert extract.sniff("x.bin", b"plain") == "text" and extract.extension(".bashrc") == "" and extract.extension("A.TXT") == "txt"


def test_registry(spark):
    def fail(name, raw):
        raise ValueError("no")

    registry = Registry()
    registry.register(Processor("first", 1, frozenset({"srt", "pdf"}), lambda n, r: Extraction("complete", "first")))
    registry.register(Processor("second", 2, frozenset({"srt"}), lambda n, r: Extraction("complete", r.decode().upper())))
    registry.register(Processor("bad", 1, frozenset({"bad"}), fail))
    rows = [("a.srt", b"hi"), ("b.pdf", b"x"), ("c.bad", b"x"), ("d.txt", b"plain"), ("e.txt", None)]
    files = spark.createDataFrame([(p, bytearray(c) if c is not None else None, len(c or b"")) for p, c in rows], "path string, content binary, length long")
    got = {r["path"]: (r["status"], r["text"], r["extractor_id"]) for r in extract.extract_files(files, registry).collect()}
    assert got["a.srt"] == ("complete", "HI", "second") and got["b.pdf"][1] == "first" and got["c.bad"][0] == "corrupt"
    assert got["d.txt"] == ("complete", "plain", "native") and got["e.txt"][1] == ""


def test_journal(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"))
    assert journal.last_lsn() == 0 and journal.replay().count() == 0
    changes = lambda *paths: spark.createDataFrame([(i, p, "upsert") for i, p in enumerate(paths)], "seq long, path string, op string")
    assert journal.append(changes("a", "b", "c"), batch=0) == (1, 3)
    assert journal.append(changes("d"), batch=1) == (4, 4)
    assert journal.append(changes("d"), batch=1) == (4, 4) and journal.last_lsn() == 4
    with pytest.raises(JournalError):
        journal.append(changes("x").limit(0))
    assert [(r["lsn"], r["path"]) for r in journal.replay(2).collect()] == [(2, "b"), (3, "c"), (4, "d")]
    assert journal.gaps().count() == 0 and journal.read(2, 3).count() == 2
    segment = journal.manifest().where("first = 1").first()["segment"]
    again = journal.quarantine(segment, spark.createDataFrame([("a",), ("b",)], "path string"), changes("a", "z"))
    assert [r["path"] for r in again.collect()] == ["a"]
    assert sorted((r["lsn"], r["op"]) for r in journal.replay().collect()) == [(1, "remove"), (2, "remove"), (3, "remove"), (4, "upsert")]
    cursor = Cursor(journal)
    assert cursor.get() is None
    cursor.set(41)
    cursor.set(42)
    assert cursor.get() == 42


def test_repair_knows_the_paths_of_an_unreadable_segment(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"))
    rows = lambda *paths: spark.createDataFrame([(i, "upsert", p, "test") for i, p in enumerate(paths)], "seq long, op string, path string, source string")
    journal.append(rows("/a", "/b", "/a"))
    journal.append(rows("/c"))
    segment = journal.manifest().where("first = 1").first()["segment"]
    for part in (tmp_path / "j" / segment).glob("part-*"):
        part.write_bytes(b"not a table")
    assert {r["path"] for r in journal.paths(segment).collect()} == {"/a", "/b"}
    again = journal.quarantine(segment, None, rows("/a", "/c", "/d"))
    assert [r["path"] for r in again.collect()] == ["/a"]
    found = [(r["lsn"], r["op"], r["path"]) for r in journal.replay().collect()]
    assert [x[:2] for x in found] == [(1, "remove"), (2, "remove"), (3, "remove"), (4, "upsert")]
    assert {p for _, op, p in found if op == "remove"} >= {"/a", "/b"} and journal.gaps().count() == 0


def test_content_store(spark):
    kind = "content_hash string, extractor_id string, extractor_version int, hints_hash string, abi_version int"
    key = lambda h, v=1: (h, "native", v, "x", 1)
    store = spark.createDataFrame([(*key("a"), "old"), (*key("b"), "old")], kind + ", text string")
    wanted = spark.createDataFrame([key("a"), key("a", 2), key("c"), key("c")], kind)
    assert content.misses(wanted, store).count() == 2
    new = content.put(store, spark.createDataFrame([(*key("a"), "new")], kind + ", text string"))
    assert {(r["content_hash"], r["text"]) for r in new.collect()} == {("a", "new"), ("b", "old")}
    assert content.evict(store, wanted).count() == 1
    assert store.select(content.storage_key()).distinct().count() == 2
    assert content.lookup(wanted, store).where("text IS NULL").count() == 3


def test_indexing_round(spark, tmp_path):
    key = lambda h: (h, "native", 1, "x", 1)
    kind = "content_hash string, extractor_id string, extractor_version int, hints_hash string, abi_version int"
    names = [x.split()[0] for x in kind.split(", ")]
    rows = [("/same", 1, 5, *key("held")), ("/changed", 2, 9, *key("held")), ("/x", 1, 1, *key("new")), ("/y", 1, 1, *key("new")), ("/z", 1, 1, *key("bad"))]
    files = spark.createDataFrame(rows, f"path string, size long, mtime_ns long, {kind}")
    known = spark.createDataFrame([("/same", 1, 5, "indexed"), ("/changed", 1, 5, "indexed")], "path string, size long, mtime_ns long, index_state string")
    store = spark.createDataFrame([(*key("held"), "ok", 0)], f"{kind}, status string, failures int")
    seen = []

    def extract(todo):
        seen.append(sorted(r["content_hash"] for r in todo.collect()))
        return todo.selectExpr(*names, "if(content_hash = 'bad', 'corrupt', 'ok') AS status")

    for n in range(1, 5):
        due, after = content.index(files, known, store, extract)
        after.write.parquet(str(tmp_path / str(n)))
        store = spark.read.parquet(str(tmp_path / str(n)))
        bad = store.where("content_hash = 'bad'").first()
        assert (bad["failures"], bad["status"]) == (min(n, 3), "corrupt" if n < 3 else "quarantined")
    assert seen == [["bad", "new"], ["bad"], ["bad"], []]
    got = {r["path"]: r["status"] for r in content.lookup(due, store).collect()}
    assert got == {"/changed": "ok", "/x": "ok", "/y": "ok", "/z": "quarantined"}


def test_listing_and_reconciliation(spark, tmp_path):
    root = tmp_path / "r"
    for p in ("a/one.txt", "a/b/two.txt", "a/node_modules/no.txt", "c/three.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    os.symlink(root / "c/three.txt", root / "link")
    filesystem.register(spark)
    listed = spark.read.format("tarn_files").load(str(root)).cache()
    base = str(root)
    assert {r["path"][len(base):] for r in listed.collect()} == {"", "/a", "/a/one.txt", "/a/b", "/a/b/two.txt", "/c", "/c/three.txt", "/link"}
    assert {r["kind"] for r in listed.where(F.endswith("path", F.lit("/link"))).collect()} == {"symlink"}
    assert spark.read.format("tarn_files").option("recursive", "false").load(base).count() == 4
    known = [(1, f"{base}/a", "dir"), (2, f"{base}/gone", "dir"), (3, f"{base}/gone/x", "file"), (4, f"{base}/gone2", "file"), (5, f"{base}/a/one.txt", "file")]
    rows = spark.createDataFrame(known, "oid long, path string, kind string")
    level = listed.where(F.regexp_count("path", F.lit("/")) == base.count("/") + 1)
    folder = spark.createDataFrame([(base,)], "path string")
    changes = filesystem.reconcile(level, folder, rows, rows).collect()
    assert {r["path"][len(base):] for r in changes if r["op"] == "remove"} == {"/gone", "/gone/x", "/gone2"}
    assert {r["path"][len(base):] for r in changes if r["op"] == "upsert"} == {"/a", "/c", "/link"}


def test_resolution(spark):
    kind = "path string, kind int"
    work = spark.createDataFrame([("/w/.git/x", 0), ("/w/none", 0), ("/w/f", 0), ("/w/known", 0), ("/w/new", 0), ("/w/known2", 2), ("/w/new2", 1)], kind)
    stats = spark.createDataFrame([("/w/f", "file", 1, 1), ("/w/known", "dir", 1, 2), ("/w/new", "dir", 1, 9), ("/w/known2", "dir", 1, 3), ("/w/new2", "dir", 1, 4)], "path string, kind string, dev long, ino long")
    objects = spark.createDataFrame([(1, "dir", 1, 2), (2, "dir", 1, 3), (3, "dir", 1, 8)], "oid long, kind string, dev long, ino long")
    entries = spark.createDataFrame([("/w/known", 1), ("/w/known2", 2), ("/w/new", 3)], "path string, oid long")
    got = {r["path"]: r["action"] for r in filesystem.resolve(work, stats, entries, objects).collect()}
    assert got == {"/w/.git/x": "skip", "/w/none": "remove", "/w/f": "upsert", "/w/known": "shallow", "/w/new": "recursive", "/w/known2": "recursive", "/w/new2": "shallow"}


def test_event_stream(spark, tmp_path):
    log = tmp_path / "events.log"
    log.write_text("1\t256\t/a\n2\t2048\t/b\n")
    filesystem.register(spark)
    run = lambda: spark.readStream.format("tarn_events").load(str(log)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    with log.open("a") as f:
        f.write("3\t1\t/c\n")
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
