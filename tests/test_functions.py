import pyarrow as pa
from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.functions.batches import PIECE_ROWS
from tarn.functions.snippets import excerpt, span
from tarn.functions.vectors import HashEmbedder, chunk, dot, embed_chunks, fnv1a, normalize
from tarn.operators import metrics
from tarn.schema import clamp
from tarn.sources.extract import extract_files

WORDS = (
    "ledger north-by-northwest l'été I/O F# ΑΣ ÉCLAIR İzmir ǅungla read_me.txt 7½ x86-64 ٣٤ किताबें ภาษาไทย كِتابٌ तमिழ் 漢字かな ﬁn a\u0301b "
    "nevertheless-an-unreasonably-drawn-out-compound zero\u200bwidth q\u00adr 𝒳𝒴 Ⅻ"
).split(" ")


def test_query_and_index_agree_on_tokens(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, "y" * 39, "y" * 40, "ü" * 20, "__ -", ""]], "t string")
    for r in rows.select("t", tx.tokens("t").alias("k")).collect():
        assert r["k"] == tx.ordered_tokens(r["t"]), r["t"]
    assert tx.ordered_tokens("किताब") == ["किताब"] and tx.ordered_tokens("tick-tock tick") == ["tick", "tock", "tick"]


def test_phrases_keep_repeats(spark):
    from tarn.operators.lexical import phrase

    docs = spark.createDataFrame([(1, "so long, so-long farewell"), (2, "so long farewell"), (3, "किताब की किताब")], "oid long, text string")
    found = lambda q: sorted(r["oid"] for r in phrase(docs, q).collect())
    assert found("so-long so long") == [1] and found("long farewell") == [1, 2] and found("किताब की") == [3] and found("") == []


def test_wildcards_are_stripped():
    assert tx.query_tokens("*foo-bar* ** baz*") == ["foo", "bar", "baz"] and tx.symbol_terms("*Ab_c* d") == ["ab_c", "d"]


def test_paths(spark):
    row = spark.createDataFrame([("/a/b/.hid", "/a/B.TXT", "/x")], "p string, q string, r string")
    got = row.select(tx.extension("p"), tx.extension("q"), tx.parent("r"), tx.parent("p"), tx.ancestors("q"), tx.percent_decode(F.lit("a%2Fb%ZZ"))).first()
    assert tuple(got) == ("", "txt", "/", "/a/b", ["/a", "/a/B.TXT"], "a/b%ZZ")


def test_truncation_keeps_characters_whole(spark):
    rows = spark.createDataFrame([("é" * 10,), ("a€b€c",), ("ab😀cd",), ("",), (None,), ("plain text",)], "t string")
    for limit in range(1, 9):
        for r in rows.select("t", tx.truncate_bytes("t", limit).alias("c")).collect():
            want = None if r["t"] is None else r["t"].encode()[:limit].decode("utf-8", "ignore")
            assert r["c"] == want, (r["t"], limit)


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nHello there\n\n2\n00:00:03,000 --> 00:00:04,000\n  General \n"
    assert spark.range(1).select(tx.strip_subtitles(F.lit(srt))).first()[0] == "Hello there\nGeneral"


def test_snippets():
    assert excerpt("The Flux   capacitor\nworks", "flux x") == (0, 26, "The Flux capacitor works")
    text = "é" * 100 + "needle" + "ü" * 200
    start, end = span(text, "needle")
    assert text.encode()[start:end].decode().count("needle") == 1 and end - start <= 200
    assert span("abc", "zzz") == (0, 3) and excerpt("", "x") == (0, 0, "")


def test_chunks():
    got = chunk("a" * 600 + "\n\n" + "b" * 600 + "\n\n" + "tail")
    assert [(o, len(t)) for o, t in got] == [(0, 1204), (1204, 4)] and chunk(" \n\n ") == [] and chunk("") == []


def test_embedding(spark):
    e = HashEmbedder()
    a, b, c = (e.embed(t) for t in ("invoice payment terms", "payment terms of the invoice", "flour butter sugar"))
    assert abs((a * a).sum() - 1) < 1e-5 and (a * b).sum() > (a * c).sum() and not e.embed("...").any()
    assert fnv1a("", 0) == 0xCBF29CE484222325 and fnv1a("a", 0) == 0xAF63DC4C8601EC8C
    rows = embed_chunks(spark.createDataFrame([(1, "one two"), (2, "!!"), (3, None)], "oid long, text string"), e)
    assert [r["oid"] for r in rows.collect()] == [1]
    vec = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    assert vec.select(dot("v", [1, 2]), F.round(dot(normalize("v"), [1, 1]), 5)).first()[:] == (11.0, 1.4)


def test_histogram(spark):
    report = metrics.histogram_report(metrics.histogram(spark.range(1, 1001).select(F.col("id").cast("double").alias("ms")), "ms")).first()
    assert (report["count"], report["mean_ms"], report["p50_ms"], report["p99_ms"]) == (1000, 500.5, 350.0, 750.0)
    over = metrics.histogram(spark.createDataFrame([(1e6,), (0.05,)], "ms double"), "ms").collect()
    assert {r["bucket"] for r in over} == {0, 18}
    assert metrics.histogram_report(metrics.histogram(spark.createDataFrame([], "ms double"), "ms")).first()["count"] is None


def test_failures_and_limits(spark):
    rows = spark.createDataFrame([("complete",), ("encrypted",), ("password-required",), ("odd",), ("corrupt",)], "s string")
    assert {r["failure"]: r["n"] for r in metrics.failure_counts(rows, "s").collect()} == {"encrypted": 2, "other": 1, "corrupt": 1}
    assert clamp(0) == 1 and clamp(5000) == 1000


class Held:
    """A table whose mapInArrow() gives the function back."""

    dtypes = [("path", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


_TEXTS = ["one two " * 40] * 999 + [None, "", "three " * 400_000]


def test_vectors_are_held_in_pieces_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"oid": list(range(len(_TEXTS))), "text": _TEXTS})
    out = list(embed_chunks(Held(), HashEmbedder(8))([batch]))
    assert [o for b in out for o in b.column("oid").to_pylist()] == [*range(999), 1001]
    assert max(b.num_rows for b in out) <= PIECE_ROWS


def test_extracted_texts_are_held_in_pieces_of_a_batch():
    paths, raw = [f"{i}.txt" for i in range(len(_TEXTS))], [None if t is None else t.encode() for t in _TEXTS]
    batch = pa.RecordBatch.from_pydict({"path": paths, "content": pa.array(raw, pa.binary()), "length": [len(r or b"") for r in raw]})
    out = list(extract_files(Held())([batch]))
    assert [p for b in out for p in b.column("path").to_pylist()] == paths
    assert max(b.num_rows for b in out) <= PIECE_ROWS and out[-1].num_rows == 1
    assert list(extract_files(Held())([batch.slice(0, 0)])) == []
