"""SimHash groups, repeated passages, classifiers, decontamination and the pipeline against brute force on small tables."""

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import decontaminate, quality, shared, simhash, suffix, toxicity
from tarn.llm.labelled import Sample, fold, labelled_sample

sys.path.insert(0, str(Path(__file__).parents[2]))
KIND = "doc_id long, text string, extra string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], KIND).repartition(parts)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "a b c", "É é A\x0bb\x1fc d", "x y " * 1000, "ab c d e f g h i j"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def groups(ids, prints, radius=2):
    root = {}
    for i, f in zip(ids, prints):
        root.setdefault(i, i)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in zip(ids, prints):
        for j, g in zip(ids, prints):
            if (f ^ g).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("limit", [1, 5, 4096])
def test_near_duplicates(spark, limit):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(6)]
    rows = [(k, b) for k, b in enumerate(base)]
    for k in range(10, 70):
        words = base[k % 6].split()
        words[rng.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(80, None), (81, ""), (82, " "), (5, base[5]), (90, "long " * 30_000), (91, "long " * 30_001)]
    got = simhash.near_duplicates(table(spark, rows + [(None, base[0])]), tree_limit=limit).collect()
    assert len(got) == len(rows) + 1
    want = groups([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [0]


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("part", [3, 4096])
def test_similar_texts_go_but_one(spark, part):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(2000)}"
    base = [[word() for _ in range(n)] for n in (4, 6, 20, 60, 120, 120, 300, 900)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(10, 130):
        words = list(base[k % 8])
        for _ in range(k % 5 * len(words) // 60):
            at = rng.randrange(len(words))
            words[at : at + 1] = [word()] * rng.randrange(3)
        rows.append((k, " ".join(words).upper() if k % 2 else "\n".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "long " * 30_000), (204, "long " * 30_001), (205, rows[3][1])]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {min(rows[j][0] for j in range(len(rows)) if top(j) == top(i)) for i in range(len(rows))}
    docs = table(spark, rows).withColumns({"node": F.lit(1), "key": F.lit("k"), "band": F.lit(2)})
    kept = simhash.keep_documents(docs, part)
    assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    assert got >= want and len(got - want) <= 1 and {10, 11} - got == {10, 11}


@pytest.mark.parametrize("rows", [2, 2048])
def test_texts_near_a_leader_that_is_unlike_them_link(spark, monkeypatch, rows):
    def crafted(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            family, kind = [i // 4 for i in ids], [i % 4 for i in ids]
            sets = [np.arange(0, 100) if k == 0 else np.arange(40 + k, 140 + k) for k in kind]
            cols = [ids, batch.column("key").to_pylist(), ids, [f * 64 + (k if k < 3 else -1) for f, k in zip(family, kind)]]
            cols += [[[f] * 8 for f in family], [s.astype(np.uint32).tobytes() for s in sets]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "key", "node", "fp", "bands", "shingles"])

    monkeypatch.setattr(simhash, "_sketches", crafted)
    monkeypatch.setattr(simhash, "ACROSS_ROWS", rows, raising=False)
    kept = simhash.keep_documents(table(spark, [(i, str(i)) for i in range(80)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(80) if i % 4 < 2]


def test_leaders_are_few_and_near():
    rng = random.Random(22)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(200)]
    rng.shuffle(prints)
    got = simhash.leaders(prints, 18)
    heads = {i for i, near in enumerate(got) if near == [i]}
    assert len(heads) == 5 and all((prints[i] ^ prints[j]).bit_count() <= 18 for i, near in enumerate(got) for j in near)


def test_documents_without_or_with_repeated_ids_stay(spark):
    rng = random.Random(9)
    one, two, three, four, five = (" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(5))
    rows = [(1, one), (None, one), (None, two), (None, two), (None, three), (2, four), (2, five), (2, five), (3, four)]
    kept = simhash.keep_documents(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "extra"]
    want = [(1, one), (None, two), (None, three), (2, four), (2, five)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.keep_documents(table(spark, [])).count() == 0


def test_trees_find_all_within_the_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        for radius in (0, 1, 2, 4):
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]
    assert simhash.BKTree().within(1, 2) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != 500}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, n=50):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        for at in range(len(raw) - n + 1):
            seen.setdefault(raw[at : at + n], i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - n + 1):
            first = seen[raw[at : at + n]]
            if first is not None and (i is None or first < i):
                gone[at : at + n] = b"\1" * n
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, monkeypatch):
    rng = random.Random(4)
    words = ["ab", "cde", "f", "ghij", "é", "kl", "m"]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        if i % 2:
            cut = rng.randrange(30)
            text += passage[i % 3][cut : cut + rng.randrange(45, 100)] + text
        rows.append((i, text))
    rows += [(50, None), (51, ""), (52, "a" * 200), (53, "a" * 120), (54, "a" * 49), (55, rows[1][1]), (55, rows[1][1]), (None, rows[3][1]), (None, "a" * 60)]
    rows += [(60, "xyz" * 100_000), (61, "yzx" * 30)]
    for pack in (1, 3000, 4 << 20):
        monkeypatch.setattr(suffix, "PACK_BYTES", pack)
        monkeypatch.setattr(suffix, "SORT_STARTS", 1 << 16 if pack > 1 else 10)
        got = suffix.remove_repeats(table(spark, rows)).collect()
        flat = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in got]
        assert sorted(flat, key=repr) == plain_removal(rows)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_buckets_of_suffixes_go_by_bytes(spark, monkeypatch):
    rng = random.Random(41)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{i} " * 30 + passage[i % 7 * 20 :][: 60 + i % 90] + f"{i % 5} " * 40) for i in range(60)]
    used, plain = [], suffix._segment_rows
    monkeypatch.setattr(suffix, "_segment_rows", lambda buckets: used.append(buckets) or plain(buckets))
    size = sum(len(t) for _, t in rows)
    for per_bucket, want in ((1 << 20, 1), (1000, -(-size // 1000))):
        monkeypatch.setattr(suffix, "BUCKET_BYTES", per_bucket, raising=False)
        got = suffix.remove_repeats(table(spark, rows)).collect()
        flat = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in got]
        assert sorted(flat, key=repr) == plain_removal(rows) and used.pop() == want


def test_longest_previous_factors():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        owners, lcp = rng.integers(0, 6, n), rng.choice([0, 3, 50], n)
        length, first = suffix.longest_previous_factors(owners, lcp.astype(np.uint8))
        for i in range(n):
            best, low = 0, owners[i]
            for j in range(n):
                shared_bytes = lcp[min(i, j) + 1 : max(i, j) + 1].min() if i != j else 0
                if owners[j] < owners[i]:
                    best = max(best, shared_bytes)
                    low = min(low, owners[j]) if shared_bytes >= 50 else low
            assert length[i] == best and (best < 50 or first[i] == low)


def sentences(rng, words, n=6):
    return " ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() + "." for _ in range(n))


def test_quality(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "th an re on er".split() for b in "ing tion ed ly ble".split()]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = sentences(rng, words)
        rows.append((i, text if good else " ".join(w.upper() + "###" for w in text.split())))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, "x" * 300_000), (0, rows[0][1])]
    labels = spark.createDataFrame(labels + [(5000, 1, 1), (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table(spark, rows), labels)
    got = quality.quality_scores(table(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert sum((score[i] >= 0.7) == (i % 3 > 0) for i in range(400)) >= 392
    assert score[1000] == score[1001] == model.prior
    kept = quality.keep_documents(table(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "extra"] and {r["doc_id"] for r in kept.collect()} >= {1, 2, 4}
    again = quality.train(table(spark, rows, 5), labels)
    assert (again.good, again.bad, again.weights) == (model.good, model.bad, model.weights)


def test_classifiers_without_two_classes():
    for texts, labels, totals in (([], [], (0, 0)), (["a"], [1], (0, 1)), (["", ""], [0, 1], (1, 1)), (["a b"], [0], (1, 0))):
        sample = Sample(texts, labels, totals)
        for s in (quality.fit(sample).score("any text"), toxicity.fit(sample).score("any text. more"), quality.fit(sample).score(None)):
            assert 0 <= s <= 1


def test_held_out_rows_are_never_learned_from(spark):
    rows = [(i, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    sample = labelled_sample(table(spark, rows), labels, "quality", fold(4) != 2, 30, 10_000)
    import zlib

    assert len(sample.texts) == 60 and all(zlib.crc32(t.split()[1].encode()) % 4 != 2 for t in sample.texts)
    assert sum(len(t) for t in labelled_sample(table(spark, rows), labels, "quality", fold(4) != 2, 30, 100).texts) <= 100


def test_quality_scores_against_plain_sizes():
    import math

    import zstandard

    rng = random.Random(31)
    words = [f"{a}{b}" for a in "th an re on er".split() for b in "ing tion ed ly ble".split()]
    good = [sentences(rng, words, rng.randrange(1, 40)) for _ in range(120)]
    bad = [" ".join(w.upper() + "###" for w in t.split()) for t in good[:60]]
    model = quality.fit(Sample(good + bad, [1] * 120 + [0] * 60, (600, 1200)))
    assert abs(model.prior - 1200.5 / 1801) < 1e-12
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
    a, b, c = model.weights
    for text in (good[0], bad[0], "x", "é" * 3000, good[1] * 20):
        raw = text.encode()
        blocks = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        gain = sum(size(x, model.bad) - size(x, model.good) for x in blocks) / len(raw)
        w = len(raw) / (len(raw) + 256)
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-max(-40, min(40, a * w * gain + b * w + c)))), rel_tol=1e-9)
    assert a > 0 and min(model.score(t) for t in good) > max(model.score(t) for t in bad)


def test_long_texts_are_skipped_alone_and_repeats_settled(spark):
    rows = [(i, "long " * 2000 if i % 5 == 0 else f"text {i}") for i in range(100)] + [(1, "a text"), (1, "text 1")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    texts = [sorted(labelled_sample(table(spark, rows, n), labels, "quality", F.lit(True), 40, 20_000).texts) for n in (1, 5)]
    assert texts[0] == texts[1] and len(texts[0]) >= 60 and "a text" in texts[0] + ["a text"] and not any(t.startswith("long") for t in texts[0])


def test_toxicity_against_plain_noisy_or():
    import math

    rng = random.Random(32)
    words = [f"{a}{b}" for a in "th an re on er".split() for b in "ing tion ed ly ble".split()]
    texts = [sentences(rng, words) for _ in range(90)]
    labels = [int(i % 3 == 0) for i in range(90)]
    texts = [t + " You awful person." if y else t for t, y in zip(texts, labels)]
    model = toxicity.fit(Sample(texts, labels, (60, 30)))

    def score(text, weights):
        stay = 1.0
        for s in re.findall(r"[^.!?\n]+", text.lower()):
            known = {f for w in re.findall(r"[^\W\d_]+", s) for f in (w, w[:4] + "*", w[:5] + "*")}
            stay *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights.get(f, 0.0) for f in known))))
        return 1 - stay

    def loss(weights):
        p = [min(max(score(t, weights), 1e-9), 1 - 1e-9) for t in texts]
        return -sum(math.log(q if y else 1 - q) for q, y in zip(p, labels))

    for t in texts[:20]:
        assert math.isclose(model.score(t), score(t, model.weights), rel_tol=1e-6, abs_tol=1e-9)
    best, top = loss(model.weights), sorted(model.weights, key=lambda f: -abs(model.weights[f]))[:4]
    assert best < 0.05 * loss({}) and all(loss(model.weights | {f: model.weights[f] - 6}) > best for f in top if model.weights[f] > 0)


def test_empty_tables_of_free_operators(spark):
    none, bench = table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(none).count() == 0 and decontaminate.find_items(none, bench).count() == 0
    assert quality.keep_documents(none, labels).count() == 0 and toxicity.toxicity_scores(none, toxicity.train(none, labels)).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "th an re on er".split() for b in "ing tion ed ly ble".split()]
    rows, labels = [], []
    for i in range(400):
        text = sentences(rng, words)
        if i % 4 == 0:
            at = text.index(". ") + 2
            text = text[:at] + f"Such an {rng.choice(['awfulone', 'awfultwo', 'nastier'])} thing. " + text[at:]
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "İ" * 10 + ". An awfulone."), (1004, "thing. " * 20_000)]
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(table(spark, rows), model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(400)) >= 398
    text = dict(rows)
    for i in (0, 4, 8, 1003):
        assert any("awful" in text[i][s["start"] : s["end"]] or "nastier" in text[i][s["start"] : s["end"]] for s in got[i]["offending"])
    assert got[1]["offending"] == [] and got[1001]["score"] == 0


ITEMS = [
    (1, "If Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have left after lunch?"),
    (2, "The river runs past the old mill and under the stone bridge before it meets the sea."),
    (3, "short one here"), (4, ""), (5, None), (6, "A train covers 120 km in 2 hours, so its speed over the whole trip is steady and known."),
]


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    cases = {
        1: ("before. " + ITEMS[1][1] + " after", {(2, False)}),
        2: ("So if Carol has 31 apples and gives 7 apples to Dave, how many apples does Carol have left after lunch?", {(1, True)}),
        3: ("If Carol has 31 apples and gives 7 apples to Dave, how many apples does Erin have left after lunch?", None),
        4: ("THE RIVER RUNS, past the old mill; and under the stone bridge before it meets the sea", {(2, False)}),
        5: ("The river runs to the sea and the old bridge is made of stone.", set()),
        6: ("A train covers 90 miles in 3 days, so its speed over the whole trip is steady and known.", {(6, True)}),
        7: ("this short one here is listed", {(3, False)}), 8: ("", set()), 9: (None, set()), 10: ("1 2 3 4 5 6 7 8 9 10 11 12 " * 5000, set()),
        11: ("filler words go on. " * 5000 + ITEMS[1][1], {(2, False)}),
    }
    docs = table(spark, [(i, t) for i, (t, _) in cases.items()])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: {(x["item_id"], x["changed"]) for x in r["items"]} for r in decontaminate.find_items(docs.withColumn("items", F.lit(1)), bench).collect()}
    assert {i: g for i, g in got.items() if i != 3} == {i: want for i, (_, want) in cases.items() if i != 3}
    slots = decontaminate.Benchmark(ITEMS).matches(cases[3][0])
    assert all(share < 1 for _, share, _ in slots)
    kept = decontaminate.keep_documents(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 3) == [5, 8, 9, 10] and kept.columns == docs.columns
    assert decontaminate.find_items(docs, bench.limit(0)).where(F.size("items") > 0).count() == 0


def test_decontamination_of_dense_items_names_at_starts_and_long_runs():
    rng = random.Random(10)
    long_item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(240)]
    items = [
        (1, "Compute 12 + 30 * 4 - 7 + 9 + 15 - 2 + 88."),
        (2, "Alice has 12 apples. Bob has 5 pears. Carol eats 3 of them. Dana buys 7 more. Who has most?"),
        (3, " ".join(long_item)), (4, "1 2 3"),
    ]
    model = decontaminate.Benchmark(items)
    found = lambda text: {(i, changed) for i, _, changed in model.matches(text)}
    assert found("So: compute 12 + 30 * 4 - 7 + 9 + 15 - 2 + 88. Done") == {(1, False)}
    assert found("So: compute 13 + 31 * 5 - 8 + 10 + 16 - 3 + 89. Done") == set()
    names = "Erin has 12 apples. Frank has 6 pears. Grace eats 3 of them. Heidi buys 7 more. Who has most?"
    assert found("Read. " + names) == {(2, True)} and found(items[1][1].upper()) == {(2, False)} and found(items[1][1]) == {(2, False)}
    run = long_item[60:120]
    assert found("a b c " + " ".join(run) + " d e f") == {(3, False)}
    assert found(" ".join(run[:45]) + " d e f") == set()
    rng.shuffle(run)
    assert found(" ".join(run)) == set() and found("the 1 2 3 count") == {(4, False)}


def plain_windows(text):
    """Every window of a text in every form, by the rules, word by word."""
    tokens = re.findall(r"[.!?\n]|\d+(?:[.,]\d+)*|[^\W\d_]+", text)
    words, start = [], True
    for i, t in enumerate(tokens):
        if t in ".!?\n":
            start = True
            continue
        number = t[0].isdigit()
        unit = t.lower() in decontaminate.UNITS and i > 0 and tokens[i - 1][0].isdigit()
        first = "<n>" if number else "<u>" if unit else t.lower()
        name = t[0].isupper() and not unit
        words.append((first, "<p>" if name and not start else first, "<p>" if name else first, t.lower()))
        start = False
    width, out = min(8, len(words)), set()
    least = min(4, max(1, width // 2))
    for i in range(len(words) - width + 1) if width else ():
        forms = [tuple(w[k] for w in words[i : i + width]) for k in range(4)]
        enough = [sum(x[0] != "<" for x in form) >= least for form in forms]
        out |= {(i, forms[k]) for k in range(3) if enough[k]} | ({(i, forms[3])} if not enough[0] else set())
    return out


def test_template_windows_against_plain_ones():
    rng = random.Random(23)
    words = "Alice Bob apples has 12 3.5 km kg the and . ! gives of to ÉCOLE été 7 hours Train x_y \n".split(" ")
    for n in [*range(1, 12), 40, 200] * 5:
        text = " ".join(rng.choice(words) for _ in range(n))
        keep, forms = decontaminate.template(decontaminate._TOKEN.findall(text))
        width, hashes = min(8, len(keep)), {}
        want = plain_windows(text)
        got = [(int(at), int(h)) for _, starts, found in decontaminate.window_hashes(forms, width) for at, h in zip(starts, found)] if width else []
        assert len(set(got)) == len({(i, w) for i, w in want})
        assert {at for at, _ in got} == {i for i, _ in want}
        for (at, h) in got:
            hashes.setdefault(h, set()).add(at)
        same = {}
        for i, w in want:
            same.setdefault(w, set()).add(i)
        assert sorted(map(sorted, hashes.values())) == sorted(map(sorted, same.values()))


def test_recall_of_changed_recased_and_partial_items(spark):
    rng = random.Random(24)
    lower = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(800)]
    names = [w.capitalize() for w in lower[:60]]

    def item(fill):
        parts = []
        for kind, x in fill:
            parts.append(names[x] if kind == "name" else str(x) if kind == "number" else x)
        return " ".join(parts)

    def other(fill, shift):
        return [(k, (x + shift) % 60 if k == "name" else x + shift if k == "number" else x) for k, x in fill]

    items, docs, want = [], [], {}
    pad = lambda n: " ".join(rng.choice(lower) for _ in range(n))
    for k in range(60):
        fill = []
        for _ in range(rng.randrange(20, 60)):
            kind = rng.choice(["word"] * 7 + ["name", "number"])
            fill.append((kind, rng.randrange(60) if kind == "name" else rng.randrange(2, 500) if kind == "number" else rng.choice(lower)))
        text = item(fill)
        items.append((k, text))
        numbers = item([(c, x + 31 if c == "number" else x) for c, x in fill])
        half = " ".join(text.split()[: -(-len(fill) * 6 // 10)])
        for j, form in enumerate((text, item(other(fill, 17)), text.upper(), text.lower(), text.title(), numbers.upper(), half)):
            docs.append((10 * k + j, pad(30) + ". " + form + ". " + pad(30)))
            want[10 * k + j] = (k, j)
        docs.append((10 * k + 9, pad(100)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in decontaminate.find_items(table(spark, docs), bench).collect()}
    hit = [sum(got[10 * k + j] == [k] for k in range(60)) / 60 for j in range(7)]
    assert min(hit) >= 0.9, hit
    assert not any(got[10 * k + 9] for k in range(60))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"{a}{b}" for a in "th an re on er st nd".split() for b in "ing tion ed ly ble ent ous".split()]
    rows = [(i, sentences(rng, words, 12), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)]
    rows += [(300 + i, rows[50 + i][1] + " Extra.", "en", "s1", 0) for i in range(5)]
    rows += [(400 + i, sentences(rng, words) + " " + ITEMS[1][1] + " " + sentences(rng, words), "en", "s2", 0) for i in range(4)]
    rows += [(500 + i, " ".join(w.upper() + "$$$" for w in sentences(rng, words, 12).split()), "en", "s2", 0) for i in range(60)]
    labels = [(i, 1, 0) for i in range(120)] + [(500 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert len(ids) == len(out) and not ids & set(range(400, 404)) and not ids & set(range(500, 560))
    assert ids >= set(range(200, 210)) and not ids & set(range(10)) and ids >= set(range(60, 120))
    assert all(50 + i in ids and 300 + i not in ids for i in range(5))
    assert sum(r["taken"] for r in out) <= 2 * sum(r["size"] for r in out) and len(corpus_pipeline.STAGES) == 5
