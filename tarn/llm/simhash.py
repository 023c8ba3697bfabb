"""SimHash near-duplicate groups: shards of fingerprints, a BK-tree for each shard.

near_duplicates() links fingerprints at most two bits apart, exactly, in pigeonhole shards. keep_documents() links texts by the
similarity of their five-word shingles, whose fingerprints are further apart: its shards are MinHash bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.bloom import bloom_filter, possible_hits
from tarn.llm.shared import connected_components, cut, drop, joined_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that one shard's tree may hold; larger shards are split.
TREE_LIMIT = 4096
#: keep_documents(): texts link if the sets of their WIDE_SHINGLE-word shingles have a Jaccard similarity of WIDE_SIMILARITY.
#: Candidates share one of BANDS bands of ROWS MinHashes, 99.7 % of pairs at 0.8, and differ in at most WIDE_RADIUS bits.
WIDE_SHINGLE, WIDE_SIMILARITY, WIDE_RADIUS = 5, 0.8, 18
BANDS, ROWS = 8, 3
#: Rows and bytes of shingles of a band's part; two parts at a time are compared with each other (across_links()).
ACROSS_ROWS, ACROSS_BYTES = 2048, 16 << 20
_MINHASH = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of byte values: _BITS[v, i] is bit i of v.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, space-joined, repeats included; of all words if there are fewer."""
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = [end - 1 for end in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without any."""
    n = len(hashes)
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = [np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)]
    bits = (np.concatenate(counts) * 2 > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 3-word shingles, unsigned; 0 for a text without words.

    A-Z are lower-cased; words are runs other than \\x20 and \\x09-\\x0D; a text of fewer words is one shingle. A bit is 1
    if it is set in over half of the shingles' XXH64 (seed 42), repeats included.
    """
    return _majority(_shingle_hashes(_words(text), SHINGLE))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("text")]
        signed = np.array(prints, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])


class BKTree:
    """Fingerprints under their Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while True:
                apart = (value ^ self.values[at]).bit_count()
                below = self.children[at].get(apart)
                if below is None:
                    self.children[at][apart] = len(self.values)
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most radius away: from a node at distance d only edges d - radius to d + radius."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            apart = (value ^ self.values[at]).bit_count()
            if apart <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                open_nodes += [c for e, c in edges.items() if apart - radius <= e <= apart + radius]
            else:
                open_nodes += [edges[e] for e in range(apart - radius, apart + radius + 1) if e in edges]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(place, root's place) for every value but one of each group that links of at most radius bits connect."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(i, r) for i in range(len(values)) if (r := top(i)) != i]


def _shard_links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in ("block", "value", "fp", "rep")]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            starts = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(starts):
                yield _linked(held[2][: starts[-1]], held[3][: starts[-1]], starts[:-1], radius)
                held = [x[starts[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield _linked(held[2], held[3], np.array([], dtype=np.int64), radius)

    return links


def _linked(fps: np.ndarray, reps: np.ndarray, starts: np.ndarray, radius: int) -> pa.RecordBatch:
    bounds = np.concatenate([[0], starts, [len(fps)]])
    a, b = [], []
    for k in np.flatnonzero(np.diff(bounds) > 1):
        lo, hi = bounds[k], bounds[k + 1]
        for i, r in tree_links(fps[lo:hi].view(np.uint64).tolist(), radius):
            a.append(int(reps[lo + i]))
            b.append(int(reps[lo + r]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _masks(free: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """(mask of a block, bits that stay free) for radius + 1 blocks of the free bits."""
    edges = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    blocks = [free[lo:hi] for lo, hi in zip(edges, edges[1:])]
    return [(sum(1 << b for b in block), [b for b in free if b not in block]) for block in blocks]


def _bits(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _split(shards: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards of at most limit fingerprints, and larger ones. Their sizes are counted on the map side first."""
    large = shards.groupBy("block", "value").count().where(F.col("count") > limit).select("block", "value")
    return shards.join(large, ["block", "value"], "left_anti"), shards.join(large, ["block", "value"], "left_semi")


def _in_trees(shards: DataFrame, radius: int) -> DataFrame:
    rows = shards.repartition("block", "value").sortWithinPartitions("block", "value", "fp")
    return rows.select("block", "value", "fp", "rep").mapInArrow(_shard_links(radius), "a long, b long")


def fingerprint_links(groups: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """groups (fp, rep), fp distinct -> edges (a, b) of reps that connect all fingerprints at most radius bits apart.

    Two such fingerprints agree in one of radius + 1 blocks, so they meet in the shard of that block's value. A shard is
    dealt to one task, which streams it through a BK-tree and emits a spanning forest of its links, fewer rows than it
    read. A shard of more than tree_limit fingerprints is split by its free bits in the same way: they are cut in radius + 1
    blocks, one of which agrees too, so 35 bits of 64 agree in a shard's shard and trees do all the work for any corpus of
    unrelated fingerprints. Where over tree_limit fingerprints still agree in all those, all very near each other, they meet
    under half-way keys (radius 2 only): a fingerprint emits itself and each form with one more free bit flipped; two are within 2
    bits exactly if they share one of these, so each key's members link to its smallest, in proportion to the members.
    """
    first = _masks(list(range(64)), radius)
    second = [(mask | more, free) for mask, rest in first for more, free in _masks(rest, radius)]
    at = lambda k, mask: F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(_bits(mask)).alias("value"))
    shards = groups.select("fp", "rep", F.explode(F.array(*[at(k, mask) for k, (mask, _) in enumerate(first)])).alias("s"))
    small, large = _split(shards.select("s.block", "s.value", "fp", "rep"), tree_limit)
    links = _in_trees(small, radius)
    n = radius + 1
    below = [F.array(*[at(k, second[k][0]) for k in range(i * n, i * n + n)]) for i in range(n)]
    again = large.select("fp", "rep", F.explode(F.element_at(F.array(*below), F.col("block") + 1)).alias("s"))
    small, large = _split(again.select("s.block", "s.value", "fp", "rep"), tree_limit)
    links = links.unionByName(_in_trees(small, radius))
    if radius != 2:
        if large.limit(1).count():
            raise ValueError("shards over tree_limit need radius 2")
        return links
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[_bits(1 << bit) for bit in free]) for _, free in second])
    hot = large.select("block", "fp", "rep", F.explode(F.element_at(flips, F.col("block") + 1)).alias("flip"))
    keyed = hot.select("block", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "rep")
    least = keyed.groupBy("block", "key").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    half_way = keyed.join(least, ["block", "key"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    return links.unionByName(half_way)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id; one row per input row.

    component_id is the smallest doc_id reachable over links of at most radius differing bits. Equal fingerprints are
    joined to one before any search, so copies cost a row each and are never paired. Null and empty texts have fingerprint
    0 and link like any other; rows without doc_id take the component of their fingerprint (null if it has no doc_id) and
    connect nothing. Repeated rows are returned as often as they occur.
    """
    prints = cut(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "print-groups")
    edges = fingerprint_links(groups.where("rep IS NOT NULL"), radius, tree_limit)
    found = connected_components(edges)
    named = groups.join(found, groups["rep"] == found["node"], "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _row_key() -> Column:
    """Tells rows apart by doc_id and text; null and empty texts are alike."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node: XXH64 of a text's words. fp: SimHash of its distinct shingles. bands: keys of its MinHash bands. shingles: the
    distinct shingles' hashes, 32 bits each, in order."""
    for batch in batches:
        nodes, prints, bands, sets = [], [], [], []
        for text in batch.column("text"):
            words = _words(text.as_py())
            hashes = np.unique(_shingle_hashes(words, WIDE_SHINGLE))
            least = np.zeros(BANDS * ROWS, np.uint64)
            if len(hashes):
                mixed = hashes ^ (hashes >> np.uint64(32))
                least = np.array([(mixed * m).min() for m in _MINHASH])
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            prints.append(_majority(hashes))
            bands.append([xxhash.xxh64_intdigest(bytes([k]) + least[k * ROWS : (k + 1) * ROWS].tobytes(), SEED) for k in range(BANDS)])
            sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        keys = np.array(bands, np.uint64).view(np.int64).reshape(-1, BANDS)
        cols = [batch.column("doc_id"), batch.column("key"), long(nodes), long(prints), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "node", "fp", "bands", "shingles"])


def leaders(prints: list[int], radius: int) -> list[list[int]]:
    """For each fingerprint, the places of the leaders at most radius bits away; one with none leads and has only itself."""
    tree, places, out = BKTree(), [], []
    for i, value in enumerate(prints):
        near = [places[k] for k in tree.within(value, radius)]
        if not near:
            tree.add(value)
            places.append(i)
        out.append(near or [i])
    return out


def _leader_links(radius: int):
    """Rows sorted by (band, part) -> band, fp, a, b: a row's node and each of its leaders' nodes; leaders have a = b."""

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        band, fp, node = rows
        own, lead = [], []
        for i, near in enumerate(leaders(fp.view(np.uint64).tolist(), radius)):
            own += [i] * len(near)
            lead += near
        cols = [pa.array(band[own]), pa.array(fp[own]), pa.array(node[own]), pa.array(node[lead])]
        return pa.RecordBatch.from_arrays(cols, ["band", "fp", "a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in ("band", "part", "fp", "node")]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            edges = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            for lo, hi in zip([0, *edges[:-1]], edges):
                yield linked([held[k][lo:hi] for k in (0, 2, 3)])
            held = [x[edges[-1] :] for x in held] if len(edges) else held
        if held is not None and len(held[0]):
            yield linked([held[k] for k in (0, 2, 3)])

    return links


def _led(rows: DataFrame, radius: int) -> DataFrame:
    """rows (band, part, fp, node) through leaders(). Each band has an order of its own, so other texts lead in it."""
    rows = rows.repartition("band", "part").sortWithinPartitions("band", "part", F.xxhash64("band", "fp"), "node")
    return rows.select("band", "part", "fp", "node").mapInArrow(_leader_links(radius), "band long, fp long, a long, b long")


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            alike.append(both >= WIDE_SIMILARITY * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))


def shingle_links(sketches: DataFrame, part_rows: int = TREE_LIMIT) -> DataFrame:
    """sketches (node, fp, bands, shingles) -> edges (a, b) of nodes whose shingle sets are similar.

    A band's key is a shard. Its fingerprints go through a BK-tree that holds leaders: a text follows only edges within the
    radius, is paired with each leader it finds, and leads itself where it finds none. So a family of copies costs a pair for
    each of them. A shard of over part_rows rows is dealt to several tasks in parts; the parts' leaders then go through a tree of
    the whole shard. Pairs are verified by the exact Jaccard similarity of all their shingles. Texts that are both near a
    leader but not similar to it aren't paired, nor are texts further apart than the radius: across_links() finds these.
    """
    rows = sketches.select("node", "fp", F.explode("bands").alias("band")).distinct()
    sizes = rows.groupBy("band").count().where(F.col("count") > part_rows)
    rows = rows.join(sizes, "band", "left")
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / part_rows)), F.lit(0)).cast("long")
    found = cut(_led(rows.withColumn("part", part), WIDE_RADIUS), "led")
    heads = found.where("a = b").join(sizes, "band", "left_semi").select("band", F.lit(0).cast("long").alias("part"), "fp", F.col("a").alias("node"))
    pairs = found.select("a", "b").unionByName(_led(heads, WIDE_RADIUS).select("a", "b")).where("a <> b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes")
    n = ids.count()
    some = possible_hits(sketches.select("node", "shingles"), "node", bloom_filter(ids, "node", n), n).where("possible")
    some = cut(some.join(ids, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"]), "near-shingles")
    x, y = (some.select(F.col("node").alias(a), F.col("shingles").alias(s)) for a, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long")


def _similar_across(rows: list) -> list[tuple[int, int]]:
    """rows (cell, side, component, node, shingles) of one cell -> (node, node) links that join all its components which similar
    texts connect. Where a cell has two sides, only texts of different sides are compared.

    The largest component's texts are compared with no others of it; each text of another one with all of the components before.
    """
    number: dict[int, int] = {}
    for r in rows:
        number[r[2]] = number.get(r[2], 0) + 1
    rows = sorted(rows, key=lambda r: (-number[r[2]], r[2]))
    sets = [np.frombuffer(r[4], np.uint32) for r in rows]
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    side, two = np.array([r[1] for r in rows]), len({r[1] for r in rows}) > 1
    root = {c: c for c in number}
    mark, out, first = np.zeros(len(known), bool), [], 0

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for i, r in enumerate(rows):
        first = i if i and r[2] != rows[i - 1][2] else first
        if not first:
            continue
        own = flat[ends[i] : ends[i + 1]]
        mark[own] = True
        sums = np.concatenate([[0], np.cumsum(mark[flat[: ends[first]]])])
        mark[own] = False
        both = sums[ends[1 : first + 1]] - sums[ends[:first]]
        alike = both >= WIDE_SIMILARITY * (sizes[:first] + sizes[i] - both)
        for j in np.flatnonzero(alike & (side[:first] != side[i]) if two else alike).tolist():
            a, b = top(r[2]), top(rows[j][2])
            if a != b:
                root[a] = b
                out.append((r[3], rows[j][3]))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def linked(rows: list) -> pa.RecordBatch:
        found = _similar_across(rows)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "component", "node", "shingles"))):
            if held and held[0][0] != row[0]:
                yield linked(held)
                held = []
            held.append(row)
    if held:
        yield linked(held)


def across_links(sketches: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) that shingle_links() left out and that join components of found (node, component): exact in each band.

    In a band that has texts of several components, each text outside the band's largest component is compared with all
    texts of other components by all their shingles, whatever their fingerprints. Both groups are dealt out in parts of
    ACROSS_ROWS and about ACROSS_BYTES, two of which make a cell for one task. So a family that is one component already costs as
    many comparisons as it has texts for each outsider, and texts that share a band and aren't similar the square of their number.
    """
    rows = sketches.select("node", "bands", F.octet_length("shingles").cast("long").alias("size")).dropDuplicates(["node"])
    rows = rows.join(found.select("node", F.col("component").alias("of")), "node", "left")
    rows = rows.select("node", "size", F.coalesce("of", "node").alias("component"), F.explode("bands").alias("band")).distinct()
    rows = held = cut(rows, "band-rows")
    each = rows.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bands = each.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    per = F.greatest(F.lit(1), F.least(F.lit(ACROSS_ROWS), F.floor(F.lit(ACROSS_BYTES) * F.col("n") / F.greatest("size", F.lit(1)))))
    parts = [F.ceil(F.col("most.n") / per).alias("p"), F.ceil((F.col("n") - F.col("most.n")) / per).alias("q")]
    rows = rows.join(bands.where("kinds > 1").select("band", F.col("most.component").alias("most"), *parts), "band")
    draw, inside = F.xxhash64("band", "node"), F.col("component") == F.col("most")
    rows = rows.withColumn("part", F.when(inside, F.pmod(draw, "p")).otherwise(F.col("p") + F.pmod(draw, "q")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    cell = F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("cell")
    rows = cut(rows.select(cell, (F.col("part") > F.col("other")).alias("side"), "component", "node"), "cells")
    drop(held)
    texts = sketches.join(rows.select("node").distinct(), "node", "left_semi").select("node", "shingles").dropDuplicates(["node"])
    rows = rows.join(texts, "node").repartition("cell").sortWithinPartitions("cell")
    return rows.select("cell", "side", "component", "node", "shingles").mapInArrow(_cells, "a long, b long")


def keep_documents(docs: DataFrame, part_rows: int = TREE_LIMIT) -> DataFrame:
    """One document of each group of similar texts, that with the smallest doc_id (null last); docs' columns.

    Groups are the components of shingle_links() and across_links(). Texts with the same words are in one group; so are all texts without words.
    Rows without doc_id belong to groups like any other, and rows that share a doc_id but have unlike texts are in different ones.
    Of rows with equal doc_id and text one stays.
    """
    key = "tarn row key"
    keyed = docs.select("doc_id", "text", _row_key().alias("key"))
    kind = "doc_id long, key string, node long, fp long, bands array<long>, shingles binary"
    sketches = cut(keyed.mapInArrow(_sketches, kind), "sketches")
    found = cut(connected_components(shingle_links(sketches, part_rows)), "near-groups")
    more = cut(across_links(sketches, found), "across")
    found = joined_components(found, more) if more.limit(1).count() else found
    found = found.withColumnRenamed("node", "n_node")
    rows = sketches.groupBy("node", "doc_id", "key").agg(F.count("*").alias("n")).join(found, F.col("node") == F.col("n_node"), "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")
    stay = cut(rows.groupBy("component").agg(F.min(order).alias("s")).select("s.key", "s.n"), "stay")
    kept = docs.withColumn(key, _row_key()).join(stay.select(F.col("key").alias(key)), key, "left_semi")
    kept = kept.dropDuplicates([key]) if stay.where("n > 1").limit(1).count() else kept
    return kept.select(*docs.columns)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
