"""Removal of repeated passages by longest-previous-factor arrays over anchored suffix buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import cut, cut_bucketed

#: Bytes of a string that must not repeat, and of the anchors by which its occurrences meet.
MATCH = 50
GRAM = 24
SPAN = MATCH - GRAM + 1
#: Bytes of text that are packed, and so searched for repeats of their own, together.
PACK_BYTES = 8 << 20
#: Bytes of text for each bucket. Every pack sends a row to nearly every bucket, so rows are (bytes / PACK_BYTES) * (bytes /
#: BUCKET_BYTES): with small packs and buckets their handling, not their contents, takes the time of large tables.
BUCKET_BYTES = 8 << 20
#: Positions whose hashes are in memory at once.
CHUNK = 1 << 14
#: Suffixes that are sorted together, beyond those of one anchor.
SORT_STARTS = 1 << 16
_PLACE = np.uint64((1 << 18) - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- packs: a few MB of documents in one row


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context, made = TaskContext.get(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        number = (context.partitionId() << 24) | made
        raw = b"".join(texts)
        blob = zstandard.ZstdCompressor(level=1).compress(raw)
        known = np.array([_LAST if i is None else i for i in ids], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        cols = [pa.array([number]), pa.array([len(raw)]), pa.array([known.tobytes()]), pa.array([sizes.tobytes()]), pa.array([blob])]
        return pa.RecordBatch.from_arrays(cols, ["pack", "n_raw", "ids", "sizes", "body"])

    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text")):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            ids.append(i.as_py())
            texts.append(raw)
            size += len(raw)
            if size >= PACK_BYTES:
                yield row()
                made, ids, texts, size = made + 1, [], [], 0
    if ids:
        yield row()


class Pack:
    """Documents laid end to end: their ids, their bounds, and the bytes."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.bounds[-1]) or 1) if self.bounds[-1] else b""

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor hash, document, anchor) of each run of string starts that share an anchor.

        The anchor of a string of MATCH bytes is the place of its least hash of GRAM bytes, the first of equals. It depends
        on the string alone, so equal strings have equal anchors at equal offsets.
        """
        n = len(self.raw) - MATCH + 1
        parts: list[tuple[np.ndarray, ...]] = []
        data = np.frombuffer(self.raw, np.uint8)
        for base in range(0, max(0, n), CHUNK):
            count = min(CHUNK, n - base)
            grams = _gram_hashes(data[base : base + count + MATCH - 1])
            keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            least = keyed
            for step in (1, 2, 4, 8):
                least = np.minimum(least[:-step], least[step:])
            least = np.minimum(least[: len(least) - (SPAN - 16)], least[SPAN - 16 :])[:count]
            anchor = (least & _PLACE).astype(np.int64)
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            inner = self.bounds[(self.bounds > base) & (self.bounds < base + count)] - base
            cuts = np.unique(np.concatenate([[0], cuts, inner]))
            ends = np.concatenate([cuts[1:], [count]]) - 1
            parts.append((cuts + base, ends + base, grams[anchor[cuts]], anchor[cuts] + base))
        if not parts:
            none = np.array([], np.int64)
            return none, none, none.astype(np.uint64), none, none
        first, last, hashes, anchor = (np.concatenate(x) for x in zip(*parts))
        # least hashes crowd at the low end; the buckets cut the range of these evenly
        hashes = hashes * np.uint64(0xA24BAED4963EE407)
        hashes ^= hashes >> np.uint64(31)
        hashes *= _MUL
        doc = np.searchsorted(self.bounds, first, side="right") - 1
        last = np.minimum(last, self.bounds[doc + 1] - MATCH)
        inside = last >= first
        return first[inside], last[inside], hashes[inside], doc[inside], anchor[inside]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM = 16 + 8 bytes from each place, by doubling."""
    by_width = {1: data.astype(np.uint64) + np.uint64(1)}
    for width in (1, 2, 4, 8):
        h, power = by_width[width], np.uint64(pow(int(_MUL), width, 1 << 64))
        by_width[2 * width] = h[:-width] * power + h[width:]
    eighth = by_width[8]
    n = len(data) - GRAM + 1
    h = by_width[16][:n] * np.uint64(pow(int(_MUL), 8, 1 << 64)) + eighth[16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _packs(batch: pa.RecordBatch) -> Iterator[tuple[int, Pack, int]]:
    for i in range(batch.num_rows):
        at = {name: batch.column(name)[i].as_py() for name in ("pack", "ids", "sizes", "body")}
        yield at["pack"], Pack(at["ids"], at["sizes"], at["body"]), i


# ---------------------------------------------------------------- which anchors occur in two documents or more


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _distinct_anchors(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, whether they are in several documents)."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.array([], bool)
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(h)]]).astype(np.int64) - 1
    return h[starts], d[starts] != d[ends] if len(h) else np.array([], bool)


def _anchor_rows(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pack, _ in _packs(batch):
                _, _, hashes, doc, _ = pack.segments()
                known, several = _distinct_anchors(hashes, doc)
                # 39 bits tell a bucket's anchors apart well enough: a false match costs work, not results
                short = ((known & np.uint64((1 << 40) - 1)) >> np.uint64(1) << np.uint64(1)) | several.astype(np.uint64)
                where = _bucket(known, buckets)
                edges = np.flatnonzero(np.diff(where)) + 1
                out = [(int(where[lo]), _five(short[lo:hi])) for lo, hi in _slices(edges, len(where))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in out], pa.int64()),
                        pa.array([number] * len(out), pa.int64()),
                        pa.array([x for _, x in out], pa.binary()),
                    ],
                    ["bucket", "pack", "anchors"],
                )

    return rows


def _slices(edges: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    if n:
        yield from zip([0, *edges.tolist()], [*edges.tolist(), n])


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _shared_anchors(table: pa.Table) -> pa.Table:
    """One bit for each of a pack's anchors in this bucket: whether another document has it."""
    packs = table.column("pack").to_pylist()
    lists = [_unfive(x) for x in table.column("anchors").to_pylist()]
    every = np.concatenate(lists)
    order = np.argsort(every >> np.uint64(1), kind="stable")
    value = every[order] >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(value)]]))
    several = np.maximum.reduceat(every[order] & np.uint64(1), starts).astype(bool) | (sizes > 1)
    shared = np.empty(len(every), bool)
    shared[order] = np.repeat(several, sizes)
    out, at = [], 0
    bucket = table.column("bucket")[0].as_py()
    for number, x in zip(packs, lists):
        bits = shared[at : at + len(x)]
        at += len(x)
        if bits.any():
            out.append((number, bucket, np.packbits(bits).tobytes()))
    cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.Table.from_arrays(cols, ["pack", "bucket", "shared"])


# ---------------------------------------------------------------- suffix buckets


class SharedSegments:
    """The segments of a pack whose anchor another document has too, equal contents told apart once."""

    def __init__(self, pack: Pack, shared: list[dict] | None, buckets: int) -> None:
        first, last, hashes, doc, anchor = pack.segments()
        order = np.argsort(hashes, kind="stable")
        in_order = hashes[order]
        new = np.concatenate([[True], in_order[1:] != in_order[:-1]]) if len(hashes) else np.array([], bool)
        known = in_order[new]
        flag = np.zeros(len(known), bool)
        where = _bucket(known, buckets)
        for part in shared or ():
            lo, hi = np.searchsorted(where, [part["bucket"], part["bucket"] + 1])
            flag[lo:hi] = np.unpackbits(np.frombuffer(part["shared"], np.uint8))[: hi - lo].astype(bool)
        hot = np.empty(len(hashes), bool)
        hot[order] = flag[np.cumsum(new) - 1]
        self.first, self.last, self.doc = first[hot], last[hot], doc[hot]
        hashes, raw = hashes[hot], pack.raw
        places: dict[bytes, int] = {}
        self.content = np.fromiter(
            (places.setdefault(raw[a : b + MATCH], len(places)) for a, b in zip(self.first.tolist(), self.last.tolist())),
            np.int64,
            len(self.first),
        )
        self.contents = list(places)
        self.owner = np.full(len(places), _LAST, np.int64)
        np.minimum.at(self.owner, self.content, pack.ids[self.doc])
        self.bucket = np.zeros(len(places), np.int64)
        self.bucket[self.content] = _bucket(hashes, buckets)
        self.offset = np.zeros(len(places), np.uint8)
        self.offset[self.content] = anchor[hot] - self.first


def _segment_rows(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pack, i in _packs(batch):
                found = SharedSegments(pack, batch.column("shared")[i].as_py(), buckets)
                order = np.argsort(found.bucket, kind="stable")
                edges = np.flatnonzero(np.diff(found.bucket[order])) + 1
                packer = zstandard.ZstdCompressor(level=3)
                out = []
                for lo, hi in _slices(edges, len(order)):
                    own = order[lo:hi]
                    texts = [found.contents[k] for k in own]
                    widths = np.fromiter(map(len, texts), np.uint8, len(texts))
                    gaps = np.diff(own, prepend=0).astype(np.int32)
                    sides = (widths, found.offset[own], found.owner[own].view(np.uint8).reshape(-1, 8).T, gaps.view(np.uint8).reshape(-1, 4).T)
                    side = packer.compress(b"".join(x.tobytes() for x in sides))
                    out.append((int(found.bucket[own[0]]), number, side, packer.compress(b"".join(texts))))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                cols = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "pack", "side", "body"])

    return rows


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the nearest earlier value that is smaller, -1 without one; by jumping over what is known to be no smaller."""
    prev = np.arange(len(values)) - 1
    open_ = np.flatnonzero(prev >= 0)
    while len(open_):
        open_ = open_[values[prev[open_]] >= values[open_]]
        prev[open_] = prev[prev[open_]]
        open_ = open_[prev[open_] >= 0]
    return prev


def longest_previous_factors(owners: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, owner) of the match with an earlier document for each suffix, in suffix order.

    owners: the suffixes' documents; lcp[i]: bytes that suffix i shares with suffix i - 1, up to MATCH. The longest match
    with a smaller owner is with the previous or the next smaller owner in suffix order, and its length is the least lcp on
    the way. The owner that is returned is the smallest one over matches of MATCH bytes, where those links end.
    """
    n = len(owners)
    before = previous_smaller(owners)
    after = n - 1 - previous_smaller(owners[::-1])[::-1]
    least = _range_min(lcp)
    length = np.zeros(n, np.int64)
    at = np.arange(n)
    ok = before >= 0
    length[ok] = least(before[ok] + 1, at[ok])
    ok = after < n
    length[ok] = np.maximum(length[ok], least(at[ok] + 1, after[ok]))
    reach = np.zeros(n, bool)
    ok = before >= 0
    reach[ok] = least(before[ok] + 1, at[ok]) >= MATCH
    link = np.where(reach, before, at)
    other = np.zeros(n, bool)
    ok = after < n
    other[ok] = least(at[ok] + 1, after[ok]) >= MATCH
    link = np.where(other & (~reach | (owners[np.minimum(after, n - 1)] < owners[link])), np.minimum(after, n - 1), link)
    while True:
        further = link[link]
        if np.array_equal(further, link):
            return length, owners[link]
        link = further


def _range_min(values: np.ndarray):
    """f(lo, hi): least of values[lo..hi], both inclusive."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), values.dtype)
        size = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(size):
            m = size == k
            out[m] = np.minimum(levels[k][lo[m]], levels[k][hi[m] - (1 << int(k)) + 1])
        return out

    return least


def _compare(pick: np.ndarray, text: np.ndarray, offsets: np.ndarray, base: np.ndarray, n_starts: np.ndarray, best: np.ndarray) -> None:
    """Sorts the suffixes of the picked contents and sets `best` to their strings' smallest documents."""
    n = n_starts[pick]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(base[pick], n) + inner
    docs = best[place]
    padded = np.zeros((len(place), -(-MATCH // 8) * 8), np.uint8)
    padded[:, :MATCH] = np.lib.stride_tricks.sliding_window_view(text, MATCH)[np.repeat(offsets[pick], n) + inner]
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((docs, *keys.T[::-1]))
    padded = padded[order]
    differ = padded[1:] != padded[:-1]
    lcp = np.zeros(len(order), np.uint8)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), MATCH)
    length, earliest = longest_previous_factors(docs[order], lcp)
    best[place[order]] = np.where(length >= MATCH, earliest, docs[order])


def _earliest(table: pa.Table) -> pa.Table:
    """For each pack's contents in this bucket: the smallest document of each of its strings, where that isn't its own."""
    names: dict[bytes, int] = {}
    owner: list[int] = []
    offset: list[int] = []
    rows = []
    unpack = zstandard.ZstdDecompressor()
    for number, side, body in zip(*(table.column(c) for c in ("pack", "side", "body"))):
        side = np.frombuffer(unpack.decompress(side.as_buffer()), np.uint8)
        body, n, ids = unpack.decompress(body.as_buffer()), len(side) // 14, []
        own = np.ascontiguousarray(side[2 * n : 10 * n].reshape(8, n).T).view(np.int64).ravel()
        places = np.cumsum(np.ascontiguousarray(side[10 * n :].reshape(4, n).T).view(np.int32).ravel(), dtype=np.int64)
        lo = 0
        for hi, doc, at in zip(np.cumsum(side[:n], dtype=np.int64).tolist(), own.tolist(), side[n : 2 * n].tolist()):
            k = names.setdefault(body[lo:hi], len(owner))
            if k == len(owner):
                owner.append(doc)
                offset.append(at)
            elif doc < owner[k]:
                owner[k] = doc
            ids.append(k)
            lo = hi
        rows.append((number.as_py(), np.array(ids, np.int64), own, places.astype(np.int32)))
    owners = np.array(owner, np.int64)
    widths = np.fromiter(map(len, names), np.int64, len(names))
    n_starts = widths - MATCH + 1
    base = np.concatenate([[0], np.cumsum(n_starts)])
    best = np.repeat(owners, n_starts)
    text = np.frombuffer(b"".join(names), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(widths)])[:-1]
    names.clear()
    grams = np.lib.stride_tricks.sliding_window_view(text, GRAM)[offsets + np.array(offset, np.int64)]
    eights = np.ascontiguousarray(grams).view("<u8")
    anchors = np.zeros(len(grams), np.uint64)
    for k in range(eights.shape[1]):
        anchors = (anchors ^ eights[:, k]) * _MUL
        anchors ^= anchors >> np.uint64(29)
    # a string only occurs under its own anchor: anchors are sorted apart, and one with one content has nothing to compare
    order = np.argsort(anchors, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(anchors[order]) != 0]))
    ends = np.concatenate([starts[1:], [len(order)]])
    mixed = ends - starts > 1
    held, size = [], 0
    for lo, hi in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        held.append(order[lo:hi])
        size += int(n_starts[held[-1]].sum())
        if size >= SORT_STARTS:
            _compare(np.concatenate(held), text, offsets, base, n_starts, best)
            held, size = [], 0
    if held:
        _compare(np.concatenate(held), text, offsets, base, n_starts, best)
    out = []
    for number, ids, own, places in rows:
        lowest = np.minimum.reduceat(best, base[:-1])[ids]
        told = np.flatnonzero(lowest < own)
        if len(told):
            sizes = n_starts[ids[told]]
            take = np.repeat(base[ids[told]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            packer = zstandard.ZstdCompressor(level=1)
            out.append((number, places[told].tobytes(), packer.compress(best[take].tobytes())))
    cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
    return pa.Table.from_arrays(cols, ["pack", "places", "earliest"])


# ---------------------------------------------------------------- what is left of the documents


def _removed(pack: Pack, found: SharedSegments, answers: list[dict] | None) -> np.ndarray:
    sizes = np.fromiter(map(len, found.contents), np.int64, len(found.contents)) - MATCH + 1
    base = np.concatenate([[0], np.cumsum(sizes)])
    best = np.repeat(found.owner, sizes)
    for part in answers or ():
        places = np.frombuffer(part["places"], np.int32)
        values = np.frombuffer(zstandard.ZstdDecompressor().decompress(part["earliest"]), np.int64)
        n = sizes[places]
        at = np.repeat(base[places] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        best[at] = values
    n = found.last - found.first + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(found.first, n) + inner
    earliest = best[np.repeat(base[found.content], n) + inner]
    gone = starts[earliest < np.repeat(pack.ids[found.doc], n)]
    cover = np.zeros(len(pack.raw) + MATCH + 1, np.int32)
    cover[gone] += 1
    cover[gone + MATCH] -= 1
    return np.cumsum(cover)[: len(pack.raw)] > 0


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
     ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def _judged(buckets: int, with_kept: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, pack, i in _packs(batch):
                found = SharedSegments(pack, batch.column("shared")[i].as_py(), buckets)
                gone = _removed(pack, found, batch.column("answers")[i].as_py())
                edges = np.flatnonzero(np.diff(gone.astype(np.int8))) + 1
                edges = np.unique(np.concatenate([[0], edges, pack.bounds])) if len(gone) else pack.bounds[:1]
                out = {name: [] for name in _OUT.names}
                at = 0
                for k, doc in enumerate(pack.ids.tolist()):
                    lo, hi = int(pack.bounds[k]), int(pack.bounds[k + 1])
                    spans, left = [], []
                    at = int(np.searchsorted(edges, lo))
                    while hi > lo and edges[at] < hi:
                        a, b = int(edges[at]), int(edges[at + 1])
                        if gone[a]:
                            spans.append({"start": a - lo, "end": b - lo})
                        else:
                            left.append(pack.raw[a:b])
                        at += 1
                    rest = b"".join(left)
                    out["doc_id"].append(None if doc == _LAST else doc)
                    out["n_bytes"].append(hi - lo)
                    out["removed"].append(spans)
                    out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                    out["kept"].append(rest if with_kept else None)
                yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return judge


def bucket_count(n_bytes: int | None) -> int:
    """Buckets for n_bytes of text, whatever the session's number of shuffle partitions."""
    return min(1 << 24, max(1, -(-(n_bytes or 0) // BUCKET_BYTES)))


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, removed: array<struct(start, end)>, kept_sha256, kept; a row per input row.

    A byte goes if a string of MATCH bytes over it also starts in a document with a smaller doc_id. Every string has an
    anchor, so equal strings meet under it. (1) Documents are packed a few MB to a row in the shared folder,
    bucketed by pack so that what is found for them comes to them and they are never shuffled. (2) Packs send
    their distinct anchors, five bytes each, and learn which of them other documents have. (3) The text around those, once
    per pack however often it occurs there, goes to the anchor's suffix bucket; there the suffixes are sorted and their
    longest-previous-factor array gives each string's earliest document. (4) Packs get these answers and cut. A passage
    in a third of all documents so costs a row per pack, and no pairs are made. Buckets are as many as the text's bytes ask for.

    Null text counts as empty; texts of fewer than MATCH bytes lose nothing. Repeated rows have equal doc_ids, so neither
    is earlier. Rows without doc_id count as later than all others, and not as each other's. Spans are byte offsets; what is
    kept may start or end inside a character and is therefore binary (null unless with_kept).
    """
    packs = docs.select("doc_id", "text").mapInArrow(_pack, "pack long, n_raw long, ids binary, sizes binary, body binary")
    packs = cut_bucketed(packs, "packs", "pack")
    buckets = bucket_count(packs.agg(F.sum("n_raw")).first()[0])
    anchors = packs.mapInArrow(_anchor_rows(buckets), "bucket long, pack long, anchors binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, "pack long, bucket long, shared binary")
    shared = shared.groupBy("pack").agg(F.collect_list(F.struct("bucket", "shared")).alias("shared"))
    shared = cut(shared, "shared-anchors")
    packs = packs.join(shared, "pack", "left")
    segments = packs.mapInArrow(_segment_rows(buckets), "bucket long, pack long, side binary, body binary")
    answers = segments.groupBy("bucket").applyInArrow(_earliest, "pack long, places binary, earliest binary")
    answers = answers.groupBy("pack").agg(F.collect_list(F.struct("places", "earliest")).alias("answers"))
    kind = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    return packs.join(answers, "pack", "left").mapInArrow(_judged(buckets, with_kept), kind)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, with_kept=False).select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )
