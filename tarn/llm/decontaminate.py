"""Benchmark decontamination: template windows in which numbers, names and units are typed placeholders."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tarn.llm.shared import cut

WINDOW = 8
#: Words of a window that must not be placeholders.
LEAST_LITERALS = 4
#: Share of an item's template that a document must hold, in windows that agree on their slots.
LEAST_SHARE = 0.5
#: Words in a row that are a hit verbatim, whatever share of a longer item they are.
LONG_RUN = 50
#: Bits for each benchmark window, and at most, of the bitmap that windows of documents pass before they are joined. A window's
#: bits are at its hash shifted by each of PROBES.
BITS_PER_WINDOW, MOST_BITS, PROBES = 128, 1 << 27, (0, 18, 37)
#: Characters of documents whose windows are hashed together.
CHUNK = 1 << 19
MEMO_WORDS = 200_000
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs hour hours day days week weeks month months year years "
    "minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet "
    "inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents "
    "percent degrees watt watts volt volts hz khz mhz ghz kb mb gb tb usd eur".split()
)
_TOKEN = re.compile(r"[.!?\n]|\d+(?:[.,]\d+)*|[^\W\d_]+")
_BREAK, _NUMBER, _NAME, _UNIT, _FIRST = 0, 1, 2, 3, 4
_CAPITAL, _MEASURE, _DIGITS = 1 << 40, 1 << 41, 1 << 42
_MASK = (1 << 40) - 1
_MUL = 0x9E3779B97F4A7C15
#: Forms of a text, and what of it is a placeholder: numbers and units; names as well, unless they start a sentence; these too;
#: nothing.
FORMS = PLAIN, NAMED, LOOSE, SURFACE = range(4)


class Codes(dict):
    """token -> code: 40 bits of a word's or number's hash, lower-cased; flags for a capital, for a word that may be a unit and
    for a number."""

    def __missing__(self, token: str) -> int:
        if token[0] in ".!?\n":
            code = _BREAK
        else:
            low = token.lower()
            code = max(_FIRST, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & _MASK)
            if token[0].isdigit() or token[0].isdecimal():
                code |= _DIGITS
            else:
                code |= (_CAPITAL if token[0].isupper() else 0) | (_MEASURE if low in UNITS else 0)
        if len(self) < MEMO_WORDS:
            self[token] = code
        return code


_codes = Codes()


def template(tokens: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keep, forms): the places of words among tokens, and the words' codes in each of FORMS. Words are lower-cased in all.
    Numbers, units after a number and, by form, capitalised words are placeholders. Punctuation and line ends only end
    sentences."""
    raw = np.fromiter(map(_codes.__getitem__, tokens), np.int64, len(tokens))
    stops = raw == _BREAK
    keep = np.flatnonzero(~stops)
    words = raw[keep]
    surface = words & _MASK
    number = words & _DIGITS != 0
    starts = np.concatenate([[True], stops[:-1]])[keep]
    plain = np.where(number, _NUMBER, surface)
    measure = np.flatnonzero((words & _MEASURE != 0) & (keep > 0))
    unit = measure[raw[keep[measure] - 1] & _DIGITS != 0]
    plain[unit] = _UNIT
    capital = words & _CAPITAL != 0
    capital[unit] = False
    named = np.where(capital & ~starts, _NAME, plain)
    return keep, [plain, named, np.where(capital, _NAME, plain), surface]


def _sums(marked: np.ndarray, width: int) -> np.ndarray:
    """For each window, how many marked words it holds."""
    n = np.concatenate([[0], np.cumsum(marked)])
    return n[width:] - n[:-width]


def window_hashes(forms: list[np.ndarray], width: int, inside: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(form, starts, hashes) of the windows with enough literals, of those marked in inside if given. A window is given in the
    forms in which it differs from the form before; as SURFACE only if it has too few literals as PLAIN."""
    n = len(forms[0]) - width + 1
    if n <= 0:
        return
    inside = np.ones(n, bool) if inside is None else inside
    least = min(LEAST_LITERALS, max(1, width // 2))
    for form in FORMS:
        codes = forms[form]
        good = inside & (_sums(codes >= _FIRST, width) >= least)
        if form == PLAIN:
            dense = ~good
        elif form == SURFACE:
            good &= dense
        else:
            good &= _sums(codes != forms[form - 1], width) > 0
        starts = np.flatnonzero(good)
        if len(starts):
            yield form, starts, _polynomial(codes, width)[starts]


def _polynomial(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width codes from each place, by doubling."""
    h, size, out, done = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    n = len(codes) - width + 1
    h ^= h >> np.uint64(32)
    while size <= width:
        if width & size:
            part = h[done : done + n]
            out = part if out is None else out * np.uint64(pow(_MUL, size, 1 << 64)) + part
            done += size
        if 2 * size <= width:
            h = h[:-size] * np.uint64(pow(_MUL, size, 1 << 64)) + h[size:]
        size *= 2
    out = out * np.uint64(2 * width + 1)
    return out ^ (out >> np.uint64(31))


class Benchmark:
    """Windows of items, as a hash table: hash -> (item, place, form)."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        self.items, self.ids = [], []
        self.table: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            tokens = _TOKEN.findall(text or "")
            keep, forms = template(tokens)
            if not len(keep):
                continue
            self.items.append((forms, [tokens[i].lower() for i in keep]))
            self.ids.append(item_id)
            width = min(WINDOW, len(keep))
            for form, starts, hashes in window_hashes(forms, width):
                for at, h in zip(starts.tolist(), hashes.tolist()):
                    self.table[width][h].append((len(self.ids) - 1, at, form))
        self.sorted = {w: np.sort(np.fromiter(t, np.uint64, len(t))) for w, t in self.table.items()}

    def matches(self, text: str | None) -> list[tuple[int, float, bool]]:
        """(item_id, share of its template found, whether a slot's filling differs) of the items that text contains."""
        tokens = _TOKEN.findall(text or "")
        keep, forms = template(tokens)
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for width, known in self.sorted.items():
            for form, starts, hashes in window_hashes(forms, width):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                for start, h in zip(starts[hit].tolist(), hashes[hit].tolist()):
                    for item, place, other in self.table[width][h]:
                        if np.array_equal(forms[form][start : start + width], self.items[item][0][other][place : place + width]):
                            found[item] |= {(place + i, start + i) for i in range(width)}
        out = []
        for item, pairs in found.items():
            share, changed = self._consistent(item, pairs, keep, tokens)
            if share >= LEAST_SHARE:
                out.append((self.ids[item], share, changed))
            elif self._verbatim(item, pairs, keep, tokens) >= LONG_RUN:
                out.append((self.ids[item], share, False))
        return sorted(out)

    def _verbatim(self, item: int, pairs: set[tuple[int, int]], keep: np.ndarray, tokens: list[str]) -> int:
        """Words of the longest run that the item and the text have in common, within the windows found."""
        surface = self.items[item][1]
        same = {(place, at) for place, at in pairs if tokens[keep[at]].lower() == surface[place]}
        longest, runs = 0, {}
        for place, at in sorted(same):
            runs[place, at] = runs.get((place - 1, at - 1), 0) + 1
            longest = max(longest, runs[place, at])
        return longest

    def _consistent(self, item: int, pairs: set[tuple[int, int]], keep: np.ndarray, tokens: list[str]) -> tuple[float, bool]:
        """Share of the item in one occurrence whose slots are filled consistently: equal fillings in the item have equal
        fillings in the text, different ones different. Occurrences are told apart by their offset, give or take a few
        inserted or dropped words."""
        (_, _, tpl, _), surface = self.items[item]
        by_offset: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place, at in sorted(pairs):
            by_offset[at - place].append((place, at))
        best, changed = 0.0, False
        for offset in by_offset:
            near = [p for o in range(offset - 3, offset + 4) for p in by_offset.get(o, ())]
            ahead: dict[tuple[int, str], str] = {}
            back: dict[tuple[int, str], str] = {}
            seen, differs = set(), False
            for place, at in sorted(near, key=lambda p: (abs(p[1] - p[0] - offset), p)):
                if place in seen:
                    continue
                kind = int(tpl[place])
                if kind < _FIRST:
                    here = tokens[keep[at]].lower()
                    if ahead.setdefault((kind, surface[place]), here) != here or back.setdefault((kind, here), surface[place]) != surface[place]:
                        continue
                    differs |= here != surface[place]
                seen.add(place)
            if len(seen) / len(tpl) > best:
                best, changed = len(seen) / len(tpl), differs
        return best, changed


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item"), batch.column("text")):
            keep, forms = template(_TOKEN.findall(text.as_py() or ""))
            width = min(WINDOW, len(keep))
            found = [h for _, _, h in window_hashes(forms, width)] if width else []
            hashes = np.unique(np.concatenate(found)).view(np.int64) if found else np.array([], np.int64)
            cols = [pa.array(hashes), pa.array([item.as_py()] * len(hashes), pa.int64()), pa.array([width] * len(hashes), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["hash", "item", "width"])


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """bits / 8 bytes in which the windows' bits are set; put together on the executors, at most MOST_BITS."""
    probes = F.array(*[F.shiftrightunsigned("hash", p).bitwiseAND(bits - 1) for p in PROBES])
    at = F.col("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    rows = windows.select(F.explode(probes).alias("at")).groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(bit).alias("set")).toPandas()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out.view(np.uint8)


def _marked(model, bits: int, widths: list[int]):
    """Adds `hits`: the distinct hashes of a text's windows that pass the bitmap."""

    def hits(texts: list[str]) -> Iterator[np.ndarray]:
        bitmap = model.value
        tokens, sizes = [], []
        for text in texts:
            before = len(tokens)
            tokens += _TOKEN.findall(text)
            tokens.append("\n")
            sizes.append(len(tokens) - before)
        keep, forms = template(tokens)
        doc = np.repeat(np.arange(len(texts)), sizes)[keep]
        where, values = [], []
        for width in widths:
            inside = doc[: len(doc) - width + 1] == doc[width - 1 :]
            for _, starts, hashes in window_hashes(forms, width, inside):
                on = np.arange(len(hashes))
                for probe in PROBES:
                    at = (hashes[on] >> np.uint64(probe) & np.uint64(bits - 1)).astype(np.int64)
                    on = on[(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                where.append(doc[starts[on]])
                values.append(hashes[on])
        where = np.concatenate(where) if where else np.array([], np.int64)
        order = np.argsort(where, kind="stable")
        values = np.concatenate(values)[order].view(np.int64) if len(where) else np.array([], np.int64)
        bounds = np.searchsorted(where[order], np.arange(len(texts) + 1))
        for lo, hi in zip(bounds, bounds[1:]):
            yield np.unique(values[lo:hi])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for text in batch.column("text"):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= CHUNK:
                    found += hits(held)
                    held, size = [], 0
            found += hits(held) if held else []
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, _HITS])

    return mark


_ROW, _HITS = "tarn document row", "tarn window hits"
_FOUND = "array<struct<item_id:long,share:double,changed:boolean>>"


@lru_cache(maxsize=256)
def _one_item(item_id: int, text: str) -> Benchmark:
    return Benchmark([(item_id, text)])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, item, asked, text in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "asked", "text"))):
            out += [(row, *m) for m in _one_item(item, asked).matches(text)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, ["row", "item_id", "share", "changed"])


def _searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with _ROW and _HITS, in the shared folder; (row, item_id, share, changed) of the items found)."""
    asked = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = cut(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    windows = cut(items.select("item", "text").mapInArrow(_item_windows, "hash long, item long, width int"), "windows")
    n, widths = windows.count(), sorted(r[0] for r in windows.select("width").distinct().collect())
    bits = min(MOST_BITS, 1 << max(6, math.ceil(math.log2(max(1, n * BITS_PER_WINDOW)))))
    model = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))
    kind = StructType([*docs.schema.fields, StructField(_HITS, ArrayType(LongType()))])
    marked = docs.mapInArrow(_marked(model, bits, widths), kind)
    marked = cut(marked.withColumn(_ROW, F.monotonically_increasing_id()), "marked")
    some = marked.where(F.size(_HITS) > 0)
    pairs = some.select(F.col(_ROW).alias("row"), F.explode(_HITS).alias("hash")).join(windows, "hash").select("row", "item").distinct()
    pairs = pairs.join(items.select("item", "item_id", F.col("text").alias("asked")), "item")
    pairs = pairs.join(some.select(F.col(_ROW).alias("row"), "text"), "row").select("row", "item_id", "asked", "text")
    return marked, cut(pairs.mapInArrow(_verified, "row long, item_id long, share double, changed boolean"), "found")


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs and `items`: array<struct(item_id, share, changed)> of the benchmark items a text contains.

    `changed` marks items with other numbers, names or units than the benchmark's. A document's template windows pass a bitmap
    of the benchmark's window hashes, at most MOST_BITS however large the benchmark is; what passes, hardly more than the
    windows that the benchmark has, is hash-joined with the table of the benchmark's windows. The document and item of a hit are
    then compared word by word and slot by slot. Capitals don't matter: windows are looked up with and without names as
    placeholders. Windows with too few literals, such as formulas, are looked up as they stand; a run of LONG_RUN words in common
    is a hit whatever its share. Items shorter than a window must occur whole; items without words, and null or empty texts,
    match nothing. Repeated rows are each judged. A column `items` is replaced, other columns stay.
    """
    marked, found = _searched(docs.drop("items"), benchmark)
    items = F.array_sort(F.collect_list(F.struct("item_id", "share", "changed"))).cast(_FOUND)
    found = found.groupBy(F.col("row").alias(_ROW)).agg(items.alias("items"))
    none = marked.where(F.size(_HITS) == 0).withColumn("items", F.array().cast(_FOUND))
    some = marked.where(F.size(_HITS) > 0).join(found, _ROW, "left").withColumn("items", F.coalesce("items", F.array().cast(_FOUND)))
    return none.unionByName(some.select(*none.columns)).drop(_ROW, _HITS)


def keep_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, with docs' columns."""
    marked, found = _searched(docs, benchmark)
    some = marked.where(F.size(_HITS) > 0).join(found.select(F.col("row").alias(_ROW)), _ROW, "left_anti")
    return marked.where(F.size(_HITS) == 0).unionByName(some.select(*marked.columns)).select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.transform(F.array_sort(F.transform("items", lambda x: x["item_id"])), lambda i: i.cast("string")), ",")
    return found.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.exists("items", lambda x: x["changed"]).alias("reparameterised"),
    )
