"""Vectors: dot products as Columns, chunking and the hashed n-gram embedder as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.batches import pieces
from tarn.functions.text import words

CHUNK_BYTES = 1000


class Embedder(Protocol):
    """id and version tag every vector; embed() returns dim L2-normalised numbers, all zero for a text without words."""

    id: str
    version: int
    dim: int

    def embed(self, text: str) -> Sequence[float]: ...


def fnv1a(text: str, seed: int = 7) -> int:
    """64-bit FNV-1a whose start value is mixed with a seed."""
    h = 0xCBF29CE484222325 ^ seed
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class HashEmbedder:
    """Words (weight 1) and pairs of words in a row (weight 0.5), hashed to one of dim places with a hashed sign."""

    id, version = "hash-ngram", 1

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self._hash = lru_cache(1 << 16)(fnv1a)

    def __getstate__(self) -> dict:
        return {"dim": self.dim}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def embed(self, text: str) -> np.ndarray:
        found = [w.lower() for w in words(text)]
        grams = found + [f"{a} {b}" for a, b in zip(found, found[1:])]
        hashes = np.array([self._hash(g) for g in grams], dtype=np.uint64)
        sign = np.where(hashes >> np.uint64(63) == 0, 1.0, -1.0)
        weight = np.repeat([1.0, 0.5], [len(found), len(grams) - len(found)])
        out = np.bincount((hashes % np.uint64(self.dim)).astype(np.int64), sign * weight, self.dim) if len(grams) else np.zeros(self.dim)
        norm = np.sqrt((out * out).sum())
        return (out / norm if norm else out).astype(np.float32)


def dot(a: Column | str, b: Column | Sequence[float]) -> Column:
    """Dot product in double precision, left to right; null if either vector is."""
    a = F.col(a) if isinstance(a, str) else a
    b = b if isinstance(b, Column) else F.array(*[F.lit(float(x)) for x in b])
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def normalize(vec: Column | str) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: (x / norm).cast("float"))).otherwise(vec)


def chunk(text: str, target: int = CHUNK_BYTES) -> list[tuple[int, str]]:
    """(byte offset, text) of paragraphs packed until a chunk has target bytes; a blank rest is dropped."""
    raw, out, start, at = text.encode(), [], 0, 0
    while at < len(raw):
        gap = raw.find(b"\n\n", at)
        at = len(raw) if gap < 0 else gap + 2
        if at - start >= target:
            out.append((start, raw[start:at].decode()))
            start = at
    rest = raw[start:].decode()
    return out + [(start, rest)] if rest.strip() else out


def embed_chunks(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """docs (oid, text) -> chunks (oid, chunk_offset, embedder_id, embedder_version, vec). Chunks without words are left out.
    Vectors of a piece of a batch are held at a time."""
    name, version = embedder.id, embedder.version

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            oids, offsets, vecs = [], [], []
            for oid, text in zip(batch.column("oid").to_pylist(), batch.column("text").to_pylist()):
                for offset, part in chunk(text or ""):
                    vec = np.asarray(embedder.embed(part), np.float32)
                    if vec.any():
                        oids.append(oid)
                        offsets.append(offset)
                        vecs.append(vec)
            n = len(oids)
            cols = [pa.array(oids, pa.int64()), pa.array(offsets, pa.int32()), pa.array([name] * n, pa.string())]
            cols += [pa.array([version] * n, pa.int32()), pa.array(vecs, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["oid", "chunk_offset", "embedder_id", "embedder_version", "vec"])

    kind = "oid long, chunk_offset int, embedder_id string, embedder_version int, vec array<float>"
    return docs.select("oid", "text").mapInArrow(rows, kind)


def chunk_column(text: Column | str) -> Column:
    """array<struct(offset, text)> of chunk()."""

    @F.pandas_udf("array<struct<offset:int,text:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"offset": o, "text": p} for o, p in chunk(t or "")])

    return split(text)
