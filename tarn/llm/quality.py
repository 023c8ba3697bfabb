"""Quality classifier: sizes under two zstandard dictionaries, built from good and from bad text."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.labelled import Sample, fold, labelled_sample

#: The bound of the training sample: rows of each class, bytes of all of them.
PER_CLASS = 4000
MAX_BYTES = 48 << 20
BLOCK = 1024
#: Blocks that a dictionary is trained on, a seeded choice of all blocks of its half of a class's sample.
TRAINING_BLOCKS = 30_000
DICTIONARY_BYTES = 65536
LEVEL = 3
#: Bytes at which a text's difference counts half: short texts differ by chance.
HALF_BYTES = 256
THRESHOLD = 0.7
HELD_OUT = (4, 2)


@dataclass
class CompressionModel:
    """score = logistic(weights . (w * difference, w, 1)), w = bytes / (bytes + HALF_BYTES); difference: bytes that the bad
    dictionary needs beyond the good one, per byte of text. A text is compressed in blocks, all of them, so that long texts
    don't outgrow a dictionary. The empty text scores the share of class 1."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    prior: float

    def __post_init__(self) -> None:
        self._by = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by": None}

    def features(self, text: str) -> tuple[float, float, float]:
        if self._by is None:
            self._by = [_compressor(x) for x in (self.good, self.bad)] if self.good and self.bad else []
        raw = text.encode("utf-8", "surrogatepass")
        if not raw or not self._by:
            return 0.0, 0.0, 1.0
        good, bad = self._by
        gain = 0
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            gain += len(bad.compress(block)) - len(good.compress(block))
        w = len(raw) / (len(raw) + HALF_BYTES)
        return w * gain / len(raw), w, 1.0

    def score(self, text: str | None) -> float:
        if not text:
            return self.prior
        z = sum(a * b for a, b in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    found = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=found, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _dictionary(texts: list[str], seed: int) -> bytes:
    blocks = [raw[i : i + BLOCK] for t in texts if (raw := t.encode("utf-8", "surrogatepass")) for i in range(0, len(raw), BLOCK)]
    random.Random(seed).shuffle(blocks)
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks[:TRAINING_BLOCKS]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their text itself is the dictionary
        return b"".join(blocks)[:DICTIONARY_BYTES]


def fit(sample: Sample, seed: int = 42) -> CompressionModel:
    """Dictionaries from every other text of each class; the rest calibrates the difference, weighted to the classes'
    true shares. With one class only, or no text, all texts score the share of class 1 (0.5 without labels)."""
    total = sum(sample.totals)
    prior = (sample.totals[1] + 0.5) / (total + 1) if total else 0.5
    flat = CompressionModel(b"", b"", (0.0, 0.0, math.log(prior / (1 - prior))), prior)
    by_class = [[t for t, y in zip(sample.texts, sample.labels) if y == c and t] for c in (0, 1)]
    if min(map(len, by_class)) < 2:
        return flat
    bad, good = (_dictionary(texts[::2], seed) for texts in by_class)
    model = CompressionModel(good, bad, (0.0, 0.0, 0.0), prior)
    rest = [texts[1::2] for texts in by_class]
    x = np.array([model.features(t) for texts in rest for t in texts])
    y = np.array([c for c, texts in enumerate(rest) for _ in texts], dtype=float)
    w = np.array([sample.totals[c] / len(texts) for c, texts in enumerate(rest) for _ in texts])
    model.weights = _logistic(x, y, w / w.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design = x / scale
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (w * (p - y)) + 1e-3 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta / scale)


def quality_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score; one row per input row.

    Null text counts as empty. Whole texts are compressed whatever their length.
    Repeated rows score alike.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    modulus, out = HELD_OUT
    return fit(labelled_sample(docs, labels, "quality", fold(modulus) != out, PER_CLASS, MAX_BYTES))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' columns; each row is judged in place, none is moved."""
    model = train(docs, labels)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    modulus, out = HELD_OUT
    scores = quality_scores(docs, train(docs, labels))
    return scores.select(
        "doc_id", (fold(modulus) == out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
