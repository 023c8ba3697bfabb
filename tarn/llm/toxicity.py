"""Toxicity by multiple-instance learning: sentences score, documents combine them by noisy-or."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.labelled import Sample, fold, labelled_sample

#: The bound of the training sample: rows of each class, bytes of all of them.
PER_CLASS = 3000
MAX_BYTES = 48 << 20
#: Features that the model may use, those that set the classes apart best.
FEATURES = 2000
LEAST_DOCS = 3
ROUNDS = 600
THRESHOLD = 0.5
HELD_OUT = (5, 0)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(sentence: str) -> set[str]:
    """A lower-cased sentence's words, and their first four and five letters (marked *), which stand for inflected forms."""
    out = set()
    for word in set(_WORD.findall(sentence)):
        out |= {word, word[:4] + "*", word[:5] + "*"}
    return out


@dataclass
class SentenceModel:
    """p(sentence) = logistic(bias + sum of its features' weights); p(document) = 1 - product of 1 - p(sentence)."""

    weights: dict[str, float]
    bias: float
    heads: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.heads = {f.rstrip("*")[:4] for f in self.weights}
        self.plain = float(np.logaddexp(0.0, self.bias))

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, -log(1 - p)) of every sentence, in code points of text."""
        lower, heads, weights = text.lower(), self.heads, self.weights
        if len(lower) != len(text):  # a letter whose lower case is longer would shift what follows
            lower = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        for m in _SENTENCE.finditer(lower):
            words = [w for w in _WORD.findall(m[0]) if w[:4] in heads]
            if words:
                z = self.bias + sum(weights.get(f, 0.0) for f in features(" ".join(words)))
                yield m.start(), m.end(), float(np.logaddexp(0.0, z))
            else:
                yield m.start(), m.end(), self.plain

    def score(self, text: str | None) -> float:
        return -math.expm1(-math.fsum(cost for _, _, cost in self.sentences(text or "")))

    def offending(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(start, end, p) of the sentences whose own probability is at least threshold."""
        least = -math.log1p(-threshold)
        return [(s, e, -math.expm1(-cost)) for s, e, cost in self.sentences(text or "") if cost >= least]


def fit(sample: Sample) -> SentenceModel:
    """Maximum likelihood of the document labels under noisy-or, by Adam from zero weights; classes weigh their true
    shares. With one class only, or no text, no sentence has weight and all texts score the same, next to 0."""
    y = np.array(sample.labels, dtype=float)
    if not 0 < y.sum() < len(y):
        return SentenceModel({}, -20.0)
    seen = [Counter(), Counter()]
    for text, label in zip(sample.texts, sample.labels):
        seen[label].update(features(text.lower()))
    share = y.mean()
    apart = {}
    for f in seen[0].keys() | seen[1].keys():
        n0, n1 = seen[0][f], seen[1][f]
        if n0 + n1 >= LEAST_DOCS:
            apart[f] = (n1 - (n0 + n1) * share) ** 2 / ((n0 + n1) * share * (1 - share))
    place = {f: i for i, f in enumerate(sorted(apart, key=lambda f: (-apart[f], f))[:FEATURES])}
    if not place:
        return SentenceModel({}, math.log(share / (1 - share)))
    del seen, apart
    sentence, feature, document = array("q"), array("q"), array("q")
    for d, text in enumerate(sample.texts):
        for s in _SENTENCE.findall(text.lower()):
            known = sorted(place[f] for f in features(s) if f in place)
            sentence.extend([len(document)] * len(known))
            feature.extend(known)
            document.append(d)
    sentence, feature, document = (np.array(x, dtype=np.int64) for x in (sentence, feature, document))
    weight = np.where(y == 1, sample.totals[1] / y.sum(), sample.totals[0] / (len(y) - y.sum()))
    weight /= weight.mean()
    beta = np.zeros(len(place) + 1)
    beta[-1] = -6.0
    mean, var = np.zeros_like(beta), np.zeros_like(beta)
    n, m = len(y), len(document)
    for step in range(1, ROUNDS + 1):
        z = beta[-1] + np.bincount(sentence, beta[feature], m)
        stay = np.exp(-np.bincount(document, np.logaddexp(0, z), n))
        slope = weight * np.where(y == 1, stay / np.maximum(1 - stay, 1e-9), -1.0)
        pull = slope[document] * -(1 / (1 + np.exp(-z)))
        grad = np.append(np.bincount(feature, pull[sentence], len(place)) / n + 1e-5 * beta[:-1], pull.sum() / n)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        beta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(beta[i]) for f, i in place.items() if abs(beta[i]) > 0.02}
    return SentenceModel(weights, float(beta[-1]))


def toxicity_scores(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, offending: array<struct(start, end, p)>; one row per input row.

    Null text counts as empty; a text without sentences scores 0. Whole texts are read, sentence by sentence. Repeated rows
    score alike.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = -math.log1p(-threshold)
        for batch in batches:
            scores, found = [], []
            for t in batch.column("text"):
                parts = list(model.sentences(t.as_py() or ""))
                scores.append(-math.expm1(-math.fsum(cost for _, _, cost in parts)))
                found.append([{"start": s, "end": e, "p": -math.expm1(-cost)} for s, e, cost in parts if cost >= least])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, spans)], ["doc_id", "score", "offending"]
            )

    kind = "doc_id long, score double, offending array<struct<start:long,end:long,p:double>>"
    return docs.select("doc_id", "text").mapInArrow(scored, kind)


def train(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    modulus, out = HELD_OUT
    return fit(labelled_sample(docs, labels, "toxic", fold(modulus) != out, PER_CLASS, MAX_BYTES))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    modulus, out = HELD_OUT
    scores = toxicity_scores(docs, train(docs, labels))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scores.select(
        "doc_id",
        (fold(modulus) == out).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        spans.alias("offending"),
    )
