"""The vector plane and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import Embedder, dot, embed_chunks

#: Of reciprocal ranks, counted from 0.
RRF_OFFSET = 60


@dataclass
class VectorPlane:
    """chunks (oid, chunk_offset, embedder_id, embedder_version, vec) and the embedder that queries are coded by."""

    chunks: DataFrame
    embedder: Embedder | None = None

    def refreshed(self, plan: DataFrame, docs: DataFrame) -> VectorPlane:
        """The plane after a batch, as the lexical plane's: only documents to refresh are embedded."""
        new = embed_chunks(docs.join(plan.where("action = 'refresh'").select("oid"), "oid", "left_semi"), self.embedder)
        return VectorPlane(self.chunks.join(plan.select("oid"), "oid", "left_anti").unionByName(new), self.embedder)

    def _known(self) -> DataFrame:
        if self.embedder is None:
            return self.chunks
        same = (F.col("embedder_id") == self.embedder.id) & (F.col("embedder_version") == self.embedder.version)
        return self.chunks.where(same)

    def encode(self, query: str | Sequence[float]) -> Sequence[float]:
        return self.embedder.embed(query) if isinstance(query, str) else query

    def scores(self, query: str | Sequence[float], allowed: DataFrame | None = None) -> DataFrame:
        """oid, score, chunk_offset of each document's best chunk, the first of equals. Vectors of another embedder or
        version are skipped; the scope is applied before anything is compared."""
        rows = self._known()
        if allowed is not None:
            rows = rows.join(allowed.select("oid"), "oid", "left_semi")
        rows = rows.select("oid", "chunk_offset", F.round(dot("vec", self.encode(query)), 6).alias("score"))
        best = rows.groupBy("oid").agg(F.max(F.struct("score", (-F.col("chunk_offset")).alias("o"))).alias("b"))
        return best.select("oid", "b.score", (-F.col("b.o")).alias("chunk_offset"))

    def top(self, query: str | Sequence[float], limit: int, allowed: DataFrame | None = None) -> DataFrame:
        return self.scores(query, allowed).orderBy(F.desc("score"), "oid").limit(limit)

    def alike(self, query: str | Sequence[float], threshold: float) -> DataFrame:
        """oid, score of documents whose best chunk, or 0 if that is more, reaches the threshold."""
        best = self.scores(query).select("oid", F.greatest(F.lit(0.0), F.col("score")).alias("score"))
        return best.where(F.col("score") >= threshold)


def ranked(top: DataFrame) -> DataFrame:
    """oid, rank from 0, of a list that a limit has bounded."""
    return top.select("oid", (F.row_number().over(Window.orderBy(F.desc("score"), "oid")) - 1).alias("rank"))


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two bounded ranked lists: oid, score, provenance (exact, meaning or both); ties by oid."""
    both = ranked(lexical).withColumnRenamed("rank", "lex").join(ranked(semantic).withColumnRenamed("rank", "sem"), "oid", "full_outer")
    part = lambda c: F.coalesce(1 / (RRF_OFFSET + F.col(c)), F.lit(0.0))
    tag = F.when(F.col("lex").isNotNull() & F.col("sem").isNotNull(), "both").when(F.col("lex").isNotNull(), "exact").otherwise("meaning")
    rows = both.select("oid", F.round(part("lex") + part("sem"), 9).alias("score"), tag.alias("provenance"))
    return rows.orderBy(F.desc("score"), "oid").limit(limit)
