"""The lexical plane: postings, boolean matching, BM25, phrases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import n_tokens, ordered_tokens, query_tokens, tokens

K1, B = 1.2, 0.75
TERM_BUCKETS = 256


def build_postings(docs: DataFrame, terms: Sequence[str] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """docs (oid, text) -> term, oid, tf, doc_len, term_bucket; tf is summed before the shuffle. With terms, only theirs: other
    tokens are dropped inside the row, before they would become rows. With asked (term), which goes to every task, only
    theirs: other tokens are dropped before the shuffle."""
    rows = docs.select("oid", tokens("text").alias("t"))
    kept = F.col("t") if terms is None else F.filter("t", lambda t: t.isin(list(terms)))
    rows = rows.select("oid", F.size("t").alias("doc_len"), F.explode(kept).alias("term"))
    rows = rows if asked is None else rows.join(F.broadcast(asked), "term", "left_semi")
    rows = rows.groupBy("oid", "doc_len", "term").agg(F.count("*").cast("int").alias("tf"))
    return rows.select("term", "oid", "tf", "doc_len", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).alias("term_bucket"))


def build_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("oid", n_tokens("text").alias("doc_len"))


def build_symbols(docs: DataFrame) -> DataFrame:
    """docs (oid, symbols) -> oid, symbol: distinct lower-cased names."""
    names = F.array_distinct(F.transform("symbols", lambda s: F.lower(s["name"])))
    return docs.select("oid", F.explode(names).alias("symbol"))


@dataclass
class LexicalPlane:
    """Tables of the plane. Terms are looked up by bucket, so a table written by partition reads only theirs.

    A plane that is built but not written keeps its documents (`docs`) and analyses them for a query's terms alone."""

    postings: DataFrame
    lengths: DataFrame
    symbols: DataFrame | None = None
    docs: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame) -> LexicalPlane:
        symbols = build_symbols(docs) if "symbols" in docs.columns else None
        return cls(build_postings(docs), build_lengths(docs), symbols, docs.select("oid", "text"))

    def refreshed(self, plan: DataFrame, docs: DataFrame) -> LexicalPlane:
        """The plane after a batch: oids of plan (oid, action) lose their rows, and those with action refresh get them anew
        from docs. Rows of other documents stay as they are."""
        stay = lambda df: df.join(plan.select("oid"), "oid", "left_anti")
        new = LexicalPlane.build(docs.join(plan.where("action = 'refresh'").select("oid"), "oid", "left_semi"))
        symbols = None if self.symbols is None else stay(self.symbols).unionByName(new.symbols)
        return LexicalPlane(stay(self.postings).unionByName(new.postings), stay(self.lengths).unionByName(new.lengths), symbols)

    def write(self, path: str) -> None:
        """Postings by term bucket, sorted by term within; the other tables beside them."""
        by_bucket = self.postings.repartition("term_bucket").sortWithinPartitions("term_bucket", "term", "oid")
        by_bucket.write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        if self.symbols is not None:
            self.symbols.write.mode("overwrite").parquet(f"{path}/symbols")

    @classmethod
    def read(cls, spark, path: str, symbols: bool = False) -> LexicalPlane:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths")]
        return cls(*tables, spark.read.parquet(f"{path}/symbols") if symbols else None)

    def of_terms(self, terms: Sequence[str]) -> DataFrame:
        if self.docs is not None:
            return build_postings(self.docs, terms)
        column = self.postings["term"]
        if "term_bucket" in self.postings.columns:
            spark = self.postings.sparkSession
            one = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_BUCKETS)).alias(f"b{i}") for i, t in enumerate(terms)])
            wanted = sorted(set(one.first())) if terms else []
            return self.postings.where(F.col("term_bucket").isin(wanted) & column.isin(list(terms)))
        return self.postings.where(column.isin(list(terms)))

    def matching(self, terms: Sequence[str], symbols: bool = False) -> DataFrame:
        """oid of documents with all terms; none for no terms."""
        terms = list(dict.fromkeys(terms))
        if symbols:
            rows = self.symbols.where(F.col("symbol").isin(terms)).groupBy("oid").agg(F.countDistinct("symbol").alias("n"))
        else:
            rows = self.of_terms(terms).groupBy("oid").agg(F.count("term").alias("n"))
        return rows.where(F.col("n") == len(terms)).where(F.lit(bool(terms))).select("oid")

    def count(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        found = self.matching(query_tokens(query))
        found = found.join(allowed, "oid", "left_semi") if allowed is not None else found
        return found.agg(F.count("*").alias("n"))

    def scores(self, terms: Sequence[str], tf_mode: str = "binary", allowed: DataFrame | None = None) -> DataFrame:
        """oid, score of documents with all terms: BM25 over the whole plane's statistics, shown rounded to six places."""
        terms = list(dict.fromkeys(terms))
        rows = self.of_terms(terms)
        every = self.lengths.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        rows = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(every))  # as many rows as terms; one row
        if allowed is not None:
            rows = rows.join(allowed.select("oid").distinct(), "oid", "left_semi")
        found = rows.groupBy("oid").agg(F.count("*").alias("n"), F.sum(bm25(tf_mode)).alias("score"))
        return found.where(F.col("n") == len(terms)).select("oid", F.round("score", 6).alias("score"))

    def top(self, query: str, limit: int, tf_mode: str = "binary", allowed: DataFrame | None = None) -> DataFrame:
        """The best documents, ties by oid; the scope is applied before the limit."""
        return self.scores(query_tokens(query), tf_mode, allowed).orderBy(F.desc("score"), "oid").limit(max(limit, 1))

    def top_each(self, queries: DataFrame, limit: int, tf_mode: str = "binary") -> DataFrame:
        """query, oid, score: the best documents of each of many queries in one job, as top() ranks them.

        queries (query, term) has a row for each term of a query, and is sent to every task, as are the counts of its terms: tokens
        that no query asks for don't leave their task, and a term that most documents have doesn't gather in one. Ranks are
        cut to the limit on the map side first, so a query that most documents match sends no more than that many rows from a task."""
        asked = queries.select("query", "term").distinct()
        need = asked.groupBy("query").agg(F.count("*").alias("terms"))
        terms = asked.select("term").distinct()
        rows = self.postings.join(F.broadcast(terms), "term", "left_semi") if self.docs is None else build_postings(self.docs, asked=terms)
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        every = self.lengths.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        rows = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(every))  # as many rows as terms; one row
        rows = rows.select("term", "oid", bm25(tf_mode).alias("part")).join(F.broadcast(asked), "term")
        found = rows.groupBy("query", "oid").agg(F.count("*").alias("n"), F.round(F.sum("part"), 6).alias("score"))
        found = found.join(F.broadcast(need), "query").where(F.col("n") == F.col("terms"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "oid"))
        return found.withColumn("rank", rank).where(F.col("rank") <= max(limit, 1)).select("query", "oid", "score")


def bm25(tf_mode: str = "binary") -> Column:
    tf = F.lit(1.0) if tf_mode == "binary" else F.col("tf").cast("double")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))


def phrase(docs: DataFrame, query: str) -> DataFrame:
    """docs (oid, text) -> oid of texts in which the query's tokens stand in a row, repeats included."""
    words = ordered_tokens(query)
    padded = F.concat(F.lit(" "), F.array_join(tokens("text"), " "), F.lit(" "))
    return docs.where(F.contains(padded, F.lit(" " + " ".join(words) + " ")) if words else F.lit(False)).select("oid")
