"""The query surface: predicate queries, counts, ranked search, snippets, status and subscriptions, under path scopes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import schema
from tarn.functions.snippets import snippet
from tarn.functions.text import query_tokens
from tarn.operators import catalog, vector
from tarn.operators.lexical import LexicalPlane, phrase
from tarn.operators.vector import VectorPlane
from tarn.plans.compiler import And, TermSet, bound_leaves, compile_expr, has_semantic, plan_label, term_set
from tarn.plans.rql import Expr, NoLexicalPlane, NoVectorPlane, Semantic, Text, UnsupportedPredicate, parse
from tarn.plans.scope import UNRESTRICTED, Authority, Scope, effective
from tarn.streaming.live import View


@dataclass
class Engine:
    """Tables and planes, and the queries over them; every method returns a lazy DataFrame.

    entries (path, oid, attach_lsn) and objects are the catalog; content (oid, text, symbols) is needed for snippets and
    phrases. limit=None asks for all rows.
    """

    entries: DataFrame
    objects: DataFrame
    content: DataFrame | None = None
    lexical: LexicalPlane | None = None
    vectors: VectorPlane | None = None
    authority: Authority = field(default_factory=lambda: Authority("", {}))

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    # ------------------------------------------------------------ predicates

    def parse(self, query: str | Expr, now_ns: int | None = None) -> Expr:
        return parse(query, now_ns) if isinstance(query, str) else query

    def explain(self, query: str | Expr) -> str:
        return plan_label(self.parse(query))

    def _allowed(self, scope: Scope) -> DataFrame | None:
        """oid of what a scope shows; None if that is everything."""
        return None if scope.prefixes is None else self.entries.where(scope.column()).select("oid").distinct()

    def _matching(self, terms: TermSet) -> DataFrame:
        if self.lexical is None or terms.symbols and self.lexical.symbols is None:
            raise NoLexicalPlane("text predicates need the lexical plane")
        return self.lexical.matching(terms.terms, terms.symbols)

    def _semantic_set(self, query: str, limit: int, scope: Scope) -> DataFrame:
        if self.vectors is None:
            raise NoVectorPlane("semantic() needs the vector plane")
        return self.vectors.top(query, max(limit, schema.NESTED_SEMANTIC), self._allowed(scope)).select("oid")

    def _rows(self, expr: Expr, scope: Scope, limit: int | None) -> DataFrame:
        """Catalog rows that satisfy expr, folders left out. Required text terms are one semi-join for all of them; other
        text, symbol and semantic leaves are flags that are joined by oid."""
        rows = self.entries.where(scope.column()).join(self.objects.drop("entry_paths"), "oid").where("kind <> 'dir'")
        parts = expr.parts if isinstance(expr, And) else (expr,)
        needed = [p for p in parts if isinstance(p, Text)]
        rest = [p for p in parts if not isinstance(p, Text)]
        if needed:
            sets = [term_set(p).terms for p in needed]
            every = tuple(dict.fromkeys(t for s in sets for t in s)) if all(sets) else ()
            rows = rows.join(self._matching(TermSet(every)), "oid", "left_semi")
        if not rest:
            return rows
        expr = rest[0] if len(rest) == 1 else And(tuple(rest))
        flags: dict[Expr, Column] = {}
        for i, leaf in enumerate(bound_leaves(expr)):
            found = self._semantic_set(leaf.query, limit or 0, scope) if isinstance(leaf, Semantic) else self._matching(term_set(leaf))
            rows = rows.join(found.withColumn(f"_f{i}", F.lit(True)), "oid", "left")
            flags[leaf] = F.coalesce(F.col(f"_f{i}"), F.lit(False))
        return rows.where(compile_expr(expr, flags.__getitem__))

    def query(
        self, query: str | Expr, onlyin: str | Sequence[str] | None = None, scope: Scope = UNRESTRICTED,
        limit: int | None = schema.QUERY_CAP, now_ns: int | None = None,
    ) -> DataFrame:
        """oid, path of the hits: best first for a lone text or semantic query, else in byte order of the path."""
        expr, scope = self.parse(query, now_ns), effective(onlyin, scope)
        if isinstance(expr, Semantic):
            return self.semantic(expr.query, limit or schema.QUERY_CAP, scope).select("oid", "path")
        if isinstance(expr, Text) and limit is not None:
            return self.search_text(expr.terms, limit, scope).select("oid", "path")
        hits = self._rows(expr, scope, limit).select("oid", "path").orderBy("path")
        return hits if limit is None else hits.limit(limit)

    def count(self, query: str | Expr, onlyin: str | Sequence[str] | None = None, scope: Scope = UNRESTRICTED, now_ns: int | None = None) -> DataFrame:
        """n, never capped: documents for a lone text query, else entry paths. Queries with semantic() have no count."""
        expr, scope = self.parse(query, now_ns), effective(onlyin, scope)
        if has_semantic(expr):
            raise UnsupportedPredicate("count of a semantic query")
        if isinstance(expr, Text):
            return self._live(self._matching(term_set(expr)), scope).agg(F.count("*").alias("n"))
        return self._rows(expr, scope, None).agg(F.count("*").alias("n"))

    # ------------------------------------------------------------ ranked

    def _live(self, oids: DataFrame, scope: Scope) -> DataFrame:
        return oids.join(self.entries.where(scope.column()).select("oid"), "oid", "left_semi")

    def _paths(self, top: DataFrame, scope: Scope) -> DataFrame:
        """A ranked list with the first path, in the order of attachment, that the scope shows."""
        shown = self.entries.where(scope.column()).join(top.select("oid"), "oid", "left_semi")
        first = shown.groupBy("oid").agg(F.min_by("path", F.struct("attach_lsn", "path")).alias("path"))
        return top.join(first, "oid").orderBy(F.desc("score"), "oid")

    def search_text(self, text: str, limit: int, scope: Scope = UNRESTRICTED, tf_mode: str = "binary", as_phrase: bool = False) -> DataFrame:
        """oid, score, path by BM25 among documents with all terms; as_phrase: in a row."""
        if self.lexical is None:
            raise NoLexicalPlane("text search needs the lexical plane")
        allowed = self._allowed(scope)
        if as_phrase:
            found = phrase(self.content.join(self.lexical.matching(query_tokens(text)), "oid", "left_semi"), text)
            allowed = found if allowed is None else allowed.join(found, "oid", "left_semi")
        return self._paths(self.lexical.top(text, limit, tf_mode, allowed), scope)

    def semantic(self, query: str | Sequence[float], limit: int, scope: Scope = UNRESTRICTED) -> DataFrame:
        """oid, score, chunk_offset, path by the best chunk's cosine."""
        if self.vectors is None:
            raise NoVectorPlane("semantic search needs the vector plane")
        return self._paths(self.vectors.top(query, limit, self._allowed(scope)), scope)

    def hybrid(self, query: str, limit: int = schema.TOOL_DEFAULT, onlyin: str | Sequence[str] | None = None, scope: Scope = UNRESTRICTED, vector_query: Sequence[float] | None = None) -> DataFrame:
        """oid, score, provenance, path: reciprocal rank fusion of the best of both planes."""
        if self.lexical is None:
            raise NoLexicalPlane("hybrid search needs the lexical plane")
        if self.vectors is None:
            raise NoVectorPlane("hybrid search needs the vector plane")
        scope, limit = effective(onlyin, scope), schema.clamp(limit)
        depth, allowed = max(limit, schema.HYBRID_DEPTH), self._allowed(scope)
        lexical = self.lexical.top(query, depth, allowed=allowed)
        semantic = self.vectors.top(query if vector_query is None else vector_query, depth, allowed)
        return self._paths(vector.fuse(lexical, semantic, limit), scope)

    def snippets(self, query: str, limit: int = schema.TOOL_DEFAULT, onlyin: str | Sequence[str] | None = None, scope: Scope = UNRESTRICTED) -> DataFrame:
        """path, start, end, text of the best hits: fused if there are vectors, else lexical."""
        scope, limit = effective(onlyin, scope), schema.clamp(limit)
        top = self.hybrid(query, limit, scope=scope) if self.vectors is not None else self.search_text(query, limit, scope)
        rows = self.content.join(F.broadcast(top), "oid")  # at most 1000 rows
        rows = rows.withColumn("s", snippet("text", query)).orderBy(F.desc("score"), "oid")
        return rows.select("path", "s.start", "s.end", F.col("s.text").alias("text"))

    def search(self, query: str, mode: str = "lexical", limit: int = schema.HTTP_DEFAULT, scope: Scope = UNRESTRICTED) -> DataFrame:
        """oid, path by mode: hybrid, semantic, rql, or text for any other; an empty query finds nothing."""
        text, limit = query.strip(), schema.clamp(limit)
        plain = text.replace('"', "")
        depth = max(limit, schema.HTTP_DEPTH)
        if not text:
            return self.entries.select("oid", "path").limit(0)
        if mode == "hybrid" and self.vectors is not None:
            return self.hybrid(plain, depth, scope=scope).select("oid", "path").limit(limit)
        if mode == "semantic":
            return self.semantic(plain, depth, scope).select("oid", "path").limit(limit)
        if mode == "rql":
            return self.query(text, scope=scope, limit=depth).limit(limit)
        return self.search_text(plain, depth, scope).select("oid", "path").limit(limit)

    # ------------------------------------------------------------ surfaces

    def status(self, scope: Scope = UNRESTRICTED) -> DataFrame:
        return catalog.scoped_counts(self.entries, scope.column())

    def connect(self, principal: str | None = None, token: str | None = None, restrict_to: Sequence[str] | None = None) -> Session:
        return Session(self, self.authority.resolve(principal, token, restrict_to))

    def view(self, id: str, query: str, scope: Scope = UNRESTRICTED) -> View:
        return View.of(id, query, scope)

    def alert(self, id: str, query: str, threshold: float = schema.ALERT_THRESHOLD, scope: Scope = UNRESTRICTED) -> View:
        if self.vectors is None or self.vectors.embedder is None:
            raise NoVectorPlane("alerts need an embedder")
        return View.alert(id, query, self.vectors.embedder, threshold, scope)


@dataclass(frozen=True)
class Session:
    """An engine as one principal sees it: requests narrow the granted scope and never widen it."""

    engine: Engine
    scope: Scope

    def query(self, query: str, onlyin=None, limit: int | None = schema.QUERY_CAP) -> DataFrame:
        return self.engine.query(query, onlyin, self.scope, limit)

    def count(self, query: str, onlyin=None) -> DataFrame:
        return self.engine.count(query, onlyin, self.scope)

    def hybrid(self, query: str, limit: int = schema.TOOL_DEFAULT, onlyin=None) -> DataFrame:
        return self.engine.hybrid(query, limit, onlyin, self.scope)

    def snippets(self, query: str, limit: int = schema.TOOL_DEFAULT, onlyin=None) -> DataFrame:
        return self.engine.snippets(query, limit, onlyin, self.scope)

    def search(self, query: str, mode: str = "lexical", limit: int = schema.HTTP_DEFAULT) -> DataFrame:
        return self.engine.search(query, mode, limit, self.scope)

    def status(self) -> DataFrame:
        return self.engine.status(self.scope)

    def view(self, id: str, query: str) -> View:
        return self.engine.view(id, query, self.scope)
