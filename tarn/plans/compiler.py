"""From syntax trees to Columns, plan labels, and the side tables that text and vector predicates need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import basename, glob, query_tokens, symbol_terms, tokens
from tarn.plans.rql import And, Cmp, Expr, InRange, Not, Or, Semantic, Str, Text, Time

_NUMERIC = {"size": "size", "mtime": "mtime_ns"}
#: Leaves that need more than a catalog row.
Bind = Callable[[Expr], Column]


def _sure(column: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(column, F.lit(False))


def _number(value) -> float | None:
    """None for a string, which no number equals or is ordered with."""
    if isinstance(value, Str):
        return None
    return float(value.ns) if isinstance(value, Time) else value.value


def _compare(left: Column, op: str, right: float) -> Column:
    right = F.lit(right)
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _cmp(expr: Cmp, bind: Bind) -> Column:
    if expr.attr in _NUMERIC:
        number = _number(expr.value)
        if number is None:
            return F.lit(expr.op == "!=")
        return _sure(_compare(F.col(_NUMERIC[expr.attr]).cast("double"), expr.op, number))
    if not isinstance(expr.value, Str):
        return F.lit(False)
    if expr.attr in ("text", "symbols"):
        return bind(expr)
    column = basename("path") if expr.attr == "name" else F.coalesce("index_state", F.lit(""))
    hit = _sure(glob(column, expr.value.text, expr.value.ignore_case))
    return ~hit if expr.op == "!=" else hit


def _in_range(expr: InRange) -> Column:
    low, high = _number(expr.low), _number(expr.high)
    if expr.attr not in _NUMERIC or low is None or high is None:
        return F.lit(False)
    return _sure(F.col(_NUMERIC[expr.attr]).cast("double").between(low, high))


def compile_expr(expr: Expr, bind: Bind) -> Column:
    """A two-valued condition over catalog rows; cheap conditions stand before those that bind() makes."""
    if isinstance(expr, (And, Or)):
        parts = sorted(expr.parts, key=lambda p: bool(bound_leaves(p)))
        columns = [compile_expr(p, bind) for p in parts]
        out = columns[0]
        for column in columns[1:]:
            out = out & column if isinstance(expr, And) else out | column
        return out
    if isinstance(expr, Not):
        return ~compile_expr(expr.part, bind)
    if isinstance(expr, Cmp):
        return _cmp(expr, bind)
    if isinstance(expr, InRange):
        return _in_range(expr)
    return bind(expr)


def bound_leaves(expr: Expr) -> list[Expr]:
    """Text, symbol and semantic leaves, in order, each once."""
    if isinstance(expr, (And, Or)):
        return list(dict.fromkeys(leaf for p in expr.parts for leaf in bound_leaves(p)))
    if isinstance(expr, Not):
        return bound_leaves(expr.part)
    if isinstance(expr, (Text, Semantic)):
        return [expr]
    if isinstance(expr, Cmp) and expr.attr in ("text", "symbols") and isinstance(expr.value, Str):
        return [expr]
    return []


def has_semantic(expr: Expr) -> bool:
    return any(isinstance(leaf, Semantic) for leaf in bound_leaves(expr))


@dataclass(frozen=True)
class TermSet:
    """Terms that a document must all have; of its text, or of its symbol names. No terms: nothing matches."""

    terms: tuple[str, ...]
    symbols: bool = False


def term_set(leaf: Expr) -> TermSet:
    """The operator of a text or symbol comparison is ignored, so != selects like ==."""
    if isinstance(leaf, Text):
        return TermSet(tuple(query_tokens(leaf.terms)))
    if leaf.attr == "symbols":
        return TermSet(tuple(symbol_terms(leaf.value.text)), symbols=True)
    return TermSet(tuple(query_tokens(leaf.value.text)))


def row_bind(text: Column | str = "text", symbols: Column | str = "symbols") -> Bind:
    """Leaves over a row that carries its text and symbols, as standing queries see it: the index's analysis, except that a
    symbol query is one name, and semantic() never holds."""

    def bind(leaf: Expr) -> Column:
        if isinstance(leaf, Semantic):
            return F.lit(False)
        if isinstance(leaf, Cmp) and leaf.attr == "symbols":
            name = leaf.value.text.strip().strip("*").lower()
            rows = F.col(symbols) if isinstance(symbols, str) else symbols
            return _sure(F.exists(rows, lambda s: F.lower(s["name"]) == name)) if name else F.lit(False)
        terms = term_set(leaf).terms
        if not terms:
            return F.lit(False)
        return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(text))) == 0

    return bind


def plan_label(expr: Expr) -> str:
    """Which strategy a query runs by."""
    if isinstance(expr, Semantic):
        return "VectorDirect"
    if isinstance(expr, Text):
        return "LexicalDirect"
    return f"CatalogScan(text_sets={len(bound_leaves(expr))})"
