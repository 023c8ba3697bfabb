"""Path scopes: whose files a query may see. Applied to candidates before anything is ranked or counted."""

from __future__ import annotations

import hmac
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _norm(prefix: str) -> str:
    return "/" + "/".join(p for p in prefix.split("/") if p)


def under(path: Column, prefix: str) -> Column:
    """prefix itself and everything below it, as one range: '0' is the byte after '/', so siblings whose names start alike
    stay out and Parquet prunes by it."""
    prefix = _norm(prefix)
    if prefix == "/":
        return F.startswith(path, F.lit("/"))
    return (path == prefix) | ((path >= prefix + "/") & (path < prefix + "0"))


@dataclass(frozen=True)
class Scope:
    """None allows every path; a tuple of prefixes allows what is under one of them; the empty tuple denies all."""

    prefixes: tuple[str, ...] | None = None

    @classmethod
    def of(cls, *prefixes: str) -> Scope:
        return cls(tuple(map(_norm, prefixes)))

    def allows(self, path: str) -> bool:
        if self.prefixes is None:
            return True
        path = _norm(path)
        return any(p == "/" or path == p or path.startswith(p + "/") for p in self.prefixes)

    def intersect(self, other: Scope) -> Scope:
        """The prefixes of either side that the other side allows, without those inside another."""
        if self.prefixes is None:
            return other
        if other.prefixes is None:
            return self
        both = [p for p in self.prefixes if other.allows(p)] + [p for p in other.prefixes if self.allows(p)]
        both = list(dict.fromkeys(both))
        return Scope(tuple(p for p in both if not any(q != p and Scope((q,)).allows(p) for q in both)))

    @property
    def denies_all(self) -> bool:
        return self.prefixes == ()

    def column(self, path: Column | str = "path") -> Column:
        path = F.col(path) if isinstance(path, str) else path
        if self.prefixes is None:
            return F.lit(True)
        out = F.lit(False)
        for p in self.prefixes:
            out = out | under(path, p)
        return out


UNRESTRICTED = Scope()
DENY = Scope(())


def effective(onlyin: str | Sequence[str] | None, grants: Scope) -> Scope:
    """A request narrows what is granted and never widens it."""
    if onlyin is None:
        return grants
    asked = Scope.of(onlyin) if isinstance(onlyin, str) else Scope.of(*onlyin)
    return grants.intersect(asked)


@dataclass(frozen=True)
class Authority:
    """Named grants and one token that lifts all restrictions."""

    token: str
    grants: Mapping[str, Scope]

    def resolve(self, principal: str | None = None, token: str | None = None, restrict_to: Sequence[str] | None = None) -> Scope:
        """The token allows everything, a known principal its grant, anyone else nothing; restrict_to narrows that."""
        if token is not None and hmac.compare_digest(token.encode(), self.token.encode()):
            scope = UNRESTRICTED
        else:
            scope = self.grants.get(principal or "", DENY)
        return scope if restrict_to is None else scope.intersect(Scope.of(*restrict_to))
