"""Secret scans: patterns, and sliding-window entropy over candidate strings. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of fewer characters fails and is dropped; as a run is matched whole, asking for the length finds the same runs.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character of the best window from which a candidate of a class is a secret.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
#: Candidates that hold one of these (in any case) are placeholders, not secrets.
ALLOWED = ("example", "abcdefghij", "0123456789", "xxxxxxxx", "placeholder")
KINDS = ("assign", "access", "hex", "entropy")


#: Matches whose lengths are summed one after the other; the sums of blocks of so many are summed first.
BLOCK = 256


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct(at, len, body)> of all matches in code points; the text between them gives where they start.

    A match starts after all gaps up to it and all matches before it. These lengths are summed in blocks: a match adds those
    of the blocks before its own, which are summed once, and of its own block's, so the work for n matches is n * BLOCK and
    (n / BLOCK)^2 additions, not n^2 copies.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wants = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = "array<struct<gap:int,len:int,body:string>>"
    rows = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len")))
    rows = F.zip_with(rows, wants, lambda r, w: F.struct(r["gap"].alias("gap"), r["len"].alias("len"), w.alias("body"))).cast(kind)
    return _bound(rows, _placed)


def _placed(rows: Column) -> Column:
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, r: n + r["gap"] + r["len"])
    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.slice(rows, s, F.lit(BLOCK)))

    def within(blocks, sums):
        def one(block, k):
            before = F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda n, x: n + x)
            return _bound(before, lambda b: F.transform(block, lambda r, i: place(block, b, r, i)))

        def place(block, before, r, i):
            at = before + total(F.slice(block, 1, i)) + r["gap"]
            return F.struct(at.alias("at"), r["len"].alias("len"), r["body"].alias("body"))

        return F.flatten(F.transform(blocks, one))

    return _bound(blocks, lambda blocks: _bound(F.transform(blocks, total), lambda sums: within(blocks, sums)))


def _log_term(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: a column that is named in a lambda would be computed at each step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hot_windows(body: Column, least: Column, window: int = WINDOW) -> Column:
    """struct(first, last): starts of the first and last window of `window` characters whose entropy is >= least, or nulls.

    The sum of c log2 c over the window's character counts is carried along: each step takes one character out and one in,
    so only those two counts change.
    """
    return _bound(F.transform(F.split(body, ""), lambda c: F.ascii(c)), lambda codes: _hot_windows(codes, least, window))


def _hot_windows(codes: Column, least: Column, window: int) -> Column:
    def entropy(total):
        return F.round(F.lit(math.log2(window)) - total / window, 9)

    def step(acc, i):
        gone, new = F.element_at(codes, i), F.element_at(codes, i + window)
        n_gone, n_new = F.element_at(acc["counts"], gone + 1), F.element_at(acc["counts"], new + 1)
        moved = acc["total"] - _log_term(n_gone) + _log_term(n_gone - 1) - _log_term(n_new) + _log_term(n_new + 1)
        total = F.when(gone == new, acc["total"]).otherwise(moved)
        counts = F.transform(acc["counts"], lambda n, k: n - (k == gone).cast("int") + (k == new).cast("int"))
        hot = entropy(total) >= least
        return F.struct(
            F.when(gone == new, acc["counts"]).otherwise(counts).alias("counts"),
            total.alias("total"),
            F.when(hot & acc["first"].isNull(), i).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
        )

    def from_counts(counts):
        total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + _log_term(n))
        return _bound(total, lambda t: from_total(counts, t))

    def from_total(counts, total):
        at0 = F.when(entropy(total) >= least, F.lit(0))
        start = F.struct(counts.alias("counts"), total.alias("total"), at0.alias("first"), at0.alias("last"))
        return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    steps = F.when(F.size(codes) > window, F.sequence(F.lit(1), F.size(codes) - window)).otherwise(F.array().cast("array<int>"))
    first = F.aggregate(
        F.slice(codes, 1, window),
        F.array_repeat(F.lit(0), 128),
        lambda counts, code: F.transform(counts, lambda n, i: n + (i == code).cast("int")),
    )
    return _bound(first, from_counts)


def _class(body: Column) -> Column:
    """Character class of a candidate: hex, alnum or base64; null for bare words and bare numbers, which are never secrets."""
    return (
        F.when(~body.rlike("[0-9]") | ~body.rlike("[A-Za-z]"), F.lit(None))
        .when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(body.rlike("^[A-Za-z0-9]+$"), F.lit("alnum"))
        .otherwise(F.lit("base64"))
    )


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["at"].alias("at"), F.lit(kind).alias("kind"), (m["at"] + m["len"]).alias("end"))
    )


def _entropy_spans(text: Column, thresholds: dict[str, float], allowed: Sequence[str], window: int) -> Column:
    least = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])

    def judged(m):
        kind = _class(m["body"])
        clean = F.lit(True)
        for word in allowed:
            clean = clean & ~F.contains(F.lower(m["body"]), F.lit(word))
        hot = F.when(kind.isNotNull() & clean, hot_windows(m["body"], F.element_at(least, kind), window))
        span = lambda h: F.struct((m["at"] + h["first"]).alias("at"), F.lit(3).alias("kind"), (m["at"] + h["last"] + window).alias("end"))
        return _bound(hot, span)

    return F.filter(F.transform(_located(text, CANDIDATE), judged), lambda s: s["at"].isNotNull())


def find_secrets(
    docs: DataFrame,
    thresholds: dict[str, float] | None = None,
    allowed: Sequence[str] = ALLOWED,
    window: int = WINDOW,
) -> DataFrame:
    """All columns of docs and `secrets`: array<struct(at, kind, end)> by start, then kind; end exclusive, code points.

    kind 0 assign, 1 access, 2 hex, 3 entropy (KINDS). Null text counts as empty and has no spans. Patterns run only on
    texts that hold a match at all. Repeated rows are each scanned; no row is moved, so hot keys don't matter.
    """
    kind = "array<struct<at:int,kind:int,end:int>>"
    none = F.array().cast(kind)
    body = F.coalesce("text", F.lit(""))
    assign = F.filter(_located(body, ASSIGN, 2), lambda m: F.length(m["body"]) >= 6)
    found = [
        F.when(body.rlike(ASSIGN), _spans(assign, 0)),
        F.when(F.contains(body, F.lit("AKIA")), _spans(_located(body, ACCESS), 1)),
        F.when(body.rlike(HEX), _spans(_located(body, HEX), 2)),
        F.when(body.rlike(CANDIDATE), _entropy_spans(body, thresholds or THRESHOLDS, allowed, window)),
    ]
    return docs.withColumn("secrets", F.array_sort(F.concat(*[F.coalesce(x.cast(kind), none) for x in found])))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of find_secrets()' rows."""
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]  # noqa: B023
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def _sql_spans(kind: int, pattern: str, where: str = "true", group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, beg, beg + n AS fin, body FROM (
    SELECT doc_id, body, want, length(body) AS n,
           coalesce(sum(length(gap) + length(body)) OVER (PARTITION BY doc_id ORDER BY i), 0) - length(body) AS beg
    FROM (SELECT doc_id, unnest(range(len(hits))) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS body, unnest(wants) AS want
          FROM (SELECT doc_id, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits,
                       regexp_extract_all(text, '{p}', {group}) AS wants FROM documents WHERE regexp_matches(text, '{p}')))) WHERE {where}"""


_ALLOW = " AND ".join(f"NOT contains(lower(body), '{w}')" for w in ALLOWED)
SQL = rf"""
WITH assign AS ({_sql_spans(0, ASSIGN, "length(want) >= 6", 2)}),
access AS ({_sql_spans(1, ACCESS)}),
hex AS ({_sql_spans(2, HEX)}),
cand AS (SELECT doc_id, beg, body, CASE
    WHEN NOT regexp_matches(body, '[0-9]') OR NOT regexp_matches(body, '[A-Za-z]') THEN NULL
    WHEN regexp_matches(body, '^([0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS["hex"]}
    WHEN regexp_matches(body, '^[A-Za-z0-9]+$') THEN {THRESHOLDS["alnum"]} ELSE {THRESHOLDS["base64"]} END AS least
  FROM ({_sql_spans(3, CANDIDATE)}) WHERE {_ALLOW}),
win AS (SELECT doc_id, beg, body, least, w, unnest(string_split(substr(body, CAST(w + 1 AS INTEGER), {WINDOW}), '')) AS c
  FROM (SELECT *, unnest(range(length(body) - {WINDOW} + 1)) AS w FROM cand WHERE least IS NOT NULL)),
ent AS (SELECT doc_id, beg, least, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS bits
  FROM (SELECT doc_id, beg, least, w, c, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL),
entropy AS (SELECT doc_id, 3 AS kind, beg + min(w) AS beg, beg + max(w) + {WINDOW} AS fin FROM ent WHERE round(bits, 9) >= least GROUP BY doc_id, ent.beg),
every AS (SELECT doc_id, kind, beg, fin FROM assign UNION ALL SELECT doc_id, kind, beg, fin FROM access
  UNION ALL SELECT doc_id, kind, beg, fin FROM hex UNION ALL SELECT doc_id, kind, beg, fin FROM entropy),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(beg AS BIGINT) || ':' || CAST(fin AS BIGINT) AS s FROM every),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
    string_agg(s, ',' ORDER BY beg, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY beg, kind) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_secrets(docs))
