"""Standing queries: incremental membership over the deltas, in batch and as a stateful stream, with bounded delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import Embedder, chunk
from tarn.plans.compiler import compile_expr, row_bind
from tarn.plans.rql import Expr, parse
from tarn.plans.scope import UNRESTRICTED, Scope
from tarn.schema import ALERT_THRESHOLD

#: Events that a subscriber's buffer holds.
LEAST_CAPACITY, IPC_CAPACITY, SSE_CAPACITY = 16, 1024, 4096


@dataclass(frozen=True)
class View:
    """A standing predicate under a scope. condition: over delta rows, whose new state is path, kind, size, mtime_ns,
    index_state, text, symbols, and chunk vectors for alerts."""

    id: str
    condition: Column
    scope: Scope = UNRESTRICTED

    @classmethod
    def of(cls, id: str, query: str | Expr, scope: Scope = UNRESTRICTED) -> View:
        expr = parse(query) if isinstance(query, str) else query
        return cls(id, compile_expr(expr, row_bind()), scope)

    @classmethod
    def alert(cls, id: str, query: str, embedder: Embedder, threshold: float = ALERT_THRESHOLD, scope: Scope = UNRESTRICTED) -> View:
        """Holds where the best chunk of the text is as similar as the threshold; it starts without members."""
        wanted = [float(x) for x in embedder.embed(query)]

        @F.pandas_udf("double")
        def best(texts: pd.Series) -> pd.Series:
            def one(text: str | None) -> float:
                scores = [sum(float(a) * b for a, b in zip(embedder.embed(part), wanted)) for _, part in chunk(text or "")]
                return max([0.0, *scores])

            return texts.map(one)

        return cls(id, best("text") >= threshold, scope)


def observations(deltas: DataFrame, views: Sequence[View]) -> DataFrame:
    """view_id, oid, lsn, path, match: what each delta says about one object to each view whose scope has the path.

    Folders never match. A delta without a new state speaks of the object that left the path. Views are columns of one
    pass over the deltas, not a product with them."""
    there = F.col("new_oid").isNotNull() & (F.coalesce("kind", F.lit("file")) != "dir")
    said = F.array(
        *[
            F.when(
                v.scope.column("path"),
                F.struct(F.lit(v.id).alias("view_id"), (there & F.coalesce(v.condition, F.lit(False))).alias("match")),
            )
            for v in views
        ]
    )
    rows = deltas.withColumn("oid", F.when(there, F.col("new_oid")).otherwise(F.col("old_oid"))).where("oid IS NOT NULL")
    rows = rows.select("lsn", "path", "oid", F.explode(F.filter(said, lambda s: s.isNotNull())).alias("s"))
    return rows.select("s.view_id", "oid", "lsn", "path", "s.match")


def events(observed: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """view_id, oid, lsn, path, event (enter or leave) wherever an object's match changes; members (view_id, oid) matched
    before. One shuffle by view and object."""
    rows = observed
    if members is not None:
        start = members.select("view_id", "oid", F.lit(-1).cast("long").alias("lsn"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("match"))
        rows = rows.unionByName(start)
    order = Window.partitionBy("view_id", "oid").orderBy("lsn", "path")
    rows = rows.withColumn("was", F.lag("match", 1, False).over(order)).where("match <> was AND lsn >= 0")
    return rows.select("view_id", "oid", "lsn", "path", F.when(F.col("match"), "enter").otherwise("leave").alias("event"))


def membership(observed: DataFrame) -> DataFrame:
    """view_id, oid of the members after the last delta."""
    return observed.groupBy("view_id", "oid").agg(F.max_by("match", F.struct("lsn", "path")).alias("m")).where("m").select("view_id", "oid")


def deliver(found: DataFrame, capacity: int) -> DataFrame:
    """Events of a batch as one subscriber gets them: those that fit, or a single resync in their place for a view that has
    more than fit."""
    capacity = max(capacity, LEAST_CAPACITY)
    size = found.groupBy("view_id").agg(F.count("*").alias("n"))
    rows = found.join(F.broadcast(size), "view_id")  # a row for each view
    fits = rows.where(F.col("n") <= capacity).drop("n")
    over = size.where(F.col("n") > capacity).select(
        "view_id", F.lit(None).cast("long").alias("oid"), F.lit(None).cast("long").alias("lsn"), F.lit(None).cast("string").alias("path"), F.lit("resync").alias("event")
    )
    return fits.unionByName(over)


def stream_events(observed: DataFrame) -> DataFrame:
    """events() of a stream of observations; each view's object keeps one boolean of state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        view_id, oid = key
        member = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["lsn", "path"])
        out = []
        for lsn, path, match in zip(rows["lsn"], rows["path"], rows["match"]):
            if bool(match) != member:
                member = bool(match)
                out.append((view_id, oid, lsn, path, "enter" if member else "leave"))
        state.update((member,))
        yield pd.DataFrame(out, columns=["view_id", "oid", "lsn", "path", "event"])

    return observed.groupBy("view_id", "oid").applyInPandasWithState(
        step, "view_id string, oid long, lsn long, path string, event string", "member boolean", "append", "NoTimeout"
    )


def subscribe(found: DataFrame, sink: Callable[[DataFrame], None], capacity: int, checkpoint: str, **trigger: Any):
    """Starts delivery of a stream of events: each batch's events or resyncs go to sink."""

    def send(batch: DataFrame, _: int) -> None:
        sink(deliver(batch, capacity))

    return found.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
