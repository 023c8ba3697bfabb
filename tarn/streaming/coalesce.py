"""Debouncing of file-system events: one work item for a burst on a path."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import parent
from tarn.sources.filesystem import PROBE, RECURSIVE, SHALLOW

QUIET_MS = 500
MAX_DELAY_MS = 5000
MAX_PENDING = 65_536


def kind_of(rescan_recursive: Column) -> Column:
    return F.when(F.coalesce(rescan_recursive, F.lit(False)), F.lit(RECURSIVE)).otherwise(F.lit(PROBE))


def sessions(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """events (path, ts, rescan_recursive) -> path, first, last, kind, n of bursts without a pause of quiet_ms."""
    rows = events.withColumn("kind", kind_of(F.col("rescan_recursive")))
    window = F.session_window("ts", f"{quiet_ms} milliseconds")
    out = rows.groupBy("path", window.alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("kind").alias("kind"), F.count("*").alias("n")
    )
    return out.select("path", "first", "last", "kind", "n")


def work_items(events: DataFrame, quiet_ms: int = QUIET_MS, max_delay_ms: int = MAX_DELAY_MS) -> DataFrame:
    """path, first, last, kind, n, due of work items, none of which waits longer than max_delay_ms after its first event.

    A burst is cut where an event comes max_delay_ms or more after the first since the last cut. Where cuts fall depends on
    the cut before, so a path's events are walked in order; a path with many events streams through in batches.
    """

    def cut(times: pd.Series) -> list[int]:
        out, first, last, group = [], None, None, -1
        for t in times:
            if first is None or t - last >= quiet_ms or t - first >= max_delay_ms:
                first, group = t, group + 1
            last = t
            out.append(group)
        return out

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            tail = frame["path"].iloc[-1]
            done, held = frame[frame["path"] != tail], frame[frame["path"] == tail]
            if len(done):
                yield group(done)
        if held is not None and len(held):
            yield group(held)

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(g=frame.groupby("path", sort=False)["ms"].transform(cut))
        out = frame.groupby(["path", "g"], sort=False).agg(first_ms=("ms", "min"), last_ms=("ms", "max"), kind=("kind", "max"), n=("ms", "size"))
        return out.reset_index()[["path", "first_ms", "last_ms", "kind", "n"]]

    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = events.select("path", ms.alias("ms"), kind_of(F.col("rescan_recursive")).alias("kind"))
    rows = rows.repartition("path").sortWithinPartitions("path", "ms")
    out = rows.mapInPandas(walk, "path string, first_ms long, last_ms long, kind int, n long")
    return out.withColumn("due_ms", F.least(F.col("last_ms") + quiet_ms, F.col("first_ms") + max_delay_ms))


def collapse(work: DataFrame, pending: int, max_pending: int = MAX_PENDING) -> DataFrame:
    """Work items with new paths beyond the bound folded into shallow rescans (or more) of their folders.

    work (path, kind, known): known paths are pending already and always merge. Paths are let in by their name's order."""
    room = max(0, max_pending - pending)
    fresh = work.where(~F.col("known"))
    if fresh.limit(room + 1).count() <= room:
        return work.groupBy("path").agg(F.max("kind").alias("kind"))
    kept = fresh.select("path").distinct().orderBy("path").limit(room).withColumn("fits", F.lit(True))
    rows = work.join(kept, "path", "left").withColumn("over", ~F.col("known") & F.col("fits").isNull())
    rows = rows.select(
        F.when(F.col("over"), parent("path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("over"), F.greatest("kind", F.lit(SHALLOW))).otherwise(F.col("kind")).alias("kind"),
    )
    return rows.groupBy("path").agg(F.max("kind").alias("kind"))


def fence(items: DataFrame, cursors: DataFrame, pending: int) -> DataFrame:
    """Items with source_cursor: the highest position seen, on the last item, and only if nothing is pending any more."""
    top = cursors.agg(F.max("source_cursor").alias("top"))
    last = items.agg(F.max(F.struct("due_ms", "path")).alias("l"))
    rows = items.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(last))  # one row each
    at_end = (F.struct("due_ms", "path") == F.col("l")) & F.lit(pending == 0)
    return rows.withColumn("source_cursor", F.when(at_end, F.col("top"))).drop("top", "l")


def stream_work(events: DataFrame, quiet_ms: int = QUIET_MS, max_delay_ms: int = MAX_DELAY_MS) -> DataFrame:
    """Work items of a stream of events, by processing-time timers: a path is due when quiet, or max_delay_ms after its
    first event, whichever comes first."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        columns = ["path", "first_ms", "last_ms", "kind", "n"]
        if state.hasTimedOut:
            first, last, kind, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], first, last, kind, n)], columns=columns)
            return
        now = state.getCurrentProcessingTimeMs()
        first, _, kind, n = state.get if state.exists else (now, now, PROBE, 0)
        for frame in frames:
            n += len(frame)
            kind = max(kind, int(frame["kind"].max()))
        state.update((int(first), int(now), int(kind), int(n)))
        state.setTimeoutDuration(int(max(1, min(quiet_ms, first + max_delay_ms - now))))
        yield pd.DataFrame([], columns=columns)

    rows = events.withColumn("kind", kind_of(F.col("rescan_recursive")))
    return rows.groupBy("path").applyInPandasWithState(
        step, "path string, first_ms long, last_ms long, kind int, n long", "first long, last long, kind int, n long", "append", "ProcessingTimeTimeout"
    )

