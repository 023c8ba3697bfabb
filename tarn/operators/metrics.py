"""Counters, gauges, fixed-bucket histograms and the snapshot report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the buckets in milliseconds (fixed values); beyond the last is the overflow bucket.
BOUNDS_MS = (
    0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 30000.0, 60000.0,
)
#: Buckets of failed extractions (fixed values).
FAILURES = {
    "encrypted": "encrypted",
    "password-required": "encrypted",
    "corrupt": "corrupt",
    "unsupported": "unsupported",
    "budget-exceeded": "budget-exceeded",
    "quarantined": "quarantined",
}


def bucket(ms: Column | str) -> Column:
    """Index of the first bound that is no less than ms; the number of bounds beyond all."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    out = F.lit(len(BOUNDS_MS))
    for i in reversed(range(len(BOUNDS_MS))):
        out = F.when(ms <= BOUNDS_MS[i], F.lit(i)).otherwise(out)
    return out


def histogram(samples: DataFrame, ms: str, by: Sequence[str] = ()) -> DataFrame:
    """by, bucket, n, sum_us: at most 19 rows for each group, summed before the shuffle; microseconds are truncated."""
    return samples.groupBy(*by, bucket(ms).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum((F.col(ms).cast("double") * 1000).cast("long")).alias("sum_us")
    )


def histogram_report(hist: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """by, count, mean_ms, p50_ms, ...: a percentile is the middle of the bucket in which the p-share of samples is reached."""
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*by)
    rows = hist.withColumns({"cum": F.sum("n").over(order), "total": F.sum("n").over(total)})
    edges = F.array(F.lit(0.0), *map(F.lit, BOUNDS_MS), F.lit(BOUNDS_MS[-1]))
    middle = (F.element_at(edges, F.col("bucket") + 1) + F.element_at(edges, F.col("bucket") + 2)) / 2
    aggs = [F.sum("n").alias("count"), F.round(F.sum("sum_us") / 1000 / F.sum("n"), 2).alias("mean_ms")]
    for p in percentiles:
        reached = F.when(F.col("cum") >= F.ceil(F.lit(p) * F.col("total")), F.struct("bucket", middle.alias("m")))
        aggs.append(F.min(reached)["m"].alias(f"p{round(p * 100)}_ms"))
    return rows.groupBy(*by).agg(*aggs)


def failure_bucket(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    out = F.lit("other")
    for name, label in FAILURES.items():
        out = F.when(status == name, F.lit(label)).otherwise(out)
    return out


def failure_counts(records: DataFrame, status: str) -> DataFrame:
    """failure, n of the records that are not complete."""
    bad = records.where(~F.col(status).isin("complete", "partial"))
    return bad.groupBy(failure_bucket(status).alias("failure")).agg(F.count("*").alias("n"))


def counters(events: DataFrame) -> DataFrame:
    """events (metric, value) -> metric, total."""
    return events.groupBy("metric").agg(F.sum("value").alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """events (metric, value, at) -> metric, value: the last one set."""
    return events.groupBy("metric").agg(F.max_by("value", "at").alias("value"))


def scan_stats(changes: DataFrame) -> DataFrame:
    """upserts and removals of a reconciliation."""
    count = lambda op: F.count(F.when(F.col("op") == op, True))
    return changes.agg(count("upsert").alias("upserts"), count("remove").alias("removals"))


def snapshot(counter_rows: DataFrame, gauge_rows: DataFrame, histograms: DataFrame, failures: DataFrame) -> DataFrame:
    """One row, one JSON report: throughput, health, freshness and backlog."""
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    c = counter_rows.agg(pairs("metric", "total").alias("counters"))
    g = gauge_rows.agg(pairs("metric", "value").alias("gauges"))
    f = failures.agg(pairs("failure", "n").alias("extraction_failures"))
    stats = F.struct("count", "mean_ms", "p50_ms", "p90_ms", "p99_ms")
    h = histogram_report(histograms, ["metric"]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), stats.alias("h"))))).alias("freshness")
    )
    one = c.crossJoin(g).crossJoin(f).crossJoin(h)  # each side is one row
    return one.select(F.to_json(F.struct("counters", "gauges", "extraction_failures", "freshness")).alias("report"))
