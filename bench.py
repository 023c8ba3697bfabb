"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its value is the median of full runs that write every row to a
no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.operators.lexical import LexicalPlane
from tarn.queries import QUERIES, engine, probe_vector

HEADLINE = [
    "attr_cmp", "bool_mix", "text_and", "text_or_attr", "scan_count", "bm25_topk", "phrase_match", "semantic_topk",
    "hybrid_rrf_tagged", "snippets", "postings", "journal_fold_objects", "journal_deltas", "live_enter_leave", "coalesce_capped",
    "reconcile_diff", "latency_histogram", "histogram_percentile",
]


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(lambda name=name: QUERIES[name](spark, sf_dir))
        seconds[name] = round(median(timed(lambda name=name: QUERIES[name](spark, sf_dir)) for _ in range(runs)), 3)
    # warm planes: an index that is built once and asked often
    e = engine(spark, sf_dir)
    e.lexical = LexicalPlane(e.lexical.postings.cache(), e.lexical.lengths.cache())
    seconds["index_build"] = round(timed(lambda: e.lexical.postings), 3)
    e.entries = e.entries.cache()
    e.entries.count()
    timed(lambda: e.search_text("that with", 100))
    seconds["warm_bm25_top100"] = round(median(timed(lambda: e.search_text("that with", 100)) for _ in range(5)), 3)
    vec = probe_vector(spark, sf_dir)
    e.vectors.chunks = e.vectors.chunks.cache()
    timed(lambda: e.semantic(vec, 100))
    seconds["warm_semantic_top100"] = round(median(timed(lambda: e.semantic(vec, 100)) for _ in range(5)), 3)
    # throughput: the BM25 top 100 of each of 500 term queries, in one job over the warm postings
    terms = e.lexical.postings.groupBy("term").count().orderBy(F.desc("count"), "term").limit(500).select(F.col("term").alias("query"), "term")
    n_queries = terms.count()
    timed(lambda: e.lexical.top_each(terms, 100))
    batch = timed(lambda: e.lexical.top_each(terms, 100))
    seconds["batch_500_term_queries"] = round(batch, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "batch_queries_per_sec": round(n_queries / batch, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
