"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Hexadecimal digits of a document's seeded draw by which its source is first cut into slices.
SLICE_DIGITS = 3
#: Sources up to which their parameters, a row each, are sent to every executor; beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000


def word_count(text: Column | str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float], budget: float, epochs: float) -> DataFrame:
    """sizes (source, source_size) -> also weight, target.

    Weights repeat over the sources by code point, null last. A target is min(epochs * size, level * weight) with the level
    at which the targets share budget * all sizes: the fixed point of clamping sources at their maximum and dealing the
    excess to the rest by weight. Sources in the order in which they reach their maximum give the level in one pass. One
    row per source is all that is gathered.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(epochs)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    rows = rows.withColumns(
        {
            "capped": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open_weight": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    rows = rows.withColumn("level", (F.col("total") * F.lit(float(budget)) - F.col("capped")) / F.col("open_weight"))
    rows = rows.withColumn("at", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    # the first source that stays below its maximum sets the level for it and all after it
    rows = rows.withColumn("level", F.first("at", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, epochs: float = 2.0, seed: int = 42
) -> DataFrame:
    """All columns of docs, and size, source_size, target, copies, part, taken; one row per input row.

    A source whose target is r times its size takes each document floor(r) times whole (`copies`), and of the rest the
    documents that come first by a seeded draw, until the target is met; the last of them gives only its first `part`
    words. So each source's taken words miss the target by less than one word. The draw is SHA-256 of seed and doc_id;
    its first digits cut a source into slices whose sizes are summed on the map side, and only the slice that holds the
    boundary is put in order. Null text has size 0; a null source is a source of its own, last. Repeated rows draw alike
    and are each their own document. Empty tables give empty results. Columns of docs that are named like an added one are
    replaced, others stay. mixed_rows() gives the mix itself.
    """
    added = ["size", "source_size", "target", "copies", "part", "taken"]
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.drop(*added).withColumns({"size": word_count("text"), "tarn draw": draw})
    rows = rows.withColumn("tarn slice", F.substring("tarn draw", 1, SLICE_DIGITS))
    slices = cut(rows.groupBy("source", "tarn slice").agg(F.sum("size").alias("in_slice")), "slices")
    few = slices.select("source").distinct().count() <= BROADCAST_SOURCES
    sizes = water_fill(slices.groupBy("source").agg(F.sum("in_slice").alias("source_size")), weights, budget, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sizes = sizes.withColumn("copies", whole.cast("long"))
    rest = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    sizes = sizes.withColumn("tarn rest", rest).drop("weight")
    along = Window.partitionBy("source").orderBy("tarn slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = slices.withColumn("tarn upto", F.sum("in_slice").over(along)).join(
        sizes.select(F.col("source").alias("_s"), "tarn rest"), F.col("source").eqNullSafe(F.col("_s"))
    )
    edge = edge.where(F.col("tarn upto") >= F.col("tarn rest")).groupBy("source").agg(F.min(F.struct(F.col("tarn slice").alias("s"), F.col("tarn upto").alias("u"), "in_slice")).alias("e"))
    edge = edge.select(
        F.col("source").alias("_e"), F.col("e.s").alias("tarn edge"), (F.col("e.u") - F.col("e.in_slice")).alias("tarn before")
    )
    plan = sizes.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left").drop("_e").withColumnRenamed("source", "tarn src")
    plan = F.broadcast(cut(plan, "plan")) if few else plan
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("tarn src"))).drop("tarn src")
    on_edge = F.col("tarn slice") == F.col("tarn edge")
    order = Window.partitionBy("source").orderBy("tarn draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(on_edge).withColumn("tarn at", F.col("tarn before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    outside = rows.where(~F.coalesce(on_edge, F.lit(False))).withColumn("tarn at", F.lit(None).cast("long"))
    rows = outside.unionByName(inside)
    part = (
        F.when(on_edge, F.greatest(F.lit(0), F.least("size", F.col("tarn rest") - F.col("tarn at"))))
        .when(F.col("tarn slice") < F.col("tarn edge"), F.col("size"))
        .otherwise(F.lit(0))
    )
    rows = rows.withColumn("part", part.cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return rows.drop("tarn draw", "tarn slice", "tarn edge", "tarn before", "tarn rest", "tarn at")


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix of mix()'s rows: a row `copies` times with its whole text, and once with its first `part` words if part > 0.

    `taken` is then a row's own words, `copies` and `part` go. A part is its words, space-joined. Rows that the
    mix doesn't take aren't there; whole copies of texts without words, which take nothing, are left out too.
    """
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    whole = F.struct(F.col("text").alias("text"), F.col("size").alias("taken"))
    piece = F.when(F.col("part") > 0, F.array(F.struct(first.alias("text"), F.col("part").alias("taken")))).otherwise(F.array().cast("array<struct<text:string,taken:bigint>>"))
    rows = mixed.where("taken > 0").withColumn("tarn piece", F.explode(F.concat(F.array_repeat(whole, F.col("copies").cast("int")), piece)))
    rows = rows.withColumns({"text": F.col("tarn piece")["text"], "taken": F.col("tarn piece")["taken"]})
    return rows.drop("tarn piece", "copies", "part")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
        ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight FROM s),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
        sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - capped) / open_weight AS lv FROM f),
k AS (SELECT *, first(CASE WHEN lv * weight <= most THEN lv END IGNORE NULLS) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT *, CAST(round(target - copies * source_size) AS BIGINT) AS rest FROM p),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM d)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + greatest(0, least(size, rest - beg)) AS BIGINT) AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source
"""


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
