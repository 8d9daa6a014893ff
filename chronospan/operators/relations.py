"""Temporal relations between instances of one recording: (rec, start, end) parents and (rec, start, end, truth) children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bind(parents: DataFrame, children: DataFrame, kind: str, least: int = 0, most: int = 0, bucket: int | None = None) -> DataFrame:
    """Every parent with one child's c_start, c_end, c_truth, or nulls. kind: AFTER, BEFORE, WITHIN or DURING.

    The child's anchor is its start, the parent's its end (DURING: its interval). TRUE children come first, then the earliest, latest or
    nearest. Both sides meet in time buckets of the relation's reach, so a long recording spreads over many tasks.
    """
    p = parents.withColumn("pid", F.struct("rec", "start", "end"))
    low, high = {
        "AFTER": (F.col("end") + least, F.col("end") + most), "BEFORE": (F.col("end") - most, F.col("end") - least),
        "WITHIN": (F.col("end") - most, F.col("end") + most), "DURING": (F.col("start"), F.col("end")),
    }[kind]
    size = bucket or (most if most > 0 else 86_400_000_000)
    p = p.withColumn("low", low).withColumn("high", high)
    spread = p.withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    c = children.select("rec", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("truth").alias("c_truth"), F.floor(F.col("start") / size).alias("slot"))
    met = spread.join(c, ["rec", "slot"]).filter(F.col("c_start").between(F.col("low"), F.col("high")))
    key = {"AFTER": F.col("c_start"), "BEFORE": -F.col("c_start"), "WITHIN": F.abs(F.col("c_start") - F.col("end")), "DURING": F.col("c_start")}[kind]
    pick = F.min(F.struct((F.col("c_truth") != "TRUE").alias("doubt"), key.alias("k"), "c_start", "c_end", "c_truth"))
    best = met.groupBy("pid").agg(pick.alias("b")).select("pid", "b.c_start", "b.c_end", "b.c_truth")
    return p.join(best, "pid", "left").select(*parents.columns, "c_start", "c_end", "c_truth")


def kleene(bound: DataFrame, truths: list[str]) -> DataFrame:
    """bound with ordinal, a missing truth counting as UNKNOWN: 0 if any truth is FALSE, 2 if all are TRUE, else 1 + 0.99 * the share of TRUE ones."""
    cols = [F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in truths]
    n_true = sum((c == "TRUE").cast("int") for c in cols)
    false = F.lit(False)
    for c in cols:
        false = false | (c == "FALSE")
    n = len(truths)
    return bound.withColumn("ordinal", F.when(false, 0.0).when(n_true == n, 2.0).otherwise(1 + 0.99 * n_true / n))


def merge_intervals(intervals: DataFrame, gap: int) -> DataFrame:
    """Unions of (rec, start, end) that overlap or lie within gap: (rec, start, end, n)."""
    order = Window.partitionBy("rec").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0)
    runs = intervals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("rec", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("run")


def hopping(series: DataFrame, width: int, stride: int) -> DataFrame:
    """(rec, w0, n, mean_y): samples in windows [w0, w0 + width], closed at both ends, every stride."""
    first = F.ceil((F.col("t") - width) / F.lit(stride))
    spread = series.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") / F.lit(stride)))))
    return spread.groupBy("rec", (F.col("w") * stride).alias("w0")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))
