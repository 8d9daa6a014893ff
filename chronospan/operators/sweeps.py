"""Exhaustive sweeps of a series for candidates, on a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resampled(series: DataFrame, step: int) -> DataFrame:
    """(rec, t, y) on the grid of multiples of `step` between a recording's samples, by linear interpolation; each pair of neighbouring
    samples makes the grid points between them, so no join is needed. Equal times: the last one counts."""
    order = Window.partitionBy("rec").orderBy("t", "seq")
    pairs = series.select("rec", "t", "y", F.lead("t").over(order).alias("t1"), F.lead("y").over(order).alias("y1")).filter("t1 > t")
    points = F.sequence(F.ceil(F.col("t") / F.lit(step)), F.ceil(F.col("t1") / F.lit(step)) - 1)
    some = F.ceil(F.col("t1") / F.lit(step)) > F.ceil(F.col("t") / F.lit(step))
    grid = pairs.filter(some).withColumn("g", F.explode(points)).withColumn("at", F.col("g") * step)
    return grid.select("rec", F.col("at").alias("t"), (F.col("y") + (F.col("y1") - F.col("y")) * (F.col("at") - F.col("t")) / (F.col("t1") - F.col("t"))).alias("y"))


def baseline(grid: DataFrame, width: int, least: int) -> DataFrame:
    """grid with base: the median of y over [t - width, t), null with fewer than `least` points."""
    before = Window.partitionBy("rec").orderBy("t").rangeBetween(-width, -1)
    held = grid.withColumn("base_of", F.sort_array(F.collect_list("y").over(before)))
    n = F.size("base_of")
    # The two middle values, one and the same for an odd number.
    low, high = F.get("base_of", F.floor((n - 1) / 2).cast("int")), F.get("base_of", F.floor(n / 2).cast("int"))
    return held.withColumn("base", F.when(n >= least, 0.5 * low + 0.5 * high)).drop("base_of")


def stays_low(grid: DataFrame, share: float, recent: int, duration: int) -> DataFrame:
    """Points (rec, t, worst) from which y stays under share * the largest recent baseline for `duration`."""
    past = Window.partitionBy("rec").orderBy("t").rangeBetween(-recent, 0)
    ahead = Window.partitionBy("rec").orderBy("t").rangeBetween(0, duration)
    marked = grid.withColumn("ref", F.max("base").over(past)).withColumn("worst", F.max("y").over(ahead)).withColumn("upto", F.max("t").over(ahead))
    return marked.filter((F.col("worst") < share * F.col("ref")) & (F.col("upto") == F.col("t") + duration)).select("rec", "t", "worst")


def little_progress(grid: DataFrame, width: int, most: float, least: float) -> DataFrame:
    """Points (rec, t, net, top) whose y moves less than `most` over [t, t + width] although it reaches `least`."""
    ahead = Window.partitionBy("rec").orderBy("t").rangeBetween(0, width)
    marked = grid.withColumn("net", F.abs(F.last("y").over(ahead) - F.first("y").over(ahead))).withColumn("top", F.max("y").over(ahead)).withColumn("upto", F.max("t").over(ahead))
    return marked.filter((F.col("net") < most) & (F.col("top") >= least) & (F.col("upto") == F.col("t") + width)).select("rec", "t", "net", "top")


def swings(grid: DataFrame, onset: int, lengths: list[int], loss: float, turn: float) -> DataFrame:
    """(rec, t, length, lost, excursion) of onsets (multiples of `onset`) and lengths over which y loses `loss` and swings by at most `turn`;
    all lengths are frames of one sort."""
    order = Window.partitionBy("rec").orderBy("t")
    marked = grid
    for i, n in enumerate(lengths):
        ahead = order.rangeBetween(0, n)
        marked = marked.withColumns({f"low{i}": F.min("y").over(ahead), f"high{i}": F.max("y").over(ahead), f"upto{i}": F.max("t").over(ahead)})
    each = F.array(*(F.struct(F.lit(n).alias("length"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), F.col(f"upto{i}").alias("upto")) for i, n in enumerate(lengths)))
    out = marked.filter(F.col("t") % onset == 0).select("rec", "t", "y", F.inline(each))
    out = out.withColumn("lost", F.col("y") - F.col("low")).withColumn("excursion", F.col("high") - F.col("low"))
    return out.filter((F.col("lost") >= loss) & (F.col("excursion") <= turn) & (F.col("upto") == F.col("t") + F.col("length"))).select("rec", "t", "length", "lost", "excursion")


def merged_stats(intervals: DataFrame, gap: int, stat: str) -> DataFrame:
    """Unions of (rec, start, end, stat) within gap: rec, start, end, n, and the largest stat."""
    order = Window.partitionBy("rec").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0)
    runs = intervals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("rec", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max(stat).alias(stat)).drop("run")


def overlapping(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """left (rec, lid, start, end) and right (rec, rid, start, end): the pairs (rec, lid, rid) that overlap, met in time buckets."""
    cut = lambda df: df.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / F.lit(bucket)), F.floor(F.col("end") / F.lit(bucket)))))
    r = cut(right).select("rec", "slot", "rid", F.col("start").alias("s1"), F.col("end").alias("e1"))
    return cut(left).join(r, ["rec", "slot"]).filter("start <= e1 and end >= s1").select("rec", "lid", "rid").distinct()
