"""Causal window reductions of a series (rec, t, y, seq); a reduction over (t - w, t] sees rows up to its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("t", "seq")


def trailing(series: DataFrame, width: int) -> DataFrame:
    """series with n, low, high, mean and median over (t - width, t]; times must be distinct inside a recording."""
    span = Window.partitionBy("rec").orderBy("t").rangeBetween(-(width - 1), 0)
    y = F.col("y")
    return series.select(
        "rec", "t", "y", F.count(y).over(span).alias("n"), F.min(y).over(span).alias("low"), F.max(y).over(span).alias("high"),
        F.round(F.avg(y).over(span), 6).alias("mean"), F.round(F.percentile(y, 0.5).over(span), 6).alias("median"),
    )


def integral(series: DataFrame, unit: int) -> DataFrame:
    """series with the running sum of y * (time since the previous sample), the first sample adding 0."""
    step = F.coalesce(F.col("t") - F.lag("t").over(in_order()), F.lit(0)) / F.lit(unit)
    return series.withColumn("part", F.col("y") * step).withColumn("total", F.round(F.sum("part").over(in_order()), 4)).select("rec", "t", "y", "total")


def value_before(series: DataFrame, lag: int) -> DataFrame:
    """series with past: the value at the last sample at or before t - lag, else the recording's first."""
    past = Window.partitionBy("rec").orderBy("t").rangeBetween(Window.unboundedPreceding, -lag)
    return series.select("rec", "t", "y", F.coalesce(F.max(F.struct("t", "seq", "y")).over(past)["y"], F.first("y").over(in_order())).alias("past"))


def time_mean(series: DataFrame, width: int) -> DataFrame:
    """series with mean: the time average of the piecewise-linear signal over [t - width, t], held at the recording's first sample.

    The integral up to t - width comes from the last sample at or before it, so every row needs one sort.
    """
    order = in_order()
    step = (F.col("t") - F.lag("t").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2
    rows = series.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("total", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next_t", F.lead("t").over(order)).withColumn("next_y", F.lead("y").over(order)).withColumn("t0", F.min("t").over(Window.partitionBy("rec")))
    at = F.struct("t", "y", "total", "next_t", "next_y")
    past = Window.partitionBy("rec").orderBy("t").rangeBetween(Window.unboundedPreceding, -width)
    rows = rows.withColumn("low", F.greatest(F.col("t") - width, F.col("t0"))).withColumn("p", F.coalesce(F.last(at).over(past), F.first(at).over(order)))
    share = F.try_divide((F.col("low") - F.col("p.t")).cast("double"), (F.col("p.next_t") - F.col("p.t")).cast("double"))
    before = F.col("p.total") + F.coalesce(share, F.lit(0.0)) * (F.col("p.next_t") - F.col("p.t")) * (F.col("p.y") + F.col("p.y") + (F.col("p.next_y") - F.col("p.y")) * share) / 2
    span = F.col("t") - F.col("low")
    return rows.select("rec", "t", "y", F.when(span > 0, (F.col("total") - F.coalesce(before, F.lit(0.0))) / span).otherwise(F.col("y")).alias("mean"))


def run_flags(series: DataFrame, mask: Column, least: int, most: int) -> DataFrame:
    """series with flag: whether the sample is in a run of mask that lasts between least and most."""
    marked = series.withColumn("mask", F.coalesce(mask, F.lit(False)))
    inside = Window.partitionBy("rec", "mask").orderBy("t", "seq")
    marked = marked.withColumn("run", F.row_number().over(in_order()) - F.row_number().over(inside))
    whole = Window.partitionBy("rec", "mask", "run")
    return marked.withColumn("long", F.max("t").over(whole) - F.min("t").over(whole)).select("rec", "t", "y", "seq", (F.col("mask") & F.col("long").between(least, most)).alias("flag"))


def drawdown(windows: DataFrame) -> DataFrame:
    """Per window (rec, w) of rows (rec, w, t, seq, y): the largest fall below an earlier maximum inside it."""
    past = Window.partitionBy("rec", "w").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("gone", F.max("y").over(past) - F.col("y")).groupBy("rec", "w").agg(F.max("gone").alias("gone"))


def ahead(series: DataFrame, width: int) -> DataFrame:
    """series with the least and greatest value in (t, t + width] and the first time of each."""
    after = Window.partitionBy("rec").orderBy("t").rangeBetween(1, width)
    best = lambda sign: F.max(F.struct((F.col("y") * sign).alias("v"), (-F.col("t")).alias("t"))).over(after)
    rows = series.withColumn("lo", best(-1)).withColumn("hi", best(1))
    return rows.select("rec", "t", "seq", (-F.col("lo.v")).alias("low"), (-F.col("lo.t")).alias("low_t"), F.col("hi.v").alias("high"), (-F.col("hi.t")).alias("high_t"))


def window_signals(windows: DataFrame) -> DataFrame:
    """Per window (rec, w) of rows (rec, w, t, seq, y): n, mean, low, high, delta (last less first), absmax, gone (drawdown), mask."""
    first, last = F.min(F.struct("t", "seq", "y")), F.max(F.struct("t", "seq", "y"))
    out = windows.groupBy("rec", "w").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), (last["y"] - first["y"]).alias("delta"), F.max(F.abs("y")).alias("absmax"))
    return out.join(drawdown(windows), ["rec", "w"]).withColumn("mask", (F.col("n") > 0).cast("double"))
