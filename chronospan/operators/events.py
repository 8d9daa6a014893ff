"""Event operators over one feature series per recording: (rec, t, y, seq), ordered by t then seq.

NaN and infinite samples count as null and satisfy no condition. Equal extremes resolve to the first sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("t", "seq")


def periods(series: DataFrame) -> DataFrame:
    """(rec, period): the median gap between samples, cut to a whole number; 0 for a single sample."""
    gaps = series.select("rec", (F.lead("t").over(in_order()) - F.col("t")).alias("gap"))
    return gaps.groupBy("rec").agg(F.coalesce(F.percentile("gap", 0.5).cast("long"), F.lit(0).cast("long")).alias("period"))


def islands(series: DataFrame, mask: Column) -> DataFrame:
    """Samples where mask holds, with the number of their run; runs are neighbours in sample order, whatever their distance."""
    marked = series.withColumn("mask", F.coalesce(mask, F.lit(False)))
    inside = Window.partitionBy("rec", "mask").orderBy("t", "seq")
    return marked.withColumn("run", F.row_number().over(in_order()) - F.row_number().over(inside)).filter("mask").drop("mask")


def compare(y: Column, op: str, x: float) -> Column:
    if op == "=":
        return F.abs(y - x) <= 1e-8 + 1e-5 * abs(x)
    return {">=": y >= x, ">": y > x, "<=": y <= x, "<": y < x}[op]


def threshold(series: DataFrame, op: str, x: float, min_duration: int) -> DataFrame:
    """Instances (rec, start, end, ext, value) of `y op x` lasting min_duration, one sample period included."""
    sign = 1 if op in (">=", ">", "=") else -1
    best = F.max(F.struct((F.col("y") * sign).alias("v"), (-F.col("t")).alias("t")))
    runs = islands(series, compare(F.col("y"), op, x)).groupBy("rec", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), best.alias("b"))
    kept = runs.join(periods(series), "rec").filter(F.col("end") - F.col("start") + F.col("period") >= min_duration)
    return kept.select("rec", "start", "end", (-F.col("b.t")).alias("ext"), (F.col("b.v") * sign).alias("value"))


def threshold_band(series: DataFrame, op: str, x: float, low: Column, high: Column, min_duration: int) -> DataFrame:
    """Instances (rec, start, end, ext, value, truth) where y is known to lie in [low, high]: definite runs that last are TRUE, a possible run
    without one UNKNOWN. For = both are the comparison of y. ext and value: the run's first extreme of y and that."""
    up, equal = op in (">=", ">"), op == "="
    possible = islands(series, compare(F.col("y") if equal else high if up else low, op, x)).withColumnRenamed("run", "outer")
    definite = compare(F.col("y") if equal else low if up else high, op, x)
    nested = Window.partitionBy("rec", "outer").orderBy("t", "seq")
    inner = possible.withColumn("sure", F.coalesce(definite, F.lit(False)))
    inner = inner.withColumn("run", F.row_number().over(nested) - F.row_number().over(Window.partitionBy("rec", "outer", "sure").orderBy("t", "seq")))
    sign = 1 if up or equal else -1
    best = F.max(F.struct((F.col("y") * sign).alias("v"), (-F.col("t")).alias("t")))
    whole = lambda rows, *keys: rows.groupBy("rec", *keys).agg(F.min("t").alias("start"), F.max("t").alias("end"), best.alias("b"))
    period = periods(series)
    long_enough = F.col("end") - F.col("start") + F.col("period") >= min_duration
    sure = whole(inner.filter("sure"), "outer", "run").join(period, "rec").filter(long_enough)
    unknown = whole(possible, "outer").join(period, "rec").filter(long_enough).join(sure.select("rec", "outer").distinct(), ["rec", "outer"], "left_anti")
    show = lambda rows, truth: rows.select("rec", "start", "end", (-F.col("b.t")).alias("ext"), (F.col("b.v") * sign).alias("value"), F.lit(truth).alias("truth"))
    return show(sure, "TRUE").union(show(unknown, "UNKNOWN"))


def change(series: DataFrame, amount: float, within: int) -> DataFrame:
    """Samples (rec, t, y, drop, rise) from which y falls or rises by `amount` at some time in (t, t + within]."""
    ahead = Window.partitionBy("rec").orderBy("t").rangeBetween(1, within)
    moved = series.withColumn("drop", F.col("y") - F.min("y").over(ahead)).withColumn("rise", F.max("y").over(ahead) - F.col("y"))
    return moved.filter((F.col("drop") >= amount) | (F.col("rise") >= amount)).select("rec", "t", "y", "drop", "rise")


def extremum(series: DataFrame, reach: int, highest: bool = True) -> DataFrame:
    """Samples (rec, t, y) that no other within +- reach exceeds; plateaus give all their samples."""
    around = Window.partitionBy("rec").orderBy("t").rangeBetween(-reach, reach)
    best = F.max("y").over(around) if highest else F.min("y").over(around)
    return series.withColumn("best", best).filter("y = best").select("rec", "t", "y")


def refractory(points: DataFrame, gap: int) -> DataFrame:
    """Of points (rec, t, y) in time order those (rec, t) at least `gap` after the last accepted one.

    A recording's points stream through one pass that remembers one time per recording.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_rec, last_t = None, 0
        for rows in it:
            keep = []
            for rec, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                keep.append(rec != last_rec or t - last_t >= gap)
                if keep[-1]:
                    last_rec, last_t = rec, t
            yield rows.filter(pa.array(keep, pa.bool_()))

    ordered = points.filter("rec is not null and t is not null").select("rec", "t").repartition("rec").sortWithinPartitions("rec", "t")
    return ordered.mapInArrow(run, ordered.schema)


def return_to(series: DataFrame, references: DataFrame, fraction: float, within: int) -> DataFrame:
    """(rec, ref, t, y): for each reference time (rec, ref) the first sample in [ref, ref + within] with y >= fraction * y(ref).

    y(ref) is the sample at that time or the last before it, else the recording's first. References meet samples in time buckets.
    """
    from .asof import last_before

    first = series.groupBy("rec").agg(F.min_by("y", F.struct("t", "seq")).alias("y0"))
    known = last_before(references, series, "ref", inclusive=True, carry=("y",)).join(first, "rec").select("rec", "ref", F.coalesce("found_y", "y0").alias("level"))
    known = known.withColumn("slot", F.explode(F.sequence(F.floor(F.col("ref") / F.lit(within)), F.floor((F.col("ref") + within) / F.lit(within)))))
    near = known.join(series.withColumn("slot", F.floor(F.col("t") / F.lit(within))), ["rec", "slot"])
    hit = near.filter(F.col("t").between(F.col("ref"), F.col("ref") + within) & (F.col("y") >= fraction * F.col("level")))
    return hit.groupBy("rec", "ref").agg(F.min(F.struct("t", "seq", "y")).alias("m")).select("rec", "ref", "m.t", "m.y")


def tracks(series: DataFrame) -> DataFrame:
    """(rec, topic, appear, disappear, n_obs) per track."""
    return series.groupBy("rec", "topic").agg(F.min("t").alias("appear"), F.max("t").alias("disappear"), F.count("*").alias("n_obs"))


def disappear(bound: DataFrame, tracks: DataFrame) -> DataFrame:
    """(rec, seq, t, reason) per reference (rec, seq, topic): the end of its track; NO_BINDING where no track is bound."""
    ends = tracks.select("rec", "topic", F.col("disappear").alias("t"))
    return bound.join(ends, ["rec", "topic"], "left").select("rec", "seq", "t", F.when(F.col("topic").isNull(), "NO_BINDING").alias("reason"))


def onset(series: DataFrame, below: float, above: float, least: int, sustain: int, creep: float, raw: str = "y") -> DataFrame:
    """(rec, start, sustained, value): after a run under `below` of at least `least`, the first sample over `above` whose mean over
    [t, t + sustain] is over it too and which lies `least` past the run's start; start walks back over samples over `creep`. Runs are those
    of y; all else is read from the column `raw`, the signal before smoothing. start and sustained are the ends of the onset's band.

    The window must end before the last sample. Runs that lead to one start give one onset.
    """
    at = in_order()
    ahead = Window.partitionBy("rec").orderBy("t").rangeBetween(0, sustain)
    whole = Window.partitionBy("rec")
    rows = series.withColumn("n", F.row_number().over(at)).withColumn("ahead", F.avg(raw).over(ahead)).withColumn("t_last", F.max("t").over(whole))
    ok = (F.col(raw) > above) & (F.col("ahead") > above) & (F.col("t") + sustain < F.col("t_last"))
    runs = islands(rows, F.col("y") < below).groupBy("rec", "run").agg(F.min("n").alias("na"), F.min("t").alias("ta"), F.max("t").alias("tb")).filter(F.col("tb") - F.col("ta") >= least)
    # From a run's earliest possible time on, the next good sample; both tables meet in one sort.
    marks = runs.select("rec", (F.col("ta") + least).alias("t"), F.lit(0).alias("kind"), F.col("na").alias("n"), F.lit(None).cast("long").alias("found"))
    good = rows.filter(ok).select("rec", "t", F.lit(1).alias("kind"), "n", F.col("n").cast("long").alias("found"))
    future = Window.partitionBy("rec").orderBy("t", "kind", "n").rowsBetween(0, Window.unboundedFollowing)
    k = marks.union(good).withColumn("nk", F.first("found", ignorenulls=True).over(future)).filter("kind = 0 and nk is not null").select("rec", F.col("n").alias("na"), "nk")
    still = Window.partitionBy("rec").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    back = rows.select("rec", F.col("n").alias("nk"), F.max(F.when(F.col(raw) <= creep, F.col("n"))).over(still).alias("low"), F.col("t").alias("sustained"), F.col(raw).alias("value"))
    found = k.join(back, ["rec", "nk"]).withColumn("nj", F.least("nk", F.greatest(F.coalesce("low", F.lit(0)), "na") + 1))
    one = found.groupBy("rec", "nj").agg(F.min_by(F.struct("sustained", "value"), "na").alias("m"))
    return one.join(rows.select("rec", F.col("n").alias("nj"), F.col("t").alias("start")), ["rec", "nj"]).select("rec", "start", "m.sustained", "m.value")
