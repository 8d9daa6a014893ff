"""The dominant oscillation of a series while it is in motion, and the mean over one of its periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import Rows, streamed


def regular(series: DataFrame, unit: float) -> DataFrame:
    """(rec, k, y, dt): samples at the k-th multiple of a recording's median step dt behind its first one, by linear interpolation; dt in
    seconds, `unit` of the time column each. Of equal times the last sample counts."""
    order = Window.partitionBy("rec").orderBy("t", "seq")
    pairs = series.filter("y is not null").select("rec", "t", "y", F.lead("t").over(order).alias("t1"), F.lead("y").over(order).alias("y1"))
    base = pairs.groupBy("rec").agg(F.min("t").alias("t0"), F.percentile(F.col("t1") - F.col("t"), 0.5).alias("dt")).filter("dt > 0")
    rows = pairs.filter("t1 > t").join(base, "rec")
    low, high = (F.ceil((F.col(c) - F.col("t0")) / F.col("dt")) for c in ("t", "t1"))
    points = rows.filter(high > low).withColumn("k", F.explode(F.sequence(low, high - 1)))
    at = F.col("t0") + F.col("k") * F.col("dt")
    return points.select("rec", "k", (F.col("y") + (F.col("y1") - F.col("y")) * (at - F.col("t")) / (F.col("t1") - F.col("t"))).alias("y"), (F.col("dt") / unit).alias("dt"))


def _mean_around(y: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Means of n neighbours as np.convolve places them ("valid" or "same"), by running sums, so that the time does not grow with n."""
    if mode == "same":
        left = (n - 1) // 2
        y = np.r_[np.zeros(n - 1 - left), y, np.zeros(left)]
    upto = np.r_[0, np.cumsum(y, dtype=np.longdouble)]
    return ((upto[n:] - upto[:-n]) / n).astype(float)


def _low_spectrum(y: np.ndarray, n: int, bins: int, block: int = 4096) -> np.ndarray:
    """The first bins of np.fft.rfft(y, n): sums within blocks of samples by one matrix product, turned by each block's place."""
    turn = np.exp(-2j * np.pi / n * np.outer(np.arange(bins), np.arange(block)))
    padded = np.zeros((-(-len(y) // block), block))
    padded.ravel()[: len(y)] = y
    within = turn.real @ padded.T + 1j * (turn.imag @ padded.T)
    return (within * np.exp(-2j * np.pi / n * np.outer(np.arange(bins), block * np.arange(len(padded))))).sum(axis=1)


def gait(grid: DataFrame, moving: float = 0.5, low: float = 1.0, high: float = 6.0, seconds: float = 8.0, share: float = 0.95) -> DataFrame:
    """(rec, period, frequency, prominence, windows) of grid as of regular: the strongest frequency between low and high.

    Spectra of half-overlapping windows in which y, averaged over a second, exceeds `moving` for `share` of the samples are averaged; the
    peak is refined by a parabola through its logarithm and its neighbours'. prominence: peak over the band's median. Recordings without
    such a window give no row. One window and a second around it are held, and of its spectrum the band alone.
    """

    def estimate(rows: Rows) -> Iterator[tuple]:
        held: list[float] = []
        first = windows = at = 0
        total = n = one = bins = None
        dt = 0.0

        def use(begin: int, ended: bool) -> None:
            """Adds the window from place `begin`, held from place `first` on."""
            nonlocal total, windows
            left, right = begin - (one - 1 - (one - 1) // 2), begin + n + (one - 1) // 2
            y = np.array(held[max(left, 0) - first : right - first])
            y = np.r_[np.zeros(max(0, -left)), y]
            y = np.r_[y, np.zeros(right - left - len(y))] if ended else y
            if (_mean_around(y, one, "valid") > moving).mean() < share:
                return
            own = np.array(held[begin - first : begin - first + n])
            slow = int(2 / dt)
            spectrum = np.abs(_low_spectrum((own - _mean_around(own, slow, "same")) * np.hanning(n), 8 * n, bins)) ** 2
            total = spectrum if total is None else total + spectrum
            windows += 1

        for k, y, step in rows:
            if n is None:
                dt = step
                n, one = int(round(seconds / dt)), max(int(round(1 / dt)), 1)
                if n < 2 or int(2 / dt) < 1:
                    return
                bins = min(int(min(high, 0.45 / dt) * 8 * n * dt) + 2, 4 * n + 1)  # the band and a neighbour
            held.append(y)
            if first + len(held) > at + n + one:
                use(at, False)
                at += n // 2
                drop = max(0, at - one - first)
                del held[:drop]
                first += drop
        while n is not None and n > 1 and at < first + len(held) - n:
            use(at, True)
            at += n // 2
        if not windows:
            return
        p = total / windows
        f = np.arange(bins) / (8 * n * dt)
        band = (f > low) & (f < min(high, 0.45 / dt))
        if not band.any():
            return
        i = int(np.argmax(np.where(band, p, 0)))
        a, b, c = np.log(np.maximum(p[i - 1 : i + 2], 1e-300))
        bend = a - 2 * b + c
        peak = f[i] + (0.5 * (a - c) / bend if bend else 0.0) * (f[1] - f[0])
        yield float(1 / peak), float(peak), float(p[i] / np.median(p[band])), windows

    return streamed(grid.select("rec", "k", "y", "dt"), ["k"], estimate, "period double, frequency double, prominence double, windows bigint")


def synchronous_mean(series: DataFrame, periods: DataFrame, width: float) -> DataFrame:
    """series with smooth: the mean of y within half a window of each sample; the window is a recording's own period (rec, period in the time
    column's unit), `width` where it has none."""
    own = series.join(periods.select("rec", F.col("period").alias("own_width")), "rec", "left")
    reach = F.coalesce("own_width", F.lit(width)) / 2
    # Sums up to each time; a window is a difference of two of them, found by sorting its ends among the samples.
    marks = own.select("rec", F.col("t").cast("double").alias("x"), F.lit(1).alias("kind"), F.col("y").alias("v"), F.lit(None).cast(series.schema["seq"].dataType).alias("seq"), F.lit(None).cast("int").alias("end"))
    ends = [own.select("rec", (F.col("t") + sign * reach).alias("x"), F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("v"), "seq", F.lit(sign).alias("end")) for sign, kind in ((-1, 0), (1, 2))]
    both = marks.union(ends[0]).union(ends[1])
    running = Window.partitionBy("rec").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("s", F.sum("v").over(running)).withColumn("c", F.count("v").over(running)).filter("end is not null")
    s, c = F.sum(F.coalesce("s", F.lit(0.0)) * F.col("end")), F.sum(F.col("c") * F.col("end"))
    mean = summed.groupBy("rec", "seq").agg(F.try_divide(s, c).alias("smooth"))
    return series.join(mean, ["rec", "seq"])
