"""Signals of overlapping windows from panes: mergeable states per pane, merged into windows that are closed at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ("n", "total", "low", "high", "largest", "drop", "first", "last")


def panes(series: DataFrame, size: int) -> DataFrame:
    """A state per (rec, topic, pane): the open stretch after k * size is pane 2k + 1, the instant k * size itself pane 2k."""
    at = F.floor(F.col("t") / F.lit(size))
    pane = F.when(F.col("t") == at * size, 2 * at).otherwise(2 * at + 1)
    rows = series.filter("y is not null").withColumn("pane", pane)
    before = Window.partitionBy("rec", "topic", "pane").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    gone = rows.withColumn("gone", F.max("y").over(before) - F.col("y"))
    order = F.struct("t", "seq")
    return gone.groupBy("rec", "topic", "pane").agg(
        F.count("*").alias("n"), F.sum("y").alias("total"), F.min("y").alias("low"), F.max("y").alias("high"), F.max(F.abs("y")).alias("largest"),
        F.max("gone").alias("drop"), F.min_by("y", order).alias("first"), F.max_by("y", order).alias("last"),
    )


def merged(states: Column) -> Column:
    """One state of neighbouring panes' states in order: a fall may begin in one pane and end in a later one."""

    def add(a: Column, b: Column) -> Column:
        fields = {
            "n": a["n"] + b["n"], "total": a["total"] + b["total"], "low": F.least(a["low"], b["low"]), "high": F.greatest(a["high"], b["high"]),
            "largest": F.greatest(a["largest"], b["largest"]), "drop": F.greatest(a["drop"], b["drop"], a["high"] - b["low"]), "first": a["first"], "last": b["last"],
        }
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    return F.reduce(F.slice(states, 2, 1 << 20), states[0], add)


def window_states(series: DataFrame, size: int, per_window: int) -> DataFrame:
    """(rec, w, topic, state): the window w is [w * size, (w + per_window) * size]; per pane at most per_window + 1 windows take its state."""
    own = panes(series, size)
    first, last = F.ceil(F.col("pane") / 2) - per_window, F.floor(F.col("pane") / 2)
    first = F.when(F.col("pane") % 2 == 0, F.col("pane") / 2 - per_window).otherwise((F.col("pane") - 1) / 2 - per_window + 1).cast("long")
    spread = own.withColumn("w", F.explode(F.sequence(first, last)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pane", *STATE))), lambda s: F.struct(*(s[c].alias(c) for c in STATE)))  # at most 2 * per_window + 1
    return spread.groupBy("rec", "w", "topic").agg(lines.alias("lines")).select("rec", "w", "topic", merged(F.col("lines")).alias("state"))


def value(state: Column, reducer: str) -> Column:
    return {
        "mean": state["total"] / state["n"], "min": state["low"], "max": state["high"], "delta": state["last"] - state["first"], "absmax": state["largest"], "drop": state["drop"],
    }[reducer]


def window_vectors(series: DataFrame, pairs: list[tuple[str, str]], size: int, per_window: int, starts: DataFrame, flags: DataFrame) -> DataFrame:
    """(rec, w, x0, ..., mask): the pairs (topic, reducer) of each window, the tracks (rec, first) that start in it and the recording's flag (rec,
    flag), with a digit of mask per value: 0 where the topic has no finite sample in the window (its value is 0 then).

    Windows begin at the multiples of `size` within a recording's samples.
    """
    edges = series.groupBy("rec").agg(F.floor(F.min("t") / F.lit(size)).alias("a"), F.floor(F.max("t") / F.lit(size)).alias("b"))
    windows = edges.select("rec", F.explode(F.sequence("a", "b")).alias("w"))
    topics = sorted({t for t, _ in pairs})
    states = window_states(series.filter(F.col("topic").isin(topics)), size, per_window)
    wide = states.groupBy("rec", "w").agg(*(F.first(F.when(F.col("topic") == t, F.col("state")), ignorenulls=True).alias(f"s_{t}") for t in topics))
    at = F.col("first")
    new = starts.withColumn("w", F.explode(F.sequence(F.ceil(at / F.lit(size)) - per_window, F.floor(at / F.lit(size))))).groupBy("rec", "w").agg(F.count("*").alias("new"))
    all_ = windows.join(wide, ["rec", "w"], "left").join(new, ["rec", "w"], "left").join(flags, "rec", "left")
    values = [F.coalesce(value(F.col(f"s_{t}"), r), F.lit(0.0)) for t, r in pairs] + [F.coalesce("new", F.lit(0)).cast("double"), F.coalesce(F.col("flag").cast("double"), F.lit(0.0))]
    known = [F.col(f"s_{t}").isNotNull() for t, _ in pairs] + [F.lit(True), F.lit(True)]
    mask = F.concat(*(F.when(k, "1").otherwise("0") for k in known))
    return all_.select("rec", "w", *(v.alias(f"x{i}") for i, v in enumerate(values)), mask.alias("mask"))


def standardised(vectors: DataFrame, count: int) -> DataFrame:
    """vectors with (x - mean) / sd * mask in place of x; means and sds over the windows that have the value, one row for all."""
    has = [F.substring("mask", i + 1, 1) == "1" for i in range(count)]
    of = [F.when(h, F.col(f"x{i}")) for i, h in enumerate(has)]
    stats = vectors.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(of)), *(F.stddev_pop(v).alias(f"d{i}") for i, v in enumerate(of)))
    both = vectors.join(F.broadcast(stats))  # one row
    z = [F.when(h, (F.col(f"x{i}") - F.col(f"m{i}")) / (F.col(f"d{i}") + 1e-6)).otherwise(0.0).alias(f"x{i}") for i, h in enumerate(has)]
    return both.select("rec", "w", *z, "mask")
