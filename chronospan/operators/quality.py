"""Log quality: profiles of topics, coverage, stale starts, anomalies, and which robot a log is from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def profile(messages: DataFrame) -> DataFrame:
    """Per (rec, topic) of messages (rec, topic, t, seq, header): n, period (mean gap in seconds), hz, max_gap (s), wide_gaps (over two
    periods), headers (all present), latency_median, latency_p99 (ms), future (share of headers after their log time), max_future (ms)."""
    order = Window.partitionBy("rec", "topic").orderBy("t", "seq")
    gaps = messages.withColumn("gap", (F.lead("t").over(order) - F.col("t")) / SECOND)
    sums = messages.groupBy("rec", "topic").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / SECOND / F.nullif(F.count("*") - 1, F.lit(0))).alias("period"))
    late = (F.col("t") - F.col("header")) / 1000
    out = gaps.join(sums.select("rec", "topic", "n", "period"), ["rec", "topic"]).groupBy("rec", "topic").agg(
        F.first("n").alias("n"), F.first("period").alias("period"), F.max("gap").alias("max_gap"), F.count(F.when(F.col("gap") > 2 * F.col("period"), 1)).alias("wide_gaps"),
        F.bool_and(F.col("header").isNotNull()).alias("headers"), F.percentile(late, 0.5).alias("latency_median"), F.percentile(late, 0.99).alias("latency_p99"),
        F.avg(F.when(late.isNotNull(), (late < 0).cast("double"))).alias("future"), F.greatest(F.lit(0.0), -F.min(late)).alias("max_future"),
    )
    return out.withColumn("hz", F.try_divide(F.lit(1.0), "period"))


def anomalies(p: DataFrame, nominal: dict[str, float], tolerance: float, latency: float) -> Column:
    """Names of the rules that a topic's profile breaks."""
    want = F.try_element_at(F.create_map(*(F.lit(x) for kv in nominal.items() for x in kv)), F.col("topic"))
    return F.array_compact(F.array(
        F.when(want.isNull(), "unprofiled"), F.when(F.abs(F.col("hz") - want) / want > tolerance, "rate"),
        F.when(F.col("max_gap") > F.greatest(F.lit(1.0), 5 * F.col("period")), "gap"), F.when(F.col("latency_median") > latency, "latency"), F.when(F.col("future") > 0.005, "future"),
    ))


def coverage(messages: DataFrame, low: Column, high: Column, wide: int, most: int) -> DataFrame:
    """Per (rec, topic) within [low, high]: n, first, last, and the first `most` gaps over `wide` as 'start:length', comma-joined.

    Gaps are ranked, so that a group lists `most` at most and is never gathered.
    """
    inside = messages.filter(F.col("t").between(low, high))
    order = Window.partitionBy("rec", "topic").orderBy("t", "seq")
    gaps = inside.withColumn("gap", F.lead("t").over(order) - F.col("t"))
    listed = gaps.filter(F.col("gap") > wide).withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "t", "gap"))), lambda g: F.concat(g["t"], F.lit(":"), g["gap"])), ",")
    lists = listed.groupBy("rec", "topic").agg(text.alias("gaps"))
    out = inside.groupBy("rec", "topic").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.join(lists, ["rec", "topic"], "left").withColumn("gaps", F.coalesce("gaps", F.lit("")))


def stale_start(messages: DataFrame, within: int, first: int = 20, early: int = 5, periods: float = 5.0) -> DataFrame:
    """(rec, topic, stale): messages before the first gap over `periods` median periods, where it is among the first ones and ends within
    `within` of the log's start."""
    order = Window.partitionBy("rec", "topic").orderBy("t", "seq")
    rows = messages.withColumn("nr", F.row_number().over(order)).withColumn("after", F.lead("t").over(order))
    rows = rows.withColumn("gap", F.col("after") - F.col("t"))
    period = rows.groupBy("rec", "topic").agg(F.percentile("gap", 0.5).alias("period"), F.count("*").alias("n")).filter("n >= 10")
    begin = messages.groupBy("rec").agg(F.min("t").alias("begin"))
    near = rows.filter((F.col("nr") < first) & F.col("gap").isNotNull()).join(period, ["rec", "topic"]).filter(F.col("gap") > periods * F.col("period"))
    big = near.groupBy("rec", "topic").agg(F.min(F.struct("nr", "after")).alias("g")).join(begin, "rec")
    return big.filter((F.col("g.nr") <= early) & (F.col("g.after") - F.col("begin") < within)).select("rec", "topic", F.col("g.nr").cast("long").alias("stale"))


def recognise(topics: DataFrame, profiles: DataFrame) -> DataFrame:
    """(rec, profile, missing): the profile whose identity topics are all in the log, null unless it is the only one; missing: the least
    number of topics any profile lacks. topics: (rec, topic); profiles: (profile, topic), a few rows."""
    need = profiles.groupBy("profile").agg(F.count("*").alias("need"))
    recs = topics.select("rec").distinct().crossJoin(F.broadcast(need))
    have = topics.distinct().join(F.broadcast(profiles), "topic").groupBy("rec", "profile").agg(F.count("*").alias("have"))
    lack = recs.join(have, ["rec", "profile"], "left").withColumn("lack", F.col("need") - F.coalesce("have", F.lit(0)))
    whole = F.when(F.col("lack") == 0, F.col("profile"))
    return lack.groupBy("rec").agg(F.when(F.count(whole) == 1, F.max(whole)).alias("profile"), F.min("lack").alias("missing"))
