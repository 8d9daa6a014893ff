"""Search dataflow: candidates from generators, their rankers, selection, and windows of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def candidate_window(window_id: Column, width: int) -> Column:
    """Struct (rec, start, end) of a window id 'rec@seconds', width in seconds, in microseconds."""
    rec = F.regexp_extract(window_id, "^(.+)@([0-9]+)$", 1)
    start = F.regexp_extract(window_id, "^(.+)@([0-9]+)$", 2).cast("long") * 1_000_000
    return F.struct(rec.alias("rec"), start.alias("start"), (start + width * 1_000_000).alias("end"))


def window_id(rec: Column, second: Column) -> Column:
    """'rec@seconds', the seconds padded to seven digits."""
    return F.concat(rec.cast("string"), F.lit("@"), F.lpad(second.cast("string"), 7, "0"))


def window_of(anchor: Column, first: Column, last: Column, stride: int) -> Column:
    """The window that begins at or next after an anchor, held between the log's first and last window."""
    return F.least(F.greatest(F.ceil(anchor / F.lit(stride)), first), last)


def windows_around(anchor: Column, reach: int, stride: int) -> Column:
    """All windows within `reach` of an anchor, the one of the anchor first."""
    own = F.ceil(anchor / F.lit(stride))
    rest = F.filter(F.sequence(F.ceil((anchor - reach) / F.lit(stride)), F.floor((anchor + reach) / F.lit(stride))), lambda w: w != own)
    return F.concat(F.array(own), rest)


def deduped(ranked: DataFrame, item: str, rank: list[Column]) -> DataFrame:
    """Each item once, where it comes first in rank order, with its new rank (from 1)."""
    firsts = ranked.groupBy(item).agg(F.min(F.struct(*rank)).alias("first"))
    return numbered(firsts, [F.col("first"), F.col(item)]).drop("first")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` from 1 in the given order: rows of a range of the order are counted first, so no task holds them all.

    The ranges are written before they are counted: their bounds are drawn from a sample, and a second run could draw others.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = stored(spread.withColumn("num_part", F.spark_partition_id()).withColumn("num_at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)))
    before = Window.orderBy("num_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = marked.groupBy("num_part").agg(F.count("*").alias("n")).withColumn("num_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row per task
    return marked.join(F.broadcast(firsts), "num_part").withColumn("rank", F.col("num_first") + F.col("num_at") + 1).drop("num_part", "num_at", "num_first")


def selection(quantifier: str) -> list[Column]:
    """Order of all candidates (truth, start, best, id) under a selection: truth first, nothing is cut; without samples (null) last."""
    by = {"ARGMIN": F.asc_nulls_last("best"), "ARGMAX": F.desc_nulls_last("best")}.get(quantifier, F.asc("start"))
    return [F.desc("truth"), by, F.col("id")]


def union_scores(generators: dict[str, DataFrame]) -> DataFrame:
    """(id, first_stage, scores) over generators' (id, score): the first generator's seed wins, every stage's score is kept."""
    parts = [df.select("id", F.lit(i).alias("nr"), F.lit(name).alias("stage"), "score") for i, (name, df) in enumerate(generators.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.min_by("stage", "nr").alias("first_stage"), F.map_from_entries(F.collect_list(F.struct("stage", "score"))).alias("scores"))


def best_of_interval(candidates: DataFrame, series: DataFrame, reducer: str, bucket: int) -> DataFrame:
    """candidates (rec, id, start, end) with best: min or max of y over the samples inside; null without samples."""
    spread = candidates.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    own = series.select("rec", "t", "y", F.floor(F.col("t") / bucket).alias("slot"))
    inside = spread.join(own, ["rec", "slot"]).filter(F.col("t").between(F.col("start"), F.col("end")))
    best = inside.groupBy("rec", "id").agg((F.min("y") if reducer == "min" else F.max("y")).alias("best"))
    return candidates.join(best, ["rec", "id"], "left")


def limit_of(requested: int | None, final: int | None, default: int = 10) -> int:
    """The request's k, else the pipeline's, else the default."""
    return requested or final or default


def l2_normal(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-9)))


def mean_vector(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, vec): the normalised mean of a group's vectors; sums are per place, so no group is gathered."""
    placed = rows.select(*keys, F.posexplode(vec).alias("place", "x")).groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = placed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("v"))
    return whole.select(*keys, l2_normal(F.col("v")).alias(vec))
