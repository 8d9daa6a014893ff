"""Ranking and agreement metrics over (group, id, score, grade); a grade of 2 or more is positive, null is unjudged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import running


def first_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each grp in the given order, with their rank r; tasks keep k rows of a group before any row moves."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("r") <= k)


def _by_score() -> list[Column]:
    return [F.desc("score"), F.col("id")]


def ranked(rows: DataFrame) -> DataFrame:
    """rows (grp, id, score, grade, ...) with their rank r in the group by falling score and the positives up to it (hits); ranges of the whole
    order are counted first, so no task sorts a group."""
    positive = F.coalesce((F.col("grade") >= 2).cast("long"), F.lit(0).cast("long"))
    lines = running(rows.withColumn("rank_p", positive).withColumn("rank_s", -F.col("score")), ["grp", "rank_s", "id"], "rank_p")
    firsts = lines.groupBy("grp").agg(F.min("rank").alias("r0"), F.min(F.col("upto") - F.col("rank_p")).alias("h0"))
    out = lines.join(firsts, "grp").withColumn("r", F.col("rank") - F.col("r0") + 1).withColumn("hits", F.col("upto") - F.col("h0"))
    return out.select(*rows.columns, "r", "hits", F.col("rank_p").alias("positive"))


def ndcg(rows: DataFrame, k: int) -> DataFrame:
    """(grp, ndcg): unjudged rows are left out; gains 2^grade - 1, discount log2(rank + 1); 0 without gain. k rows of a group count."""
    judged = rows.filter("grade is not null")
    gain = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1.0))
    found = first_k(judged, k, _by_score()).groupBy("grp").agg(gain.alias("d"))
    best = first_k(judged, k, [F.desc("grade"), F.col("id")]).groupBy("grp").agg(gain.alias("m"))
    return best.join(found, "grp").select("grp", F.round(F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(0.0), 6).alias("ndcg"))


def ndcg_or_null(rows: DataFrame, k: int, unjudged_as_zero: bool) -> DataFrame:
    """As ndcg, with null for a group without a grade of 1 or more; unjudged_as_zero: rows without a grade keep their rank and gain nothing."""
    gain = F.sum((F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("r") + 1.0))
    judged = rows.filter("grade is not null")
    found = first_k(rows if unjudged_as_zero else judged, k, _by_score()).groupBy("grp").agg(gain.alias("d"))
    best = first_k(judged, k, [F.desc("grade"), F.col("id")]).groupBy("grp").agg(gain.alias("m"))
    both = rows.select("grp").distinct().join(best, "grp", "left").join(found, "grp", "left")
    return both.select("grp", F.when(F.col("m") > 0, F.round(F.coalesce("d", F.lit(0.0)) / F.col("m"), 6)).alias("ndcg"))


def recall(rows: DataFrame, k: int) -> DataFrame:
    """(grp, recall): share of positives among the first k judged rows."""
    judged, positive = rows.filter("grade is not null"), (F.col("grade") >= 2).cast("long")
    hits = first_k(judged, k, _by_score()).groupBy("grp").agg(F.sum(positive).alias("hit"))
    every = judged.groupBy("grp").agg(F.sum(positive).alias("all"))
    return every.join(hits, "grp").select("grp", F.round(F.try_divide(F.col("hit").cast("double"), F.col("all").cast("double")), 6).alias("recall"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """(grp, auc): wins of positives over negatives plus half the ties, by summed average ranks; null with one class only.

    Equal scores are counted before ranking, so a group's sort holds distinct scores only.
    """
    positive = (F.col("grade") >= 2).cast("long")
    cells = rows.filter("grade is not null").groupBy("grp", "score").agg(F.sum(positive).alias("p"), F.count("*").alias("c"))
    below = Window.partitionBy("grp").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("n", F.col("c") - F.col("p")).withColumn("less", F.coalesce(F.sum("n").over(below), F.lit(0)))
    out = cells.groupBy("grp").agg(F.sum(F.col("p") * (F.col("less") + F.col("n") / 2.0)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select("grp", F.round(F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n")), 6).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    out = ranked(rows.filter("grade is not null"))
    return out.groupBy("grp").agg(F.round(F.try_divide(F.sum(F.col("positive") * F.col("hits") / F.col("r")), F.sum("positive").cast("double")), 6).alias("ap"))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row (n, exact, kappa) over (a, b) grades; margins come from one count per pair of grades."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("e"))
    both = total.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("exact"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def judged(rows: DataFrame, k: int) -> DataFrame:
    """(grp, judged): share of the first k rows with a grade."""
    return first_k(rows, k, _by_score()).groupBy("grp").agg(F.round(F.avg(F.col("grade").isNotNull().cast("double")), 6).alias("judged"))


def positions(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (grp, id) with score: minus the position (from 0) in ranked (grp, id, r), minus the group's number of ranked rows if absent."""
    n = ranked.groupBy("grp").agg(F.count("*").alias("n"))
    out = wanted.join(ranked.select("grp", "id", "r"), ["grp", "id"], "left").join(n, "grp", "left")
    return out.select("grp", "id", (-F.coalesce(F.col("r") - 1, F.col("n"), F.lit(0))).cast("long").alias("score"))


def two_level(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, mean): the mean over inner groups of their means."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.round(F.avg("m"), 6).alias("mean"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p50, p95): the median, and the value at index min(n - 1, int(0.95 n)) in order, from counts of distinct values."""
    cells = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return cells.withColumn("upto", upto).join(n, group).filter(F.col("upto") > at).groupBy(group).agg(F.first("p50").alias("p50"), F.min(value).alias("p95"))


def hubness(hits: DataFrame) -> DataFrame:
    """One row (busiest, items) of hits (probe, item): the most probes that one item answers, and the distinct items."""
    return hits.groupBy("item").agg(F.count("*").alias("c")).agg(F.max("c").alias("busiest"), F.count("*").alias("items"))


def bootstrap(values: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """One row (mean, low, high): the mean over group keys (key, v) and the 2.5 and 97.5 % points of its resamples.

    Draws with replacement by Poisson(1) weights from a hash of (replicate, key): each row is weighed where it is, and only sums move.
    """
    u = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "key", "b", F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(1_000_003)) / 1_000_003.0
    bounds = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)  # Poisson(1), cumulated
    weight = sum((u >= x).cast("int") for x in bounds)
    drawn = values.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w").cast("double")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return values.agg(F.avg("v").alias("mean")).crossJoin(F.broadcast(ends))  # one row each


def agreement(pairs: DataFrame, positive: int = 1) -> DataFrame:
    """One row (n, exact, within_one, binary) over grades (a, b)."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    same = (F.col("a") >= positive) == (F.col("b") >= positive)
    return pairs.agg(F.count("*").alias("n"), share(F.col("a") == F.col("b")).alias("exact"), share(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"), share(same).alias("binary"))


def set_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grp, precision, recall, jaccard) of two sets of (grp, item)."""
    both = left.select("grp", "item", F.lit(1).alias("l")).distinct().join(right.select("grp", "item", F.lit(1).alias("r")).distinct(), ["grp", "item"], "full")
    n = both.groupBy("grp").agg(F.sum(F.col("l") * F.col("r")).alias("both"), F.sum("l").alias("nl"), F.sum("r").alias("nr"), F.count("*").alias("any"))
    part = lambda d: F.round(F.coalesce(F.try_divide(F.coalesce("both", F.lit(0)).cast("double"), F.col(d).cast("double")), F.lit(0.0)), 6)
    return n.select("grp", part("nl").alias("precision"), part("nr").alias("recall"), part("any").alias("jaccard"))
