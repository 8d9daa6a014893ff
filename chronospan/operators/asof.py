"""As-of operators: rows of one table find their neighbour in time in another by one sort of both, never by a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(points: DataFrame, rows: DataFrame, at: str, keys: tuple[str, ...], carry: tuple[str, ...], first: bool) -> DataFrame:
    """Both tables in one: kind orders points against rows of the same time; found holds a row's values, null for points."""
    fields = F.struct("t", "seq", *carry)
    kind = -1 if first else 1
    left = points.select(*keys, F.col(at).alias("t"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("seq"), F.struct(*points.columns).alias("point"))
    right = rows.select(*keys, "t", F.lit(0).alias("kind"), F.col("seq").cast("long"), fields.alias("found"))
    return left.unionByName(right, allowMissingColumns=True)


def _out(df: DataFrame, points: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return df.filter("kind <> 0").select(*(F.col(f"point.{c}").alias(c) for c in points.columns), *(F.col(f"hit.{c}").alias(f"found_{c}") for c in ("t", "seq", *carry)))


def last_before(points: DataFrame, rows: DataFrame, at: str = "t0", inclusive: bool = False, keys: tuple[str, ...] = ("rec",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Every point with found_t, found_seq and found_<carry> of the last row before its time (inclusive: or at it); null if none."""
    both = _merged(points, rows, at, keys, carry, first=not inclusive)
    past = Window.partitionBy(*keys).orderBy("t", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return _out(both.withColumn("hit", F.last("found", ignorenulls=True).over(past)), points, carry)


def first_after(points: DataFrame, rows: DataFrame, at: str = "t0", inclusive: bool = True, keys: tuple[str, ...] = ("rec",), carry: tuple[str, ...] = ()) -> DataFrame:
    both = _merged(points, rows, at, keys, carry, first=inclusive)
    future = Window.partitionBy(*keys).orderBy("t", "kind", "seq").rowsBetween(0, Window.unboundedFollowing)
    return _out(both.withColumn("hit", F.first("found", ignorenulls=True).over(future)), points, carry)


def nearest(points: DataFrame, rows: DataFrame, at: str = "t0", keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """The closest row in time; the earlier one of two equally close."""
    before = last_before(points, rows, at, inclusive=True, keys=keys)
    renamed = before.withColumnRenamed("found_t", "past_t").withColumnRenamed("found_seq", "past_seq")
    both = first_after(renamed, rows, at, inclusive=True, keys=keys)
    past = F.col("found_t").isNull() | (F.col(at) - F.col("past_t") <= F.col("found_t") - F.col(at))
    pick = lambda c: F.when(past, F.col(f"past_{c}")).otherwise(F.col(f"found_{c}")).alias(f"found_{c}")
    return both.select(*points.columns, pick("t"), pick("seq"))


def causal_last(cutoffs: DataFrame, messages: DataFrame, max_age: int, ahead: int = 25_000, inclusive: bool = False, keys: tuple[str, ...] = ("rec", "topic")) -> DataFrame:
    """Per cutoff (keys, cutoff) the message available by then with the largest valid header; columns seq, truth, reason.

    A header is valid if it is not null and at most `ahead` past its log time. No fallback: an old or future measurement is UNKNOWN.
    """
    valid = F.col("header") <= F.col("t") + ahead
    best = F.when(valid, F.struct(F.col("header").alias("h"), (-F.col("seq")).alias("s")))
    rows = messages.select(*keys, "t", "seq", best.alias("best"), F.col("header").isNotNull().cast("int").alias("stamped"))
    rows = rows.withColumn("kind", F.lit(0))
    points = cutoffs.select(*keys, F.col("cutoff").alias("t"), F.lit(1 if inclusive else -1).alias("kind")).distinct()
    both = points.unionByName(rows, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("t", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    seen = both.select(
        *keys, "t", "kind", F.max("best").over(past).alias("m"), F.count("seq").over(past).alias("n"), F.coalesce(F.sum("stamped").over(past), F.lit(0)).alias("stamps"), F.count("seq").over(whole).alias("total"),
    ).filter("kind <> 0")
    age = F.col("t") - F.col("m.h")
    reason = (
        F.when(F.col("total") == 0, "SENSOR_ABSENT_IN_LOG").when(F.col("n") == 0, "OUTSIDE_COVERAGE").when(F.col("stamps") == 0, "HEADER_MISSING")
        .when(F.col("m").isNull(), "CLOCK_INCOMPATIBLE").when(age < 0, "FUTURE_MEASUREMENT").when(age > max_age, "STALE")
    )
    return seen.select(*keys, F.col("t").alias("cutoff"), (-F.col("m.s")).alias("seq"), F.when(reason.isNull(), "TRUE").otherwise("UNKNOWN").alias("truth"), reason.alias("reason"))


def receipt(cutoffs: DataFrame, messages: DataFrame, sensors: list[str], topics: dict[str, tuple[str, ...]], max_age: int) -> DataFrame:
    """Per cutoff (rec, cutoff), sensor and topic of it the causal_last verdict; a sensor without topics is NOT_APPLICABLE."""
    known = [(s, t) for s in sensors for t in topics.get(s, (None,))]
    pairs = F.array(*(F.struct(F.lit(s).alias("sensor"), F.lit(t).cast("string").alias("topic")) for s, t in known))
    asked = cutoffs.select("rec", "cutoff", F.explode(pairs).alias("p")).select("rec", "cutoff", "p.sensor", "p.topic")
    found = causal_last(asked.filter("topic is not null").select("rec", "topic", "cutoff"), messages, max_age)
    out = asked.join(found, ["rec", "topic", "cutoff"], "left")
    missing = F.col("topic").isNull()
    return out.select("rec", "sensor", "topic", "cutoff", "seq", F.when(missing, "UNKNOWN").otherwise(F.col("truth")).alias("truth"), F.when(missing, "NOT_APPLICABLE").otherwise(F.col("reason")).alias("reason"))


def cutoff(anchor: Column, lows: Column) -> Column:
    """The anchor, lowered to the smallest low end of an uncertainty band."""
    return F.least(anchor, F.coalesce(F.array_min(lows), anchor))
