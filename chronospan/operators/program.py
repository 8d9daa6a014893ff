"""Event programs: relations bound from a primary event outwards, with coverage deciding between FALSE and UNKNOWN.

instances: (rec, event, iid, start, end, ext, truth, value); series: (rec, event, t, seq), the samples that each event is found in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

SECOND = 1_000_000
DAY = 86_400 * SECOND
POINTS = {"START": "start", "END": "end", "EXTREMUM_POINT": "ext"}
BASES = ("SPATIAL_NONE", "SPATIAL_POINT", "SPATIAL_SECTOR", "SPATIAL_CORRIDOR")  # weakest last


@dataclass(frozen=True)
class Relation:
    kind: str  # AFTER, BEFORE, WITHIN, DURING
    parent: str
    child: str
    least: int = 0
    most: int = 0
    parent_point: str = "END"
    child_point: str = "START"
    required: bool = True


def slots(low: Column, high: Column, size: int = DAY) -> Column:
    """The time buckets that [low, high] touches; none if it is empty."""
    first, last = F.floor(low / size), F.floor(high / size)
    return F.when(low <= high, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Spans:
    """Where samples are: log edges by rec, each event's first and last sample, its gaps over max(1 s, some median periods)."""

    log: DataFrame
    span: DataFrame
    wide: DataFrame


def spans(series: DataFrame, periods: float = 5.0) -> Spans:
    """One scan of the samples: their gaps are written once, and all three tables come from there."""
    order = Window.partitionBy("rec", "event").orderBy("t", "seq")
    gaps = stored(series.select("rec", "event", F.col("t").alias("g0"), F.lead("t").over(order).alias("g1")))
    log = gaps.groupBy("rec").agg(F.min("g0").alias("l0"), F.max("g0").alias("l1"))
    span = stored(gaps.groupBy("rec", "event").agg(F.min("g0").alias("f0"), F.max("g0").alias("f1"), F.percentile(F.col("g1") - F.col("g0"), 0.5).alias("period")))
    limit = F.greatest(F.lit(float(SECOND)), periods * F.coalesce("period", F.lit(0.0)))
    wide = gaps.join(span.select("rec", "event", "period"), ["rec", "event"]).filter(F.col("g1") - F.col("g0") > limit).select("rec", "event", "g0", "g1")
    return Spans(stored(log), span.drop("period"), stored(wide))


def known_spans(samples: DataFrame | Spans) -> Spans:
    return samples if isinstance(samples, Spans) else spans(samples)


def covered(windows: DataFrame, samples: DataFrame | Spans, hard: bool) -> DataFrame:
    """windows (rec, event, wid, low, high, ...) with covered and absent (no sample of the event in the log).

    hard: the log's ends cut a window; else a window beyond them is not covered, as what it waits for may happen later. Inside, samples
    must reach both edges to a second, without a wide gap in between. A window outside the log is covered. Windows meet gaps in buckets.
    """
    known = known_spans(samples)
    w = windows.join(known.log, "rec", "left").join(known.span, ["rec", "event"], "left")
    w = w.withColumn("lo", F.greatest("low", "l0")).withColumn("hi", F.least("high", "l1"))
    cut = known.wide.withColumn("slot", F.explode(slots(F.col("g0"), F.col("g1")))).alias("g")
    spread = w.filter("lo < hi").select("rec", "event", "wid", "lo", "hi", F.explode(slots(F.col("lo"), F.col("hi"))).alias("slot"))
    hit = spread.join(cut, ["rec", "event", "slot"]).filter("g1 > lo and g0 < hi").select("rec", "event", "wid").distinct().withColumn("gap", F.lit(True))
    w = w.join(hit, ["rec", "event", "wid"], "left")
    inside = (F.col("lo") >= F.col("f0") - SECOND) & (F.col("hi") <= F.col("f1") + SECOND) & F.col("gap").isNull()
    fits = F.lit(True) if hard else (F.col("low") >= F.col("l0")) & (F.col("high") <= F.col("l1"))
    verdict = fits & ((F.col("hi") <= F.col("lo")) | inside)
    return w.select(*windows.columns, F.coalesce(verdict, F.lit(False)).alias("covered"), F.col("f0").isNull().alias("absent"))


def breadth_first(primary: str, relations: list[Relation]) -> list[Relation]:
    found, frontier = [], [primary]
    while frontier:
        step = [r for name in frontier for r in relations if r.parent == name]
        found, frontier = found + step, [r.child for r in step]
    return found


def bind_tree(instances: DataFrame, samples: DataFrame | Spans, primary: str, relations: list[Relation], unexpressible: tuple[str, ...] = ()) -> DataFrame:
    """A row per primary instance: rec, iid, a struct per event (null: not bound), clauses (event, truth, reason, required), ordinal,
    definite, and start and end of the match.

    Each child is bound to one parent instance, TRUE ones first, then the earliest (BEFORE: latest, WITHIN: nearest); no child: FALSE where
    the child's samples cover the window, else UNKNOWN. An unbound parent leaves its children UNKNOWN. The bindings are written after each
    relation, so a tree of n relations reads the instances n + 1 times.
    """
    known = known_spans(samples)
    one = F.struct("iid", "start", "end", "ext", "truth", "value")
    bound = instances.filter(F.col("event") == primary).select("rec", "iid", one.alias(primary))
    clause = lambda event, truth, reason, required: F.struct(F.lit(event).alias("event"), truth.alias("truth"), reason.alias("reason"), F.lit(required).alias("required"))
    doubt = lambda truth: F.when(truth == "UNKNOWN", "CALIBRATION_UNCERTAIN")
    bound = bound.withColumn("clauses", F.array(clause(primary, F.col(f"{primary}.truth"), doubt(F.col(f"{primary}.truth")), True)))
    names = [primary]
    for r in breadth_first(primary, relations):
        p = F.col(f"{r.parent}.{POINTS[r.parent_point]}")
        low, high = {
            "AFTER": (p + r.least, p + r.most), "BEFORE": (p - r.most, p - r.least), "WITHIN": (p - r.most, p + r.most),
            "DURING": (F.col(f"{r.parent}.start"), F.col(f"{r.parent}.end")),
        }[r.kind]
        bound = stored(bound)
        asked = bound.withColumn("p", p).withColumn("low", low).withColumn("high", high)
        windows = asked.filter(F.col(r.parent).isNotNull()).select("rec", "iid", "p", "low", "high")
        at = F.col(POINTS[r.child_point])
        children = instances.filter(F.col("event") == r.child).select("rec", at.alias("at"), F.floor(at / DAY).alias("slot"), one.alias("child"))
        met = windows.withColumn("slot", F.explode(slots(F.col("low"), F.col("high")))).join(children, ["rec", "slot"]).filter("at between low and high")
        key = {"BEFORE": -F.col("at"), "WITHIN": F.abs(F.col("at") - F.col("p"))}.get(r.kind, F.col("at"))
        best = F.min(F.struct((F.col("child.truth") != "TRUE").alias("doubt"), key.alias("key"), F.col("child.iid").alias("nr"), "child"))
        picked = met.groupBy("rec", "iid").agg(best.alias("b")).select("rec", "iid", F.col("b.child").alias(r.child))
        seen = covered(asked.withColumn("event", F.lit(r.child)).withColumnRenamed("iid", "wid"), known, hard=False).withColumnRenamed("wid", "iid")
        bound = seen.drop("event", "p", "low", "high").join(picked, ["rec", "iid"], "left")
        child = F.col(r.child)
        truth = F.when(F.col(r.parent).isNull(), "UNKNOWN").when(child.isNotNull(), child["truth"]).when(F.col("covered") & ~F.col("absent"), "FALSE").otherwise("UNKNOWN")
        reason = (
            F.when(F.col(r.parent).isNull(), "NO_BINDING").when(child.isNotNull(), doubt(child["truth"])).when(F.col("absent"), "SENSOR_ABSENT_IN_LOG")
            .when(~F.col("covered"), "OUTSIDE_COVERAGE")
        )
        bound = bound.withColumn("clauses", F.concat("clauses", F.array(clause(r.child, truth, reason, r.required)))).drop("covered", "absent")
        names.append(r.child)
    if unexpressible:
        more = [clause(f"unexpressible[{i}]", F.lit("UNKNOWN"), F.lit("UNEXPRESSIBLE"), True) for i in range(len(unexpressible))]
        bound = bound.withColumn("clauses", F.concat("clauses", F.array(*more)))
    ordinal, definite = kleene_of(F.col("clauses"))
    bound = bound.withColumn("ordinal", ordinal).withColumn("definite", definite)
    return bound.withColumn("start", F.array_min(F.array(*(F.col(f"{n}.start") for n in names)))).withColumn("end", F.array_max(F.array(*(F.col(f"{n}.end") for n in names))))


def kleene_of(clauses: Column) -> tuple[Column, Column]:
    """(ordinal, definite) of the required clauses: 0 if one is FALSE, 2 and definite if all are TRUE, else 1 + 0.99 * share of TRUE."""
    required = F.filter(clauses, lambda c: c["required"])
    n_true = F.size(F.filter(required, lambda c: c["truth"] == "TRUE"))
    whole = n_true == F.size(required)
    ordinal = F.when(F.exists(required, lambda c: c["truth"] == "FALSE"), 0.0).when(whole, 2.0).otherwise(1 + 0.99 * n_true / F.greatest(F.size(required), F.lit(1)))
    return ordinal, ~F.exists(required, lambda c: c["truth"] == "FALSE") & whole


def anchors(bound: DataFrame, primary: str, requested: list[tuple[str, str]]) -> Column:
    """Anchors (name, t) of bound events, the primary's START first, each once."""
    wanted = [(primary, "START"), *(a for a in requested if a != (primary, "START"))]
    made = [F.when(F.col(e).isNotNull(), F.struct(F.lit(f"{e}.{point}").alias("name"), F.col(f"{e}.{POINTS[point]}").alias("t"))) for e, point in wanted]
    return F.array_compact(F.array(*made))


def weakest_basis(basis: dict[str, str]) -> Column:
    """The last of BASES among the bound events' bases."""
    ranks = [F.when(F.col(e).isNotNull(), F.lit(BASES.index(b))) for e, b in basis.items()]
    return F.element_at(F.array(*map(F.lit, BASES)), F.coalesce(F.array_max(F.array(*ranks)), F.lit(0)) + 1)


def best_near(matches: DataFrame, seeds: DataFrame, primary: str, samples: DataFrame | Spans, slack: int) -> DataFrame:
    """Every seed (rec, sid, s0, s1) with the best match whose primary overlaps [s0 - slack, s1 + slack]: iid and ordinal, truth, reason.

    Best: highest ordinal, then the primary nearest to the seed's end. No primary near: FALSE where covered, else UNKNOWN.
    """
    own = seeds.withColumn("low", F.col("s0") - slack).withColumn("high", F.col("s1") + slack)
    spread = own.withColumn("slot", F.explode(slots(F.col("low"), F.col("high"))))
    p = matches.select("rec", "iid", "ordinal", F.col(f"{primary}.start").alias("a"), F.col(f"{primary}.end").alias("b"))
    p = p.withColumn("slot", F.explode(slots(F.col("a"), F.col("b"))))
    met = spread.join(p, ["rec", "slot"]).filter("a <= high and b >= low")
    pick = F.min(F.struct((-F.col("ordinal")).alias("o"), F.abs(F.col("a") - F.col("s1")).alias("away"), "iid"))
    best = met.groupBy("rec", "sid").agg(pick.alias("m")).select("rec", "sid", F.col("m.iid").alias("iid"), (-F.col("m.o")).alias("ordinal"))
    seen = covered(own.select("rec", F.lit(primary).alias("event"), F.col("sid").alias("wid"), "low", "high"), samples, hard=True).select("rec", F.col("wid").alias("sid"), "covered", "absent")
    out = own.join(best, ["rec", "sid"], "left").join(seen, ["rec", "sid"])
    none = F.when(F.col("absent"), "UNKNOWN").when(F.col("covered"), "FALSE").otherwise("UNKNOWN")
    truth = F.when(F.col("iid").isNull(), none).when(F.col("ordinal") >= 2, "TRUE").when(F.col("ordinal") > 0, "UNKNOWN").otherwise("FALSE")
    reason = F.when(F.col("iid").isNull(), F.when(F.col("absent"), "SENSOR_ABSENT_IN_LOG").when(~F.col("covered"), "OUTSIDE_COVERAGE"))
    return out.select(*seeds.columns, "iid", "ordinal", truth.alias("truth"), reason.alias("reason"))


def eligibility(facts: DataFrame) -> Column:
    """The first reason why an event can't be evaluated on a log, null if it can; facts: booleans applicable, indexed, present, tracks, and n, floor."""
    return (
        F.when(~F.col("applicable"), "NOT_APPLICABLE").when(~F.col("indexed"), "NOT_INDEXED").when(~F.col("present"), "SENSOR_ABSENT_IN_LOG")
        .when(~F.col("tracks"), "NOT_INDEXED").when(F.col("n") == 0, "NOT_INDEXED").when(F.col("floor") > F.col("threshold"), "BELOW_SENSOR_FLOOR")
    )


def status(abstained: Column, verified: Column, n: Column, top: Column, exhaustive: Column, definite_only: Column) -> Column:
    """The answer's status: abstained runs first, then unverified ones, then no result, then by the best result's ordinal."""
    none = F.when(exhaustive, "NONE_FOUND_EXHAUSTIVE").otherwise("INSUFFICIENT_EVIDENCE")
    return (
        F.when(abstained, "INSUFFICIENT_EVIDENCE").when(~verified, "ANSWERED_UNVERIFIED").when(n == 0, none).when(top >= 2, "ANSWERED").when(definite_only, "INSUFFICIENT_EVIDENCE")
        .otherwise("ANSWERED_PARTIAL")
    )


def predicate_ranked(bound: DataFrame, near: DataFrame, allowed: Column) -> DataFrame:
    """(rec, id, score, detail, kept) of a ranker's candidates: bound (rec, id, ordinal) come with a match and keep its ordinal, near (rec, id, iid,
    ordinal, truth) as of best_near. Filtered are candidates outside the program's scope and those with a required clause FALSE."""
    outside = F.when(~allowed, "outside program scope")
    a = bound.select("rec", "id", F.when(allowed, F.col("ordinal")).alias("score"), outside.alias("detail"))
    none, false = F.col("iid").isNull(), F.col("truth") == "FALSE"
    detail = outside.when(none & false, "no instance near the candidate").when(~none & (F.col("ordinal") <= 0), "required clause is FALSE")
    score = F.when(allowed, F.when(none, F.when(false, 0.0).otherwise(1.0)).otherwise(F.greatest("ordinal", F.lit(0.0))))
    return a.union(near.select("rec", "id", score.alias("score"), detail.alias("detail"))).withColumn("kept", F.col("detail").isNull())


def exhaustive(reasons: DataFrame, events: list[str], unexpressible: tuple[str, ...] = ()) -> DataFrame:
    """(rec, exhaustive) of reasons (rec, event, reason, absence): whether absence of a match can be claimed on a recording: every event of the
    program can be evaluated, supports claims of absence, and no clause is unexpressible."""
    good = F.col("event").isin(events) & F.col("reason").isNull() & F.col("absence")
    return reasons.groupBy("rec").agg(((F.count_distinct(F.when(good, F.col("event"))) == len(events)) & F.lit(not unexpressible)).alias("exhaustive"))
