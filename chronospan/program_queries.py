"""Event programs as registered queries: relation trees, coverage, matches, onsets, and what can't be evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import asof, events, program, search
from .operators.program import Relation
from .registry import INSTANCES, SERIES, SPANS, query
from .sources.shared import stored
from .sources.tables import HOUR, messages, series


def _instances(s: DataFrame) -> DataFrame:
    truth = F.when(F.col("y") >= 20, "TRUE").otherwise("UNKNOWN")
    return s.select("rec", F.col("topic").alias("event"), F.col("seq").alias("iid"), F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"), (F.col("t") + HOUR // 2).alias("ext"), truth.alias("truth"), F.col("y").alias("value"))


def _samples(s: DataFrame) -> DataFrame:
    return s.select("rec", F.col("topic").alias("event"), "t", "seq")


RELATIONS = [Relation("AFTER", "purchase", "view", HOUR, 24 * HOUR), Relation("WITHIN", "view", "error", 0, 12 * HOUR, "EXTREMUM_POINT", "START")]
UNEXPRESSIBLE = ("a mood",)


def _covered_sql(row: str, topic: str) -> str:
    return f"""({row}.lo >= l0 AND {row}.hi <= l1 AND ({row}.hi <= {row}.lo OR ({row}.lo >= f0 - 1000000 AND {row}.hi <= f1 + 1000000
        AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.rec = {row}.rec AND w.topic = '{topic}' AND w.g1 > {row}.lo AND w.g0 < {row}.hi))))"""


def _clause_sql(row: str, topic: str, parent: str, nr: int) -> str:
    cov = _covered_sql(row, topic)
    return f"""CASE WHEN {parent} IS NULL THEN 'UNKNOWN' WHEN c{nr} IS NOT NULL THEN t{nr} WHEN f0 IS NOT NULL AND {cov} THEN 'FALSE' ELSE 'UNKNOWN' END AS truth{nr},
        CASE WHEN {parent} IS NULL THEN 'NO_BINDING' WHEN c{nr} IS NOT NULL THEN CASE WHEN t{nr} = 'UNKNOWN' THEN 'CALIBRATION_UNCERTAIN' END
            WHEN f0 IS NULL THEN 'SENSOR_ABSENT_IN_LOG' WHEN NOT {cov} THEN 'OUTSIDE_COVERAGE' END AS reason{nr}"""


TREE = f"""WITH {SERIES}, {INSTANCES}, {SPANS},
    v1 AS (SELECT p.rec, p.iid, p.a, p.b, p.truth AS truth0, c.iid AS c1, c.a AS a1, c.b AS b1, c.e AS e1, c.truth AS t1, p.b + {HOUR} AS lo, p.b + {24 * HOUR} AS hi,
            row_number() OVER (PARTITION BY p.iid ORDER BY (c.truth <> 'TRUE'), c.a, c.iid) AS nr
        FROM inst p LEFT JOIN inst c ON c.rec = p.rec AND c.topic = 'view' AND c.a BETWEEN p.b + {HOUR} AND p.b + {24 * HOUR} WHERE p.topic = 'purchase'),
    w1 AS (SELECT v1.*, {_clause_sql("v1", "view", "v1.iid", 1)} FROM v1 JOIN lg USING (rec) LEFT JOIN f ON f.rec = v1.rec AND f.topic = 'view' WHERE nr = 1),
    v2 AS (SELECT w1.* EXCLUDE (lo, hi, nr), c.iid AS c2, c.a AS a2, c.b AS b2, c.truth AS t2, e1 - {12 * HOUR} AS lo, e1 + {12 * HOUR} AS hi,
            row_number() OVER (PARTITION BY w1.iid ORDER BY (c.truth <> 'TRUE'), abs(c.a - e1), c.iid) AS nr
        FROM w1 LEFT JOIN inst c ON c.rec = w1.rec AND c.topic = 'error' AND c.a BETWEEN e1 - {12 * HOUR} AND e1 + {12 * HOUR}),
    w2 AS (SELECT v2.*, {_clause_sql("v2", "error", "c1", 2)} FROM v2 JOIN lg USING (rec) LEFT JOIN f ON f.rec = v2.rec AND f.topic = 'error' WHERE nr = 1),
    m AS (SELECT *, least(a, coalesce(a1, a), coalesce(a2, a)) AS m0, greatest(b, coalesce(b1, b), coalesce(b2, b)) AS m1,
            CASE WHEN truth1 = 'FALSE' OR truth2 = 'FALSE' THEN 0.0::DOUBLE WHEN truth0 = 'TRUE' AND truth1 = 'TRUE' AND truth2 = 'TRUE' THEN 2.0
                ELSE 1 + 0.99::DOUBLE * ((truth0 = 'TRUE')::INT + (truth1 = 'TRUE')::INT + (truth2 = 'TRUE')::INT) / 3 END AS ordinal FROM w2)"""


def _tree(spark: SparkSession, sf_dir: str, unexpressible: tuple[str, ...] = ()) -> DataFrame:
    s = series(spark, sf_dir)
    return program.bind_tree(_instances(s), program.spans(_samples(s)), "purchase", RELATIONS, unexpressible)


@query(f"""{TREE} SELECT rec, iid, c1 AS view_iid, c2 AS error_iid, truth1 AS view_truth, reason1 AS view_reason, truth2 AS error_truth, reason2 AS error_reason,
    round(ordinal, 6) AS ordinal, ordinal = 2 AS definite FROM m""")
def rel_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c = _tree(spark, sf_dir), F.col("clauses")
    return m.select("rec", "iid", F.col("view.iid").alias("view_iid"), F.col("error.iid").alias("error_iid"), c[1]["truth"].alias("view_truth"), c[1]["reason"].alias("view_reason"), c[2]["truth"].alias("error_truth"), c[2]["reason"].alias("error_reason"), F.round("ordinal", 6).alias("ordinal"), "definite")


@query(f"""{TREE} SELECT rec, iid, c1 AS child, truth1 AS truth, reason1 AS reason FROM w1""")
def rel_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    m = program.bind_tree(_instances(s), program.spans(_samples(s)), "purchase", RELATIONS[:1])
    return m.select("rec", "iid", F.col("view.iid").alias("child"), F.col("clauses")[1]["truth"].alias("truth"), F.col("clauses")[1]["reason"].alias("reason"))


@query(f"{TREE} SELECT rec, iid, m0 AS start, m1 AS \"end\" FROM m")
def mt_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("rec", "iid", "start", "end")


@query(f"""{TREE} SELECT rec, iid, concat_ws(',', 'purchase.START:' || a, 'purchase.END:' || b, 'view.EXTREMUM_POINT:' || e1, 'error.START:' || a2) AS anchors FROM m""")
def mt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _tree(spark, sf_dir)
    found = program.anchors(m, "purchase", [("purchase", "END"), ("purchase", "START"), ("view", "EXTREMUM_POINT"), ("error", "START")])
    return m.select("rec", "iid", F.array_join(F.transform(found, lambda a: F.concat(a["name"], F.lit(":"), a["t"])), ",").alias("anchors"))


@query(f"""{TREE} SELECT rec, iid, CASE WHEN c2 IS NOT NULL THEN 'SPATIAL_CORRIDOR' WHEN c1 IS NOT NULL THEN 'SPATIAL_SECTOR' ELSE 'SPATIAL_NONE' END AS basis FROM m""")
def mt_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = program.weakest_basis({"purchase": "SPATIAL_NONE", "view": "SPATIAL_SECTOR", "error": "SPATIAL_CORRIDOR"})
    return _tree(spark, sf_dir).select("rec", "iid", basis.alias("basis"))


@query(f"""{TREE}, n AS (SELECT rec, bool_and(topic IS NOT NULL) FILTER (WHERE topic IN ('purchase', 'view', 'error')) AND count(DISTINCT topic) FILTER (WHERE topic IN ('purchase', 'view', 'error')) = 3 AS e FROM s GROUP BY rec)
    SELECT m.rec, iid, e AS exhaustive FROM m JOIN n USING (rec)""")
def mt_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    needed = ["purchase", "view", "error"]
    whole = s.filter(F.col("topic").isin(needed)).groupBy("rec").agg((F.count_distinct("topic") == len(needed)).alias("exhaustive"))
    return _tree(spark, sf_dir).select("rec", "iid").join(whole, "rec")


@query(f"""{TREE} SELECT rec, iid, CASE WHEN truth1 = 'FALSE' OR truth2 = 'FALSE' THEN 0.0::DOUBLE
    ELSE round(1 + 0.99::DOUBLE * ((truth0 = 'TRUE')::INT + (truth1 = 'TRUE')::INT + (truth2 = 'TRUE')::INT) / 4, 6) END AS ordinal, 'UNEXPRESSIBLE' AS reason FROM m""")
def kl_unexpressible(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _tree(spark, sf_dir, UNEXPRESSIBLE)
    return m.select("rec", "iid", F.round("ordinal", 6).alias("ordinal"), F.element_at("clauses", -1)["reason"].alias("reason"))


@query(f"""{TREE} SELECT rec, iid, round(ordinal, 6) AS ordinal, m0 AS start, m1 AS "end" FROM m WHERE ordinal > 0""")
def gen_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).filter("ordinal > 0").select("rec", "iid", F.round("ordinal", 6).alias("ordinal"), "start", "end")


SEEDS = f"sd AS (SELECT rec, seq AS sid, t AS s0, t + {4 * HOUR} AS s1, t - {6 * HOUR} AS lo, t + {10 * HOUR} AS hi FROM s WHERE topic = 'click')"
NEAR = f"""{TREE}, {SEEDS},
    k AS (SELECT sd.*, m.iid, m.ordinal, row_number() OVER (PARTITION BY sd.sid ORDER BY m.ordinal DESC, abs(m.a - sd.s1), m.iid) AS nr
        FROM sd LEFT JOIN m ON m.rec = sd.rec AND m.a <= sd.hi AND m.b >= sd.lo),
    h AS (SELECT k.rec, k.sid, k.s0, k.s1, k.iid, k.ordinal, f0, f1, greatest(k.lo, l0) AS lo, least(k.hi, l1) AS hi FROM k JOIN lg USING (rec) LEFT JOIN f ON f.rec = k.rec AND f.topic = 'purchase' WHERE nr = 1),
    c AS (SELECT h.*, coalesce(hi <= lo OR (lo >= f0 - 1000000 AND hi <= f1 + 1000000
            AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.rec = h.rec AND w.topic = 'purchase' AND w.g1 > h.lo AND w.g0 < h.hi)), false) AS cov FROM h),
    best AS (SELECT rec, sid, s0, s1, iid, round(ordinal, 6) AS ordinal,
        CASE WHEN iid IS NULL THEN CASE WHEN f0 IS NOT NULL AND cov THEN 'FALSE' ELSE 'UNKNOWN' END WHEN ordinal >= 2 THEN 'TRUE' WHEN ordinal > 0 THEN 'UNKNOWN' ELSE 'FALSE' END AS truth,
        CASE WHEN iid IS NULL THEN CASE WHEN f0 IS NULL THEN 'SENSOR_ABSENT_IN_LOG' WHEN NOT cov THEN 'OUTSIDE_COVERAGE' END END AS reason FROM c)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    seeds = s.filter("topic = 'click'").select("rec", F.col("seq").alias("sid"), F.col("t").alias("s0"), (F.col("t") + 4 * HOUR).alias("s1"))
    known = program.spans(_samples(s))
    matches = program.bind_tree(_instances(s), known, "purchase", RELATIONS)
    return program.best_near(matches, seeds, "purchase", known, 6 * HOUR).withColumn("ordinal", F.round("ordinal", 6))


@query(f"{NEAR} SELECT * FROM best")
def mt_best_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)


@query(f"{NEAR} SELECT rec, sid, iid, truth <> 'FALSE' AS kept, CASE WHEN truth = 'FALSE' THEN 'predicate_false' END AS filtered, CASE truth WHEN 'TRUE' THEN 2.0 WHEN 'UNKNOWN' THEN coalesce(ordinal, 1.0) ELSE 0.0 END::DOUBLE AS score FROM best")
def rk_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("truth") == "TRUE", 2.0).when(F.col("truth") == "UNKNOWN", F.coalesce("ordinal", F.lit(1.0))).otherwise(0.0)
    return _near(spark, sf_dir).select("rec", "sid", "iid", (F.col("truth") != "FALSE").alias("kept"), F.when(F.col("truth") == "FALSE", "predicate_false").alias("filtered"), score.alias("score"))


@query(f"{NEAR} SELECT coalesce(reason, truth) AS outcome, count(*) AS n FROM best GROUP BY 1")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groupBy(F.coalesce("reason", "truth").alias("outcome")).agg(F.count("*").alias("n"))


DETAIL = """CASE WHEN rec % 3 = 1 THEN 'outside program scope' WHEN bound THEN NULL WHEN iid IS NULL AND truth = 'FALSE' THEN 'no instance near the candidate'
    WHEN iid IS NOT NULL AND ordinal <= 0 THEN 'required clause is FALSE' END"""


@query(f"""{NEAR}, cc AS (SELECT rec, 'b' || iid AS id, true AS bound, iid, ordinal, NULL AS truth FROM m WHERE ordinal > 0 UNION ALL SELECT rec, 's' || sid, false, iid, ordinal, truth FROM best),
    d AS (SELECT rec, id, CASE WHEN rec % 3 <> 1 THEN CASE WHEN bound THEN ordinal WHEN iid IS NULL THEN CASE WHEN truth = 'FALSE' THEN 0.0 ELSE 1.0 END ELSE greatest(ordinal, 0.0) END END AS score, {DETAIL} AS detail FROM cc)
    SELECT rec, id, round(score, 6) AS score, detail, CASE WHEN detail IS NULL THEN row_number() OVER (PARTITION BY detail IS NULL ORDER BY round(score, 6) DESC, id) END AS rank FROM d""")
def rk_predicate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a program generated together with seeds of other generators, over the recordings that the program allows."""
    s = series(spark, sf_dir)
    known = program.spans(_samples(s))
    matches = stored(program.bind_tree(_instances(s), known, "purchase", RELATIONS).select("rec", "iid", "ordinal", "purchase"))
    seeds = s.filter("topic = 'click'").select("rec", F.col("seq").alias("sid"), F.col("t").alias("s0"), (F.col("t") + 4 * HOUR).alias("s1"))
    near = program.best_near(matches, seeds, "purchase", known, 6 * HOUR)
    bound = matches.filter("ordinal > 0").select("rec", F.concat(F.lit("b"), "iid").alias("id"), "ordinal")
    out = stored(program.predicate_ranked(bound, near.withColumn("id", F.concat(F.lit("s"), "sid")), F.col("rec") % 3 != 1).withColumn("score", F.round("score", 6)))
    kept = search.numbered(out.filter("kept"), [F.desc("score"), F.col("id")])
    return kept.union(out.filter("not kept").withColumn("rank", F.lit(None).cast("long"))).drop("kept")


EVENTS = ("purchase", "view", "error")
REASONS = """rs AS (SELECT r.rec, e.event, CASE WHEN r.rec % 7 = 0 AND e.event = 'error' THEN 'NOT_APPLICABLE' WHEN r.rec % 5 = 0 AND e.event = 'view' THEN 'NOT_INDEXED' WHEN (SELECT count(*) FROM s WHERE s.rec = r.rec AND s.topic = e.event) = 0 THEN 'SENSOR_ABSENT_IN_LOG' END AS reason,
    NOT (e.event = 'view' AND r.rec % 4 = 3) AS absence FROM (SELECT DISTINCT rec FROM s) r, (VALUES ('purchase'), ('view'), ('error')) e(event)),
    ex AS (SELECT rec, bool_and(reason IS NULL AND absence) AS exhaustive FROM rs GROUP BY rec)"""


def _reasons(s: DataFrame) -> DataFrame:
    """Per recording and event why it can't be evaluated, by the rules of eligibility, and whether its feature supports claims of absence."""
    counts = s.groupBy("rec").agg(*(F.count(F.when(F.col("topic") == e, 1)).alias(e) for e in EVENTS))
    rows = counts.select("rec", F.explode(F.array(*(F.struct(F.lit(e).alias("event"), F.col(e).alias("n")) for e in EVENTS))).alias("x")).select("rec", "x.event", "x.n")
    facts = rows.select(
        "rec", "event", "n", (~((F.col("rec") % 7 == 0) & (F.col("event") == "error"))).alias("applicable"), (~((F.col("rec") % 5 == 0) & (F.col("event") == "view"))).alias("indexed"),
        (F.col("n") > 0).alias("present"), F.lit(True).alias("tracks"), F.lit(0.0).alias("floor"), F.lit(1.0).alias("threshold"),
    )
    return facts.select("rec", "event", program.eligibility(facts).alias("reason"), (~((F.col("event") == "view") & (F.col("rec") % 4 == 3))).alias("absence"))


@query(f"{TREE}, {REASONS} SELECT m.rec, iid, exhaustive FROM m JOIN ex USING (rec)")
def mt_exhaustive_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return _tree(spark, sf_dir).select("rec", "iid").join(program.exhaustive(_reasons(s), list(EVENTS)), "rec")


@query(f"{TREE}, {REASONS} SELECT (SELECT count(*) FROM m WHERE ordinal > 0) AS candidates, (SELECT count(*) FROM ex WHERE exhaustive) AS exhaustive, (SELECT count(*) FROM ex) AS recordings, CASE WHEN (SELECT bool_and(exhaustive) FROM ex) THEN 'EXHAUSTIVE' ELSE 'PARTIAL' END AS completeness")
def gen_program_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the program's generator says of its own completeness over the scope."""
    n = _tree(spark, sf_dir).filter("ordinal > 0").agg(F.count("*").alias("candidates"))
    ex = program.exhaustive(_reasons(series(spark, sf_dir)), list(EVENTS)).agg(F.count(F.when(F.col("exhaustive"), 1)).alias("exhaustive"), F.count("*").alias("recordings"), F.when(F.bool_and("exhaustive"), "EXHAUSTIVE").otherwise("PARTIAL").alias("completeness"))
    return n.join(F.broadcast(ex))  # one row each


STATUS = """CASE WHEN rec % 17 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN rec % 13 = 0 THEN 'ANSWERED_UNVERIFIED' WHEN n = 0 THEN CASE WHEN whole THEN 'NONE_FOUND_EXHAUSTIVE' ELSE 'INSUFFICIENT_EVIDENCE' END
    WHEN top >= 2 THEN 'ANSWERED' WHEN rec % 2 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERED_PARTIAL' END"""


@query(f"""{NEAR}, st AS (SELECT rec, count(*) FILTER (WHERE truth <> 'FALSE') AS n, max(ordinal) FILTER (WHERE truth <> 'FALSE') AS top,
        bool_and(reason IS NULL) AS whole FROM best GROUP BY rec) SELECT rec, {STATUS} AS status FROM st""")
def status_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer of each recording's search; some runs abstained, some are not verified, some questions ask to abstain without a definite match."""
    live = F.col("truth") != "FALSE"
    st = _near(spark, sf_dir).groupBy("rec").agg(F.count(F.when(live, 1)).alias("n"), F.max(F.when(live, F.col("ordinal"))).alias("top"), F.bool_and(F.col("reason").isNull()).alias("whole"))
    return st.select("rec", program.status(F.col("rec") % 17 == 0, F.col("rec") % 13 != 0, F.col("n"), F.col("top"), F.col("whole"), F.col("rec") % 2 == 0).alias("status"))


@query(f"""WITH {SERIES}, {SPANS},
    x AS (SELECT rec, topic, seq AS wid, t - {6 * HOUR} AS low, t + {6 * HOUR} AS high FROM s),
    h AS (SELECT x.*, f0, f1, greatest(low, l0) AS lo, least(high, l1) AS hi FROM x JOIN lg USING (rec) JOIN f ON f.rec = x.rec AND f.topic = x.topic)
    SELECT rec, topic AS event, wid, coalesce(hi <= lo OR (lo >= f0 - 1000000 AND hi <= f1 + 1000000
        AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.rec = h.rec AND w.topic = h.topic AND w.g1 > h.lo AND w.g0 < h.hi)), false) AS covered FROM h""")
def cov_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(series(spark, sf_dir))
    windows = s.select("rec", "event", F.col("seq").alias("wid"), (F.col("t") - 6 * HOUR).alias("low"), (F.col("t") + 6 * HOUR).alias("high"))
    return program.covered(windows, program.spans(s), hard=True).select("rec", "event", "wid", "covered")


@query(f"""WITH {SERIES}, {INSTANCES}, c AS (SELECT rec, seq, t FROM s WHERE topic = 'view'),
    k AS (SELECT i.rec, i.iid, c.seq AS msg, c.t AS msg_t FROM inst i ASOF JOIN c ON c.rec = i.rec AND i.a >= c.t WHERE i.topic = 'purchase')
    SELECT rec, msg, any_value(msg_t) AS msg_t, count(*) AS cited FROM k GROUP BY rec, msg""")
def mt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    bought = s.filter("topic = 'purchase'").select("rec", F.col("t").alias("t0"), F.col("seq").alias("iid"))
    cited = asof.last_before(bought, s.filter("topic = 'view'"), inclusive=True).filter("found_seq is not null")
    return cited.groupBy("rec", F.col("found_seq").alias("msg")).agg(F.first("found_t").alias("msg_t"), F.count("*").alias("cited"))


@query(f"""WITH {SERIES}, l AS (SELECT DISTINCT rec FROM s), fx AS (SELECT rec, rec % 7 <> 0 AS applicable, rec % 5 <> 0 AS indexed,
        (SELECT count(*) FROM s WHERE s.rec = l.rec AND topic = 'signup') AS n, (SELECT quantile_cont(y, 0.01) FROM s WHERE s.rec = l.rec) AS floor FROM l)
    SELECT rec, CASE WHEN NOT applicable THEN 'NOT_APPLICABLE' WHEN NOT indexed THEN 'NOT_INDEXED' WHEN n = 0 THEN 'SENSOR_ABSENT_IN_LOG'
        WHEN floor > 0.5 THEN 'BELOW_SENSOR_FLOOR' END AS reason FROM fx""")
def ev_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = series(spark, sf_dir).groupBy("rec").agg(F.count(F.when(F.col("topic") == "signup", 1)).alias("n"), F.percentile("y", 0.01).alias("floor"))
    facts = facts.select("rec", "n", "floor", (F.col("rec") % 7 != 0).alias("applicable"), (F.col("rec") % 5 != 0).alias("indexed"), (F.col("n") > 0).alias("present"), F.lit(True).alias("tracks"), F.lit(0.5).alias("threshold"))
    return facts.select("rec", program.eligibility(facts).alias("reason"))


@query(f"""WITH {SERIES}, tr AS (SELECT rec, topic, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY rec, topic),
    b AS (SELECT rec, seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE topic END AS track FROM s WHERE y >= 50)
    SELECT b.rec, b.seq, last_t AS t, CASE WHEN track IS NULL THEN 'NO_BINDING' END AS reason FROM b LEFT JOIN tr ON tr.rec = b.rec AND tr.topic = b.track""")
def ev_track_disappear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    bound = s.filter("y >= 50").select("rec", "seq", F.when(F.col("seq") % 4 != 0, F.col("topic")).alias("topic"))
    return events.disappear(bound, events.tracks(s))


ONSET = f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, seq) AS n, max(t) OVER (PARTITION BY rec) AS t_last,
        avg(y) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN CURRENT ROW AND {24 * HOUR} FOLLOWING) AS ahead FROM s),
    st AS (SELECT *, n - row_number() OVER (PARTITION BY rec, y < 30 ORDER BY n) AS run FROM r),
    runs AS (SELECT rec, min(n) AS na, min(t) AS ta, max(t) AS tb FROM st WHERE y < 30 GROUP BY rec, run HAVING max(t) - min(t) >= {12 * HOUR}),
    ok AS (SELECT rec, n, t, y FROM r WHERE y > 25 AND ahead > 25 AND t + {24 * HOUR} < t_last),
    k AS (SELECT runs.rec, na, ta, min(ok.n) AS nk FROM runs JOIN ok ON ok.rec = runs.rec AND ok.n >= na AND ok.t >= ta + {12 * HOUR} GROUP BY ALL),
    j AS (SELECT k.*, coalesce((SELECT max(r.n) FROM r WHERE r.rec = k.rec AND r.n > k.na AND r.n < k.nk AND r.y <= 5), k.na) + 1 AS nj FROM k),
    o AS (SELECT j.rec, na, least(nj, nk) AS nj, nk FROM j)
    SELECT o.rec, lo.t AS start, hi.t AS sustained, hi.y AS value FROM (SELECT rec, nj, arg_min(nk, na) AS nk FROM o GROUP BY rec, nj) o
        JOIN r lo ON lo.rec = o.rec AND lo.n = o.nj JOIN r hi ON hi.rec = o.rec AND hi.n = o.nk"""


@query(ONSET)
def ev_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.onset(series(spark, sf_dir), below=30.0, above=25.0, least=12 * HOUR, sustain=24 * HOUR, creep=5.0)


@query(ONSET.replace("AS ahead FROM s)", f"AS ahead, avg(y) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN {12 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING) AS ys FROM s)").replace("PARTITION BY rec, y < 30", "PARTITION BY rec, ys < 30").replace("WHERE y < 30", "WHERE ys < 30"))
def ev_onset_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops in the smoothed series, onsets refined on the raw one."""
    around = Window.partitionBy("rec").orderBy("t").rangeBetween(-12 * HOUR, 12 * HOUR)
    both = series(spark, sf_dir).withColumn("raw", F.col("y")).withColumn("y", F.avg("raw").over(around))
    return events.onset(both, below=30.0, above=25.0, least=12 * HOUR, sustain=24 * HOUR, creep=5.0, raw="raw")


SENSORS = {"motion": ("view", "purchase"), "faults": ("error",)}


@query(f"""WITH {SERIES}, m AS (SELECT *, CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN t + {HOUR} ELSE t - ((seq * 7919) % 600) * 1000000 END AS header FROM s),
    c AS (SELECT DISTINCT rec, t AS cutoff FROM s WHERE topic = 'error'),
    w AS (SELECT rec, cutoff, sensor, unnest(CASE sensor WHEN 'motion' THEN ['view', 'purchase'] WHEN 'faults' THEN ['error'] ELSE [NULL] END) AS topic FROM c, (VALUES ('motion'), ('faults'), ('lidar')) x(sensor)),
    a AS (SELECT w.rec, w.topic, w.cutoff, w.sensor, count(m.seq) AS total, count(CASE WHEN m.t < w.cutoff THEN 1 END) AS n,
            count(CASE WHEN m.t < w.cutoff THEN m.header END) AS stamps,
            max(CASE WHEN m.t < w.cutoff AND m.header <= m.t + 25000 THEN {{'h': m.header, 's': -m.seq}} END) AS best
        FROM w LEFT JOIN m ON m.rec = w.rec AND m.topic = w.topic GROUP BY ALL),
    v AS (SELECT rec, sensor, topic, cutoff, -(best.s) AS seq, CASE WHEN topic IS NULL THEN 'NOT_APPLICABLE' WHEN total = 0 THEN 'SENSOR_ABSENT_IN_LOG' WHEN n = 0 THEN 'OUTSIDE_COVERAGE'
            WHEN stamps = 0 THEN 'HEADER_MISSING' WHEN best IS NULL THEN 'CLOCK_INCOMPATIBLE' WHEN cutoff < best.h THEN 'FUTURE_MEASUREMENT'
            WHEN cutoff - best.h > {48 * HOUR} THEN 'STALE' END AS reason FROM a)
    SELECT rec, sensor, topic, cutoff, seq, CASE WHEN reason IS NULL THEN 'TRUE' ELSE 'UNKNOWN' END AS truth, reason FROM v""")
def rc_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = messages(spark, sf_dir)
    cutoffs = own.filter("topic = 'error'").select("rec", F.col("t").alias("cutoff")).distinct()
    return asof.receipt(cutoffs, own, ["motion", "faults", "lidar"], SENSORS, 48 * HOUR)


@query(f"""WITH {SERIES} SELECT rec, seq, least(t, coalesce(CASE WHEN seq % 3 = 0 THEN t - {HOUR} END, t), coalesce(CASE WHEN seq % 5 = 0 THEN t - {2 * HOUR} END, t)) AS cutoff FROM s WHERE topic = 'error'""")
def rc_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).filter("topic = 'error'")
    lows = F.array_compact(F.array(F.when(F.col("seq") % 3 == 0, F.col("t") - HOUR), F.when(F.col("seq") % 5 == 0, F.col("t") - 2 * HOUR)))
    return s.select("rec", "seq", asof.cutoff(F.col("t"), lows).alias("cutoff"))
