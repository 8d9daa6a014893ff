"""Index plans over a stage graph, observed pipelines, the durable sink and stateful streams as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .plans import index
from .plans.index import Stage
from .registry import SERIES, query
from .search_queries import CANDIDATES, _candidates
from .sources import manifest
from .sources.shared import folder, stored
from .sources.tables import HOUR, series
from .streaming import sessions

STAGES = [
    Stage("decode"),
    Stage("motion", ("decode",), applies="rec % 11 <> 0"),
    Stage("detect", ("decode",), version=2, flag="gpu", adopts="rec % 3 = 0"),
    Stage("fuse", ("motion", "detect"), adopts="rec % 2 = 0"),
]
NUMBER = {s.name: n for n, s in enumerate(STAGES)}


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n")).select("rec", F.concat(F.lit("f"), "n").alias("fingerprint"))


def _artifacts(recs: DataFrame) -> DataFrame:
    """What earlier runs left: for some recordings and stages an old build, for some the right one of decode and motion."""
    old = None
    for n, s in enumerate(STAGES):
        one = recs.filter((F.col("rec") * 7 + n * 3) % 5 > n).select("rec", F.lit(s.name).alias("stage"), F.lit("old").alias("key"), F.concat(F.lit(f"c{n}-"), F.col("rec") % 4).alias("content"), F.lit(1).cast("long").alias("at"))
        old = one if old is None else old.union(one)
    right = recs.filter("rec % 2 = 1").select("rec", F.lit("decode").alias("stage"), index.canonical_key(STAGES[0], F.array().cast("array<string>"), F.col("rec"), F.col("fingerprint")).alias("key"), F.concat(F.lit("d"), F.col("rec") % 3).alias("content"), F.lit(2).cast("long").alias("at"))
    return old.union(right)


def _plan_sql(run: bool, flags: set[str]) -> str:
    steps = []
    for n, s in enumerate(STAGES):
        seen = "art" if n == 0 or not run else f"art{n}"
        inputs = ", ".join(f"i{k}.content" for k in range(len(s.needs)))
        joined = " ".join(f"LEFT JOIN (SELECT rec, arg_max(content, {{'m': made, 'k': key}}) AS content FROM {seen} WHERE stage = '{need}' GROUP BY rec) i{k} ON i{k}.rec = r.rec" for k, need in enumerate(s.needs))
        lacks = " OR ".join(f"i{k}.content IS NULL" for k in range(len(s.needs))) or "false"
        listed = "'[' || " + " || ',' || ".join(f"'\"' || i{k}.content || '\"'" for k in range(len(s.needs))) + " || ']'" if s.needs else "'[]'"
        extra = "''" if s.needs else "fingerprint"
        key = f"""substr(sha256('{{"extra":"' || {extra} || '","inputs":' || {listed} || ',"recording":"' || r.rec || '","stage":"{s.name}","version":{s.version}}}'), 1, 32)"""
        gated = "true" if s.flag and s.flag not in flags else "false"
        steps.append(f"k{n} AS MATERIALIZED (SELECT r.rec, CASE WHEN NOT ({lacks}) THEN {key} END AS key FROM r {joined})")
        steps.append(f"""s{n} AS MATERIALIZED (SELECT rec, '{s.name}' AS stage, key, CASE WHEN key IS NULL THEN 'blocked' WHEN NOT ({s.applies}) THEN 'n/a'
            WHEN EXISTS (SELECT 1 FROM {seen} a WHERE a.rec = k{n}.rec AND a.stage = '{s.name}' AND a.key = k{n}.key) THEN 'built' WHEN {gated} THEN 'gated' WHEN {s.adopts} THEN 'adopted' ELSE 'todo' END AS state FROM k{n})""")
        if run:
            steps.append(f"art{n + 1} AS (SELECT * FROM {seen} UNION ALL SELECT rec, stage, key, substr(sha256('content:' || key), 1, 32), 4611686018427387904 FROM s{n} WHERE state IN ('adopted', 'todo'))")
        assert inputs is not None
    old = " UNION ALL ".join(f"SELECT rec, '{s.name}' AS stage, 'old' AS key, 'c{n}-' || (rec % 4) AS content, 1::BIGINT AS made FROM r WHERE (rec * 7 + {n * 3}) % 5 > {n}" for n, s in enumerate(STAGES))
    return f"""WITH r AS MATERIALIZED (SELECT user_id AS rec, 'f' || count(*) AS fingerprint FROM events GROUP BY user_id),
        art AS MATERIALIZED ({old} UNION ALL SELECT rec, 'decode', substr(sha256('{{"extra":"' || fingerprint || '","inputs":[],"recording":"' || rec || '","stage":"decode","version":1}}'), 1, 32), 'd' || (rec % 3), 2 FROM r WHERE rec % 2 = 1),
        {", ".join(steps)} {" UNION ALL ".join(f"SELECT rec, stage, key, state FROM s{n}" for n in range(len(STAGES)))}"""


@query(_plan_sql(False, set()))
def ix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = stored(_recs(spark, sf_dir))
    return index.graph_plan(recs, STAGES, stored(_artifacts(recs)), set())


@query(_plan_sql(True, {"gpu"}))
def ix_plan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states as a run with the gpu flag meets them: what a stage adopts or builds unblocks the stages after it."""
    recs = stored(_recs(spark, sf_dir))
    return index.graph_plan(recs, STAGES, stored(_artifacts(recs)), {"gpu"}, run=True)


KEPT = 40


@query(f"""WITH {SERIES}, {CANDIDATES}, a AS (SELECT *, rec % 3 = 0 AS off, CASE WHEN score IS NULL THEN 'no_score' WHEN truth < 2 AND score < 20 THEN 'predicate_false' END AS why FROM cd),
    c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE off) AS o, count(*) FILTER (WHERE NOT off) AS n1, count(*) FILTER (WHERE NOT off AND why = 'no_score') AS w1,
        count(*) FILTER (WHERE NOT off AND why = 'predicate_false') AS w2, count(*) FILTER (WHERE NOT off AND why IS NULL) AS n2 FROM a)
    SELECT 'scope' AS stage, n0 AS n_in, n1 AS n_out, o AS out_of_scope, 0 AS no_score, 0 AS predicate_false, 0 AS truncated FROM c
    UNION ALL SELECT 'predicate', n1, n2, 0, w1, w2, 0 FROM c UNION ALL SELECT 'truncate', n2, least(n2, {KEPT}), 0, 0, 0, greatest(n2 - {KEPT}, 0) FROM c""")
def stage_report_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of one search took in, let out, filtered by reason and cut; the numbers are observed while the search itself runs."""
    reasons = ("out_of_scope", "no_score", "predicate_false")

    def counts(why) -> list:
        return [F.count(F.lit(1)).alias("n_in"), *(F.count(F.when(why == r, 1)).alias(r) for r in reasons), F.count(F.when(why.isNull(), 1)).alias("n_out")]

    seen = {name: Observation(name) for name in ("scope", "predicate", "truncate")}
    rows = _candidates(spark, sf_dir).withColumn("why", F.when(F.col("rec") % 3 == 0, "out_of_scope"))
    rows = rows.observe(seen["scope"], *counts(F.col("why"))).filter("why is null")
    rows = rows.withColumn("why", F.when(F.col("score").isNull(), "no_score").when((F.col("truth") < 2) & (F.col("score") < 20), "predicate_false"))
    rows = rows.observe(seen["predicate"], *counts(F.col("why"))).filter("why is null")
    shown = stored(rows.observe(seen["truncate"], F.count(F.lit(1)).alias("n_in")).orderBy(*search.selection("ALL")).limit(KEPT))
    out = []
    for name, observed in seen.items():
        m = observed.get
        n_out = m.get("n_out", min(m["n_in"], KEPT))
        out.append((name, m["n_in"], n_out, *(m.get(r, 0) for r in reasons), m["n_in"] - n_out if name == "truncate" else 0))
    assert shown.columns
    return spark.createDataFrame(out, "stage string, n_in bigint, n_out bigint, out_of_scope bigint, no_score bigint, predicate_false bigint, truncated bigint")


FEATURES = f"SELECT rec, topic, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS day, count(*) AS n, round(avg(y), 6) AS mean FROM s GROUP BY ALL"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("rec", "topic", F.floor(F.col("t") / F.lit(24 * HOUR)).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query(f"WITH {SERIES} {FEATURES}")
def snk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written to the sink, superseded by a second build and read back; a repeated put writes nothing."""
    sink = manifest.Manifest(spark, f"{folder(spark)}/sink-{uuid.uuid4().hex}")
    whole = _features(spark, sf_dir)
    sink.put(whole.filter("n > 1"), "features", "*", "first")
    put = [sink.put(whole, "features", "*", "second"), sink.put(whole, "features", "*", "second")]
    found = sink.read("features")
    if put != [True, False] or not manifest.differences(whole, found, ["rec", "topic", "day"]).isEmpty():
        raise RuntimeError("the sink's data are not what was written")
    return found


@query(f"WITH {SERIES}, k AS (SELECT rec, t, y, topic, seq FROM s) SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t, seq) AS nr, topic, y FROM k")
def snk_timeline_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines written sorted within files by recording and time, and read back with each row's place in its recording."""
    from pyspark.sql import Window

    sink = manifest.Manifest(spark, f"{folder(spark)}/sink-{uuid.uuid4().hex}")
    nr = F.row_number().over(Window.partitionBy("rec").orderBy("t", "seq"))
    lines = series(spark, sf_dir).withColumn("nr", nr).select("rec", "t", "nr", "topic", "y").sortWithinPartitions("rec", "nr")
    sink.put(lines, "timeline", "*", "one")
    return sink.read("timeline")


@query(f"""WITH {SERIES}, o AS (SELECT *, t - lag(t) OVER (PARTITION BY rec ORDER BY t, seq) AS gap FROM s), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t, seq) AS k FROM o)
    SELECT rec, min(t) AS start, max(t) + {24 * HOUR} AS "end", count(*) AS n, round(sum(y), 4) AS total FROM g GROUP BY rec, k""")
def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from a stream of two parts with every fifth row sent twice; the query stops after each part and goes on from its state."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = series(spark, sf_dir).select("rec", F.timestamp_micros("t").alias("ts"), "seq", "y")
    last = rows.agg(F.max("ts")).first()[0]  # one row
    end = spark.createDataFrame([(None, last, None, None)], rows.schema).withColumn("ts", F.col("ts") + F.expr("interval 30 days"))  # moves the watermark past all sessions
    first, second = rows.filter("ts < timestamp'2024-01-16'"), rows.filter("ts >= timestamp'2024-01-16'")
    for part in (first, second, end):
        again = part.filter("seq % 5 = 0")
        part.union(again).write.mode("append").parquet(f"{root}/in")
        sessions.run_available(spark, f"{root}/in", "rec long, ts timestamp, seq long, y double", f"{root}/out", f"{root}/state", "24 hours", "2 days")
    out = spark.read.schema("rec long, start timestamp, `end` timestamp, n long, total double").parquet(f"{root}/out").filter("rec is not null")
    return out.select("rec", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 4).alias("total"))
