"""Greedy and ordered operators as registered queries: merging, change episodes, tracks, slowdowns, chunks and their packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search, sequences, sweeps
from .registry import SERIES, query
from .search_queries import CANDIDATES, _candidates
from .sources.tables import HOUR, series

GAP, MOST, GROW = HOUR, 20 * HOUR, 150


@query(f"""WITH RECURSIVE {SERIES}, {CANDIDATES},
    c AS (SELECT rec, id, start AS a, "end" AS b, row_number() OVER (ORDER BY truth DESC, start, id) AS rank FROM cd),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY rank) AS k FROM c),
    f AS (SELECT DISTINCT rec, 0::BIGINT AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, id BIGINT, rank BIGINT)[]) AS g, 0::BIGINT AS j FROM k
        UNION ALL SELECT rec, k, CASE WHEN j > len(g) THEN list_append(g, {{'a': a, 'b': b, 'id': id, 'rank': rank}})
                WHEN rank <= {GROW} THEN list_concat(list_concat(g[1:j - 1], [{{'a': least(g[j].a, a), 'b': greatest(g[j].b, b), 'id': g[j].id, 'rank': g[j].rank}}]), g[j + 1:]) ELSE g END, j
            FROM (SELECT f.rec, k.k, f.g, k.a, k.b, k.id, k.rank, coalesce(list_position(list_transform(f.g, lambda x: NOT (k.a > x.b + {GAP} OR k.b < x.a - {GAP})
                AND CASE WHEN k.rank > {GROW} THEN k.a < x.b AND k.b > x.a ELSE greatest(x.b, k.b) - least(x.a, k.a) <= {MOST} END), true), len(f.g) + 1) AS j
                FROM f JOIN k ON k.rec = f.rec AND k.k = f.k + 1)),
    last AS (SELECT rec, arg_max(g, k) AS g FROM f GROUP BY rec),
    m AS (SELECT k.rec, k.id, f.j, last.g[f.j] AS x FROM f JOIN k ON k.rec = f.rec AND k.k = f.k JOIN last ON last.rec = f.rec),
    w AS (SELECT m.*, count(*) OVER p AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY CAST(id AS VARCHAR)) OVER p AS ids, dense_rank() OVER (ORDER BY x.rank) AS group_rank FROM m
        WINDOW p AS (PARTITION BY rec, j))
    SELECT rec, id, x.id AS leader, x.a AS start, x.b AS "end", n, CASE WHEN n > 1 THEN substr(sha256(ids), 1, 16) END AS merged_id, group_rank FROM w""")
def rk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.numbered(_candidates(spark, sf_dir).select("rec", "id", "start", "end", "truth"), search.selection("ALL"))
    return sequences.merged_results(ranked, GAP, MOST, GROW)


def _change_sql(amount: float, within: int, direction: str | None, relative: bool) -> str:
    falls = {"DOWN": "true", "UP": "false"}.get(direction or "", "y - lo.y >= hi.y - y")
    key = {"DOWN": "y", "UP": "-y"}.get(direction or "", "d")
    scale, fit = ("abs(y)", "abs(y) >= 0.25::DOUBLE * top AND y <> 0") if relative else ("1", "true")
    return f"""WITH RECURSIVE {SERIES}, o AS MATERIALIZED (SELECT rec, t, y, row_number() OVER (PARTITION BY rec ORDER BY t, seq) AS n, max(abs(y)) OVER (PARTITION BY rec) AS top FROM s),
    e AS (SELECT a.rec, a.n, a.t, a.y, a.top, min({{'y': b.y, 'n': b.n, 't': b.t}}) AS lo, max({{'y': b.y, 'n': -b.n, 't': b.t}}) AS hi
        FROM o a LEFT JOIN o b ON b.rec = a.rec AND b.n > a.n AND b.t <= a.t + {within} AND b.y IS NOT NULL GROUP BY ALL),
    d AS (SELECT *, CASE WHEN {falls} THEN y - lo.y ELSE hi.y - y END / {scale} AS d, CASE WHEN {falls} THEN lo.n ELSE -hi.n END AS x, CASE WHEN {falls} THEN lo.t ELSE hi.t END AS xt FROM e),
    q AS MATERIALIZED (SELECT *, coalesce(d >= {amount} AND {fit}, false) AS q, {key} AS key FROM d),
    f AS (SELECT rec, 0::BIGINT AS n, 0::BIGINT AS resume, NULL::BIGINT AS reach, NULL::BIGINT AS last, NULL::STRUCT(key DOUBLE, t BIGINT, d DOUBLE, xt BIGINT, x BIGINT) AS best,
            NULL::STRUCT(key DOUBLE, t BIGINT, d DOUBLE, xt BIGINT, x BIGINT) AS done FROM (SELECT DISTINCT rec FROM q)
        UNION ALL SELECT rec, n, resume, CASE WHEN goes THEN greatest(reach, x) WHEN q AND n >= resume THEN x END, CASE WHEN goes OR (q AND n >= resume) THEN n END,
            CASE WHEN goes AND NOT (key > best.key) THEN best WHEN goes OR (q AND n >= resume) THEN {{'key': key, 't': t, 'd': d, 'xt': xt, 'x': x}} END, CASE WHEN NOT goes THEN best END
        FROM (SELECT f.rec, q.n, q.t, q.d, q.x, q.xt, q.q, q.key, f.best, f.reach, coalesce(f.best IS NOT NULL AND q.q AND q.n <= f.reach, false) AS goes,
                CASE WHEN f.best IS NOT NULL AND NOT coalesce(q.q AND q.n <= f.reach, false) THEN greatest(f.last + 1, f.best.x) ELSE f.resume END AS resume
            FROM f JOIN q ON q.rec = f.rec AND q.n = f.n + 1)),
    out AS (SELECT rec, done AS b FROM f WHERE done IS NOT NULL UNION ALL SELECT rec, arg_max(best, n) FROM (SELECT rec, n, coalesce(best, {{'key': NULL, 't': NULL, 'd': NULL, 'xt': NULL, 'x': NULL}}) AS best FROM f) GROUP BY rec)
    SELECT rec, b.t AS start, b.xt AS "end", round(b.d, 6) AS value FROM out WHERE b.t IS NOT NULL"""


@query(_change_sql(20.0, 72 * HOUR, None, False))
def ev_change_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.change_episodes(series(spark, sf_dir), 20.0, 72 * HOUR).withColumn("value", F.round("value", 6))


@query(_change_sql(0.5, 96 * HOUR, "DOWN", True))
def ev_change_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.change_episodes(series(spark, sf_dir), 0.5, 96 * HOUR, "DOWN", relative=True).withColumn("value", F.round("value", 6))


@query(_change_sql(25.0, 96 * HOUR, "UP", False))
def ev_change_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.change_episodes(series(spark, sf_dir), 25.0, 96 * HOUR, "UP").withColumn("value", F.round("value", 6))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording per event type: a frame per quarter of a day, a box per event; user and value say where it is."""
    s = series(spark, sf_dir)
    x, y = (F.col("rec") % 40).cast("double") * 5, (F.col("seq") % 3).cast("double") * 4
    side = 20.0 + F.least(F.col("y"), F.lit(40.0)) / 4
    return s.filter("y is not null").select(F.col("topic").alias("rec"), (F.floor(F.col("t") / F.lit(6 * HOUR)) * (6 * HOUR)).alias("t"), F.col("seq").alias("nr"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))


@query()
def ag_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.box_tracks(_boxes(spark, sf_dir))


STEP = HOUR


def _slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.baseline(sweeps.resampled(series(spark, sf_dir), STEP), 48 * HOUR, 5)


SLOW = f"""WITH {SERIES}, p AS (SELECT rec, t, y, lead(t) OVER w AS t1, lead(y) OVER w AS y1 FROM s WINDOW w AS (PARTITION BY rec ORDER BY t, seq)),
    x AS (SELECT *, unnest(range(CAST(ceil(t / {STEP}) AS BIGINT), CAST(ceil(t1 / {STEP}) AS BIGINT))) AS g FROM p WHERE t1 > t),
    grid AS MATERIALIZED (SELECT rec, g * {STEP} AS t, y + (y1 - y) * (g * {STEP} - t) / (t1 - t) AS y FROM x),
    b AS MATERIALIZED (SELECT *, CASE WHEN count(y) OVER w >= 5 THEN median(y) OVER w END AS base, min(t) OVER (PARTITION BY rec) AS first, max(t) OVER (PARTITION BY rec) AS last FROM grid
        WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND 1 PRECEDING))"""


@query(f"""{SLOW},
    o AS (SELECT * FROM b WHERE base >= 5 AND t % {4 * HOUR} = 0 AND t >= first + {4 * HOUR} AND t < last - {2 * HOUR}),
    m AS (SELECT o.rec, o.t, o.base, min({{'y': g.y, 't': g.t}}) AS low, count(*) AS n FROM o JOIN grid g ON g.rec = o.rec AND g.t BETWEEN o.t AND o.t + {16 * HOUR} GROUP BY ALL),
    r AS (SELECT m.*, (SELECT min(g.t) FROM grid g WHERE g.rec = m.rec AND g.t BETWEEN m.low.t AND m.low.t + {40 * HOUR} AND g.y >= 0.7::DOUBLE * m.base) AS back FROM m WHERE n >= 2 AND 1 - low.y / base >= 0.4),
    k AS (SELECT *, row_number() OVER (PARTITION BY rec, (low.t + {HOUR}) // {2 * HOUR} ORDER BY t) AS nr FROM r WHERE back IS NOT NULL)
    SELECT rec, t AS onset, low.t AS low, back AS recovery, round(base, 6) AS base, round(1 - low.y / base, 6) AS loss, t - {4 * HOUR} AS start, back + {4 * HOUR} AS "end" FROM k WHERE nr = 1""")
def sw_slowdown_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.slowdowns(_slow(spark, sf_dir), 4 * HOUR, 16 * HOUR, 0.4, 5.0, 0.7, 40 * HOUR, 4 * HOUR, 2 * HOUR, 2 * HOUR, 4 * HOUR)
    return found.withColumn("base", F.round("base", 6)).withColumn("loss", F.round("loss", 6))


LENGTHS = [4 * HOUR, 8 * HOUR, 16 * HOUR]
MANEUVERS = f"""{SLOW}, h AS MATERIALIZED (SELECT *, CAST((t // {STEP}) * 37 % 90 AS DOUBLE) AS h FROM b),
    o AS (SELECT * FROM h WHERE base >= 5 AND t % {2 * HOUR} = 0 AND t >= first + {2 * HOUR} AND t < last - {HOUR}),
    w AS (SELECT o.rec, o.t, o.base, n.n, o.last FROM o, (VALUES {", ".join(f"({n})" for n in LENGTHS)}) n(n) WHERE o.t + n.n <= o.last),
    m AS (SELECT w.rec, w.t, w.base, w.n, 1 - min(g.y) / w.base AS loss, max(g.h) - min(g.h) AS excursion, arg_max(g.h, g.t) - arg_min(g.h, g.t) AS net, count(*) AS c FROM w JOIN h g ON g.rec = w.rec AND g.t BETWEEN w.t AND w.t + w.n GROUP BY w.rec, w.t, w.base, w.n),
    hits AS (SELECT rec, t AS start, t + n AS "end", base, loss, excursion, net FROM m WHERE c >= 2 AND loss >= 0.2 AND loss < 0.9 AND excursion < 80 AND abs(net) >= 10)"""


def _maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _slow(spark, sf_dir).withColumn("h", (F.floor(F.col("t") / F.lit(STEP)) * 37 % 90).cast("double"))
    return sequences.maneuvers(grid, 2 * HOUR, LENGTHS, 2 * HOUR, HOUR, 5.0, (0.2, 0.9), (None, 80.0), 10.0)


@query(f"""{MANEUVERS} SELECT rec, start, "end", round(base, 6) AS base, round(loss, 6) AS loss, excursion, net FROM hits""")
def sw_maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss against the baseline, swing and net turn of every window; the bearing is made from the hour's number."""
    return _maneuvers(spark, sf_dir).withColumn("base", F.round("base", 6)).withColumn("loss", F.round("loss", 6))


@query(f"""{MANEUVERS}, r AS (SELECT *, max("end") OVER (PARTITION BY rec ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM hits),
    u AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached + {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT rec, min(start) AS start, max("end") AS "end", count(*) AS n, round(max(loss), 6) AS loss FROM u GROUP BY rec, run""")
def sw_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _maneuvers(spark, sf_dir).select("rec", "start", "end", "loss")
    return sweeps.merged_stats(hits, HOUR, "loss").withColumn("loss", F.round("loss", 6))


CHUNKS = f"""WITH RECURSIVE {SERIES}, iv AS (SELECT rec, min(t) AS a, max(t) AS b FROM s GROUP BY rec), n AS (SELECT *, greatest(CAST(ceil((b - a) / {30 * HOUR}) AS BIGINT), 1) AS n FROM iv),
    c AS (SELECT rec, a, b, n, unnest(range(n)) AS nr FROM n),
    ch AS MATERIALIZED (SELECT rec, greatest(0, CAST(floor(a + nr * ((b - a) / n) + 0.5) AS BIGINT) - CASE WHEN nr > 0 THEN {2 * HOUR} ELSE 0 END) AS start, CAST(floor(a + (nr + 1) * ((b - a) / n) + 0.5) AS BIGINT) AS "end", nr FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.chunks(series(spark, sf_dir).groupBy("rec").agg(F.min("t").alias("start"), F.max("t").alias("end")), 30 * HOUR, 2 * HOUR)


@query(f"{CHUNKS} SELECT * FROM ch")
def iv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(f"""{CHUNKS}, l AS MATERIALIZED (SELECT *, "end" - start AS w, row_number() OVER (ORDER BY rec, nr) AS i FROM ch WHERE "end" > start),
    f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS job, 0::BIGINT AS used UNION ALL
        SELECT l.i, CASE WHEN f.job = 0 OR f.used + l.w > {150 * HOUR} THEN f.job + 1 ELSE f.job END, CASE WHEN f.job = 0 OR f.used + l.w > {150 * HOUR} THEN l.w ELSE f.used + l.w END FROM f JOIN l ON l.i = f.i + 1)
    SELECT rec, start, "end", nr, job FROM f JOIN l USING (i)""")
def iv_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chunks(spark, sf_dir).filter("`end` > start").withColumn("width", F.col("end") - F.col("start"))
    return sequences.packed_in_order(lines, ["rec", "nr"], "width", 150 * HOUR).drop("width")
