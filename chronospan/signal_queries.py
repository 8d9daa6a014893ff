"""Window signals, gait and grid clusters as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clusters, gait, signals
from .registry import SERIES, query
from .sources.tables import HOUR, series, table

PANE, PER = 12 * HOUR, 4
REDUCERS = ("mean", "min", "max", "delta", "drop", "absmax")
PAIRS = [(t, r) for t in ("view", "click", "purchase") for r in REDUCERS] + [("error", "max"), ("signup", "mean"), ("view2", "min")]


def _window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    starts = s.groupBy("rec", "topic").agg(F.min("t").alias("first")).select("rec", "first")
    flags = s.select("rec", (F.col("rec") % 2).alias("flag")).distinct()
    return signals.window_vectors(s, PAIRS, PANE, PER, starts, flags)


_REDUCED = {"mean": "avg(y)", "min": "min(y)", "max": "max(y)", "delta": "arg_max(y, {'t': t, 's': seq}) - arg_min(y, {'t': t, 's': seq})", "absmax": "max(abs(y))", "drop": "max(gone)"}
VECTORS = f"""WITH {SERIES}, ed AS (SELECT rec, CAST(floor(min(t) / {PANE}) AS BIGINT) AS a, CAST(floor(max(t) / {PANE}) AS BIGINT) AS b FROM s GROUP BY rec),
    wn AS MATERIALIZED (SELECT rec, unnest(range(a, b + 1)) AS w FROM ed),
    i AS MATERIALIZED (SELECT wn.rec, w, topic, t, seq, y, max(y) OVER (PARTITION BY wn.rec, w, topic ORDER BY t, seq) - y AS gone FROM wn JOIN s ON s.rec = wn.rec AND s.t BETWEEN w * {PANE} AND (w + {PER}) * {PANE} WHERE y IS NOT NULL),
    g AS MATERIALIZED (SELECT rec, w, topic, {", ".join(f"{sql} AS v_{r}" for r, sql in _REDUCED.items())} FROM i GROUP BY rec, w, topic),
    tr AS (SELECT rec, topic, min(t) AS first FROM s GROUP BY rec, topic), nw AS (SELECT wn.rec, w, count(*) AS n FROM wn JOIN tr ON tr.rec = wn.rec AND first BETWEEN w * {PANE} AND (w + {PER}) * {PANE} GROUP BY wn.rec, w),
    p AS (SELECT rec, w, {", ".join(f"max(v_{r}) FILTER (WHERE topic = '{t}') AS p{i}" for i, (t, r) in enumerate(PAIRS))} FROM g GROUP BY rec, w),
    v AS (SELECT wn.rec, wn.w, {", ".join(f"coalesce(p{i}, 0.0) AS x{i}" for i in range(len(PAIRS)))}, coalesce(nw.n, 0)::DOUBLE AS x{len(PAIRS)}, (wn.rec % 2)::DOUBLE AS x{len(PAIRS) + 1},
        concat({", ".join(f"CASE WHEN p{i} IS NULL THEN '0' ELSE '1' END" for i in range(len(PAIRS)))}, '11') AS mask FROM wn LEFT JOIN p USING (rec, w) LEFT JOIN nw USING (rec, w))"""
_ALL = range(len(PAIRS) + 2)


@query(f"{VECTORS} SELECT rec, w, {', '.join(f'round(x{i}, 5) AS x{i}' for i in _ALL)}, mask FROM v")
def ag_window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_vectors(spark, sf_dir).withColumns({f"x{i}": F.round(f"x{i}", 5) for i in _ALL})


@query(f"""{VECTORS}, st AS (SELECT {", ".join(f"avg(x{i}) FILTER (WHERE mask[{i + 1}] = '1') AS m{i}, stddev_pop(x{i}) FILTER (WHERE mask[{i + 1}] = '1') AS d{i}" for i in _ALL)} FROM v)
    SELECT rec, w, {", ".join(f"round(CASE WHEN mask[{i + 1}] = '1' THEN (x{i} - m{i}) / (d{i} + 1e-6::DOUBLE) ELSE 0.0 END, 4) AS x{i}" for i in _ALL)}, mask FROM v, st""")
def ag_standardised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.standardised(_window_vectors(spark, sf_dir), len(PAIRS) + 2).withColumns({f"x{i}": F.round(f"x{i}", 4) for i in _ALL})


UNIT = 25.0 * HOUR  # taken as a second, so that the tables' month holds several windows


def _by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording per event type."""
    return series(spark, sf_dir).select(F.col("topic").alias("rec"), "t", "y", "seq")


@query()
def ag_gait(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _by_topic(spark, sf_dir)
    return gait.gait(gait.regular(s, UNIT))


@query(f"""WITH {SERIES}, a AS (SELECT s.rec, s.seq, s.t, s.y, 3600000000.0::DOUBLE * (6 + s.rec % 5 * 12) / 2 AS h FROM s)
    SELECT a.rec, a.seq, round(avg(b.y), 6) AS smooth FROM a LEFT JOIN s b ON b.rec = a.rec AND b.t BETWEEN a.t - h AND a.t + h GROUP BY a.rec, a.seq""")
def w_synchronous_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over each recording's own period; here the period follows from the recording's number, five times in six."""
    s = series(spark, sf_dir)
    own = s.filter("rec % 5 > 0").select("rec", (F.lit(float(HOUR)) * (6 + F.col("rec") % 5 * 12)).alias("period")).distinct()
    return gait.synchronous_mean(s, own, 6.0 * HOUR).select("rec", "seq", F.round("smooth", 6).alias("smooth"))


@query("""WITH RECURSIVE p AS (SELECT label AS scan, vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y FROM embeddings),
    q AS (SELECT *, CAST(floor(x / 0.25::DOUBLE) AS BIGINT) AS i, CAST(floor(y / 0.25::DOUBLE) AS BIGINT) AS j FROM p),
    c AS MATERIALIZED (SELECT DISTINCT scan, i, j, scan || ':' || i || ':' || j AS name FROM q),
    e AS MATERIALIZED (SELECT a.name AS a, b.name AS b FROM c a JOIN c b ON a.scan = b.scan AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
    r AS (SELECT name AS a, name AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    l AS (SELECT a AS name, min(b) AS label FROM r GROUP BY a),
    g AS (SELECT q.scan, label, count(*) AS points, min(sqrt(x * x + y * y)) AS range, degrees(atan2(avg(y), avg(x))) AS bearing, greatest(max(x) - min(x), max(y) - min(y)) AS extent
        FROM q JOIN c ON c.scan = q.scan AND c.i = q.i AND c.j = q.j JOIN l ON l.name = c.name GROUP BY q.scan, label)
    SELECT scan, label, points, round(range, 4) AS range, round(bearing, 4) AS bearing, round(extent, 4) AS extent FROM g WHERE points >= 6""")
def vw_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), (e[0].cast("double") * 10).alias("x"), (e[1].cast("double") * 10).alias("y"))
    found = clusters.point_clusters(points, 0.25, 6, tile=8)
    return found.withColumns({c: F.round(c, 4) for c in ("range", "bearing", "extent")})
