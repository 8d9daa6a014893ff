"""Timelines, trailing reductions, log quality and sweeps as registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import trailing
from .operators import quality, sweeps
from .registry import SERIES, query
from .sources.tables import HOUR, messages, series, table

ORDINALS = "o AS (SELECT *, row_number() OVER (PARTITION BY rec, topic ORDER BY t, seq) - 1 AS ordinal FROM s)"
MESSAGES = f"""m AS (SELECT *, CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN t + {HOUR} ELSE t - ((seq * 7919) % 600) * 1000000 END AS header FROM s)"""


def _ordinals(s: DataFrame) -> DataFrame:
    return s.withColumn("ordinal", (F.row_number().over(Window.partitionBy("rec", "topic").orderBy("t", "seq")) - 1).cast("long"))


@query(f"WITH {SERIES} SELECT p.seq AS pid, r.seq FROM s p JOIN s r ON r.rec = p.rec AND r.t BETWEEN p.t AND p.t + {12 * HOUR} WHERE p.topic = 'purchase'")
def tl_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, wide = series(spark, sf_dir), 12 * HOUR
    p = s.filter("topic = 'purchase'").select("rec", F.col("seq").alias("pid"), F.col("t").alias("t0"))
    p = p.withColumn("slot", F.explode(F.sequence(F.floor(F.col("t0") / F.lit(wide)), F.floor((F.col("t0") + wide) / F.lit(wide)))))
    return p.join(s.withColumn("slot", F.floor(F.col("t") / F.lit(wide))), ["rec", "slot"]).filter(F.col("t").between(F.col("t0"), F.col("t0") + wide)).select("pid", "seq")


@query(f"WITH {SERIES}, {ORDINALS}, q AS (SELECT rec, topic, seq, seq % 20 AS ordinal FROM s) SELECT q.seq, o.t, o.seq IS NULL AS missing FROM q LEFT JOIN o USING (rec, topic, ordinal)")
def tl_index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    asked = s.select("rec", "topic", "seq", (F.col("seq") % 20).alias("ordinal"))
    found = asked.join(_ordinals(s).select("rec", "topic", "ordinal", "t"), ["rec", "topic", "ordinal"], "left")
    return found.select("seq", "t", F.col("t").isNull().alias("missing"))


@query(f"WITH {SERIES}, {ORDINALS} SELECT seq, rec || '/' || topic || '#' || ordinal AS mid, CAST(rec AS VARCHAR) AS rec, '/' || topic AS topic, ordinal FROM o")
def tl_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ordinals(series(spark, sf_dir)).select("seq", F.concat("rec", F.lit("/"), "topic", F.lit("#"), "ordinal").alias("mid"))
    part = lambda i: F.regexp_extract("mid", "^([^/]+)(/.*)#([0-9]+)$", i)
    return o.select("seq", "mid", part(1).alias("rec"), part(2).alias("topic"), part(3).cast("long").alias("ordinal"))


def millis(seconds: Column) -> Column:
    """Seconds (or milliseconds) to three decimals as SQL's double arithmetic gives them: the product is rounded, so half a millisecond goes where the product
    lies; F.round(x, 3) rounds the shortest decimal of x instead."""
    return F.round(seconds * 1e3) / 1e3


@query(f"WITH {SERIES}, b AS (SELECT rec, min(t) AS t0 FROM s GROUP BY rec) SELECT seq, round((t - t0) / 1e6, 3) AS rel, t0 + CAST(round(round((t - t0) / 1e6, 3) * 1e6) AS BIGINT) AS back FROM s JOIN b USING (rec)")
def tl_rel_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    rel = s.join(s.groupBy("rec").agg(F.min("t").alias("t0")), "rec").withColumn("rel", millis((F.col("t") - F.col("t0")) / 1e6))
    return rel.select("seq", "rel", (F.col("t0") + F.round(F.col("rel") * 1e6).cast("long")).alias("back"))


@query("""WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS claim FROM documents), h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN reverse(claim) ELSE claim END AS claim FROM c)
    SELECT d.doc_id, sha256(coalesce(d.text, '')) = h.claim AS ok FROM documents d JOIN h USING (doc_id)""")
def ev_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    claims = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.reverse("own")).otherwise(F.col("own")).alias("claim"))
    return docs.join(claims, "doc_id").select("doc_id", (F.col("own") == F.col("claim")).alias("ok"))


@query(f"""WITH {SERIES}, {MESSAGES}, r AS (SELECT rec, topic, seq, t, md5(CAST(y AS VARCHAR)) AS h FROM s WHERE seq % 50 <> 0 UNION ALL SELECT rec, topic, -seq, t, 'new' FROM s WHERE seq % 70 = 0),
    w AS (SELECT rec, topic, seq, md5(CAST(y AS VARCHAR)) AS h FROM s)
    SELECT coalesce(w.seq, r.seq) AS seq, CASE WHEN r.seq IS NULL THEN 'missing' WHEN w.seq IS NULL THEN 'extra' ELSE 'same' END AS state FROM w FULL JOIN r ON w.seq = r.seq WHERE w.h IS DISTINCT FROM r.h""")
def snk_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer check of a written timeline against its source: only rows that differ come back."""
    s = series(spark, sf_dir)
    source = s.select("seq", F.md5(F.col("y").cast("string")).alias("want"))
    kept = source.filter("seq % 50 <> 0").select("seq", F.col("want").alias("have"))
    written = kept.union(s.filter("seq % 70 = 0").select(-F.col("seq"), F.lit("new")))
    both = source.join(written, "seq", "full").filter(~F.col("want").eqNullSafe(F.col("have")))
    return both.select("seq", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("same").alias("state"))


TIME_MEAN = f"""WITH {SERIES}, o AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS t1, lead(y) OVER w AS y1, min(t) OVER (PARTITION BY rec) AS t0,
        coalesce((t - lag(t) OVER w) * (y + lag(y) OVER w) / 2, 0) AS step FROM s WINDOW w AS (PARTITION BY rec ORDER BY t, seq)),
    c AS (SELECT *, sum(step) OVER (PARTITION BY rec ORDER BY n) AS total, greatest(t - {24 * HOUR}, t0) AS low FROM o),
    k AS (SELECT c.rec, c.t, c.y, c.total, c.low, p.total + (c.low - p.t) * (p.y + p.y + coalesce((p.y1 - p.y) * (c.low - p.t) / (p.t1 - p.t), 0)) / 2 AS before
        FROM c ASOF JOIN c p ON c.rec = p.rec AND c.low >= p.t)"""


@query(f"{TIME_MEAN} SELECT rec, t, y, round(CASE WHEN t > low THEN (total - before) / (t - low) ELSE y END, 4) AS mean FROM k")
def w_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.time_mean(series(spark, sf_dir), 24 * HOUR).withColumn("mean", F.round("mean", 4))


@query(f"""{TIME_MEAN}, md AS (SELECT rec, t, median(y) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS med FROM s)
    SELECT k.rec, k.t, round(CASE WHEN k.rec % 2 = 1 THEN med WHEN k.t > low THEN (total - before) / (k.t - low) ELSE y END, 4) AS smooth FROM k JOIN md ON md.rec = k.rec AND md.t = k.t""")
def w_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    mean = trailing.time_mean(s.filter("rec % 2 = 0"), 24 * HOUR).select("rec", "t", F.round("mean", 4).alias("smooth"))
    return mean.union(trailing.trailing(s.filter("rec % 2 = 1"), 24 * HOUR).select("rec", "t", F.round("median", 4)))


@query(f"""WITH {SERIES}, m AS (SELECT *, y < 40 AS mask, row_number() OVER (PARTITION BY rec ORDER BY t, seq) - row_number() OVER (PARTITION BY rec, y < 40 ORDER BY t, seq) AS run FROM s)
    SELECT rec, t, y, seq, mask AND max(t) OVER w - min(t) OVER w BETWEEN {12 * HOUR} AND {96 * HOUR} AS flag FROM m WINDOW w AS (PARTITION BY rec, mask, run)""")
def w_run_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.run_flags(series(spark, sf_dir), F.col("y") < 40, 12 * HOUR, 96 * HOUR)


DAYS = f"d AS (SELECT *, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS w FROM s)"
DRAWDOWN = "x AS (SELECT *, max(y) OVER (PARTITION BY rec, w ORDER BY t, seq) - y AS gone FROM d)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("w", F.floor(F.col("t") / F.lit(24 * HOUR)))


@query(f"WITH {SERIES}, {DAYS}, {DRAWDOWN} SELECT rec, w, max(gone) AS gone FROM x GROUP BY rec, w")
def w_cummax_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.drawdown(_days(spark, sf_dir))


@query(f"""WITH {SERIES} SELECT a.rec, a.t, a.seq, min(b.y) AS low, arg_min(b.t, {{'y': b.y, 't': b.t}}) AS low_t, max(b.y) AS high, arg_max(b.t, {{'y': b.y, 't': -b.t}}) AS high_t
    FROM s a LEFT JOIN s b ON b.rec = a.rec AND b.t > a.t AND b.t <= a.t + {24 * HOUR} GROUP BY a.rec, a.t, a.seq""")
def w_forward_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.ahead(series(spark, sf_dir), 24 * HOUR)


SIGNALS = f"""WITH {SERIES}, {DAYS}, {DRAWDOWN}, g AS (SELECT rec, w, count(y) AS n, avg(y) AS mean, min(y) AS low, max(y) AS high, arg_max(y, {{'t': t, 's': seq}}) - arg_min(y, {{'t': t, 's': seq}}) AS delta,
    max(abs(y)) AS absmax, max(gone) AS gone, 1.0::DOUBLE AS mask FROM x GROUP BY rec, w)"""


@query(f"{SIGNALS} SELECT rec, w, n, round(mean, 6) AS mean, low, high, delta, absmax, gone, mask FROM g")
def ag_window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.window_signals(_days(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"""{SIGNALS}, st AS (SELECT avg(mean) AS mu, stddev_pop(mean) + 1e-6 AS sd FROM g) SELECT rec, w, round((mean - mu) / sd * mask, 5) AS z, mask FROM g, st""")
def ag_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trailing.window_signals(_days(spark, sf_dir))
    st = g.agg(F.avg("mean").alias("mu"), (F.stddev_pop("mean") + 1e-6).alias("sd"))
    return g.crossJoin(F.broadcast(st)).select("rec", "w", F.round((F.col("mean") - F.col("mu")) / F.col("sd") * F.col("mask"), 5).alias("z"), "mask")  # st: one row


PROFILE = f"""WITH {SERIES}, {MESSAGES}, gp AS (SELECT *, (lead(t) OVER (PARTITION BY rec, topic ORDER BY t, seq) - t) / 1e6 AS gap, (t - header) / 1e3 AS late FROM m),
    pd AS (SELECT rec, topic, count(*) AS n, (max(t) - min(t)) / 1e6 / nullif(count(*) - 1, 0) AS period FROM m GROUP BY rec, topic),
    pf AS (SELECT rec, topic, any_value(n) AS n, any_value(period) AS period, max(gap) AS max_gap, count(*) FILTER (WHERE gap > 2 * period) AS wide_gaps, bool_and(header IS NOT NULL) AS headers,
        median(late) AS latency_median, quantile_cont(late, 0.99) AS latency_p99, avg(CASE WHEN late IS NOT NULL THEN (late < 0)::INT END) AS future, greatest(0, -min(late)) AS max_future
        FROM gp JOIN pd USING (rec, topic) GROUP BY rec, topic)"""


@query(f"""{PROFILE} SELECT rec, topic, n, round(period, 3) AS period, round(max_gap, 3) AS max_gap, wide_gaps, headers, round(latency_median, 3) AS latency_median, round(latency_p99, 3) AS latency_p99,
    round(future, 6) AS future, max_future FROM pf""")
def ag_topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quality.profile(messages(spark, sf_dir)).drop("hz")
    return p.withColumns({c: millis(F.col(c)) for c in ("period", "max_gap", "latency_median", "latency_p99")} | {"future": F.round("future", 6)})


NOMINAL = {"view": 1e-5, "click": 8e-6, "error": 5e-6, "purchase": 6e-6}


@query(f"""{PROFILE}, nm(topic, want) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in NOMINAL.items())})
    SELECT pf.rec, pf.topic, concat_ws(',', CASE WHEN want IS NULL THEN 'unprofiled' END, CASE WHEN abs(1 / period - want) / want > 0.5 THEN 'rate' END, CASE WHEN max_gap > greatest(1.0, 5 * period) THEN 'gap' END,
        CASE WHEN latency_median > 300000 THEN 'latency' END, CASE WHEN future > 0.005 THEN 'future' END) AS broken FROM pf LEFT JOIN nm USING (topic)""")
def ag_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quality.profile(messages(spark, sf_dir))
    return p.select("rec", "topic", F.array_join(quality.anomalies(p, NOMINAL, 0.5, 300_000.0), ",").alias("broken"))


@query(f"""WITH {SERIES}, i AS (SELECT *, lead(t) OVER (PARTITION BY rec, topic ORDER BY t, seq) - t AS gap FROM s WHERE t BETWEEN 1704500000000000 AND 1706000000000000),
    n AS (SELECT *, row_number() OVER (PARTITION BY rec, topic ORDER BY t, seq) AS nr FROM i WHERE gap > {48 * HOUR}),
    l AS (SELECT rec, topic, string_agg(t || ':' || gap, ',' ORDER BY nr) AS gaps FROM n WHERE nr <= 20 GROUP BY rec, topic)
    SELECT i.rec, i.topic, count(*) AS n, min(t) AS first, max(t) AS last, coalesce(any_value(gaps), '') AS gaps FROM i LEFT JOIN l USING (rec, topic) GROUP BY i.rec, i.topic""")
def ag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(series(spark, sf_dir), F.lit(1704500000000000), F.lit(1706000000000000), 48 * HOUR, 20)


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER w AS nr, lead(t) OVER w AS after FROM s WINDOW w AS (PARTITION BY rec, topic ORDER BY t, seq)),
    p AS (SELECT rec, topic, median(after - t) AS period FROM r GROUP BY rec, topic HAVING count(*) >= 10), b AS (SELECT rec, min(t) AS t0 FROM s GROUP BY rec),
    g AS (SELECT r.rec, r.topic, min({{'nr': nr, 'after': after}}) AS f FROM r JOIN p USING (rec, topic) WHERE nr < 20 AND after - t > 5 * period GROUP BY r.rec, r.topic)
    SELECT rec, topic, f.nr AS stale FROM g JOIN b USING (rec) WHERE f.nr <= 5 AND f.after - t0 < {480 * HOUR}""")
def ag_stale_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stale_start(series(spark, sf_dir), 480 * HOUR)


@query(f"""WITH {SERIES}, pr(profile, topic) AS (VALUES ('shop', 'purchase'), ('shop', 'view'), ('shop', 'click'), ('shop', 'signup'), ('shop', 'error'), ('kiosk', 'kiosk'), ('kiosk', 'view')),
    tp AS (SELECT DISTINCT rec, topic FROM s WHERE (rec + length(topic)) % 11 <> 0), nd AS (SELECT profile, count(*) AS need FROM pr GROUP BY profile),
    hv AS (SELECT rec, profile, count(*) AS have FROM tp JOIN pr USING (topic) GROUP BY rec, profile),
    lk AS (SELECT r.rec, nd.profile, need - coalesce(have, 0) AS lack FROM (SELECT DISTINCT rec FROM tp) r CROSS JOIN nd LEFT JOIN hv ON hv.rec = r.rec AND hv.profile = nd.profile)
    SELECT rec, CASE WHEN count(*) FILTER (WHERE lack = 0) = 1 THEN max(profile) FILTER (WHERE lack = 0) END AS profile, min(lack) AS missing FROM lk GROUP BY rec""")
def ag_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("shop", t) for t in ("purchase", "view", "click", "signup", "error")] + [("kiosk", t) for t in ("kiosk", "view")]
    topics = series(spark, sf_dir).filter((F.col("rec") + F.length("topic")) % 11 != 0).select("rec", "topic")
    return quality.recognise(topics, spark.createDataFrame(rows, "profile string, topic string"))


@query(f"WITH {SERIES} SELECT rec, round(quantile_cont(y, 0.01), 6) AS floor FROM s GROUP BY rec")
def ag_speed_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("rec").agg(F.round(F.percentile("y", 0.01), 6).alias("floor"))


@query(f"""WITH {SERIES} SELECT rec, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS frame, count(*) FILTER (WHERE topic = 'view') AS views, count(*) FILTER (WHERE topic = 'error') AS errors,
    coalesce(max(y) FILTER (WHERE topic = 'purchase'), 0.0) AS largest FROM s GROUP BY ALL""")
def ag_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda topic: F.when(F.col("topic") == topic, F.col("y"))
    return series(spark, sf_dir).groupBy("rec", F.floor(F.col("t") / F.lit(24 * HOUR)).alias("frame")).agg(F.count(of("view")).alias("views"), F.count(of("error")).alias("errors"), F.coalesce(F.max(of("purchase")), F.lit(0.0)).alias("largest"))


@query("""SELECT vec_id, round(list_min(list_concat(list_filter(embedding[1:16], lambda x: x > 0.02)::DOUBLE[], [5.0])), 6) AS front, round(list_min(list_concat(list_filter(embedding, lambda x: x > 0.02)::DOUBLE[], [10.0])), 6) AS whole FROM embeddings""")
def ag_min_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least range in a scan's front sector and in any direction, ranges under a bound left out, with defaults for none."""
    valid = lambda v, default: F.round(F.array_min(F.concat(F.transform(F.filter(v, lambda x: x.cast("double") > 0.02), lambda x: x.cast("double")), F.array(F.lit(default)))), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", valid(F.slice("embedding", 1, 16), 5.0).alias("front"), valid(F.col("embedding"), 10.0).alias("whole"))


GRID27 = "gr AS (SELECT a, b, c FROM (VALUES (0.8), (1.0), (1.2)) x(a), (VALUES (-2.0), (0.0), (2.0)) y(b), (VALUES (30.0), (35.0), (40.0)) z(c))"


@query(f"""WITH {SERIES}, {GRID27}, k AS (SELECT rec, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS frame, seq, bool_and(y * a + b > c) AS sure, bool_or(y * a + b > c) AS maybe, any_value(y > 35) AS nominal FROM s, gr GROUP BY ALL)
    SELECT rec, frame, count(*) FILTER (WHERE nominal) AS n, count(*) FILTER (WHERE sure) AS lo, count(*) FILTER (WHERE maybe) AS hi FROM k GROUP BY rec, frame""")
def ag_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside a corridor under all, any and the nominal of 27 settings; the settings are an array, so rows are not multiplied."""
    y = F.col("y")
    inside = F.array(*((y * a + b > c) for a in (0.8, 1.0, 1.2) for b in (-2.0, 0.0, 2.0) for c in (30.0, 35.0, 40.0)))
    s = series(spark, sf_dir).select("rec", F.floor(F.col("t") / F.lit(24 * HOUR)).alias("frame"), (y > 35).alias("nominal"), F.forall(inside, lambda x: x).alias("sure"), F.exists(inside, lambda x: x).alias("maybe"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    return s.groupBy("rec", "frame").agg(n("nominal").alias("n"), n("sure").alias("lo"), n("maybe").alias("hi"))


# Sweeps.

STEP = 2 * HOUR
GRID = f"""WITH {SERIES}, pr AS (SELECT rec, t, y, lead(t) OVER w AS t1, lead(y) OVER w AS y1 FROM s WINDOW w AS (PARTITION BY rec ORDER BY t, seq)),
    pg AS (SELECT *, unnest(range(CAST(ceil(t / {STEP}) AS BIGINT), CAST(ceil(t1 / {STEP}) AS BIGINT))) * {STEP} AS tg FROM pr WHERE t1 > t),
    g AS (SELECT rec, tg AS t, y + (y1 - y) * (tg - t) / (t1 - t) AS y FROM pg)"""
BASE = f"b AS (SELECT *, CASE WHEN count(y) OVER w >= 10 THEN median(y) OVER w END AS base FROM g WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND 1 PRECEDING))"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.resampled(series(spark, sf_dir), STEP)


@query(f"{GRID} SELECT rec, t, round(y, 5) AS y FROM g")
def sw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).withColumn("y", F.round("y", 5))


@query(f"{GRID}, {BASE} SELECT rec, t, round(base, 5) AS base FROM b")
def sw_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.baseline(_grid(spark, sf_dir), 24 * HOUR, 10).select("rec", "t", F.round("base", 5).alias("base"))


@query(f"""{GRID}, {BASE}, k AS (SELECT *, max(base) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW) AS ref, max(y) OVER w AS worst, max(t) OVER w AS upto FROM b
        WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN CURRENT ROW AND {24 * HOUR} FOLLOWING)) SELECT rec, t, round(worst, 5) AS worst FROM k WHERE worst < 0.6 * ref AND upto = t + {24 * HOUR}""")
def sw_stays_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.stays_low(sweeps.baseline(_grid(spark, sf_dir), 24 * HOUR, 10), 0.6, 48 * HOUR, 24 * HOUR).withColumn("worst", F.round("worst", 5))


@query(f"""{GRID}, k AS (SELECT *, abs(last_value(y) OVER w - first_value(y) OVER w) AS net, max(y) OVER w AS top, max(t) OVER w AS upto FROM g
        WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN CURRENT ROW AND {12 * HOUR} FOLLOWING)) SELECT rec, t, round(net, 5) AS net, round(top, 5) AS top FROM k WHERE net < 2 AND top >= 40 AND upto = t + {12 * HOUR}""")
def sw_little_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.little_progress(_grid(spark, sf_dir), 12 * HOUR, 2.0, 40.0).withColumns({c: F.round(c, 5) for c in ("net", "top")})


@query(f"""{GRID}, k AS (SELECT a.rec, a.t, n.length, any_value(a.y) - min(b.y) AS lost, max(b.y) - min(b.y) AS excursion, max(b.t) AS upto FROM g a, (VALUES ({4 * HOUR}), ({8 * HOUR}), ({12 * HOUR})) n(length), g b
        WHERE a.t % {4 * HOUR} = 0 AND b.rec = a.rec AND b.t BETWEEN a.t AND a.t + n.length GROUP BY a.rec, a.t, n.length)
    SELECT rec, t, CAST(length AS BIGINT) AS length, round(lost, 5) AS lost, round(excursion, 5) AS excursion FROM k WHERE lost >= 10 AND excursion <= 40 AND upto = t + length""")
def sw_speed_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.swings(_grid(spark, sf_dir), 4 * HOUR, [4 * HOUR, 8 * HOUR, 12 * HOUR], 10.0, 40.0)
    return found.select("rec", "t", F.col("length").cast("long").alias("length"), F.round("lost", 5).alias("lost"), F.round("excursion", 5).alias("excursion"))


@query(f"""{GRID}, k AS (SELECT *, y - min(y) OVER w AS lost, arg_min(t, {{'y': y, 't': t}}) OVER w AS low_t FROM g WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN CURRENT ROW AND {16 * HOUR} FOLLOWING))
    SELECT rec, low_t, min(t) AS onset FROM k WHERE lost >= 25 GROUP BY rec, low_t""")
def sw_slowdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls by 25 within 16 hours, one per lowest point, with its earliest onset."""
    ahead = Window.partitionBy("rec").orderBy("t").rangeBetween(0, 16 * HOUR)
    low = F.min(F.struct("y", "t")).over(ahead)
    k = _grid(spark, sf_dir).withColumn("low", low).filter(F.col("y") - F.col("low.y") >= 25)
    return k.groupBy("rec", F.col("low.t").alias("low_t")).agg(F.min("t").alias("onset"))


@query(f"""{GRID}, sg AS (SELECT rec, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS seg, max(y) - min(y) AS swing FROM g GROUP BY ALL), lb AS (SELECT DISTINCT rec, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS seg FROM s WHERE topic = 'signup'),
    dt AS (SELECT DISTINCT rec, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS seg FROM s WHERE topic = 'error' AND y > 20)
    SELECT sg.rec, sg.seg, round(swing, 5) AS swing, lb.seg IS NOT NULL AS labelled, dt.seg IS NOT NULL AS detected FROM sg LEFT JOIN lb USING (rec, seg) LEFT JOIN dt USING (rec, seg)
    WHERE swing < 30 AND (lb.seg IS NOT NULL OR dt.seg IS NOT NULL)""")
def sw_hold_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a small swing and a person by label or detector."""
    day = lambda df: df.withColumn("seg", F.floor(F.col("t") / F.lit(24 * HOUR)))
    seg = day(_grid(spark, sf_dir)).groupBy("rec", "seg").agg((F.max("y") - F.min("y")).alias("swing")).filter("swing < 30")
    s = day(series(spark, sf_dir))
    some = lambda cond, name: s.filter(cond).select("rec", "seg").distinct().withColumn(name, F.lit(True))
    both = seg.join(some("topic = 'signup'", "labelled"), ["rec", "seg"], "left").join(some("topic = 'error' and y > 20", "detected"), ["rec", "seg"], "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("labelled", "detected")})
    return both.filter("labelled or detected").select("rec", "seg", F.round("swing", 5).alias("swing"), "labelled", "detected")


EPISODES = f"""ep AS (SELECT rec, seq AS rid, t AS "start", t + {6 * HOUR} AS "end", seq % 3 AS grade FROM s WHERE topic = 'signup'), ca AS (SELECT rec, seq AS lid, t AS "start", t + {4 * HOUR} AS "end" FROM s WHERE y >= 45)"""


def _episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = series(spark, sf_dir)
    ep = s.filter("topic = 'signup'").select("rec", F.col("seq").alias("rid"), F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("end"), (F.col("seq") % 3).alias("grade"))
    return ep, s.filter("y >= 45").select("rec", F.col("seq").alias("lid"), F.col("t").alias("start"), (F.col("t") + 4 * HOUR).alias("end"))


@query(f"""WITH {SERIES}, {EPISODES} SELECT rec, rid, grade FROM ep WHERE grade >= 1 AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.rec = ep.rec AND ca."start" <= ep."end" AND ca."end" >= ep."start")""")
def sw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep, ca = _episodes(spark, sf_dir)
    met = sweeps.overlapping(ca, ep, 24 * HOUR).select("rec", "rid").distinct()
    return ep.filter("grade >= 1").join(met, ["rec", "rid"], "left_anti").select("rec", "rid", "grade")


@query(f"""WITH {SERIES}, {EPISODES} SELECT rec, lid, CAST(0 AS BIGINT) AS grade FROM ca WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ca.rec = ep.rec AND grade >= 1 AND ca."start" <= ep."end" AND ca."end" >= ep."start")
    UNION ALL SELECT ca.rec, lid, max(grade) FROM ca JOIN ep ON ca.rec = ep.rec AND grade >= 1 AND ca."start" <= ep."end" AND ca."end" >= ep."start" GROUP BY ca.rec, lid""")
def sw_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the best grade of an episode that it overlaps, a real zero without one."""
    ep, ca = _episodes(spark, sf_dir)
    met = sweeps.overlapping(ca, ep.filter("grade >= 1"), 24 * HOUR).join(ep.select("rec", "rid", "grade"), ["rec", "rid"])
    best = met.groupBy("rec", "lid").agg(F.max("grade").alias("grade"))
    return ca.select("rec", "lid").join(best, ["rec", "lid"], "left").select("rec", "lid", F.coalesce("grade", F.lit(0)).cast("long").alias("grade"))


@query(f"WITH {SERIES} SELECT rec, CAST(floor(t / {4 * HOUR}) AS BIGINT) * {4 * HOUR} AS w0, count(*) AS n FROM s GROUP BY ALL")
def w_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("rec", (F.floor(F.col("t") / F.lit(4 * HOUR)) * (4 * HOUR)).alias("w0")).agg(F.count("*").alias("n"))


@query(f"""WITH {SERIES} SELECT rec, topic, min(y) AS low, arg_min(t, {{'y': y, 't': t}}) AS low_t, max(y) AS high, arg_min(t, {{'y': -y, 't': t}}) AS high_t, arg_min(y, {{'t': t, 's': seq}}) AS first, arg_max(y, {{'t': t, 's': seq}}) AS last FROM s GROUP BY rec, topic""")
def vw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.min(F.struct("y", "t")), F.min(F.struct((-F.col("y")).alias("y"), "t"))
    first, last = F.min(F.struct("t", "seq", "y")), F.max(F.struct("t", "seq", "y"))
    return series(spark, sf_dir).groupBy("rec", "topic").agg(low["y"].alias("low"), low["t"].alias("low_t"), (-high["y"]).alias("high"), high["t"].alias("high_t"), first["y"].alias("first"), last["y"].alias("last"))


@query(f"""{PROFILE}, q AS (SELECT rec, topic, quantile_cont(gap, 0.95) AS p95 FROM gp GROUP BY rec, topic) SELECT rec, topic, n, round(1e6 / period, 4) AS uhz, round(max_gap, 3) AS max_gap, round(p95, 3) AS p95 FROM pf JOIN q USING (rec, topic)""")
def vw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    gap = (F.lead("t").over(Window.partitionBy("rec", "topic").orderBy("t", "seq")) - F.col("t")) / 1e6
    q = m.withColumn("gap", gap).groupBy("rec", "topic").agg(F.percentile("gap", 0.95).alias("p95"))
    p = quality.profile(m).join(q, ["rec", "topic"])
    return p.select("rec", "topic", "n", F.round(1e6 * F.col("hz"), 4).alias("uhz"), millis(F.col("max_gap")).alias("max_gap"), millis(F.col("p95")).alias("p95"))
