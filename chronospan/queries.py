"""The engine's own operators as registered queries over whole tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import trailing
from .operators import asof, events, metrics, relations, retrieval
from .plans import index
from .registry import ORACLE_SQL, QUERIES, SERIES, query
from .sources.tables import HOUR, messages, series, table

POINTS = f"p AS (SELECT rec, t - {HOUR} AS t0, seq AS pid FROM s WHERE topic = 'purchase'), r AS (SELECT * FROM s WHERE topic = 'view')"
PERIODS = """per AS (SELECT rec, coalesce(CAST(trunc(median(gap)) AS BIGINT), 0) AS period
    FROM (SELECT rec, lead(t) OVER (PARTITION BY rec ORDER BY t, seq) - t AS gap FROM s) GROUP BY rec)"""


def _points(s: DataFrame) -> DataFrame:
    return s.filter("topic = 'purchase'").select("rec", (F.col("t") - HOUR).alias("t0"), F.col("seq").alias("pid"))


def _runs(mask: str) -> str:
    """SQL of the runs of samples where mask holds."""
    return f"""m AS (SELECT *, coalesce({mask}, false) AS mask FROM s),
        i AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t, seq)
            - row_number() OVER (PARTITION BY rec, mask ORDER BY t, seq) AS run FROM m)"""


# Points on a timeline.


@query(f"""WITH {SERIES}, {POINTS}
    SELECT p.rec, t0, pid, r.t AS found_t, r.seq AS found_seq, r.y AS found_y FROM p ASOF LEFT JOIN r ON p.rec = r.rec AND p.t0 > r.t""")
def tl_last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return asof.last_before(_points(s), s.filter("topic = 'view'"), carry=("y",))


@query(f"""WITH {SERIES}, {POINTS}
    SELECT p.rec, t0, pid, r.t AS found_t, r.seq AS found_seq, r.y AS found_y FROM p ASOF LEFT JOIN r ON p.rec = r.rec AND p.t0 <= r.t""")
def tl_first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return asof.first_after(_points(s), s.filter("topic = 'view'"), carry=("y",))


@query(f"""WITH {SERIES}, {POINTS},
    n AS (SELECT p.rec, t0, pid, r.t AS found_t, r.seq AS found_seq,
            row_number() OVER (PARTITION BY pid ORDER BY abs(r.t - t0), r.t, r.seq) AS nr FROM p LEFT JOIN r ON p.rec = r.rec)
    SELECT rec, t0, pid, found_t, found_seq FROM n WHERE nr = 1""")
def tl_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return asof.nearest(_points(s), s.filter("topic = 'view'"))


MESSAGES = f"""m AS (SELECT *, CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN t + {HOUR}
    ELSE t - ((seq * 7919) % 600) * 1000000 END AS header FROM s)"""


@query(f"""WITH {SERIES}, {MESSAGES},
    c AS (SELECT DISTINCT rec, t AS cutoff FROM s WHERE topic = 'error'),
    a AS (SELECT c.rec, m.topic, c.cutoff, count(CASE WHEN m.t < c.cutoff THEN 1 END) AS n,
            count(CASE WHEN m.t < c.cutoff THEN m.header END) AS stamps,
            max(CASE WHEN m.t < c.cutoff AND m.header <= m.t + 25000 THEN {{'h': m.header, 's': -m.seq}} END) AS best
        FROM c JOIN m ON m.rec = c.rec GROUP BY ALL),
    v AS (SELECT rec, topic, cutoff, -(best.s) AS seq, CASE WHEN n = 0 THEN 'OUTSIDE_COVERAGE' WHEN stamps = 0 THEN 'HEADER_MISSING'
            WHEN best IS NULL THEN 'CLOCK_INCOMPATIBLE' WHEN cutoff < best.h THEN 'FUTURE_MEASUREMENT'
            WHEN cutoff - best.h > {48 * HOUR} THEN 'STALE' END AS reason FROM a)
    SELECT rec, topic, cutoff, seq, CASE WHEN reason IS NULL THEN 'TRUE' ELSE 'UNKNOWN' END AS truth, reason FROM v""")
def rc_causal_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = messages(spark, sf_dir)
    topics = own.select("rec", "topic").distinct()
    cutoffs = own.filter("topic = 'error'").select("rec", F.col("t").alias("cutoff")).join(topics, "rec")
    return asof.causal_last(cutoffs, own, 48 * HOUR)


# Events of a series.


@query(f"""WITH {SERIES}, {_runs("y >= 30")}, {PERIODS},
    g AS (SELECT rec, min(t) AS "start", max(t) AS "end", max({{'v': y, 't': -t}}) AS b FROM i WHERE mask GROUP BY rec, run)
    SELECT rec, "start", "end", -(b.t) AS ext, b.v AS value FROM g JOIN per USING (rec) WHERE "end" - "start" + period >= {24 * HOUR}""")
def ev_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.threshold(series(spark, sf_dir), ">=", 30.0, 24 * HOUR)


@query(f"""WITH {SERIES}, {_runs("y + 5 >= 30")}, {PERIODS},
    o AS (SELECT *, run AS "outer", y - 5 >= 30 AS sure FROM i WHERE mask),
    q AS (SELECT *, row_number() OVER (PARTITION BY rec, "outer" ORDER BY t, seq)
            - row_number() OVER (PARTITION BY rec, "outer", sure ORDER BY t, seq) AS part FROM o),
    d AS (SELECT rec, "outer", min(t) AS "start", max(t) AS "end", max({{'v': y, 't': -t}}) AS b FROM q WHERE sure GROUP BY rec, "outer", part),
    sure AS (SELECT d.* FROM d JOIN per USING (rec) WHERE "end" - "start" + period >= {24 * HOUR}),
    w AS (SELECT rec, "outer", min(t) AS "start", max(t) AS "end", max({{'v': y, 't': -t}}) AS b FROM o GROUP BY rec, "outer")
    SELECT rec, "start", "end", -(b.t) AS ext, b.v AS value, 'TRUE' AS truth FROM sure
    UNION ALL SELECT rec, "start", "end", -(b.t), b.v, 'UNKNOWN' FROM w JOIN per USING (rec) WHERE "end" - "start" + period >= {24 * HOUR}
        AND NOT EXISTS (SELECT 1 FROM sure WHERE sure.rec = w.rec AND sure."outer" = w."outer")""")
def ev_threshold_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.threshold_band(series(spark, sf_dir), ">=", 30.0, F.col("y") - 5, F.col("y") + 5, 24 * HOUR)


@query(f"""WITH {SERIES},
    c AS (SELECT rec, t, y, y - min(y) OVER w AS "drop", max(y) OVER w - y AS rise FROM s
        WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {12 * HOUR} FOLLOWING))
    SELECT * FROM c WHERE "drop" >= 50 OR rise >= 50""")
def ev_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.change(series(spark, sf_dir), 50.0, 12 * HOUR)


@query(f"""WITH {SERIES},
    c AS (SELECT rec, t, y, max(y) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND {24 * HOUR} FOLLOWING) AS best FROM s)
    SELECT rec, t, y FROM c WHERE y = best""")
def ev_extremum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.extremum(series(spark, sf_dir), 24 * HOUR)


@query(f"""WITH RECURSIVE {SERIES},
    k AS (SELECT rec, min(t) AS t FROM s GROUP BY rec
        UNION ALL SELECT k.rec, (SELECT min(s.t) FROM s WHERE s.rec = k.rec AND s.t >= k.t + {24 * HOUR}) FROM k WHERE k.t IS NOT NULL)
    SELECT rec, t FROM k WHERE t IS NOT NULL""")
def ev_refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.refractory(series(spark, sf_dir), 24 * HOUR)


@query(f"""WITH {SERIES},
    r AS (SELECT DISTINCT rec, t - {HOUR} AS ref FROM s WHERE topic = 'signup'),
    k AS (SELECT r.rec, r.ref, coalesce(s.y, (SELECT arg_min(f.y, f.t) FROM s f WHERE f.rec = r.rec)) AS level FROM r ASOF LEFT JOIN s ON r.rec = s.rec AND r.ref >= s.t),
    h AS (SELECT k.rec, ref, min({{'t': s.t, 'seq': s.seq, 'y': s.y}}) AS m FROM k JOIN s ON s.rec = k.rec
            AND s.t BETWEEN ref AND ref + {24 * HOUR} AND s.y >= 0.8 * level GROUP BY ALL)
    SELECT rec, ref, m.t AS t, m.y AS y FROM h""")
def ev_return_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return events.return_to(s, s.filter("topic = 'signup'").select("rec", (F.col("t") - HOUR).alias("ref")).distinct(), 0.8, 24 * HOUR)


@query(f"WITH {SERIES} SELECT rec, topic, min(t) AS appear, max(t) AS disappear, count(*) AS n_obs FROM s GROUP BY rec, topic")
def ev_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tracks(series(spark, sf_dir))


# Relations between events.


def _instances(s: DataFrame, topic: str) -> DataFrame:
    return s.filter(F.col("topic") == topic).select("rec", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"), F.when(F.col("y") >= 20, "TRUE").otherwise("UNKNOWN").alias("truth"))


def _bound_sql(meets: str, key: str) -> str:
    one = lambda topic: f"""SELECT rec, t AS "start", t + {HOUR} AS "end", CASE WHEN y >= 20 THEN 'TRUE' ELSE 'UNKNOWN' END AS truth FROM s WHERE topic = '{topic}'"""
    return f"""WITH {SERIES}, p AS ({one("purchase")}), c AS ({one("view")}),
    b AS (SELECT p.rec, p."start", p."end", p.truth, c."start" AS c_start, c."end" AS c_end, c.truth AS c_truth,
            row_number() OVER (PARTITION BY p.rec, p."start" ORDER BY (c.truth <> 'TRUE'), {key}, c."start") AS nr
        FROM p LEFT JOIN c ON p.rec = c.rec AND {meets})
    SELECT rec, "start", "end", truth, c_start, c_end, c_truth FROM b WHERE nr = 1"""


@query(_bound_sql(f'c."start" BETWEEN p."end" + {HOUR} AND p."end" + {24 * HOUR}', 'c."start"'))
def rel_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.bind(_instances(s, "purchase"), _instances(s, "view"), "AFTER", HOUR, 24 * HOUR)


@query(_bound_sql(f'c."start" BETWEEN p."end" - {24 * HOUR} AND p."end" - {HOUR}', '-c."start"'))
def rel_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.bind(_instances(s, "purchase"), _instances(s, "view"), "BEFORE", HOUR, 24 * HOUR)


@query(_bound_sql(f'c."start" BETWEEN p."end" - {24 * HOUR} AND p."end" + {24 * HOUR}', 'abs(c."start" - p."end")'))
def rel_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.bind(_instances(s, "purchase"), _instances(s, "view"), "WITHIN", 0, 24 * HOUR)


@query(_bound_sql('c."start" BETWEEN p."start" AND p."end"', 'c."start"'))
def rel_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.bind(_instances(s, "purchase"), _instances(s, "view"), "DURING", bucket=HOUR)


@query("SELECT *, CASE WHEN truth = 'TRUE' AND c_truth = 'TRUE' THEN 2.0 "
    "ELSE 1 + 0.99::DOUBLE * ((truth = 'TRUE')::INT + coalesce(c_truth = 'TRUE', false)::INT) / 2 END AS ordinal FROM ("
    + _bound_sql(f'c."start" BETWEEN p."end" AND p."end" + {24 * HOUR}', 'c."start"') + ")")
def kl_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.kleene(relations.bind(_instances(s, "purchase"), _instances(s, "view"), "AFTER", 0, 24 * HOUR), ["truth", "c_truth"])


@query(f"""WITH {SERIES}, iv AS (SELECT rec, t AS "start", t + {HOUR} AS "end" FROM s),
    f AS (SELECT *, max("end") OVER (PARTITION BY rec ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv),
    g AS (SELECT *, sum(CASE WHEN reached IS NULL OR "start" > reached + {2 * HOUR} THEN 1 ELSE 0 END)
            OVER (PARTITION BY rec ORDER BY "start", "end") AS run FROM f)
    SELECT rec, min("start") AS "start", max("end") AS "end", count(*) AS n FROM g GROUP BY rec, run""")
def sw_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return relations.merge_intervals(s.select("rec", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end")), 2 * HOUR)


@query(f"""WITH {SERIES}, w AS (SELECT rec, y, unnest(range(CAST(ceil((t - {4 * HOUR}) / {HOUR}) AS BIGINT), CAST(floor(t / {HOUR}) AS BIGINT) + 1)) AS k FROM s)
    SELECT rec, k * {HOUR} AS w0, count(*) AS n, round(avg(y), 6) AS mean_y FROM w GROUP BY rec, k""")
def w_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.hopping(series(spark, sf_dir), 4 * HOUR, HOUR)


# Trailing reductions.


@query(f"""WITH {SERIES} SELECT rec, t, y, count(y) OVER w AS n, min(y) OVER w AS low, max(y) OVER w AS high,
        round(avg(y) OVER w, 6) AS mean, round(median(y) OVER w, 6) AS median
    FROM s WINDOW w AS (PARTITION BY rec ORDER BY t RANGE BETWEEN {48 * HOUR - 1} PRECEDING AND CURRENT ROW)""")
def w_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.trailing(series(spark, sf_dir), 48 * HOUR)


@query(f"""WITH {SERIES}, d AS (SELECT *, y * (coalesce(t - lag(t) OVER (PARTITION BY rec ORDER BY t, seq), 0) / {HOUR}) AS part FROM s)
    SELECT rec, t, y, round(sum(part) OVER (PARTITION BY rec ORDER BY t, seq), 4) AS total FROM d""")
def w_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.integral(series(spark, sf_dir), HOUR)


@query(f"""WITH {SERIES} SELECT rec, t, y, coalesce(last_value(y) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {12 * HOUR} PRECEDING),
        first_value(y) OVER (PARTITION BY rec ORDER BY t, seq)) AS past FROM s""")
def w_lag_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.value_before(series(spark, sf_dir), 12 * HOUR)


# Metrics over graded rows; the score of a document is a fixed rule of its id.

GRADED = """g AS (SELECT source AS grp, d.doc_id AS id, CAST((d.doc_id * 7919) % 1009 AS DOUBLE) AS score, l.quality * 2 + l.toxic AS grade
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
RANKS = "k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY grp ORDER BY grade DESC, id) AS i FROM g)"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 1009).cast("double").alias("score"), (F.col("quality") * 2 + F.col("toxic")).alias("grade"))


@query(f"""WITH {GRADED}, {RANKS},
    c AS (SELECT grp, sum(CASE WHEN r <= 10 THEN (pow(2.0, grade) - 1) / log2(r + 1.0) ELSE 0 END) AS d,
            sum(CASE WHEN i <= 10 THEN (pow(2.0, grade) - 1) / log2(i + 1.0) ELSE 0 END) AS m FROM k GROUP BY grp)
    SELECT grp, round(CASE WHEN m > 0 THEN d / m ELSE 0.0 END, 6) AS ndcg FROM c""")
def ag_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_graded(spark, sf_dir), 10)


@query(f"""WITH {GRADED}, {RANKS},
    c AS (SELECT grp, count(CASE WHEN grade >= 2 AND r <= 10 THEN 1 END) AS hit, count(CASE WHEN grade >= 2 THEN 1 END) AS n FROM k GROUP BY grp)
    SELECT grp, round(CAST(hit AS DOUBLE) / nullif(n, 0), 6) AS recall FROM c""")
def ag_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(_graded(spark, sf_dir), 10)


@query(f"""WITH {GRADED},
    pairs AS (SELECT a.grp, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS wins, count(*) AS n
        FROM g a JOIN g b ON a.grp = b.grp AND a.grade >= 2 AND b.grade < 2 GROUP BY a.grp)
    SELECT g.grp, round(CAST(any_value(wins) AS DOUBLE) / any_value(n), 6) AS auc FROM g LEFT JOIN pairs ON g.grp = pairs.grp GROUP BY g.grp""")
def ag_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_graded(spark, sf_dir))


@query(f"""WITH {GRADED}, {RANKS},
    h AS (SELECT *, CAST(grade >= 2 AS INT) AS p, sum(CAST(grade >= 2 AS INT)) OVER (PARTITION BY grp ORDER BY r) AS hits FROM k)
    SELECT grp, round(sum(CAST(p * hits AS DOUBLE) / r) / nullif(sum(p), 0), 6) AS ap FROM h GROUP BY grp""")
def ag_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_graded(spark, sf_dir))


@query("""WITH t AS (SELECT count(*) AS n, CAST(count(CASE WHEN quality = toxic THEN 1 END) AS DOUBLE) / count(*) AS po FROM labels),
    a AS (SELECT quality AS v, count(*) AS x FROM labels GROUP BY 1), b AS (SELECT toxic AS v, count(*) AS x FROM labels GROUP BY 1),
    e AS (SELECT sum(a.x * b.x) AS e FROM a JOIN b USING (v))
    SELECT n, round(po, 6) AS exact, round((po - CAST(e AS DOUBLE) / (n * n)) / (1 - CAST(e AS DOUBLE) / (n * n)), 6) AS kappa FROM t, e""")
def ag_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


# Retrieval.

ASKED = ("river", "water", "data", "water")


def _bm25_sql() -> str:
    words = sorted(set(ASKED))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(words)))
    score = " + ".join(
        f"{ASKED.count(t)} * ln(1 + (num - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / greatest(mean, 1e-9)))"
        for i, t in enumerate(words)
    )
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, {tf} FROM d), st AS (SELECT count(*) AS num, avg(n) AS mean, {df} FROM c)
    SELECT doc_id, round({score}, 6) AS score FROM c, st"""


@query(_bm25_sql())
def bm25_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), " ".join(ASKED), "doc_id", "text")


QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]


@query(f"""SELECT vec_id, round(CAST(list_inner_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]) AS DOUBLE), 6) AS score
    FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 50""")
def gen_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.most_similar(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 50, "vec_id", "embedding")


@query(f"""WITH {SERIES} SELECT seq, substr(sha256(concat_ws('|', CAST(rec AS VARCHAR), '1', CAST(t AS VARCHAR), CAST(t + {HOUR} AS VARCHAR))), 1, 16) AS candidate_id FROM s""")
def cand_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("seq", retrieval.candidate_id(F.col("rec"), 1, F.col("t"), F.col("t") + HOUR).alias("candidate_id"))


@query(f"""WITH {SERIES}, a AS (SELECT seq AS id, y AS score, 0 AS nr, 'peak' AS stage FROM s WHERE y >= 60
        UNION ALL SELECT seq, CAST(seq % 100 AS DOUBLE), 1, 'purchase' FROM s WHERE topic = 'purchase')
    SELECT id, arg_min(stage, nr) AS first_stage, arg_min(score, nr) AS score, string_agg(stage, ',' ORDER BY nr) AS stages FROM a GROUP BY id""")
def gen_union_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    peaks = s.filter("y >= 60").select(F.col("seq").alias("id"), F.col("y").alias("score"))
    bought = s.filter("topic = 'purchase'").select(F.col("seq").alias("id"), (F.col("seq") % 100).cast("double").alias("score"))
    return retrieval.union_by_id({"peak": peaks, "purchase": bought})


# Incremental index.

KEYS = """k AS (SELECT DISTINCT user_id AS rec, substr(sha256(concat_ws('|', 'motion', '3', CAST(user_id % 5 AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 32) AS key FROM events),
    h AS (SELECT DISTINCT user_id AS rec, substr(sha256(concat_ws('|', 'motion', '3', CAST(CASE WHEN user_id % 3 = 0 THEN 9 ELSE user_id % 5 END AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 32) AS key
        FROM events WHERE user_id % 4 <> 0)"""


@query(f"""WITH {KEYS} SELECT k.rec, k.key, CASE WHEN h.key IS NULL THEN 'todo' WHEN h.key = k.key THEN 'built' ELSE 'stale' END AS state
    FROM k LEFT JOIN h ON h.rec = k.rec""")
def ix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = series(spark, sf_dir).select("rec").distinct()
    fresh = index.artifact_key("motion", 3, (F.col("rec") % 5).cast("string"), F.col("rec"))
    old = index.artifact_key("motion", 3, F.when(F.col("rec") % 3 == 0, F.lit(9)).otherwise(F.col("rec") % 5).cast("string"), F.col("rec"))
    return index.build_plan(recs.select("rec", fresh.alias("key")), recs.filter("rec % 4 <> 0").select("rec", old.alias("key")))


@query(f"""WITH {SERIES}, l AS (SELECT *, row_number() OVER (PARTITION BY rec, topic ORDER BY y DESC, seq) AS nr FROM s) SELECT rec, topic, t, y, seq FROM l WHERE nr = 1""")
def lb_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest(series(spark, sf_dir), ["rec", "topic"], [F.desc("y"), F.col("seq")]).select("rec", "topic", "t", "y", "seq")


from . import program_queries, report_queries, search_queries, sequence_queries, signal_queries, stage_queries, timeline_queries  # noqa: E402, F401  they register their own
