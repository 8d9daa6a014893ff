"""Search dataflow and scalar functions as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import retrieval, search
from .registry import SERIES, query
from .sources.tables import HOUR, series, table

WORDS = "d AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)"
ASKED = ("than", "ther")


def _bm25_sql() -> str:
    words = sorted(set(ASKED))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (num - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / greatest(mean, 1e-9)))" for i in range(len(words)))
    return f"""{WORDS}, c AS (SELECT doc_id, len(w) AS n, {tf} FROM d), st AS (SELECT count(*) AS num, avg(n) AS mean, {df} FROM c),
    b AS (SELECT doc_id, round({score}, 6) AS score FROM c, st)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), " ".join(ASKED), "doc_id", "text")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select("doc_id", search.window_id(F.col("doc_id"), F.col("k") * 4).alias("window_id"))


WINDOWS = "wn AS (SELECT doc_id, doc_id || '@' || lpad(CAST(k * 4 AS VARCHAR), 7, '0') AS window_id FROM documents, range(3) r(k))"


@query(f"WITH {_bm25_sql()}, {WINDOWS} SELECT window_id, score FROM b JOIN wn USING (doc_id) WHERE score > 0")
def gen_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).filter("score > 0").join(_windows(spark, sf_dir), "doc_id").select("window_id", "score")


@query(f"WITH {WINDOWS} SELECT * FROM wn WHERE doc_id % 10 = 3")
def gen_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    given = w.filter("doc_id % 10 = 3").select("window_id")
    return w.join(given, "window_id", "left_semi").select("doc_id", "window_id")


@query(f"WITH {WINDOWS} SELECT window_id, split_part(window_id, '@', 1) AS rec, CAST(split_part(window_id, '@', 2) AS BIGINT) * 1000000 AS start, CAST(split_part(window_id, '@', 2) AS BIGINT) * 1000000 + 4000000 AS \"end\" FROM wn")
def cand_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("window_id", search.candidate_window(F.col("window_id"), 4).alias("c")).select("window_id", "c.rec", "c.start", "c.end")


@query(f"WITH {_bm25_sql()} SELECT l.doc_id, coalesce(b.score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(b.score, 0.0) DESC, l.doc_id) AS rank FROM labels l LEFT JOIN b ON b.doc_id = l.doc_id AND b.score > 0")
def rk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").select("doc_id").join(_bm25(spark, sf_dir).filter("score > 0"), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return search.numbered(scored, [F.desc("score"), F.col("doc_id")])


QUERY_VECTOR = [((i * 29) % 64 - 31.5) / 64 for i in range(64)]


@query(f"""SELECT l.doc_id, coalesce(round(CAST(list_inner_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]) AS DOUBLE), 6), -1.0) AS score,
    CAST(l.quality AS BIGINT) AS other FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id""")
def rk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*(F.lit(float(v)) for v in QUERY_VECTOR))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(retrieval.dot(F.col("embedding"), q), 6).alias("score"))
    return table(spark, sf_dir, "labels").join(vectors, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(-1.0)).alias("score"), F.col("quality").cast("long").alias("other"))


CANDIDATES = f"cd AS (SELECT rec, seq AS id, t AS start, t + {4 * HOUR} AS \"end\", CASE WHEN seq % 9 = 0 THEN NULL ELSE y END AS score, CASE WHEN y >= 40 THEN 2.0 ELSE 1.0 END AS truth FROM s WHERE topic = 'purchase')"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).filter("topic = 'purchase'")
    return s.select("rec", F.col("seq").alias("id"), F.col("t").alias("start"), (F.col("t") + 4 * HOUR).alias("end"), F.when(F.col("seq") % 9 != 0, F.col("y")).alias("score"), F.when(F.col("y") >= 40, 2.0).otherwise(1.0).alias("truth"))


@query(f"WITH {SERIES}, {CANDIDATES} SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rank FROM cd")
def ord_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.numbered(_candidates(spark, sf_dir).select("id", "score"), [F.desc_nulls_last("score"), F.col("id")])


@query(f"WITH {SERIES}, {CANDIDATES} SELECT id, row_number() OVER (ORDER BY truth DESC, start, id) AS rank FROM cd")
def sel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.numbered(_candidates(spark, sf_dir).select("id", "truth", "start"), [F.desc("truth"), F.col("start"), F.col("id")]).select("id", "rank")


@query(f"WITH {SERIES}, {CANDIDATES} SELECT id, rec, truth, start, row_number() OVER (ORDER BY truth DESC, start, id) AS rank FROM cd")
def sel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.numbered(_candidates(spark, sf_dir).select("id", "rec", "truth", "start"), search.selection("FIRST"))


BEST = "v AS (SELECT cd.rec, cd.id, cd.truth, {f}(s.y) AS best FROM cd LEFT JOIN s ON s.rec = cd.rec AND s.t BETWEEN cd.start AND cd.\"end\" GROUP BY cd.rec, cd.id, cd.truth)"


@query(f"WITH {SERIES}, {CANDIDATES}, {BEST.format(f='min')} SELECT id, truth, best, row_number() OVER (ORDER BY truth DESC, best NULLS LAST, id) AS rank FROM v")
def sel_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_of_interval(_candidates(spark, sf_dir), series(spark, sf_dir), "min", 4 * HOUR)
    return search.numbered(best.select("id", "truth", "best"), search.selection("ARGMIN"))


@query(f"WITH {SERIES}, {CANDIDATES}, {BEST.format(f='max')} SELECT id, truth, best, row_number() OVER (ORDER BY truth DESC, best DESC NULLS LAST, id) AS rank FROM v")
def sel_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_of_interval(_candidates(spark, sf_dir), series(spark, sf_dir), "max", 4 * HOUR)
    return search.numbered(best.select("id", "truth", "best"), search.selection("ARGMAX"))


@query(f"WITH {SERIES} SELECT DISTINCT rec FROM s WHERE rec % 3 <> 1 INTERSECT SELECT rec FROM s WHERE topic = 'error' EXCEPT SELECT rec FROM s WHERE topic = 'signup' AND y > 150")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    scope = s.filter("rec % 3 <> 1").select("rec").distinct()
    return scope.intersect(s.filter("topic = 'error'").select("rec")).subtract(s.filter("topic = 'signup' and y > 150").select("rec"))


EDGES = f"ed AS (SELECT rec, CAST(ceil(min(t) / {HOUR}) AS BIGINT) AS w0, CAST(floor(max(t) / {HOUR}) AS BIGINT) AS w1 FROM s GROUP BY rec)"


@query(f"WITH {SERIES}, {EDGES} SELECT s.rec, seq, least(greatest(CAST(ceil((t + {2 * HOUR}) / {HOUR}) AS BIGINT), w0), w1) AS w FROM s JOIN ed USING (rec)")
def win_of_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    edges = s.groupBy("rec").agg(F.ceil(F.min("t") / F.lit(HOUR)).alias("w0"), F.floor(F.max("t") / F.lit(HOUR)).alias("w1"))
    return s.join(edges, "rec").select("rec", "seq", search.window_of(F.col("t") + 2 * HOUR, F.col("w0"), F.col("w1"), HOUR).alias("w"))


@query(f"""WITH {SERIES}, x AS (SELECT rec, seq, CAST(ceil(t / {HOUR}) AS BIGINT) AS own, unnest(range(CAST(ceil((t - {2 * HOUR}) / {HOUR}) AS BIGINT), CAST(floor((t + {2 * HOUR}) / {HOUR}) AS BIGINT) + 1)) AS w FROM s)
    SELECT rec, seq, w, w = own AS main FROM x""")
def iv_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("rec", "seq", F.posexplode(search.windows_around(F.col("t"), 2 * HOUR, HOUR)).alias("nr", "w"))
    return s.select("rec", "seq", "w", (F.col("nr") == 0).alias("main"))


@query(f"""WITH {SERIES}, x AS (SELECT rec || ':' || CAST(floor(t / {24 * HOUR}) AS BIGINT) AS win, min({{'o': -y, 'id': seq}}) AS first FROM s GROUP BY 1)
    SELECT win, row_number() OVER (ORDER BY first, win) AS rank FROM x""")
def rank_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).withColumn("win", F.concat("rec", F.lit(":"), F.floor(F.col("t") / F.lit(24 * HOUR))))
    return search.deduped(s, "win", [(-F.col("y")).alias("o"), F.col("seq").alias("id")])


@query(f"WITH {SERIES} SELECT seq, y FROM s ORDER BY y DESC, seq LIMIT 25")
def rk_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("seq", "y").orderBy(F.desc("y"), "seq").limit(search.limit_of(None, 25))


@query(f"""WITH {SERIES}, {CANDIDATES}, a AS (SELECT seq AS id FROM s), sc AS (SELECT a.id, cd.score, cd.id IS NULL AS filtered FROM a LEFT JOIN cd USING (id))
    SELECT id, filtered, row_number() OVER (ORDER BY filtered, score DESC NULLS LAST, id) AS rank FROM sc""")
def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = series(spark, sf_dir).select(F.col("seq").alias("id"))
    scored = every.join(_candidates(spark, sf_dir).select("id", "score", F.lit(False).alias("filtered")), "id", "left").withColumn("filtered", F.coalesce("filtered", F.lit(True)))
    return search.numbered(scored, [F.col("filtered"), F.desc_nulls_last("score"), F.col("id")]).select("id", "filtered", "rank")


@query(f"""WITH {SERIES}, a AS (SELECT seq AS id, 0 AS nr, 'peak' AS stage, y AS score FROM s WHERE y >= 60 UNION ALL SELECT seq, 1, 'purchase', CAST(seq % 100 AS DOUBLE) FROM s WHERE topic = 'purchase')
    SELECT id, arg_min(stage, nr) AS first_stage, max(score) FILTER (WHERE stage = 'peak') AS peak, max(score) FILTER (WHERE stage = 'purchase') AS purchase FROM a GROUP BY id""")
def fn_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    both = search.union_scores({"peak": s.filter("y >= 60").select(F.col("seq").alias("id"), F.col("y").alias("score")), "purchase": s.filter("topic = 'purchase'").select(F.col("seq").alias("id"), (F.col("seq") % 100).cast("double").alias("score"))})
    return both.select("id", "first_stage", F.try_element_at("scores", F.lit("peak")).alias("peak"), F.try_element_at("scores", F.lit("purchase")).alias("purchase"))


@query("""WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM p GROUP BY label)
    SELECT p.label, CAST(i - 1 AS INTEGER) AS place, round(x / greatest(norm, 1e-9), 5) AS x FROM p JOIN n USING (label)""")
def ag_window_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = search.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 5))


# Scalar functions.


@query(f"""WITH {SERIES}, {CANDIDATES}, ed AS (SELECT rec, CAST(ceil(min(t) / {HOUR}) AS BIGINT) AS w0, CAST(floor(max(t) / {HOUR}) AS BIGINT) AS w1 FROM s GROUP BY rec),
    w AS (SELECT cd.*, rec * 7 + least(greatest(CAST(ceil(start / {HOUR}) AS BIGINT), w0), w1) % 7 AS wid FROM cd JOIN ed USING (rec)),
    c AS (SELECT w.id, w.truth, coalesce(round(CAST(list_inner_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]) AS DOUBLE), 6), -1.0) AS score FROM w LEFT JOIN embeddings e ON e.vec_id = w.wid)
    SELECT id, truth, score, row_number() OVER (ORDER BY truth DESC, score DESC, id) AS rank FROM c""")
def rk_similarity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals take the vector of their window, -1 where there is none; ordered by another stage's score first, then by their own."""
    s = series(spark, sf_dir)
    edges = s.groupBy("rec").agg(F.ceil(F.min("t") / F.lit(HOUR)).alias("w0"), F.floor(F.max("t") / F.lit(HOUR)).alias("w1"))
    w = _candidates(spark, sf_dir).join(edges, "rec").select("id", "truth", (F.col("rec") * 7 + search.window_of(F.col("start"), F.col("w0"), F.col("w1"), HOUR) % 7).alias("wid"))
    q = F.array(*(F.lit(float(v)) for v in QUERY_VECTOR))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("wid"), F.round(retrieval.dot(F.col("embedding"), q), 6).alias("score"))
    scored = w.join(vectors, "wid", "left").select("id", "truth", F.coalesce("score", F.lit(-1.0)).alias("score"))
    return search.numbered(scored, [F.desc("truth"), F.desc("score"), F.col("id")])


@query("""SELECT event_id, value / 100 AS fraction, value / 100 AS m_of_cm, round(value / 3.6, 6) AS mps, value * 1000 AS us_of_ms FROM events""")
def fn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (v / 100).alias("fraction"), (v / 100).alias("m_of_cm"), F.round(v / 3.6, 6).alias("mps"), (v * 1000).alias("us_of_ms"))


@query("""SELECT event_id, abs(value - 30) AS gone, round(sqrt(value), 5) AS root, round(sqrt(value * value + 9), 5) AS hyp, round(exp(-value / 50), 5) AS decay, floor(value) AS low, ceil(value) AS high, least(greatest(value, 10), 40) AS clipped,
    round(sqrt(value * value + 16 + 25), 5) AS norm3 FROM events""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    norm3 = F.sqrt(v * v + F.lit(4.0) * 4.0 + F.lit(5.0) * 5.0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.abs(v - 30).alias("gone"), F.round(F.sqrt(v), 5).alias("root"), F.round(F.hypot(v, F.lit(3.0)), 5).alias("hyp"), F.round(F.exp(-v / 50), 5).alias("decay"),
        F.floor(v).cast("double").alias("low"), F.ceil(v).cast("double").alias("high"), F.least(F.greatest(v, F.lit(10.0)), F.lit(40.0)).alias("clipped"), F.round(norm3, 5).alias("norm3"),
    )


@query("""SELECT event_id, round(radians(value), 5) AS rad, round(sin(radians(value)), 5) AS s, round(cos(radians(value)), 5) AS c, round(degrees(atan2(value, 30)), 5) AS bearing, round(degrees(atan(value / 10)), 5) AS slope FROM events""")
def fn_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    r = F.radians(v)
    return table(spark, sf_dir, "events").select("event_id", F.round(r, 5).alias("rad"), F.round(F.sin(r), 5).alias("s"), F.round(F.cos(r), 5).alias("c"), F.round(F.degrees(F.atan2(v, F.lit(30.0))), 5).alias("bearing"), F.round(F.degrees(F.atan(v / 10)), 5).alias("slope"))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'))) AS norm FROM conversations""")
def fn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))).alias("norm"))


@query("""SELECT page_id, split_part(url, '/', 3) AS host, lpad(CAST(page_id AS VARCHAR), 7, '0') AS padded, regexp_replace(url, '^.*/', '') AS leaf FROM pages""")
def fn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.format_string("%07d", "page_id").alias("padded"), F.substring_index("url", "/", -1).alias("leaf"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"' || event_type || '"}' AS canonical FROM events""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("canonical"))
