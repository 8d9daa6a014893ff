"""Report metrics, labels, pools and the index as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import metrics, retrieval, sweeps
from .operators.sequences import running
from .plans import index
from .registry import SERIES, query
from .sources.tables import HOUR, series, table

RUN = "g AS (SELECT source AS grp, d.doc_id AS id, CAST((d.doc_id * 7919) % 1009 AS DOUBLE) AS score, l.quality * 2 + l.toxic AS grade, coalesce(lang, '') AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 1009).cast("double").alias("score"), (F.col("quality") * 2 + F.col("toxic")).alias("grade"), F.coalesce("lang", F.lit("")).alias("lang"))


@query(f"WITH {RUN}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r FROM g) SELECT grp, round(avg((grade IS NOT NULL)::INT), 6) AS judged FROM k WHERE r <= 20 GROUP BY grp")
def ag_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged(_run(spark, sf_dir), 20)


@query(f"""WITH {RUN}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r FROM g WHERE id % 4 <> 0), n AS (SELECT grp, count(*) AS n FROM k GROUP BY grp)
    SELECT g.grp, g.id, -coalesce(r - 1, n, 0) AS score FROM g LEFT JOIN k USING (grp, id) LEFT JOIN n ON n.grp = g.grp WHERE g.id % 2 = 0""")
def ag_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    return metrics.positions(metrics.ranked(run.filter("id % 4 <> 0")), run.filter("id % 2 = 0").select("grp", "id"))


@query(f"""WITH {RUN}, j AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS r FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY grade DESC, id) AS r FROM g WHERE grade IS NOT NULL),
    d AS (SELECT grp, sum((pow(2, coalesce(grade, 0)) - 1) / log2(r + 1)) AS d FROM j WHERE r <= 20 GROUP BY grp), m AS (SELECT grp, sum((pow(2, grade) - 1) / log2(r + 1)) AS m FROM i WHERE r <= 20 GROUP BY grp)
    SELECT d.grp, CASE WHEN m > 0 THEN round(d / m, 6) END AS ndcg FROM d LEFT JOIN m USING (grp)""")
def ag_ndcg_unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg_or_null(_run(spark, sf_dir), 20, unjudged_as_zero=True)


@query(f"WITH {RUN}, m AS (SELECT grp, lang, avg(score) AS m FROM g GROUP BY grp, lang) SELECT grp, round(avg(m), 6) AS mean FROM m GROUP BY grp")
def ag_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.two_level(_run(spark, sf_dir), "grp", "lang", "score")


@query(f"WITH {RUN}, o AS (SELECT grp, list_sort(list(score)) AS v FROM g GROUP BY grp) SELECT grp, list_median(v) AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT)) + 1] AS p95 FROM o")
def ag_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(_run(spark, sf_dir), "grp", "score")


@query("""WITH q AS (SELECT vec_id AS probe, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT probe, e.vec_id AS item, row_number() OVER (PARTITION BY probe ORDER BY list_inner_product(v, CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS r
    FROM q JOIN embeddings e ON e.vec_id <> probe), c AS (SELECT item, count(*) AS c FROM s WHERE r <= 5 GROUP BY item) SELECT max(c) AS busiest, count(*) AS items FROM c""")
def ag_hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 of a stated set of probes against all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return metrics.hubness(retrieval.nearest_of(e, e.filter("item % 50 = 0").select(F.col("item").alias("probe"), "v"), 5).select("probe", "item"))


@query(f"""WITH {RUN}, k AS (SELECT grp || '|' || lang AS key, avg(score) AS v FROM g GROUP BY 1), d AS (SELECT b, v, CAST('0x' || substr(md5(key || '|' || b || '|0'), 1, 8) AS BIGINT) % 1000003 / 1000003.0::DOUBLE AS u FROM k, range(1, 2001) r(b)),
    w AS (SELECT b, v, {" + ".join(f"(u >= {x}::DOUBLE)::INT" for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))} AS w FROM d), m AS (SELECT b, sum(v * w) / nullif(sum(w), 0) AS m FROM w GROUP BY b)
    SELECT (SELECT avg(v) FROM k) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m""")
def ag_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _run(spark, sf_dir).groupBy(F.concat_ws("|", "grp", "lang").alias("key")).agg(F.avg("score").alias("v"))
    return metrics.bootstrap(per, 2000)


@query("""SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS exact, round(avg((abs(quality - toxic) <= 1)::INT), 6) AS within_one, round(avg(((quality >= 1) = (toxic >= 1))::INT), 6) AS "binary" FROM labels""")
def ag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


@query("SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL")
def ag_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n"))


SETS = f"l AS (SELECT DISTINCT rec AS grp, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS item FROM s WHERE y >= 30), r AS (SELECT DISTINCT rec AS grp, CAST(floor(t / {24 * HOUR}) AS BIGINT) AS item FROM s WHERE topic = 'purchase')"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = series(spark, sf_dir)
    day = lambda df: df.select(F.col("rec").alias("grp"), F.floor(F.col("t") / F.lit(24 * HOUR)).alias("item"))
    return day(s.filter("y >= 30")), day(s.filter("topic = 'purchase'"))


@query(f"""WITH {SERIES}, {SETS}, b AS (SELECT coalesce(l.grp, r.grp) AS grp, l.item IS NOT NULL AS hl, r.item IS NOT NULL AS hr FROM l FULL JOIN r ON l.grp = r.grp AND l.item = r.item)
    SELECT grp, round(coalesce(sum((hl AND hr)::INT)::DOUBLE / nullif(sum(hl::INT), 0), 0), 6) AS precision, round(coalesce(sum((hl AND hr)::INT)::DOUBLE / nullif(sum(hr::INT), 0), 0), 6) AS recall,
        round(sum((hl AND hr)::INT)::DOUBLE / count(*), 6) AS jaccard FROM b GROUP BY grp""")
def ag_clause_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.set_overlap(*_sets(spark, sf_dir))


@query(f"""WITH {SERIES}, {SETS}, j AS (SELECT l.grp, count(*) AS n, count(r.item) AS hit FROM l LEFT JOIN r USING (grp, item) GROUP BY l.grp) SELECT round(sum(hit)::DOUBLE / sum(n), 6) AS precision,
    round((SELECT sum(hit) FROM j)::DOUBLE / (SELECT count(*) FROM r), 6) AS recall FROM j""")
def ag_gen_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, wanted = (x.distinct() for x in _sets(spark, sf_dir))
    hits = made.join(wanted, ["grp", "item"], "left_semi").agg(F.count("*").alias("hit"))
    sizes = made.agg(F.count("*").alias("n")).crossJoin(wanted.agg(F.count("*").alias("m"))).crossJoin(hits)  # one row each
    return sizes.select(F.round(F.col("hit") / F.col("n"), 6).alias("precision"), F.round(F.col("hit") / F.col("m"), 6).alias("recall"))


@query(f"""WITH {SERIES}, ep AS (SELECT rec, seq AS rid, t AS "start", t + {6 * HOUR} AS "end" FROM s WHERE topic = 'signup'), ca AS (SELECT * FROM (SELECT rec, t AS "start", t + {4 * HOUR} AS "end", row_number() OVER (PARTITION BY rec ORDER BY y DESC, seq) AS r FROM s) WHERE r <= 10)
    SELECT rec, round(avg((EXISTS (SELECT 1 FROM ca WHERE ca.rec = ep.rec AND ca."start" <= ep."end" AND ca."end" >= ep."start"))::INT), 6) AS recall FROM ep GROUP BY rec""")
def ag_episode_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    ep = s.filter("topic = 'signup'").select("rec", F.col("seq").alias("rid"), F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("end"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("y"), "seq"))).filter("r <= 10")
    met = sweeps.overlapping(top.select("rec", F.col("seq").alias("lid"), F.col("t").alias("start"), (F.col("t") + 4 * HOUR).alias("end")), ep, 24 * HOUR)
    hit = met.select("rec", "rid").distinct().withColumn("hit", F.lit(1.0))
    return ep.join(hit, ["rec", "rid"], "left").groupBy("rec").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


@query(f"""WITH {RUN} SELECT coalesce(grp, 'all') AS "set", coalesce(lang, 'all') AS slice, count(*) AS n, count(grade) AS judged, round(avg(score), 6) AS mean FROM g GROUP BY GROUPING SETS ((grp, lang), (grp), ())""")
def ag_config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _run(spark, sf_dir).groupingSets([[F.col("grp"), F.col("lang")], [F.col("grp")], []], F.col("grp"), F.col("lang"))
    return sets.agg(F.count("*").alias("n"), F.count("grade").alias("judged"), F.round(F.avg("score"), 6).alias("mean")).select(F.coalesce("grp", F.lit("all")).alias("set"), F.coalesce("lang", F.lit("all")).alias("slice"), "n", "judged", "mean")


# Labels and pools.


@query(f"""WITH {SERIES}, k AS (SELECT rec, topic, seq % 3 AS priority, seq % 2 AS grade FROM s), p AS (SELECT rec, topic, priority, count(DISTINCT grade) AS payloads FROM k GROUP BY ALL), t AS (SELECT rec, topic, max({{'p': priority, 'n': payloads}}) AS m FROM p GROUP BY rec, topic)
    SELECT rec, topic, m.p AS priority, m.n AS payloads FROM t WHERE m.n > 1""")
def lb_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = series(spark, sf_dir).select("rec", "topic", (F.col("seq") % 3).alias("priority"), (F.col("seq") % 2).alias("grade"))
    return index.conflicts(records, ["rec", "topic"], "priority", "grade")


@query(f"""WITH {SERIES}, l AS (SELECT rec, topic, seq, y, row_number() OVER (PARTITION BY rec, topic ORDER BY seq % 3 DESC, 'shard' || (seq % 5) DESC, seq DESC) AS nr FROM s) SELECT rec, topic, seq, y FROM l WHERE nr = 1""")
def lb_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that counts per key: by campaign priority, then shard name, then line, the last one."""
    last = F.max(F.struct((F.col("seq") % 3).alias("p"), F.concat(F.lit("shard"), F.col("seq") % 5).alias("shard"), "seq", "y"))
    return series(spark, sf_dir).groupBy("rec", "topic").agg(last.alias("m")).select("rec", "topic", "m.seq", "m.y")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'held' WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS folder FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lb_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("quality").isNull() & F.col("toxic").isNull(), "unlabelled").when(F.col("toxic") == 1, "held").when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("folder"))


@query("""SELECT l.doc_id, concat_ws(',', CASE WHEN quality NOT IN (0, 1) THEN 'quality' END, CASE WHEN toxic NOT IN (0, 1) THEN 'toxic' END, CASE WHEN d.doc_id IS NULL THEN 'ref_missing' END, CASE WHEN length(coalesce(d.text, '')) < 100 THEN 'no_evidence' END,
    CASE WHEN quality = 1 AND toxic = 1 THEN 'contradiction' END) AS broken FROM labels l LEFT JOIN documents d USING (doc_id)""")
def lb_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.lit(True).alias("there"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    rules = {"quality": ~F.col("quality").isin(0, 1), "toxic": ~F.col("toxic").isin(0, 1), "ref_missing": F.col("there").isNull(), "no_evidence": F.coalesce("n", F.lit(0)) < 100, "contradiction": (F.col("quality") == 1) & (F.col("toxic") == 1)}
    return both.select("doc_id", F.concat_ws(",", *(F.when(c, name) for name, c in rules.items())).alias("broken"))


@query(f"""WITH {SERIES}, a AS (SELECT seq AS id, 'top' AS src FROM (SELECT seq, row_number() OVER (PARTITION BY rec ORDER BY y DESC, seq) AS r FROM s) WHERE r <= 5),
    b AS (SELECT seq AS id, 'attr' AS src FROM s WHERE topic = 'error' AND y >= 30) SELECT id, string_agg(src, ',' ORDER BY src) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def pl_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("y"), "seq"))).filter("r <= 5").select(F.col("seq").alias("id"), F.lit("top").alias("src"))
    both = top.union(s.filter("topic = 'error' and y >= 30").select("seq", F.lit("attr")))
    return both.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"))


POOL = {"by_value": ("y DESC, seq", lambda: [F.desc("y"), F.col("id")]), "by_number": ("seq * 7919 % 1009, seq", lambda: [F.col("id") * 7919 % 1009, F.col("id")])}


@query(f"""WITH {SERIES}, {", ".join(f"c{i} AS (SELECT topic, seq AS id, '{name}' AS src, row_number() OVER (PARTITION BY topic ORDER BY {sql}) AS r FROM s WHERE y IS NOT NULL)" for i, (name, (sql, _)) in enumerate(POOL.items()))},
    a AS (SELECT topic, seq AS id, 'attribute' AS src, row_number() OVER (PARTITION BY topic ORDER BY seq) AS r FROM s WHERE y >= 30 AND y < 60),
    z AS (SELECT topic, seq AS id, 'random' AS src, row_number() OVER (PARTITION BY topic ORDER BY md5(seq || '|7'), seq) AS r FROM s),
    u AS (SELECT * FROM c0 WHERE r <= 20 UNION ALL SELECT * FROM c1 WHERE r <= 20 UNION ALL SELECT * FROM a WHERE r <= 25 UNION ALL SELECT * FROM z WHERE r <= 10)
    SELECT topic AS grp, id, string_agg(src, ',' ORDER BY src) AS sources FROM u GROUP BY topic, id""")
def pl_pool_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query (event type): the first 20 of each configuration, up to 25 candidates by attribute and 10 drawn ones, with all their sources."""
    s = series(spark, sf_dir).select(F.col("topic").alias("grp"), F.col("seq").alias("id"), "y")
    parts = [metrics.first_k(s.filter("y is not null"), 20, order()).withColumn("src", F.lit(name)) for name, (_, order) in POOL.items()]
    parts.append(metrics.first_k(s.filter("y >= 30 and y < 60"), 25, [F.col("id")]).withColumn("src", F.lit("attribute")))
    parts.append(metrics.first_k(s, 10, [F.md5(F.concat_ws("|", "id", F.lit(7))), F.col("id")]).withColumn("src", F.lit("random")))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("grp", "id").agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"))


@query(f"WITH {SERIES} SELECT seq, (topic IN ('view', 'click') AND y BETWEEN 10 AND 60) OR (topic = 'error' AND NOT y < 20) AS wanted FROM s")
def pl_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (F.col("topic").isin("view", "click") & F.col("y").between(10, 60)) | ((F.col("topic") == "error") & ~(F.col("y") < 20))
    return series(spark, sf_dir).select("seq", rule.alias("wanted"))


@query("SELECT d.doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1) / 30) AS BIGINT) AS job FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def ix_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    lines = running(todo.select("source", "doc_id").withColumn("one", F.lit(1).cast("long")), ["source", "doc_id"], "one")
    firsts = lines.groupBy("source").agg(F.min("rank").alias("r0"))
    return lines.join(firsts, "source").select("doc_id", F.floor((F.col("rank") - F.col("r0")) / 30).alias("job"))


@query(f"""WITH {SERIES}, h AS (SELECT rec, CAST('0x' || substr(md5(topic || '|' || seq || '|' || sha256(CAST(CAST(round(y * 1000000) AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT) AS h FROM s)
    SELECT rec, substr(sha256(sum(h) || '|' || count(*)), 1, 32) AS content FROM h GROUP BY rec""")
def ix_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.content_key(series(spark, sf_dir).withColumn("sha", F.sha2(F.round(F.col("y") * 1_000_000).cast("long").cast("string"), 256)), "rec", "topic", "sha", "seq")


@query(f"""WITH {SERIES}, pg(name, topic, low) AS (VALUES ('busy', 'click', 50.0), ('fault', 'error', 30.0), ('sale', 'purchase', 40.0)) SELECT pg.name, rec, CAST(floor(t / {HOUR}) AS BIGINT) AS w FROM s JOIN pg ON s.topic = pg.topic AND y >= low GROUP BY ALL""")
def ml_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of definite matches of a list of programs; the programs are an expression, so one pass reads the series."""
    programs = {"busy": ("click", 50.0), "fault": ("error", 30.0), "sale": ("purchase", 40.0)}
    hits = F.array_compact(F.array(*(F.when((F.col("topic") == topic) & (F.col("y") >= low), F.lit(name)) for name, (topic, low) in programs.items())))
    return series(spark, sf_dir).select(F.explode(hits).alias("name"), "rec", F.floor(F.col("t") / F.lit(HOUR)).alias("w")).distinct()


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) GROUP BY label")
def ml_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not yet embedded: the anti-join that an append starts from, counted by label."""
    todo = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    return todo.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, json_extract_string(to_json({'role': role, 'n': length(text)}), '$.role') AS role, CAST(length(text) AS BIGINT) AS n FROM conversations")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines read by an explicit schema; absent fields are null."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("line"))
    r = F.from_json("line", "role string, n long, absent string")
    return lines.select("conv_id", "turn", r["role"].alias("role"), r["n"].alias("n"))


@query("""SELECT event_id, round(sqrt(value * value + 4), 6) AS speed, round(degrees(atan2(value, 2)), 5) AS yaw FROM events""")
def src_odom(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.hypot(v, F.lit(2.0)), 6).alias("speed"), F.round(F.degrees(F.atan2(v, F.lit(2.0))), 5).alias("yaw"))


@query("""WITH r AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS rec FROM pages), m AS (SELECT DISTINCT rec, length(rec) AS robot FROM r WHERE length(rec) % 2 = 0) SELECT r.rec, any_value(robot) AS robot, count(*) AS n, count(*) > 1 AS collision FROM r LEFT JOIN m USING (rec) GROUP BY r.rec""")
def src_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings named by a pattern of their paths, joined with metadata, collisions marked."""
    r = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("rec"))
    meta = r.distinct().select("rec", F.length("rec").cast("long").alias("robot")).filter("robot % 2 = 0")
    n = r.groupBy("rec").agg(F.count("*").alias("n"))
    return n.join(meta, "rec", "left").select("rec", "robot", "n", (F.col("n") > 1).alias("collision"))


@query(f"""WITH {SERIES}, b AS (SELECT rec, topic, CAST(seq % 4 AS BIGINT) AS stage, seq FROM s), l AS (SELECT rec, stage, max(seq) AS seq FROM b GROUP BY rec, stage) SELECT b.rec, b.stage, b.seq, b.seq < l.seq AS superseded FROM b JOIN l USING (rec, stage)""")
def snk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest after many puts: a later build supersedes the earlier ones of its stage and recording."""
    b = series(spark, sf_dir).select("rec", (F.col("seq") % 4).alias("stage"), "seq")
    last = b.groupBy("rec", "stage").agg(F.max("seq").alias("last"))
    return b.join(last, ["rec", "stage"]).select("rec", "stage", "seq", (F.col("seq") < F.col("last")).alias("superseded"))
