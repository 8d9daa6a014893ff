"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, langid, lloyd, mixing, neardup, packing, quality, secrets, sharding, suffixes, tokens, topk, warc
from .common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def damaged_replica(records: DataFrame) -> DataFrame:
    """The replica that op4 audits: page ids 7 mod 101 lost their last byte to another one, ids 50 mod 101 are missing."""
    spot = F.coalesce(F.pmod("id", F.lit(101)), F.lit(0))
    spoilt = F.concat(F.substring("record", 1, F.octet_length("record") - 1), F.lit(b"?"))
    return records.filter(spot != 50).withColumn("record", F.when(spot == 7, spoilt).otherwise(F.col("record")))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), damaged_replica)


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: F.pmod(i, F.lit(100)) == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(documents(spark, sf_dir), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _lloyd_sql(rounds: int = 3) -> str:
    away = "list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.nr, any_value(v.vec_id) AS vec_id, any_value(v.vec) AS vec, min({{'d': CAST({away} AS BIGINT), 'c': c.c}}) AS m FROM v, c{i} c GROUP BY v.nr)")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.vec, c.vec) AS vec FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS vec
            FROM (SELECT m.c AS c, i, CAST(floor(sum(vec[i]) / count(*)) AS BIGINT) AS x FROM a{i}, range(1, 65) r(i) GROUP BY m.c, i) GROUP BY c) n ON n.c = c.c)""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec) - 1 AS c, vec FROM v ORDER BY sha256('1:' || vec_id), vec LIMIT 16),
        {", ".join(steps[:-1])}
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.c = m.c"""


def op13_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_language_id, op3_best_fit_packing, op4_warc_fixity, op5_pfair_mixing,
        op6_order_minhash, op7_token_counts, op8_exact_top_k, op9_sharding, op10_quality_rules,
        op11_event_sweep, op12_delta_lloyd, op13_suffix_decontamination,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op12_delta_lloyd": _lloyd_sql(),
    "op13_suffix_decontamination": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        v AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0),
        win AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, a, a + k - 1), ' ') AS s FROM v),
        p AS (SELECT nr, k, w, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
        o AS MATERIALIZED (SELECT nr, a, p.k, item_id FROM p JOIN win ON win.k = p.k AND win.s = array_to_string(list_slice(p.w, a, a + p.k - 1), ' ')),
        h AS (SELECT nr, count(DISTINCT x) AS n_hit FROM (SELECT nr, unnest(range(a, a + k)) AS x FROM (SELECT DISTINCT nr, a, k FROM o)) GROUP BY nr),
        t AS (SELECT nr, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT nr, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY nr)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (nr) LEFT JOIN t USING (nr)""",
    "op4_warc_fixity": r"""
        WITH texts AS (
            SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:uuid:' || md5(coalesce(CAST(page_id AS VARCHAR), '')) || '>' || chr(13) || chr(10)
                || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\x00-\x1F\x7F]', '', 'g') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages)
        SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS record_sha256,
            CASE WHEN page_id % 101 = 7 THEN 'damaged' WHEN page_id % 101 = 50 THEN 'missing' ELSE 'ok' END AS verdict
        FROM texts""",
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
}
