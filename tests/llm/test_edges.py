"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronospan.llm import common, langid, mixing, neardup, packing, queries, quality, secrets, sharding, tokens, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, length int, slot string, spans int, c0 int, `part` string"
LONG = "lorem ipsum dolor sit amet " * 8000


def messy(spark):
    some = "the quick brown fox jumps over the lazy dog and then runs away from all of the other animals in the wood"
    rows = [(1, some, "en", "a"), (2, some, "en", "a"), (2, some, "en", "a"), (3, None, "en", None), (None, some, None, "b"), (4, "", None, "b"), (5, LONG, "la", "a"), (6, "!!! 123", None, None), (None, None, None, None)]
    return spark.createDataFrame([(*r, None, "x", 1, None, 2, 3, "y") for r in rows], SCHEMA)


def audited(df):
    return warc.audit_pages(df, lambda records: records, "doc_id", "source", "text")


OPERATORS = {
    "secrets": secrets.scan,
    "langid": langid.identify,
    "packing": lambda df: packing.pack(df, queries.tokenizer_path()).filter("piece = 0"),
    "warc": audited,
    "mixing": mixing.plan,
    "neardup": neardup.classes,
    "tokens": lambda df: tokens.count_tokens(df, queries.tokenizer_path()),
    "sharding": sharding.shard_documents,
    "quality": quality.judge,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(spark, name):
    found = OPERATORS[name](messy(spark)).collect()
    ids = [r["doc_id"] for r in found]
    assert sorted(i for i in ids if i is not None) == [1, 2, 2, 3, 4, 5, 6]
    assert ids.count(None) == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_of_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, lambda i: F.pmod(i, F.lit(100)) == 0).collect() == []


def test_null_texts_are_undecided_and_alone(spark):
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(messy(spark)).collect() if r["doc_id"] in (3, 4, 6)} == {3: "und", 4: "und", 6: "und"}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(messy(spark)).collect() if r["doc_id"]} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_audit_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body" * i) for i in range(300)], "doc_id long, source string, text string")
    found = warc.audit_pages(pages, queries.damaged_replica, "doc_id", "source", "text").collect()
    want = {i: "damaged" if i % 101 == 7 else "missing" if i % 101 == 50 else "ok" for i in range(300)}
    assert {r["doc_id"]: r["verdict"] for r in found} == want


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_messy_and_empty_documents(spark, stage):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = messy(spark).select("doc_id", "text", "lang", "source", "n_chars")
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, spark.createDataFrame([], columns), "").count() == 0
    out = run(spark, docs, "")
    if stage != "best_fit_packing":
        assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    if stage in ("secret_scan", "source_mixing"):
        assert len(ids) == 9
    if stage == "near_dedup":
        assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6]


def test_near_duplicates_leave_one_table_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    words = " ".join(f"w{i}" for i in range(60))
    kept = neardup.keep_first(spark.createDataFrame([(1, words), (2, words + " more"), (3, "other text")], "doc_id long, text string"))
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
