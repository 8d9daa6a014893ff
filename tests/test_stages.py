"""The sink under repeated and lost writes, plans through a stage graph, and streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from chronospan.plans import index
from chronospan.plans.index import Stage
from chronospan.sources.manifest import Manifest, differences
from chronospan.streaming import sessions


def test_sink_supersedes_and_repeats_safely(spark, tmp_path):
    sink = Manifest(spark, str(tmp_path / "sink"))
    a, b = spark.range(5).selectExpr("id k", "id * 2 v"), spark.range(7).selectExpr("id k", "id * 3 v")
    assert sink.put(a, "s", "r1", "a") and not sink.put(a, "s", "r1", "a")
    assert sink.put(b, "s", "r2", "b") and sink.read("s").count() == 12
    assert sink.put(b, "s", "r1", "c") and sink.read("s").count() == 14
    assert not sink.has("a") and sink.has("c")
    assert sorted((r["recording"], r["key"], r["rows"]) for r in sink.current().collect()) == [("r1", "c", 7), ("r2", "b", 7)]
    assert sink.records().count() == 3
    keys = {r["key"]: r["content_key"] for r in sink.records().collect()}
    assert keys["b"] == keys["c"] != keys["a"]


def test_a_lost_put_leaves_nothing_to_read(spark, tmp_path):
    sink = Manifest(spark, str(tmp_path / "sink"))
    bad = spark.range(3).selectExpr("id k", "raise_error('lost') v")
    with pytest.raises(Exception, match="lost"):
        sink.put(bad, "s", "r", "a")
    with pytest.raises(ValueError, match="nothing"):
        sink.read("s")
    assert sink.put(spark.range(3).selectExpr("id k", "id v"), "s", "r", "a") and sink.read("s").count() == 3


def test_writers_take_different_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    sink = Manifest(spark, str(tmp_path / "sink"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sink._commit({"stage": "s", "recording": f"r{i}", "key": f"k{i}", "content_key": "", "path": "", "rows": 0}), range(8)))
    assert sorted(r["version"] for r in sink.records().collect()) == list(range(8))


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 4.0)], "k long, v double")
    assert sorted(map(tuple, differences(a, b, ["k"]).collect())) == [(2, "changed"), (3, "missing"), (4, "added")]


def test_states_in_their_order(spark):
    recs = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "rec long, fingerprint string")
    top, low = Stage("top"), Stage("low", ("top",), flag="gpu", applies="rec <> 1", adopts="rec = 3")
    key = {r["rec"]: r["key"] for r in index.stage_states(recs, low, spark.createDataFrame([(i, "top", "x", f"c{i}", 1) for i in range(6)], "rec long, stage string, key string, content string, at long"), set()).collect()}
    rows = [(i, "top", "x", f"c{i}", 1) for i in range(5)] + [(2, "low", key[2], "l", 1), (2, "top", "w", "older", 0), (4, "low", "other", "l", 1)]
    artifacts = spark.createDataFrame(rows, "rec long, stage string, key string, content string, at long")
    states = lambda flags: {r["rec"]: r["state"] for r in index.stage_states(recs, low, artifacts, flags).collect()}
    assert states(set()) == {0: "gated", 1: "n/a", 2: "built", 3: "gated", 4: "gated", 5: "blocked"}
    assert states({"gpu"}) == {0: "todo", 1: "n/a", 2: "built", 3: "adopted", 4: "todo", 5: "blocked"}
    whole = index.graph_plan(recs, [top, low], artifacts, {"gpu"}, run=True)
    assert {r["rec"]: r["state"] for r in whole.filter("stage = 'low'").collect()}[5] == "todo"


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "rec long, ts timestamp, seq long, y double"
    rows = [(n % 3, 10**6 + n * 600 + (n // 7) * 7000, n, float(n)) for n in range(60)]
    df = spark.createDataFrame(rows, "rec long, s long, seq long, y double").select("rec", F.timestamp_seconds("s").alias("ts"), "seq", "y")
    end = spark.createDataFrame([(None, 10**7, None, None)], "rec long, s long, seq long, y double").select("rec", F.timestamp_seconds("s").alias("ts"), "seq", "y")
    found = {}
    for name, cuts in {"whole": [(0, 60)], "parts": [(0, 25), (20, 60)]}.items():
        root = str(tmp_path / name)
        for a, b in cuts:  # the second part repeats rows of the first one
            df.filter(f"seq >= {a} and seq < {b}").write.mode("append").parquet(f"{root}/in")
            sessions.run_available(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", "1 hour", "1 day")
        end.write.mode("append").parquet(f"{root}/in")
        for _ in range(2):  # the second run finds nothing new
            sessions.run_available(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", "1 hour", "1 day")
        found[name] = sorted(map(tuple, spark.read.parquet(f"{root}/out").filter("rec is not null").collect()))
    assert found["parts"] == found["whole"] and sum(r[3] for r in found["whole"]) == 60
