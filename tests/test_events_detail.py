"""Events, relations and streams on small hand-made series: ties, gaps, nulls and edges that the tables do not hold."""

from pyspark.sql import functions as F

from chronospan.operators import events, program, relations, retrieval
from chronospan.operators.program import Relation
from chronospan.streaming import windows

S = 1_000_000


def series(spark, values, step=S):
    return spark.createDataFrame([(1, i * step, v, i) for i, v in enumerate(values)], "rec long, t long, y double, seq long")


def test_equal_band_is_the_comparison_of_the_value(spark):
    s = series(spark, [30.0] * 5)
    found = events.threshold_band(s, "=", 30.0, F.col("y") - 5, F.col("y") + 5, 2 * S).collect()
    assert [(r["start"], r["end"], r["truth"], r["value"]) for r in found] == [(0, 4 * S, "TRUE", 30.0)]


def test_refractory_counts_from_the_last_accepted_point(spark):
    points = series(spark, [1.0] * 10)
    assert sorted(r["t"] for r in events.refractory(points, 3 * S).collect()) == [0, 3 * S, 6 * S, 9 * S]


def test_reference_before_the_first_sample_takes_the_first(spark):
    s = spark.createDataFrame([(1, 10 * S, 4.0, 0), (1, 12 * S, 3.0, 1)], "rec long, t long, y double, seq long")
    found = events.return_to(s, spark.createDataFrame([(1, 9 * S)], "rec long, ref long"), 0.8, 5 * S).collect()
    assert [(r["t"], r["y"]) for r in found] == [(10 * S, 4.0)]


def test_during_needs_no_bucket(spark):
    parents = spark.createDataFrame([(1, 0, 3600 * S)], "rec long, start long, `end` long")
    children = spark.createDataFrame([(1, 1800 * S, 1801 * S, "TRUE")], "rec long, start long, `end` long, truth string")
    assert relations.bind(parents, children, "DURING").first()["c_start"] == 1800 * S


def test_order_comes_before_rounding(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0000001])], "id long, v array<double>")
    assert retrieval.most_similar(rows, [1.0], 1, "id", "v").first()["id"] == 2


def instances(spark, rows):
    return spark.createDataFrame([(1, e, i, t * S, t * S, t * S, truth, 1.0) for i, (e, t, truth) in enumerate(rows)], "rec long, event string, iid long, start long, `end` long, ext long, truth string, value double")


def bound(spark, rows, samples, relation):
    frame = spark.createDataFrame([(1, e, t * S, i) for i, (e, t) in enumerate(samples)], "rec long, event string, t long, seq long")
    return program.bind_tree(instances(spark, rows), frame, "a", [relation]).orderBy("iid").collect()


def test_silence_is_false_only_where_samples_cover_it(spark):
    after = Relation("AFTER", "a", "b", 0, 10 * S)
    log = [("a", 0), ("a", 100)]
    whole = bound(spark, [("a", 20, "TRUE")], log + [("b", t) for t in range(101)], after)[0]
    assert (whole["clauses"][1]["truth"], whole["ordinal"]) == ("FALSE", 0.0)
    gap = bound(spark, [("a", 20, "TRUE")], log + [("b", t) for t in range(101) if not 22 < t < 29], after)[0]
    assert (gap["clauses"][1]["truth"], gap["clauses"][1]["reason"]) == ("UNKNOWN", "OUTSIDE_COVERAGE")
    late = bound(spark, [("a", 95, "TRUE")], log + [("b", t) for t in range(101)], after)[0]
    assert late["clauses"][1]["reason"] == "OUTSIDE_COVERAGE"
    absent = bound(spark, [("a", 20, "TRUE")], log, after)[0]
    assert absent["clauses"][1]["reason"] == "SENSOR_ABSENT_IN_LOG"


def test_true_children_come_before_uncertain_ones(spark):
    after = Relation("AFTER", "a", "b", 0, 10 * S)
    found = bound(spark, [("a", 20, "TRUE"), ("b", 22, "UNKNOWN"), ("b", 25, "TRUE")], [("a", 0), ("b", 0), ("b", 100)], after)[0]
    assert (found["b"]["start"], found["ordinal"], found["definite"]) == (25 * S, 2.0, True)


def test_unbound_parents_leave_children_unknown(spark):
    chain = [Relation("AFTER", "a", "b", 0, 10 * S), Relation("AFTER", "b", "c", 0, 10 * S)]
    frame = spark.createDataFrame([(1, e, t * S, t) for e in "abc" for t in range(60)], "rec long, event string, t long, seq long")
    row = program.bind_tree(instances(spark, [("a", 20, "TRUE"), ("c", 21, "TRUE")]), frame, "a", chain, ("mood",)).first()
    assert [c["reason"] for c in row["clauses"]] == [None, None, "NO_BINDING", "UNEXPRESSIBLE"]
    assert row["ordinal"] == 0.0 and row["end"] == 20 * S


def test_onset_walks_back_to_the_first_motion(spark):
    values = [0.0] * 20 + [0.2, 0.3] + [1.0] * 20
    found = events.onset(series(spark, values), below=0.1, above=0.5, least=5 * S, sustain=3 * S, creep=0.01).collect()
    assert [(r["start"], r["sustained"]) for r in found] == [(20 * S, 22 * S)]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 0{h}:30:00", float(h)) for h in range(6)]
    frame = spark.createDataFrame(rows, "rec long, at string, y double").select("rec", F.to_timestamp("at").alias("ts"), "y")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = windows.hopping_means(stream).writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["start"], r["n"]) for r in spark.table("hops").collect()}
    assert got == {(r["start"], r["n"]) for r in windows.hopping_means(frame).collect()} and got
