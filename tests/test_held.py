"""Baselines without a percentile per row, and what ordered operators hold where no onset is asked for."""

import statistics

from chronospan.operators import sequences, sweeps


def test_baseline_is_the_median_and_sorts_plainly(spark):
    rows = [(rec, t, None if t % 7 == 3 else float(t * 37 % 23)) for rec in range(3) for t in range(60)]
    out = sweeps.baseline(spark.createDataFrame(rows, "rec long, t long, y double"), 9, 4)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        near = [y for q, t, y in rows if q == r["rec"] and r["t"] - 9 <= t < r["t"] and y is not None]
        assert r["base"] == (statistics.median(near) if len(near) >= 4 else None)


def test_samples_that_no_onset_needs_are_let_go(spark, monkeypatch):
    longest = []

    class Watched(sequences.deque):
        def append(self, x):
            super().append(x)
            longest.append(len(self))

    monkeypatch.setattr(sequences, "deque", Watched)
    steps = []
    monkeypatch.setattr(sequences, "streamed", lambda rows, order, step, schema: steps.append(step) or spark.createDataFrame([], f"rec long, {schema}"))
    grid = spark.createDataFrame([], "rec long, t long, y double, base double, h double")
    sequences.maneuvers(grid, 2, [4, 8], 2, 1, 5.0)
    sequences.slowdowns(grid, 4, 16, 0.4, 5.0, 0.7, 40, 4, 2, 2, 4)
    assert list(steps[0]((t, 1.0, None, 0.0) for t in range(5000))) == list(steps[1]((t, 1.0, None) for t in range(5000))) == []
    assert max(longest) < 100
