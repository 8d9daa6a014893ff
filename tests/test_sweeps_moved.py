"""What sweeps move between tasks."""

import random

from chronospan.operators import sweeps


def test_swings_need_one_exchange_and_are_the_plain_ones(spark):
    r = random.Random(1)
    rows = [(rec, t, r.choice([None, *map(float, range(0, 40, 3))])) for rec in range(4) for t in range(0, 120, 1 + rec % 2)]
    grid = spark.createDataFrame(rows, "rec long, t long, y double")
    out = sweeps.swings(grid, 4, [4, 8, 12], 10.0, 30.0)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    wanted = set()
    for rec, t, y in rows:
        for n in (4, 8, 12):
            near = [(u, v) for q, u, v in rows if q == rec and t <= u <= t + n]
            values = [v for _, v in near if v is not None]
            if t % 4 == 0 and y is not None and max(u for u, _ in near) == t + n and y - min(values) >= 10 and max(values) - min(values) <= 30:
                wanted.add((rec, t, n, y - min(values), max(values) - min(values)))
    assert {tuple(x) for x in out.collect()} == wanted and wanted
