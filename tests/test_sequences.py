"""Ordered operators against plain versions, ranks with extra columns, and the size of relation trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.operators import program, search, sequences
from chronospan.operators.program import Relation


def test_ranks_are_right_with_columns_outside_the_order(spark):
    rows = spark.range(300_000, numPartitions=8).select("id", F.pmod(F.xxhash64("id"), F.lit(5000)).alias("score"), F.concat(F.lit("x"), "id").alias("extra"))
    order = [F.desc("score"), F.col("id")]
    ranked = search.numbered(rows, order)
    got = ranked.agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).first()
    assert tuple(got) == (300_000, 1, 300_000)
    pairs = ranked.select("rank", "score", "id", "extra").orderBy("rank").collect()
    assert all((-p["score"], p["id"]) < (-q["score"], q["id"]) for p, q in zip(pairs, pairs[1:], strict=False))
    assert pairs[7]["extra"] == f"x{pairs[7]['id']}"


def test_a_tree_reads_its_tables_once_per_relation(spark, tmp_path):
    """Scans of the instances grow by one with each relation; everything else reads what was written."""
    path = str(tmp_path / "events")
    spark.range(2000).selectExpr("id % 7 rec", "element_at(array('a', 'b', 'c', 'd', 'e'), cast(id % 5 + 1 as int)) event", "id iid", "id * 60000000 start", "id * 60000000 + 1000 `end`", "id * 60000000 + 500 ext", "'TRUE' truth", "1.0D value").write.parquet(path)
    reads = []

    def counted(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count(path.rsplit("/", 1)[0]) or str(df._jdf.queryExecution().executedPlan()).count(path))
        return stored(df)

    stored, program.stored = program.stored, counted
    try:
        instances = spark.read.parquet(path)
        samples = instances.select("rec", "event", F.col("start").alias("t"), F.col("iid").alias("seq"))
        relations = [Relation("AFTER", "a", "b", 0, 10**10), Relation("AFTER", "b", "c", 0, 10**10), Relation("BEFORE", "c", "d", 0, 10**10), Relation("WITHIN", "d", "e", 0, 10**10)]
        whole = program.bind_tree(instances, program.spans(samples), "a", relations)
    finally:
        program.stored = stored
    last = str(whole._jdf.queryExecution().executedPlan()).count(path)
    assert sum(reads) + last <= 8
    assert whole.count() == 400


def test_merging_is_the_plain_fold(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        a = r.randrange(2000)
        rows.append((i % 3, i, a, a + r.choice([0, 5, 30, 200]), i + 1))
    gap, most, grow = 4, 60, 250
    groups, wanted = [], {}
    for rec, i, a, b, rank in rows:
        for g in groups:
            if g["rec"] != rec or a > g["b"] + gap or b < g["a"] - gap:
                continue
            if rank - 1 >= grow:
                if a < g["b"] and b > g["a"]:
                    break
            elif max(b, g["b"]) - min(a, g["a"]) <= most:
                g["a"], g["b"] = min(a, g["a"]), max(b, g["b"])
                break
        else:
            g = {"rec": rec, "a": a, "b": b, "leader": i, "ids": []}
            groups.append(g)
        g["ids"].append(i)
        wanted[i] = g
    found = sequences.merged_results(spark.createDataFrame(rows, "rec long, id long, start long, end long, rank long").repartition(4), gap, most, grow).collect()
    assert {f["id"]: (f["leader"], f["start"], f["end"], f["n"]) for f in found} == {i: (g["leader"], g["a"], g["b"], len(g["ids"])) for i, g in wanted.items()}
    assert len(found) == 400
    assert {f["leader"]: f["group_rank"] for f in found} == {g["leader"]: n + 1 for n, g in enumerate(groups)}


def plain_tracks(frames, most_miss, least, confirm):
    live, done, n = [], [], 0
    for t, boxes in frames:
        pairs = sorted(((-float(sequences.overlap(np.array([x[1]]), np.array([b]))[0, 0]), i, k) for i, x in enumerate(live) for k, b in enumerate(boxes)))
        used, met = set(), set()
        for score, i, k in pairs:
            if -score >= least and i not in met and k not in used:
                met.add(i)
                used.add(k)
                live[i][1], live[i][3], live[i][4] = boxes[k], t, live[i][4] + 1
                live[i][6] = 0
                if live[i][4] == confirm:
                    live[i][5] = t
        for i, x in enumerate(live):
            if i not in met:
                x[6] += 1
        done += [x for x in live if x[6] > most_miss]
        live = [x for x in live if x[6] <= most_miss]
        for k, b in enumerate(boxes):
            if k not in used:
                live.append([n, b, t, t, 1, None, 0])
                n += 1
    return sorted((x[0], x[2], x[3], x[4], x[5]) for x in done + live)


def test_tracks_are_the_plain_ones(spark):
    r = random.Random(8)
    frames, rows = [], []
    for t in range(80):
        boxes = []
        for k in range(r.choice([0, 1, 3, 5])):
            x = 10.0 * k + r.uniform(-2, 2) + t * 0.3
            boxes.append([x, r.uniform(0, 2), x + r.uniform(6, 9), 9.0 + r.uniform(0, 1)])
        frames.append((t, boxes))
        rows += [(1, t, k, *b) for k, b in enumerate(boxes)] or [(1, t, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "rec long, t long, nr long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    found = sequences.box_tracks(df, 2, 0.3, 3).collect()
    assert sorted((f["track"], f["first"], f["last"], f["n"], f["confirmed"]) for f in found) == plain_tracks(frames, 2, 0.3, 3)


@pytest.mark.parametrize("seed", range(2))
def test_jobs_are_packed_in_order(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 3, 10, 29, 30, 100, 101, 250]) for _ in range(120)]
    job, used, wanted = 0, 0, []
    for w in sizes:
        if not job or used + w > 100:
            job, used = job + 1, 0
        used += w
        wanted.append(job)
    found = sequences.packed_in_order(spark.createDataFrame(list(enumerate(sizes)), "i long, w long").repartition(3), ["i"], "w", 100).collect()
    assert [f["job"] for f in sorted(found, key=lambda f: f["i"])] == wanted


def plain_changes(y, t, amount, within, direction, relative):
    top = max((abs(v) for v in y if v is not None), default=0.0)
    q = {}
    for i, v in enumerate(y):
        later = [k for k in range(i + 1, len(y)) if t[k] <= t[i] + within and y[k] is not None]
        if v is None or not later:
            continue
        low, high = min(later, key=lambda k: (y[k], k)), min(later, key=lambda k: (-y[k], k))
        down, up = v - y[low], y[high] - v
        d, k = (down, low) if direction == "DOWN" or (direction is None and down >= up) else (up, high)
        if relative:
            if abs(v) < 0.25 * top or v == 0:
                continue
            d /= abs(v)
        if d >= amount:
            q[i] = (d, k)
    out, i = [], 0
    while i < len(y):
        if i not in q:
            i += 1
            continue
        j, reach = i, q[i][1]
        while j + 1 in q and j + 1 <= reach:
            j += 1
            reach = max(reach, q[j][1])
        grp = range(i, j + 1)
        pick = max(grp, key=lambda g: ({"DOWN": y[g], "UP": -y[g]}.get(direction, q[g][0]), -g))
        out.append((t[pick], t[q[pick][1]], q[pick][0]))
        i = max(j + 1, q[pick][1])
    return out


@pytest.mark.parametrize(("direction", "relative"), [(None, False), ("DOWN", False), ("UP", True)])
def test_change_episodes_are_the_plain_ones(spark, direction, relative):
    r = random.Random(11)
    rows = {rec: sorted((r.randrange(150), n, r.choice([None, float("nan"), 1.0, 2.0, 3.0, 5.0, -4.0, 0.0])) for n in range(120)) for rec in range(3)}
    df = spark.createDataFrame([(rec, t, n, y) for rec, own in rows.items() for t, n, y in own], "rec long, t long, seq long, y double")
    df = df.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    amount = 0.5 if relative else 3.0
    found = sequences.change_episodes(df.repartition(3), amount, 9, direction, relative).collect()
    for rec, own in rows.items():
        y = [None if v is None or v != v else v for _, _, v in own]
        assert sorted((f["start"], f["end"], f["value"]) for f in found if f["rec"] == rec) == sorted(plain_changes(y, [t for t, _, _ in own], amount, 9, direction, relative))
