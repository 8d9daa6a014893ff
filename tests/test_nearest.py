"""Nearest items with many probes: memory of a task, and ties between copies."""

import tracemalloc

import numpy as np

from chronospan.operators import retrieval


def wanted(vectors, probes, k):
    score = np.zeros((len(probes), len(vectors)))
    for j in range(vectors.shape[1]):
        score += vectors[probes, j, None] * vectors[None, :, j]
    score[np.arange(len(probes)), probes] = -np.inf
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def test_tiles_hold_little_and_copies_go_by_number():
    r = np.random.default_rng(4)
    vectors = np.tile(r.normal(size=(1000, 16)), (8, 1))  # every vector eight times
    probes = np.arange(0, 8000, 4)
    best = retrieval.Best(probes, vectors[probes], 5)
    tracemalloc.start()
    for c in range(0, 8000, 500):
        for at in range(0, 2000, 500):
            best.meet(np.arange(c, c + 500), vectors[c : c + 500], at, at + 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (best.item == wanted(vectors, probes, 5)).all()
    assert peak < 30 << 20


def test_blocks_and_tiles_of_any_size_give_the_plain_result(spark):
    r = np.random.default_rng(5)
    vectors = np.tile(np.round(r.normal(size=(60, 8)), 3), (3, 1))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item long, v array<double>").repartition(3)
    probes = items.filter("item % 3 = 0").selectExpr("item probe", "v")
    found = retrieval.nearest_of(items, probes, 4, block=25, tile=7).collect()
    ids = np.arange(0, 180, 3)
    assert {(f["probe"], f["item"]) for f in found} == {(int(p), int(i)) for p, row in zip(ids, wanted(vectors, ids, 4), strict=True) for i in row}
    assert len(found) == 4 * len(ids)
