"""Mixing follows the target weights themselves, for every source."""

from collections import Counter

import pytest

from chronospan.llm import mixing


def worst_deviation(steps, weights):
    """The largest |blocks done - weight * slots| per phase, by the weights of the sources that phase still has."""
    worst, phases = 0.0, {}
    for s, _, phase, *_ in steps:
        phases.setdefault(phase, []).append(s)
    last = {s: max(p for p, own in phases.items() if s in set(own)) for s in weights}
    for phase, own in phases.items():
        left = {s: w for s, w in weights.items() if last[s] >= phase}
        total, done = sum(left.values()), Counter()
        for t, s in enumerate(own, 1):
            done[s] += 1
            if t % 7 == 0 or t == len(own):
                worst = max(worst, *(abs(done[x] - w * t / total) for x, w in left.items()))
    return worst


def test_deviation_from_the_target_stays_below_one_block():
    blocks = {"a": 93750 // 8, "b": 31250 // 8, "c": 15625 // 8, "d": 6250 // 8, "e": 63 // 8}
    weights = mixing.targets(blocks, None, 0.5)
    assert abs(weights["a"] / weights["b"] - (blocks["a"] / blocks["b"]) ** 0.5) < 1e-12
    steps = list(mixing.phases(blocks, weights))
    assert Counter(x[0] for x in steps) == blocks
    assert [x[3] for x in steps] == list(range(len(steps)))
    assert all(release <= slot < deadline for *_, slot, release, deadline in steps)
    assert worst_deviation(steps, weights) < 1
    rare = {"a": 5000, "b": 3}
    assert worst_deviation(mixing.phases(rare, mixing.targets(rare, {"a": 3000, "b": 1}, 0.5)), {"a": 3000, "b": 1}) < 1


def test_given_weights_are_shares_of_the_whole():
    weights = mixing.targets({"a": 9, "b": 400, "c": 100}, {"a": 0.5}, 0.5)
    total = sum(weights.values())
    assert [round(weights[s] / total, 9) for s in "abc"] == [0.5, round(1 / 3, 9), round(1 / 6, 9)]
    with pytest.raises(ValueError):
        mixing.targets({"a": 9, "b": 4}, {"a": 1.0}, 0.5)


def test_every_source_has_its_own_blocks(spark):
    rows = [(i, f"s{i % 400}") for i in range(4000)] + [(4000 + i, "big") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.plan(frame, block_rows=4, weights={"s399": 0.25}).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i, _ in rows]
    slots = {}
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"]
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert {s for x in slots.values() for s in x} == {(f"s{i}", b) for i in range(400) for b in range(3)} | {("big", b) for b in range(750)}
    assert sorted(t for t, x in slots.items() if next(iter(x))[0] == "s399")[-1] < 12
