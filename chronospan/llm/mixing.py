"""Mixing of sources to target weights by Pfair scheduling.

Documents of a source form blocks. Block j (from 1) of a source of weight w may run from slot floor((j - 1) / w) and must have run by
ceil(j / w); earliest-deadline-first then interleaves the sources so that at every slot each source is less than one block away from
its weight. Weights are exact fractions. When a source runs out and is due, the others go on with their weights scaled up (a new phase,
counted from its first slot); no document is left out. One task plans all blocks of all sources and writes a row for each as it goes,
so it holds a few numbers per source; documents join the plan by source and block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PLAN = "mix_source string, mix_block long, mix_phase int, mix_slot long, mix_release long, mix_deadline long"


def edf(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) by earliest deadline among released blocks, until a source without blocks is due."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # (slot from which it may run, source, block)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), j * total // weights[s], s, j))
        deadline, release, s, j = heapq.heappop(ready)
        if j >= blocks[s]:
            return
        yield s, j, slot, release, deadline
        slot += 1
        heapq.heappush(waiting, (max((j + 1) * total // weights[s], slot), s, j + 1))


def targets(blocks: dict[str, int], weights: dict[str, float] | None, power: float) -> dict[str, int]:
    """Exact weights of the sources with blocks, as whole numbers relative to each other."""
    given = {s: Fraction(weights[s]) for s in blocks if s in (weights or {})}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    rest = {s: Fraction(float(n) ** power) for s, n in blocks.items() if s not in given}
    if given and rest:
        left = 1 - sum(given.values())
        if left <= 0:
            raise ValueError("the given weights leave no share for the other sources")
        total = sum(rest.values())
        rest = {s: left * w / total for s, w in rest.items()}
    exact = given | rest
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def phases(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline) of all blocks by slot."""
    left, used = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    first = phase = 0
    while left:
        slots, taken = 0, dict.fromkeys(left, 0)
        for s, j, slot, release, deadline in edf({s: weights[s] for s in left}, left):
            yield s, used[s] + j, phase, first + slot, first + release, first + deadline
            slots, taken[s] = slot + 1, j + 1
        for s, n in taken.items():
            used[s] += n
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
        first += slots
        phase += 1


def place_in_task(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The place of each row among the task's rows of its source."""
    seen: dict[str, int] = {}
    for sources in parts:
        inside = sources.groupby(sources).cumcount()
        yield inside + sources.map(lambda s: seen.get(s, 0))
        for s, n in sources.value_counts().items():
            seen[s] = seen.get(s, 0) + int(n)


def numbered(df: DataFrame, source_col: str) -> DataFrame:
    """df with its row's task (mix_part), and its place (mix_local) among the task's rows of its source (mix_source, null: '').

    Only sources go to Python.
    """
    thin = df.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("mix_part", F.spark_partition_id())
    return thin.withColumn("mix_local", F.pandas_udf(place_in_task, "long").asNondeterministic()("mix_source"))


def planned(totals: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """A row per block (PLAN); totals: (mix_source, blocks)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, int] = {}
        for rows in it:
            blocks |= zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
        if not blocks:
            return
        steps = phases(blocks, targets(blocks, weights, power))
        while some := list(islice(steps, 20_000)):
            source, block, phase, slot, release, deadline = zip(*some, strict=True)
            columns = [pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(phase, pa.int32()), *(pa.array(x, pa.int64()) for x in (slot, release, deadline))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PLAN.split(", ")])

    return totals.coalesce(1).mapInArrow(run, PLAN)


def interleave(df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", block_rows: int = 32, power: float = 0.5) -> DataFrame:
    """All rows of df with block, phase, release, deadline, slot, place (in the block) and the number of slots as mix_block .. mix_slots, in no order.

    weights: target weight per source, relative to each other if all sources have one. Otherwise they are shares of the whole, and the
    other sources divide what these leave by their number of blocks to the power `power`; it is an error if nothing is left. A null source
    is the source ''; repeated rows are placed once each; an empty table gives an empty result. df's column names must not begin with mix_.
    Rows are numbered per task and source, so a source of any size is never sorted or held by one task.
    """
    rows = materialize(numbered(df, source_col))
    counts = materialize(rows.groupBy("mix_source", "mix_part").agg(F.count("*").alias("n")))
    totals = counts.groupBy("mix_source").agg(F.ceil(F.sum("n") / block_rows).alias("blocks"))
    steps = materialize(planned(totals, weights, power))
    before = Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("mix_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.col("mix_first") + F.col("mix_local")
    placed = rows.join(firsts, ["mix_source", "mix_part"])
    placed = placed.withColumn("mix_block", F.floor(rank / block_rows)).withColumn("mix_place", (rank % block_rows).cast("int"))
    placed = placed.join(steps, ["mix_source", "mix_block"]).crossJoin(F.broadcast(totals.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("mix_slots"))))  # one row
    return placed.select(*(F.col(c) for c in df.columns), "mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_place", "mix_slots")


def plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """One row per row of df: id, source, block (in its source, from 0), phase, release, deadline, slot and place (in the block)."""
    out = interleave(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source")), source_col="source", **options)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *(F.col(f"mix_{c}").alias(c) for c in ("block", "phase", "release", "deadline", "slot", "place")))


def mixed(df: DataFrame, source_col: str = "source", **options) -> DataFrame:
    """The rows of df in mixed order: partitions follow one another by slot and rows inside by slot and place. Columns as they were.

    A slot's partition is computed, so rows move there once and no sample is drawn. Null sources, empty and very long texts, repeated
    rows: as interleave; an empty table gives an empty result.
    """
    spark, names = df.sparkSession, df.columns
    safe = df.toDF(*(f"c{i}" for i in range(len(names))))
    out = interleave(safe, source_col=f"c{names.index(source_col)}", **options)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = F.greatest(F.col("mix_slots"), F.lit(1))
    out = out.withColumn("part", F.least(F.floor(F.col("mix_slot") * parts / slots), F.lit(parts - 1)).cast("int"))
    return out.repartitionById(parts, "part").sortWithinPartitions("mix_slot", "mix_place").select(safe.columns).toDF(*names)
