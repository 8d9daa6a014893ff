"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, with DataFrame functions only.

The driver sees one count per input partition and draws, by exact hypergeometric laws, how many rows each partition sends
to each shard; rows are permuted inside their partition (a local sort by a random key), sent, and permuted again inside
their shard. The result is one uniformly random permutation, and every shard has its exact size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_bytes


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Successes among `draws` from an urn, by inversion outward from the mode; works at any size of urn."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    spread = math.sqrt(draws * good / (good + bad) * (bad / (good + bad))) + 1
    reach = int(16 * spread) + 16  # weights beyond are under 1e-50 of the mode's
    down, up, weight = [], [], 1.0
    for k in range(mode, max(low, mode - reach), -1):
        weight *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        down.append(weight)
        if weight < 1e-18:
            break
    weight = 1.0
    for k in range(mode, min(high, mode + reach)):
        weight *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        up.append(weight)
        if weight < 1e-18:
            break
    at = rng.random() * (1.0 + math.fsum(down) + math.fsum(up))
    for k, w in [(mode, 1.0), *((mode - 1 - i, w) for i, w in enumerate(down)), *((mode + 1 + i, w) for i, w in enumerate(up))]:
        at -= w
        if at <= 0:
            return k
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int, most: int = 500_000_000) -> Iterator[list[int]]:
    """Row p: how many rows of partition p go to each shard; rows sum to counts, columns to sizes.

    Runs of partitions with up to `most` rows are drawn first, one exact draw per run and shard; inside a run each partition's row is one
    multivariate draw from what the run has left, some microseconds each. Only one run's rest is held.
    """
    rng, left = random.Random(seed), list(sizes)
    at = 0
    while at < len(counts):
        to, size = at, 0
        while to < len(counts) and (to == at or size + counts[to] <= most):
            size += counts[to]
            to += 1
        run, rest, open_ = [], size, sum(left)
        for n in left:
            open_ -= n
            run.append(hypergeometric(rng, n, open_, rest) if open_ else rest)
            rest -= run[-1]
        left = [a - b for a, b in zip(left, run, strict=True)]
        if size <= most:
            draw, held = np.random.default_rng(rng.getrandbits(64)), np.array(run, np.int64)
            for n in counts[at:to]:
                row = draw.multivariate_hypergeometric(held, n, method="marginals") if n < held.sum() else held.copy()
                held -= row
                yield row.tolist()
        else:  # one partition over `most`
            yield run
        at = to


def shuffle_shards(df: DataFrame, columns: dict[str, Column], shards: int = 24, seed: int = 20, parts: int = 64) -> DataFrame:
    """Gives every row of df a shard (0..shards-1) and a slot (gapless from 0 in the shard); columns: what else to return.

    Shard sizes differ by one row at most (law `rows`). Nulls, empty and long texts, ties and repeated rows are rows like any
    other; an empty table gives an empty result; df's columns that are not asked for are ignored, so clashing names don't
    matter. What goes through the driver is one count per input partition. Inside a shard, rows are dealt over `parts` ranges of
    the random key and numbered there, so no task holds a whole shard.
    """
    spark = df.sparkSession
    names = {f"c{i}": name for i, name in enumerate(columns)}
    keyed = df.select(*(columns[name].alias(c) for c, name in names.items()), F.rand(seed).alias("r1"), F.rand(seed + 2**40).alias("r2"))
    local = keyed.sortWithinPartitions("r1", "r2").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1))
    sent = materialize(local.drop("r1"))
    counts = sorted((r["part"], r["n"]) for r in sent.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], [total // shards + (s < total % shards) for s in range(shards)], seed)
    lines = zip(counts, matrix, strict=True)
    # A row per input partition, written as a table in parts of bounded size: neither a plan nor a broadcast grows with the partitions.
    bounds, step = None, 100_000
    rows: list[tuple] = []
    while bounds is None or rows:
        rows = [(part, list(accumulate(row))) for (part, _), row in islice(lines, step)]
        if rows or bounds is None:
            some = materialize(spark.createDataFrame(rows, "part int, bounds array<bigint>"))
            bounds = some if bounds is None else bounds.union(some)
    # Each row reads only its own partition's bounds: partitions and bounds meet in a narrow join that Spark splits where it is skewed.
    dealt = sent.join(bounds, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("at"))).cast("int")).drop("bounds")
    dealt = dealt.withColumn("range", F.floor(F.col("r2") * parts).cast("int"))
    sizes = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("r2", "part", "at")) - 1
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(firsts), ["shard", "range"])  # shards * parts rows
    return numbered.select(*(F.col(c).alias(name) for c, name in names.items()), F.col("shard"), (F.col("first") + F.col("inside")).alias("slot"))


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 (null text: 0, as of no bytes), law, shard, slot, grown_shard (null: no key law)."""
    crc = F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0).cast("long"))
    out = shuffle_shards(df, {"doc_id": F.col(id_col), "size": n_bytes(F.col(text_col)) + 8, "text_crc32": crc}, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
