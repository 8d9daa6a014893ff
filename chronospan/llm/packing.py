"""Best-fit packing by minimum bin slack.

Only lengths decide a packing, and a length is at most the capacity, so the driver plans on a histogram of that many counts:
per bin it takes the longest open length and fills the rest by a bitset subset-sum over the open lengths. The same
combination is taken as often as the counts allow, hence at least one length runs out per combination and the plan has at
most `capacity` combinations at any size of input. Rows then find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import TextIds


def fullest(slack: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of open lengths with the largest sum up to slack, as length -> how often."""
    reach, full, steps = 1, (1 << (slack + 1)) - 1, []
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        left, size = min(counts[length], slack // length), 1
        while left and not reach >> slack & 1:  # 1, 2, 4, ... copies at once
            take = min(size, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & full
            left -= take
            size *= 2
        if reach >> slack & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, copies per bin, first bin, offset in the bin), sorted by length and rank."""
    left, used, rows, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v > (k == seed)}
        chosen = fullest(capacity - seed, rest)
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], n, bins, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return sorted(rows)


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, window: Column | None = None) -> DataFrame:
    """Token pieces of whole texts with their window, the task that made them (part) and their rank there among equal lengths (local)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_texts, part, seen = TextIds(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = end_id.to_bytes(4, "little")
        for rows in it:
            out = [[] for _ in range(6)]
            for i, ids in enumerate(ids_of_texts(rows.column(1))):
                ids += tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]), strict=True):
                        column.append(value)
                    seen[b - a] += 1
            of = pa.array(out[0], pa.int64())
            ids_of, window_of = rows.column(0).take(of), rows.column(2).take(of)
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64()), window_of],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "local", "window"],
            )

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(0) if window is None else window).cast("long").alias("window"))
    return thin.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local long, window long")


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts into sequences of at most `capacity` tokens; one row per piece.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. A text's tokens end with end_id; only texts over the
    capacity are cut, their first piece taking the remainder. Null and empty texts are one piece holding end_id alone;
    repeated rows are packed once each; null ids stay null; an empty table gives an empty result; other columns are ignored.
    Pieces are written once to the shared folder. Equal lengths may hold any share of the rows: ranks come from counts per
    (task, length) and the position inside the task, never from one sort over a length.
    """
    spark = df.sparkSession
    made = materialize(pieces(df, path, capacity, end_id, id_col, text_col))
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_bins(histogram, capacity), "length long, rank0 long, copies long, bin0 long, offset0 long")
    upto = F.lead("rank0").over(Window.partitionBy("length").orderBy("rank0"))
    plan = F.broadcast(plan.withColumn("rank1", F.coalesce(upto, F.lit(2**62))))  # rows: at most capacity combinations of few lengths
    ranked = made.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("local"))
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank1")))
    k = F.col("rank") - F.col("rank0")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin0") + F.floor(k / F.col("copies"))).alias("sequence_id"),
        (F.col("offset0") + F.pmod(k, F.col("copies")) * ranked["length"]).alias("offset"),
    )


BINS = 1 << 23  # sequence numbers that a window has for itself


def pack_in_order(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", window_rows: int = 4096) -> DataFrame:
    """As pack, but within windows of `window_rows` rows in the order in which df is stored, so that an order of documents, such as a mix of
    sources, shows in the order of sequence_id. Each window packs its own pieces; its last sequences stay open, one of several hundred.

    The order is that of df's files by part number and of rows inside; of a df that does not come from files, that of its partitions.
    """
    if df.inputFiles():
        part = F.coalesce(F.try_to_number(F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1), F.lit("99999999")), F.lit(0)).cast("long")
        window = part * (1 << 20) + F.floor(F.col("_metadata.row_index") / window_rows)
    else:
        window = F.spark_partition_id() * (1 << 20) + F.floor(F.monotonically_increasing_id().bitwiseAND(2**33 - 1) / window_rows)
    made = materialize(pieces(df, path, capacity, end_id, id_col, text_col, window))
    kind = made.schema["id"].dataType.simpleString()

    def place(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("length", "ascending"), ("part", "ascending"), ("local", "ascending")])
        rows = rows.take(order)
        length = rows.column("length").to_numpy()
        values, first, n = np.unique(length, return_index=True, return_counts=True)
        plan = np.array(plan_bins(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity), np.int64)
        rank = np.arange(len(length)) - np.repeat(first, n)
        # The plan is sorted by length and rank, and so are the rows: a row's entry is the last one that begins at or before it.
        begin = first[np.searchsorted(values, plan[:, 0])] + plan[:, 1]
        own = plan[np.searchsorted(begin, np.arange(len(length)), side="right") - 1]
        k = rank - own[:, 1]
        sequence = rows.column("window").to_numpy() * BINS + own[:, 3] + k // own[:, 2]
        columns = [rows.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array(sequence), pa.array(own[:, 4] + k % own[:, 2] * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    packed = made.groupBy("window").applyInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
