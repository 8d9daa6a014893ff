"""Delta Lloyd: exact integer k-means whose rounds move only what changed.

Vectors are packed in blocks with their owners and distances, and each round writes the blocks anew. A round compares a vector with the
centroids that moved in the round before, or with all of them where its own moved. A task adds up what its vectors carried from one
owner to another, as signed integers; these transfers update the global sums and counts, which are never taken over all vectors again.
Sums travel in limbs of 40 bits, so they are exact for components of any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches, scratch

LIMB = 40
BLOCKS = "ids array<bigint>, code string, vecs binary, owner binary, distance binary, moves array<struct<cluster: int, limb: int, n: bigint, sums: array<bigint>>>"
MOVES = pa.list_(pa.struct([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("code", pa.string()), ("vecs", pa.binary()), ("owner", pa.binary()), ("distance", pa.binary()), ("moves", MOVES)])
MOST = 2**63 - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: longs, or Python's integers where one would not fit."""
    if np.abs(values).max(initial=0.0) < 2.0**45 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def encoded(vecs: np.ndarray) -> tuple[str, bytes]:
    if vecs.dtype == object:
        return "text", ",".join(map(str, vecs.ravel())).encode()
    code = next(c for c in ("<i1", "<i2", "<i4", "<i8") if vecs.size == 0 or (vecs.min() >= np.iinfo(c).min and vecs.max() <= np.iinfo(c).max))
    return code, vecs.astype(code).tobytes()


def decoded(code: str, data: bytes, dim: int) -> np.ndarray:
    if code == "text":
        return np.array([int(x) for x in data.split(b",")], object).reshape(-1, dim)
    return np.frombuffer(data, code).astype(np.int64).reshape(-1, dim)


def distances(vecs: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    reach = max((abs(x) for c in centroids for x in c), default=0) + int(np.abs(vecs).max(initial=0))
    if vecs.dtype != object and reach * reach * vecs.shape[1] < 2**53:  # every step is exact in doubles
        v, c = vecs.astype(np.float64), np.array(centroids, np.float64).reshape(len(centroids), vecs.shape[1])
        return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (v @ c.T)).astype(np.int64)
    own = vecs.astype(object)
    out = np.empty((len(vecs), len(centroids)), object)
    for i, c in enumerate(centroids):
        step = own - np.array(c, object)
        out[:, i] = (step * step).sum(axis=1)
    return out


def reassigned(vecs: np.ndarray, owner: np.ndarray | None, distance: np.ndarray | None, centroids: list[list[int]], moved: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after `moved` centroids changed; ties go to the smaller number. Vectors without an owner meet every centroid."""
    if owner is None or distance is None:
        away = distances(vecs, centroids)
        owner = away.argmin(axis=1).astype(np.int32)
        return owner, away[np.arange(len(vecs)), owner]
    owner, distance = owner.copy(), distance.copy()
    lost = np.isin(owner, moved)
    if lost.any():
        away = distances(vecs[lost], centroids)
        best = away.argmin(axis=1).astype(np.int32)
        owner[lost], distance[lost] = best, away[np.arange(len(best)), best]
    kept = np.flatnonzero(~lost)
    if len(kept) and moved:
        away = distances(vecs[kept], [centroids[m] for m in moved])
        at = away.argmin(axis=1)
        best, near = np.array(moved, np.int32)[at], away[np.arange(len(at)), at]
        won = (near < distance[kept]) | ((near == distance[kept]) & (best < owner[kept]))
        owner[kept[won]], distance[kept[won]] = best[won], near[won]
    return owner, distance


class Transfers:
    """Signed sums and counts that vectors carry between owners."""

    def __init__(self, dim: int):
        self.dim, self.n, self.sums = dim, {}, {}

    def add(self, vecs: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        for owner, sign in ((old, -1), (new, 1)):
            if owner is None:
                continue
            gone = np.ones(len(new), bool) if old is None else old != new
            for c in np.unique(owner[gone]).tolist():
                rows = vecs[gone & (owner == c)]
                self.n[c] = self.n.get(c, 0) + sign * len(rows)
                self.sums[c] = self.sums.get(c, np.zeros(self.dim, object)) + sign * rows.sum(axis=0).astype(object)

    def rows(self) -> list[dict]:
        out = []
        for c, sums in self.sums.items():
            rest, limb = [int(x) for x in sums], 0
            while limb == 0 or any(rest):
                low = [((x + 2 ** (LIMB - 1)) & (2**LIMB - 1)) - 2 ** (LIMB - 1) for x in rest]
                out.append({"cluster": c, "limb": limb, "n": self.n[c] if limb == 0 else 0, "sums": low})
                rest, limb = [(x - y) >> LIMB for x, y in zip(rest, low, strict=True)], limb + 1
        return out


def _packed(dim: int, scale: int, size: int):
    """Blocks (ids, vecs) without owners from batches of (id, vec)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, None, None]]:
        for batch in it:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                yield part.column(0).to_pylist(), integers(values, scale), None, None

    return run


def _stored(dim: int):
    """Blocks from batches of written ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray | None]]:
        for batch in it:
            for row in batch.to_pylist():
                if row["ids"]:
                    vecs = decoded(row["code"], row["vecs"], dim)
                    yield row["ids"], vecs, np.frombuffer(row["owner"], np.int32), np.frombuffer(row["distance"], np.int64) if row["distance"] is not None else None

    return run


def _round(blocks, dim: int, centroids: list[list[int]], moved: list[int]):
    """A function for mapInArrow: the blocks with new owners, and one row of the task's transfers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = Transfers(dim)
        for ids, vecs, old, near in blocks(it):
            owner, distance = reassigned(vecs, None if near is None else old, near, centroids, moved)
            carried.add(vecs, old, owner)
            code, data = encoded(vecs)
            fits = distance.dtype != object or max(distance, default=0) <= MOST
            row = {"ids": ids, "code": code, "vecs": data, "owner": owner.tobytes(), "distance": distance.astype(np.int64).tobytes() if fits else None, "moves": []}
            yield pa.RecordBatch.from_pylist([row], SCHEMA)
        if carried.sums:
            yield pa.RecordBatch.from_pylist([{"ids": [], "code": "", "vecs": b"", "owner": b"", "distance": b"", "moves": carried.rows()}], SCHEMA)

    return run


def _last(blocks, centroids: list[list[int]], moved: list[int]):
    """A function for mapInArrow: a row per vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs, old, near in blocks(it):
            owner, distance = reassigned(vecs, None if near is None else old, near, centroids, moved)
            held = pa.array([min(int(x), MOST) for x in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owner, pa.int32()), held], names=["id", "cluster", "distance"])

    return run


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding", block: int = 256
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that has `dim` components, none null or non-finite.

    Components become floor(scale * x). The first centroids are the k vectors with the smallest sha256 of `seed:id` (fewer vectors: fewer
    centroids); repeated ids are taken by their vectors' order, null ids come last. Equal distances go to the smaller number, empty
    centroids stay. Repeated rows and null ids are kept as they are; other columns are ignored; an empty table gives an empty result.
    Distances and inertias beyond a long are shown as its largest value, but compared exactly.
    """
    spark = df.sparkSession
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = (F.size(F.col(vec_col)) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.filter(whole).select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.withColumn("digest", digest).orderBy(F.asc_nulls_last("digest"), "vec").limit(k).select("vec").collect()
    id_type = df.schema[id_col].dataType
    if not starts:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"`{id_col}` {id_type.simpleString()}, {empty}")
    centroids = [[int(v) for v in integers(np.array(r["vec"], np.float64), scale)] for r in starts]
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    moved = list(range(len(centroids)))
    with row_batches(spark, 512), scratch(spark):
        state, blocks = rows, _packed(dim, scale, block)
        for _ in range(rounds):
            state = materialize(state.mapInArrow(_round(blocks, dim, centroids, moved), BLOCKS))
            blocks = _stored(dim)
            moves = state.select(F.explode("moves").alias("m")).select("m.*")
            placed = moves.select("cluster", "limb", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "limb", "place").agg(F.sum("x").alias("x"))
            for c, limb, place, value in placed.collect():  # k * dim rows a limb
                sums[c][place] += value << (LIMB * limb)
            for c, n in moves.groupBy("cluster").agg(F.sum("n")).collect():
                counts[c] += n
            after = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
            moved = [c for c, (a, b) in enumerate(zip(after, centroids, strict=True)) if a != b]
            centroids = after
        flat = materialize(state.mapInArrow(_last(blocks, centroids, moved), "id long, cluster int, distance long"), keep=True)
    total = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    per = flat.groupBy("cluster").agg(total.alias("i")).collect()  # a row per centroid
    every = min(sum(r["i"] for r in per), MOST)
    shown = [(r["cluster"], r["i"], every, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    totals = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = flat.join(F.broadcast(totals), "cluster")  # at most k rows
    return out.select(F.col("id").cast(id_type).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
