"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length into buckets. For a query with threshold theta (its k-th best score so far) a bucket has the local
cosine threshold theta / (|query| * longest member): above 1 the bucket is skipped; from `steep` on, members are pruned by
coordinates (a vector at that angle has each coordinate in a known range, tested on the query's largest ones); below, by length
alone. What remains is verified by exact integer products. Queries are taken in blocks of bounded bytes, each broadcast in turn; a
first pass over the longest buckets gives every query a threshold that all tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST = -(2**63)


def products(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows; those beyond a long are held at its ends."""
    if queries.shape[1] == 0:
        return np.zeros((len(queries), len(members)), np.int64)
    bound = np.abs(queries).max(initial=0.0) * np.abs(members).max(initial=0.0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ members.T).astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(q, m, strict=True)) for m in members] for q in queries], object)
    return np.clip(exact, LEAST + 1, 2**63 - 1).astype(np.int64).reshape(len(queries), len(members))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def packed(vectors: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Rows (id, vec) in runs of equal dimension as (dim, longest, ids, vecs), each run sorted by falling length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            values = np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)
            norm = _norms(values)
            order = np.argsort(-norm, kind="stable")
            ids = np.array([i for i, _ in rows], np.int64)[order]
            columns = [pa.array([dim], pa.int32()), pa.array([float(norm.max())]), pa.array([ids.tobytes()], pa.binary()), pa.array([values[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "longest", "ids", "vecs"])

        for batch in it:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(row), []).append((i, row))
                if len(held[len(row)]) >= rows_per_bucket:
                    yield emit(len(row))
        for dim in list(held):
            yield emit(dim)

    return vectors.mapInArrow(run, "dim int, longest double, ids binary, vecs binary")


class Best:
    """The k best (score, id) of each query of one dimension, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.norm = _norms(values)
        self.unit = values / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        self.least = least.copy()  # scores below take no part
        self.score = [np.empty(0, np.int64) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]

    def put(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.least[q]) & (ids != self.ids[q])
        if not good.any():
            return
        ids, scores = np.r_[self.found[q], ids[good]], np.r_[self.score[q], scores[good]]
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q], self.score[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])

    def see(self, ids: np.ndarray, members: np.ndarray, steep: float, focus: int, block: int = 256) -> None:
        """Compares one bucket, sorted by falling length, with all queries."""
        norm = _norms(members)
        unit = members / np.where(norm > 0, norm, 1.0)[:, None]
        reach = self.norm * norm[0]
        theta = self.least.astype(np.float64)
        local = np.where(theta <= 0, 0.0, np.divide(theta, reach, out=np.full(len(theta), np.inf), where=reach > 0)) * (1 - 1e-9)
        alive = local <= 1
        sharp = alive & (local >= steep)
        for q in np.flatnonzero(sharp):  # coordinate pruning
            t = local[q]
            at = np.argsort(-np.abs(self.unit[q]), kind="stable")[:focus]
            angle, turn = np.arccos(np.clip(self.unit[q][at], -1, 1)), np.arccos(t)
            low = np.where(angle + turn >= np.pi, -1.0, np.cos(np.minimum(angle + turn, np.pi))) - 1e-9
            high = np.where(angle - turn <= 0, 1.0, np.cos(np.maximum(angle - turn, 0))) + 1e-9
            near = np.ones(len(ids), bool)
            for f, a, b in zip(at, low, high, strict=True):
                near &= (unit[:, f] >= a) & (unit[:, f] <= b)
            kept = np.flatnonzero(near)
            if len(kept):
                self.put(q, ids[kept], products(self.values[q : q + 1], members[kept])[0])
        flat = np.flatnonzero(alive & ~sharp)
        for a in range(0, len(flat), block):  # length pruning
            some = flat[a : a + block]
            need = np.where(theta[some] > 0, theta[some] / np.where(self.norm[some] > 0, self.norm[some], 1.0), 0.0).min() * (1 - 1e-9)
            upto = int(np.searchsorted(-norm, -need, side="right"))
            scores = products(self.values[some], members[:upto])
            hits = (scores >= self.least[some][:, None]).any(axis=1)
            for i in np.flatnonzero(hits):
                self.put(some[i], ids[:upto], scores[i])


def _search(buckets: DataFrame, queries, k: int, steep: float, focus: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query per task; queries: broadcast of {dim: (ids, values, least)}."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(*rows, k) for dim, rows in queries.value.items()}
        for batch in it:
            for row in batch.to_pylist():
                if row["dim"] in best:
                    ids = np.frombuffer(row["ids"], np.int64)
                    best[row["dim"]].see(ids, np.frombuffer(row["vecs"], np.float64).reshape(len(ids), row["dim"]), steep, focus)
        for b in best.values():
            for q in range(0, len(b.ids), 1000):
                found = b.found[q : q + 1000]
                of = np.repeat(b.ids[q : q + 1000], [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(found)), pa.array(np.concatenate(b.score[q : q + 1000]))], names=["query_id", "vec_id", "score"])

    return buckets.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    df: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
    rows_per_bucket: int = 1024, block_bytes: int = 16 << 20, steep: float = 0.75, focus: int = 4,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each row whose id column satisfies is_query.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components take no part, nor do rows with a
    null id; vectors of different dimension do not meet; an empty vector scores 0. A query's own row is every row with its id.
    Repeated candidates count once each; a query id that is repeated is answered for its smallest vector. Ties go to the smaller id. An
    empty table, or one without queries, gives an empty result; other columns are ignored. Scores beyond a long stay at its ends.
    """
    spark = df.sparkSession
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.filter(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: _floor(v * float(scale))).alias("vec")).filter("id is not null")
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    ordered = rows.withColumn("length", length).repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
    buckets = materialize(packed(ordered.select("id", "vec"), rows_per_bucket))
    asked = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec"))
    packs = materialize(packed(asked, rows_per_bucket).withColumn("pack", F.monotonically_increasing_id()))
    sizes = packs.select("pack", (F.length("ids") + F.length("vecs")).alias("n")).orderBy("pack").collect()  # a row per 1024 queries
    groups: list[list[int]] = []
    room = 0
    for r in sizes:
        if r["n"] > room:
            groups.append([])
            room = block_bytes
        groups[-1].append(r["pack"])
        room -= r["n"]
    longest = [r[0] for r in buckets.select("longest").orderBy(F.desc("longest")).limit(4).collect()]
    found = None
    for group in groups:
        held: dict[int, list] = {}
        for r in packs.filter(F.col("pack").between(group[0], group[-1])).collect():  # at most block_bytes
            ids = np.frombuffer(r["ids"], np.int64)
            held.setdefault(r["dim"], []).append((ids, np.frombuffer(r["vecs"], np.float64).reshape(len(ids), r["dim"])))
        block = {d: (np.concatenate([i for i, _ in p]), np.concatenate([v for _, v in p])) for d, p in held.items()}
        least = {d: np.full(len(i), LEAST, np.int64) for d, (i, _) in block.items()}
        first = spark.sparkContext.broadcast({d: (*block[d], least[d]) for d in block})
        head = buckets.filter(F.col("longest") >= longest[-1]).orderBy(F.desc("longest")).limit(len(longest))
        known = _ranked(_search(head, first, k, steep, focus), k).filter(F.col("rank") == k).select("query_id", "score").collect()  # a row per query of the block
        at = {d: {int(q): n for n, q in enumerate(block[d][0])} for d in block}
        for q, score in known:
            for d in block:
                if q in at[d]:
                    least[d][at[d][q]] = score
        sent = spark.sparkContext.broadcast({d: (*block[d], least[d]) for d in block})
        part = materialize(_search(buckets, sent, k, steep, focus))
        first.destroy()
        sent.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _floor(v):
    """floor of a double as a double, exact at any size (floor to a long would saturate)."""
    whole = F.rint(v)
    return F.when(whole > v, whole - 1.0).otherwise(whole)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
