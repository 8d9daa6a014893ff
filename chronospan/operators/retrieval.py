"""Candidate generators: BM25 over texts, exact inner-product top-k, and the union of generators by candidate id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, stop: tuple[str, ...] = (), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of all rows; query tokens count as often as they occur in the query; no hit scores 0.

    One pass counts each text's tokens and those of the query, as matches inside the text; these numbers are written, and the corpus counts
    and scores come from there. No posting list is shuffled and no text is split.
    """
    import re

    asked = [t for t in re.findall("[a-z0-9]+", query.lower()) if t not in stop]
    words = sorted(set(asked))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    times = lambda pattern: F.regexp_count(low, F.lit(f"(?<![a-z0-9]){pattern}(?![a-z0-9])"))
    n = F.regexp_count(low, F.lit("[a-z0-9]+"))
    if stop:
        n = n - times(f"(?:{'|'.join(sorted(map(re.escape, stop)))})")
    counted = stored(docs.select(F.col(id_col), n.alias("n"), *(times(t).alias(f"tf{i}") for i, t in enumerate(words))))
    stats = counted.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(words))))
    both = counted.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(words):
        idf = F.log(1 + (F.col("total") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + asked.count(t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.greatest("mean", F.lit(1e-9))))
    return both.select(id_col, F.round(score, 6).alias("score"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def most_similar(rows: DataFrame, query: list[float], k: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, score) of the k rows with the largest inner product; ties to the smaller id."""
    q = F.array(*(F.lit(float(v)) for v in query))
    return rows.select(id_col, dot(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k).withColumn("score", F.round("score", 6))


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in order: equal vectors have equal ones."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Best:
    """The k best items of each of some probes, met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.size = np.sqrt((vectors**2).sum(axis=1))
        self.item, self.score = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)

    def meet(self, own: np.ndarray, vectors: np.ndarray, at: int, to: int) -> None:
        """Items against the probes from place `at` to `to`: a matrix product finds those near enough to the k best, whose sums then decide."""
        score = self.vectors[at:to] @ vectors.T
        score[self.ids[at:to, None] == own[None, :]] = -np.inf
        score[~np.isfinite(score)] = -np.inf
        margin = 1e-12 * self.size[at:to] * np.sqrt((vectors**2).sum(axis=1).max(initial=0.0))  # far over the product's rounding
        floor = self.score[at:to, -1]
        near = score >= (floor - margin)[:, None]
        if near.sum() > 4 * self.k * len(near) and score.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
            near = score >= (floor - margin)[:, None]
        i, c = np.nonzero(near & (score > -np.inf))
        if not len(i):
            return
        some = np.unique(i)
        rows = np.r_[i, np.repeat(some, self.k)]
        items = np.r_[own[c], self.item[at + some].ravel()]
        sums = np.r_[_sums(self.vectors[at + i], vectors[c]), self.score[at + some].ravel()]
        order = np.lexsort((items, -sums, rows))
        rows = rows[order]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        keep = order[(begins[:, None] + np.arange(self.k)).ravel()]
        self.item[at + some], self.score[at + some] = items[keep].reshape(-1, self.k), sums[keep].reshape(-1, self.k)


def nearest_of(items: DataFrame, probes: DataFrame, k: int, block: int = 1 << 15, tile: int = 1 << 10) -> DataFrame:
    """(probe, item, score): of each probe (probe, v) the k items (item, v) of largest inner product but itself, ties to the smaller item.

    Probes are a stated set and go to the tasks in blocks of about `block`, one pass over the items each; a task keeps k items a probe and
    compares `tile` probes with `tile` items at once. Every probe meets every item: the time grows with the product of both.
    """
    spark, n = items.sparkSession, max(1, -(-probes.count() // block))
    out = None
    for part in range(n):
        rows = probes.filter(F.pmod(F.xxhash64("probe"), F.lit(n)) == part).select("probe", "v").toArrow()  # about `block` rows
        ids = rows.column("probe").to_numpy().astype(np.int64)
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sent = spark.sparkContext.broadcast((ids, flat.reshape(len(ids), -1) if len(ids) else flat))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Best(*sent.value, k)
            for batch in it:
                own = batch.column(0).to_numpy()
                vectors = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
                for c in range(0, len(own), tile):
                    for at in range(0, len(best.ids), tile):
                        best.meet(own[c : c + tile], vectors[c : c + tile], at, min(at + tile, len(best.ids)))
            hit = np.isfinite(best.score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, hit.sum(axis=1))), pa.array(best.item[hit]), pa.array(best.score[hit])], names=["probe", "item", "score"])

        found = items.select("item", "v").mapInArrow(run, "probe bigint, item bigint, score double") if len(ids) else None
        out = found if out is None else out if found is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "probe bigint, item bigint, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "item")
    return out.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def candidate_id(rec: Column, kind: int, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", rec.cast("string"), F.lit(str(kind)), start.cast("string"), end.cast("string")), 256), 1, 16)


def union_by_id(generators: dict[str, DataFrame]) -> DataFrame:
    """(id, first_stage, score, stages) over generators' (id, score): the first one's score stays, all are listed."""
    parts = [df.select("id", "score", F.lit(i).alias("nr"), F.lit(name).alias("stage")) for i, (name, df) in enumerate(generators.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    seed = F.min(F.struct("nr", "stage", "score"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "stage"))), lambda x: x["stage"]), ",")
    return both.groupBy("id").agg(seed.alias("m"), lines.alias("stages")).select("id", F.col("m.stage").alias("first_stage"), "m.score", "stages")
