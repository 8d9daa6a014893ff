"""Connected components: of a graph by label propagation with pointer jumping, and of points on a grid, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b): label is the smallest vertex of its component. A written table per round."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("low"))
        hooked = labels.join(near, "v").select("v", F.least("label", "low").alias("next"), F.col("label").alias("old"))
        jumped = hooked.join(labels.select(F.col("v").alias("next"), F.col("label").alias("top")), "next", "left")
        now = stored(jumped.select("v", F.least("next", F.coalesce("top", "next")).alias("label"), "old"))
        if now.filter("label <> old").isEmpty():
            return now.select("v", "label")
        labels = now.select("v", "label")


def grid_labels(cells: DataFrame, tile: int = 64) -> DataFrame:
    """cells (scan, i, j), each once, with label: a name that the cells of one 8-connected component of a scan share.

    A task labels a tile, at most tile * tile cells; labels of neighbouring tiles meet along their borders only.
    """

    def label(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        names = np.array(rows.column("name").to_pylist(), object)
        order = np.argsort(names, kind="stable")
        i, j, names = i[order], j[order], names[order]
        low_i, low_j = int(i.min()), int(j.min())
        away = len(i)
        field = np.full((int(i.max()) - low_i + 3, int(j.max()) - low_j + 3), away)
        at = (i - low_i + 1, j - low_j + 1)
        field[at] = np.arange(len(i))
        full = field < away
        while True:
            wide = np.full((field.shape[0] + 2, field.shape[1] + 2), away)
            wide[1:-1, 1:-1] = field
            least = np.minimum.reduce([wide[a : a + field.shape[0], b : b + field.shape[1]] for a in range(3) for b in range(3)])
            least = np.where(full, least, away)
            if (least == field).all():
                break
            field = least
        return pa.table({"scan": rows.column("scan").take(pa.array(order)), "i": pa.array(i), "j": pa.array(j), "local": pa.array(names[field[at]].tolist(), pa.string())})

    scan = cells.schema["scan"].dataType.simpleString()
    named = cells.select("scan", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).withColumn("name", F.concat_ws(":", "scan", "i", "j"))
    tiled = named.withColumn("ti", F.floor(F.col("i") / F.lit(tile))).withColumn("tj", F.floor(F.col("j") / F.lit(tile)))
    local = stored(tiled.groupBy("scan", "ti", "tj").applyInArrow(lambda rows: label(rows), f"scan {scan}, i bigint, j bigint, local string"))
    edge = (F.pmod("i", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("j", F.lit(tile)).isin(0, tile - 1))
    rim = local.filter(edge)
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))))
    reach = rim.select("scan", "i", "j", F.col("local").alias("x"), step.alias("s")).select("scan", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "x")
    met = reach.join(rim, ["scan", "i", "j"]).filter("x < local").select(F.col("x").alias("a"), F.col("local").alias("b")).distinct()
    top = components(met).select(F.col("v").alias("local"), "label")
    return local.join(top, "local", "left").select("scan", "i", "j", F.coalesce("label", "local").alias("label"))


def point_clusters(points: DataFrame, cell: float, least: int, tile: int = 64) -> DataFrame:
    """(scan, label, points, range, bearing, extent) of the clusters of at least `least` points (scan, x, y): nearest point's distance,
    direction of the mean in degrees, larger side of the bounding box."""
    placed = points.withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell))
    labels = grid_labels(placed.select("scan", "i", "j").distinct(), tile)
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    out = placed.join(labels, ["scan", "i", "j"]).groupBy("scan", "label").agg(
        F.count("*").alias("points"), F.min(F.hypot("x", "y")).alias("range"), F.degrees(F.atan2(F.avg("y"), F.avg("x"))).alias("bearing"), side.alias("extent")
    )
    return out.filter(F.col("points") >= least)
