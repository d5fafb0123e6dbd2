"""Distances between stage positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.operators.quantile import exact_quantiles
from stagelight.operators.spatial import cell, explode_cells, halvings
from stagelight.session import cut_lineage


def nearest_other_distance(points: DataFrame, radius: float) -> DataFrame:
    """Distance from each distinct coordinate to the nearest other point; copies are at distance 0.

    The search ring starts so small that no cell holds many points and doubles for the points that have no neighbour yet,
    until none is left: few points ever meet a full cell, and distances are exact whatever the radius. NULL only where all points share one coordinate.
    """
    pts = cut_lineage(points.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("_n")))
    found = pts.where("_n > 1").select("x", "y", "_n", F.lit(0.0).alias("dist"))
    left = pts.where("_n = 1").select("x", "y")
    ref = pts.select(F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    box = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    widest = 0.0 if box[0] is None else math.hypot(box[1] - box[0], box[3] - box[2])
    size = float(radius) / 2 ** halvings(pts, radius, "x", "y")
    while True:
        d = F.hypot(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry"))
        hit = (
            explode_cells(left, "x", "y", size)
            .join(ref.withColumn("_cx", cell("_rx", size)).withColumn("_cy", cell("_ry", size)), ["_cx", "_cy"])
            .where((d > 0) & (d <= size)).groupBy("x", "y").agg(F.min(d).alias("dist"))
        )
        hit = cut_lineage(hit)
        found = found.unionByName(hit.select("x", "y", F.lit(1).cast("long").alias("_n"), "dist"))
        left = cut_lineage(left.join(hit, ["x", "y"], "left_anti"))
        if size > widest or left.isEmpty():
            break
        size *= 2
    return found.unionByName(left.select("x", "y", F.lit(1).cast("long").alias("_n"), F.lit(None).cast("double").alias("dist")))


def median_nn_distance(points: DataFrame, radius: float) -> DataFrame:
    """One row: median nearest-neighbour distance over all points (NULL below two points); ``radius`` is only the first ring."""
    d = cut_lineage(nearest_other_distance(points, radius))
    q = exact_quantiles(d, [], "dist", {"median_nn": 0.5}, weight="_n")
    return q.agg(F.max("median_nn").alias("median_nn"))
