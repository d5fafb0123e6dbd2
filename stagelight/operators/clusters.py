"""Clusters of points that touch, without listing the pairs of a dense place.

All points of a cell of side radius / sqrt(2) touch each other, so a cell is one node and two cells need only one pair that is
close enough. Bounding boxes answer most cell pairs; where they do not, pairs of few points are compared, and boxes of many
points are cut into 4 x 4 parts, of which only the undecided pairs go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.operators.graph import connected_components
from stagelight.session import cut_lineage

#: Pairs of points that are compared at most for one pair of boxes.
PAIRS = 1024
#: Times a cell is cut; boxes are then 4^-15 of a cell and hold copies or next to copies.
DEPTH = 15
#: Half of the cells that can hold a point within the radius.
OFFSETS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]


def boxes_at(points: DataFrame, level: int) -> DataFrame:
    """Occupied boxes of a level (i, j) with bounds and number of points."""
    side = lambda c: F.floor(F.col(c) * float(4**level)).cast("long")
    return points.groupBy(side("u").alias("i"), side("v").alias("j")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"), F.min("id").alias("least"))


def sided(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])


def judged(pairs: DataFrame, radius: float) -> DataFrame:
    """Pairs of boxes that may hold close points, with `sure` where all their points are close."""
    gap = lambda c: F.greatest(F.col(f"{c}0_a") - F.col(f"{c}1_b"), F.col(f"{c}0_b") - F.col(f"{c}1_a"), F.lit(0.0))
    span = lambda c: F.greatest(F.col(f"{c}1_b") - F.col(f"{c}0_a"), F.col(f"{c}1_a") - F.col(f"{c}0_b"))
    return pairs.where(F.hypot(gap("x"), gap("y")) <= radius).withColumn("sure", F.hypot(span("x"), span("y")) <= radius)


def touching_clusters(df: DataFrame, radius: float, *, id: str = "id", x: str = "x", y: str = "y", lone: bool = False) -> DataFrame:
    """(id, component): component is the smallest id that a chain of points, each at most ``radius`` from the next, leads to.

    Points without a neighbour are left out unless ``lone``. Work and rows follow the number of points, however dense they lie.
    """
    side = radius / math.sqrt(2) * (1 - 1e-9)
    place = lambda c: F.col(c).cast("double")
    points = df.select(F.col(id).alias("id"), place(x).alias("x"), place(y).alias("y"), (place(x) / side).alias("u"), (place(y) / side).alias("v")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = cut_lineage(boxes_at(points, 0))
    root = ["ri_a", "rj_a", "ri_b", "rj_b"]

    def rooted(pairs: DataFrame, level: int) -> DataFrame:
        up = lambda c: F.shiftright(F.col(c), 2 * level)
        return pairs.withColumns({f"r{c}_{s}": up(f"{c}_{s}") for s in "ab" for c in "ij"})

    def close_points(pairs: DataFrame, level: int) -> DataFrame:
        """Cell pairs of those box pairs in which some points are close."""
        box = lambda c: F.floor(F.col(c) * float(4**level)).cast("long")
        at = sided(points.select(box("u").alias("i"), box("v").alias("j"), "x", "y"), "a")
        other = sided(points.select(box("u").alias("i"), box("v").alias("j"), "x", "y"), "b")
        met = pairs.select(*root, "i_a", "j_a", "i_b", "j_b").join(at, ["i_a", "j_a"]).join(other, ["i_b", "j_b"])
        return met.where(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) <= radius).select(*root).distinct()

    step = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("di"), F.lit(j).cast("long").alias("dj")) for i, j in OFFSETS]))
    near = sided(cells, "a").withColumn("o", step).withColumns({"i_b": F.col("i_a") + F.col("o.di"), "j_b": F.col("j_a") + F.col("o.dj")}).drop("o")
    level, pairs = 0, rooted(near.join(sided(cells, "b"), ["i_b", "j_b"]), 0)
    links = None
    while True:
        open_pairs = cut_lineage(judged(pairs, radius))
        found = open_pairs.where("sure").select(*root).distinct()
        left = open_pairs.where("NOT sure") if level == 0 else open_pairs.where("NOT sure").join(found, root, "left_anti")
        few = (F.col("n_a") * F.col("n_b") <= PAIRS) | F.lit(level >= DEPTH)
        found = cut_lineage(found.union(close_points(left.where(few), level)).distinct())
        links = found if links is None else links.union(found)
        if left.where(~few).isEmpty():
            break
        left = cut_lineage(left.where(~few).join(found, root, "left_anti").select(*root, "i_a", "j_a", "i_b", "j_b"))
        level += 1
        dense = left.select(F.col("ri_a").alias("ci"), F.col("rj_a").alias("cj")).union(left.select("ri_b", "rj_b")).distinct()
        inside = points.withColumns({"ci": F.floor("u").cast("long"), "cj": F.floor("v").cast("long")}).join(dense, ["ci", "cj"], "left_semi")
        parts = cut_lineage(boxes_at(inside, level).withColumns({"pi": F.shiftright("i", 2), "pj": F.shiftright("j", 2)}))
        parents = left.withColumnsRenamed({c: f"p{c}" for c in ("i_a", "j_a", "i_b", "j_b")})
        pairs = parents.join(sided(parts, "a"), ["pi_a", "pj_a"]).join(sided(parts, "b"), ["pi_b", "pj_b"]).drop("pi_a", "pj_a", "pi_b", "pj_b")

    end = lambda s: cells.select(F.col("i").alias(f"ri_{s}"), F.col("j").alias(f"rj_{s}"), F.col("least").alias(s))
    edges = links.join(end("a"), ["ri_a", "rj_a"]).join(end("b"), ["ri_b", "rj_b"]).select("a", "b")
    label = connected_components(edges).withColumnRenamed("id", "least")
    named = cells.select("i", "j", "n", "least").join(label, "least", "left")
    if not lone:
        named = named.where("component IS NOT NULL OR n > 1")
    named = named.select("i", "j", F.coalesce("component", "least").alias("component"))
    return points.select("id", F.floor("u").cast("long").alias("i"), F.floor("v").cast("long").alias("j")).join(named, ["i", "j"]).select("id", "component")
