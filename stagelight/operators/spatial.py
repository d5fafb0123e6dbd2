"""Distance joins on grid buckets: nearest neighbours, contact edges, mutual matches.

Catalyst plans a distance predicate as a nested loop. Here each side gets the grid cell of its point, the query
side is repeated over its 3x3 neighbour cells, and an equi join on the cell finds every pair within one cell size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.session import cut_lineage

NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
HALF_NEIGHBOURS = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def cell(v: Column | str, size: float) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v / F.lit(float(size))).cast("long")


def explode_cells(df: DataFrame, x: str, y: str, size: float, offsets=NEIGHBOURS) -> DataFrame:
    """Repeat each row over the neighbour cells of its own cell (columns ``_cx``, ``_cy``)."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return (
        df.withColumn("_o", o)
        .withColumn("_cx", cell(x, size) + F.col("_o.i"))
        .withColumn("_cy", cell(y, size) + F.col("_o.j"))
    )


#: Points of the fullest cell of the first search.
CELL_POINTS = 8
#: Halvings of a radius at most; what is then still in one cell lies within 1e-12 of it.
HALVINGS = 40
#: Partitions that cells are dealt to where their pairs are listed: a few rows make many pairs, so the bytes say nothing of the work.
CELL_PARTS = 256


def halvings(points: DataFrame, radius: float, x: str, y: str, group: list[str] | None = None) -> int:
    """How often ``radius`` must be halved until no cell of that side holds more than `CELL_POINTS` of the distinct points."""
    k = 0
    while k < HALVINGS:
        size = float(radius) / 2**k
        most = points.groupBy(*(group or []), cell(x, size), cell(y, size)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= CELL_POINTS:
            break
        # evenly filled cells would need half as many halvings as the count has bits
        k = min(HALVINGS, k + max(1, math.floor(math.log2(most / CELL_POINTS) / 2)))
    return k


def nearest_within(
    query: DataFrame, ref: DataFrame, radius: float, *,
    q: tuple[str, str] = ("x", "y"), r: tuple[str, str] = ("x", "y"),
    rid: str = "ref_id", strict: bool = False, levels: int | None = 1, group: list[str] | None = None,
    spread_ref: bool = False,
) -> DataFrame:
    """Nearest reference point of each distinct query coordinate within ``radius`` (ties: lowest ``rid``).

    Result: group columns, query coordinates, ``rid``, ``dist``. Copies of one coordinate are merged on both sides
    first. With ``levels`` > 1 the search starts at ``radius / 2**(levels-1)`` and only points without a match go
    on to the next size, so a dense cluster never meets a wide cell; the answer is the same. None takes as many levels
    as the fullest cell of the reference needs. ``spread_ref`` repeats the reference over its neighbour cells instead of the query: right when the reference is the smaller side.
    """
    group = group or []
    pts = query.select(*group, F.col(q[0]).cast("double").alias("_qx"), F.col(q[1]).cast("double").alias("_qy")).distinct()
    refs = ref.groupBy(*group, F.col(r[0]).cast("double").alias("_rx"), F.col(r[1]).cast("double").alias("_ry")).agg(
        F.min(rid).alias("_rid")
    )
    if levels is None or levels > 1:
        pts, refs = cut_lineage(pts), cut_lineage(refs)
    if levels is None:
        levels = 1 + halvings(refs, radius, "_rx", "_ry", group)
    found = None
    for level in range(levels):
        size = float(radius) / 2 ** (levels - 1 - level)
        d = F.hypot(F.col("_qx") - F.col("_rx"), F.col("_qy") - F.col("_ry"))
        last = level == levels - 1
        keep = d < size if (strict and last) else d <= size
        own = lambda df, x, y: df.withColumn("_cx", cell(x, size)).withColumn("_cy", cell(y, size))
        wide = lambda df, x, y: explode_cells(df, x, y, size)
        ql, rl = (own, wide) if spread_ref else (wide, own)
        hit = (
            ql(pts, "_qx", "_qy").join(rl(refs, "_rx", "_ry"), [*group, "_cx", "_cy"])
            .where(keep)
            .groupBy(*group, "_qx", "_qy")
            .agg(F.min(F.struct(d.alias("dist"), F.col("_rid").alias(rid))).alias("_m"))
            .select(*group, "_qx", "_qy", F.col(f"_m.{rid}").alias(rid), F.col("_m.dist").alias("dist"))
        )
        if not last:
            hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        if not last:
            pts = pts.join(hit.select(*group, "_qx", "_qy"), [*group, "_qx", "_qy"], "left_anti")
    return found.withColumnRenamed("_qx", q[0]).withColumnRenamed("_qy", q[1])


def contact_edges(df: DataFrame, radius: float, *, id: str = "id", x: str = "x", y: str = "y",
                  group: list[str] | None = None) -> DataFrame:
    """Undirected edges (a < b) between points at most ``radius`` apart; each pair of cells is visited once."""
    group = group or []
    pts = df.select(*group, F.col(id).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    left = explode_cells(pts, "_x", "_y", radius, HALF_NEIGHBOURS).withColumnsRenamed(
        {"_id": "_ia", "_x": "_xa", "_y": "_ya"}
    )
    right = pts.withColumn("_cx", cell("_x", radius)).withColumn("_cy", cell("_y", radius))
    dx, dy = F.col("_xa") - F.col("_x"), F.col("_ya") - F.col("_y")
    dist = F.sqrt(dx * dx + dy * dy)
    same_cell = (F.col("_o.i") == 0) & (F.col("_o.j") == 0)
    keys = [*group, "_cx", "_cy"]
    return (
        left.repartition(CELL_PARTS, *keys).join(right.repartition(CELL_PARTS, *keys), keys)
        .where((dist <= float(radius)) & (~same_cell | (F.col("_ia") < F.col("_id"))))
        .select(*group, F.least("_ia", "_id").alias("a"), F.greatest("_ia", "_id").alias("b"), dist.alias("dist"))
    )


def mutual_nearest(
    src: DataFrame, tgt: DataFrame, radius: float, *, sid: str = "src_id", tid: str = "tgt_id", levels: int | None = None,
) -> DataFrame:
    """Pairs that are each other's nearest within ``radius`` (inclusive); points in ``x``, ``y`` on both sides."""
    s = nearest_within(src, tgt, radius, rid=tid, levels=levels)
    t = nearest_within(tgt, src, radius, rid=sid, levels=levels)
    # ids come back per coordinate, so the lowest id of each copy group stands for it on its own side
    s_id = src.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(sid).alias(sid))
    t_id = tgt.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(tid).alias(tid))
    fwd = s.join(s_id, ["x", "y"]).select(sid, tid, "dist")
    bwd = t.join(t_id, ["x", "y"]).select(sid, tid)
    return fwd.join(bwd, [sid, tid])


def points_in_squares(points: DataFrame, squares: DataFrame, size: float) -> DataFrame:
    """Points (x, y, ...) inside half-open squares (x0, y0): a square of side ``size`` meets at most 4 cells."""
    sq = (
        squares.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                                     for i in (0, 1) for j in (0, 1)])))
        .withColumn("_cx", cell("x0", size) + F.col("_o.i"))
        .withColumn("_cy", cell("y0", size) + F.col("_o.j"))
    )
    pts = points.withColumn("_cx", cell("x", size)).withColumn("_cy", cell("y", size))
    inside = (
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + size)
        & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + size)
    )
    return pts.join(sq, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy", "_o")
