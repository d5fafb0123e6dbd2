"""Operators on stage positions and point sets: grid neighbours, exterior, matches, windows, translation votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.operators.quantile import exact_quantiles
from stagelight.operators.scan import ordered_scan
from stagelight.operators.spatial import cell, explode_cells, nearest_within, points_in_squares
from stagelight.session import cut_lineage

DIRECTIONS = {"right": (1, 0), "left": (-1, 0), "up": (0, 1), "down": (0, -1)}
DIAGONALS = {"up_right": (1, 1), "down_right": (1, -1), "up_left": (-1, 1), "down_left": (-1, -1)}


def nearest_position(points: DataFrame, positions: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """FOV nearest to each point within the tolerance; farther gives NULL (count those to decide on an error)."""
    hit = nearest_within(points, positions, tolerance, rid="fov_id", spread_ref=True)
    return points.join(hit, ["x", "y"], "left")


def spots_around(positions: DataFrame, step: float, offsets: dict[str, tuple[int, int]]) -> DataFrame:
    o = F.explode(F.array(*[
        F.struct(F.lit(n).alias("direction"), F.lit(dx * float(step)).alias("dx"), F.lit(dy * float(step)).alias("dy"))
        for n, (dx, dy) in offsets.items()]))
    return positions.withColumn("_o", o).select(
        "fov_id", F.col("_o.direction").alias("direction"), (F.col("x") + F.col("_o.dx")).alias("qx"), (F.col("y") + F.col("_o.dy")).alias("qy"))


def grid_neighbours(positions: DataFrame, step: float, tolerance: float = 0.25, offsets=None) -> DataFrame:
    """(fov_id, direction, neighbour): the FOV nearest to the spot one step away, NULL beyond tolerance * step."""
    spots = spots_around(positions, step, offsets or DIRECTIONS)
    ref = positions.select("x", "y", F.col("fov_id").alias("neighbour"))
    hit = nearest_within(spots, ref, tolerance * step, q=("qx", "qy"), rid="neighbour")
    return spots.join(hit, ["qx", "qy"], "left").select("fov_id", "direction", "neighbour")


def exterior_split(positions: DataFrame, step: float, connectivity: str = "8", tolerance: float = 0.25) -> DataFrame:
    """Flag FOVs with at least one neighbour spot without a FOV."""
    if connectivity not in ("4", "8"):
        raise ValueError(f"connectivity must be '4' or '8', got {connectivity!r}")
    offsets = DIRECTIONS if connectivity == "4" else {**DIRECTIONS, **DIAGONALS}
    n = grid_neighbours(positions, step, tolerance, offsets)
    return n.groupBy("fov_id").agg(F.bool_or(F.col("neighbour").isNull()).alias("exterior"))


def grid_row_col(positions: DataFrame, step: float) -> DataFrame:
    """Grid row and column: (v - min) / step rounded half to even."""
    lo = positions.agg(F.struct(F.min("x").alias("x"), F.min("y").alias("y"))).scalar()
    p = positions.withColumn("_lo", lo)
    return p.withColumn("row", F.bround((F.col("y") - F.col("_lo.y")) / step).cast("int")).withColumn(
        "col", F.bround((F.col("x") - F.col("_lo.x")) / step).cast("int")).drop("_lo")


def complete_blocks(positions: DataFrame, step: float, tolerance: float = 0.25) -> DataFrame:
    """Every FOV with all 8 neighbours, one column per direction; a diagonal goes by the vertical neighbour first."""
    nb = cut_lineage(
        grid_neighbours(positions, step, tolerance).groupBy("fov_id").agg(
            *[F.max(F.when(F.col("direction") == d, F.col("neighbour"))).alias(d) for d in DIRECTIONS])
    )
    out = nb.where(" and ".join(f"{d} is not null" for d in DIRECTIONS)).withColumnRenamed("fov_id", "center")
    for vertical in ("up", "down"):
        v = nb.select(F.col("fov_id").alias(vertical), F.col("left").alias(f"_{vertical}_l"), F.col("right").alias(f"_{vertical}_r"))
        out = out.join(v, vertical)
    for side in ("left", "right"):
        h = nb.select(F.col("fov_id").alias(side), F.col("up").alias(f"_{side}_u"), F.col("down").alias(f"_{side}_d"))
        out = out.join(h, side)
    diag = {
        "up_left": ("_up_l", "_left_u"), "up_right": ("_up_r", "_right_u"),
        "down_left": ("_down_l", "_left_d"), "down_right": ("_down_r", "_right_d"),
    }
    out = out.select("center", *DIRECTIONS, *[F.coalesce(a, b).alias(n) for n, (a, b) in diag.items()])
    return out.where(" and ".join(f"{d} is not null" for d in diag))


def first_complete_block(positions: DataFrame, step: float, order: str = "fov_id", tolerance: float = 0.25) -> DataFrame:
    """The first complete block by the given order of FOVs (top-1, not a sort)."""
    b = complete_blocks(positions, step, tolerance)
    if order == "fov_id":
        return b.orderBy("center").limit(1)
    return b.join(positions.select(F.col("fov_id").alias("center"), F.col(order).alias("_ord")), "center").orderBy("_ord", "center").limit(1).drop("_ord")


def graph_consistency(pairs: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, min_fraction: float = 0.5,
                      sid: str = "src_id", tid: str = "tgt_id") -> DataFrame:
    """Keep a pair when enough of the source's neighbours match neighbours of its target; no neighbours keeps it."""
    pairs = cut_lineage(pairs)
    both = lambda e, p, q: e.select(F.col("a").alias(p), F.col("b").alias(q)).union(e.select("b", "a"))
    s = both(src_edges, sid, "_sn")
    matched = pairs.select(F.col(sid).alias("_sn"), F.col(tid).alias("_tn"))
    t = both(tgt_edges, tid, "_tn").withColumn("_hit", F.lit(1))
    around = pairs.join(s, sid).join(matched, "_sn", "left").join(t, [tid, "_tn"], "left")
    share = around.groupBy(sid, tid).agg((F.count("_hit") / F.count(F.lit(1))).alias("_share"))
    return pairs.join(share, [sid, tid], "left").where(F.col("_share").isNull() | (F.col("_share") >= min_fraction)).select(*pairs.columns)


def consistent_within(pairs: DataFrame, src: DataFrame, tgt: DataFrame, radius: float, min_fraction: float = 0.5,
                      sid: str = "src_id", tid: str = "tgt_id") -> DataFrame:
    """`graph_consistency` on the contact graphs of ``radius`` without listing their edges.

    Copies of a point are one place with a count, and pairs are measured against places and pairs of near cells, so work follows
    the distinct places and not the copies. A pair's own source isn't its neighbour; its copies are.
    """
    at = lambda df, k, p: df.select(F.col(k), F.col("x").cast("double").alias(f"{p}x"), F.col("y").cast("double").alias(f"{p}y"))
    own = cut_lineage(pairs.select(sid, tid).join(at(src, sid, "s"), sid).join(at(tgt, tid, "t"), tid))
    places = at(src, sid, "p").groupBy("px", "py").agg(F.count("*").alias("n"))
    size, r2 = radius / 2, float(radius) * float(radius)
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    here = lambda df, x, y: df.withColumn("_cx", cell(x, size)).withColumn("_cy", cell(y, size))
    near = lambda a, b, c, d: (F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(d)) * (F.col(b) - F.col(d)) <= r2
    around = explode_cells(own, "sx", "sy", size, offsets).drop("_o")
    seen = around.join(here(places, "px", "py"), ["_cx", "_cy"]).where(near("sx", "sy", "px", "py")).groupBy(sid, tid).agg((F.sum("n") - 1).alias("_all"))
    others = here(own.select(F.col(sid).alias("_os"), F.col(tid).alias("_ot"), F.col("sx").alias("ox"), F.col("sy").alias("oy"), F.col("tx").alias("ux"), F.col("ty").alias("uy")), "ox", "oy")
    held = around.join(others, ["_cx", "_cy"]).where(near("sx", "sy", "ox", "oy") & near("tx", "ty", "ux", "uy") & (F.col(sid) != F.col("_os")) & (F.col(tid) != F.col("_ot")))
    hits = held.groupBy(sid, tid).agg(F.count("*").alias("_hits"))
    share = seen.join(hits, [sid, tid], "left").select(sid, tid, (F.coalesce("_hits", F.lit(0)) / F.nullif(F.col("_all"), F.lit(0))).alias("_share"))
    return pairs.join(share, [sid, tid], "left").where(F.col("_share").isNull() | (F.col("_share") >= min_fraction)).select(*pairs.columns)


def match_channels(spots: DataFrame, ref_color: int, colors: list[int], tol_px: float, pixel_um: float,
                   group: list[str] | None = None) -> DataFrame:
    """Reference spots found in every channel, one column triple per channel, in µm.

    spots: color, spot_id (reading order), x_px, y_px, z_um. Each spot goes to its nearest reference spot (strictly
    within the tolerance); per reference and colour the closest spot is kept. A group is one field of view.
    """
    group = group or []
    ref = spots.where(F.col("color") == ref_color)
    rest = spots.where(F.col("color") != ref_color)
    near = nearest_within(rest, ref.select(*group, "x_px", "y_px", F.col("spot_id").alias("ref_id")), tol_px,
                          q=("x_px", "y_px"), r=("x_px", "y_px"), rid="ref_id", strict=True, group=group, levels=None)
    found = rest.join(near, [*group, "x_px", "y_px"]).groupBy(*group, "ref_id", "color").agg(
        F.min_by(F.struct("x_px", "y_px", "z_um"), F.struct("dist", "spot_id")).alias("p"))
    own = ref.select(*group, F.col("spot_id").alias("ref_id"), "color", F.struct("x_px", "y_px", "z_um").alias("p"))
    val = lambda c, f: F.max(F.when(F.col("color") == c, F.col(f"p.{f}")))
    cols = [(val(c, f) * (pixel_um if f != "z_um" else 1.0)).alias(f"{c}_{n}") for c in sorted(colors) for f, n in (("x_px", "x"), ("y_px", "y"), ("z_um", "z"))]
    wide = found.unionByName(own).groupBy(*group, "ref_id").agg(F.count_distinct("color").alias("_n"), *cols).where(F.col("_n") == len(colors)).drop("_n")
    return ordered_scan(wide, group, ["ref_id"], row_number="_rn").withColumn("bead_id", F.col("_rn") - 1).drop("_rn")


def translation_vote(src: DataFrame, tgt: DataFrame, keys: list[str], max_shift: float = 1024.0, bin_px: float = 4.0) -> DataFrame:
    """Translation from target to source per key by the peak of the displacement histogram, refined near the peak.

    Points are (keys, row, col). Copies of a point are merged with a weight; displacements are joined on cells of
    ``max_shift`` and counted where they are made, so only bins are shuffled. The refinement joins on small cells.
    """
    def weigh(df, p):
        return df.groupBy(*keys, F.col("row").cast("double").alias(f"{p}r"), F.col("col").cast("double").alias(f"{p}c")).agg(
            F.count(F.lit(1)).alias(f"{p}w"))

    s, t = weigh(src, "s"), weigh(tgt, "t")
    n_bins = max(1, int(2 * max_shift / bin_px))
    width = 2 * max_shift / n_bins
    dy, dx, w = F.col("sr") - F.col("tr"), F.col("sc") - F.col("tc"), F.col("sw") * F.col("tw")
    index = lambda d: F.least(F.floor((d + max_shift) / width), F.lit(n_bins - 1)).cast("int")
    votes = (
        explode_cells(s, "sr", "sc", max_shift)
        .join(t.withColumn("_cx", cell("tr", max_shift)).withColumn("_cy", cell("tc", max_shift)), [*keys, "_cx", "_cy"])
        .where((F.abs(dy) <= max_shift) & (F.abs(dx) <= max_shift))
        .groupBy(*keys, index(dy).alias("iy"), index(dx).alias("ix")).agg(F.sum(w).alias("n"))
    )
    centre = lambda i: (F.col(f"_p.{i}") + 0.5) * width - max_shift
    peak = votes.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("iy")).alias("niy"), (-F.col("ix")).alias("nix"))).alias("_m")).select(
        *keys, F.struct((-F.col("_m.niy")).alias("iy"), (-F.col("_m.nix")).alias("ix")).alias("_p")
    ).select(*keys, centre("iy").alias("dy0"), centre("ix").alias("dx0"))
    peak = cut_lineage(peak)
    r = 2 * bin_px
    moved = s.join(peak, keys).withColumn("_er", F.col("sr") - F.col("dy0")).withColumn("_ec", F.col("sc") - F.col("dx0"))
    near = (
        explode_cells(moved, "_er", "_ec", r).join(t.withColumn("_cx", cell("tr", r)).withColumn("_cy", cell("tc", r)), [*keys, "_cx", "_cy"])
        .where((F.abs(dy - F.col("dy0")) < r) & (F.abs(dx - F.col("dx0")) < r))
        .groupBy(*keys).agg((F.sum(dy * w) / F.sum(w)).alias("dy"), (F.sum(dx * w) / F.sum(w)).alias("dx"), F.sum(w).alias("n_inliers"))
    )
    sizes = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_src")).join(
        tgt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tgt")), keys, "full")
    out = sizes.join(peak, keys, "left").join(near, keys, "left")
    smaller = F.greatest(F.least(F.coalesce("n_src", F.lit(0)), F.coalesce("n_tgt", F.lit(0))), F.lit(1))
    n_in = F.coalesce("n_inliers", F.lit(0))
    return out.select(
        *keys, F.coalesce("dy", "dy0").alias("dy"), F.coalesce("dx", "dx0").alias("dx"), n_in.cast("long").alias("n_inliers"),
        (n_in / smaller).alias("score"), F.coalesce("n_src", F.lit(0)).alias("n_src"), F.coalesce("n_tgt", F.lit(0)).alias("n_tgt"))


def window_point_features(points: DataFrame, windows: DataFrame, size: float) -> DataFrame:
    """Per half-open square window: n, median, q10 and q90 of volume, share below 20 and above 1000; empty gives n = 0.

    Windows at one place are measured once.
    """
    places = cut_lineage(windows.groupBy("x0", "y0").agg(F.min("window_id").alias("place")))
    inside = points_in_squares(points, places, size)
    q = exact_quantiles(inside, ["place"], "volume", {"vol_med": 0.5, "vol_q10": 0.1, "vol_q90": 0.9})
    n = inside.groupBy("place").agg(
        F.count(F.lit(1)).alias("_n"), F.avg((F.col("volume") < 20).cast("double")).alias("frac_small"),
        F.avg((F.col("volume") > 1000).cast("double")).alias("frac_large"))
    measured = places.join(n, "place").join(q, "place").drop("place")
    return windows.select("window_id", "x0", "y0").join(measured, ["x0", "y0"], "left").drop("x0", "y0").withColumn(
        "n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def flag_points_by_square(squares: DataFrame, points: DataFrame, square: float, n_squares: int) -> DataFrame:
    """Square (i, j) of each point in its own FOV and its quality by the square's score.

    squares: fov, i, j, x0, y0, score, removed; points: fov, x, y. The FOV origin follows from any of its squares.
    """
    origin = squares.groupBy("fov").agg(F.min(F.col("x0") - F.col("j") * square).alias("_ox"), F.min(F.col("y0") - F.col("i") * square).alias("_oy"))
    clip = lambda v: F.coalesce(F.least(F.greatest(F.floor(v / square), F.lit(0)), F.lit(n_squares - 1)), F.lit(-1)).cast("int")
    p = points.join(origin, "fov", "left").withColumn("i", clip(F.col("y") - F.col("_oy"))).withColumn("j", clip(F.col("x") - F.col("_ox"))).drop("_ox", "_oy")
    out = p.join(squares.select("fov", "i", "j", "score", "removed"), ["fov", "i", "j"], "left")
    return out.withColumn(
        "quality", F.when(F.col("score").isNull(), "no score").when(F.col("removed"), "damaged").otherwise("good")).drop("removed")
