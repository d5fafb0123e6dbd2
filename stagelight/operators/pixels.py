"""Operators on long pixel or block tables: (keys..., r, c, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelight.functions.scalar import contrast_stretch, round_even
from stagelight.operators.quantile import attach, exact_quantiles
from stagelight.operators.scan import ordered_scan

# named orientations as (transpose, flip columns, flip rows), applied in this order
ORIENTATIONS = {
    "none": (False, False, False), "fliplr": (False, True, False), "flipud": (False, False, True),
    "transpose": (True, False, False), "rot90": (True, False, True), "rot180": (False, True, True),
    "rot270": (True, True, False),
}


def orient(px: DataFrame, h: int, w: int, *, transpose: bool = True, flip_horizontal: bool = True,
           flip_vertical: bool = False) -> DataFrame:
    """Transpose, then flip columns, then flip rows, as index arithmetic."""
    r, c = (F.col("c"), F.col("r")) if transpose else (F.col("r"), F.col("c"))
    rows, cols = (w, h) if transpose else (h, w)
    c = (cols - 1) - c if flip_horizontal else c
    r = (rows - 1) - r if flip_vertical else r
    return px.withColumn("_r", r).withColumn("_c", c).drop("r", "c").withColumnsRenamed({"_r": "r", "_c": "c"})


def orient_named(px: DataFrame, h: int, w: int, name: str) -> DataFrame:
    if name not in ORIENTATIONS:
        raise ValueError(f"unknown orientation: {name}; known: {sorted(ORIENTATIONS)}")
    t, fh, fv = ORIENTATIONS[name]
    return orient(px, h, w, transpose=t, flip_horizontal=fh, flip_vertical=fv)


def apply_flat_field(px: DataFrame, field: DataFrame, on: list[str]) -> DataFrame:
    """v / field, not below 0; ``field`` is one bounded image per key, joined as Spark sees fit."""
    return px.join(field.withColumnRenamed("v", "_f"), [*on, "r", "c"]).withColumn(
        "v", F.greatest(F.col("v") / F.col("_f"), F.lit(0.0))
    ).drop("_f")


def crop_center(px: DataFrame, h: int, w: int, size: int | None) -> DataFrame:
    """Centre square of side ``size``, clamped to the frame, re-indexed from 0; None keeps the frame."""
    if size is None:
        return px
    nr, nc = min(size, h), min(size, w)
    r0, c0 = (h - nr) // 2, (w - nc) // 2
    return (
        px.where(F.col("r").between(r0, r0 + nr - 1) & F.col("c").between(c0, c0 + nc - 1))
        .withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0)
    )


def crop_border(px: DataFrame, h: int, w: int, border: int) -> DataFrame:
    """Cut the same border on all sides, re-indexed from 0."""
    return (
        px.where(F.col("r").between(border, h - border - 1) & F.col("c").between(border, w - border - 1))
        .withColumn("r", F.col("r") - border).withColumn("c", F.col("c") - border)
    )


def mosaic_border(size: int, non_overlap: float) -> int:
    """Border that leaves the non-overlapping part of a frame (half rounds to even)."""
    return round(size * (1 - non_overlap) / 2)


PROJECTIONS = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}


def z_projection(px: DataFrame, keys: list[str], statistics: list[str]) -> DataFrame:
    """Per-pixel statistics over planes. 16-bit values bound the buffer of the exact median."""
    unknown = set(statistics) - set(PROJECTIONS)
    if unknown:
        raise ValueError(f"unknown projection: {sorted(unknown)}")
    return px.groupBy(*keys, "r", "c").agg(*[PROJECTIONS[s]("v").alias(s) for s in statistics])


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def correlate_axis(img: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """One-dimensional filter along an axis with half-sample mirrored edges."""
    radius = len(kernel) // 2
    a = np.moveaxis(img, axis, -1)
    pad = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(radius, radius)], mode="symmetric")
    out = np.zeros(a.shape, dtype=float)
    for i, k in enumerate(kernel):
        out += k * pad[..., i:i + a.shape[-1]]
    return np.moveaxis(out, -1, axis)


def gaussian_blur(img: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return img.astype(float)
    k = gaussian_kernel(sigma)
    return correlate_axis(correlate_axis(img.astype(float), k, 0), k, 1)


def blur_image(px: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """Gaussian blur of one image per key; a group is one camera frame, never more."""
    if sigma <= 0:
        return px

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        img = pdf.pivot(index="r", columns="c", values="v").sort_index(axis=0).sort_index(axis=1)
        out = pd.DataFrame(gaussian_blur(img.to_numpy(), sigma), index=img.index, columns=img.columns)
        long = out.stack().rename("v").reset_index()
        for k in keys:
            long[k] = pdf[k].iloc[0]
        return long[[*keys, "r", "c", "v"]]

    return px.select(*keys, "r", "c", F.col("v").cast("double").alias("v")).groupBy(*keys).applyInPandas(
        one, schema=T.StructType([*[px.schema[k] for k in keys], px.schema["r"], px.schema["c"], T.StructField("v", T.DoubleType())])
    )


def flat_field(px: DataFrame, keys: list[str], sigma: float = 50.0, normalize_pct: float = 99.99, floor: float = 0.1) -> DataFrame:
    """Mean image, blur, division by its high percentile, floor; also the number of samples per pixel."""
    mean = px.groupBy(*keys, "r", "c").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n_samples"))
    counts = mean.groupBy(*keys).agg(F.max("n_samples").alias("n_samples"))
    smooth = blur_image(mean.select(*keys, "r", "c", "v"), keys, sigma)
    top = exact_quantiles(smooth, keys, "v", {"_top": normalize_pct / 100})
    scaled = attach(smooth, top, keys).withColumn(
        "v", F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.col("v"))
    )
    return attach(scaled.withColumn("v", F.greatest("v", F.lit(float(floor)))).drop("_top"), counts, keys)


def field_convergence(px: DataFrame, rank: str, sizes: list[int]) -> DataFrame:
    """Per sample size: median and p95 of the relative difference (%) to the field of all samples.

    A sample of rank k counts in every size >= k, so one aggregate makes all candidate fields.
    """
    arr = F.array(*[F.lit(int(s)) for s in sizes])
    fields = (
        px.withColumn("size", F.explode(F.filter(arr, lambda s: s >= F.col(rank))))
        .groupBy("size", "r", "c").agg(F.avg("v").alias("f"))
    )
    ref = px.groupBy("r", "c").agg(F.avg("v").alias("ref")).where("ref > 0")
    diff = fields.join(ref, ["r", "c"]).withColumn("d", 100 * F.abs(F.col("f") - F.col("ref")) / F.col("ref"))
    return exact_quantiles(diff, ["size"], "d", {"median_pct": 0.5, "p95_pct": 0.95})


def smallest_size_within(convergence: DataFrame, tolerance_pct: float) -> DataFrame:
    return convergence.agg(F.min(F.when(F.col("median_pct") <= tolerance_pct, F.col("size"))).alias("size"))


def block_mean(px: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Mean of k x k blocks; ragged edge blocks count the missing pixels as 0."""
    return (
        px.groupBy(*keys, F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c"))
        .agg((F.sum("v") / float(k * k)).alias("v"))
    )


def elevation_map(blocks: DataFrame, keys: list[str], z: str, threshold: float) -> DataFrame:
    """Per block the topmost z at or above the threshold, 0 when there is none."""
    top = F.max(F.when(F.col("v") >= threshold, F.col(z).cast("double")))
    return blocks.groupBy(*keys, "r", "c").agg(F.coalesce(top, F.lit(0.0)).alias("z"))


def fov_depth(elevation: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest block per FOV (NULL when none) and the share of non-zero blocks at that depth."""
    top = elevation.groupBy(*keys).agg(F.max("z").alias("_top"))
    return (
        elevation.join(top, keys).groupBy(*keys)
        .agg(
            F.nullif(F.max("_top"), F.lit(0.0)).alias("z_last"),
            F.avg(F.when(F.col("z") > 0, (F.col("z") == F.col("_top")).cast("double"))).alias("share_at_depth"),
        )
    )


def contrast_range(px: DataFrame, group: list[str], lo_pct: float, hi_pct: float) -> DataFrame:
    """Pooled (lo, hi) per group; an empty range gets hi = lo + 1. 16-bit values bound the buffer."""
    q = px.groupBy(*group).agg(F.percentile("v", F.array(F.lit(lo_pct / 100), F.lit(hi_pct / 100))).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return q.select(*group, lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1).alias("hi"))


def log_density(px: DataFrame, tile: str, n_bins: int) -> DataFrame:
    """Density of log10(max(v, 1)) per tile in bins shared by all tiles (bins without pixels are absent)."""
    counts = px.groupBy(tile, "v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_l", F.log10(F.greatest(F.col("v").cast("double"), F.lit(1.0))))
    span = px.agg(F.struct(F.log10(F.greatest(F.min("v").cast("double"), F.lit(1.0))).alias("lo"),
                           F.log10(F.greatest(F.max("v").cast("double"), F.lit(1.0))).alias("hi"))).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / n_bins
    binned = counts.withColumn("_s", span).withColumn(
        "bin", F.least(F.floor((F.col("_l") - F.col("_s.lo")) / width), F.lit(n_bins - 1)).cast("int")
    ).groupBy(tile, "bin").agg(
        F.sum("_n").alias("n"), F.max(width).alias("_w"), F.max(F.col("_s.lo")).alias("_lo"))
    total = binned.groupBy(tile).agg(F.sum("n").alias("_t"))
    return binned.join(total, tile).select(
        tile, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("center"), "n",
        (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"),
    )


def pooled_log_density(density: DataFrame, tile: str) -> DataFrame:
    """Mean density over tiles; a tile without pixels in a bin counts 0."""
    n = density.agg(F.count_distinct(tile)).scalar()
    return density.groupBy("bin").agg(F.max("center").alias("center"), F.sum("density").alias("_d")).select(
        "bin", "center", (F.col("_d") / n).alias("density")
    )


def balanced_log_density(density: DataFrame, signal: DataFrame, tile: str) -> DataFrame:
    """Half the density of pooled empty tiles plus half that of pooled signal tiles (``signal``: tile, is_signal)."""
    d = density.join(signal, tile)
    per = d.groupBy("is_signal", "bin").agg(F.sum("n").alias("n"), F.max("center").alias("center"),
                                            F.max(F.col("n") / F.col("density")).alias("_tw"), F.max(tile).alias("_t"))
    width = density.join(density.groupBy(tile).agg(F.sum("n").alias("_tot")), tile).agg(
        F.max(F.col("n") / (F.col("density") * F.col("_tot")))).scalar()
    total = d.groupBy("is_signal").agg(F.sum("n").alias("_all"))
    return (
        per.join(total, "is_signal").withColumn("_w", width)
        .groupBy("bin").agg(F.max("center").alias("center"), F.sum(0.5 * F.col("n") / (F.col("_all") * F.col("_w"))).alias("density"))
    )


def otsu_threshold(values: DataFrame, keys: list[str], value: str, n_bins: int = 256) -> DataFrame:
    """Otsu split of a value per key: the bin centre with the largest between-class variance; NULL when all are equal.

    The running sums go over at most ``n_bins`` rows per key.
    """
    from pyspark.sql import Window

    v = F.col(value).cast("double")
    span = values.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / width), F.lit(n_bins - 1))).otherwise(0)
    hist = (
        attach(values, span, keys).groupBy(*keys, b.alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .withColumn("_x", F.col("_lo") + (F.col("_b") + 0.5) * width)
    )
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    run = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.select(
        *keys, "_b", "_x", "_lo", "_hi", F.sum("_n").over(run).alias("w1"), F.sum(F.col("_n") * F.col("_x")).over(run).alias("s1"),
        F.sum("_n").over(part).alias("w"), F.sum(F.col("_n") * F.col("_x")).over(part).alias("s"),
    )
    w2, s2 = F.col("w") - F.col("w1"), F.col("s") - F.col("s1")
    var = F.when(w2 > 0, F.col("w1") * w2 * F.pow(F.col("s1") / F.col("w1") - s2 / F.nullif(w2, F.lit(0)), 2))
    s = s.withColumn("_var", F.round(var, 9))
    return s.groupBy(*keys).agg(
        F.when(F.max("_hi") > F.max("_lo"), F.max_by("_x", F.when(F.col("_var").isNotNull(), F.struct(F.col("_var"), -F.col("_b"))))).alias("threshold")
    )


def classify_tiles(px: DataFrame, tile: str, pct: float = 99.0) -> DataFrame:
    """Signal flag per tile by Otsu on the tiles' own high percentile of log10(max(v, 1)); NULL when they do not split."""
    stat = px.groupBy(tile).agg(F.percentile(F.greatest("v", F.lit(1)), F.lit(pct / 100)).alias("_q")).withColumn("stat", F.log10("_q"))
    thr = otsu_threshold(stat, [], "stat")
    flags = attach(stat, thr, []).withColumn("_s", F.col("stat") >= F.col("threshold"))
    both = flags.agg(F.bool_or("_s") & F.bool_or(~F.col("_s"))).scalar()
    return flags.withColumn("_both", both).select(
        tile, "stat", "threshold", F.when(F.col("_both"), F.col("_s")).alias("is_signal"))


def valley_threshold(hist: DataFrame, keys: list[str], min_prominence: float = 0.05) -> DataFrame:
    """Valley between the two most prominent peaks of a log histogram (bin, center, density); NULL below two peaks.

    One group is one histogram (a few hundred bins).
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        y, x = pdf["density"].to_numpy(float), pdf["center"].to_numpy(float)
        found = [(p, q) for p, q in peak_prominences(y) if q >= y.max() * min_prominence]
        out = {k: [pdf[k].iloc[0]] for k in keys}
        top = sorted(p for p, _ in sorted(found, key=lambda t: t[1], reverse=True)[:2])
        out["threshold"] = [float(10 ** x[top[0] + int(np.argmin(y[top[0]:top[1] + 1]))]) if len(top) == 2 else None]
        return pd.DataFrame(out)

    fields = [*[hist.schema[k] for k in keys], T.StructField("threshold", T.DoubleType())]
    return hist.groupBy(*keys).applyInPandas(one, schema=T.StructType(fields))


def peak_prominences(y: np.ndarray) -> list[tuple[int, float]]:
    """Index (middle of a flat top) and prominence of every inner peak."""
    edges = np.flatnonzero(np.r_[True, np.diff(y) != 0])
    ends = np.r_[edges[1:], len(y)]
    found = []
    for i in range(1, len(edges) - 1):
        top = y[edges[i]]
        if top <= y[edges[i - 1]] or top <= y[edges[i + 1]]:
            continue
        higher_left = np.flatnonzero(y[:edges[i]] > top)
        higher_right = np.flatnonzero(y[ends[i]:] > top)
        left = y[(higher_left[-1] + 1 if len(higher_left) else 0):edges[i]].min()
        right = y[ends[i]:(ends[i] + higher_right[0] if len(higher_right) else len(y))].min()
        found.append(((edges[i] + ends[i] - 1) // 2, float(top - max(left, right))))
    return found


def topmost_composite(tiles: DataFrame, px: DataFrame, tile: str, pixel_um: float) -> DataFrame:
    """Canvas cells (row, col, v): where tiles overlap the one with the highest ``zvalue`` wins (then the higher id).

    tiles: id, x_um, y_um (centre), zvalue, h, w, pixel_size_um. A tile is thinned to the canvas pixel first.
    """
    half = lambda n: F.col(n) * F.col("pixel_size_um") / 2
    t = tiles.withColumn("_x0", F.col("x_um") - half("w")).withColumn("_y0", F.col("y_um") - half("h"))
    origin = t.agg(F.struct(F.min("_x0").alias("x"), F.min("_y0").alias("y"))).scalar()
    t = t.withColumn("_o", origin).select(
        tile, "zvalue", F.greatest(F.lit(1), round_even(F.lit(pixel_um) / F.col("pixel_size_um")).cast("int")).alias("_k"),
        round_even((F.col("_x0") - F.col("_o.x")) / pixel_um).cast("int").alias("_col0"),
        round_even((F.col("_y0") - F.col("_o.y")) / pixel_um).cast("int").alias("_row0"),
    )
    placed = px.join(t, tile).where((F.col("r") % F.col("_k") == 0) & (F.col("c") % F.col("_k") == 0)).select(
        (F.col("_row0") + F.floor(F.col("r") / F.col("_k"))).alias("row"),
        (F.col("_col0") + F.floor(F.col("c") / F.col("_k"))).alias("col"), "v", "zvalue", tile,
    )
    return placed.groupBy("row", "col").agg(F.max_by("v", F.struct("zvalue", tile)).alias("v"))


def mosaic_layout(positions: DataFrame, tw: int, th: int, padding: int, scale: float | DataFrame, flip_y: bool = False) -> DataFrame:
    """Top-left pixel of each tile and the canvas size. ``scale`` is a number or a one-value table."""
    p = positions.withColumn("_y", -F.col("y") if flip_y else F.col("y"))
    span = p.agg(F.struct(F.min("x").alias("x0"), F.min("_y").alias("y0"), F.max("x").alias("x1"), F.max("_y").alias("y1"))).scalar()
    k = scale.scalar() if isinstance(scale, DataFrame) else F.lit(float(scale))
    px = lambda v, lo: ((v - lo) * F.col("_k") + padding).cast("int")
    return p.withColumn("_s", span).withColumn("_k", k).select(
        *positions.columns,
        px(F.col("x"), F.col("_s.x0")).alias("px"), px(F.col("_y"), F.col("_s.y0")).alias("py"),
        (px(F.col("_s.x1"), F.col("_s.x0")) + tw + padding).alias("canvas_w"),
        (px(F.col("_s.y1"), F.col("_s.y0")) + th + padding).alias("canvas_h"),
    )


def mosaic_scale(nn: DataFrame, tw: int, th: int, padding: int) -> DataFrame:
    """Pixels per unit from the median nearest-neighbour distance (NULL or 0 gives 1)."""
    d = F.nullif(F.max("median_nn"), F.lit(0.0))
    return nn.agg(F.coalesce((max(tw, th) + padding) / d, F.lit(1.0)).alias("scale"))


def assemble_mosaic(layout: DataFrame, tiles: DataFrame, fov: str, lo_pct: float, hi_pct: float) -> DataFrame:
    """Canvas cells: tiles placed by the layout, the higher FOV overwrites, one shared percentile stretch to 0..255."""
    cells = tiles.join(layout.select(fov, "px", "py"), fov).select(
        (F.col("py") + F.col("r")).alias("row"), (F.col("px") + F.col("c")).alias("col"), fov, "v"
    ).groupBy("row", "col").agg(F.max_by("v", fov).cast("double").alias("v"))
    lim = exact_quantiles(cells, [], "v", {"lo": lo_pct / 100, "hi": hi_pct / 100})
    return attach(cells, lim, []).select("row", "col", "v", contrast_stretch("v", F.col("lo"), F.col("hi")).alias("v8"))


def stitch_by_grid(tiles: DataFrame, grid: DataFrame, fov: str, tile_h: int, tile_w: int, crop: int, *,
                   r0: int = 0, c0: int = 0, n_rows: int, n_cols: int, full: bool = False) -> DataFrame:
    """Cropped tiles at their grid index inside a window; with ``full`` absent cells appear with NULL."""
    h, w = tile_h - 2 * crop, tile_w - 2 * crop
    g = grid.where(F.col("y_idx").between(r0, r0 + n_rows - 1) & F.col("x_idx").between(c0, c0 + n_cols - 1))
    out = crop_border(tiles, tile_h, tile_w, crop).join(g.select(fov, "x_idx", "y_idx"), fov).select(
        ((F.col("y_idx") - r0) * h + F.col("r")).alias("row"), ((F.col("x_idx") - c0) * w + F.col("c")).alias("col"), "v"
    )
    if not full:
        return out
    spark = tiles.sparkSession
    canvas = spark.range(n_rows * h * n_cols * w).select(
        F.floor(F.col("id") / (n_cols * w)).alias("row"), (F.col("id") % (n_cols * w)).alias("col")
    )
    return canvas.join(out, ["row", "col"], "left")


def overlap_correlation(pairs: DataFrame, px: DataFrame, a: str, b: str, frame: str = "frame") -> DataFrame:
    """Pearson r of two aligned images per pair, 0 when either is constant."""
    left = px.select(F.col(frame).alias(a), "r", "c", F.col("v").cast("double").alias("_va"))
    right = px.select(F.col(frame).alias(b), "r", "c", F.col("v").cast("double").alias("_vb"))
    j = pairs.select(a, b).join(left, a).join(right, [b, "r", "c"])
    flat = (F.min("_va") == F.max("_va")) | (F.min("_vb") == F.max("_vb"))
    return j.groupBy(a, b).agg(F.when(flat, F.lit(0.0)).otherwise(F.corr("_va", "_vb")).alias("r"))


def explode_pixels_of(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Long pixels of binary frames (see the raw frame source)."""
    from stagelight.sources.raw_frames import explode_pixels

    return explode_pixels(frames, keys)
