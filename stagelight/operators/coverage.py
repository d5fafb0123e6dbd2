"""Areas on a cell raster and polygon coverage of square fields of view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.operators.graph import connected_components
from stagelight.operators.pixels import gaussian_kernel, otsu_threshold
from stagelight.operators.scan import ordered_scan
from stagelight.session import cut_lineage

Ring = list[tuple[float, float]]


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    """Steps (row, column) to all pixels within the radius."""
    side = range(-radius, radius + 1)
    return [(a, b) for a in side for b in side if a * a + b * b <= radius * radius]


def square_areas(ring: np.ndarray, x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """Area of a polygon inside each square, exactly: the polygon boundary is integrated with x and y clipped.

    For every edge, the part at a given height contributes its clipped x; summing signed strips gives the area.
    """
    total = np.zeros(len(x))
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        if y1 == y2:
            continue
        lo, hi = np.clip([min(y1, y2)] * len(y), y - half, y + half), np.clip([max(y1, y2)] * len(y), y - half, y + half)
        slope = (x2 - x1) / (y2 - y1)
        left, right = x - half, x + half
        at = lambda h: x1 + slope * (h - y1)
        # heights where the edge crosses the sides of the square split it into linear pieces
        cuts = [lo, hi]
        if slope != 0:
            cuts += [np.clip(y1 + (left - x1) / slope, lo, hi), np.clip(y1 + (right - x1) / slope, lo, hi)]
        cuts = np.sort(np.stack(cuts), axis=0)
        part = np.zeros(len(x))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part += (np.clip(at((a + b) / 2), left, right) - left) * (b - a)
        total += np.sign(y2 - y1) * part
    return np.abs(total)


def touches(ring: np.ndarray, x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """Whether each closed square shares a point with the polygon."""
    hit = square_areas(ring, x, y, half) > 0
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        # clip the edge parameter to the square on both axes
        t0, t1 = np.zeros(len(x)), np.ones(len(x))
        for p, d, c in ((x1, x2 - x1, x), (y1, y2 - y1, y)):
            if d == 0:
                out = (p < c - half) | (p > c + half)
                t0 = np.where(out, 2.0, t0)
            else:
                a, b = (c - half - p) / d, (c + half - p) / d
                t0, t1 = np.maximum(t0, np.minimum(a, b)), np.minimum(t1, np.maximum(a, b))
        hit |= t0 <= t1
    return hit


def disjoint_parts(rings: list[Ring]) -> list[Ring]:
    """The union of polygons as convex quads that do not overlap: strips between the heights of vertices and crossings."""
    edges = [(k, *a, *b) for k, r in enumerate(rings) for a, b in zip(r, [*r[1:], r[0]]) if a[1] != b[1]]
    edges = [(k, *((x0, y0, x1, y1) if y0 < y1 else (x1, y1, x0, y0))) for k, x0, y0, x1, y1 in edges]
    at = lambda e, y: e[1] + (e[3] - e[1]) * (y - e[2]) / (e[4] - e[2])
    heights = {y for e in edges for y in (e[2], e[4])}
    for i, e in enumerate(edges):
        for f in edges[:i]:
            lo, hi = max(e[2], f[2]), min(e[4], f[4])
            if lo < hi and (d := at(e, lo) - at(f, lo)) * (g := at(e, hi) - at(f, hi)) < 0:
                heights.add(lo + (hi - lo) * d / (d - g))
    out, ys = [], sorted(heights)
    for lo, hi in zip(ys, ys[1:]):
        mid, inside, left = (lo + hi) / 2, set(), None
        for e in sorted((e for e in edges if e[2] <= lo and e[4] >= hi), key=lambda e: at(e, mid)):
            before = bool(inside)
            inside ^= {e[0]}
            if not before and inside:
                left = e
            elif before and not inside:
                out.append([(at(left, lo), lo), (at(e, lo), lo), (at(e, hi), hi), (at(left, hi), hi)])
    return out


def coverage_filter(fovs: DataFrame, boundary: Ring, holes: list[Ring], fov_size: float, min_fraction: float = 0.0,
                    subsets: list[Ring] | None = None) -> DataFrame:
    """Keep square FOVs (x, y centre) over tissue; polygons are small and travel with the tasks.

    min_fraction 0: the square meets the boundary and the union of the holes does not cover it. Otherwise: area inside
    the boundary and outside that union over the square's area reaches the fraction. Holes may overlap or repeat.
    With ``subsets`` the square must also meet one of them.
    """
    half, full = fov_size / 2.0, fov_size * fov_size
    outer, inner = np.array(boundary, float), [np.array(q, float) for q in disjoint_parts(holes)]
    wanted = [np.array(s, float) for s in subsets or []]

    @F.pandas_udf("boolean")
    def keep(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y = xs.to_numpy(float), ys.to_numpy(float)
        if min_fraction <= 0:
            ok = touches(outer, x, y, half)
            if inner:
                ok &= sum(square_areas(h, x, y, half) for h in inner) < full * (1 - 1e-9)
        else:
            area = square_areas(outer, x, y, half)
            for h in inner:
                area = area - square_areas(h, x, y, half)
            ok = area / full >= min_fraction
        if wanted:
            ok &= np.logical_or.reduce([touches(w, x, y, half) for w in wanted])
        return pd.Series(ok)

    return fovs.where(keep(F.col("x").cast("double"), F.col("y").cast("double")))


def cell_spans(fov_size: float, cell_um: float) -> list[Column]:
    """First and last row and column (r0, r1, c0, c1) of the cells whose centre lies in the square of a FOV."""
    first = lambda v: F.ceil((F.col(v) - fov_size / 2) / cell_um - 0.5).cast("long")
    last = lambda v: F.floor((F.col(v) + fov_size / 2) / cell_um - 0.5).cast("long")
    return [first("y").alias("r0"), last("y").alias("r1"), first("x").alias("c0"), last("x").alias("c1")]


def cells_of_fovs(fovs: DataFrame, fov_size: float, cell_um: float) -> DataFrame:
    """(fov_id, r, c): the cells whose centre lies in the square of each FOV; a FOV covers a fixed number of cells."""
    return cells_of_spans(fovs.select("fov_id", *cell_spans(fov_size, cell_um)))


def cells_of_spans(spans: DataFrame) -> DataFrame:
    return spans.select("fov_id", F.explode(F.sequence("r0", "r1")).alias("r"), F.sequence("c0", "c1").alias("_c")).select("fov_id", "r", F.explode("_c").alias("c"))


#: Cells of the FOVs that are decided together in one task.
DECIDED_AT_ONCE = 1 << 20


def decide_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """(fov_id, removed) of FOVs in id order: removed while every cell of it still has two; `left` is the number before this block."""
    rows = rows.sort_values("fov_id", kind="stable")
    cell, _ = pd.factorize(pd.MultiIndex.from_frame(rows[["r", "c"]]))
    left = np.zeros(cell.max() + 1, np.int64)
    left[cell] = rows["left"].to_numpy()
    ids, start = np.unique(rows["fov_id"].to_numpy(), return_index=True)
    removed = np.zeros(len(ids), bool)
    for k, own in enumerate(np.split(cell, start[1:])):
        if (left[own] >= 2).all():
            left[own] -= 1
            removed[k] = True
    return pd.DataFrame({"fov_id": ids, "removed": removed})


def redundant_fovs(fovs: DataFrame, tissue: DataFrame, fov_size: float, cell_um: float, at_once: int | None = None) -> DataFrame:
    """(fov_id, detected, removed): detected when no tissue cell is covered by the FOV alone; removed in id order while still redundant.

    FOVs on the same cells are one class: in id order all but the last of them go, since that last one still covers what they cover, so
    only the last takes part below. Classes without common cells do not meet: a component of overlapping detected FOVs is cut into blocks of ``at_once`` FOVs in id
    order (so many that their cells fit a task). Round k decides block k of every component, each in one task, from the cell counts that the
    earlier blocks left, which is the sequential rule at any length; rounds grow with the largest component over the block size.
    """
    spans = F.sort_array(F.collect_set(F.struct(*cell_spans(fov_size, cell_um)))).alias("spans")
    own = cut_lineage(fovs.groupBy("fov_id").agg(spans))
    classes = cut_lineage(own.groupBy("spans").agg(F.max("fov_id").alias("last"), F.count("*").alias("copies")))
    shapes = classes.select(F.col("last").alias("fov_id"), "copies", F.explode("spans").alias("s"))
    cover = cells_of_spans(shapes.select("fov_id", "s.*")).join(tissue.select("r", "c").distinct(), ["r", "c"]).distinct()
    cover = cut_lineage(cover.join(classes.select(F.col("last").alias("fov_id"), "copies"), "fov_id"))
    count = cover.groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("copies").alias("fovs"))
    alone = cover.join(count.where("fovs = 1"), ["r", "c"]).select("fov_id").distinct()
    detected = classes.select(F.col("last").alias("fov_id")).join(alone, "fov_id", "left_anti")
    live = cut_lineage(cover.drop("copies").join(detected, "fov_id").join(count.drop("fovs"), ["r", "c"]))
    first = live.groupBy("r", "c").agg(F.min("fov_id").alias("first"))
    parts = connected_components(live.join(first, ["r", "c"]).select("fov_id", "first").distinct(), "fov_id", "first")
    size = at_once or max(1, int(DECIDED_AT_ONCE // (fov_size / cell_um + 1) ** 2))
    numbered = ordered_scan(parts.select(F.col("id").alias("fov_id"), "component"), ["component"], ["fov_id"], row_number="_rn")
    blocks = cut_lineage(numbered.select("fov_id", "component", F.floor((F.col("_rn") - 1) / size).alias("block")))
    last = blocks.agg(F.max("block")).first()[0]
    decided = taken = None
    for k in range(-1 if last is None else last + 1):
        rows = live.join(blocks.where(F.col("block") == k), "fov_id")
        if taken is not None:
            rows = rows.join(taken, ["r", "c"], "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0)))
        kind = fovs.schema["fov_id"].dataType.simpleString()
        out = cut_lineage(rows.select("component", "fov_id", "r", "c", F.col("n").alias("left")).groupBy("component").applyInPandas(decide_in_order, f"fov_id {kind}, removed boolean"))
        used = live.join(out.where("removed"), "fov_id").groupBy("r", "c").agg(F.count("*").alias("used"))
        taken = used if taken is None else taken.unionByName(used).groupBy("r", "c").agg(F.sum("used").alias("used"))
        if last:
            taken = cut_lineage(taken)
        decided = out if decided is None else decided.unionByName(out)
    flags = detected.withColumn("detected", F.lit(True))
    if decided is not None:
        flags = flags.join(decided, "fov_id", "left")
    # a detected class without any tissue cell was never in a block; it goes at once
    gone = F.coalesce("removed", F.lit(True)) if decided is not None else F.lit(True)
    flags = flags.select(F.col("fov_id").alias("last"), "detected", gone.alias("_gone"))
    named = own.join(classes, "spans").select("fov_id", "last").join(flags, "last", "left")
    every = fovs.select("fov_id").distinct().join(named, "fov_id", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    return every.select("fov_id", "detected", (F.col("detected") & (F.col("_gone") | (F.col("fov_id") != F.col("last")))).alias("removed"))


def uncovered_cells(fovs: DataFrame, tissue: DataFrame, fov_size: float, cell_um: float) -> DataFrame:
    return tissue.select("r", "c").distinct().join(cells_of_fovs(fovs, fov_size, cell_um), ["r", "c"], "left_anti")


#: Side of a tile in cells, or the reach of what is done in it if that is more.
TILE = 256
RUNS = "tr long, tc long, r long, c0 long, c1 long"


def tiles_within(r: tuple[str, str], c: tuple[str, str], side: int, reach: int) -> list[Column]:
    """Tiles (tr, tc) that cells of the given first and last row and column lie in or are within reach of."""
    at = lambda v, d: F.floor((F.col(v) + d) / side).cast("long")
    return [F.explode(F.sequence(at(r[0], -reach), at(r[1], reach))).alias("tr"), F.sequence(at(c[0], -reach), at(c[1], reach)).alias("_tc")]


def in_tiles(cells: DataFrame, side: int, reach: int) -> DataFrame:
    """Each cell (r, c, ...) in every tile that needs it."""
    return cells.select("*", *tiles_within(("r", "r"), ("c", "c"), side, reach)).select(*cells.columns, "tr", F.explode("_tc").alias("tc"))


def smooth_cells(canvas: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing of (r, c, v) tile by tile, rows first; cells outside the table count 0. A NULL counts 0 too, and is left where nothing else is in reach."""
    k = gaussian_kernel(sigma)
    reach = len(k) // 2
    side = max(TILE, reach)

    def run(key, pdf):
        top, left, size = key[0] * side - reach, key[1] * side - reach, side + 2 * reach
        r, c, v = pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left, pdf["v"].to_numpy()
        img, there = np.zeros((size, size)), ~np.isnan(v)
        np.add.at(img, (r[there], c[there]), v[there])
        around = lambda a, w: sum(x * a[i : i + side] for i, x in enumerate(w))
        both = lambda a, w: around(around(a, w).T, w).T
        out = both(img, k)
        if not there.all():
            full = np.zeros((size, size))
            full[r[there], c[there]] = 1
            out[both(full, np.ones(len(k))) == 0] = np.nan
        own = np.zeros((size, size), bool)
        own[r, c] = True
        y, x = np.nonzero(own[reach : reach + side, reach : reach + side])
        v = pd.array(out[y, x], dtype="Float64") if not there.all() else out[y, x]
        return pd.DataFrame({"r": y + key[0] * side, "c": x + key[1] * side, "v": v})

    cells = canvas.where(F.col("r").isNotNull() & F.col("c").isNotNull()).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))
    return in_tiles(cells, side, reach).groupBy("tr", "tc").applyInPandas(run, "r long, c long, v double")


def disk_filter(mask: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Pixels with a set pixel within the radius, or whose whole disk is set; outside the image nothing is set."""
    out = np.zeros_like(mask) if grow else np.ones_like(mask)
    h, w = mask.shape
    pad = np.zeros((h + 2 * radius, w + 2 * radius + 1), np.int32)
    pad[radius : radius + h, radius + 1 : radius + 1 + w] = mask
    total = np.cumsum(pad, axis=1)
    for d in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - d * d) + 1e-9)
        rows = total[radius + d : radius + d + h]
        n = rows[:, radius + half + 1 : radius + half + 1 + w] - rows[:, radius - half : radius - half + w]
        out = out | (n > 0) if grow else out & (n == 2 * half + 1)
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column behind the last) of the runs of set pixels, by rows."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (r, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return r, start, end


def first_runs(r: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """For each run the first run of its 4-connected piece."""
    parent = list(range(len(r)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    key = r * (width + 1)
    low = np.searchsorted(key + end, key + width + 1 + start, side="right")
    high = np.searchsorted(key + start, key + width + 1 + end, side="left")
    for i in np.flatnonzero(high > low):
        for j in range(low[i], high[i]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(r))], np.int64)


def label_runs(runs: DataFrame, box: tuple[int, int, int, int], side: int, inside: bool = True) -> DataFrame:
    """(tr, tc, r, c0, c1, label): 4-connected pieces of the runs' cells, or of all other cells of the box (first and last row and column).

    A tile labels its own pieces, which are then joined over the tiles' borders. A label is the smallest number of a cell, counted by rows of the box.
    """
    r0, r1, c0, c1 = box
    width = c1 - c0 + 1

    def run(key, pdf):
        top, left = key[0] * side, key[1] * side
        mask = np.zeros((side, side), bool)
        for r, a, b in pdf[["r", "c0", "c1"]].dropna().astype("int64").itertuples(index=False):
            mask[r - top, a - left : b - left] = True
        if not inside:
            mask = ~mask
            mask[: max(r0 - top, 0)] = mask[max(r1 + 1 - top, 0) :] = False
            mask[:, : max(c0 - left, 0)] = mask[:, max(c1 + 1 - left, 0) :] = False
        r, a, b = runs_of(mask)
        first = first_runs(r, a, b, side)
        label = (r[first] + top - r0) * width + a[first] + left - c0
        named = np.zeros((side, side), np.int64)
        for i, (y, x, z) in enumerate(zip(r, a, b)):
            named[y, x:z] = label[i]
        out = [pd.DataFrame({"tr": key[0], "tc": key[1], "r": r + top, "c0": a + left, "c1": b + left, "label": label, "edge": 0})]
        # cells at the lower and right border, under the place of their neighbour, and at the upper and left border
        for edge, cells, y, x in ((1, np.s_[-1, :], side, None), (2, np.s_[0, :], 0, None), (3, np.s_[:, -1], None, side), (4, np.s_[:, 0], None, 0)):
            at = np.flatnonzero(mask[cells])
            out.append(pd.DataFrame({"tr": key[0], "tc": key[1], "r": top + (at if y is None else y), "c0": left + (at if x is None else x), "c1": 0, "label": named[cells][at], "edge": edge}))
        return pd.concat(out)

    if not inside:
        down, across = r1 // side - r0 // side + 1, c1 // side - c0 // side + 1
        tiles = runs.sparkSession.range(down * across).select((F.floor(F.col("id") / across) + r0 // side).cast("long").alias("tr"), (F.col("id") % across + c0 // side).alias("tc"))
        runs = runs.select("tr", "tc", "r", "c0", "c1").unionByName(tiles, allowMissingColumns=True)
    parts = cut_lineage(runs.groupBy("tr", "tc").applyInPandas(run, RUNS + ", label long, edge int"))
    edges = parts.where("edge = 0").select(F.col("label").alias("a"), F.col("label").alias("b")).distinct()
    for one, other in ((1, 2), (3, 4)):
        side_of = lambda e, name: parts.where(F.col("edge") == e).select("r", "c0", F.col("label").alias(name))
        edges = edges.unionByName(side_of(one, "a").join(side_of(other, "b"), ["r", "c0"]).select("a", "b").distinct())
    same = connected_components(edges).select(F.col("id").alias("label"), "component")
    return parts.where("edge = 0").join(same, "label").select("tr", "tc", "r", "c0", "c1", F.col("component").alias("label"))


def labels_near(runs: DataFrame, reach: int, side: int) -> DataFrame:
    """Labels of runs without the flag `main` that have a cell within reach of a run with it."""
    side = max(side, reach)
    wide = runs.select("r", "c0", "c1", "label", "main", (F.col("c1") - 1).alias("_c")).select("r", "c0", "c1", "label", "main", *tiles_within(("r", "r"), ("c0", "_c"), side, reach))
    wide = wide.select("r", "c0", "c1", "label", "main", "tr", F.explode("_tc").alias("tc"))

    def run(key, pdf):
        top, left, size = key[0] * side - reach, key[1] * side - reach, side + 2 * reach
        mask = np.zeros((size, size), bool)
        at = lambda m: zip(*[pdf.loc[pdf["main"] == m, c].to_numpy() - o for c, o in (("r", top), ("c0", left), ("c1", left))], pdf.loc[pdf["main"] == m, "label"])
        for r, a, b, _ in at(True):
            mask[r, max(a, 0) : max(b, 0)] = True
        around = disk_filter(mask, reach, True)
        found = {label for r, a, b, label in at(False) if reach <= r < reach + side and around[r, max(a, reach) : max(min(b, reach + side), 0)].any()}
        return pd.DataFrame({"label": np.array(sorted(found), np.int64)})

    return wide.groupBy("tr", "tc").applyInPandas(run, "label long").distinct()


def segment_tissue(canvas: DataFrame, *, pixel_um: float, threshold: float | None = None, smooth_um: float = 10.0, close_um: float = 50.0,
                   open_um: float = 15.0, margin_um: float = 75.0, min_tissue_um2: float = 1000.0, min_hole_um2: float = 1000.0,
                   near_um: float = 0.0, min_near_um2: float = 0.0) -> DataFrame:
    """(r, c, kind, label, area_um2): tissue and hole cells of a canvas (r, c, v) of covered cells.

    Smooth, threshold (Otsu unless given), close, open, grow by a margin, fill. Small pieces are dropped unless they lie
    within ``near_um`` of a large one. Holes are background pieces that do not reach the frame around the canvas.
    """
    px = lambda um, low: max(low, round(um / pixel_um))
    s = smooth_cells(canvas, smooth_um / pixel_um) if smooth_um > 0 else canvas
    s = cut_lineage(s)
    limit = otsu_threshold(s, [], "v").scalar() if threshold is None else F.lit(float(threshold))
    mask = s.withColumn("_t", limit).where("v > _t").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    closed, opened, grow = px(close_um, 1), px(open_um, 1), px(margin_um, 0)
    reach = 2 * closed + 2 * opened + grow
    side = max(TILE, reach)
    box = canvas.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if None in box:
        return canvas.sparkSession.createDataFrame([], "r long, c long, kind string, label long, area_um2 double")
    r0, r1, c0, c1 = box[0] - 1, box[1] + 1, box[2] - 1, box[3] + 1

    def shaped(key, pdf):
        top, left, size = key[0] * side - reach, key[1] * side - reach, side + 2 * reach
        m = np.zeros((size, size), bool)
        m[pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left] = True
        for radius, more in ((closed, True), (closed, False), (opened, False), (opened, True), (grow, True)):
            m = disk_filter(m, radius, more) if radius else m
        m = m[reach : reach + side, reach : reach + side]
        top, left = top + reach, left + reach
        m[: max(box[0] - top, 0)] = m[max(box[1] + 1 - top, 0) :] = False
        m[:, : max(box[2] - left, 0)] = m[:, max(box[3] + 1 - left, 0) :] = False
        r, a, b = runs_of(m)
        return pd.DataFrame({"tr": key[0], "tc": key[1], "r": r + top, "c0": a + left, "c1": b + left})

    tissue = cut_lineage(in_tiles(mask, side, reach).groupBy("tr", "tc").applyInPandas(shaped, RUNS))
    frame, width = (r0, r1, c0, c1), c1 - c0 + 1
    back = label_runs(tissue, frame, side, inside=False)
    holes = cut_lineage(back.where("label <> 0"))  # the outer frame holds cell 0
    pieces = cut_lineage(label_runs(tissue.unionByName(holes.drop("label")), frame, side))
    areas = lambda runs: runs.groupBy("label").agg((F.sum(F.col("c1") - F.col("c0")) * pixel_um * pixel_um).alias("area_um2"))
    area = areas(pieces)
    main = area.where(F.col("area_um2") >= min_tissue_um2)
    if near_um > 0:
        flags = area.select("label", (F.col("area_um2") >= min_tissue_um2).alias("main"))
        close_by = labels_near(pieces.join(flags, "label"), px(near_um, 1), side)
        main = main.unionByName(area.join(close_by, "label", "left_semi").where(F.col("area_um2") >= min_near_um2))
    main = cut_lineage(main)
    keep = pieces.join(main, "label").withColumn("kind", F.lit("tissue"))
    # a hole lies in one piece, that of its first cell
    first = areas(holes).where(F.col("area_um2") >= min_hole_um2).withColumnsRenamed({"label": "hole", "area_um2": "_area"}).select(
        "hole", "_area", (F.floor(F.col("hole") / width) + r0).cast("long").alias("r"), (F.col("hole") % width + c0).alias("_c"))
    first = first.withColumn("tr", F.floor(F.col("r") / side).cast("long")).withColumn("tc", F.floor(F.col("_c") / side).cast("long"))
    kept = first.join(pieces.join(main, "label", "left_semi"), ["tr", "tc", "r"]).where("_c >= c0 AND _c < c1").select(F.col("hole").alias("label"), F.col("_area").alias("area_um2"))
    out = keep.unionByName(holes.join(kept, "label").withColumn("kind", F.lit("hole")))
    return out.select("r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"), "kind", "label", "area_um2")


def transform_candidates(n_angles: int = 72, allow_flip: bool = True, around: float | None = None, span: float = 0.0) -> list[tuple[int, float]]:
    """(flip, angle in degrees): all angles for both handednesses, or a finer fan around one angle."""
    flips = (1, -1) if allow_flip else (1,)
    angles = [360.0 * i / n_angles for i in range(n_angles)] if around is None else [around + span * (2 * i / (n_angles - 1) - 1) for i in range(n_angles)]
    return [(f, a) for f in flips for a in angles]


def grid_search(src: DataFrame, tgt: DataFrame, candidates: list[tuple[int, float]], cell: float) -> DataFrame:
    """IoU per candidate of source cells mapped onto target cells (r, c): (flip, angle, scale, tx, ty, iou).

    Scale is the square root of the area ratio, translation matches centroids. Every target cell centre is mapped back
    to the source, so scaling leaves no gaps. The candidates are a fixed list carried by each row.
    """
    stat = lambda df: df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg((F.col("c") + 0.5) * cell).alias("x"), F.avg((F.col("r") + 0.5) * cell).alias("y"))).scalar()
    cand = F.explode(F.array(*[F.struct(F.lit(int(f)).alias("flip"), F.lit(float(a)).alias("angle")) for f, a in candidates]))
    t = tgt.select("r", "c").distinct().withColumn("_s", stat(src.select("r", "c").distinct())).withColumn("_t", stat(tgt.select("r", "c").distinct()))
    t = t.select("_s", "_t", ((F.col("c") + 0.5) * cell - F.col("_t.x")).alias("dx"), ((F.col("r") + 0.5) * cell - F.col("_t.y")).alias("dy"), cand.alias("_k"))
    scale = F.sqrt(F.col("_t.n") / F.col("_s.n"))
    cos, sin = F.cos(F.radians("_k.angle")), F.sin(F.radians("_k.angle"))
    back = t.select(
        "_k.flip", "_k.angle", scale.alias("scale"), F.col("_s").alias("s"), F.col("_t").alias("t"),
        F.floor((F.col("_s.x") + F.col("_k.flip") * (cos * F.col("dx") + sin * F.col("dy")) / scale) / cell).alias("c"),
        F.floor((F.col("_s.y") + (cos * F.col("dy") - sin * F.col("dx")) / scale) / cell).alias("r"))
    hit = back.join(src.select("r", "c").distinct().withColumn("_in", F.lit(1)), ["r", "c"], "left")
    per = hit.groupBy("flip", "angle").agg(F.count("_in").alias("inter"), F.max("scale").alias("scale"), F.max("s").alias("s"), F.max("t").alias("t"))
    iou = F.col("inter") / (F.col("s.n") * F.col("scale") * F.col("scale") + F.col("t.n") - F.col("inter"))
    a, sx, sy = F.radians("angle"), F.col("flip") * F.col("s.x"), F.col("s.y")
    return per.select(
        "flip", "angle", "scale", (F.col("t.x") - F.col("scale") * (F.cos(a) * sx - F.sin(a) * sy)).alias("tx"),
        (F.col("t.y") - F.col("scale") * (F.sin(a) * sx + F.cos(a) * sy)).alias("ty"), iou.alias("iou"))


def fit_similarity(src: DataFrame, tgt: DataFrame, cell: float, n_angles: int = 72, allow_flip: bool = True, refine: bool = True) -> DataFrame:
    """Best candidate of the grid search, refined by a second, finer fan of angles around it."""
    first = grid_search(src, tgt, transform_candidates(n_angles, allow_flip), cell)
    order = [F.desc(F.round("iou", 9)), F.desc("flip"), "angle"]
    best = first.orderBy(*order).limit(1)
    if not refine:
        return best
    row = best.first()
    fine = [(row.flip, a) for _, a in transform_candidates(21, False, around=row.angle, span=360.0 / n_angles)]
    return grid_search(src, tgt, fine, cell).orderBy(*order).limit(1)
