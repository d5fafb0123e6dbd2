"""Least-squares positions from pairwise displacements: one solver for components of every size.

The start is the solution by nested dissection: blocks of at most `BLOCK` neighbouring points, one task's group each, reduce their
equations to the points with links to other blocks, `MERGE` such groups are put together and reduced again, and the values go back down. That
is two jobs a level, and levels grow with the logarithm of the size. Conjugate gradients, preconditioned by the blocks, take what
rounding has left, or all of it where a merged group would hold more than `MERGED` points (a dense matrix in one task); step sizes are
columns, one row per component, from grouped sums. The stopping rule is the same for every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.operators.graph import connected_components
from stagelight.operators.scan import ordered_scan
from stagelight.session import cut_lineage

#: Points that are solved together in the preconditioner.
BLOCK = 2048
#: Rounds allowed, and those more for each block.
ROUNDS = (200, 20)
#: Bits of each coordinate on the curve that orders points.
CURVE_BITS = 26
#: Groups that are put together at each level of the dissection, and the points of one group at most.
MERGE = 4
MERGED = 4096


def curve_code(x: Column, y: Column) -> Column:
    """Z-order number of two coordinates between 0 and 1; points close on the curve are close in the plane."""
    top = float((1 << CURVE_BITS) - 1)
    xi, yi = (F.floor(F.coalesce(v, F.lit(0.0)) * top).cast("long") for v in (x, y))
    code = F.lit(0).cast("long")
    for k in range(CURVE_BITS):
        bit = lambda v: F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long"))
        code = code + F.shiftleft(bit(xi), 2 * k) + F.shiftleft(bit(yi), 2 * k + 1)
    return code


def with_blocks(points: DataFrame, size: int) -> DataFrame:
    """Adds `block`: runs of ``size`` points in the order (component, curve), so small components share one."""
    box = points.groupBy("component").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    # one scale for both axes, so that blocks of a long strip are short pieces of it
    unit = lambda c: (F.col(c) - F.col(f"lo{c}")) / F.nullif(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")), F.lit(0.0))
    coded = points.join(box, "component").select(*points.columns, curve_code(unit("x"), unit("y")).alias("_code"))
    placed = ordered_scan(coded, [], ["component", "_code", "id"], row_number="_rn")
    return placed.select(*points.columns, F.floor((F.col("_rn") - 1) / size).alias("block"))


def solve_block(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """`points` with zx, zy, the solution of the block's own equations for the residuals rx, ry.

    Points outside the block and pinned ones count as held at 0.
    """
    ids = points["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    a, b = (order[np.searchsorted(ids[order], edges[k].to_numpy())] for k in ("id", "nb"))
    free = ~points["pinned"].to_numpy()
    deg = points["deg"].to_numpy(float)[:, None]
    r = points[["rx", "ry"]].to_numpy(float)
    z = np.zeros_like(r)
    inverse = np.where(free[:, None] & (deg > 0), 1 / np.maximum(deg, 1), 0.0)
    y = inverse * r
    d, rho, end = y.copy(), (r * y).sum(0), 1e-13 * np.abs(r).max(initial=0.0)
    for _ in range(4 * len(ids) + 100):
        if np.abs(r).max(initial=0.0) <= end:
            break
        q = deg * d - np.stack([np.bincount(a, d[b, i], len(ids)) for i in (0, 1)], axis=1)
        q[~free] = 0
        dq = (d * q).sum(0)
        step = np.divide(rho, dq, out=np.zeros(2), where=dq > 0)
        z, r = z + step * d, r - step * q
        y = inverse * r
        new = (r * y).sum(0)
        d = y + np.divide(new, rho, out=np.zeros(2), where=rho > 0) * d
        rho = new
    return points.assign(zx=z[:, 0], zy=z[:, 1])


def reduce_equations(ids: np.ndarray, lams: np.ndarray, a: np.ndarray, r: np.ndarray, level: int) -> dict:
    """Eliminates the points of ``lams`` <= ``level`` from ``a`` z = ``r``: what is left for the others, and how the values come back."""
    out = lams <= level
    keep = ~out
    both = np.linalg.solve(a[np.ix_(out, out)], np.concatenate([a[np.ix_(out, keep)], r[out]], axis=1))
    back, own = both[:, :-2], both[:, -2:]
    across = a[np.ix_(keep, out)]
    return {"ids": ids[keep].tobytes(), "lams": lams[keep].tobytes(), "mat": (a[np.ix_(keep, keep)] - across @ back).tobytes(), "rhs": (r[keep] - across @ own).tobytes(),
            "gone": ids[out].tobytes(), "back": np.ascontiguousarray(back).tobytes(), "own": np.ascontiguousarray(own).tobytes()}


REDUCED = "grp long, ids binary, lams binary, mat binary, rhs binary, gone binary, back binary, own binary"


def reduce_block(key, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """One block of free points reduced to those with links to other blocks; nothing is kept to come back (`solve_block` does that)."""
    if not len(points) or not (points["lam"] > 0).any():
        return pd.DataFrame(columns=["grp", "ids", "lams", "mat", "rhs", "gone", "back", "own"])
    points = points.sort_values("id")
    ids, a = points["id"].to_numpy(np.int64), np.diag(np.maximum(points["deg"].to_numpy(float), 1.0))
    np.subtract.at(a, tuple(np.searchsorted(ids, edges[k].to_numpy()) for k in ("id", "nb")), 1.0)
    row = reduce_equations(ids, points["lam"].to_numpy(np.int64), a, points[["rx", "ry"]].to_numpy(float), 0)
    return pd.DataFrame([{"grp": key[0], **row, "gone": b"", "back": b"", "own": b""}])


def merge_groups(level: int):
    """Puts the groups of one parent together with the links that meet at this level, and reduces them."""
    def merged(key, groups: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(groups):
            return groups
        parts = [np.frombuffer(b, np.int64) for b in groups["ids"]]
        ids = np.concatenate(parts)
        a, r = np.zeros((len(ids), len(ids))), np.concatenate([np.frombuffer(b).reshape(-1, 2) for b in groups["rhs"]])
        at = 0
        for part, b in zip(parts, groups["mat"]):
            a[at:at + len(part), at:at + len(part)] = np.frombuffer(b).reshape(len(part), len(part))
            at += len(part)
        order = np.argsort(ids, kind="stable")
        np.subtract.at(a, tuple(order[np.searchsorted(ids[order], edges[k].to_numpy())] for k in ("id", "nb")), 1.0)
        lams = np.concatenate([np.frombuffer(b, np.int64) for b in groups["lams"]])
        return pd.DataFrame([{"grp": key[0], **reduce_equations(ids, lams, a, r, level)}])
    return merged


KNOWN = "grp long, ids binary, z binary"


def values_back(groups: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The values of a group's points from those that its parent group knows."""
    rows = []
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in above["ids"]]) if len(above) else np.zeros(0, np.int64)
    z = np.concatenate([np.frombuffer(b).reshape(-1, 2) for b in above["z"]]) if len(above) else np.zeros((0, 2))
    order = np.argsort(ids, kind="stable")
    for g in groups.itertuples():
        kept, gone = np.frombuffer(g.ids, np.int64), np.frombuffer(g.gone, np.int64)
        zk = z[order[np.searchsorted(ids[order], kept)]]
        ze = np.frombuffer(g.own).reshape(-1, 2) - np.frombuffer(g.back).reshape(len(gone), len(kept)) @ zk
        rows.append((g.grp, np.concatenate([gone, kept]).tobytes(), np.concatenate([ze, zk]).tobytes()))
    return pd.DataFrame(rows, columns=["grp", "ids", "z"])


def point_values(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per point of the groups' values."""
    for part in groups:
        for g in part.itertuples():
            z = np.frombuffer(g.z).reshape(-1, 2)
            yield pd.DataFrame({"id": np.frombuffer(g.ids, np.int64), "kx": z[:, 0], "ky": z[:, 1]})


def shared_values(start: DataFrame, links: DataFrame, n_blocks: int, size: int) -> DataFrame | None:
    """(id, kx, ky): the solution at all points with links to other blocks; None where a merged group would be too large.

    start: id, pinned, deg, rx, ry, block; links: both directions of each link with block_id and block_nb, of free points only.
    """
    top = 0
    while MERGE**top < n_blocks:
        top += 1
    group = lambda c, l: F.floor(F.col(c) / MERGE**l)
    meet = sum(((group("block_id", l) != group("block_nb", l)).cast("long") for l in range(top)), F.lit(0).cast("long"))
    links = cut_lineage(links.withColumn("lev", meet))
    free = start.where("NOT pinned").join(links.groupBy("id").agg(F.max("lev").alias("lam")), "id", "left").withColumn("lam", F.coalesce("lam", F.lit(0).cast("long")))
    free = cut_lineage(free.select("id", "deg", "rx", "ry", "block", "lam"))
    counts = free.groupBy("block", "lam").agg(F.count("*").alias("n"))
    at = counts.select("block", "lam", "n", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("l")).where("lam >= l").withColumn("grp", F.floor(F.col("block") / F.pow(F.lit(float(MERGE)), F.col("l"))))
    most = at.groupBy("l", "grp").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if max(most, size) > MERGED:
        return None
    rows = free.groupBy("block").cogroup(links.where("lev = 0").groupBy("block_id")).applyInPandas(reduce_block, REDUCED)
    levels = [cut_lineage(rows)]
    for l in range(1, top + 1):
        below = levels[-1].select(F.floor(F.col("grp") / MERGE).alias("up"), "ids", "lams", "mat", "rhs")
        met = links.where(F.col("lev") == l).select(group("block_id", l).alias("up"), "id", "nb")
        levels.append(cut_lineage(below.groupBy("up").cogroup(met.groupBy("up")).applyInPandas(merge_groups(l), REDUCED)))
    known = start.sparkSession.createDataFrame([], KNOWN)
    for l in range(top, 0, -1):
        # groups of level l + 1 know what those of level l have kept; the last one has kept nothing
        own = levels[l].select("grp", "ids", "gone", "back", "own")
        known = cut_lineage(own.groupBy(F.floor(F.col("grp") / MERGE)).cogroup(known.groupBy("grp")).applyInPandas(values_back, KNOWN))
    return known.mapInPandas(point_values, "id long, kx double, ky double")


def solve_positions(pairs: DataFrame, nominal: DataFrame, *, tol: float = 1e-9, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Positions p minimising sum |(p_b - p_a) - r_ab|^2 with the most used anchor of each component fixed (ties: the lowest).

    pairs: anchor, neighbour, measured_x, measured_y; nominal: fov_id, x, y, ids whole numbers. Returns (fov_id, component,
    pinned, x, y) and one row with residual_rms and n_components. Stops when no residual is above ``tol`` times the largest at the
    start (or 1); raises an error when that isn't reached in the rounds of `ROUNDS`.
    """
    at = lambda k, x, y: nominal.select(F.col("fov_id").alias(k), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    e = cut_lineage(pairs.join(at("anchor", "ax", "ay"), "anchor").join(at("neighbour", "bx", "by"), "neighbour").select(
        "anchor", "neighbour", "ax", "ay", "bx", "by", (F.col("measured_x") - F.col("ax")).alias("mx"), (F.col("measured_y") - F.col("ay")).alias("my")))
    component = connected_components(e, "anchor", "neighbour")
    anchors = e.groupBy(F.col("anchor").alias("id")).agg(F.count("*").alias("n")).join(component, "id")
    pins = anchors.groupBy("component").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("pin"))

    ex, ey = (F.col(f"b{c}") - F.col(f"a{c}") - F.col(f"m{c}") for c in "xy")
    end = lambda k, c, sign: F.struct(F.col(k).alias("id"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"), (sign * ex).alias("gx"), (sign * ey).alias("gy"), (F.col("anchor") != F.col("neighbour")).cast("long").alias("deg"))
    ends = e.select(F.explode(F.array(end("neighbour", "b", 1.0), end("anchor", "a", -1.0))).alias("e")).select("e.*")
    points = ends.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.sum("deg").alias("deg"))
    points = points.join(component, "id").join(pins, "component").withColumn("pinned", F.col("id") == F.col("pin"))
    free = lambda c: F.when(F.col("pinned"), 0.0).otherwise(c)
    start = points.select("id", "component", "pinned", "deg", "x", "y", free(-F.col("gx")).alias("rx"), free(-F.col("gy")).alias("ry"))
    start = cut_lineage(with_blocks(start, block))
    links = cut_lineage(e.where("anchor <> neighbour").select(F.explode(F.array(
        F.struct(F.col("anchor").alias("id"), F.col("neighbour").alias("nb")), F.struct(F.col("neighbour").alias("id"), F.col("anchor").alias("nb")))).alias("l")).select("l.*"))
    side = lambda k: start.select(F.col("id").alias(k), F.col("block").alias(f"block_{k}"), F.col("pinned").alias(f"pinned_{k}"))
    placed = cut_lineage(links.join(side("id"), "id").join(side("nb"), "nb"))
    inner = placed.where("block_id = block_nb").select(F.col("block_id").alias("block"), "id", "nb")

    def preconditioned(state: DataFrame) -> DataFrame:
        kept = [c for c in state.columns if c not in ("zx", "zy")]
        out = ", ".join(f"{c} {t}" for c, t in state.select(*kept).dtypes) + ", zx double, zy double"
        return state.select(*kept).groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(solve_block, out)

    def pushed_by(values: DataFrame, x: str, y: str) -> DataFrame:
        """`values` with nx, ny: the sums of the neighbours' x, y."""
        near = links.join(values.select(F.col("id").alias("nb"), F.col(x).alias("nx"), F.col(y).alias("ny")), "nb")
        return values.join(near.groupBy("id").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny")), "id", "left")

    worst_of = F.max(F.greatest(F.abs("rx"), F.abs("ry")))
    left = lambda c, z: free(F.col(f"r{c}") - F.col("deg") * F.col(z) + F.coalesce(F.col(f"n{c}"), F.lit(0.0)))
    worst, n_blocks = start.agg(worst_of, F.max("block") + 1).first()
    limit = tol * max(1.0, worst or 0.0)
    own = start.columns
    shared = shared_values(start, placed.where("NOT pinned_id AND NOT pinned_nb").select("id", "nb", "block_id", "block_nb"), n_blocks or 0, block) if (n_blocks or 0) > 1 and worst > limit else None
    if shared is not None or n_blocks == 1:
        # values of the points between blocks are held while the blocks are solved
        held = start.join(shared, "id", "left") if shared is not None else start.withColumns({f"k{c}": F.lit(None).cast("double") for c in "xy"})
        held = held.withColumn("held", F.col("kx").isNotNull()).withColumns({f"k{c}": F.coalesce(f"k{c}", F.lit(0.0)) for c in "xy"})
        held = cut_lineage(pushed_by(cut_lineage(held), "kx", "ky").withColumns({f"r{c}_": left(c, f"k{c}") for c in "xy"}).drop("nx", "ny"))
        inside = preconditioned(held.select("id", "block", "deg", (F.col("pinned") | F.col("held")).alias("pinned"), F.col("rx_").alias("rx"), F.col("ry_").alias("ry")))
        found = cut_lineage(start.join(held.select("id", "kx", "ky"), "id").join(inside.select("id", "zx", "zy"), "id").withColumns({f"z{c}": F.col(f"z{c}") + F.col(f"k{c}") for c in "xy"}))
        moved = pushed_by(found, "zx", "zy").withColumns({c: F.col(c) + F.col(f"z{c}") for c in "xy"} | {f"r{c}": left(c, f"z{c}") for c in "xy"})
        start = cut_lineage(moved.select(*own))
        worst = start.agg(worst_of).first()[0]
    none = {f"{p}{c}": F.lit(0.0) for p in ("d", "o") for c in "xy"}
    state = cut_lineage(preconditioned(start).withColumns(none)) if (worst or 0.0) > limit else start
    for _ in range(ROUNDS[0] + ROUNDS[1] * (n_blocks or 0)):
        if (worst or 0.0) <= limit:
            break
        # the new direction, with the step back that keeps it conjugate (o: the residual before)
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        size = {f"rho{c}": dot(f"r{c}", f"z{c}") for c in "xy"} | {f"mix{c}": dot(f"o{c}", f"z{c}") for c in "xy"} | {f"old{c}": dot(f"o{c}", f"d{c}") for c in "xy"}
        by = state.groupBy("component").agg(*[v.alias(k) for k, v in size.items()])
        turn = lambda c: F.coalesce((F.col(f"rho{c}") - F.col(f"mix{c}")) / F.nullif(F.col(f"old{c}"), F.lit(0.0)), F.lit(0.0))
        aimed = state.join(by, "component").withColumns({f"d{c}": F.col(f"z{c}") + turn(c) * F.col(f"d{c}") for c in "xy"})
        aimed = cut_lineage(aimed.drop("zx", "zy", *size))
        push = lambda c: free(F.col("deg") * F.col(f"d{c}") - F.coalesce(F.col(f"n{c}"), F.lit(0.0)))
        pushed = cut_lineage(pushed_by(aimed, "dx", "dy").withColumns({f"q{c}": push(c) for c in "xy"}).drop("nx", "ny"))
        steps = pushed.groupBy("component").agg(*[(dot(f"r{c}", f"d{c}") / F.nullif(dot(f"d{c}", f"q{c}"), F.lit(0.0))).alias(f"step{c}") for c in "xy"])
        step = lambda c: F.coalesce(F.col(f"step{c}"), F.lit(0.0))
        moved = pushed.join(steps, "component").withColumns(
            {f"o{c}": F.col(f"r{c}") for c in "xy"} | {c: F.col(c) + step(c) * F.col(f"d{c}") for c in "xy"} | {f"r{c}": F.col(f"r{c}") - step(c) * F.col(f"q{c}") for c in "xy"})
        state = cut_lineage(preconditioned(moved.drop("stepx", "stepy", "qx", "qy")))
        worst = state.agg(worst_of).first()[0]
    else:
        if (worst or 0.0) > limit:
            raise RuntimeError(f"positions did not settle: the largest residual is {worst}, wanted {limit}")
    solved = state.select(F.col("id").alias("fov_id"), "component", "pinned", "x", "y")
    place = lambda k, c: solved.select(F.col("fov_id").alias(k), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    ended = e.select("anchor", "neighbour", "mx", "my").join(place("anchor", "a"), "anchor").join(place("neighbour", "b"), "neighbour")
    summary = ended.agg(F.sqrt(F.coalesce(F.avg(ex * ex + ey * ey), F.lit(0.0))).alias("residual_rms")).withColumn("n_components", solved.agg(F.count_distinct("component")).scalar())
    return solved, summary
