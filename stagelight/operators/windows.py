"""Ordered operators: labels, grids, path steps, gap splits, runs, plateaus, schedules and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions.scalar import pad_number, round_even
from stagelight.operators.quantile import attach, exact_quantiles, median_and_mad, shared
from stagelight.operators.scan import dense_index, ordered_scan
from stagelight.session import cut_lineage


def round_labels(rounds: DataFrame, round_id: str = "round_id", kind: str = "kind") -> DataFrame:
    """``focustest``, ``cells`` or ``hybNN`` with NN the 1-based rank among the remaining rounds."""
    other = rounds.where(~F.col(kind).isin("focustest", "cells")).select(round_id)
    ranked = dense_index(other.distinct(), round_id, "_i")
    return rounds.join(ranked, round_id, "left").select(
        *rounds.columns,
        F.coalesce(F.concat(F.lit("hyb"), pad_number(F.col("_i") + 1, 2)), F.col(kind)).alias("label"),
    )


def rank_grid(positions: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Grid index of each position: 0-based dense rank of the coordinate rounded to whole µm.

    The different coordinates are numbered by one window: there are no more of them than µm of a stage's travel.
    """
    p = positions.withColumn("_x", round_even(x)).withColumn("_y", round_even(y))
    for c in ("x", "y"):
        number = (F.row_number().over(Window.orderBy(f"_{c}")) - 1).cast("long")
        p = p.join(p.select(f"_{c}").where(F.col(f"_{c}").isNotNull()).distinct().withColumn(f"{c}_idx", number), f"_{c}", "left")
    return p.select(*positions.columns, "x_idx", "y_idx")


def inter_file_time(files: DataFrame, keys: list[str], order: list[str], exposure_s: float, n_frames: int) -> DataFrame:
    """Seconds between successive files: median, min, max, population std, per-frame time and its ratio to exposure."""
    t = files.withColumn("_t", F.col(order[0]).cast("double"))
    d = ordered_scan(t, keys, ["_t", *order[1:]], lag={"_p": "_t"}).withColumn("gap", F.col("_t") - F.col("_p"))
    d = d.where("gap is not null")
    med = exact_quantiles(d, keys, "gap", {"median_s": 0.5})
    rest = d.groupBy(*keys).agg(
        F.min("gap").alias("min_s"), F.max("gap").alias("max_s"), F.stddev_pop("gap").alias("std_s")
    )
    per = F.col("median_s") / n_frames
    return rest.join(med, keys).withColumn("per_frame_s", per).withColumn("ratio", per / exposure_s)


def path_stats(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Total and longest step of an ordered path; fewer than two points give 0."""
    s = ordered_scan(points, keys, [order], lag={"_px": "x", "_py": "y"})
    step = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    return s.groupBy(*keys).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("total"), F.coalesce(F.max(step), F.lit(0.0)).alias("longest")
    )


def split_on_gap(points: DataFrame, keys: list[str], order: str, min_points: int = 3) -> DataFrame:
    """Cut an ordered path where the step to the next point is an outlier (modified z > 3.5); small parts are dropped.

    Adds ``part`` (0-based within the path, before dropping).
    """
    s = ordered_scan(points, keys, [order], lag={"_px": "x", "_py": "y"})
    s = cut_lineage(s.withColumn("_d", F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))))
    std = s.groupBy(*keys).agg(F.stddev_pop("_d").alias("_std"))
    full = attach(s, shared(cut_lineage(attach(std, median_and_mad(s, keys, "_d"), keys))), keys)
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    scale = F.coalesce(pos("_mad"), pos("_std"), pos("_med"), F.lit(1.0))
    cut = F.coalesce((0.6745 * (F.col("_d") - F.col("_med")) / scale > 3.5).cast("int"), F.lit(0))
    parts = ordered_scan(full.withColumn("_cut", cut), keys, [order], running_sum={"part": "_cut"})
    sizes = parts.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_points)
    return parts.join(sizes, [*keys, "part"], "left_semi").select(*points.columns, F.col("part").cast("int").alias("part"))


def scan_mode(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``interleaved`` when at least a quarter of neighbouring frames share z, else ``sequential``."""
    s = ordered_scan(frames, keys, order, lag={"_pz": "z"})
    share = F.avg(F.when(F.col("_pz").isNotNull(), (F.col("z") == F.col("_pz")).cast("double")))
    return s.groupBy(*keys).agg(
        F.when(F.coalesce(share, F.lit(1.0)) >= 0.25, "interleaved").otherwise("sequential").alias("mode")
    )


def runs_of_equal(frames: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Number the runs of equal neighbouring values from 0; NULL equals NULL."""
    f = frames.withColumn("_one", F.lit(1)).withColumn("_v", F.struct(F.col(column)))
    s = ordered_scan(f, keys, order, lag={"_pv": "_v"})
    new = F.when(F.col("_pv").isNull() | F.col("_pv").eqNullSafe(F.col("_v")), 0).otherwise(1)
    r = ordered_scan(s.withColumn("_new", new), keys, order, running_sum={"run": "_new"})
    return r.select(*frames.columns, F.col("run").cast("int").alias("run"))


def median_filter_3(profile: DataFrame, keys: list[str], z: str, value: str, out: str) -> DataFrame:
    """Median of each value and its two neighbours along z; the ends repeat their own value.

    A profile is the planes of one stack (hundreds), already aggregated to one row per plane.
    """
    w = Window.partitionBy(*keys).orderBy(z)
    three = F.array(F.coalesce(F.lag(value).over(w), F.col(value)), F.col(value), F.coalesce(F.lead(value).over(w), F.col(value)))
    return profile.withColumn(out, F.array_sort(three)[1])


def peak_normalise(profile: DataFrame, keys: list[str], value: str, noise_floor: Column, out: str) -> DataFrame:
    """Value over its own peak; NULL where the peak does not exceed the noise floor."""
    peaks = profile.groupBy(*keys).agg(F.max(value).alias("_peak"))
    return (
        profile.join(peaks, keys).withColumn("_nf", noise_floor)
        .withColumn(out, F.when(F.col("_peak") > F.col("_nf"), F.col(value) / F.col("_peak"))).drop("_peak", "_nf")
    )


def detect_plateau(profile: DataFrame, keys: list[str], z: str, value: str, *, slope_tol: float = 0.01,
                   value_tol: float = 0.15, run: int = 8) -> DataFrame:
    """First plane index, from the peak on, that starts ``run`` planes of small slope and small value.

    Slope and value are relative to the range of the profile; a flat profile gives its peak, none gives NULL.
    """
    w = Window.partitionBy(*keys).orderBy(z)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    one_sided = F.coalesce(nxt - F.col(value), F.col(value) - prev)
    grad = F.when(prev.isNull() | nxt.isNull(), one_sided).otherwise((nxt - prev) / 2)
    p = profile.select(*keys, z, value, (F.row_number().over(w) - 1).alias("_i"), F.abs(grad).alias("_g"))
    span = p.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.max_by("_i", F.struct(F.col(value), -F.col("_i"))).alias("_peak"),
    )
    rng = F.col("_hi") - F.col("_lo")
    ok = (rng > 0) & (F.col("_g") / rng < slope_tol) & ((F.col(value) - F.col("_lo")) / rng < value_tol)
    ahead = Window.partitionBy(*keys).orderBy("_i").rowsBetween(0, run - 1)
    q = p.join(span, keys).withColumn("_ok", ok.cast("int"))
    starts = (F.min("_ok").over(ahead) == 1) & (F.count("_ok").over(ahead) == run) & (F.col("_i") >= F.col("_peak"))
    return (
        q.withColumn("_start", F.when(starts, F.col("_i"))).groupBy(*keys)
        .agg(F.when(F.max("_hi") <= F.max("_lo"), F.max("_peak")).otherwise(F.min("_start")).alias("plateau_idx"))
    )


def chained_schedule(steps: DataFrame, keys: list[str], order: list[str], duration: str, start: Column) -> DataFrame:
    """Start and end of steps run back to back from ``start``, with the calendar day number of each start."""
    s = ordered_scan(steps, keys, order, running_sum={"_end": duration})
    at = lambda sec: F.timestamp_micros((start.cast("double") * 1e6).cast("long") + F.round(sec * 1e6).cast("long"))
    s = s.withColumn("start_ts", at(F.col("_end") - F.col(duration))).withColumn("end_ts", at(F.col("_end")))
    return s.withColumn("day", (F.datediff(F.col("start_ts"), start) + 1).cast("int")).drop("_end")


def block_times(files: DataFrame, keys: list[str], round_id: str, mtime: str, expected: Column) -> DataFrame:
    """Imaging and fluidics blocks of each round from file times.

    Imaging runs from the first to the last file and is final when the round is complete; fluidics runs from the
    end of the previous round (when that is complete) to the start of this one.
    """
    r = files.groupBy(*keys, round_id).agg(
        F.min(mtime).alias("lo"), F.max(mtime).alias("hi"), F.count(F.lit(1)).alias("n")
    ).withColumn("done", F.col("n") >= expected)
    s = ordered_scan(r, keys, [round_id], lag={"_pend": "hi", "_pdone": "done", "_pr": round_id})
    image = s.select(
        *keys, round_id, F.lit("imaging").alias("kind"), F.col("lo").alias("obs_start"),
        F.when(F.col("done"), F.col("hi")).alias("obs_end"), F.col("done").alias("measured"),
    )
    ready = F.coalesce(F.col("_pdone"), F.lit(False))
    fluid = s.where(F.col("_pr").isNotNull()).select(
        *keys, round_id, F.lit("fluidics").alias("kind"), F.when(ready, F.col("_pend")).alias("obs_start"),
        F.when(ready, F.col("lo")).alias("obs_end"), ready.alias("measured"),
    )
    return image.unionByName(fluid)


def reforecast(blocks: DataFrame, keys: list[str], order: list[str], ratio: DataFrame, origin: Column) -> DataFrame:
    """Chain unfinished blocks behind real progress (times in seconds).

    Finished blocks keep their times; a running one ends at its start plus plan times ratio; later ones follow the
    last anchored end. ``ratio`` has one row per ``kind``.
    """
    b = cut_lineage(blocks.join(ratio, "kind", "left")).withColumn(
        "_est", F.col("plan_s") * F.coalesce(F.col("ratio"), F.lit(1.0))
    )
    anchored = F.when(F.col("measured"), F.col("obs_end")).when(
        F.col("obs_start").isNotNull(), F.col("obs_start") + F.col("_est")
    )
    b = b.withColumn("_anchor", anchored).withColumn("_free", F.when(anchored.isNull(), F.col("_est")).otherwise(0.0))
    s = ordered_scan(b, keys, order, running_sum={"_run": "_free"})
    s = s.withColumn("_base", F.when(F.col("_anchor").isNotNull(), F.struct("_anchor", "_run")))
    s = ordered_scan(s, keys, order, forward_fill={"_last": "_base"})
    base = F.coalesce(F.col("_last._anchor"), origin)
    off = F.col("_run") - F.coalesce(F.col("_last._run"), F.lit(0.0))
    end = F.coalesce(F.col("_anchor"), base + off)
    start = F.when(F.col("measured") | F.col("obs_start").isNotNull(), F.col("obs_start")).otherwise(end - F.col("_est"))
    return s.select(
        *blocks.columns, start.alias("start_s"), end.alias("end_s"),
        F.when(F.col("measured"), "measured").otherwise("estimated").alias("status"),
    )


def active_round(rounds: DataFrame, keys: list[str], round_id: str = "round_id") -> DataFrame:
    """The round in progress: latest by (in progress, last file time); the next one if it is complete; else the first."""
    s = ordered_scan(rounds, keys, [round_id], lead={"_next": round_id})
    seen = F.col("n_done") > 0
    full = F.col("n_done") >= F.col("n_total")
    rank = F.struct((seen & ~full).alias("p"), F.col("last_mtime"), F.col(round_id))
    pick = F.max_by(F.when(full, F.coalesce(F.col("_next"), F.col(round_id))).otherwise(F.col(round_id)), F.when(seen, rank))
    return s.groupBy(*keys).agg(F.coalesce(pick, F.min(round_id)).alias("active_round"))


def evenly_spaced(items: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` items per key at half-even rounded positions of an even spacing; all when there are no more than ``n``."""
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    r = attach(ordered_scan(items, keys, order, row_number="_rn"), sizes, keys)
    m = F.col("_m") - 1
    slots = F.array(*[F.bround(F.lit(float(i)) * m / max(n - 1, 1)).cast("long") for i in range(n)])
    return r.where((F.col("_m") <= n) | F.array_contains(slots, F.col("_rn") - 1)).select(*items.columns)


def quantile_tiers(fovs: DataFrame, value: str, n_tiers: int) -> DataFrame:
    """Right-closed quantile bins of ``value`` (0-based ``tier``); NULL goes to tier 0; ``tier_depth`` is the bin maximum."""
    edges = exact_quantiles(fovs, [], value, {f"e{i}": i / n_tiers for i in range(n_tiers + 1)})
    arr = edges.select(F.array_distinct(F.array(*edges.columns)).alias("e")).scalar()
    tier = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(value))) - 1, F.lit(0))
    binned = fovs.withColumn("_e", arr).withColumn("tier", F.when(F.col(value).isNull(), 0).otherwise(tier)).drop("_e")
    return binned.join(binned.groupBy("tier").agg(F.max(value).alias("tier_depth")), "tier")


def rank_tiers(fovs: DataFrame, value: str, tie: str, n_tiers: int) -> DataFrame:
    """Equal-count tiers: tier = rank * n // total; each FOV gets the deepest need of its tier."""
    total = fovs.agg(F.count(F.lit(1))).scalar()
    r = ordered_scan(fovs, [], [value, tie], row_number="_rn").withColumn("_n", total)
    r = r.withColumn("tier", F.floor((F.col("_rn") - 1) * n_tiers / F.col("_n")).cast("int"))
    return r.join(r.groupBy("tier").agg(F.max(value).alias("tier_depth")), "tier").drop("_rn", "_n")


def uniform_step(planes: DataFrame, keys: list[str], z: str, pixel_size_um: float, tol: float = 1e-3) -> DataFrame:
    """Plane step over pixel size; fewer than two planes or an uneven step gives ``ok`` = false and no ratio."""
    s = ordered_scan(planes.select(*keys, z).distinct(), keys, [z], lag={"_p": z}).withColumn("_d", F.abs(F.col(z) - F.col("_p")))
    ok = (F.count("_d") >= 1) & (F.max("_d") - F.min("_d") <= tol)
    return s.groupBy(*keys).agg(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(ok, F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col(z))) / pixel_size_um).alias("anisotropy"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in file order: one aggregate, no sort of the groups."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
