"""Aggregations: focus logs, signal summaries, drift, outliers, fits, progress, storage, jobs, damage scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions.scalar import nice_limit, round_even
from stagelight.operators.quantile import attach, exact_quantiles, median_and_mad, shared
from stagelight.session import cut_lineage


def emptiest_fovs(stats: DataFrame, frame: int, n: int, min_samples: int = 1) -> DataFrame:
    """The ``n`` FOVs with the lowest (mean, std) at one frame; fewer than ``min_samples`` gives no rows yet."""
    picked = stats.where(F.col("frame") == frame).orderBy("mean", "std", "fov_id").limit(n)
    return picked.where(picked.agg(F.count(F.lit(1))).scalar() >= min_samples)


def first_round_with_color(rounds: DataFrame) -> DataFrame:
    """First complete round per colour (round_id, color, complete)."""
    return rounds.where("complete").groupBy("color").agg(F.min("round_id").alias("round_id"))


def quartile_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, q25 and q75 of a measured value per group."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(exact_quantiles(rows, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}), keys)


def signal_per_round(stats: DataFrame, frame: int) -> DataFrame:
    """Mean and sample std over FOVs of the frame means, per round."""
    return stats.where(F.col("frame") == frame).groupBy("round_id").agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"))


def fov_intensity_grid(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Median over planes of the frame medians per FOV, on the rank grid, with the p2/p98 colour limits.

    A FOV has one row per plane, so the inner median is over a bounded group.
    """
    per_fov = stats.groupBy("fov_id").agg(F.median("median").alias("value"))
    lim = exact_quantiles(per_fov, [], "value", {"vmin": 0.02, "vmax": 0.98})
    return attach(per_fov.join(grid.select("fov_id", "x_idx", "y_idx"), "fov_id"), lim, [])


def stage_z_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.min_by("stage_z", "frame").alias("first_stage_z"), F.min("stage_z").alias("min_stage_z"),
        F.max("stage_z").alias("max_stage_z"), (F.min("stage_z") == F.max("stage_z")).alias("all_same"),
    )


def focus_lock_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(~F.col("good")).alias("n_bad_frames"), F.bool_and("good").alias("all_good"))


def channel_shift_summary(shifts: DataFrame) -> DataFrame:
    """Per colour mean and sample std of dx, dy, dz and the linear trend of dz over z."""
    aggs = [a for c in ("dx", "dy", "dz") for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    return shifts.groupBy("color").agg(
        *aggs, F.regr_slope("dz", "z").alias("slope"), F.regr_intercept("dz", "z").alias("intercept"))


def combine_drift(drifts: DataFrame, warn_spread: float) -> DataFrame:
    """One row: median x and y, spread, warn flag, number of exact (0, 0) results."""
    q = exact_quantiles(drifts, [], "drift_x_um", {"x": 0.5})
    p = exact_quantiles(drifts, [], "drift_y_um", {"y": 0.5})
    spread = F.greatest(F.max("drift_x_um") - F.min("drift_x_um"), F.max("drift_y_um") - F.min("drift_y_um"))
    base = drifts.agg(
        spread.alias("spread"), (spread > warn_spread).alias("warn"),
        F.count_if((F.col("drift_x_um") == 0) & (F.col("drift_y_um") == 0)).alias("n_zero"))
    return base.withColumn("x", q.scalar()).withColumn("y", p.scalar())


def with_distance(drift: DataFrame) -> DataFrame:
    """Add ``distance`` where the table does not bring its own."""
    return drift if "distance" in drift.columns else drift.withColumn("distance", F.hypot("x_drift", "y_drift"))


def drift_matrix(drift: DataFrame, order: str) -> DataFrame:
    """(round, fov, deviation): mean distance per cell minus the median distance; rounds number series by first row.

    The series of a run are few (tens), so ranking their first rows is a small window after an aggregate.
    """
    from stagelight.operators.scan import ordered_scan

    d = with_distance(drift)
    first = d.groupBy("series").agg(F.min(order).alias("_first"))
    rank = ordered_scan(first, [], ["_first", "series"], row_number="_rn").select("series", (F.col("_rn") - 1).alias("round"))
    med = exact_quantiles(d, [], "distance", {"_med": 0.5}).scalar()
    return (
        d.groupBy("series", "fov").agg(F.avg("distance").alias("mean_distance")).join(rank, "series").withColumn("_m", med)
        .select("round", "fov", "mean_distance", (F.col("mean_distance") - F.col("_m")).alias("deviation"))
    )


def drift_summary(drift: DataFrame, scatter_max: float, dist_max: float, auto_pct: float = 99) -> DataFrame:
    """One row: median distance, counts beyond the axes, and the limits chosen when asked to pick them."""
    d = with_distance(drift)
    q = exact_quantiles(d, [], "distance", {"median": 0.5, "_hi": auto_pct / 100})
    both = d.select(F.explode(F.array(F.abs("x_drift"), F.abs("y_drift"))).alias("_a"))
    a = exact_quantiles(both, [], "_a", {"_s": auto_pct / 100}).scalar()
    counts = d.agg(
        F.count_if((F.abs("x_drift") > scatter_max) | (F.abs("y_drift") > scatter_max)).alias("n_off"),
        F.count_if(F.col("distance") > dist_max).alias("n_over"))
    return attach(counts.withColumn("_s", a), q, []).select(
        "median", "n_off", "n_over", nice_limit("_s").alias("auto_scatter"), nice_limit("_hi").alias("auto_distance"))


def drift_histogram(drift: DataFrame, dist_max: float, bin_size: float = 5.0) -> DataFrame:
    """Counts of distances in [0, dist_max] in bins of ``bin_size``, the last edge closed."""
    d = with_distance(drift).where(F.col("distance").between(0, dist_max))
    n_bins = int(-(-dist_max // bin_size))
    b = F.least(F.floor(F.col("distance") / bin_size), F.lit(n_bins - 1)).cast("int")
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mad_outliers(rows: DataFrame, value: str, k: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Flag ``kept``: at most median + k * 1.4826 * MAD (the median when MAD is 0); groups under 3 keep all."""
    keys = keys or []
    stats = attach(rows.groupBy(*keys).agg(F.count("*").alias("_n")), median_and_mad(rows, keys, value), keys)
    full = attach(rows, shared(cut_lineage(stats)), keys)
    limit = F.col("_med") + F.when(F.col("_mad") > 0, k * 1.4826 * F.col("_mad")).otherwise(0.0)
    return full.select(*rows.columns, ((F.col("_n") < 3) | (F.col(value) <= limit)).alias("kept"))


def orientation_vote(shifts: DataFrame) -> DataFrame:
    """Per (transpose, flip_h, flip_v) the number and median of shifts (none: infinity); the smallest has rank 1."""
    keys = ["transpose", "flip_h", "flip_v"]
    n = shifts.groupBy(*keys).agg(F.count("shift").alias("n"))
    med = exact_quantiles(shifts, keys, "shift", {"_m": 0.5})
    from pyspark.sql import Window

    out = n.join(med, keys, "left").withColumn("median_shift", F.coalesce("_m", F.lit(float("inf")))).drop("_m")
    w = Window.orderBy("median_shift", *keys)  # eight rows at most
    return out.withColumn("rank", F.row_number().over(w))


def fit_affine(pairs: DataFrame, *, x: str = "x", y: str = "y", u: str = "u", v: str = "v",
               zero_translation: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Least-squares affine (u, v) = M (x, y) + t in one aggregate, from covariances; under 3 pairs is an error."""
    keys = keys or []
    s = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"), F.avg(v).alias("mv"),
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"),
        F.covar_pop(x, u).alias("xu"), F.covar_pop(y, u).alias("yu"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"),
    )
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    coef = lambda p, q, own: (F.col(p) * F.col(own) - F.col(q) * F.col("xy")) / det
    s = s.select(
        *keys, "n", "mx", "my", "mu", "mv",
        coef("xu", "yu", "yy").alias("a"), coef("yu", "xu", "xx").alias("b"),
        coef("xv", "yv", "yy").alias("c"), coef("yv", "xv", "xx").alias("d"),
    )
    shift = lambda m, p, q: F.lit(0.0) if zero_translation else F.col(m) - F.col(p) * F.col("mx") - F.col(q) * F.col("my")
    enough = F.when(F.col("n") >= 3, F.col("n")).otherwise(F.raise_error(F.lit("at least 3 pairs are needed")).cast("long"))
    return s.select(
        *keys, enough.alias("n"), "a", "b", shift("mu", "a", "b").alias("tx"), "c", "d", shift("mv", "c", "d").alias("ty"),
        F.degrees(F.atan2("c", "a")).alias("rotation_deg"), F.hypot("a", "c").alias("scale"),
    )


def holdout_error(pairs: DataFrame, fitted: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Errors before and after a fit on pairs not used for it: median, mean, max and the reduction in %."""
    rest = attach(pairs.join(used.select(key), key, "left_anti"), fitted, [])
    e = rest.select(
        F.hypot(F.col("u") - F.col("x"), F.col("v") - F.col("y")).alias("before"),
        F.hypot(F.col("u") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx")),
                F.col("v") - (F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty"))).alias("after"),
    )
    m = [exact_quantiles(e, [], c, {f"median_{c}": 0.5}).scalar() for c in ("before", "after")]
    agg = e.agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"),
                F.max("before").alias("max_before"), F.max("after").alias("max_after"))
    out = agg.withColumn("median_before", m[0]).withColumn("median_after", m[1])
    return out.withColumn("reduction_pct", 100 * (1 - F.col("mean_after") / F.col("mean_before")))


def progress_summary(files: DataFrame) -> DataFrame:
    """Expected files (round_id, fov_id, color, imaged, processed): per round and in total (round_id NULL).

    A FOV counts as processed when all its colours are.
    """
    per_fov = files.groupBy("round_id", "fov_id").agg(F.bool_and("imaged").alias("imaged"), F.bool_and("processed").alias("processed"))
    return per_fov.rollup("round_id").agg(
        F.count_if("imaged").alias("imaged"), F.count_if("processed").alias("processed"), F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("processed")).alias("pending"))


def complete_rounds(files: DataFrame) -> DataFrame:
    """Per round whether every expected file exists and is analysed; an empty round is not complete."""
    ok = F.col("imaged") & F.col("processed")
    return files.groupBy("round_id").agg((F.bool_and(ok) & (F.count(F.lit(1)) > 0)).alias("complete"))


def pending_rounds(files: DataFrame, results: DataFrame) -> DataFrame:
    return complete_rounds(files).where("complete").select("round_id").join(results.select("round_id"), "round_id", "left_anti")


def storage_audit(files: DataFrame, keys: list[str], now: Column, min_gb: float = 0.0, by: str = "age_days") -> DataFrame:
    """Size, file count, first and last change, GB (1e9) and age in days per owner, oldest or largest first."""
    a = files.groupBy(*keys).agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n_files"),
        F.min("modificationTime").alias("earliest"), F.max("modificationTime").alias("latest"))
    gb = F.col("bytes") / 1e9
    return a.withColumn("gb", gb).withColumn("age_days", F.datediff(now, F.col("latest"))).where(gb >= min_gb).orderBy(F.desc(by))


def case_insensitive_group(rows: DataFrame, name: str, aggs: list[Column]) -> DataFrame:
    """Group by the lower-cased name; shown as all spellings joined by `` / ``, in case-folded order.

    The spellings of a name differ in case only, so the set of each group is small.
    """
    spelled = F.array_join(F.sort_array(F.collect_set(name)), " / ").alias("display")
    return rows.groupBy(F.lower(name).alias("key")).agg(spelled, *aggs).orderBy("key")


def job_resources(jobs: DataFrame) -> DataFrame:
    """Per task of completed ``_N.batch`` rows: n and min/mean/max of seconds and of memory in MiB.

    jobs: task, JobID, State, ElapsedRaw, Elapsed, MaxRSS (text).
    """
    p = F.split("Elapsed", "[-:]")
    hms = F.element_at(p, -1).cast("double") + F.element_at(p, -2).cast("double") * 60 + F.element_at(p, -3).cast("double") * 3600 \
        + F.when(F.size(p) > 3, p[0].cast("double") * 86400).otherwise(0.0)
    raw = F.nullif(F.trim("ElapsedRaw"), F.lit("")).cast("double")
    amount = F.nullif(F.regexp_extract("MaxRSS", r"^([0-9.]+)", 1), F.lit("")).cast("double")
    unit = F.regexp_extract("MaxRSS", r"([KMG])$", 1)
    mib = F.when(unit == "K", amount / 1024).when(unit == "M", amount).when(unit == "G", amount * 1024).otherwise(amount / 1048576)
    done = jobs.where((F.col("State") == "COMPLETED") & F.col("JobID").rlike(r"_\d+\.batch$"))
    m = done.select("task", F.coalesce(raw, hms).alias("s"), mib.alias("m"))
    return m.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("min_s"), F.avg("s").alias("mean_s"), F.max("s").alias("max_s"),
        F.min("m").alias("min_mib"), F.avg("m").alias("mean_mib"), F.max("m").alias("max_mib"))


def task_marker_status(markers: DataFrame) -> DataFrame:
    """Per (run, task): fragments done, in error (and not done), running (started only) and in total."""
    has = lambda m: F.bool_or(F.col("marker") == m)
    frag = markers.groupBy("run", "task", "fragment").agg(has("done").alias("d"), has("error").alias("e"), has("start").alias("s"))
    return frag.groupBy("run", "task").agg(
        F.count_if("d").alias("done"), F.count_if(F.col("e") & ~F.col("d")).alias("error"),
        F.count_if(F.col("s") & ~F.col("e") & ~F.col("d")).alias("running"), F.count(F.lit(1)).alias("total"))


def status_table(status: DataFrame, runs: list[str]) -> DataFrame:
    """Tasks in rows, the named runs in columns, ``done/total`` in the cells."""
    text = F.concat_ws("/", F.col("done"), F.col("total"))
    return status.groupBy("task").pivot("run", runs).agg(F.first(text))


def square_scores(windows: DataFrame, keys: list[str], line: float, step: int = 144) -> DataFrame:
    """Mean damage per square; each window covers 2 x 2 squares of ``step`` pixels."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    w = windows.withColumn("_o", o).withColumn("i", (F.floor(F.col("wy") / step) + F.col("_o.i")).cast("int")).withColumn(
        "j", (F.floor(F.col("wx") / step) + F.col("_o.j")).cast("int"))
    s = w.groupBy(*keys, "i", "j").agg(F.avg("p_damaged").alias("score"), F.count("p_damaged").alias("n_windows"))
    return s.withColumn("removed", F.col("score") > line)


def damaged_share(windows: DataFrame, keys: list[str], damaged_p: float = 0.5) -> DataFrame:
    """100 * tissue in damaged windows / tissue, after averaging the planes of a window."""
    per = windows.groupBy(*keys, "wy", "wx").agg(F.avg("fg_frac").alias("fg"), F.avg("p_damaged").alias("p"))
    bad = F.sum(F.when(F.col("p") > damaged_p, F.col("fg")).otherwise(0.0))
    return per.groupBy(*keys).agg(
        (100 * bad / F.nullif(F.sum("fg"), F.lit(0.0))).alias("damaged_pct"), F.count(F.lit(1)).alias("n_windows"))


def haze_level(levels: DataFrame, level: str, fg: str, empty_fg: float = 0.01) -> DataFrame:
    """Median level of FOVs with almost no tissue, 0 when there is none."""
    empty = levels.where(F.col(fg) < empty_fg)
    q = exact_quantiles(empty, [], level, {"haze": 0.5})
    return q.agg(F.coalesce(F.max("haze"), F.lit(0.0)).alias("haze"))


def sequence_name(frames: DataFrame, keys: list[str], separator: str = "_", sequential: bool = False) -> DataFrame:
    """``blkfN_560fM_...``: blank count first, then colours ascending (a handful of colours per key)."""
    n = frames.groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("_n"))
    token = F.when(F.col("color").isNull(), F.concat(F.lit("blkf"), "_n")).otherwise(
        F.concat(F.col("color").cast("int").cast("string"), F.lit("f"), F.col("_n").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct(F.coalesce("color", F.lit(-1.0)).alias("o"), token.alias("t"))))
    name = F.array_join(F.transform(parts, lambda p: p["t"]), separator)
    return n.groupBy(*keys).agg((F.concat(name, F.lit(separator + "seq")) if sequential else name).alias("name"))
