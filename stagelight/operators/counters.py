"""Exact per-frame value counters and everything derived from them.

A counter row is (keys..., value INT, count BIGINT). Pixels are 16-bit, so a frame has at most 65,536 rows and
counters of parts of a frame merge by addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_counter(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sparse exact counter per key: one shuffle of already combined (key, value) counts."""
    return pixels.groupBy(*keys, F.col(value).cast("int").alias("value")).agg(
        F.count(F.lit(1)).cast("long").alias("count")
    )


def counter_arrays(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Storage form: two parallel arrays per key, values ascending."""
    pairs = F.sort_array(F.collect_list(F.struct("value", "count")))
    return (
        counters.groupBy(*keys).agg(pairs.alias("_p"))
        .select(*keys, F.col("_p.value").alias("values"), F.col("_p.count").alias("counts"))
    )


def counter_rows(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of :func:`counter_arrays`."""
    return arrays.select(*keys, F.explode(F.arrays_zip("values", "counts")).alias("_p")).select(
        *keys, F.col("_p.values").alias("value"), F.col("_p.counts").alias("count")
    )


def weighted_mean() -> Column:
    return F.sum(F.col("value").cast("double") * F.col("count")) / F.sum("count")


def counter_mean(counters: DataFrame, keys: list[str]) -> DataFrame:
    return counters.groupBy(*keys).agg(weighted_mean().alias("mean"))


def frame_stats(counters: DataFrame, keys: list[str]) -> DataFrame:
    """min, max, mean, median, population std and linear p01 / p99 of each frame, from its counter.

    The sums are exact integers (decimal), so the variance does not cancel. ``percentile`` with a frequency keeps
    one entry per distinct 16-bit value.
    """
    v, c = F.col("value").cast("decimal(10,0)"), F.col("count").cast("decimal(14,0)")
    n = F.sum("count").cast("double")
    s1, s2 = F.sum(v * c), F.sum(v * v * c)
    mean = s1.cast("double") / n
    q = F.percentile("value", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)), F.col("count"))
    return (
        counters.groupBy(*keys)
        .agg(
            F.min("value").alias("min"), F.max("value").alias("max"), mean.alias("mean"), q.alias("_q"),
            n.alias("_n"), s1.cast("decimal(19,0)").alias("_s1"), s2.cast("double").alias("_s2"),
        )
        .withColumn("_var", (F.col("_s2") - F.col("_s1").cast("double") * F.col("mean")) / F.col("_n"))
        .select(
            *keys, "min", "max", "mean", F.col("_q")[1].alias("median"),
            F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))).alias("std"),
            F.col("_q")[0].alias("p01"), F.col("_q")[2].alias("p99"),
        )
    )


def histogram_bin(value: Column | str, n_bins: int, lo: float, hi: float) -> Column:
    """Bin of a value in [lo, hi]: the right edge falls in the last bin; outside gives NULL.

    When the width is a power of two of whole numbers the bin is a shift.
    """
    v = F.col(value) if isinstance(value, str) else value
    width = (hi + 1 - lo) / n_bins
    whole = width == int(width) and int(width) & (int(width) - 1) == 0 and lo == 0 and hi == int(hi) and hi > 1
    if whole:
        b = F.shiftright(v.cast("int"), int(width).bit_length() - 1)
    else:
        b = F.least(F.floor((v - lo) / ((hi - lo) / n_bins)).cast("int"), F.lit(n_bins - 1))
    return F.when((v >= lo) & (v <= hi), b)


def fixed_histogram(counters: DataFrame, keys: list[str], n_bins: int = 512, lo: float = 0, hi: float = 65535) -> DataFrame:
    """Dense histogram per key: (keys, bin, bin_center, n), zeros included."""
    binned = (
        counters.withColumn("bin", histogram_bin("value", n_bins, lo, hi))
        .groupBy(*keys, "bin").agg(F.sum("count").alias("n"))
    )
    dense = binned.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("_m")
    )
    width = (hi - lo) / n_bins
    return dense.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")).select(
        *keys, "bin", (F.lit(float(lo)) + (F.col("bin") + 0.5) * F.lit(float(width))).alias("bin_center"),
        F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long").alias("n"),
    )


def counter_percentiles(counters: DataFrame, keys: list[str], pcts: dict[str, float]) -> DataFrame:
    """Discrete percentiles: smallest value whose cumulative count reaches pct/100 of the total; all in one pass."""
    w = Window.partitionBy(*keys)
    cum = F.sum("count").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(w)
    return counters.select(*keys, "value", cum.alias("_cum"), total.alias("_n")).groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_cum") * 100.0 >= F.lit(float(p)) * F.col("_n"), F.col("value"))).alias(name)
            for name, p in pcts.items()
        ]
    )


def rebin_counter(counters: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
    """Weighted histogram over arbitrary edges, right-open but for the last bin."""
    lit = F.array(*[F.lit(float(e)) for e in edges])
    v = F.col("value").cast("double")
    at = F.size(F.filter(lit, lambda e: e <= v)) - 1
    b = F.when((v >= float(edges[0])) & (v <= float(edges[-1])), F.least(at, F.lit(len(edges) - 2)))
    return counters.withColumn("bin", b).where("bin is not null").groupBy(*keys, "bin").agg(F.sum("count").alias("n"))


def true_pixels(threshold: Column | float) -> Column:
    """Aggregate: number of pixels at or above the threshold."""
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    return F.coalesce(F.sum(F.when(F.col("value") >= t, F.col("count"))), F.lit(0)).cast("long")


def true_pixel_count(counters: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    return counters.groupBy(*keys).agg(true_pixels(threshold).alias("tpc"))


def intensity_percentile_table(counters: DataFrame, frame_table: DataFrame, keys: list[str],
                               frame_keys: list[str], pcts=(25, 50, 75, 95)) -> DataFrame:
    """min, discrete percentiles and max per frame with z and color; a frame unknown to the table keeps NULL there."""
    table = counter_percentiles(
        counters, keys, {"min": 0.0, **{f"p{p:g}": float(p) for p in pcts}, "max": 100.0}
    )
    return table.join(frame_table.select(*frame_keys, "z", "color"), frame_keys, "left")


def signal_extent(profile: DataFrame, keys: list[str], limit: float, z: str = "z", tpc: str = "tpc") -> DataFrame:
    """First and last z whose count exceeds ``limit`` (strictly), and whether every plane between does.

    The planes of a key are a z-stack (hundreds at most); the aggregate needs no window over them.
    """
    passed = F.col(tpc) > limit
    planes = F.sort_array(F.collect_list(F.struct(F.col(z).alias("z"), passed.alias("ok"))))
    got = profile.groupBy(*keys).agg(
        F.min(F.when(passed, F.col(z))).alias("z_first"), F.max(F.when(passed, F.col(z))).alias("z_last"),
        planes.alias("_p"),
    )
    inside = F.filter("_p", lambda p: (p["z"] >= F.col("z_first")) & (p["z"] <= F.col("z_last")))
    return got.select(
        *keys, "z_first", "z_last",
        F.coalesce(F.forall(inside, lambda p: p["ok"]), F.lit(True)).alias("is_contiguous"),
    )


def background_threshold(counters: DataFrame, keys: list[str], n_background: int, pct: float = 100.0) -> DataFrame:
    """One row: the largest ``pct`` percentile (linear) among the ``n_background`` lowest-mean images."""
    q = F.max("value").cast("double") if pct >= 100 else F.percentile("value", F.lit(pct / 100), F.col("count"))
    images = counters.groupBy(*keys).agg(weighted_mean().alias("mean"), q.alias("q"))
    return images.orderBy("mean", *keys).limit(n_background).agg(F.max("q").alias("threshold"))


def tissue_fraction(counters: DataFrame, fov: str, plane_keys: list[str], n_background: int = 10) -> DataFrame:
    """Per FOV the largest share over planes of pixels at or above the background threshold."""
    threshold = background_threshold(counters, plane_keys, n_background).scalar()
    share = (
        counters.withColumn("_t", threshold).groupBy(*plane_keys)
        .agg((true_pixels(F.col("_t")) / F.sum("count")).alias("share"))
    )
    return share.groupBy(fov).agg(F.max("share").alias("tissue_fraction"))
