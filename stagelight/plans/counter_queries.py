"""Counter and frame-statistics queries (lineitem as pixels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators import counters as C
from stagelight.plans.registry import query
from stagelight.plans.tables import CT, FT, PX, frame_table, pixels, positions, PS, r6

KEYS = ["fov_id", "frame", "color"]


def counters(spark, d):
    return C.exact_counter(pixels(spark, d), KEYS)


@query("A1_frame_stats", f"""WITH {PX} SELECT fov_id, frame, color, min(value) AS min, max(value) AS max,
  round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99
  FROM px GROUP BY fov_id, frame, color""")
def _(spark, d):
    s = C.frame_stats(counters(spark, d), KEYS)
    return s.select(*KEYS, "min", "max", *[r6(c).alias(c) for c in ("mean", "median", "std", "p01", "p99")])


@query("A2_fixed_histogram", f"""WITH {CT}, k AS (SELECT DISTINCT fov_id, frame, color FROM ct),
  b AS (SELECT unnest(range(16)) AS bin),
  h AS (SELECT fov_id, frame, color, value // 4 AS bin, sum(count) AS n FROM ct WHERE value BETWEEN 0 AND 63 GROUP BY ALL)
  SELECT k.fov_id, k.frame, k.color, CAST(b.bin AS INTEGER) AS bin, round((b.bin + 0.5e0) * 63e0 / 16, 6) AS bin_center,
  CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM k CROSS JOIN b
  LEFT JOIN h ON h.fov_id = k.fov_id AND h.frame = k.frame AND h.color = k.color AND h.bin = b.bin""")
def _(spark, d):
    h = C.fixed_histogram(counters(spark, d), KEYS, n_bins=16, lo=0, hi=63)
    return h.withColumn("bin_center", r6("bin_center"))


@query("A3_exact_counter", f"WITH {CT} SELECT fov_id, frame, color, value, count FROM ct")
def _(spark, d):
    return counters(spark, d)


@query("A4_counter_mean", f"WITH {PX} SELECT fov_id, frame, color, round(avg(value), 6) AS mean FROM px GROUP BY ALL")
def _(spark, d):
    return C.counter_mean(counters(spark, d), KEYS).withColumn("mean", r6("mean"))


@query("A5_counter_percentile", f"""WITH {PX} SELECT fov_id, frame, color, quantile_disc(value, 0.25) AS p25,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM px GROUP BY fov_id, frame, color""")
def _(spark, d):
    return C.counter_percentiles(counters(spark, d), KEYS, {"p25": 25, "p50": 50, "p90": 90})


@query("A6_rebin_counter", f"""WITH {PX} SELECT fov_id, color, CAST(CASE WHEN value < 10 THEN 0 WHEN value < 11 THEN 1
  WHEN value < 30 THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS n FROM px
  WHERE value BETWEEN 2 AND 45 GROUP BY ALL""")
def _(spark, d):
    return C.rebin_counter(counters(spark, d), ["fov_id", "color"], [2, 10, 11, 30, 45])


@query("A7_true_pixel_count", f"""WITH {PX} SELECT fov_id, frame, color,
  count(*) FILTER (WHERE value >= 40) AS tpc FROM px GROUP BY fov_id, frame, color""")
def _(spark, d):
    return C.true_pixel_count(counters(spark, d), KEYS, 40)


@query("A8_intensity_percentile_table", f"""WITH {PX}, {FT}, s AS (SELECT fov_id, frame, color, min(value) AS min,
  quantile_disc(value, 0.25) AS p25, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75,
  quantile_disc(value, 0.95) AS p95, max(value) AS max FROM px GROUP BY fov_id, frame, color)
  SELECT s.fov_id, s.frame, s.color AS channel_nm, s.min, p25, p50, p75, p95, s.max, ft.z, ft.color FROM s
  LEFT JOIN ft ON ft.frame = s.frame AND ft.color = s.color AND ft.segment = 'data'""")
def _(spark, d):
    ft = frame_table(spark, d).where("segment = 'data'").withColumn("channel_nm", F.col("color"))
    ct = counters(spark, d).withColumnRenamed("color", "channel_nm")
    return C.intensity_percentile_table(ct, ft, ["fov_id", "frame", "channel_nm"], ["frame", "channel_nm"])


@query("A9_signal_extent_profile", f"""WITH {PX}, p AS (SELECT fov_id, color, frame * 0.5e0 AS z,
  count(*) FILTER (WHERE value >= 45) AS tpc FROM px GROUP BY ALL),
  e AS (SELECT fov_id, color, min(z) FILTER (WHERE tpc > 2) AS z_first, max(z) FILTER (WHERE tpc > 2) AS z_last
  FROM p GROUP BY ALL)
  SELECT fov_id, color, any_value(z_first) AS z_first, any_value(z_last) AS z_last,
  coalesce(bool_and(tpc > 2) FILTER (WHERE z BETWEEN z_first AND z_last), true) AS is_contiguous
  FROM p JOIN e USING (fov_id, color) GROUP BY fov_id, color""")
def _(spark, d):
    p = C.true_pixel_count(counters(spark, d), KEYS, 45).withColumn("z", F.col("frame") * 0.5)
    return C.signal_extent(p, ["fov_id", "color"], 2)


@query("A10_background_threshold", f"""WITH {PX}, i AS (SELECT fov_id, frame, color, avg(value) AS mean,
  quantile_cont(value, 0.9) AS q FROM px GROUP BY ALL),
  l AS (SELECT q FROM i ORDER BY mean, fov_id, frame, color LIMIT 10) SELECT round(max(q), 6) AS threshold FROM l""")
def _(spark, d):
    return C.background_threshold(counters(spark, d), KEYS, 10, 90.0).select(r6("threshold").alias("threshold"))


@query("A11_tissue_fraction", f"""WITH {PX}, i AS (SELECT fov_id, frame, color, avg(value) AS mean, max(value) AS q
  FROM px GROUP BY ALL), t AS (SELECT max(q) AS t FROM (SELECT q FROM i ORDER BY mean, fov_id, frame, color LIMIT 10)),
  s AS (SELECT fov_id, frame, color, avg(CAST(value >= (SELECT t FROM t) AS INTEGER)) AS share FROM px GROUP BY ALL)
  SELECT fov_id, round(max(share), 6) AS tissue_fraction FROM s GROUP BY fov_id""")
def _(spark, d):
    f = C.tissue_fraction(counters(spark, d), "fov_id", KEYS)
    return f.withColumn("tissue_fraction", r6("tissue_fraction"))


@query("flagship_signal_by_position", f"""WITH {PX}, {PS}, s AS (SELECT fov_id, frame, quantile_cont(value, 0.5) AS median
  FROM px WHERE color = 560 GROUP BY ALL),
  b AS (SELECT max(q) AS t FROM (SELECT max(value) AS q FROM px GROUP BY fov_id, frame, color
        ORDER BY avg(value), fov_id, frame, color LIMIT 10))
  SELECT s.fov_id, s.frame * 0.5e0 AS z, x, y, round(median, 6) AS median,
  CAST((SELECT t FROM b) AS DOUBLE) AS background FROM s JOIN ps USING (fov_id) WHERE s.frame <> 1""")
def flagship(spark, d):
    """Median signal per FOV and plane of one colour, with stage position and background level."""
    ct = counters(spark, d)
    background = C.background_threshold(ct, KEYS, 10).scalar()
    stats = C.frame_stats(ct.where("color = 560"), KEYS).where("frame <> 1")
    return (
        stats.join(positions(spark, d), "fov_id")
        .select("fov_id", (F.col("frame") * 0.5).alias("z"), "x", "y", r6("median").alias("median"))
        .withColumn("background", background)
    )


@query("S14_counter_store", f"WITH {CT} SELECT fov_id, frame, color, value, count FROM ct")
def _(spark, d):
    return C.counter_rows(C.counter_arrays(counters(spark, d), KEYS), KEYS)
