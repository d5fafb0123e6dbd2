"""Pixel and block table queries (embeddings as 8x8 frames)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators import pixels as X
from stagelight.operators import windows as W
from stagelight.operators.spatial_stats import median_nn_distance
from stagelight.plans.registry import query
from stagelight.plans.tables import IMG, PS, blur_sql, images, positions, r6


@query("P12_orient_pixels", f"WITH {IMG} SELECT frame, c AS r, 7 - r AS c, v FROM img")
def _(spark, d):
    return X.orient(images(spark, d), 8, 8).select("frame", "r", "c", "v")


@query("P12_orient_rot180", f"WITH {IMG} SELECT frame, 7 - r AS r, 7 - c AS c, v FROM img")
def _(spark, d):
    return X.orient_named(images(spark, d), 8, 8, "rot180").select("frame", "r", "c", "v")


FIELD = """mn AS (SELECT r, c, avg(v) AS v FROM img GROUP BY r, c),
  ff AS (SELECT r, c, greatest(v / (SELECT quantile_cont(v, 0.9999) FROM mn), 0.1e0) AS f FROM mn)"""


def field(spark, d):
    return X.flat_field(images(spark, d), [], sigma=0).drop("n_samples")


@query("P13_apply_flat_field", f"WITH {IMG}, {FIELD} SELECT frame, r, c, round(greatest(v / f, 0), 6) AS v FROM img JOIN ff USING (r, c)")
def _(spark, d):
    return X.apply_flat_field(images(spark, d), field(spark, d), []).select("frame", "r", "c", r6("v").alias("v"))


@query("P14_crop", f"""WITH {IMG} SELECT frame, 'centre' AS kind, r - 1 AS r, c - 1 AS c, v FROM img WHERE r BETWEEN 1 AND 5 AND c BETWEEN 1 AND 5
  UNION ALL SELECT frame, 'border', r - 2, c - 2, v FROM img WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5""")
def _(spark, d):
    img = images(spark, d)
    a = X.crop_center(img, 8, 8, 5).select("frame", F.lit("centre").alias("kind"), "r", "c", "v")
    b = X.crop_border(img, 8, 8, X.mosaic_border(8, 0.55)).select("frame", F.lit("border").alias("kind"), "r", "c", "v")
    return a.unionByName(b)


@query("A12_z_projection", f"""WITH {IMG} SELECT grp, r, c, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM img GROUP BY grp, r, c""")
def _(spark, d):
    p = X.z_projection(images(spark, d), ["grp"], ["min", "max", "mean", "median"])
    return p.select("grp", "r", "c", "min", "max", r6("mean").alias("mean"), r6("median").alias("median"))


@query("A13_flat_field", f"""WITH {IMG}, m AS (SELECT grp, r, c, avg(v) AS v, count(*) AS n FROM img GROUP BY ALL),
  t AS (SELECT grp, quantile_cont(v, 0.9999) AS top, max(n) AS n_samples FROM m GROUP BY grp)
  SELECT grp, r, c, round(greatest(v / top, 0.1e0), 6) AS v, n_samples FROM m JOIN t USING (grp)""")
def _(spark, d):
    return X.flat_field(images(spark, d), ["grp"], sigma=0).select("grp", "r", "c", r6("v").alias("v"), "n_samples")


@query("A13_flat_field_blurred", f"""WITH {IMG}, m AS (SELECT grp, r, c, avg(v) AS v, count(*) AS n FROM img GROUP BY ALL), {blur_sql('m', 'grp', 8, 1.5)},
  t AS (SELECT grp, quantile_cont(bl.v, 0.9999) AS top, max(n) AS n_samples FROM bl JOIN m USING (grp, r, c) GROUP BY grp)
  SELECT grp, r, c, round(greatest(v / top, 0.1e0), 6) AS v, n_samples FROM bl JOIN t USING (grp)""")
def _(spark, d):
    return X.flat_field(images(spark, d), ["grp"], sigma=1.5).select("grp", "r", "c", r6("v").alias("v"), "n_samples")


@query("A15_field_convergence", f"""WITH {IMG}, k AS (SELECT DISTINCT frame FROM img), rk AS (SELECT frame, row_number() OVER (ORDER BY frame) AS k FROM k),
  f AS (SELECT s.size, r, c, avg(v) AS f FROM img JOIN rk USING (frame) JOIN (VALUES (10), (50), (200)) s(size) ON rk.k <= s.size GROUP BY ALL),
  m AS (SELECT r, c, avg(v) AS ref FROM img GROUP BY ALL), d AS (SELECT size, 100 * abs(f - ref) / ref AS d FROM f JOIN m USING (r, c) WHERE ref > 0)
  SELECT size, round(quantile_cont(d, 0.5), 6) AS median_pct, round(quantile_cont(d, 0.95), 6) AS p95_pct FROM d GROUP BY size""")
def _(spark, d):
    img = images(spark, d)
    ranked = img.join(_ranks(img), "frame")
    c = X.field_convergence(ranked, "k", [10, 50, 200])
    return c.select("size", r6("median_pct").alias("median_pct"), r6("p95_pct").alias("p95_pct"))


def _ranks(img):
    from stagelight.operators.scan import ordered_scan

    return ordered_scan(img.select("frame").distinct(), [], ["frame"], row_number="k")


@query("A16_block_mean", f"WITH {IMG} SELECT frame, r // 3 AS r, c // 3 AS c, round(sum(v) / 9e0, 6) AS v FROM img GROUP BY frame, r // 3, c // 3")
def _(spark, d):
    return X.block_mean(images(spark, d), ["frame"], 3).withColumn("v", r6("v"))


ELEV = """bl AS (SELECT grp, frame % 12 AS z, r // 2 AS r, c // 2 AS c, sum(v) / 4e0 AS v FROM img GROUP BY grp, frame, r // 2, c // 2),
  el AS (SELECT grp, r, c, coalesce(max(CAST(z AS DOUBLE)) FILTER (WHERE v >= 1100), 0) AS z FROM bl GROUP BY ALL)"""


def elevation(spark, d):
    b = X.block_mean(images(spark, d), ["grp", "frame"], 2).withColumn("zp", F.col("frame") % 12)
    return X.elevation_map(b, ["grp"], "zp", 1100)


@query("A17_elevation_map", f"WITH {IMG}, {ELEV} SELECT grp, r, c, z FROM el")
def _(spark, d):
    return elevation(spark, d)


@query("A18_fov_depth", f"""WITH {IMG}, {ELEV}, t AS (SELECT grp, max(z) AS top FROM el GROUP BY grp)
  SELECT grp, nullif(max(top), 0) AS z_last, round(avg(CASE WHEN z > 0 THEN CAST(z = top AS INTEGER) END), 6) AS share_at_depth FROM el JOIN t USING (grp) GROUP BY grp""")
def _(spark, d):
    return X.fov_depth(elevation(spark, d), ["grp"]).withColumn("share_at_depth", r6("share_at_depth"))


@query("A19_pooled_contrast_range", f"""WITH {IMG}, q AS (SELECT grp, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM img WHERE frame % 3 <> 0 GROUP BY grp)
  SELECT g.grp, round(lo, 6) AS lo, round(CASE WHEN hi > lo THEN hi ELSE lo + 1 END, 6) AS hi FROM (SELECT DISTINCT grp FROM img) g LEFT JOIN q USING (grp)""")
def _(spark, d):
    img = images(spark, d)
    interior = img.where("frame % 3 <> 0")
    rng = X.contrast_range(interior, ["grp"], 1, 99)
    return img.select("grp").distinct().join(rng, "grp", "left").select("grp", r6("lo").alias("lo"), r6("hi").alias("hi"))


LD = """l AS (SELECT grp, log10(greatest(v, 1)) AS l FROM img), s AS (SELECT min(l) AS lo, max(l) AS hi, (max(l) - min(l)) / 40 AS w FROM l),
  h AS (SELECT grp, CAST(least(floor((l - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY ALL),
  dn AS (SELECT grp, bin, lo + (bin + 0.5e0) * w AS center, n, n / (sum(n) OVER (PARTITION BY grp) * w) AS density FROM h, s)"""


@query("A20_log_density_histogram", f"WITH {IMG}, {LD} SELECT grp, bin, round(center, 6) AS center, n, round(density, 6) AS density FROM dn")
def _(spark, d):
    h = X.log_density(images(spark, d), "grp", 40)
    return h.select("grp", "bin", r6("center").alias("center"), "n", r6("density").alias("density"))


@query("A20_pooled_log_density", f"WITH {IMG}, {LD} SELECT bin, round(any_value(center), 6) AS center, round(sum(density) / (SELECT count(DISTINCT grp) FROM dn), 6) AS density FROM dn GROUP BY bin")
def _(spark, d):
    p = X.pooled_log_density(X.log_density(images(spark, d), "grp", 40), "grp")
    return p.select("bin", r6("center").alias("center"), r6("density").alias("density"))


TILES = """t AS (SELECT frame, log10(quantile_cont(greatest(v, 1), 0.99)) AS stat FROM img GROUP BY frame),
  s AS (SELECT min(stat) AS lo, max(stat) AS hi, (max(stat) - min(stat)) / 256 AS w FROM t),
  h AS (SELECT least(floor((stat - lo) / w), 255) AS b, count(*) AS n FROM t, s GROUP BY ALL),
  x AS (SELECT b, n, lo + (b + 0.5e0) * w AS x FROM h, s),
  k AS (SELECT b, x, sum(n) OVER (ORDER BY b) AS w1, sum(n * x) OVER (ORDER BY b) AS s1, sum(n) OVER () AS w, sum(n * x) OVER () AS s FROM x),
  o AS (SELECT x AS threshold FROM k WHERE w > w1 ORDER BY round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 9) DESC, b LIMIT 1)"""


@query("A21_otsu_tiles", f"WITH {IMG}, {TILES} SELECT frame, round(stat, 6) AS stat, round(threshold, 6) AS threshold, stat >= threshold AS is_signal FROM t, o")
def _(spark, d):
    t = X.classify_tiles(images(spark, d), "frame")
    return t.select("frame", r6("stat").alias("stat"), r6("threshold").alias("threshold"), "is_signal")


@query("A20_balanced_log_density", f"""WITH {IMG}, {TILES}, sg AS (SELECT frame, stat >= threshold AS is_signal FROM t, o),
  l AS (SELECT is_signal, log10(greatest(v, 1)) AS l FROM img JOIN sg USING (frame)), q AS (SELECT min(l) AS lo, (max(l) - min(l)) / 40 AS w FROM l),
  g AS (SELECT is_signal, CAST(least(floor((l - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM l, q GROUP BY ALL),
  e AS (SELECT bin, lo + (bin + 0.5e0) * w AS center, 0.5e0 * n / (sum(n) OVER (PARTITION BY is_signal) * w) AS density FROM g, q)
  SELECT bin, round(any_value(center), 6) AS center, round(sum(density), 6) AS density FROM e GROUP BY bin""")
def _(spark, d):
    img = images(spark, d)
    b = X.balanced_log_density(X.log_density(img, "frame", 40), X.classify_tiles(img, "frame").select("frame", "is_signal"), "frame")
    return b.select("bin", r6("center").alias("center"), r6("density").alias("density"))


@query("A21_valley", f"""WITH {IMG}, {LD}, hs AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY bin) - 1 AS i, center, density AS y FROM dn),
  nw AS (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY grp ORDER BY i) THEN 0 ELSE 1 END AS new FROM hs), nr AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY i) AS k FROM nw),
  ru AS (SELECT grp, k, min(i) AS s, max(i) AS e, any_value(y) AS y FROM nr GROUP BY grp, k), rn AS (SELECT *, lag(y) OVER w AS yl, lead(y) OVER w AS yr FROM ru WINDOW w AS (PARTITION BY grp ORDER BY k)),
  pk AS (SELECT * FROM rn WHERE y > yl AND y > yr), hi AS (SELECT pk.grp, pk.k, any_value(pk.s) AS s, any_value(pk.e) AS e, any_value(pk.y) AS y,
    coalesce(max(hs.i) FILTER (hs.i < pk.s AND hs.y > pk.y), -1) AS l, coalesce(min(hs.i) FILTER (hs.i > pk.e AND hs.y > pk.y), 1000000) AS r FROM pk JOIN hs USING (grp) GROUP BY pk.grp, pk.k),
  pr AS (SELECT hi.grp, hi.k, (any_value(s) + any_value(e)) // 2 AS pos, any_value(hi.y) - greatest(min(hs.y) FILTER (hs.i > l AND hs.i < s), min(hs.y) FILTER (hs.i > e AND hs.i < r)) AS p, max(hs.y) AS top
    FROM hi JOIN hs USING (grp) GROUP BY hi.grp, hi.k),
  mx AS (SELECT grp, max(y) AS top FROM hs GROUP BY grp), rk AS (SELECT pr.grp, pos, row_number() OVER (PARTITION BY pr.grp ORDER BY p DESC, pos) AS n FROM pr JOIN mx USING (grp) WHERE p >= 0.05e0 * mx.top),
  ed AS (SELECT grp, min(pos) AS a, max(pos) AS z, count(*) AS n FROM rk WHERE n <= 2 GROUP BY grp),
  va AS (SELECT ed.grp, arg_min(center, y * 1000 + i / 1e9) AS x FROM ed JOIN hs ON hs.grp = ed.grp AND i BETWEEN a AND z WHERE n = 2 GROUP BY ed.grp)
  SELECT g.grp, round(pow(10, x), 6) AS threshold FROM (SELECT DISTINCT grp FROM hs) g LEFT JOIN va USING (grp)""")
def _(spark, d):
    h = X.log_density(images(spark, d), "grp", 40)
    v = X.valley_threshold(h.select("grp", "bin", "center", "density"), ["grp"])
    return v.select("grp", F.round(F.nanvl("threshold", F.lit(None).cast("double")), 6).alias("threshold"))


CAN = """tl AS (SELECT DISTINCT frame, 6e0 * (frame % 20) AS x_um, 6e0 * (frame // 20 % 20) AS y_um, frame * 7 % 31 AS zvalue FROM img),
  og AS (SELECT min(x_um - 4) AS x0, min(y_um - 4) AS y0 FROM tl)"""


@query("W18_topmost_wins_composite", f"""WITH {IMG}, {CAN} SELECT CAST(round_even((y_um - 4 - y0) / 2, 0) AS BIGINT) + r // 2 AS "row", CAST(round_even((x_um - 4 - x0) / 2, 0) AS BIGINT) + c // 2 AS col,
  arg_max(v, zvalue * 1000000000 + frame) AS v FROM img JOIN tl USING (frame), og WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY ALL""")
def _(spark, d):
    img = images(spark, d)
    k = F.col("frame")
    tiles = img.select("frame").distinct().select(
        "frame", (6.0 * (k % 20)).alias("x_um"), (6.0 * (F.floor(k / 20) % 20)).alias("y_um"), (k * 7 % 31).alias("zvalue"),
        F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1.0).alias("pixel_size_um"),
    )
    return X.topmost_composite(tiles, img, "frame", 2.0)


@query("W19_mosaic_layout", f"""WITH {PS}, e AS (SELECT a.fov_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM ps a JOIN ps b ON a.fov_id <> b.fov_id GROUP BY a.fov_id),
  k AS (SELECT (8 + 2) / median(d) AS k FROM e), s AS (SELECT min(x) AS x0, max(x) AS x1, min(-y) AS y0, max(-y) AS y1 FROM ps)
  SELECT fov_id, CAST(trunc((x - x0) * k + 2) AS INTEGER) AS px, CAST(trunc((-y - y0) * k + 2) AS INTEGER) AS py,
  CAST(trunc((x1 - x0) * k + 2) AS INTEGER) + 10 AS canvas_w, CAST(trunc((y1 - y0) * k + 2) AS INTEGER) + 10 AS canvas_h FROM ps, k, s""")
def _(spark, d):
    return layout(spark, d).select("fov_id", "px", "py", "canvas_w", "canvas_h")


def layout(spark, d):
    p = positions(spark, d)
    return X.mosaic_layout(p, 8, 8, 2, X.mosaic_scale(median_nn_distance(p, 400.0), 8, 8, 2), flip_y=True)


@query("W20_assemble_mosaic", f"""WITH {IMG}, {PS}, ce AS (SELECT CAST(y / 40 AS BIGINT) + r AS "row", CAST(x / 40 AS BIGINT) + c AS col, CAST(arg_max(v, fov_id) AS DOUBLE) AS v FROM img JOIN ps ON ps.fov_id = img.frame GROUP BY ALL),
  q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM ce)
  SELECT "row", col, v, CAST(floor(least(1e0, greatest(0e0, (v - lo) / (hi - lo))) * 255) AS INTEGER) AS v8 FROM ce, q""")
def _(spark, d):
    p = positions(spark, d)
    place = p.select("fov_id", (F.col("x") / 40).cast("long").alias("px"), (F.col("y") / 40).cast("long").alias("py"))
    return X.assemble_mosaic(place, images(spark, d).withColumnRenamed("frame", "fov_id"), "fov_id", 1, 99)


@query("W21_stitch_by_grid", f"""WITH {IMG}, {PS}, g AS (SELECT fov_id, dense_rank() OVER (ORDER BY x) - 1 AS xi, dense_rank() OVER (ORDER BY y) - 1 AS yi FROM ps),
  t AS (SELECT (yi - 1) * 6 + r - 1 AS "row", (xi - 2) * 6 + c - 1 AS col, v FROM img JOIN g ON g.fov_id = img.frame
        WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 AND yi BETWEEN 1 AND 5 AND xi BETWEEN 2 AND 8)
  SELECT k.r AS "row", k.c AS col, t.v FROM (SELECT r, c FROM range(30) a(r), range(42) b(c)) k LEFT JOIN t ON t."row" = k.r AND t.col = k.c""")
def _(spark, d):
    grid = W.rank_grid(positions(spark, d))
    img = images(spark, d).withColumnRenamed("frame", "fov_id")
    return X.stitch_by_grid(img, grid, "fov_id", 8, 8, 1, r0=1, c0=2, n_rows=5, n_cols=7, full=True)


@query("A45_overlap_correlation", f"""WITH {IMG} SELECT a.frame AS a, b.frame AS b, round(CASE WHEN min(a.v) = max(a.v) OR min(b.v) = max(b.v) THEN 0 ELSE corr(a.v, b.v) END, 6) AS r
  FROM img a JOIN img b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c GROUP BY ALL""")
def _(spark, d):
    img = images(spark, d)
    pairs = img.select(F.col("frame").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return X.overlap_correlation(pairs, img, "a", "b").withColumn("r", r6("r"))
