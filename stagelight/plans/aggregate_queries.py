"""Aggregation, progress, storage and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators import aggregate as A
from stagelight.operators import counters as C
from stagelight.operators import schedule as D
from stagelight.operators import windows as W
from stagelight.plans.counter_queries import KEYS, counters
from stagelight.plans.registry import query
from stagelight.plans.select_queries import FTB, fov_frames
from stagelight.plans.tables import (
    CLOUD, CT, FT, INV, LOG, PS, PX, focus_log, frame_table, inventory, pixels, positions, r6, table,
)


def rounded(df, cols):
    q = lambda c: F.col(f"`{c}`")
    return df.select(*[r6(q(c)).alias(c) if c in cols else q(c) for c in df.columns])


@query("A14_flat_field_sampling", f"""WITH {PX}, s AS (SELECT fov_id, avg(value) AS mean, stddev_pop(value) AS std FROM px WHERE frame = 2 AND color = 405 GROUP BY fov_id)
  SELECT fov_id, round(mean, 6) AS mean FROM s ORDER BY mean, std, fov_id LIMIT 12""")
def _(spark, d):
    s = C.frame_stats(counters(spark, d).where("color = 405 and frame = 2"), ["fov_id", "frame"])
    return A.emptiest_fovs(s, 2, 12, min_samples=5).select("fov_id", r6("mean").alias("mean"))


@query("A14_first_round_with_colour", """WITH r AS (SELECT l_orderkey % 5000 AS round_id, l_returnflag AS color, min(l_quantity) >= 2 AS complete FROM lineitem GROUP BY ALL)
  SELECT color, min(round_id) AS round_id FROM r WHERE complete GROUP BY color""")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5000).alias("round_id"), F.col("l_returnflag").alias("color")).agg(
        (F.min("l_quantity") >= 2).alias("complete"))
    return A.first_round_with_color(r)


@query("A22_spots_by_z_summary", """SELECT l_returnflag AS color, l_linenumber AS z, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY ALL""")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("color"), F.col("l_linenumber").alias("z"), "l_extendedprice")
    return rounded(A.quartile_summary(s, ["color", "z"], "l_extendedprice"), {"median", "q25", "q75"})


RS = """rs AS (SELECT l_orderkey % 5 + 1 AS round_id, l_suppkey AS fov_id, l_linenumber AS frame, avg(CAST(l_quantity AS INTEGER)) AS mean FROM lineitem GROUP BY ALL)"""


def round_stats(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5 + 1).alias("round_id"), F.col("l_suppkey").alias("fov_id"),
        F.col("l_linenumber").alias("frame"), F.col("l_quantity").cast("int").alias("value"))
    keys = ["round_id", "fov_id", "frame"]
    return C.frame_stats(C.exact_counter(li, keys), keys)


@query("A23_signal_per_round", f"WITH {RS} SELECT round_id, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std FROM rs WHERE frame = 3 GROUP BY round_id")
def _(spark, d):
    return rounded(A.signal_per_round(round_stats(spark, d), 3), {"mean", "std"})


@query("A24_fov_intensity_grid", f"""WITH {PX}, {PS}, m AS (SELECT fov_id, frame, quantile_cont(value, 0.5) AS med FROM px WHERE color = 560 AND frame <> 1 GROUP BY ALL),
  v AS (SELECT fov_id, quantile_cont(med, 0.5) AS value FROM m GROUP BY fov_id), l AS (SELECT quantile_cont(value, 0.02) AS vmin, quantile_cont(value, 0.98) AS vmax FROM v),
  g AS (SELECT fov_id, dense_rank() OVER (ORDER BY round_even(x, 0)) - 1 AS x_idx, dense_rank() OVER (ORDER BY round_even(y, 0)) - 1 AS y_idx FROM ps)
  SELECT fov_id, round(value, 6) AS value, x_idx, y_idx, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM v JOIN g USING (fov_id), l""")
def _(spark, d):
    s = C.frame_stats(counters(spark, d).where("color = 560 and frame <> 1"), KEYS)
    return rounded(A.fov_intensity_grid(s, W.rank_grid(positions(spark, d))), {"value", "vmin", "vmax"})


@query("A25_stage_z_summary", f"""WITH {LOG} SELECT movie, arg_min(stage_z, frame) AS first_stage_z, min(stage_z) AS min_stage_z, max(stage_z) AS max_stage_z,
  min(stage_z) = max(stage_z) AS all_same FROM log GROUP BY movie""")
def _(spark, d):
    return A.stage_z_summary(focus_log(spark, d), ["movie"])


@query("A26_focus_lock_summary", f"WITH {LOG} SELECT movie, count(*) AS n_frames, count(*) FILTER (WHERE NOT good) AS n_bad_frames, bool_and(good) AS all_good FROM log GROUP BY movie")
def _(spark, d):
    return A.focus_lock_summary(focus_log(spark, d), ["movie"])


@query("A27_channel_shift_summary", """WITH s AS (SELECT l_returnflag AS color, l_discount * 10 AS dx, l_tax * 10 AS dy, l_quantity / 50 AS dz, CAST(l_linenumber AS DOUBLE) AS z FROM lineitem)
  SELECT color, round(avg(dx), 6) AS mean_dx, round(stddev_samp(dx), 6) AS std_dx, round(avg(dy), 6) AS mean_dy, round(stddev_samp(dy), 6) AS std_dy,
  round(avg(dz), 6) AS mean_dz, round(stddev_samp(dz), 6) AS std_dz, round(regr_slope(dz, z), 6) AS slope, round(regr_intercept(dz, z), 6) AS intercept FROM s GROUP BY color""")
def _(spark, d):
    s = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("color"), (F.col("l_discount") * 10).alias("dx"), (F.col("l_tax") * 10).alias("dy"),
        (F.col("l_quantity") / 50).alias("dz"), F.col("l_linenumber").cast("double").alias("z"))
    out = A.channel_shift_summary(s)
    return rounded(out, set(out.columns) - {"color"})


DR = """dr AS (SELECT l_suppkey AS fov, 's' || l_linenumber AS series, l_orderkey AS ord, (l_discount * 100 - 5) * l_quantity AS x_drift, (l_tax * 100 - 4) * l_quantity AS y_drift FROM lineitem),
  dd AS (SELECT *, sqrt(x_drift * x_drift + y_drift * y_drift) AS distance FROM dr)"""


def drifts(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("fov"), F.concat(F.lit("s"), "l_linenumber").alias("series"), F.col("l_orderkey").alias("ord"),
        ((F.col("l_discount") * 100 - 5) * q).alias("x_drift"), ((F.col("l_tax") * 100 - 4) * q).alias("y_drift"))


@query("A28_combine_drift", f"""WITH {DR} SELECT round(quantile_cont(x_drift, 0.5), 6) AS x, round(quantile_cont(y_drift, 0.5), 6) AS y,
  round(greatest(max(x_drift) - min(x_drift), max(y_drift) - min(y_drift)), 6) AS spread, greatest(max(x_drift) - min(x_drift), max(y_drift) - min(y_drift)) > 100 AS warn,
  count(*) FILTER (WHERE x_drift = 0 AND y_drift = 0) AS n_zero FROM dr""")
def _(spark, d):
    t = drifts(spark, d).withColumnsRenamed({"x_drift": "drift_x_um", "y_drift": "drift_y_um"})
    return rounded(A.combine_drift(t, 100), {"x", "y", "spread"})


@query("A29_drift_matrix", f"""WITH {DR}, f AS (SELECT series, min(ord) AS f FROM dd GROUP BY series), k AS (SELECT series, row_number() OVER (ORDER BY f, series) - 1 AS round FROM f)
  SELECT round, fov, round(avg(distance), 6) AS mean_distance, round(avg(distance) - (SELECT quantile_cont(distance, 0.5) FROM dd), 6) AS deviation FROM dd JOIN k USING (series) GROUP BY round, fov""")
def _(spark, d):
    return rounded(A.drift_matrix(drifts(spark, d), "ord"), {"mean_distance", "deviation"})


@query("A29_drift_summary", f"""WITH {DR}, q AS (SELECT quantile_cont(distance, 0.5) AS median, quantile_cont(distance, 0.99) AS hi FROM dd),
  s AS (SELECT quantile_cont(a, 0.99) AS s FROM (SELECT abs(x_drift) AS a FROM dd UNION ALL SELECT abs(y_drift) FROM dd)),
  c AS (SELECT count(*) FILTER (WHERE abs(x_drift) > 100 OR abs(y_drift) > 100) AS n_off, count(*) FILTER (WHERE distance > 100) AS n_over FROM dd),
  n AS (SELECT k, hi, pow(10e0, floor(log10(hi))) AS m FROM (SELECT 's' AS k, s AS hi FROM s UNION ALL SELECT 'd', hi FROM q)),
  li AS (SELECT k, CASE WHEN hi <= m THEN m WHEN hi <= 2 * m THEN 2 * m WHEN hi <= 5 * m THEN 5 * m ELSE 10 * m END AS lim FROM n)
  SELECT round(median, 6) AS median, n_off, n_over, (SELECT lim FROM li WHERE k = 's') AS auto_scatter, (SELECT lim FROM li WHERE k = 'd') AS auto_distance FROM q, c""")
def _(spark, d):
    return rounded(A.drift_summary(drifts(spark, d), 100, 100), {"median"})


@query("A29_drift_histogram", f"WITH {DR} SELECT CAST(least(floor(distance / 5), 19) AS INTEGER) AS bin, count(*) AS n FROM dd WHERE distance <= 100 GROUP BY ALL")
def _(spark, d):
    return A.drift_histogram(drifts(spark, d), 100)


@query("A30_mad_outlier_filter", """WITH s AS (SELECT o_orderkey, o_orderpriority AS g, pow(o_totalprice / 50000, 3) AS v FROM orders), m AS (SELECT g, quantile_cont(v, 0.5) AS med FROM s GROUP BY g),
  a AS (SELECT g, quantile_cont(abs(v - med), 0.5) AS mad FROM s JOIN m USING (g) GROUP BY g)
  SELECT o_orderkey, v <= med + 5 * 1.4826e0 * mad AS kept FROM s JOIN m USING (g) JOIN a USING (g)""")
def _(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.pow(F.col("o_totalprice") / 50000, F.lit(3)).alias("v"))
    return A.mad_outliers(s, "v", keys=["g"]).select("o_orderkey", "kept")


@query("A31_orientation_vote", """WITH s AS (SELECT p_partkey % 2 = 1 AS transpose, p_partkey // 2 % 2 = 1 AS flip_h, p_partkey // 4 % 2 = 1 AS flip_v,
  CASE WHEN p_partkey % 8 <> 5 THEN p_retailprice * (1 + p_partkey % 8) END AS shift FROM part),
  g AS (SELECT transpose, flip_h, flip_v, count(shift) AS n, coalesce(quantile_cont(shift, 0.5), 1e300) AS m FROM s GROUP BY ALL)
  SELECT transpose, flip_h, flip_v, n, CAST(CASE WHEN m = 1e300 THEN 'infinity' ELSE CAST(round(m, 6) AS VARCHAR) END AS DOUBLE) AS median_shift, CAST(row_number() OVER (ORDER BY m, transpose, flip_h, flip_v) AS INTEGER) AS rank FROM g""")
def _(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(
        (k % 2 == 1).alias("transpose"), (F.floor(k / 2) % 2 == 1).alias("flip_h"), (F.floor(k / 4) % 2 == 1).alias("flip_v"),
        F.when(k % 8 != 5, F.col("p_retailprice") * (1 + k % 8)).alias("shift"))
    return rounded(A.orientation_vote(s), {"median_shift"})


PR = """pr AS (SELECT id, x, y, 0.99e0 * x + 0.03e0 * y + volume / 1000 AS u, -0.02e0 * x + 1.01e0 * y - volume / 2000 AS v FROM cloud)"""
NE = """ft AS (SELECT count(*) AS n, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv, var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy, covar_pop(x, u) xu, covar_pop(y, u) yu, covar_pop(x, v) xv, covar_pop(y, v) yv FROM pr WHERE id % 5 <> 0),
  af AS (SELECT n, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d, mx, my, mu, mv FROM ft)"""


def affine_pairs(spark, d):
    from stagelight.plans.tables import cloud

    x, y, w = F.col("x"), F.col("y"), F.col("volume")
    return cloud(spark, d).select("id", "x", "y", (0.99 * x + 0.03 * y + w / 1000).alias("u"), (-0.02 * x + 1.01 * y - w / 2000).alias("v"))


@query("A32_fit_affine", f"""WITH {CLOUD}, {PR}, {NE} SELECT n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx - b * my, 6) AS tx, round(c, 6) AS c, round(d, 6) AS d, round(mv - c * mx - d * my, 6) AS ty,
  round(degrees(atan2(c, a)), 6) AS rotation_deg, round(sqrt(a * a + c * c), 6) AS scale FROM af""")
def _(spark, d):
    f = A.fit_affine(affine_pairs(spark, d).where("id % 5 <> 0"), zero_translation=False)
    return rounded(f, set(f.columns) - {"n"})


@query("A33_holdout_error", f"""WITH {CLOUD}, {PR}, {NE}, e AS (SELECT sqrt(pow(u - x, 2) + pow(v - y, 2)) AS eb, sqrt(pow(u - (a * x + b * y), 2) + pow(v - (c * x + d * y), 2)) AS ea FROM pr, af WHERE id % 5 = 0)
  SELECT count(*) AS n, round(avg(eb), 6) AS mean_before, round(avg(ea), 6) AS mean_after, round(max(eb), 6) AS max_before, round(max(ea), 6) AS max_after,
  round(quantile_cont(eb, 0.5), 6) AS median_before, round(quantile_cont(ea, 0.5), 6) AS median_after, round(100 * (1 - avg(ea) / avg(eb)), 6) AS reduction_pct FROM e""")
def _(spark, d):
    p = affine_pairs(spark, d)
    used = p.where("id % 5 <> 0")
    h = A.holdout_error(p, A.fit_affine(used).drop("n"), used, "id")
    return rounded(h, set(h.columns) - {"n"})


EXP = """ex AS (SELECT l_orderkey % 300 AS round_id, l_suppkey AS fov_id, l_returnflag AS color, l_quantity >= 2 AS imaged, l_discount <= 0.09e0 AS processed FROM lineitem)"""


def expected(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 300).alias("round_id"), F.col("l_suppkey").alias("fov_id"), F.col("l_returnflag").alias("color"),
        (F.col("l_quantity") >= 2).alias("imaged"), (F.col("l_discount") <= 0.09).alias("processed"))


@query("A34_progress_summary", f"""WITH {EXP}, f AS (SELECT round_id, fov_id, bool_and(imaged) AS imaged, bool_and(processed) AS processed FROM ex GROUP BY ALL)
  SELECT round_id, count(*) FILTER (WHERE imaged) AS imaged, count(*) FILTER (WHERE processed) AS processed, count(*) AS total, count(*) FILTER (WHERE NOT processed) AS pending FROM f GROUP BY ROLLUP (round_id)""")
def _(spark, d):
    return A.progress_summary(expected(spark, d))


EX2 = """ex AS (SELECT o_custkey AS round_id, o_orderkey AS fov_id, o_orderstatus <> 'P' AS imaged, o_orderstatus <> 'P' AND o_totalprice > 2000 AS processed FROM orders)"""


def expected_orders(spark, d):
    s = F.col("o_orderstatus") != "P"
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("round_id"), F.col("o_orderkey").alias("fov_id"), s.alias("imaged"), (s & (F.col("o_totalprice") > 2000)).alias("processed"))


@query("A35_round_complete", f"WITH {EX2} SELECT round_id, bool_and(imaged AND processed) AS complete FROM ex GROUP BY round_id")
def _(spark, d):
    return A.complete_rounds(expected_orders(spark, d))


@query("A35_pending_rounds", f"WITH {EX2} SELECT round_id FROM ex WHERE round_id % 3 <> 0 GROUP BY round_id HAVING bool_and(imaged AND processed)")
def _(spark, d):
    done = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("round_id"))
    return A.pending_rounds(expected_orders(spark, d), done)


@query("A36_storage_audit", f"""WITH {INV} SELECT owner, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS n_files, round(sum(length) / 1e9, 6) AS gb, epoch(min(modificationTime)) AS earliest, epoch(max(modificationTime)) AS latest,
  CAST(date_diff('day', CAST(max(modificationTime) AS DATE), DATE '2024-06-01') AS INTEGER) AS age_days FROM inv GROUP BY owner HAVING sum(length) / 1e9 >= 1""")
def _(spark, d):
    a = A.storage_audit(inventory(spark, d), ["owner"], F.lit("2024-06-01").cast("date"), min_gb=1)
    sec = lambda c: F.col(c).cast("double").alias(c)
    return a.select("owner", "bytes", "n_files", r6("gb").alias("gb"), sec("earliest"), sec("latest"), "age_days")


@query("A37_case_insensitive_group", """WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name, c_acctbal FROM customer)
  SELECT lower(name) AS key, array_to_string(list_sort(list_distinct(list(name))), ' / ') AS display, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM n GROUP BY lower(name)""")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"), "c_acctbal")
    return A.case_insensitive_group(c, "name", [F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")])


@query("A38_job_resource_stats", """WITH j AS (SELECT o_orderpriority AS task, o_orderkey % 86400 AS s, o_orderkey % 4 AS u, o_orderkey % 1000 + 1 AS m FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0)
  SELECT task, count(*) AS n, CAST(min(s) AS DOUBLE) AS min_s, round(avg(s), 6) AS mean_s, CAST(max(s) AS DOUBLE) AS max_s,
  round(min(CASE u WHEN 0 THEN m / 1024e0 WHEN 1 THEN m WHEN 2 THEN m * 1024 ELSE m / 1048576e0 END), 6) AS min_mib, round(avg(CASE u WHEN 0 THEN m / 1024e0 WHEN 1 THEN m WHEN 2 THEN m * 1024 ELSE m / 1048576e0 END), 6) AS mean_mib,
  round(max(CASE u WHEN 0 THEN m / 1024e0 WHEN 1 THEN m WHEN 2 THEN m * 1024 ELSE m / 1048576e0 END), 6) AS max_mib FROM j GROUP BY task""")
def _(spark, d):
    k = F.col("o_orderkey")
    s = k % 86400
    jobs = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("task"),
        F.concat(F.lit("77_"), k, F.when(k % 5 == 0, "").otherwise(".batch")).alias("JobID"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("State"),
        F.when(k % 2 == 0, s.cast("string")).otherwise("").alias("ElapsedRaw"),
        F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("Elapsed"),
        F.concat(k % 1000 + 1, F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G"), F.lit("")), (k % 4 + 1).cast("int"))).alias("MaxRSS"))
    out = A.job_resources(jobs)
    return rounded(out, {"mean_s", "min_mib", "mean_mib", "max_mib"})


MK = """mk AS (SELECT 'run' || (user_id % 3) AS run, 'task' || (event_id % 7) AS task, event_id % 500 AS fragment,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'done' ELSE 'start' END AS marker FROM events),
  fr AS (SELECT run, task, fragment, bool_or(marker = 'done') AS d, bool_or(marker = 'error') AS e FROM mk GROUP BY ALL),
  sm AS (SELECT run, task, count(*) FILTER (WHERE d) AS done, count(*) FILTER (WHERE e AND NOT d) AS error, count(*) FILTER (WHERE NOT e AND NOT d) AS running, count(*) AS total FROM fr GROUP BY ALL)"""


def markers(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat(F.lit("run"), F.col("user_id") % 3).alias("run"), F.concat(F.lit("task"), F.col("event_id") % 7).alias("task"),
        (F.col("event_id") % 500).alias("fragment"), F.when(t == "error", "error").when(t == "click", "done").otherwise("start").alias("marker"))


@query("A39_task_marker_status", f"WITH {MK} SELECT * FROM sm")
def _(spark, d):
    return A.task_marker_status(markers(spark, d))


@query("A39_status_table", f"""WITH {MK} SELECT task, max(CASE WHEN run = 'run0' THEN done || '/' || total END) AS run0, max(CASE WHEN run = 'run1' THEN done || '/' || total END) AS run1,
  max(CASE WHEN run = 'run2' THEN done || '/' || total END) AS run2 FROM sm GROUP BY task""")
def _(spark, d):
    return A.status_table(A.task_marker_status(markers(spark, d)), ["run0", "run1", "run2"])


SCH = """mv AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Cells Imaging' ELSE 'Hyb 0' || (o_orderkey % 5 + 1) END AS label, o_orderkey % 30 AS positions_id, 's' || (o_orderkey % 13) AS series,
  o_orderkey % 215 + 1 AS frames, CASE WHEN o_orderkey % 3 <> 0 THEN 0.5e0 END AS frame_s FROM orders),
  fc AS (SELECT c_nationkey AS positions_id, count(*) AS n_fov FROM customer GROUP BY ALL),
  st AS (SELECT 'Hyb 0' || (p_partkey % 5 + 1) AS label, p_brand AS protocol FROM part),
  du AS (SELECT 'Brand#' || (s_suppkey + 1) AS protocol, abs(s_acctbal) AS duration_s FROM supplier WHERE s_suppkey % 6 <> 0),
  al AS (SELECT label, series, frames * coalesce(frame_s, 0.25e0) + 5 AS fov_s, coalesce(n_fov, 0) * (frames * coalesce(frame_s, 0.25e0) + 5) AS imaging_s, coalesce(n_fov, 0) * frames * 2048 AS bytes, coalesce(n_fov, 0) AS movies, 0e0 AS fluidics_s
         FROM mv LEFT JOIN fc USING (positions_id) UNION ALL SELECT label, NULL, 0, 0, 0, 0, coalesce(duration_s, 0) FROM st LEFT JOIN du USING (protocol))"""


def schedule_inputs(spark, d):
    k = F.col("o_orderkey")
    mv = table(spark, d, "orders").select(
        F.when(k % 7 == 0, "Cells Imaging").otherwise(F.concat(F.lit("Hyb 0"), k % 5 + 1)).alias("label"), (k % 30).alias("positions_id"),
        F.concat(F.lit("s"), k % 13).alias("series"), (k % 215 + 1).alias("frames"), F.when(k % 3 != 0, 0.5).alias("frame_s"))
    fc = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("positions_id")).agg(F.count(F.lit(1)).alias("n_fov"))
    st = table(spark, d, "part").select(F.concat(F.lit("Hyb 0"), F.col("p_partkey") % 5 + 1).alias("label"), F.col("p_brand").alias("protocol"))
    du = table(spark, d, "supplier").where("s_suppkey % 6 <> 0").select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey") + 1).alias("protocol"), F.abs("s_acctbal").alias("duration_s"))
    return mv, fc, st, du


@query("A40_schedule_estimate", f"""WITH {SCH} SELECT label, round(sum(imaging_s), 3) AS imaging_s, round(sum(fluidics_s), 3) AS fluidics_s, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(movies) AS BIGINT) AS movies,
  round(sum(fov_s), 3) AS per_fov_s, count(DISTINCT series) AS n_series, CAST(grouping(label) AS INTEGER) AS is_total FROM al GROUP BY ROLLUP (label)""")
def _(spark, d):
    mv, fc, st, du = schedule_inputs(spark, d)
    e = D.estimate_schedule(mv, fc, st, du, frame_bytes=2048).orderBy("is_total", *D.report_order())
    return e.select(*[F.round(c, 3).alias(c) if c.endswith("_s") else F.col(c) for c in e.columns])


@query("A40_unknown_protocols", f"WITH {SCH} SELECT protocol, count(*) AS n FROM st WHERE protocol NOT IN (SELECT protocol FROM du) GROUP BY protocol")
def _(spark, d):
    _, _, st, du = schedule_inputs(spark, d)
    return D.unknown_protocols(st, du)


@query("A41_actual_vs_plan_ratio", """SELECT o_orderpriority AS kind, coalesce(round(avg(o_totalprice / (o_orderkey % 100 * 1000)) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 100 > 0), 6), 1) AS ratio FROM orders GROUP BY ALL""")
def _(spark, d):
    b = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("actual_s"), (F.col("o_orderkey") % 100 * 1000).alias("plan_s"),
        (F.col("o_orderstatus") == "F").alias("measured"))
    return rounded(D.actual_vs_plan(b), {"ratio"})


@query("A42_trim_savings", f"""WITH {FT}, sw AS (SELECT color, min(z) < max(z) AS swept, count(*) AS n FROM ft GROUP BY color),
  nd AS (SELECT c_custkey AS fov_id, CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal / 100) / 20 END AS z_last FROM customer),
  zn AS (SELECT *, CASE WHEN z_last IS NOT NULL THEN least(z_last + 0.5e0, 3) END AS z_needed FROM nd),
  k AS (SELECT fov_id, z_last, z_needed, (SELECT count(*) FROM ft) AS n_frames, (SELECT coalesce(sum(n), 0) FROM sw WHERE NOT swept) + (SELECT count(*) FROM ft JOIN sw USING (color) WHERE swept AND ft.z <= z_needed) AS n_kept FROM zn)
  SELECT fov_id, z_last, z_needed, n_frames, CAST(n_kept AS BIGINT) AS n_kept, CAST(n_frames - n_kept AS BIGINT) AS n_removed, CAST((n_frames - n_kept) * 1000 AS BIGINT) AS bytes_saved, CAST((n_frames - n_kept) * 0.25e0 AS DOUBLE) AS seconds_saved, coalesce(z_last + 0.5e0 > 3, false) AS capped FROM k""")
def _(spark, d):
    needs = table(spark, d, "customer").select(
        F.col("c_custkey").alias("fov_id"), F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 100) / 20).alias("z_last"))
    return D.trim_savings(needs, frame_table(spark, d), margin_um=0.5, z_cap=3, frame_bytes=1000, frame_s=0.25)


WIN = """wn AS (SELECT p_partkey // 200 AS fov, p_partkey % 3 AS plane, 144 * (p_partkey // 3 % 8) AS wy, 144 * (p_partkey // 24 % 8) AS wx, p_size / 50e0 AS fg_frac, p_retailprice % 100 / 100 AS p_damaged FROM part)"""


def scored_windows(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 200).alias("fov"), (k % 3).alias("plane"), (144 * (F.floor(k / 3) % 8)).alias("wy"), (144 * (F.floor(k / 24) % 8)).alias("wx"),
        (F.col("p_size") / 50.0).alias("fg_frac"), (F.col("p_retailprice") % 100 / 100).alias("p_damaged"))


@query("A43_square_scores", f"""WITH {WIN} SELECT fov, CAST(wy // 144 + di AS INTEGER) AS i, CAST(wx // 144 + dj AS INTEGER) AS j, round(avg(p_damaged), 6) AS score, count(*) AS n_windows, avg(p_damaged) > 0.5 AS removed
  FROM wn, range(2) a(di), range(2) b(dj) GROUP BY ALL""")
def _(spark, d):
    return rounded(A.square_scores(scored_windows(spark, d), ["fov"], 0.5), {"score"})


@query("A43_damage_scores", f"""WITH {WIN}, p AS (SELECT fov, wy, wx, avg(fg_frac) AS fg, avg(p_damaged) AS p FROM wn GROUP BY ALL)
  SELECT fov, round(100 * sum(CASE WHEN p > 0.5 THEN fg ELSE 0 END) / sum(fg), 6) AS damaged_pct, count(*) AS n_windows FROM p GROUP BY fov""")
def _(spark, d):
    return rounded(A.damaged_share(scored_windows(spark, d), ["fov"]), {"damaged_pct"})


@query("A44_haze_level", """SELECT round(coalesce(quantile_cont(p_retailprice, 0.5), 0), 6) AS haze FROM part WHERE p_size / 1000e0 < 0.01""")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("level"), (F.col("p_size") / 1000.0).alias("fg"))
    return rounded(A.haze_level(p, "level", "fg"), {"haze"})


@query("A46_sequence_name", f"""WITH {FTB}, n AS (SELECT fov_id, color, count(*) AS n FROM fb GROUP BY ALL)
  SELECT fov_id, string_agg(CASE WHEN color IS NULL THEN 'blkf' || n ELSE CAST(color AS INTEGER) || 'f' || n END, '_' ORDER BY coalesce(color, -1)) || '_seq' AS name FROM n GROUP BY fov_id""")
def _(spark, d):
    return A.sequence_name(fov_frames(spark, d), ["fov_id"], sequential=True)
