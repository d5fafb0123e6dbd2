"""Ordered, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators import ranking as T
from stagelight.operators import windows as W
from stagelight.plans.registry import query
from stagelight.plans.select_queries import FTB, fov_frames
from stagelight.plans.tables import (
    CLOUD, FT, INV, LOG, PS, PX, cloud, focus_log, frame_table, inventory, pixels, positions, r6, table,
)


@query("W1_round_labels", """WITH k AS (SELECT c_custkey AS round_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'cells' WHEN 'HOUSEHOLD' THEN 'focustest' ELSE 'bits' END AS kind FROM customer),
  o AS (SELECT round_id, row_number() OVER (ORDER BY round_id) AS i FROM k WHERE kind = 'bits')
  SELECT k.round_id, k.kind, coalesce('hyb' || repeat('0', CAST(greatest(2 - length(CAST(i AS VARCHAR)), 0) AS INTEGER)) || i, kind) AS label FROM k LEFT JOIN o USING (round_id)""")
def _(spark, d):
    s = F.col("c_mktsegment")
    r = table(spark, d, "customer").select(
        F.col("c_custkey").alias("round_id"),
        F.when(s == "MACHINERY", "cells").when(s == "HOUSEHOLD", "focustest").otherwise("bits").alias("kind"),
    )
    return W.round_labels(r)


@query("W2_rank_grid", f"""WITH {PS} SELECT fov_id, x, y, dense_rank() OVER (ORDER BY round_even(x, 0)) - 1 AS x_idx,
  dense_rank() OVER (ORDER BY round_even(y, 0)) - 1 AS y_idx FROM ps""")
def _(spark, d):
    return W.rank_grid(positions(spark, d))


@query("W3_inter_file_time", f"""WITH {INV}, g AS (SELECT owner, epoch(modificationTime) - epoch(lag(modificationTime)
  OVER (PARTITION BY owner ORDER BY modificationTime, file_id)) AS gap FROM inv),
  s AS (SELECT owner, min(gap) AS min_s, max(gap) AS max_s, stddev_pop(gap) AS std_s, quantile_cont(gap, 0.5) AS median_s FROM g WHERE gap IS NOT NULL GROUP BY owner)
  SELECT owner, min_s, max_s, round(std_s, 6) AS std_s, round(median_s, 6) AS median_s, round(median_s / 215, 6) AS per_frame_s, round(median_s / 215 / 0.25e0, 6) AS ratio FROM s""")
def _(spark, d):
    s = W.inter_file_time(inventory(spark, d), ["owner"], ["modificationTime", "file_id"], 0.25, 215)
    return s.select("owner", "min_s", "max_s", *[r6(c).alias(c) for c in ("std_s", "median_s", "per_frame_s", "ratio")])


@query("W4_path_stats", f"""WITH {CLOUD}, s AS (SELECT id % 10 AS path_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step
  FROM cloud WINDOW w AS (PARTITION BY id % 10 ORDER BY id))
  SELECT path_id, round(coalesce(sum(step), 0), 6) AS total, round(coalesce(max(step), 0), 6) AS longest FROM s GROUP BY path_id""")
def _(spark, d):
    s = W.path_stats(cloud(spark, d).withColumn("path_id", F.col("id") % 10), ["path_id"], "id")
    return s.select("path_id", r6("total").alias("total"), r6("longest").alias("longest"))


# click-ordered vertices: short steps along a line, long jumps now and then
CLICKS = """cl AS (SELECT c_custkey % 4 AS path_id, c_custkey AS id, CAST(c_custkey * 3 + (c_custkey // 97) * 5000 + c_custkey % 11 AS DOUBLE) AS x,
  CAST(c_custkey % 13 AS DOUBLE) AS y FROM customer)"""


def clicks(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        (k % 4).alias("path_id"), k.alias("id"),
        (k * 3 + F.floor(k / 97) * 5000 + k % 11).cast("double").alias("x"), (k % 13).cast("double").alias("y"),
    )


@query("W5_split_on_gap", f"""WITH {CLICKS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM cl WINDOW w AS (PARTITION BY path_id ORDER BY id)),
  m AS (SELECT path_id, median(d) AS med, stddev_pop(d) AS sd FROM s GROUP BY path_id),
  a AS (SELECT path_id, median(abs(d - med)) AS mad FROM s JOIN m USING (path_id) GROUP BY path_id),
  f AS (SELECT s.*, coalesce(CAST(0.6745e0 * (d - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd WHEN med > 0 THEN med ELSE 1 END > 3.5e0 AS INTEGER), 0) AS cut
        FROM s JOIN m USING (path_id) JOIN a USING (path_id)),
  p AS (SELECT path_id, id, x, y, CAST(sum(cut) OVER (PARTITION BY path_id ORDER BY id) AS INTEGER) AS part FROM f)
  SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY path_id, part) >= 3""")
def _(spark, d):
    return W.split_on_gap(clicks(spark, d), ["path_id"], "id")


@query("W6_scan_mode", f"""WITH {FTB}, s AS (SELECT fov_id, z, lag(z) OVER (PARTITION BY fov_id ORDER BY frame) AS p FROM fb)
  SELECT fov_id, CASE WHEN coalesce(avg(CAST(z = p AS INTEGER)), 1) >= 0.25 THEN 'interleaved' ELSE 'sequential' END AS mode FROM s GROUP BY fov_id""")
def _(spark, d):
    return W.scan_mode(fov_frames(spark, d), ["fov_id"], ["frame"])


@query("W6_runs_of_equal", f"""WITH {FTB}, s AS (SELECT *, lag(color) OVER w AS p, row_number() OVER w AS rn FROM fb WINDOW w AS (PARTITION BY fov_id ORDER BY frame))
  SELECT fov_id, frame, color, CAST(sum(CASE WHEN rn = 1 OR color IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY fov_id ORDER BY frame) AS INTEGER) AS run FROM s""")
def _(spark, d):
    return W.runs_of_equal(fov_frames(spark, d), ["fov_id"], ["frame"], "color").select("fov_id", "frame", "color", "run")


PROF = """pr AS (SELECT user_id AS fov_id, CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) AS z, round(avg(value), 6) AS v FROM events GROUP BY ALL)"""


def profiles(spark, d):
    """Mean value per (user, day): a profile of at most one value per day."""
    return table(spark, d, "events").groupBy(
        F.col("user_id").alias("fov_id"), F.floor((F.col("ts").cast("double") - 1704067200) / 86400).alias("z")
    ).agg(r6(F.avg("value")).alias("v"))


@query("W7_median_filter_1d", f"""WITH {PROF} SELECT fov_id, z, v, list_sort([coalesce(lag(v) OVER w, v), v, coalesce(lead(v) OVER w, v)])[2] AS clean
  FROM pr WINDOW w AS (PARTITION BY fov_id ORDER BY z)""")
def _(spark, d):
    return W.median_filter_3(profiles(spark, d), ["fov_id"], "z", "v", "clean")


@query("W8_peak_normalise", f"""WITH {PROF}, p AS (SELECT fov_id, max(v) AS peak FROM pr GROUP BY fov_id),
  n AS (SELECT max(v) AS nf FROM (SELECT v FROM pr WHERE fov_id % 10 = 0))
  SELECT fov_id, z, round(CASE WHEN peak > (SELECT nf FROM n) THEN v / peak END, 6) AS rel FROM pr JOIN p USING (fov_id)""")
def _(spark, d):
    p = profiles(spark, d)
    floor = p.where("fov_id % 10 = 0").agg(F.max("v")).scalar()
    return W.peak_normalise(p, ["fov_id"], "v", floor, "rel").select("fov_id", "z", r6("rel").alias("rel"))


@query("W9_detect_plateau", f"""WITH {PROF}, p AS (SELECT *, row_number() OVER w - 1 AS i, lag(v) OVER w AS a, lead(v) OVER w AS b FROM pr WINDOW w AS (PARTITION BY fov_id ORDER BY z)),
  s AS (SELECT fov_id, min(v) AS lo, max(v) AS hi FROM pr GROUP BY fov_id),
  k AS (SELECT fov_id, min(i) AS peak FROM p JOIN s USING (fov_id) WHERE v = hi GROUP BY fov_id),
  o AS (SELECT p.*, lo, hi, peak, hi > lo AND abs(CASE WHEN a IS NULL OR b IS NULL THEN coalesce(b - v, v - a) ELSE (b - a) / 2 END) / nullif(hi - lo, 0) < 0.3e0
        AND (v - lo) / nullif(hi - lo, 0) < 0.6e0 AS ok FROM p JOIN s USING (fov_id) JOIN k USING (fov_id)),
  t AS (SELECT *, min(CAST(ok AS INTEGER)) OVER r AS m, count(ok) OVER r AS n FROM o WINDOW r AS (PARTITION BY fov_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
  SELECT fov_id, CASE WHEN any_value(hi) <= any_value(lo) THEN any_value(peak) ELSE min(i) FILTER (WHERE m = 1 AND n = 3 AND i >= peak) END AS plateau_idx FROM t GROUP BY fov_id""")
def _(spark, d):
    p = W.detect_plateau(profiles(spark, d), ["fov_id"], "z", "v", slope_tol=0.3, value_tol=0.6, run=3)
    return p.withColumn("plateau_idx", F.col("plateau_idx").cast("long"))


@query("W10_chained_schedule", """WITH s AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 10, 3) AS dur, o_orderdate FROM orders),
  e AS (SELECT *, sum(dur) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum FROM s)
  SELECT o_custkey, o_orderkey, round(epoch(TIMESTAMP '2024-01-01 08:00:00') + cum - dur, 3) AS start_s, round(epoch(TIMESTAMP '2024-01-01 08:00:00') + cum, 3) AS end_s,
  CAST(floor((8 * 3600 + round(cum - dur, 6)) / 86400) AS INTEGER) + 1 AS day FROM e""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 10, 3).alias("dur"), "o_orderdate")
    start = F.lit("2024-01-01 08:00:00").cast("timestamp")
    s = W.chained_schedule(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "dur", start)
    sec = lambda c: F.round(F.col(c).cast("double"), 3)
    return s.select("o_custkey", "o_orderkey", sec("start_ts").alias("start_s"), sec("end_ts").alias("end_s"), "day")


BLK = f"""{INV}, rd AS (SELECT owner, CAST(floor(epoch(modificationTime) / 2592000) AS BIGINT) AS round_id, epoch(min(modificationTime)) AS lo,
  epoch(max(modificationTime)) AS hi, count(*) AS n FROM inv GROUP BY ALL),
  rs AS (SELECT *, n >= 30 AS done, lag(hi) OVER w AS pend, lag(n >= 30) OVER w AS pdone, lag(round_id) OVER w AS pr FROM rd WINDOW w AS (PARTITION BY owner ORDER BY round_id)),
  bl AS (SELECT owner, round_id, 'imaging' AS kind, lo AS obs_start, CASE WHEN done THEN hi END AS obs_end, done AS measured FROM rs
  UNION ALL SELECT owner, round_id, 'fluidics', CASE WHEN pdone THEN pend END, CASE WHEN pdone THEN lo END, coalesce(pdone, false) FROM rs WHERE pr IS NOT NULL)"""


def blocks(spark, d):
    f = inventory(spark, d).withColumn("t", F.col("modificationTime").cast("double"))
    f = f.withColumn("round_id", F.floor(F.col("t") / 2592000))
    return W.block_times(f, ["owner"], "round_id", "t", F.lit(30))


@query("W11_measured_block_times", f"WITH {BLK} SELECT * FROM bl")
def _(spark, d):
    return blocks(spark, d)


@query("W12_reforecast_schedule", f"""WITH RECURSIVE {BLK}, pl AS (SELECT *, CAST(1000 + round_id % 7 * 100 AS DOUBLE) AS plan_s,
  row_number() OVER (PARTITION BY owner ORDER BY round_id, kind) AS k FROM bl),
  ra AS (SELECT kind, avg((obs_end - obs_start) / plan_s) FILTER (WHERE measured) AS ratio FROM pl GROUP BY kind),
  pe AS (SELECT pl.*, plan_s * coalesce(ratio, 1) AS est FROM pl JOIN ra USING (kind)),
  ch AS (SELECT owner, round_id, kind, k, measured, obs_start, CASE WHEN measured OR obs_start IS NOT NULL THEN obs_start ELSE 0e0 END AS s,
           CASE WHEN measured THEN obs_end WHEN obs_start IS NOT NULL THEN obs_start + est ELSE est END AS e FROM pe WHERE k = 1
         UNION ALL SELECT p.owner, p.round_id, p.kind, p.k, p.measured, p.obs_start, CASE WHEN p.measured OR p.obs_start IS NOT NULL THEN p.obs_start ELSE ch.e END,
           CASE WHEN p.measured THEN p.obs_end WHEN p.obs_start IS NOT NULL THEN p.obs_start + p.est ELSE ch.e + p.est END
         FROM ch JOIN pe p ON p.owner = ch.owner AND p.k = ch.k + 1)
  SELECT owner, round_id, kind, round(s, 2) AS start_s, round(e, 2) AS end_s, CASE WHEN measured THEN 'measured' ELSE 'estimated' END AS status FROM ch""")
def _(spark, d):
    from stagelight.operators.schedule import actual_vs_plan

    b = blocks(spark, d).withColumn("plan_s", (1000 + F.col("round_id") % 7 * 100).cast("double"))
    ratio = actual_vs_plan(b.withColumn("actual_s", F.col("obs_end") - F.col("obs_start")))
    f = W.reforecast(b, ["owner"], ["round_id", "kind"], ratio, F.lit(0.0))
    return f.select("owner", "round_id", "kind", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"), "status")


@query("W13_active_round", """WITH r AS (SELECT o_custkey AS sample, CAST(floor(epoch(o_orderdate) / 31536000) AS BIGINT) AS round_id,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) AS n_total, max(epoch(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS last_mtime FROM orders GROUP BY ALL),
  s AS (SELECT *, lead(round_id) OVER (PARTITION BY sample ORDER BY round_id) AS nxt FROM r),
  b AS (SELECT sample, CASE WHEN n_done >= n_total THEN coalesce(nxt, round_id) ELSE round_id END AS pick FROM s WHERE n_done > 0
        QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n_done < n_total DESC, last_mtime DESC, round_id DESC) = 1)
  SELECT sample, coalesce(pick, first_round) AS active_round FROM (SELECT sample, min(round_id) AS first_round FROM r GROUP BY sample) LEFT JOIN b USING (sample)""")
def _(spark, d):
    t = F.col("o_orderdate").cast("double")
    done = F.col("o_orderstatus") == "F"
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample"), F.floor(t / 31536000).alias("round_id")).agg(
        F.count_if(done).alias("n_done"), F.count(F.lit(1)).alias("n_total"), F.max(F.when(done, t)).alias("last_mtime")
    )
    return W.active_round(r, ["sample"])


@query("W15_evenly_spaced_pick", f"""WITH {LOG}, s AS (SELECT movie, frame, row_number() OVER (PARTITION BY movie ORDER BY ts, frame) - 1 AS i, count(*) OVER (PARTITION BY movie) AS m FROM log)
  SELECT movie, frame FROM s WHERE m <= 9 OR i IN (SELECT CAST(round_even(k * (m - 1) / 8e0, 0) AS BIGINT) FROM range(9) t(k))""")
def _(spark, d):
    return W.evenly_spaced(focus_log(spark, d), ["movie"], ["ts", "frame"], 9).select("movie", "frame")


NEED = """nd AS (SELECT c_custkey AS fov_id, CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(c_acctbal / 50) AS DOUBLE) END AS z_needed FROM customer)"""


def needs(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("fov_id"), F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 50).cast("double")).alias("z_needed")
    )


@query("W16_quantile_tiers", f"""WITH {NEED}, q AS (SELECT list_sort(list_distinct(quantile_cont(z_needed, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM nd),
  t AS (SELECT fov_id, z_needed, CAST(CASE WHEN z_needed IS NULL THEN 0 ELSE greatest(len(list_filter((SELECT e FROM q), lambda x: x < z_needed)) - 1, 0) END AS INTEGER) AS tier FROM nd)
  SELECT fov_id, z_needed, tier, max(z_needed) OVER (PARTITION BY tier) AS tier_depth FROM t""")
def _(spark, d):
    return W.quantile_tiers(needs(spark, d), "z_needed", 4)


@query("W16_rank_tiers", f"""WITH {NEED}, r AS (SELECT fov_id, z_needed, CAST((row_number() OVER (ORDER BY z_needed, fov_id) - 1) * 5 // count(*) OVER () AS INTEGER) AS tier FROM nd WHERE z_needed IS NOT NULL)
  SELECT fov_id, z_needed, tier, max(z_needed) OVER (PARTITION BY tier) AS tier_depth FROM r""")
def _(spark, d):
    return W.rank_tiers(needs(spark, d).where("z_needed is not null"), "z_needed", "fov_id", 5)


@query("W17_uniform_step_check", f"""WITH {PX}, z AS (SELECT DISTINCT fov_id, frame * 0.5e0 AS z FROM px WHERE fov_id % 3 <> 0 OR frame <> fov_id % 7),
  s AS (SELECT fov_id, z - lag(z) OVER (PARTITION BY fov_id ORDER BY z) AS d FROM z),
  g AS (SELECT fov_id, coalesce(count(d) >= 1 AND max(d) - min(d) <= 1e-3, false) AS ok, min(d) AS m FROM s GROUP BY fov_id)
  SELECT fov_id, ok, round(CASE WHEN ok THEN m / 0.108e0 END, 6) AS anisotropy FROM g""")
def _(spark, d):
    p = pixels(spark, d).where("fov_id % 3 <> 0 or frame <> fov_id % 7").select("fov_id", (F.col("frame") * 0.5).alias("z"))
    return W.uniform_step(p, ["fov_id"], "z", 0.108).withColumn("anisotropy", r6("anisotropy"))


@query("W22_first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return W.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("T1_lowest_n", f"""WITH {PX} SELECT fov_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM px GROUP BY fov_id ORDER BY avg(value), stddev_pop(value), fov_id LIMIT 10""")
def _(spark, d):
    s = pixels(spark, d).groupBy("fov_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return T.lowest_n(s, ["mean", "std", "fov_id"], 10).select("fov_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query("T2_brightest_per_group", """SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5""")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return T.brightest_per_group(p, ["p_brand"], "p_retailprice", ["p_partkey"], 5)


@query("T3_lexicographic_ranking", f"""WITH {PX}, m AS (SELECT fov_id, count(*) AS n_fovs, max(value) AS waste, avg(value) AS longest FROM px GROUP BY fov_id)
  SELECT fov_id, row_number() OVER (ORDER BY n_fovs, waste, longest, fov_id) AS rank FROM m""")
def _(spark, d):
    m = pixels(spark, d).groupBy("fov_id").agg(
        F.count(F.lit(1)).alias("n_fovs"), F.max("value").alias("waste"), F.avg("value").alias("longest")
    )
    return T.lexicographic_rank(m, ["n_fovs", "waste", "longest"], "fov_id").select("fov_id", "rank")


@query("T4_near_percentile_sample", """WITH q2 AS (SELECT 0.1e0 AS prob, quantile_cont(o_totalprice, 0.1) AS t FROM orders UNION ALL SELECT 0.5e0, quantile_cont(o_totalprice, 0.5) FROM orders UNION ALL SELECT 0.9e0, quantile_cont(o_totalprice, 0.9) FROM orders),
  n AS (SELECT prob, o_orderkey, o_totalprice FROM orders, q2 QUALIFY row_number() OVER (PARTITION BY prob ORDER BY abs(o_totalprice - t), o_orderkey) <= 3)
  SELECT prob, o_orderkey, o_totalprice FROM n QUALIFY row_number() OVER (PARTITION BY prob ORDER BY md5(o_orderkey || '|7'), o_orderkey) = 1""")
def _(spark, d):
    return T.near_percentile_sample(
        table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", [0.1, 0.5, 0.9], seed=7
    )


@query("T5_seeded_anchor_sample", f"""WITH {PS} SELECT * FROM ps ORDER BY md5(fov_id || '|3'), fov_id LIMIT 10""")
def _(spark, d):
    return T.seeded_sample(positions(spark, d), "fov_id", 10, seed=3)


@query("U1_outer_schema_union", """SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
  UNION ALL SELECT c_custkey, CAST(NULL AS DOUBLE), c_mktsegment FROM customer""")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return T.outer_union([a, b])


@query("U2_set_difference", """SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.difference(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("U3_distinct_union", """SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem""")
def _(spark, d):
    return T.both_ends(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("U3_distinct_key_count", """SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem)""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("U4_table_equality", f"""WITH {FTB}, o AS (SELECT fov_id, frame, color, CASE WHEN fov_id % 9 = 0 THEN z + 1 ELSE z END AS z FROM fb)
  SELECT (SELECT count(*) FROM (SELECT fov_id, frame, color, z FROM fb EXCEPT ALL SELECT * FROM o)) AS only_left,
         (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT fov_id, frame, color, z FROM fb)) AS only_right""")
def _(spark, d):
    a = fov_frames(spark, d).select("fov_id", "frame", "color", "z")
    return T.table_difference(a, a.withColumn("z", F.when(F.col("fov_id") % 9 == 0, F.col("z") + 1).otherwise(F.col("z"))))
