"""Filter, pick, naming and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.functions import scalar as S
from stagelight.operators import select as P
from stagelight.operators.quantile import exact_quantiles
from stagelight.plans.registry import query
from stagelight.plans.tables import (
    CLOUD, FT, IMG, INV, PX, cloud, color_of, images, inventory, pixels, r6, table,
)

# per-FOV frame tables: blanks on the last plane of one channel, beads at 488 nm on the first
FTB = """fb AS (SELECT DISTINCT l_suppkey AS fov_id, l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS frame,
  CASE WHEN l_linenumber = 1 THEN CASE WHEN l_returnflag = 'N' THEN 488e0 WHEN l_returnflag = 'A' THEN 405e0 END
       WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL
       WHEN l_returnflag = 'A' THEN 405e0 WHEN l_returnflag = 'N' THEN 560e0 ELSE 650e0 END AS color,
  CASE WHEN l_linenumber IN (1, 7) THEN 0e0 ELSE l_linenumber * 0.5e0 END AS z,
  CASE l_linenumber WHEN 1 THEN 'bead' WHEN 7 THEN 'end' ELSE 'data' END AS segment FROM lineitem)"""


def fov_frames(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    bead = F.when(flag == "N", 488.0).when(flag == "A", 405.0)
    color = F.when(line == 1, bead).when((line == 7) & (flag == "R"), F.lit(None)).otherwise(color_of())
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("fov_id"),
        (line * 3 + F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)).alias("frame"),
        color.alias("color"), F.when(line.isin(1, 7), 0.0).otherwise(line * 0.5).alias("z"),
        F.when(line == 1, "bead").when(line == 7, "end").otherwise("data").alias("segment"),
    ).distinct()


@query("P1_data_frame_filter", f"""WITH {FTB} SELECT fov_id, frame, color, z FROM fb WHERE segment = 'data'""")
def _(spark, d):
    return P.data_frames(fov_frames(spark, d)).select("fov_id", "frame", "color", "z")


@query("P1_data_frame_filter_by_z", f"""WITH {FTB} SELECT fov_id, frame, color, z FROM fb WHERE z NOT IN (0, 1.5e0)""")
def _(spark, d):
    return P.data_frames(fov_frames(spark, d).drop("segment"), [0.0, 1.5])


@query("P2_colour_filter", f"""WITH {FTB} SELECT fov_id, frame, color FROM fb
  WHERE color IS NOT NULL AND round_even(color, 0) IN (488, 560, 650) AND round_even(color, 0) NOT IN (650)""")
def _(spark, d):
    return P.color_filter(fov_frames(spark, d), [488, 560, 650], [650]).select("fov_id", "frame", "color")


@query("P3_mid_z_frame_per_colour", f"""WITH {FTB}, dt AS (SELECT * FROM fb WHERE segment = 'data'),
  m AS (SELECT fov_id, (min(z) + max(z)) / 2 AS mid FROM dt GROUP BY ALL),
  b AS (SELECT fov_id, z FROM dt JOIN m USING (fov_id)
        QUALIFY row_number() OVER (PARTITION BY fov_id ORDER BY abs(z - mid), frame) = 1)
  SELECT fov_id, color, min(frame) AS frame FROM dt JOIN b USING (fov_id, z) WHERE color IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return P.mid_z_frames(fov_frames(spark, d), ["fov_id"])


@query("P4_frames_of_colour", f"""WITH {FTB} SELECT fov_id, list(frame ORDER BY z, frame) AS frames FROM fb
  WHERE segment = 'data' AND color = 560 GROUP BY fov_id""")
def _(spark, d):
    return P.frames_of_color(fov_frames(spark, d), ["fov_id"], 560)


@query("P5_bead_frames", f"""WITH {FTB}, n AS (SELECT fov_id, color, count(*) AS n FROM fb WHERE segment = 'bead' AND color IS NOT NULL GROUP BY ALL),
  c AS (SELECT fov_id, color FROM n QUALIFY row_number() OVER (PARTITION BY fov_id ORDER BY n, color) = 1),
  f AS (SELECT fov_id, list(frame ORDER BY frame) AS f FROM fb JOIN c USING (fov_id, color) WHERE segment IN ('bead', 'end') GROUP BY ALL)
  SELECT fov_id, f[1] AS first, f[-1] AS last, f[len(f) // 2 + 1] AS middle, CAST(len(f) AS INTEGER) AS n FROM f""")
def _(spark, d):
    return P.bead_frames(fov_frames(spark, d), ["fov_id"])


@query("P6_fiducial_frame", f"""WITH {FTB}, f AS (SELECT fov_id, list(frame ORDER BY frame) AS f FROM fb
  WHERE segment = 'bead' AND color = 488 GROUP BY ALL) SELECT fov_id, f[len(f) // 2 + 1] AS frame FROM f""")
def _(spark, d):
    ft = fov_frames(spark, d)
    has = ft.where("segment = 'bead' and color = 488").select("fov_id").distinct()
    return P.fiducial_frame(ft.join(has, "fov_id", "left_semi"), ["fov_id"])


@query("P7_blank_frames", f"""WITH {FTB}, ch AS (SELECT fov_id % 5 AS round_id, fov_id AS movie, color, frame FROM fb WHERE color IS NOT NULL AND segment = 'data'),
  m AS (SELECT round_id, movie FROM ch QUALIFY row_number() OVER (PARTITION BY round_id ORDER BY CAST(CAST(color AS INTEGER) AS VARCHAR), movie, frame) = 1)
  SELECT f.fov_id % 5 AS round_id, f.fov_id AS movie, f.frame FROM fb f JOIN m ON m.movie = f.fov_id WHERE f.color IS NULL""")
def _(spark, d):
    ft = fov_frames(spark, d).withColumn("round_id", F.col("fov_id") % 5).withColumnRenamed("fov_id", "movie")
    ch = ft.where("color is not null and segment = 'data'").withColumn("ord", F.struct("movie", "frame"))
    return P.blank_frames(ch, ft, ["round_id"], "ord").select("round_id", "movie", "frame")


@query("P8_subset_filter", """SELECT s_suppkey AS fov_id, ['a' || s_suppkey, 'b' || s_suppkey, 'c' || s_suppkey][least(3, s_nationkey % 3 + 1)] AS file
  FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(spark, d):
    sub = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("fov_id"))
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "fov_id")
    files = F.slice(F.array(*[F.concat(F.lit(p), F.col("fov_id")) for p in "abc"]), 1, F.col("s_nationkey") % 3 + 1)
    return P.fov_subset(s, sub).select("fov_id", P.series_at(files, 7).alias("file"))


STATUS = """st AS (SELECT o_orderkey % 5 + 1 AS round_id, o_orderkey AS fov_id,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'missing_chunks' ELSE 'truncated_chunks' END AS status FROM orders)"""


def statuses(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        (F.col("o_orderkey") % 5 + 1).alias("round_id"), F.col("o_orderkey").alias("fov_id"),
        F.when(s == "F", "ok").when(s == "O", "missing_chunks").otherwise("truncated_chunks").alias("status"),
    )


@query("P9_flag_incomplete", f"WITH {STATUS} SELECT * FROM st WHERE status NOT IN ('ok', 'not_checked')")
def _(spark, d):
    return P.flag_incomplete(statuses(spark, d))


@query("P9_status_counts", f"WITH {STATUS} SELECT round_id, status, count(*) AS n FROM st GROUP BY ALL")
def _(spark, d):
    return statuses(spark, d).groupBy("round_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("P10_keep_or_drop", """SELECT p_partkey AS fov_id, NOT (coalesce(damaged > 30, false)) AND NOT (p_size < 5) AS kept
  FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice % 100 END AS damaged FROM part)""")
def _(spark, d):
    fovs = table(spark, d, "part").select(
        F.col("p_partkey").alias("fov_id"), (F.col("p_size") < 5).alias("no_tissue"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") % 100).otherwise(F.lit(float("nan"))).alias("damaged_pct"),
    )
    return P.require_rows(P.keep_or_drop(fovs, 30, True), "no FOV left").select("fov_id", "kept")


@query("P11_contrast_stretch", f"""WITH {IMG}, s AS (SELECT grp, min(v) AS lo, quantile_cont(v, 0.9) AS hi FROM img GROUP BY grp)
  SELECT frame, r, c, CASE WHEN hi <= lo THEN 0 ELSE CAST(floor(least(1e0, greatest(0e0, (v - lo) / (hi - lo))) * 255) AS INTEGER) END AS v8
  FROM img JOIN s USING (grp)""")
def _(spark, d):
    img = images(spark, d)
    lim = img.groupBy("grp").agg(F.min("v").cast("double").alias("lo"), F.percentile("v", F.lit(0.9)).alias("hi"))
    return img.join(lim, "grp").select("frame", "r", "c", S.contrast_stretch("v", F.col("lo"), F.col("hi")).alias("v8"))


@query("P15_shared_range_filter", """WITH a AS (SELECT c_acctbal AS v, c_custkey AS id FROM customer), b AS (SELECT s_acctbal AS v FROM supplier),
  i AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT v FROM a)
        WHERE v BETWEEN greatest((SELECT min(v) FROM a), (SELECT min(v) FROM b)) AND least((SELECT max(v) FROM a), (SELECT max(v) FROM b)))
  SELECT v FROM i WHERE k % 5 = 0""")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_acctbal").alias("v")).distinct()
    return P.shared_range(a, table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), "v", 5)


@query("P16_transform_points", f"""WITH {CLOUD} SELECT id, round(1.5e0 * (cos(radians(30e0)) * (-x) - sin(radians(30e0)) * y) + 10, 6) AS tx,
  round(1.5e0 * (sin(radians(30e0)) * (-x) + cos(radians(30e0)) * y) - 5, 6) AS ty,
  round(0.9e0 * x + 0.1e0 * y + 3, 6) AS ax, round(-0.1e0 * x + 1.1e0 * y - 2, 6) AS ay FROM cloud""")
def _(spark, d):
    tx, ty = S.similarity("x", "y", scale=1.5, angle_deg=30, flip_x=True, tx=10, ty=-5)
    ax, ay = S.affine("x", "y", [[0.9, 0.1, 3.0], [-0.1, 1.1, -2.0]])
    return cloud(spark, d).select("id", r6(tx).alias("tx"), r6(ty).alias("ty"), r6(ax).alias("ax"), r6(ay).alias("ay"))


@query("P17_expected_name", """SELECT o_orderkey AS fov_id, 'hal_' || (o_orderkey % 5 + 1) || '_' ||
  repeat('0', greatest(4 - length(CAST(o_orderkey AS VARCHAR)), 0)) || o_orderkey || '.dax' AS name FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("fov_id"),
        F.concat(F.lit("hal_"), F.col("o_orderkey") % 5 + 1, F.lit("_{fov:04d}.dax")).alias("p"),
    )
    return o.select("fov_id", S.expected_name("p", "fov_id").alias("name"))


@query("P18_parse_series_name", r"""SELECT c_custkey, CAST(nullif(regexp_extract(c_name, '^Customer#(\d+)$', 1), '') AS BIGINT) AS fov_id,
  CAST(nullif(regexp_extract(c_name, '^Customer#0+1(\d+)$', 1), '') AS BIGINT) AS tail FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", S.fov_from_name("c_name", "Customer#{fov:09d}").alias("fov_id"),
        F.nullif(F.regexp_extract("c_name", r"^Customer#0+1(\d+)$", 1), F.lit("")).cast("long").alias("tail"),
    )


@query("P19_reroot_path", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/mnt/run/data/r' || o_orderkey
  WHEN 1 THEN '/root/data/x/r' || o_orderkey WHEN 2 THEN '/sample/data/r' || o_orderkey ELSE '/root/data/r' || o_orderkey END AS path FROM orders""")
def _(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("/mnt/run/data/r"), s)).when(k % 4 == 1, F.concat(F.lit("D:\\lab\\data\\x\\r"), s))
        .when(k % 4 == 2, F.concat(F.lit("data/r"), s)).otherwise(F.concat(F.lit("E:\\other\\r"), s))
    )
    return table(spark, d, "orders").select("o_orderkey", S.reroot_path(raw, "/root/data", "/sample").alias("path"))


@query("P20_coerce_bool", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true
  WHEN 3 THEN false END AS flag FROM events""")
def _(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "True").when(k == 1, "0").when(k == 2, "1").when(k == 3, "false")
    return table(spark, d, "events").select("event_id", S.strict_bool(raw).alias("flag"))


@query("P21_round_type_lookup", """SELECT min(c_custkey) AS round_id FROM customer WHERE lower(trim(' ' || c_mktsegment || ' ')) = 'machinery'""")
def _(spark, d):
    s = table(spark, d, "customer").select(
        F.col("c_custkey").alias("round_id"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("imaging_type")
    )
    return P.round_of_type(s, " Machinery")


@query("P21_cells_series", """SELECT c_custkey AS round_id FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN c_name LIKE '%7%'
  ELSE lower(c_mktsegment) = 'building' END""")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("round_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.when(F.col("c_mktsegment") == "BUILDING", " Cells ").otherwise("bits")).alias("imaging_type"),
        F.regexp_replace("c_name", "7", "_CELLS_").alias("series"),
    )
    return c.where(P.is_cells()).select("round_id")


@query("F1_format_duration", """WITH s AS (SELECT o_orderkey, o_totalprice / 10 AS v, CAST(round_even(o_totalprice / 10, 0) AS BIGINT) AS t FROM orders)
  SELECT o_orderkey, CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's'
    WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS short,
  CASE WHEN t < 60 THEN t || 's' ELSE (t // 86400) || 'd, ' || (t % 86400 // 3600) || 'h, ' || (t % 3600 // 60) || 'm' END AS days FROM s""")
def _(spark, d):
    v = F.col("o_totalprice") / 10
    return table(spark, d, "orders").select(
        "o_orderkey", S.format_duration(v).alias("short"), S.format_day_duration(v).alias("days")
    )


@query("F2_format_bytes", """WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 997 + o_orderkey AS n FROM orders)
  SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024e0)
  WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576e0) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824e0)
  ELSE printf('%.1f TiB', n / 1099511627776e0) END AS size FROM s""")
def _(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.format_bytes(k * k * 997 + k).alias("size"))


@query("F3_nice_limit", """WITH p AS (SELECT o_orderstatus, quantile_cont(abs(o_totalprice), 0.99) AS hi FROM orders GROUP BY ALL),
  m AS (SELECT o_orderstatus, hi, pow(10e0, floor(log10(hi))) AS mag FROM p)
  SELECT o_orderstatus, CASE WHEN hi <= mag THEN mag WHEN hi <= 2 * mag THEN 2 * mag WHEN hi <= 5 * mag THEN 5 * mag ELSE 10 * mag END AS lim FROM m""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.abs("o_totalprice").alias("v"))
    q = exact_quantiles(o, ["o_orderstatus"], "v", {"hi": 0.99})
    return q.select("o_orderstatus", S.nice_limit("hi").alias("lim"))


@query("F4_channel_map", f"""WITH {FTB} SELECT fov_id, frame, CAST(CASE color WHEN 405 THEN 4 WHEN 488 THEN 3 WHEN 560 THEN 2 WHEN 650 THEN 1 END AS INTEGER) AS channel FROM fb""")
def _(spark, d):
    return fov_frames(spark, d).select("fov_id", "frame", S.channel_map("color", S.CHANNELS["MF3"]).alias("channel"))
