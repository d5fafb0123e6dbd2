"""Join queries: metadata, as-of, positions, matches and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators import counters as C
from stagelight.operators import joins as J
from stagelight.operators import positions as G
from stagelight.operators import ranking as R
from stagelight.operators.spatial import contact_edges, mutual_nearest
from stagelight.operators.spatial_stats import median_nn_distance
from stagelight.plans.aggregate_queries import RS, round_stats, rounded
from stagelight.plans.registry import query
from stagelight.session import cut_lineage
from stagelight.plans.tables import CLOUD, LOG, PCLOUD, PS, cloud, color_of, focus_log, pixels, positions, r6, table


def rounds(spark, d):
    k = F.col("r_regionkey") + 1
    return table(spark, d, "region").select(
        k.alias("round_id"), F.concat(F.lit("hal_"), k, F.lit("_{fov:04d}")).alias("series"), k.alias("ord"),
        F.array(F.concat(F.lit("data/h"), k), F.lit("data")).alias("dirs"))


# every order is a file of round key % 5 + 1; some sit in the second folder, some have another digit width, some are named otherwise
FILES = """fi AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS r, o_orderkey // 5 AS fov, CASE WHEN o_orderkey % 3 = 0 THEN 'data' ELSE 'data/h' || (o_orderkey % 5 + 1) END AS dir,
  CASE WHEN o_orderkey % 11 = 0 THEN 'other_' ELSE 'hal_' END || (o_orderkey % 5 + 1) || '_' || repeat('0', greatest(CASE WHEN o_orderkey % 7 = 0 THEN 6 ELSE 4 END - length(CAST(o_orderkey // 5 AS VARCHAR)), 0)) || (o_orderkey // 5) || '.dax' AS name FROM orders)"""


def files(spark, d):
    k = F.col("o_orderkey")
    fov, r = F.floor(k / 5), k % 5 + 1
    width = F.when(k % 7 == 0, 6).otherwise(4)
    num = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(fov.cast("string")), F.lit(0))), fov.cast("string"))
    name = F.concat(F.when(k % 11 == 0, "other_").otherwise("hal_"), r, F.lit("_"), num, F.lit(".dax"))
    return table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 3 == 0, "data").otherwise(F.concat(F.lit("data/h"), r)).alias("dir"), name.alias("name"))


@query("J1_resolve_expected_files", f"""WITH {FILES}, {PS}, rn AS (SELECT r_regionkey + 1 AS r FROM region),
  w AS (SELECT rn.r, ps.fov_id, 'hal_' || rn.r || '_' || repeat('0', greatest(4 - length(CAST(fov_id AS VARCHAR)), 0)) || fov_id || '.dax' AS want FROM rn, ps),
  h AS (SELECT w.r, w.fov_id, want, fi.dir, fi.name, row_number() OVER (PARTITION BY w.r, w.fov_id ORDER BY CASE WHEN fi.name = want THEN 0 ELSE 1 END, CASE WHEN fi.dir = 'data' THEN 1 ELSE 0 END, fi.name) AS rk
        FROM w LEFT JOIN fi ON fi.r = w.r AND fi.fov = w.fov_id AND fi.name LIKE 'hal%')
  SELECT CAST(r AS INTEGER) AS round_id, 'hal_' || r || '_{{fov:04d}}' AS series, fov_id, coalesce(dir || '/' || name, 'data/h' || r || '/' || want) AS path, name IS NOT NULL AS exists FROM h WHERE rk = 1""")
def _(spark, d):
    return J.resolve_expected_files(rounds(spark, d), positions(spark, d), files(spark, d))


@query("J2_classify_files", f"""WITH {FILES}, m AS (SELECT *, CASE WHEN starts_with(name, 'hal_1_00') THEN 102 WHEN name LIKE 'hal%' THEN r ELSE 101 END AS m FROM fi)
  SELECT dir || '/' || name AS path, CAST(m AS INTEGER) AS round_id, CASE m WHEN 102 THEN 'hal_1_00{{fov}}' WHEN 101 THEN 'other_{{run}}_{{fov:04d}}' ELSE 'hal_' || r || '_{{fov:04d}}' END AS series,
  CASE m WHEN 102 THEN CAST(replace(substr(name, 9), '.dax', '') AS BIGINT) ELSE fov END AS fov_id FROM m""")
def _(spark, d):
    f = files(spark, d).select(F.concat_ws("/", "dir", "name").alias("path"))
    # one pattern whose digits touch its placeholder, one with a second placeholder
    more = spark.createDataFrame([(101, "other_{run}_{fov:04d}", 50), (102, "hal_1_00{fov}", 0)], "round_id int, series string, ord int")
    series = rounds(spark, d).select(F.col("round_id").cast("int").alias("round_id"), "series", F.col("ord").cast("int").alias("ord"))
    return J.classify_files(f, series.unionByName(more))


@query("J3_annotate_stats", f"""WITH {RS}, {PS} SELECT rs.round_id, rs.fov_id, rs.frame, round(mean, 6) AS mean, x, y, CASE WHEN frame <> 7 THEN 405e0 + rs.round_id END AS color,
  CASE WHEN frame <> 7 THEN frame * 0.5e0 END AS z, CASE WHEN frame <> 7 THEN CASE WHEN frame = 1 THEN 'bead' ELSE 'data' END END AS segment, 'S1' AS sample FROM rs LEFT JOIN ps USING (fov_id)""")
def _(spark, d):
    ft = round_stats(spark, d).where("frame <> 7").select("round_id", "frame").distinct().select(
        "round_id", "frame", (405.0 + F.col("round_id")).alias("color"), (F.col("frame") * 0.5).alias("z"),
        F.when(F.col("frame") == 1, "bead").otherwise("data").alias("segment"))
    a = J.annotate_stats(round_stats(spark, d), positions(spark, d), ft, "S1")
    return a.select("round_id", "fov_id", "frame", r6("mean").alias("mean"), "x", "y", "color", "z", "segment", "sample")


RF = """rf AS (SELECT DISTINCT l_orderkey % 5 AS round_id, CAST(l_linenumber AS INTEGER) AS frame, CASE l_returnflag WHEN 'A' THEN 405e0 WHEN 'N' THEN 560e0 ELSE 650e0 END AS color, l_linenumber * 0.5e0 AS z FROM lineitem)"""


@query("J4_build_channel_table", f"""WITH {RF}, l AS (SELECT round_id, color, list(frame ORDER BY frame, z) AS frame, list(z ORDER BY frame, z) AS z_pos FROM rf GROUP BY round_id, color),
  b AS (SELECT p_partkey AS bit, p_partkey % 5 AS round_id, CASE p_partkey % 3 WHEN 0 THEN 405e0 WHEN 1 THEN 560e0 ELSE 650e0 END AS color FROM part)
  SELECT CASE WHEN bit % 5 = 0 THEN 'gene' || bit ELSE 'bit' || repeat('0', greatest(2 - length(CAST(bit AS VARCHAR)), 0)) || bit END AS channel_name,
  CASE WHEN bit % 4 = 0 THEN 'own' || bit ELSE 'probe' || bit END AS readout_name, bit AS bit_number, round_id AS imaging_round, color, frame, z_pos, r_name AS image_type, CAST(round_id + 1 AS BIGINT) AS fiducial_frame
  FROM b JOIN l USING (round_id, color) JOIN region ON r_regionkey = round_id""")
def _(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    bits = p.select((k % 5).alias("round_id"), k.alias("bit"), F.when(k % 3 == 0, 405.0).when(k % 3 == 1, 560.0).otherwise(650.0).alias("color"))
    cat = p.select(k.alias("bit"), F.concat(F.lit("probe"), k).alias("probe"))
    own = p.where("p_partkey % 4 = 0").select(k.alias("bit"), F.concat(F.lit("own"), k).alias("probe"))
    genes = p.where("p_partkey % 5 = 0").select(k.alias("bit"), F.concat(F.lit("gene"), k).alias("gene"))
    rid = F.col("r_regionkey").cast("long")
    reg = table(spark, d, "region")
    rnd = reg.select(rid.alias("round_id"), F.col("r_name").alias("image_type"), F.lit("x").alias("name_regexp"), F.lit("s").alias("series"))
    fid = reg.select(rid.alias("round_id"), (rid + 1).alias("fiducial_frame"), F.lit(0.0).alias("fiducial_z"))
    frames = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("round_id"), F.col("l_linenumber").alias("frame"), color_of().alias("color"), (F.col("l_linenumber") * 0.5).alias("z")).distinct()
    t = J.build_channel_table(frames, bits, cat, own, genes, rnd, fid)
    return t.select("channel_name", "readout_name", "bit_number", "imaging_round", "color", "frame", "z_pos", "image_type", "fiducial_frame")


@query("J5_unknown_reference_check", """SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) AND l_partkey NOT IN (SELECT c_custkey FROM customer)""")
def _(spark, d):
    as_id = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"))
    return J.unknown_references(as_id("lineitem", "l_partkey"), [as_id("supplier", "s_suppkey"), as_id("customer", "c_custkey")], "id")


@query("J6_bit_lookup", f"""WITH b AS (SELECT s_suppkey + 1 AS bit, s_suppkey * 3 AS round, CASE s_suppkey % 3 WHEN 0 THEN 405e0 WHEN 1 THEN 560e0 ELSE 650e0 END AS color FROM supplier),
  k AS (SELECT bit, color, dense_rank() OVER (ORDER BY round) AS k FROM b), r AS (SELECT c_custkey AS round_id, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0),
  f AS (SELECT DISTINCT l_suppkey * 2 AS round_id, l_linenumber AS frame, CASE l_returnflag WHEN 'A' THEN 405e0 WHEN 'N' THEN 560e0 ELSE 650e0 END AS color FROM lineitem WHERE l_linenumber = 4)
  SELECT bit, round_id, k.color, CASE WHEN f.frame IS NOT NULL THEN 2e0 END AS z, f.frame, f.frame IS NOT NULL AS ok FROM k JOIN r USING (k) LEFT JOIN f USING (round_id, color)""")
def _(spark, d):
    s = F.col("s_suppkey")
    sup = table(spark, d, "supplier")
    bits = sup.select((s + 1).alias("bit"), (s * 3).alias("round"), F.when(s % 3 == 0, 405.0).when(s % 3 == 1, 560.0).otherwise(650.0).alias("color"))
    rnd = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("round_id"))
    frames = pixels(spark, d).select((F.col("fov_id") * 2).alias("round_id"), "frame", "color", (F.col("frame") * 0.5).alias("z")).distinct()
    n = sup.count()  # one number: the length of the barcode
    return J.bit_lookup(bits, rnd, frames, n).select(F.col("bit").cast("long").alias("bit"), "round_id", "color", "z", "frame", "ok")


SUP = """nd AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS item FROM orders), hv AS (SELECT DISTINCT s_nationkey AS cfg, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][s_suppkey % 5 + 1] AS item FROM supplier),
  hs AS (SELECT cfg, count(*) AS n_items FROM hv GROUP BY cfg), ns AS (SELECT k, count(*) AS need FROM nd GROUP BY k),
  ft AS (SELECT k, cfg FROM nd JOIN hv USING (item) GROUP BY k, cfg HAVING count(*) = (SELECT need FROM ns WHERE ns.k = nd.k)),
  rk AS (SELECT k, cfg, n_items, rank() OVER (PARTITION BY k ORDER BY n_items) AS r FROM ft JOIN hs USING (cfg)),
  tp AS (SELECT k, min(cfg) AS cfg, any_value(n_items) AS n_items, count(*) AS n FROM rk WHERE r = 1 GROUP BY k)"""


@query("J7_smallest_superset_match", f"""WITH {SUP} SELECT k, CASE WHEN n = 1 THEN cfg END AS cfg, n_items, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'tie' ELSE 'ok' END AS status FROM ns LEFT JOIN tp USING (k)""")
def _(spark, d):
    need = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("item"))
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    have = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cfg"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("item"))
    return J.smallest_superset(need, have, "k", "cfg", "item")


@query("J8_reimage_folders", """WITH f AS (SELECT 'data' AS parent, 'H' || c_custkey // 3 || CASE c_custkey % 3 WHEN 1 THEN '_old' WHEN 2 THEN '_old_' || c_custkey ELSE '' END AS name FROM customer),
  dl AS (SELECT 'data' AS parent, 'H' || s_suppkey AS name, s_suppkey AS round_id FROM supplier)
  SELECT f.parent, regexp_extract(f.name, '^(.+)_old(?:_[0-9]+)?$', 1) AS base, f.name, round_id FROM f JOIN dl ON dl.name = regexp_extract(f.name, '^(.+)_old(?:_[0-9]+)?$', 1)""")
def _(spark, d):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 1, "_old").when(k % 3 == 2, F.concat(F.lit("_old_"), k)).otherwise("")
    folders = table(spark, d, "customer").select(F.lit("data").alias("parent"), F.concat(F.lit("H"), F.floor(k / 3), tail).alias("name"))
    decl = table(spark, d, "supplier").select(F.lit("data").alias("parent"), F.concat(F.lit("H"), "s_suppkey").alias("name"), F.col("s_suppkey").alias("round_id"))
    return J.reimage_folders(folders, decl)


AS = """tg AS (SELECT o_orderkey AS id, o_custkey % 150 AS movie, o_totalprice / 4000 AS t FROM orders), rw AS (SELECT user_id AS movie, value AS z, event_id AS frame FROM events)"""


def asof_inputs(spark, d):
    tg = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 150).alias("movie"), (F.col("o_totalprice") / 4000).alias("t"))
    rw = table(spark, d, "events").select(F.col("user_id").alias("movie"), F.col("value").alias("z"), F.col("event_id").alias("frame"))
    return tg, rw


@query("J9_asof_floor_join", f"""WITH {AS}, fl AS (SELECT tg.id, arg_max(rw.frame, rw.z * 1e6 - rw.frame / 1e3) AS frame, max(rw.z) AS z FROM tg JOIN rw ON rw.movie = tg.movie AND rw.z <= tg.t GROUP BY tg.id),
  lo AS (SELECT movie, arg_min(frame, z * 1e6 + frame / 1e3) AS frame, min(z) AS z FROM rw GROUP BY movie)
  SELECT tg.id, tg.movie, tg.t, coalesce(fl.z, lo.z) AS z, coalesce(fl.frame, lo.frame) AS frame FROM tg LEFT JOIN fl USING (id) LEFT JOIN lo ON lo.movie = tg.movie""")
def _(spark, d):
    tg, rw = asof_inputs(spark, d)
    return J.asof_floor(tg, rw, ["movie"], "t", "z", "frame").select("id", "movie", "t", "z", "frame")


@query("J10_nearest_join_1d", f"""WITH {AS} SELECT tg.id, tg.movie, any_value(tg.t) AS t, arg_min(rw.z, struct_pack(a := abs(rw.z - tg.t), b := rw.frame)) AS z, arg_min(rw.frame, struct_pack(a := abs(rw.z - tg.t), b := rw.frame)) AS frame
  FROM tg LEFT JOIN rw ON rw.movie = tg.movie GROUP BY tg.id, tg.movie""")
def _(spark, d):
    tg, rw = asof_inputs(spark, d)
    return J.nearest_1d(tg, rw, ["movie"], "t", "z", "frame").select("id", "movie", "t", "z", "frame")


@query("J11_nearest_position_match", f"""WITH {PS}, q AS (SELECT o_orderkey AS id, 200e0 * (o_orderkey % 12) + (o_orderkey % 5 - 2) / 4e0 AS x, 200e0 * (o_orderkey // 12 % 12) AS y FROM orders)
  SELECT q.id, q.x, q.y, p.fov_id, CASE WHEN p.fov_id IS NOT NULL THEN round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 6) END AS dist FROM q LEFT JOIN ps p ON abs(p.x - q.x) <= 0.5e0 AND abs(p.y - q.y) <= 0.5e0""")
def _(spark, d):
    k = F.col("o_orderkey")
    q = table(spark, d, "orders").select(k.alias("id"), (200.0 * (k % 12) + (k % 5 - 2) / 4.0).alias("x"), (200.0 * (F.floor(k / 12) % 12)).alias("y"))
    return G.nearest_position(q, positions(spark, d), 0.5).select("id", "x", "y", "fov_id", r6("dist").alias("dist"))


NB = """nb AS (SELECT p.fov_id, o.n AS direction, q.fov_id AS neighbour FROM ps p, (VALUES ('right', 1, 0), ('left', -1, 0), ('up', 0, 1), ('down', 0, -1)) o(n, dx, dy)
  LEFT JOIN ps q ON q.x = p.x + 200 * o.dx AND q.y = p.y + 200 * o.dy)"""


@query("J12_grid_neighbour", f"WITH {PS}, {NB} SELECT * FROM nb")
def _(spark, d):
    return G.grid_neighbours(positions(spark, d), 200)


@query("J13_exterior_split", f"""WITH {PS}, o AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0)
  SELECT p.fov_id, bool_or(q.fov_id IS NULL) AS exterior, CAST((any_value(p.y) - (SELECT min(y) FROM ps)) / 200 AS INTEGER) AS "row", CAST((any_value(p.x) - (SELECT min(x) FROM ps)) / 200 AS INTEGER) AS col
  FROM ps p, o LEFT JOIN ps q ON q.x = p.x + 200 * dx AND q.y = p.y + 200 * dy GROUP BY p.fov_id""")
def _(spark, d):
    p = positions(spark, d)
    return G.exterior_split(p, 200).join(G.grid_row_col(p, 200).select("fov_id", "row", "col"), "fov_id")


@query("J13_exterior_split_4", f"WITH {PS}, {NB} SELECT fov_id, bool_or(neighbour IS NULL) AS exterior FROM nb GROUP BY fov_id")
def _(spark, d):
    return G.exterior_split(positions(spark, d), 200, "4")


@query("J14_complete_3x3_block", f"""WITH {PS}, b AS (SELECT p.fov_id AS center, max(CASE WHEN dx = 0 AND dy = 1 THEN q.fov_id END) AS up, max(CASE WHEN dx = 0 AND dy = -1 THEN q.fov_id END) AS down, max(CASE WHEN dx = -1 AND dy = 0 THEN q.fov_id END) AS left,
  max(CASE WHEN dx = 1 AND dy = 0 THEN q.fov_id END) AS right, max(CASE WHEN dx = -1 AND dy = 1 THEN q.fov_id END) AS up_left, max(CASE WHEN dx = 1 AND dy = 1 THEN q.fov_id END) AS up_right,
  max(CASE WHEN dx = -1 AND dy = -1 THEN q.fov_id END) AS down_left, max(CASE WHEN dx = 1 AND dy = -1 THEN q.fov_id END) AS down_right, count(q.fov_id) AS n
  FROM ps p, range(-1, 2) a(dx), range(-1, 2) b(dy) LEFT JOIN ps q ON q.x = p.x + 200 * dx AND q.y = p.y + 200 * dy GROUP BY p.fov_id)
  SELECT * EXCLUDE (n) FROM b WHERE n = 9""")
def _(spark, d):
    return G.complete_blocks(positions(spark, d), 200)


@query("J15_median_nn_distance", f"""WITH {CLOUD}, n AS (SELECT a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM cloud a JOIN cloud b ON a.id <> b.id GROUP BY a.id)
  SELECT round(median(d), 6) AS median_nn FROM n""")
def _(spark, d):
    return rounded(median_nn_distance(cloud(spark, d), 25.0), {"median_nn"})


@query("J16_contact_graph", f"""WITH {CLOUD} SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS dist FROM cloud a JOIN cloud b ON a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 625""")
def _(spark, d):
    # rounded by rint: squares are whole numbers here, so no distance lies halfway between two roundings
    return contact_edges(cloud(spark, d), 25).select("a", "b", (F.rint(F.col("dist") * 1e6) / 1e6).alias("dist"))


MNN = """sc AS (SELECT * FROM cloud WHERE id % 2 = 0), tc AS (SELECT * FROM cloud WHERE id % 2 = 1),
  cd AS (SELECT s.id AS src_id, t.id AS tgt_id, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS dist FROM sc s JOIN tc t ON pow(s.x - t.x, 2) + pow(s.y - t.y, 2) <= 900),
  mn AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY dist, tgt_id) = 1 AND row_number() OVER (PARTITION BY tgt_id ORDER BY dist, src_id) = 1)"""


def halves(spark, d):
    c = cloud(spark, d)
    return c.where("id % 2 = 0").withColumnRenamed("id", "src_id"), c.where("id % 2 = 1").withColumnRenamed("id", "tgt_id")


@query("J17_mutual_nearest_neighbour", f"WITH {CLOUD}, {MNN} SELECT src_id, tgt_id, round(dist, 6) AS dist FROM mn")
def _(spark, d):
    s, t = halves(spark, d)
    return rounded(mutual_nearest(s, t, 30), {"dist"})


@query("J18_graph_consistency_filter", f"""WITH {CLOUD}, {MNN}, se AS (SELECT a.id AS i, b.id AS n FROM sc a JOIN sc b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1600),
  te AS (SELECT a.id AS i, b.id AS n FROM tc a JOIN tc b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1600),
  sh AS (SELECT m.src_id, m.tgt_id, count(te.n) * 1e0 / count(*) AS share FROM mn m JOIN se ON se.i = m.src_id LEFT JOIN mn o ON o.src_id = se.n LEFT JOIN te ON te.i = m.tgt_id AND te.n = o.tgt_id GROUP BY ALL)
  SELECT m.src_id, m.tgt_id FROM mn m LEFT JOIN sh USING (src_id, tgt_id) WHERE share IS NULL OR share >= 0.25e0""")
def _(spark, d):
    s, t = halves(spark, d)
    pairs = cut_lineage(mutual_nearest(s, t, 30))
    return G.consistent_within(pairs, s, t, 40, 0.25).select("src_id", "tgt_id")


BD = """bd AS (SELECT p_partkey AS spot_id, p_partkey % 4 AS fov, [405, 560, 650][p_partkey // 4 % 3 + 1] AS color, CAST(p_partkey // 12 * 31 % 211 + p_partkey % 3 AS DOUBLE) AS x_px, CAST(p_partkey // 12 * 17 % 199 + p_partkey % 5 AS DOUBLE) AS y_px, p_size / 10e0 AS z_um FROM part),
  nr AS (SELECT q.fov, q.color, q.spot_id, q.x_px, q.y_px, q.z_um, r.spot_id AS ref_id, sqrt(pow(q.x_px - r.x_px, 2) + pow(q.y_px - r.y_px, 2)) AS dist FROM bd q JOIN bd r ON r.fov = q.fov AND r.color = 560 AND q.color <> 560 AND pow(q.x_px - r.x_px, 2) + pow(q.y_px - r.y_px, 2) < 36
         QUALIFY row_number() OVER (PARTITION BY q.fov, q.spot_id ORDER BY dist, ref_id) = 1),
  cl AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY fov, ref_id, color ORDER BY dist, spot_id) = 1)"""


@query("J19_match_across_channels", f"""WITH {BD}, w AS (SELECT r.fov, r.spot_id AS ref_id, a.x_px * 0.1e0 AS "405_x", a.y_px * 0.1e0 AS "405_y", a.z_um AS "405_z", r.x_px * 0.1e0 AS "560_x", r.y_px * 0.1e0 AS "560_y", r.z_um AS "560_z", b.x_px * 0.1e0 AS "650_x", b.y_px * 0.1e0 AS "650_y", b.z_um AS "650_z"
  FROM bd r JOIN cl a ON a.fov = r.fov AND a.ref_id = r.spot_id AND a.color = 405 JOIN cl b ON b.fov = r.fov AND b.ref_id = r.spot_id AND b.color = 650 WHERE r.color = 560)
  SELECT fov, ref_id, round("405_x", 6) AS "405_x", round("405_y", 6) AS "405_y", "405_z", round("560_x", 6) AS "560_x", round("560_y", 6) AS "560_y", "560_z", round("650_x", 6) AS "650_x", round("650_y", 6) AS "650_y", "650_z",
  row_number() OVER (PARTITION BY fov ORDER BY ref_id) - 1 AS bead_id FROM w""")
def _(spark, d):
    k = F.col("p_partkey")
    g = F.floor(k / 12)
    spots = table(spark, d, "part").select(
        k.alias("spot_id"), (k % 4).alias("fov"), F.element_at(F.array(F.lit(405), F.lit(560), F.lit(650)), (F.floor(k / 4) % 3 + 1).cast("int")).alias("color"),
        (g * 31 % 211 + k % 3).cast("double").alias("x_px"), (g * 17 % 199 + k % 5).cast("double").alias("y_px"), (F.col("p_size") / 10.0).alias("z_um"))
    m = G.match_channels(spots, 560, [405, 560, 650], 6, 0.1, group=["fov"])
    return m.select(*[r6(c).alias(c) if c[-2:] in ("_x", "_y") else F.col(f"`{c}`") for c in m.columns])


# bead tables of one FOV each: reference points, and the same points moved by (7, -3) with some noise points
TV = """sp AS (SELECT c_custkey // 60 AS fov, CAST(c_custkey * 37 % 499 AS DOUBLE) AS "row", CAST(c_custkey * 91 % 503 AS DOUBLE) AS col FROM customer),
  tp AS (SELECT c_custkey // 60 AS fov, CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 53 % 491 ELSE c_custkey * 37 % 499 + 7 END AS DOUBLE) AS "row", CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 29 % 487 ELSE c_custkey * 91 % 503 - 3 END AS DOUBLE) AS col FROM customer),
  pd AS (SELECT s.fov, s."row" - t."row" AS dy, s.col - t.col AS dx FROM sp s JOIN tp t USING (fov) WHERE abs(s."row" - t."row") <= 64 AND abs(s.col - t.col) <= 64),
  hb AS (SELECT fov, least(floor((dy + 64) / 4), 31) AS iy, least(floor((dx + 64) / 4), 31) AS ix, count(*) AS n FROM pd GROUP BY ALL),
  pk AS (SELECT fov, (iy + 0.5e0) * 4 - 64 AS dy0, (ix + 0.5e0) * 4 - 64 AS dx0 FROM hb QUALIFY row_number() OVER (PARTITION BY fov ORDER BY n DESC, iy, ix) = 1)"""


def bead_sets(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    fov = F.floor(k / 60).alias("fov")
    src = c.select(fov, (k * 37 % 499).cast("double").alias("row"), (k * 91 % 503).cast("double").alias("col"))
    noise = k % 6 == 0
    tgt = c.select(fov, F.when(noise, k * 53 % 491).otherwise(k * 37 % 499 + 7).cast("double").alias("row"),
                   F.when(noise, k * 29 % 487).otherwise(k * 91 % 503 - 3).cast("double").alias("col"))
    return src, tgt


@query("J20_translation_vote", f"""WITH {TV}, il AS (SELECT fov, avg(dy) AS dy, avg(dx) AS dx, count(*) AS n FROM pd JOIN pk USING (fov) WHERE abs(dy - dy0) < 8 AND abs(dx - dx0) < 8 GROUP BY fov),
  ns AS (SELECT fov, count(*) AS n FROM sp GROUP BY fov)
  SELECT fov, round(dy, 6) AS dy, round(dx, 6) AS dx, il.n AS n_inliers, round(il.n / ns.n, 6) AS score, ns.n AS n_src, ns.n AS n_tgt FROM il JOIN ns USING (fov)""")
def _(spark, d):
    src, tgt = bead_sets(spark, d)
    return rounded(G.translation_vote(src, tgt, ["fov"], max_shift=64), {"dy", "dx", "score"})


@query("J21_points_in_windows", f"""WITH {CLOUD}, wi AS (SELECT s_suppkey AS window_id, s_suppkey * 61 % 1100 AS x0, s_suppkey * 83 % 1100 AS y0 FROM supplier)
  SELECT window_id, count(id) AS n, round(median(volume), 6) AS vol_med, round(quantile_cont(volume, 0.1), 6) AS vol_q10, round(quantile_cont(volume, 0.9), 6) AS vol_q90,
  round(avg(CASE WHEN id IS NOT NULL THEN CAST(volume < 20 AS INTEGER) END), 6) AS frac_small, round(avg(CASE WHEN id IS NOT NULL THEN CAST(volume > 1000 AS INTEGER) END), 6) AS frac_large
  FROM wi LEFT JOIN cloud ON x >= x0 AND x < x0 + 100 AND y >= y0 AND y < y0 + 100 GROUP BY window_id""")
def _(spark, d):
    k = F.col("s_suppkey")
    w = table(spark, d, "supplier").select(k.alias("window_id"), (k * 61 % 1100).alias("x0"), (k * 83 % 1100).alias("y0"))
    f = G.window_point_features(cloud(spark, d), w, 100)
    return rounded(f, set(f.columns) - {"window_id", "n"}).select("window_id", "n", "vol_med", "vol_q10", "vol_q90", "frac_small", "frac_large")


SQ = """sq AS (SELECT s_suppkey // 16 AS fov, CAST(s_suppkey // 4 % 4 AS INTEGER) AS i, CAST(s_suppkey % 4 AS INTEGER) AS j, 1000e0 * (s_suppkey // 16) + 50 * (s_suppkey % 4) AS x0, 50e0 * (s_suppkey // 4 % 4) AS y0, s_acctbal / 10000 AS score FROM supplier WHERE s_suppkey % 9 <> 0)"""


@query("J22_flag_points_by_square", f"""WITH {SQ}, pt AS (SELECT c_custkey AS id, c_custkey % 9 AS fov, 1000e0 * (c_custkey % 9) + c_custkey * 37 % 260 - 20 AS x, c_custkey * 91 % 240 - 20e0 AS y FROM customer),
  og AS (SELECT fov, min(x0 - 50 * j) AS ox, min(y0 - 50 * i) AS oy FROM sq GROUP BY fov),
  ij AS (SELECT pt.*, CAST(coalesce(least(greatest(floor((y - oy) / 50), 0), 3), -1) AS INTEGER) AS i, CAST(coalesce(least(greatest(floor((x - ox) / 50), 0), 3), -1) AS INTEGER) AS j FROM pt LEFT JOIN og USING (fov))
  SELECT ij.fov, ij.i, ij.j, id, x, y, score, CASE WHEN score IS NULL THEN 'no score' WHEN score > 0.5 THEN 'damaged' ELSE 'good' END AS quality FROM ij LEFT JOIN sq ON sq.fov = ij.fov AND sq.i = ij.i AND sq.j = ij.j""")
def _(spark, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    fov, i, j = F.floor(k / 16), (F.floor(k / 4) % 4).cast("int"), (k % 4).cast("int")
    sq = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(
        fov.alias("fov"), i.alias("i"), j.alias("j"), (1000.0 * fov + 50 * j).alias("x0"), (50.0 * i).alias("y0"), (F.col("s_acctbal") / 10000).alias("score"))
    pts = table(spark, d, "customer").select(c.alias("id"), (c % 9).alias("fov"), (1000.0 * (c % 9) + c * 37 % 260 - 20).alias("x"), (c * 91 % 240 - 20.0).alias("y"))
    return G.flag_points_by_square(sq.withColumn("removed", F.col("score") > 0.5), pts, 50.0, 4)


@query("J23_reference_consistency", """WITH s AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'valve' ELSE 'pump' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS protocol, p_partkey AS pos FROM part),
  u AS (SELECT kind, name, protocol, min(pos) AS pos, count(*) AS n FROM s WHERE name = upper(name) GROUP BY ALL)
  SELECT *, CASE WHEN name LIKE '%1%' THEN NULL ELSE lower(name) END AS suggestion, name NOT LIKE '%1%' AS normalized_match FROM u""")
def _(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "valve").otherwise("pump").alias("kind")
    p = table(spark, d, "part")
    steps = p.select(kind, F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("protocol"), k.alias("pos"))
    cmds = p.where(~F.col("p_name").contains("1")).select(kind, F.col("p_name").alias("name"), k.alias("pos"))
    return J.reference_consistency(steps.where((k % 5 == 0) | ~F.col("p_name").contains("1")), cmds)


@query("J24_last_flowed_valve", """WITH s AS (SELECT o_custkey AS protocol, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN 'pump' ELSE 'valve' END AS kind, ' ' || o_orderpriority AS name FROM orders),
  f AS (SELECT protocol, pos, kind, last_value(CASE WHEN kind = 'valve' THEN trim(name) END IGNORE NULLS) OVER (PARTITION BY protocol ORDER BY pos) AS v FROM s)
  SELECT protocol, arg_max(v, pos) FILTER (WHERE kind = 'pump' AND v IS NOT NULL) AS valve FROM f GROUP BY protocol""")
def _(spark, d):
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("protocol"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", "pump").otherwise("valve").alias("kind"),
        F.concat(F.lit(" "), "o_orderpriority").alias("name"))
    return J.last_flowed_valve(s)


EST = """ea AS (SELECT c_custkey AS fov_id, c_acctbal / 100 AS z FROM customer WHERE c_custkey % 10 <> 0), eb AS (SELECT o_custkey AS fov_id, avg(o_totalprice) / 5000 AS z FROM orders GROUP BY ALL),
  df AS (SELECT fov_id, ea.z AS a, eb.z AS b, eb.z - ea.z AS diff FROM ea FULL JOIN eb USING (fov_id))"""


def estimates(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("fov_id"), (F.col("c_acctbal") / 100).alias("z"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("fov_id")).agg((F.avg("o_totalprice") / 5000).alias("z"))
    return a, b


@query("J26_compare_estimates", f"""WITH {EST} SELECT count(diff) AS n_both, count(*) FILTER (WHERE a IS NULL) AS n_only_b, count(*) FILTER (WHERE b IS NULL) AS n_only_a, round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff), 6) AS std_diff,
  round(avg(CAST(diff < 0 AS INTEGER)), 6) AS share_lower, round(corr(diff, c_nationkey), 6) AS corr_brightness, round(median(diff), 6) AS median_diff FROM df LEFT JOIN customer ON c_custkey = fov_id""")
def _(spark, d):
    a, b = estimates(spark, d)
    br = table(spark, d, "customer").select(F.col("c_custkey").alias("fov_id"), F.col("c_nationkey").cast("double").alias("brightness"))
    c = J.compare_estimates(a, b, "fov_id", "z", br)
    return rounded(c, {"mean_diff", "std_diff", "share_lower", "corr_brightness", "median_diff"})


@query("J26_worst_differences", f"WITH {EST} SELECT fov_id, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM df WHERE diff IS NOT NULL ORDER BY abs(df.diff) DESC, fov_id LIMIT 6")
def _(spark, d):
    a, b = estimates(spark, d)
    return rounded(J.largest_differences(a, b, "fov_id", "z"), {"a", "b", "diff"})


@query("J27_apply_drift", f"""WITH {PS} SELECT fov_id, x, y, x + coalesce(c_acctbal / 1000, 0) AS x_corrected, y + coalesce(c_nationkey / 10e0, 0) AS y_corrected, c_custkey IS NOT NULL AS corrected
  FROM ps LEFT JOIN customer ON c_custkey = fov_id AND c_custkey % 4 <> 0""")
def _(spark, d):
    dr = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(
        F.col("c_custkey").alias("fov_id"), (F.col("c_acctbal") / 1000).alias("drift_x"), (F.col("c_nationkey") / 10.0).alias("drift_y"))
    return J.apply_drift(positions(spark, d), dr)


@query("J28_reconstruct_frame_table", """SELECT CAST(o_orderkey AS INTEGER) AS frame, CASE WHEN o_orderstatus <> 'P' THEN [405e0, 488e0, 560e0][o_orderkey % 3 + 1] END AS color, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 3 AS INTEGER) END AS channel, o_orderkey * 0.5e0 AS z FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    z = o.select(k.cast("int").alias("frame"), (k * 0.5).alias("z"))
    ev = o.where("o_orderstatus <> 'P'").select((k + 0.25).alias("on"), (k % 3).cast("int").alias("channel"))
    return J.reconstruct_frame_table(z, ev, {0: 405, 1: 488, 2: 560})


CH = """so AS (SELECT c_custkey AS path, c_custkey % 13 <> 0 AS exists, 20 AS n_frames FROM customer), ck AS (SELECT o_custkey AS path, o_orderkey % 10 AS i, 1000 - o_orderkey % 4 AS size, CASE WHEN o_orderkey % 50 <> 0 THEN 998 END AS declared FROM orders),
  cc AS (SELECT path, i, max(size) AS size, max(declared) AS declared FROM ck WHERE i < 5 GROUP BY ALL),
  cg AS (SELECT path, count(*) AS have, count(*) FILTER (WHERE declared IS NULL OR size < declared) AS short FROM cc GROUP BY path)"""


@query("J29_chunk_completeness", f"""WITH {CH} SELECT path, exists, CASE WHEN exists THEN CAST(5 - coalesce(have, 0) AS BIGINT) END AS n_missing_chunks, CASE WHEN exists THEN coalesce(short, 0) END AS n_truncated_chunks,
  CASE WHEN NOT exists THEN 'missing_file' WHEN coalesce(have, 0) < 5 THEN 'missing_chunks' WHEN coalesce(short, 0) > 0 THEN 'truncated_chunks' ELSE 'ok' END AS status FROM so LEFT JOIN cg USING (path)""")
def _(spark, d):
    k = F.col("o_orderkey")
    so = table(spark, d, "customer").select(
        F.col("c_custkey").alias("path"), (F.col("c_custkey") % 13 != 0).alias("exists"), F.lit(20).alias("n_frames"), F.lit(4).alias("chunk_frames"), F.lit(1).alias("chunks_per_frame"))
    ck = table(spark, d, "orders").select(
        F.col("o_custkey").alias("path"), (k % 10).alias("i"), (1000 - k % 4).alias("size"), F.when(k % 50 != 0, 998).alias("declared_size"))
    return J.chunk_completeness(so, ck)


@query("J30_left_antijoin_pending", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.pending_inputs(table(spark, d, "customer").select("c_custkey"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["c_custkey"])


@query("J30_input_counts", """WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
  SELECT count(*) FILTER (WHERE p.k IS NOT NULL) AS cached, count(*) FILTER (WHERE p.k IS NULL AND f.k IS NOT NULL) AS to_compute, count(*) FILTER (WHERE p.k IS NULL AND f.k IS NULL) AS not_imaged FROM customer LEFT JOIN f ON f.k = c_custkey LEFT JOIN p ON p.k = c_custkey""")
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.input_counts(table(spark, d, "customer"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["c_custkey"])
