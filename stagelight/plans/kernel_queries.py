"""Frame kernels, graph and coverage queries (embeddings as frames, 64 of them as one 64x64 image)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stagelight.operators import coverage as Q
from stagelight.operators import kernels as K
from stagelight.operators import positions as G
from stagelight.operators.clusters import touching_clusters
from stagelight.operators.model import fit_damage_model, score_windows
from stagelight.operators.pixels import explode_pixels_of
from stagelight.operators.solve import solve_positions
from stagelight.plans.aggregate_queries import rounded
from stagelight.plans.registry import query
from stagelight.plans.tables import CLOUD, IMG, PS, blur_sql, cloud, frames, images, mirrored_sql, positions, r6, table


def binary_frames(spark, d, spike: bool = False):
    """One 8x8 frame per embedding; with ``spike`` every third frame gets one hot pixel."""
    f = frames(spark, d)
    hot = F.transform("px", lambda v, i: F.when((i == 28) & (F.col("frame") % 3 == 0), v * 20).otherwise(v)) if spike else F.col("px")

    @F.pandas_udf("binary")
    def pack(px: pd.Series) -> pd.Series:
        return px.map(lambda a: np.asarray(a).astype("<u2").tobytes())

    return f.select("frame", "grp", "h", "w", pack(hot).alias("pixels"))


def big_images(spark, d, roll: tuple[int, int] = (0, 0), planes: bool = False):
    """64 frames in frame order as the 8x8 tiles of one 64x64 image; a missing tile is flat."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.full((64, 64), 1000, dtype=np.uint16)
        for f, px in zip(pdf["frame"], pdf["px"]):
            r, c = divmod(int(f) % 64, 8)
            img[8 * r:8 * r + 8, 8 * c:8 * c + 8] = np.asarray(px).reshape(8, 8)
        img = np.roll(img, roll, (0, 1))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "h": [64], "w": [64], "pixels": [img.astype("<u2").tobytes()]})

    f = frames(spark, d).select(F.floor(F.col("frame") / 64).alias("image"), "frame", "px")
    return f.groupBy("image").applyInPandas(build, "image LONG, h INT, w INT, pixels BINARY")


@query("K1_frame_analysis", f"""WITH {IMG} SELECT frame, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std,
  round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.99), 6) AS p99, count(*) FILTER (WHERE v // 128 = 7) AS bin7, 16 AS thumbnail_bytes FROM img GROUP BY frame""")
def _(spark, d):
    a = K.analyse_frames(binary_frames(spark, d), ["frame"], size=(4, 4))
    return a.select("frame", "min", "max", *[r6(c).alias(c) for c in ("mean", "median", "std", "p01", "p99")],
                    F.col("hist")[7].alias("bin7"), F.octet_length("thumbnail").alias("thumbnail_bytes"))


@query("K1_thumbnails")
def _(spark, d):
    return K.analyse_frames(big_images(spark, d), ["image"], size=(20, 20)).select("image", F.hex("thumbnail").alias("thumbnail"))


def spots_sql(src: str, key: str, n: int, reach: int, sigmas: float) -> str:
    """Spots of n x n images ``src`` (key, r, c, v): tops of windows that reach so far, above the background of the blurred image."""
    return f"""{blur_sql(src, key, n, 1.5)}, cut AS (SELECT {key}, quantile_cont(v, 0.8) AS top FROM bl GROUP BY ALL),
  dark AS (SELECT {key}, median(v) FILTER (v < top) AS med, stddev_pop(v) FILTER (v < top) AS std, median(v) AS whole FROM bl JOIN cut USING ({key}) GROUP BY ALL),
  lvl AS (SELECT {key}, coalesce(med, whole) AS med, coalesce(std, 1) AS std FROM dark),
  cand AS (SELECT bl.*, med FROM bl JOIN lvl USING ({key}) WHERE v > med + {sigmas}e0 * std),
  peak AS (SELECT a.{key}, a.r, a.c, any_value(med) AS med FROM cand a CROSS JOIN range({-reach}, {reach + 1}) p(i) CROSS JOIN range({-reach}, {reach + 1}) q(j)
    JOIN bl b ON b.{key} = a.{key} AND b.r = {mirrored_sql("a.r + i", n)} AND b.c = {mirrored_sql("a.c + j", n)} GROUP BY ALL HAVING max(b.v) <= any_value(a.v))
  SELECT {key}, CAST(r AS INTEGER) AS row_px, CAST(c AS INTEGER) AS col_px, round(v - med, 6) AS intensity FROM peak JOIN {src} USING ({key}, r, c)"""


BIG = f"""{IMG}, tile AS (SELECT frame // 64 AS image, CAST(8 * (frame % 64 // 8) + r AS BIGINT) AS r, CAST(8 * (frame % 8) + c AS BIGINT) AS c, v FROM img),
  big AS (SELECT image, y.r, x.c, coalesce(v, 1000) AS v FROM (SELECT DISTINCT image FROM tile) CROSS JOIN range(64) y(r) CROSS JOIN range(64) x(c) LEFT JOIN tile USING (image, r, c))"""


@query("K2_detect_spots", f"WITH {BIG}, {spots_sql('big', 'image', 64, 2, 1.5)}")
def _(spark, d):
    return rounded(K.detect_spots(big_images(spark, d), ["image"], 5, 1.5), {"intensity"})


@query("K2_detect_spots_projected", f"WITH {IMG}, pj AS (SELECT grp, r, c, max(v) AS v FROM img GROUP BY ALL), {spots_sql('pj', 'grp', 8, 1, 0.5)}")
def _(spark, d):
    p = K.max_project(binary_frames(spark, d), ["grp"])
    return rounded(K.detect_spots(p, ["grp"], 3, 0.5), {"intensity"})


HOT = f"""{IMG}, hp AS (SELECT frame, r, c, CASE WHEN r = 3 AND c = 4 AND frame % 3 = 0 THEN v * 20 ELSE v END AS v FROM img),
  lm AS (SELECT a.frame, a.r, a.c, any_value(a.v) AS v, median(b.v) AS m FROM hp a, range(-1, 2) p(i), range(-1, 2) q(j) JOIN hp b ON b.frame = a.frame AND b.r = least(greatest(a.r + i, 0), 7) AND b.c = least(greatest(a.c + j, 0), 7) GROUP BY a.frame, a.r, a.c),
  md AS (SELECT frame, median(v - m) AS me FROM lm GROUP BY frame), ns AS (SELECT frame, 1.4826e0 * median(abs(v - m - me)) AS s FROM lm JOIN md USING (frame) GROUP BY frame)"""


@query("K3_remove_hot_pixels", f"""WITH {HOT} SELECT frame, r, c, CAST(CASE WHEN v > 5 * greatest(m, 1) AND v - m > 5 * s THEN floor(m) ELSE v END AS INTEGER) AS v FROM lm JOIN ns USING (frame)""")
def _(spark, d):
    return explode_pixels_of(K.remove_hot_pixels(binary_frames(spark, d, spike=True), ["frame"]), ["frame"])


@query("K4_phase_shift", """SELECT DISTINCT vec_id // 64 AS image, -2e0 AS dy_px, 3e0 AS dx_px, 0.3e0 AS drift_x_um, -0.2e0 AS drift_y_um FROM embeddings""")
def _(spark, d):
    ref, mov = big_images(spark, d), big_images(spark, d, roll=(2, -3))
    pair = ref.select("image", F.col("h").alias("ah"), F.col("w").alias("aw"), F.col("pixels").alias("apx")).join(
        mov.select("image", F.col("h").alias("bh"), F.col("w").alias("bw"), F.col("pixels").alias("bpx")), "image")
    return rounded(K.fov_drift(pair, ["image"], 0.1).drop("error"), {"dy_px", "dx_px", "drift_x_um", "drift_y_um"})


@query("K5_bead_drift")
def _(spark, d):
    v = K.bead_drift(big_images(spark, d), big_images(spark, d, roll=(2, -3)), ["image"], 0.1, min_dist=3, sigmas=1.0, max_shift=16)
    return rounded(v, {"dy", "dx", "score", "drift_x_um", "drift_y_um"})


@query("K6_laplacian_texture", f"""WITH {IMG}, {blur_sql('img', 'frame', 8, 1.0)}, la AS (SELECT a.frame, a.r, a.c, sum(b.v) - 4 * any_value(a.v) AS v FROM bl a CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(i, j)
  JOIN bl b ON b.frame = a.frame AND b.r = {mirrored_sql("a.r + i", 8)} AND b.c = {mirrored_sql("a.c + j", 8)} GROUP BY ALL) SELECT frame, round(var_pop(v), 6) AS texture FROM la GROUP BY frame""")
def _(spark, d):
    return rounded(K.laplacian_texture(binary_frames(spark, d), ["frame"]), {"texture"})


#: Pixels between neighbours of the test grid, and of a side of its frames: half of each frame is shared.
PITCH, SIDE = 24, 48


def textured_frames(spark, d):
    """Frames of one fixed world of random pixels; each stands up to two whole pixels off its nominal place."""
    k, px = F.col("fov_id"), 200.0 / PITCH
    p = positions(spark, d).select("fov_id", (F.round(F.col("x") / px) + k * 37 % 5 - 2).cast("long").alias("c0"), (F.round(F.col("y") / px) + k * 53 % 5 - 2).cast("long").alias("r0"))
    level = lambda i: F.pmod(F.xxhash64(F.col("r0") + F.floor(i / SIDE), F.col("c0") + i % SIDE), F.lit(4096))
    values = p.select(k.alias("frame"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SIDE * SIDE - 1).cast("long")), level).alias("px"))

    @F.pandas_udf("binary")
    def pack(px: pd.Series) -> pd.Series:
        return px.map(lambda a: np.asarray(a).astype("<u2").tobytes())

    return values.select("frame", "h", "w", pack("px").alias("pixels"))


@query("K7_neighbour_registration", f"""WITH {PS}, j AS (SELECT *, fov_id * 37 % 5 AS jx, fov_id * 53 % 5 AS jy FROM ps)
  SELECT a.fov_id AS anchor, b.fov_id AS neighbour, CASE WHEN b.x > a.x THEN 'right' WHEN b.x < a.x THEN 'left' WHEN b.y > a.y THEN 'up' ELSE 'down' END AS direction,
  round(b.x + (b.jx - a.jx) * 200e0 / {PITCH}, 6) AS measured_x, round(b.y + (b.jy - a.jy) * 200e0 / {PITCH}, 6) AS measured_y FROM j a JOIN j b ON abs(a.x - b.x) + abs(a.y - b.y) = 200""")
def _(spark, d):
    p = positions(spark, d)
    nb = G.grid_neighbours(p, 200).where("neighbour is not null").select(F.col("fov_id").alias("anchor"), "direction", "neighbour")
    b = p.select(F.col("fov_id").alias("neighbour"), F.col("x").alias("bx0"), F.col("y").alias("by0"))
    m = K.neighbour_registration(nb.join(b, "neighbour"), textured_frames(spark, d), ["anchor", "neighbour", "direction"], 0.5, 200.0 / PITCH)
    return rounded(m, {"measured_x", "measured_y"}).drop("error")


@query("K8_localize_3d")
def _(spark, d):
    f = binary_frames(spark, d).withColumn("stack", F.floor(F.col("frame") / 20)).withColumn("z", F.col("frame") % 20 * 0.5)
    return rounded(K.localize_3d(f, ["stack"], "z", 3, 4, 3, 0.2), {"x_px", "y_px", "z_um"})


@query("K10_fit_and_score_model")
def _(spark, d):
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(
        k.alias("window_id"), F.when(k % 13 != 0, F.col("p_size").cast("double")).alias("f1"), F.col("p_retailprice").alias("f2"),
        (k % 17).cast("double").alias("f3"), (F.col("p_size") + k % 7 > 28).cast("int").alias("damaged"))
    model = fit_damage_model(w, ["f1", "f2", "f3"], "damaged", rounds=5, rate=0.3)
    return rounded(score_windows(model, w).select("window_id", "p_damaged"), {"p_damaged"})


PAIRS = """jt AS (SELECT fov_id, x, y, x + (fov_id * 37 % 11 - 5) / 4e0 AS tx, y + (fov_id * 53 % 13 - 6) / 4e0 AS ty FROM ps),
  pa AS (SELECT a.fov_id AS anchor, b.fov_id AS neighbour FROM jt a JOIN jt b ON (b.x = a.x + 200 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 200)),
  pn AS (SELECT anchor FROM pa GROUP BY anchor ORDER BY count(*) DESC, anchor LIMIT 1)"""


def consistent_pairs(spark, d):
    """Neighbour measurements that agree with one set of true positions."""
    p = positions(spark, d)
    k = F.col("fov_id")
    t = p.select("fov_id", "x", "y", (F.col("x") + (k * 37 % 11 - 5) / 4.0).alias("tx"), (F.col("y") + (k * 53 % 13 - 6) / 4.0).alias("ty"))
    nb = G.grid_neighbours(p, 200, offsets={"right": (1, 0), "up": (0, 1)}).where("neighbour is not null").select(F.col("fov_id").alias("anchor"), "neighbour")
    a = t.select(F.col("fov_id").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("tx").alias("atx"), F.col("ty").alias("aty"))
    b = t.select(F.col("fov_id").alias("neighbour"), F.col("tx").alias("btx"), F.col("ty").alias("bty"))
    return nb.join(a, "anchor").join(b, "neighbour").select(
        "anchor", "neighbour", (F.col("ax") + F.col("btx") - F.col("atx")).alias("measured_x"), (F.col("ay") + F.col("bty") - F.col("aty")).alias("measured_y"))


@query("K11_solve_positions", f"""WITH {PS}, {PAIRS}, o AS (SELECT x - tx AS ox, y - ty AS oy FROM jt JOIN pn ON pn.anchor = jt.fov_id)
  SELECT fov_id, (SELECT min(fov_id) FROM jt) AS component, fov_id = (SELECT anchor FROM pn) AS pinned, round(tx + ox, 6) AS x, round(ty + oy, 6) AS y, 0.0::DOUBLE AS residual_rms FROM jt, o""")
def _(spark, d):
    solved, summary = solve_positions(consistent_pairs(spark, d), positions(spark, d))
    at = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return solved.select("fov_id", "component", "pinned", at("x"), at("y")).withColumn("residual_rms", F.round(summary.select("residual_rms").scalar(), 6) + 0.0)


@query("K12_connected_components", f"""WITH RECURSIVE {CLOUD}, ed AS (SELECT a.id AS a, b.id AS b FROM cloud a JOIN cloud b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400),
  re AS (SELECT a AS id, a AS node FROM ed UNION SELECT re.id, ed.b FROM re JOIN ed ON ed.a = re.node)
  SELECT id, min(node) AS component FROM re GROUP BY id""")
def _(spark, d):
    return touching_clusters(cloud(spark, d), 20)


def blob(spark, d, turned: bool = False):
    """Cells of an oblique ellipse filled by the point cloud; ``turned`` maps the points by a known similarity."""
    c = cloud(spark, d).where(F.pow((F.col("x") - 500) / 380, F.lit(2)) + F.pow((F.col("y") - 500) / 170, F.lit(2)) < 1)
    x, y = F.col("x"), F.col("y")
    if turned:
        a = np.radians(40.0)
        x, y = 1.2 * (np.cos(a) * F.col("x") - np.sin(a) * F.col("y")) + 900, 1.2 * (np.sin(a) * F.col("x") + np.cos(a) * F.col("y")) + 50
    return c.select(F.floor(y / 60).alias("r"), F.floor(x / 60).alias("c")).distinct()


@query("K14_transform_grid_search")
def _(spark, d):
    f = Q.fit_similarity(blob(spark, d), blob(spark, d, turned=True), 60.0)
    return rounded(f, {"angle", "scale", "tx", "ty", "iou"})


@query("K15_cell_morphology")
def _(spark, d):
    k = F.col("frame")
    canvas = images(spark, d).select((F.floor(k / 20) * 8 + F.col("r")).alias("r"), (k % 20 * 8 + F.col("c")).alias("c"), "v")
    return Q.segment_tissue(canvas, pixel_um=1.0, smooth_um=2, close_um=2, open_um=2, margin_um=1, min_tissue_um2=200, min_hole_um2=10, near_um=5)


@query("K16_coverage_redundancy", f"""WITH RECURSIVE {CLOUD}, fv AS (SELECT s_suppkey AS f, 20e0 * (s_suppkey * 37 % 53) AS x, 20e0 * (s_suppkey * 11 % 47) AS y FROM supplier),
  ce AS (SELECT DISTINCT CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c FROM cloud), cv AS (SELECT f, r * 100000 + c AS k FROM fv JOIN ce ON abs((r + 0.5) * 10 - y) <= 60 AND abs((c + 0.5) * 10 - x) <= 60),
  ct AS (SELECT k, count(*) AS n FROM cv GROUP BY k), al AS (SELECT DISTINCT f FROM cv JOIN ct USING (k) WHERE n = 1), de AS (SELECT f FROM fv ANTI JOIN al USING (f)),
  ds AS (SELECT f, row_number() OVER (ORDER BY f) AS i, ks, ns FROM de LEFT JOIN (SELECT f, list(k ORDER BY k) AS ks, list(n ORDER BY k) AS ns FROM cv JOIN ct USING (k) GROUP BY f) USING (f)),
  st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS gone UNION ALL
    SELECT i, CASE WHEN ok THEN list_concat(used, ks) ELSE used END, CASE WHEN ok THEN list_append(gone, f) ELSE gone END FROM (SELECT ds.i, f, used, gone, coalesce(ks, []) AS ks,
      coalesce(list_aggregate(list_transform(range(1, len(ks) + 1), lambda j: ns[j] - len(list_filter(used, lambda u: u = ks[j])) >= 2), 'bool_and'), true) AS ok FROM st JOIN ds ON ds.i = st.i + 1)),
  fin AS (SELECT arg_max(gone, i) AS gone FROM st)
  SELECT f AS fov_id, de.f IS NOT NULL AS detected, list_contains(gone, fv.f) AS removed FROM fv LEFT JOIN de USING (f), fin""")
def _(spark, d):
    k = F.col("s_suppkey")
    fovs = table(spark, d, "supplier").select(k.alias("fov_id"), (20.0 * (k * 37 % 53)).alias("x"), (20.0 * (k * 11 % 47)).alias("y"))
    tissue = cloud(spark, d).select(F.floor(F.col("y") / 10).alias("r"), F.floor(F.col("x") / 10).alias("c")).distinct()
    return Q.redundant_fovs(fovs, tissue, 120.0, 10.0)


@query("K16_uncovered_cells", f"""WITH {CLOUD}, fv AS (SELECT 20e0 * (s_suppkey * 37 % 53) AS x, 20e0 * (s_suppkey * 11 % 47) AS y FROM supplier), ce AS (SELECT DISTINCT CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c FROM cloud)
  SELECT r, c FROM ce WHERE NOT EXISTS (SELECT 1 FROM fv WHERE abs((r + 0.5) * 10 - fv.y) <= 60 AND abs((c + 0.5) * 10 - fv.x) <= 60)""")
def _(spark, d):
    k = F.col("s_suppkey")
    fovs = table(spark, d, "supplier").select(k.alias("fov_id"), (20.0 * (k * 37 % 53)).alias("x"), (20.0 * (k * 11 % 47)).alias("y"))
    tissue = cloud(spark, d).select(F.floor(F.col("y") / 10).alias("r"), F.floor(F.col("x") / 10).alias("c")).distinct()
    return Q.uncovered_cells(fovs, tissue, 120.0, 10.0)


CLIP = """cv AS (SELECT id, x, y, greatest(0, least(x + 50, 700) - greatest(x - 50, 100)) * greatest(0, least(y + 50, 800) - greatest(y - 50, 150)) AS a,
  greatest(0, least(x + 50, 400) - greatest(x - 50, 250)) * greatest(0, least(y + 50, 500) - greatest(y - 50, 300)) AS h FROM cloud)"""
BOUNDARY = [(100.0, 150.0), (700.0, 150.0), (700.0, 800.0), (100.0, 800.0)]
HOLE = [(250.0, 300.0), (250.0, 500.0), (400.0, 500.0), (400.0, 300.0)]


@query("J25_coverage_filter", f"WITH {CLOUD}, {CLIP} SELECT id FROM cv WHERE x + 50 >= 100 AND x - 50 <= 700 AND y + 50 >= 150 AND y - 50 <= 800 AND h < 10000")
def _(spark, d):
    return Q.coverage_filter(cloud(spark, d), BOUNDARY, [HOLE], 100.0).select("id")


@query("J25_coverage_fraction", f"WITH {CLOUD}, {CLIP} SELECT id FROM cv WHERE (a - h) / 10000 >= 0.35e0")
def _(spark, d):
    return Q.coverage_filter(cloud(spark, d), BOUNDARY, [HOLE], 100.0, min_fraction=0.35).select("id")
