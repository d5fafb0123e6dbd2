"""Edge rules of counters, windows, positions, joins and aggregates on literal tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelight.functions import scalar as S
from stagelight.operators import aggregate as A
from stagelight.operators import counters as C
from stagelight.operators import joins as J
from stagelight.operators import pixels as X
from stagelight.operators import positions as G
from stagelight.operators import select as P
from stagelight.operators import windows as W


def counter(spark, values, key=1):
    return C.exact_counter(spark.createDataFrame([(key, int(v)) for v in values], "k int, value int"), ["k"])


@pytest.mark.parametrize("values", [[7], [5, 5, 5], [0, 65535], [1, 2, 3, 4, 10], [0, 0, 1, 65535, 65535, 9]])
def test_frame_stats(spark, values):
    r = C.frame_stats(counter(spark, values), ["k"]).first()
    v = np.array(values, float)
    want = [v.min(), v.max(), v.mean(), np.median(v), v.std(), *np.percentile(v, [1, 99])]
    assert [r["min"], r["max"], r["mean"], r["median"], r["std"], r["p01"], r["p99"]] == pytest.approx(want)


def test_histogram_edges(spark):
    c = counter(spark, [0, 127, 128, 65535])
    h = {r.bin: r.n for r in C.fixed_histogram(c, ["k"]).where("n > 0").collect()}
    assert h == {0: 2, 1: 1, 511: 1}
    h = {r.bin: r.n for r in C.fixed_histogram(counter(spark, [0, 1, 9, 10, 11]), ["k"], 3, 0, 10).collect()}
    assert h == {0: 2, 1: 0, 2: 2}  # the right edge belongs to the last bin, 11 is outside


def test_counter_percentile_on_boundary(spark):
    r = C.counter_percentiles(counter(spark, [1, 2, 3, 4]), ["k"], {"q": 50.0, "a": 0.0, "z": 100.0}).first()
    assert (r.q, r.a, r.z) == (2, 1, 4)


@pytest.mark.parametrize("tpc, want", [
    ([0, 0, 0], (None, None, True)), ([0, 5, 6], (2.0, 3.0, True)), ([5, 0, 6], (1.0, 3.0, False)), ([0, 5, 0], (2.0, 2.0, True)), ([2, 2, 3], (3.0, 3.0, True))])
def test_signal_extent(spark, tpc, want):
    df = spark.createDataFrame([(1, float(i + 1), t) for i, t in enumerate(tpc)], "k int, z double, tpc int")
    assert tuple(C.signal_extent(df, ["k"], 2).first())[1:] == want


@pytest.mark.parametrize("profile", [[5.0] * 10, [9, 1, 1, 1, 1, 1, 1, 1, 1, 1], [9, 5, 1, 1, 1], [1, 9, 5, 1.0, 1, 1, 1, 1, 1, 1, 1, 1], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3]])
def test_detect_plateau(spark, profile):
    p = np.array(profile, float)
    rng, peak = p.max() - p.min(), int(p.argmax())
    if rng <= 0:
        want = peak
    else:
        ok = (np.abs(np.gradient(p)) / rng < 0.01) & ((p - p.min()) / rng < 0.15)
        want = next((i for i in range(peak, len(p) - 7) if ok[i:i + 8].all()), None)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(p)], "k int, z int, v double")
    assert W.detect_plateau(df, ["k"], "z", "v").first().plateau_idx == want


def test_split_on_gap_with_mad_zero(spark):
    pts = [(float(i), 0.0) for i in range(6)] + [(100.0 + i, 0.0) for i in range(2)] + [(300.0 + i, 0.0) for i in range(4)]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "k int, i int, x double, y double")
    got = sorted((r.i, r.part) for r in W.split_on_gap(df, ["k"], "i").collect())
    # all small steps are equal, so the spread falls back to the standard deviation of the steps
    d = np.hypot(*np.diff(np.array(pts), axis=0).T)
    cut = np.r_[0, (0.6745 * (d - np.median(d)) / d.std() > 3.5).cumsum()]
    keep = [p for p in set(cut) if (cut == p).sum() >= 3]
    assert got == [(i, int(p)) for i, p in enumerate(cut) if p in keep]


def test_quantile_tiers_duplicate_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0, None])], "fov int, v double")
    got = {r.fov: (r.tier, r.tier_depth) for r in W.quantile_tiers(df, "v", 3).collect()}
    edges = np.unique(np.quantile([1, 1, 1, 2, 3], np.linspace(0, 1, 4)))
    for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0]):
        assert got[i][0] == max(int((edges < v).sum()) - 1, 0)
    assert got[5][0] == 0


@pytest.mark.parametrize("connectivity", ["4", "8"])
def test_exterior(spark, connectivity):
    grid = {(i, j) for i in range(5) for j in range(5)} - {(2, 2)}
    pos = spark.createDataFrame([(10 * i + j, 100.0 * i, 100.0 * j) for i, j in grid], "fov_id long, x double, y double")
    got = {r.fov_id: r.exterior for r in G.exterior_split(pos, 100, connectivity).collect()}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == "8" else [])
    assert got == {10 * i + j: any((i + a, j + b) not in grid for a, b in steps) for i, j in grid}


def test_grid_neighbour_tolerance(spark):
    pos = spark.createDataFrame([(0, 0.0, 0.0), (1, 125.0, 0.0), (2, 0.0, 126.0)], "fov_id long, x double, y double")
    got = {(r.fov_id, r.direction): r.neighbour for r in G.grid_neighbours(pos, 100).collect()}
    assert got[(0, "right")] == 1 and got[(0, "up")] is None  # exactly the tolerance is present, beyond is not


def test_first_complete_block(spark):
    pos = spark.createDataFrame([(10 * i + j, 50.0 * j, 50.0 * i) for i in range(4) for j in range(4)], "fov_id long, x double, y double")
    r = G.first_complete_block(pos, 50).first()
    assert (r.center, r.up, r.down, r.left, r.right, r.up_left, r.down_right) == (11, 21, 1, 10, 12, 20, 2)


def test_translation_vote(spark):
    rng = np.random.default_rng(5)
    src = rng.integers(0, 400, (60, 2))
    tgt = np.r_[src[:45] - (11, -7), rng.integers(0, 400, (15, 2))]
    df = lambda p: spark.createDataFrame([(1, int(a), int(b)) for a, b in p], "fov int, row int, col int")
    r = G.translation_vote(df(src), df(tgt), ["fov"], max_shift=100).first()
    d = (src[:, None] - tgt[None]).reshape(-1, 2)
    d = d[(np.abs(d) <= 100).all(1)]
    h, ye, xe = np.histogram2d(d[:, 0], d[:, 1], bins=50, range=[[-100, 100]] * 2)
    i, j = np.unravel_index(h.argmax(), h.shape)
    near = d[(np.abs(d[:, 0] - (ye[i] + 2)) < 8) & (np.abs(d[:, 1] - (xe[j] + 2)) < 8)]
    assert (r.dy, r.dx, r.n_inliers) == (pytest.approx(near[:, 0].mean()), pytest.approx(near[:, 1].mean()), len(near))
    none = G.translation_vote(df(src), df(tgt).where("fov < 0"), ["fov"], max_shift=100).first()
    assert none.dy is None and none.score == 0


def test_match_channels_strict_tolerance(spark):
    df = spark.createDataFrame([(560, 0, 0.0, 0.0, 1.0), (405, 1, 3.0, 0.0, 2.0), (560, 2, 50.0, 0.0, 1.0), (405, 3, 52.0, 0.0, 2.0)],
                               "color int, spot_id long, x_px double, y_px double, z_um double")
    assert [r.ref_id for r in G.match_channels(df, 560, [405, 560], 3.0, 1.0).collect()] == [2]


def test_asof_and_nearest(spark):
    rows = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 11), ("a", 4.0, 12), ("b", 9.0, 20)], "g string, z double, frame int")
    t = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 3.0), ("a", 99.0), ("b", 1.0), ("c", 1.0)], "g string, t double")
    floor = {(r.g, r.t): r.frame for r in J.asof_floor(t, rows, ["g"], "t", "z", "frame").collect()}
    assert floor == {("a", 0.5): 10, ("a", 2.0): 11, ("a", 3.0): 11, ("a", 99.0): 12, ("b", 1.0): 20, ("c", 1.0): None}
    near = {(r.g, r.t): r.frame for r in J.nearest_1d(t, rows, ["g"], "t", "z", "frame").collect()}
    assert near == {("a", 0.5): 10, ("a", 2.0): 11, ("a", 3.0): 11, ("a", 99.0): 12, ("b", 1.0): 20, ("c", 1.0): None}


def test_any_pattern_meets_its_files(spark):
    """Digits beside a placeholder, other placeholders, special characters, none at all: as the regular expression says."""
    import re

    patterns = ["A1{fov}2", "A{fov}", "r{round:02d}_{fov:03d}.x", "{fov}", "h-+({fov})", "plain", "7", "{a}{fov}", "k#{fov}", "{well}-x"]
    names = ["A112", "A1342", "A12", "A1", "r07_0033.x", "r7_3.x", "r_3.x", "0012", "7", "h-+(5)", "h-+()", "plain", "plain2", "k#4", "k4", "33-x", "", "A1x2", "r07_0033yx"]
    series = spark.createDataFrame([(i, p, i) for i, p in enumerate(patterns)], "round_id int, series string, ord int")
    got = {r.path: (r.series, r.fov_id) for r in J.classify_files(spark.createDataFrame([(f"d/{n}.dax",) for n in names], "path string"), series).collect()}
    for name in names:
        want = (None, None)
        for p in patterns:
            parts = re.split(r"\{([^}:]*)[^}]*\}", p)
            m = re.fullmatch("".join(f"(?P<{x}>[0-9]+)" if i % 2 else re.escape(x) for i, x in enumerate(parts)), name)
            if m:
                want = (p, int(m.groupdict()["fov"]) if "fov" in m.groupdict() else None)
                break
        assert got[f"d/{name}.dax"] == want, name
    rounds = spark.createDataFrame([(1, "A1{fov}2", ["d"]), (2, "whole", ["d"])], "round_id int, series string, dirs array<string>")
    inv = spark.createDataFrame([("d", "A1052.dax"), ("d", "A132.tif"), ("d", "whole.dax")], "dir string, name string")
    found = {(r.round_id, r.fov_id): (r.path, r.exists) for r in J.resolve_expected_files(rounds, spark.createDataFrame([(5,), (3,)], "fov_id long"), inv).collect()}
    assert found == {(1, 5): ("d/A1052.dax", True), (1, 3): ("d/A132.dax", False), (2, 5): ("d/whole.dax", True), (2, 3): ("d/whole.dax", True)}


def test_resolve_expected_files(spark):
    rounds = spark.createDataFrame([(1, "h_{fov:03d}", ["d1", "d2"])], "round_id int, series string, dirs array<string>")
    pos = spark.createDataFrame([(0,), (1,), (2,), (3,)], "fov_id long")
    inv = spark.createDataFrame([("d1", "h_0000.dax"), ("d2", "h_000.dax"), ("d2", "h_001.dax"), ("d1", "h_02.dax")], "dir string, name string")
    got = {r.fov_id: (r.path, r.exists) for r in J.resolve_expected_files(rounds, pos, inv).collect()}
    # exact names win over another width in an earlier folder; nothing anywhere gives the primary path
    assert got == {0: ("d2/h_000.dax", True), 1: ("d2/h_001.dax", True), 2: ("d1/h_02.dax", True), 3: ("d1/h_003.dax", False)}


def test_reference_consistency(spark):
    steps = spark.createDataFrame([("valve", "Set Hyb ", "p1", 0), ("valve", "Set Hyb ", "p2", 1), ("pump", "Go", "p1", 2), ("valve", "Set A", "p1", 3)], "kind string, name string, protocol string, pos int")
    cmds = spark.createDataFrame([("valve", "Set Hyb", 0), ("valve", "Set A", 1)], "kind string, name string, pos int")
    got = sorted((r.kind, r.name, r.protocol, r.pos, r.n, r.suggestion, r.normalized_match) for r in J.reference_consistency(steps, cmds).collect())
    assert got == [("pump", "Go", "p1", 2, 1, None, False), ("valve", "Set Hyb ", "p1", 0, 1, "Set Hyb", True), ("valve", "Set Hyb ", "p2", 1, 1, "Set Hyb", True)]


def test_last_flowed_valve(spark):
    s = spark.createDataFrame([("p", 0, "valve", "A"), ("p", 1, "pump", "x"), ("p", 2, "valve", "B"), ("q", 0, "valve", "C"), ("r", 0, "pump", "x")], "protocol string, pos int, kind string, name string")
    assert {r.protocol: r.valve for r in J.last_flowed_valve(s).collect()} == {"p": "A", "q": None, "r": None}


def test_smallest_superset(spark):
    need = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "z")], "r int, c string")
    have = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c"), ("w", "c"), ("v", "c")], "cfg string, c string")
    assert {r.r: (r.cfg, r.status) for r in J.smallest_superset(need, have, "r", "cfg", "c").collect()} == {1: ("x", "ok"), 2: (None, "tie"), 3: (None, "none")}


def test_mad_outliers(spark):
    df = spark.createDataFrame([(g, v) for g, vs in {"z": [0.0] * 5 + [1.0], "o": [1.0, 2.0, 3.0, 2.0, 90.0], "s": [1.0, 99.0]}.items() for v in vs], "g string, v double")
    got = {(r.g, r.v): r.kept for r in A.mad_outliers(df, "v", keys=["g"]).collect()}
    assert got[("z", 0.0)] and not got[("z", 1.0)] and not got[("o", 90.0)] and got[("o", 3.0)] and got[("s", 99.0)]


def test_fit_affine_needs_three(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 1.0, 0.0)], "x double, y double, u double, v double")
    with pytest.raises(Exception, match="at least 3"):
        A.fit_affine(df).collect()


def test_orientation_round_trip(spark):
    px = spark.createDataFrame([(r, c, 10 * r + c) for r in range(2) for c in range(3)], "r int, c int, v int")
    img = np.array([[0, 1, 2], [10, 11, 12]])
    as_array = lambda df, h, w: np.array([x.v for x in df.orderBy("r", "c").collect()]).reshape(h, w)
    for t in (False, True):
        for fh in (False, True):
            for fv in (False, True):
                want = img.T if t else img
                want = want[:, ::-1] if fh else want
                want = want[::-1] if fv else want
                assert (as_array(X.orient(px, 2, 3, transpose=t, flip_horizontal=fh, flip_vertical=fv), *want.shape) == want).all()
    for name, fn in {"rot90": np.rot90, "rot180": lambda a: np.rot90(a, 2), "rot270": lambda a: np.rot90(a, 3), "fliplr": np.fliplr, "flipud": np.flipud}.items():
        want = fn(img)
        assert (as_array(X.orient_named(px, 2, 3, name), *want.shape) == want).all(), name
    with pytest.raises(ValueError):
        X.orient_named(px, 2, 3, "sideways")


def test_block_mean_pads_with_zero(spark):
    px = spark.createDataFrame([(r, c, 4.0) for r in range(5) for c in range(5)], "r int, c int, v double")
    got = {(x.r, x.c): x.v for x in X.block_mean(px, [], 2).collect()}
    assert got[(0, 0)] == 4.0 and got[(2, 0)] == 2.0 and got[(2, 2)] == 1.0


def test_mid_z_and_masks(spark):
    ft = spark.createDataFrame([(0, 488.0, 0.0), (1, 560.0, 1.0), (2, 650.0, 1.0), (3, 560.0, 2.0), (4, None, 2.0)], "frame int, color double, z double").withColumn("k", F.lit(1))
    assert sorted((r.color, r.frame) for r in P.mid_z_frames(ft, ["k"]).collect()) == [(560.0, 1), (650.0, 2)]
    assert P.mid_z_frames(ft.where("frame < 0"), ["k"]).count() == 0


def test_strict_bool_and_channels_raise(spark):
    df = spark.createDataFrame([("yes",)], "s string")
    with pytest.raises(Exception, match="not a boolean"):
        df.select(S.strict_bool("s")).collect()
    with pytest.raises(Exception, match="no channel"):
        spark.createDataFrame([(999.0,)], "c double").select(S.channel_map("c", S.CHANNELS["ST2"])).collect()
    assert spark.range(1).select(S.power_list({405: 0.5, 650.0: 0.2}, S.CHANNELS["ST2"])).first()[0] == [0.2, 1.0, 1.0, 0.5]


def test_durations_and_bytes(spark):
    df = spark.createDataFrame([(None,), (0.5,), (59.5,), (61.0,), (3601.4,), (90061.0,)], "s double")
    got = [tuple(r) for r in df.select(S.format_duration("s"), S.format_day_duration("s")).collect()]
    assert got[1:] == [("0s", "0s"), ("1m 0s", "0d, 0h, 1m"), ("1m 1s", "0d, 0h, 1m"), ("1h 0m 1s", "0d, 1h, 0m"), ("25h 1m 1s", "1d, 1h, 1m")] and got[0][0] == "n/a"
    b = spark.createDataFrame([(1023,), (1536,), (5 * 1024**4,), (5000 * 1024**4,)], "n long").select(S.format_bytes("n")).collect()
    assert [r[0] for r in b] == ["1023 B", "1.5 KiB", "5.0 TiB", "5000.0 TiB"]


def test_series_regex(spark):
    import re

    assert re.match(S.series_regex("hal-m.f_{fov:03d}_00"), "hal-m.f_12_00").group(1) == "12"
    assert re.match(S.series_regex("hal-m.f_{fov:03d}_00"), "hal-mxf_12_00") is None
    df = spark.createDataFrame([("hal-mf3_01_{fov:03d}",), ("hal_cells_{fov:03d}",)], "p string")
    assert [r[0] for r in df.select(S.series_stem("p")).collect()] == ["hal-mf3", "hal_cells"]


def test_holes_may_overlap_or_repeat(spark):
    from stagelight.operators.coverage import coverage_filter, disjoint_parts

    area = lambda q: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, [*q[1:], q[0]]))) / 2
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    assert abs(sum(map(area, disjoint_parts([square(0, 0, 10), square(5, 5, 10), square(0, 0, 10), square(2, 2, 3)]))) - 175) < 1e-9
    assert abs(sum(map(area, disjoint_parts([[(0, 0), (4, 4), (0, 8)], [(4, 0), (4, 8), (0, 4)]]))) - 24) < 1e-9
    fovs = spark.createDataFrame([(0, 5.0, 5.0), (1, 12.0, 5.0), (2, 50.0, 50.0)], "fov_id int, x double, y double")
    ring, hole = square(0, 0, 100), square(0, 0, 9)
    ids = lambda holes, f: sorted(r.fov_id for r in coverage_filter(fovs, ring, holes, 10.0, f).collect())
    assert ids([hole], 0.15) == ids([hole, hole, hole], 0.15) == [0, 1, 2]
    assert ids([square(0, 0, 6), square(4, 0, 6), square(0, 4, 6), square(4, 4, 6)], 0.0) == [1, 2]


def test_quantiles_and_mad_of_small_and_large_groups(spark):
    """Ranks from the sketch are exact for every size, with copies, ties, far values and a NULL key; the folded sketch encloses the MAD."""
    from stagelight.operators.quantile import exact_quantiles, median_and_mad

    rng = np.random.default_rng(31)
    groups = {k: rng.normal(0, 1, n) for k, n in enumerate((1, 2, 3, 4, 7, 50, 999, 5001, 9001))}
    groups |= {20: rng.lognormal(0, 3, 40_000), 21: np.repeat([1.0, 2.0, 5.0], (30_000, 3, 9_000)), 22: np.concatenate([rng.integers(0, 9, 20_000) * 1.0, [1e300, -1e300]]), None: rng.uniform(0, 1, 12_345)}
    rows = pd.DataFrame({"k": np.repeat([-1 if k is None else k for k in groups], [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))})
    df = spark.createDataFrame(rows).withColumn("k", F.when(F.col("k") >= 0, F.col("k"))).repartition(16)
    df = df.union(df.limit(1).select(F.lit(77).cast("long"), F.lit(None).cast("double")))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    low = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, method="discrete").collect()}
    mad = {r.k: r for r in median_and_mad(df, ["k"], "v").collect()}
    assert got.keys() == low.keys() == mad.keys() == groups.keys()
    for k, v in groups.items():
        assert [got[k][c] for c in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12)
        assert [low[k][c] for c in probs] == list(np.quantile(v, list(probs.values()), method="inverted_cdf"))
        assert (mad[k]._med, mad[k]._mad) == pytest.approx((np.median(v), np.median(np.abs(v - np.median(v)))), rel=1e-12)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    every = np.concatenate(list(groups.values()))
    assert whole.m == pytest.approx(np.median(every)) and median_and_mad(df, [], "v").first()._mad == pytest.approx(np.median(np.abs(every - np.median(every))))
    assert exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()[0].m is None and exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_consistency_within_a_radius_is_that_of_the_listed_graphs(spark):
    """Copies of points included; the edges themselves are listed here only."""
    from stagelight.operators.positions import consistent_within, graph_consistency
    from stagelight.operators.spatial import contact_edges, mutual_nearest

    rng = np.random.default_rng(5)
    cloud = lambda n, k: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (n, 2)))], f"{k} long, x double, y double")
    s, t = cloud(500, "src_id"), cloud(350, "tgt_id")
    pairs = mutual_nearest(s, t, 3)
    for share in (0.05, 0.1, 0.2):
        want = graph_consistency(pairs, contact_edges(s, 4, id="src_id"), contact_edges(t, 4, id="tgt_id"), share)
        got = consistent_within(pairs, s, t, 4, share)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
