"""Ordered scans, exact quantiles and spatial joins against brute force, with one group holding most rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelight.operators.quantile import attach, exact_quantiles
from stagelight.operators.scan import dense_index, ordered_scan
from stagelight.operators.spatial import contact_edges, mutual_nearest, nearest_within
from stagelight.operators.spatial_stats import median_nn_distance, nearest_other_distance


def skewed(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 8, n))
    t = rng.permutation(n).astype(float) ** 2  # uneven spacing: most rows share few buckets
    v = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 50, n))
    return pd.DataFrame({"k": key, "t": t, "i": np.arange(n), "v": v})


def test_ordered_scan_matches_pandas(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = ordered_scan(df, ["k"], ["t", "i"], lag={"p": "v"}, lead={"n": "i"}, running_sum={"s": "v"}, forward_fill={"f": "v"}, row_number="rn", n_buckets=16)
    got = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")
    want["p"], want["n"], want["f"], want["rn"] = g["v"].shift(1), g["i"].shift(-1), g["v"].ffill(), g.cumcount() + 1
    want["s"] = g["v"].transform(lambda x: x.fillna(0).cumsum().where(x.notna().cummax()))
    for c in ("p", "n", "s", "f", "rn"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_ordered_scan_without_keys_and_single_value(spark):
    df = spark.createDataFrame([(5.0, i) for i in range(10)], "t double, i int")
    assert [r.rn for r in ordered_scan(df, [], ["t", "i"], row_number="rn").orderBy("i").collect()] == list(range(1, 11))


def test_dense_index(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,), (None,)], "x double")
    assert sorted((r.x or -1, r.d) for r in dense_index(df, "x", "d").collect() if r.d is not None) == [(1.0, 0), (2.0, 1), (3.0, 2), (3.0, 2)]


@pytest.mark.parametrize("method", ["linear", "discrete"])
def test_exact_quantiles(spark, method):
    rng = np.random.default_rng(1)
    groups = {0: rng.lognormal(3, 2, 2000), 1: np.full(50, 7.5), 2: np.array([4.0]), 3: rng.integers(0, 5, 300).astype(float)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.937, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, method=method, n_bins=32).collect()}
    how = "linear" if method == "linear" else "inverted_cdf"
    for k, v in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p, method=how)), (k, name)


def test_exact_quantiles_weighted_and_empty(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1), (5.0, 0)], "v double, w int")
    assert exact_quantiles(df, [], "v", {"m": 0.5, "x": 1.0}, weight="w").first().asDict() == {"m": 1.0, "x": 10.0}
    assert exact_quantiles(df.where("v > 99"), [], "v", {"m": 0.5}).first().m is None
    assert exact_quantiles(df.where("v > 99"), ["w"], "v", {"m": 0.5}).count() == 0


def clouds(n=400, seed=3):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random((n, 2)) * 60) - 20  # many copies of a coordinate and equidistant ties
    t = np.round(rng.random((n, 2)) * 60) - 20
    s[: n // 3] = 5.0  # a third of the points are copies
    return s, t


def frame(spark, p, name):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(p)], f"{name} long, x double, y double")


@pytest.mark.parametrize("levels", [1, 3])
def test_nearest_within(spark, levels):
    s, t = clouds()
    got = nearest_within(frame(spark, s, "q"), frame(spark, t, "ref_id"), 4.0, levels=levels).collect()
    found = {(r.x, r.y): (r.ref_id, r.dist) for r in got}
    for x, y in {tuple(p) for p in s}:
        d = np.hypot(t[:, 0] - x, t[:, 1] - y)
        if d.min() <= 4.0:
            assert found[(x, y)] == (int(np.flatnonzero(d == d.min())[0]), pytest.approx(d.min()))
        else:
            assert (x, y) not in found


def test_contact_edges(spark):
    s, _ = clouds(150)
    got = {(r.a, r.b) for r in contact_edges(frame(spark, s, "id"), 3.0).collect()}
    d = np.hypot(*(s[:, None] - s[None]).transpose(2, 0, 1))
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 3.0}


def test_cells_of_contact_edges_are_not_put_together(spark):
    """Few bytes make many pairs: the join's tasks are not merged by the bytes they read (all cells were one task here)."""
    s, _ = clouds(150)
    assert contact_edges(frame(spark, s, "id"), 3.0).rdd.getNumPartitions() >= 64


def test_mutual_nearest_is_one_to_one(spark):
    s, t = clouds()
    got = mutual_nearest(frame(spark, s, "src_id"), frame(spark, t, "tgt_id"), 4.0).collect()
    assert len({r.src_id for r in got}) == len(got) == len({r.tgt_id for r in got})
    for r in got:
        d = np.hypot(*(t - s[r.src_id]).T)
        assert r.dist == pytest.approx(d.min()) and r.dist <= 4.0


def test_mutual_nearest_limits(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "src_id long, x double, y double")
    t = spark.createDataFrame([(7, 3.0, 4.0), (8, 106.0, 0.0)], "tgt_id long, x double, y double")
    assert [(r.src_id, r.tgt_id) for r in mutual_nearest(s, t, 5.0).collect()] == [(1, 7)]  # exactly the limit counts
    assert mutual_nearest(s, t.where("tgt_id < 0"), 5.0).count() == 0


def test_nearest_other_distance(spark):
    p = [(0, 0), (0, 0), (10, 0), (13, 0), (500, 500)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in p], "x double, y double")
    got = {(r.x, r.y): r.dist for r in nearest_other_distance(df, 4.0).collect()}
    assert got == {(0, 0): 0.0, (10, 0): 3.0, (13, 0): 3.0, (500, 500): math.hypot(487, 500)}


def test_median_distance_counts_lonely_points(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 100, 200, 300)], "x double, y double")
    assert median_nn_distance(df, 10.0).first().median_nn == 99.0


def test_null_keys_are_a_group(spark):
    rows = [(None, 1.0), (None, 3.0), (None, 8.0), ("a", 5.0), ("a", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 3.0, "a": 6.0}
    with_m = {(r.g, r.v): r.m for r in attach(df, exact_quantiles(df, ["g"], "v", {"m": 0.5}), ["g"]).collect()}
    assert with_m[(None, 8.0)] == 3.0 and len(with_m) == 5
    s = {(r.g, r.v): (r.before, r.total, r.rn) for r in ordered_scan(df, ["g"], ["v"], lag={"before": "v"}, running_sum={"total": "v"}, row_number="rn", n_buckets=3).collect()}
    assert s[(None, 8.0)] == (3.0, 12.0, 3) and s[(None, 1.0)] == (None, 1.0, 1) and s[("a", 7.0)] == (5.0, 12.0, 2)
    d = {(r.g, r.v): r.i for r in dense_index(df, "v", "i", ["g"]).collect()}
    assert d[(None, 3.0)] == 1 and d[("a", 5.0)] == 0


def test_search_starts_where_cells_are_few(spark, monkeypatch):
    """A full cluster and far points: no ring meets more than some points a cell, and distances are those of all pairs."""
    from stagelight.operators import spatial, spatial_stats

    rng = np.random.default_rng(21)
    pts = [*{(float(x), float(y)) for x, y in np.round(rng.normal(0, 1, (1500, 2)), 4)}, (900.0, 900.0), (-700.0, 40.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    first = []
    explode = spatial.explode_cells
    monkeypatch.setattr(spatial_stats, "explode_cells", lambda d, x, y, size, *a: first.append(size) or explode(d, x, y, size, *a))
    got = {(r.x, r.y): r.dist for r in nearest_other_distance(df, 25.0).collect()}
    xy = np.array(pts)
    d = np.hypot(*(xy[:, None] - xy[None]).T)
    np.fill_diagonal(d, np.inf)
    assert all(got[p] == pytest.approx(v) for p, v in zip(pts, d.min(0))) and len(got) == len(pts)
    assert np.unique(np.floor(xy / first[0]), axis=0, return_counts=True)[1].max() <= spatial.CELL_POINTS


def test_mutual_nearest_in_a_full_cluster(spark, monkeypatch):
    """The first level's cells hold few reference points, whatever the radius; pairs are those of all pairs."""
    from stagelight.operators import spatial

    rng = np.random.default_rng(22)
    s, t = (np.unique(np.round(rng.normal(0, 1, (700, 2)), 4), axis=0) for _ in range(2))
    df = lambda a, k: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], f"{k} long, x double, y double")
    sizes, explode = [], spatial.explode_cells
    monkeypatch.setattr(spatial, "explode_cells", lambda d, x, y, size, *a: sizes.append(size) or explode(d, x, y, size, *a))
    got = {(r.src_id, r.tgt_id) for r in mutual_nearest(df(s, "src_id"), df(t, "tgt_id"), 30.0).collect()}
    d = np.hypot(*(s[:, None] - t[None]).transpose(2, 0, 1))
    assert got == {(i, int(j)) for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i}
    assert max(np.unique(np.floor(a / min(sizes)), axis=0, return_counts=True)[1].max() for a in (s, t)) <= spatial.CELL_POINTS


def test_windows_at_one_place_are_measured_once(spark, monkeypatch):
    from stagelight.operators import positions

    points = spark.createDataFrame([(float(i % 20), float(i // 20), float(i)) for i in range(400)], "x double, y double, volume double")
    windows = spark.createDataFrame([(k, float(k % 3 * 5), 0.0) for k in range(60)] + [(60, 500.0, 0.0), (61, None, 0.0)], "window_id long, x0 double, y0 double")
    seen, inside = [], positions.points_in_squares
    monkeypatch.setattr(positions, "points_in_squares", lambda p, w, size: seen.append(w.count()) or inside(p, w, size))
    got = {r.window_id: r for r in positions.window_point_features(points, windows, 10.0).collect()}
    for k in range(60):
        v = [i for i in range(400) if k % 3 * 5 <= i % 20 < k % 3 * 5 + 10 and i // 20 < 10]
        assert (got[k].n, got[k].vol_med, got[k].vol_q90) == (len(v), pytest.approx(np.median(v)), pytest.approx(np.quantile(v, 0.9)))
    assert len(got) == 62 and (got[60].n, got[61].n, got[61].vol_med) == (0, 0, None) and seen == [5]


def test_channels_are_matched_on_cells_of_few_points(spark, monkeypatch):
    from stagelight.operators import positions, spatial

    xy = [(i % 30 / 10, i // 30 / 10) for i in range(600)]
    rows = [(c, i, x + d, y, 0.0) for c, d in ((405, 0.01), (560, 0.0), (650, -0.02)) for i, (x, y) in enumerate(xy)]
    sizes, explode = [], spatial.explode_cells
    monkeypatch.setattr(spatial, "explode_cells", lambda d, x, y, size, *a: sizes.append(size) or explode(d, x, y, size, *a))
    got = positions.match_channels(spark.createDataFrame(rows, "color int, spot_id int, x_px double, y_px double, z_um double"), 560, [405, 560, 650], 6, 1.0).collect()
    assert len(got) == 600 and all(r["405_x"] == pytest.approx(xy[r.ref_id][0] + 0.01) and r["650_x"] == pytest.approx(xy[r.ref_id][0] - 0.02) for r in got)
    assert np.unique(np.floor(np.array(xy) / min(sizes)), axis=0, return_counts=True)[1].max() <= spatial.CELL_POINTS
