"""Kernels against naive loops and known answers; graph and coverage against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagelight.operators import coverage as Q
from stagelight.operators import graph as N
from stagelight.operators import kernels as K
from stagelight.operators import pixels as X
from stagelight.operators.clusters import touching_clusters
from stagelight.operators.solve import solve_positions


def frames(spark, images, key="frame"):
    rows = [(i, int(im.shape[0]), int(im.shape[1]), bytearray(im.astype("<u2").tobytes())) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, f"{key} int, h int, w int, pixels binary")


def spots_image(points, shape=(60, 70), level=100, noise=3, seed=0):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:shape[0], :shape[1]]
    img = level + rng.normal(0, noise, shape)
    for r, c, a in points:
        img += a * np.exp(-((yy - r) ** 2 + (xx - c) ** 2) / (2 * 1.5**2))
    return np.clip(img, 0, 65535).astype(np.uint16)


def mirror(i, n):
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def test_gaussian_blur_is_the_naive_sum():
    rng = np.random.default_rng(0)
    img = rng.random((9, 7))
    k = X.gaussian_kernel(1.5)
    radius = len(k) // 2
    want = np.zeros_like(img)
    for r in range(9):
        for c in range(7):
            want[r, c] = sum(k[i] * k[j] * img[mirror(r + i - radius, 9), mirror(c + j - radius, 7)] for i in range(len(k)) for j in range(len(k)))
    np.testing.assert_allclose(X.gaussian_blur(img, 1.5), want)


def test_blurred_flat_field(spark):
    rng = np.random.default_rng(1)
    imgs = rng.integers(100, 200, (3, 6, 5))
    px = spark.createDataFrame([(1, f, r, c, int(imgs[f, r, c])) for f in range(3) for r in range(6) for c in range(5)], "k int, f int, r int, c int, v int")
    got = {(x.r, x.c): x.v for x in X.flat_field(px, ["k"], sigma=1.2).collect()}
    m = X.gaussian_blur(imgs.mean(0), 1.2)
    m = np.maximum(m / np.percentile(m, 99.99), 0.1)
    assert got == {(r, c): pytest.approx(m[r, c]) for r in range(6) for c in range(5)}


@pytest.mark.parametrize("size", [3, 4, 5])
def test_sliding_max(size):
    img = np.random.default_rng(2).integers(0, 99, (8, 9))
    lo, hi = size // 2, size - size // 2 - 1
    want = [[max(img[mirror(r + i, 8), mirror(c + j, 9)] for i in range(-lo, hi + 1) for j in range(-lo, hi + 1)) for c in range(9)] for r in range(8)]
    assert (K.sliding_max(img, size) == np.array(want)).all()


def test_detect_spots_and_flat_image(spark):
    pts = [(15, 20, 4000), (40, 50, 3000)]
    got = K.detect_spots(frames(spark, [spots_image(pts), np.full((20, 20), 7, np.uint16)]), ["frame"], 5, 20).collect()
    assert sorted((r.frame, r.row_px, r.col_px) for r in got) == [(0, 15, 20), (0, 40, 50)]
    assert all(2500 < r.intensity < 4500 for r in got)


def test_max_project(spark):
    a = np.random.default_rng(3).integers(0, 65535, (5, 4, 6)).astype(np.uint16)
    df = frames(spark, list(a)).repartition(3).withColumn("k", F.lit(1))
    r = K.max_project(df, ["k"]).first()
    assert (np.frombuffer(r.pixels, "<u2").reshape(4, 6) == a.max(0)).all()


def test_hot_pixels():
    img = spots_image([(20, 20, 3000)])
    hot = img.copy()
    hot[5, 5], hot[0, 69] = 60000, 30000
    out = K.without_hot_pixels(hot)
    assert out[5, 5] < 200 and out[0, 69] < 200
    out[5, 5], out[0, 69] = img[5, 5], img[0, 69]
    assert (out == img).all()  # beads stay


def fourier_shift(img, dy, dx):
    f = np.fft.fft2(img.astype(float))
    ky, kx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None]
    return np.real(np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * dy + kx * dx))))


@pytest.mark.parametrize("shift", [(0, 0), (3, -5), (1.3, -2.6), (-0.4, 0.7)])
def test_phase_shift(shift):
    img = np.random.default_rng(4).random((40, 52)) * 1000
    dy, dx, err = K.phase_shift(img, fourier_shift(img, *shift), 10)
    assert (dy, dx) == (pytest.approx(-shift[0], abs=0.051), pytest.approx(-shift[1], abs=0.051)) and 0 <= err <= 1


def test_bead_drift(spark):
    pts = [(r, c, 3000 + 10 * r + c) for r in (10, 34, 50) for c in (12, 35, 58)]
    ref, mov = spots_image(pts), spots_image([(r + 3, c - 4, a) for r, c, a in pts], seed=9)
    r = K.bead_drift(frames(spark, [ref], "fov"), frames(spark, [mov], "fov"), ["fov"], 0.1, sigmas=20, max_shift=10).first()
    assert (r.dy, r.dx) == (pytest.approx(-3, abs=0.6), pytest.approx(4, abs=0.6)) and r.score > 0.6


def test_laplacian_texture(spark):
    img = np.random.default_rng(7).integers(0, 500, (10, 12)).astype(np.uint16)
    b = X.gaussian_blur(img, 1.0)
    p = np.pad(b, 1, mode="symmetric")
    want = (p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * b).var()
    assert K.laplacian_texture(frames(spark, [img]), ["frame"]).first().texture == pytest.approx(want)


def test_edge_strips(spark):
    a = np.arange(20, dtype=np.uint16).reshape(4, 5)
    got = {r.side: np.frombuffer(r.strip, "<u2").reshape(r.sh, r.sw) for r in K.edge_strips(frames(spark, [a]), "frame", 0.4).collect()}
    assert (got["right"] == a[:, 3:]).all() and (got["left"] == a[:, :2]).all() and (got["up"] == a[2:]).all() and (got["down"] == a[:2]).all()


def test_local_median_and_noise():
    rng = np.random.default_rng(21)
    for shape in ((1, 1), (1, 5), (7, 4), (30, 31)):
        img = rng.integers(0, 50, shape)
        p = np.pad(img, 1, mode="edge")
        want = [[np.median(p[r : r + 3, c : c + 3]) for c in range(shape[1])] for r in range(shape[0])]
        assert (K.local_median(img) == np.array(want)).all()
        v = rng.integers(-9, 9, rng.integers(1, 40))
        assert K.counted_noise(*np.unique(v, return_counts=True)) == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    for size in (1, 2, 5, 8):
        at = np.arange(img.size)
        assert (K.window_tops(img, at, size).reshape(img.shape) == (K.sliding_max(img, size) == img)).all()


def test_neighbour_registration(spark):
    big = spots_image([(r, c, 5000) for r, c in np.random.default_rng(8).integers(5, 75, (25, 2))], (80, 160))
    a, b = big[8:72, :100], big[10:74, 63:163][:, :97]
    a, b = a[:, :97], np.pad(b, ((0, 0), (0, 97 - b.shape[1])), mode="edge")
    # true offset of b: 63 columns right and 2 rows up; nominal says 60 and 0
    pair = spark.createDataFrame([(0, 1, "right", 60.0, 0.0)], "anchor int, neighbour int, direction string, bx0 double, by0 double")
    r = K.neighbour_registration(pair, frames(spark, [a, b]), ["anchor", "neighbour"], 37 / 97, 1.0).first()
    assert (r.measured_x, r.measured_y) == (pytest.approx(60 + 3, abs=0.3), pytest.approx(2, abs=0.3))


def test_pixels_are_not_broadcast(spark):
    """Tables that look small by their columns: every strip would pass through the driver."""
    side = spark.range(4).select(F.col("id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(bytes(range(128))).alias("pixels"))
    pairs = spark.range(3).select(F.col("id").alias("anchor"), (F.col("id") + 1).alias("neighbour"), F.lit("right").alias("direction"), F.lit(1.0).alias("bx0"), F.lit(0.0).alias("by0"))
    for df in (K.neighbour_registration(pairs, side, ["anchor", "neighbour"], 0.5, 1.0), K.pair_frames(pairs, side, "anchor", "neighbour")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 3


def test_whole_shifts_of_strips_are_exact():
    """Strips of random pixels, each cut off the other by up to four pixels: the rims moved one of some hundred pairs by 0.1."""
    rng, plain = np.random.default_rng(3), 0
    for _ in range(1500):
        world = rng.integers(0, 4096, (60, 40))
        dy, dx = rng.integers(-4, 5, 2)
        a, b = world[6:54, 6:30], world[6 + dy:54 + dy, 6 + dx:30 + dx]
        assert K.overlap_shift(a, b)[:2] == (dy, dx)
        plain += K.phase_shift(a, b)[:2] != (dy, dx)
    assert plain > 0


def test_fit_gauss3d_and_too_small():
    z = np.arange(9) * 0.5
    zz, yy, xx = np.meshgrid(z, np.arange(12.0), np.arange(14.0), indexing="ij")
    vol = 900 * np.exp(-((xx - 6.3) ** 2 + (yy - 5.6) ** 2) / (2 * 1.4**2) - (zz - 2.2) ** 2 / (2 * 0.7**2)) + 50
    assert K.fit_gauss3d(vol, z) == pytest.approx((6.3, 5.6, 2.2), abs=1e-3)
    assert K.fit_gauss3d(vol[:2], z[:2]) is None


def test_localize_3d(spark):
    z = np.arange(11) * 0.5
    yy, xx = np.mgrid[:40, :44]
    rng = np.random.default_rng(10)
    stack = [np.clip(100 + rng.normal(0, 2, (40, 44)) + sum(3000 * np.exp(-((yy - r) ** 2 + (xx - c) ** 2) / (2 * 1.5**2) - (zi - zc) ** 2 / (2 * 0.6**2))
             for r, c, zc in [(12.3, 10.4, 2.3), (28.6, 30.2, 2.9)]), 0, 65535).astype(np.uint16) for zi in z]
    df = frames(spark, stack).withColumn("s", F.lit(1)).withColumn("z", F.col("frame") * 0.5)
    got = sorted((r.x_px, r.y_px, r.z_um) for r in K.localize_3d(df, ["s"], "z", 6, 5).collect())
    assert got == [pytest.approx((10.4, 12.3, 2.3), abs=0.1), pytest.approx((30.2, 28.6, 2.9), abs=0.1)]


def test_peaks_and_valley(spark):
    y = np.array([0, 3, 1, 1, 5, 5, 2, 0.5, 4, 0.0])
    assert K and X.peak_prominences(y) == [(1, 2.0), (4, 5.0), (8, 3.5)]
    h = spark.createDataFrame([(1, i, i / 2, float(v)) for i, v in enumerate(y)] + [(2, i, i / 2, float(v)) for i, v in enumerate([0, 1, 3, 2, 0])], "k int, bin int, center double, density double")
    got = {r.k: r.threshold for r in X.valley_threshold(h, ["k"]).collect()}
    assert got[1] == pytest.approx(10 ** 3.5) and (got[2] is None or np.isnan(got[2]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, i) for i in range(1001, 1200)]
    rng = np.random.default_rng(12)
    rand = [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    edges = chain + hub + rand + [(5000, 5000)]
    got = {r.id: r.component for r in N.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}


@pytest.mark.parametrize("block", [2048, 2])
def test_solve_positions(spark, block):
    rng = np.random.default_rng(13)
    nominal = {i: (100.0 * (i % 3), 100.0 * (i // 3)) for i in range(6)} | {10: (0.0, 0.0), 11: (100.0, 0.0)}
    pairs = [(0, 1), (1, 2), (0, 3), (1, 4), (2, 5), (3, 4), (4, 5), (10, 11)]
    meas = [(a, b, *(np.array(nominal[b]) + rng.normal(0, 3, 2))) for a, b in pairs]
    df = spark.createDataFrame([(a, b, float(x), float(y)) for a, b, x, y in meas], "anchor long, neighbour long, measured_x double, measured_y double")
    nom = spark.createDataFrame([(i, *p) for i, p in nominal.items()], "fov_id long, x double, y double")
    solved, summary = solve_positions(df, nom, block=block)
    ids = sorted(nominal)
    pins = [0, 10]
    a = np.zeros((len(pairs) + 2, len(ids)))
    rhs = np.zeros((len(pairs) + 2, 2))
    for k, (p, q, x, y) in enumerate(meas):
        a[k, ids.index(q)], a[k, ids.index(p)] = 1, -1
        rhs[k] = np.array([x, y]) - nominal[p]
    for k, p in enumerate(pins):
        a[len(pairs) + k, ids.index(p)] = 1e6
        rhs[len(pairs) + k] = 1e6 * np.array(nominal[p])
    want = np.linalg.lstsq(a, rhs, rcond=None)[0]
    for r in solved.collect():
        assert (r.x, r.y) == pytest.approx(tuple(want[ids.index(r.fov_id)]), abs=1e-6) and r.pinned == (r.fov_id in pins)
    res = (a @ want - rhs)[:len(pairs)]
    s = summary.first()
    assert s.residual_rms == pytest.approx(np.sqrt((res**2).sum(1).mean()), abs=1e-5) and s.n_components == 2


def test_redundant_fovs(spark):
    rng = np.random.default_rng(14)
    fovs = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 100, (25, 2)))] + [(99, 500.0, 500.0)]
    tissue = [(r, c) for r in range(10) for c in range(10) if (r + c) % 7]
    cells = set(tissue)
    cover = {f: {(r, c) for r, c in cells if abs((r + 0.5) * 10 - y) <= 20 and abs((c + 0.5) * 10 - x) <= 20} for f, x, y in fovs}
    alone = lambda f, gone: cover[f] - set().union(*[cover[g] for g in cover if g != f and g not in gone])
    detected = {f for f in cover if not alone(f, set())}
    removed = set()
    for f in sorted(detected):
        if not alone(f, removed):
            removed.add(f)
    for at_once in (None, 3):
        got = Q.redundant_fovs(spark.createDataFrame(fovs, "fov_id long, x double, y double"), spark.createDataFrame(tissue, "r long, c long"), 40.0, 10.0, at_once).collect()
        assert {r.fov_id for r in got if r.detected} == detected and {r.fov_id for r in got if r.removed} == removed


def test_copies_of_a_fov_are_decided_by_their_last(spark, monkeypatch):
    """4,000 FOVs on 30 places: the blocks hold places, so one block is enough where FOVs would fill a hundred."""
    rng = np.random.default_rng(15)
    places = rng.integers(0, 100, (30, 2))
    fovs = [(i, *map(float, places[k])) for i, k in enumerate(rng.integers(0, 30, 4000))] + [(5000, 500.0, 500.0), (5001, 93.0, 7.0)]
    tissue = [(r, c) for r in range(10) for c in range(10) if (r + c) % 7]
    cover = {f: [(r, c) for r, c in tissue if abs((r + 0.5) * 10 - y) <= 20 and abs((c + 0.5) * 10 - x) <= 20] for f, x, y in fovs}
    left = {}
    for own in cover.values():
        for k in own:
            left[k] = left.get(k, 0) + 1
    detected = {f for f, own in cover.items() if all(left[k] >= 2 for k in own)}
    removed = set()
    for f in sorted(detected):
        if all(left[k] >= 2 for k in cover[f]):
            removed.add(f)
            for k in cover[f]:
                left[k] -= 1
    decide, most = Q.ordered_scan, []

    def watched(df, *args, **kw):
        most.append(df.count())
        return decide(df, *args, **kw)

    monkeypatch.setattr(Q, "ordered_scan", watched)
    got = Q.redundant_fovs(spark.createDataFrame(fovs, "fov_id long, x double, y double"), spark.createDataFrame(tissue, "r long, c long"), 40.0, 10.0).collect()
    assert {r.fov_id for r in got if r.detected} == detected and {r.fov_id for r in got if r.removed} == removed and len(got) == len(fovs)
    assert max(most) <= 31


def test_a_chain_of_ten_thousand_fovs(spark):
    """Each FOV overlaps its neighbours by a third or two thirds, so every decision hangs on the one before."""
    step, n = (1, 2, 2), 10_000
    x = np.cumsum([step[i % 3] for i in range(n)]) * 10.0
    fovs = spark.createDataFrame([(i, float(v), 5.0) for i, v in enumerate(x)], "fov_id long, x double, y double")
    tissue = spark.range(int(x[-1] // 10) + 9).select(F.lit(0).cast("long").alias("r"), F.col("id").alias("c"))
    cover = [[c for c in range(int(v // 10) - 3, int(v // 10) + 4) if c >= 0 and abs((c + 0.5) * 10 - v) <= 15] for v in x]
    left = {}
    for own in cover:
        for c in own:
            left[c] = left.get(c, 0) + 1
    detected = {i for i, own in enumerate(cover) if all(left[c] >= 2 for c in own)}
    removed = set()
    for i in sorted(detected):
        if all(left[c] >= 2 for c in cover[i]):
            removed.add(i)
            for c in cover[i]:
                left[c] -= 1
    got = Q.redundant_fovs(fovs, tissue, 30.0, 10.0, 4000).collect()
    assert len(removed) > 2000 and {r.fov_id for r in got if r.removed} == removed and {r.fov_id for r in got if r.detected} == detected


def brute_clusters(points, radius):
    """Components over all pairs within the radius, points without a neighbour left out."""
    ids, xy = [p[0] for p in points], np.array([p[1:] for p in points], float)
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    touched = set()
    for i in range(len(ids)):
        for j in np.flatnonzero(np.hypot(*(xy[i] - xy[:i]).T) <= radius):
            touched |= {i, int(j)}
            label[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = {}
    for i in touched:
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {(ids[i], least[find(i)]) for i in touched}


@pytest.mark.parametrize("radius", [0.5, 3.0])
def test_touching_clusters(spark, monkeypatch, radius):
    from stagelight.operators import clusters as C

    monkeypatch.setattr(C, "PAIRS", 16)  # boxes are cut down to few points
    rng = np.random.default_rng(int(radius * 10))
    xy = np.concatenate([rng.uniform(0, 30, (250, 2)), rng.normal(5, 0.2, (150, 2)), rng.normal((9, 5), 0.3, (60, 2)), [(5.0, 5.0)] * 30, [(-7, -7), (-7 + radius, -7), (50, 50), (1e6, 1e6)]])
    points = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)) + 5, xy)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    assert {tuple(r) for r in touching_clusters(df, radius).select("id", "component").collect()} == brute_clusters(points, radius)
    assert touching_clusters(df, radius, lone=True).count() == len(points)


def test_a_dense_cell_is_linear_work(spark):
    """10^5 points in two cells that touch through one pair only: no list of pairs, the right components."""
    rng = np.random.default_rng(4)
    left = np.stack([rng.uniform(0, 0.5, 50_000), rng.uniform(0, 0.6, 50_000)], axis=1)
    right = left + (1.6, 0.0)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([left, right, [(0.55, 0.3), (1.55, 0.3), (9, 9), (9.1, 9)]]))]
    got = touching_clusters(spark.createDataFrame(points, "id long, x double, y double"), 1.0).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 100_002), (100_002, 2)}


def test_positions_of_one_large_component(spark):
    """A grid of 24,000 pairs: the true positions come back (several blocks are tested above)."""
    side, rng = 110, np.random.default_rng(6)
    true = {i: (100.0 * (i % side) + rng.uniform(-4, 4), 100.0 * (i // side) + rng.uniform(-4, 4)) for i in range(side * side)}
    pairs = [(i, j) for i in true for j in (i + 1, i + side) if j in true and (j != i + 1 or j % side)]
    nominal = spark.createDataFrame([(i, 100.0 * (i % side), 100.0 * (i // side)) for i in true], "fov_id long, x double, y double")
    # measured: nominal place of the neighbour as seen from the anchor's nominal place
    rows = [(a, b, 100.0 * (a % side) + true[b][0] - true[a][0], 100.0 * (a // side) + true[b][1] - true[a][1]) for a, b in pairs]
    solved, summary = solve_positions(spark.createDataFrame(rows, "anchor long, neighbour long, measured_x double, measured_y double"), nominal, block=1 << 14)
    got = {r.fov_id: (r.x, r.y) for r in solved.collect()}
    pin = solved.where("pinned").first()
    off = np.array([pin.x, pin.y]) - true[pin.fov_id]
    assert len(pairs) > 20_000 and max(np.abs(np.array(got[i]) - true[i] - off).max() for i in true) < 1e-5 and summary.first().residual_rms < 1e-6


def test_positions_of_a_long_strip_need_no_rounds(spark, monkeypatch):
    """Noisy pairs of a strip in many blocks, with a second component: the start is the least-squares solution already."""
    from stagelight.operators import solve as V

    monkeypatch.setattr(V, "ROUNDS", (0, 0))
    rng, n = np.random.default_rng(8), 3 * 60
    spot = {i: (100.0 * (i % 3), 100.0 * (i // 3)) for i in range(n)} | {1000: (0.0, 0.0), 1001: (100.0, 0.0)}
    pairs = [(i, j) for i in range(n) for j in (i + 1, i + 3) if j < n and (j != i + 1 or j % 3)] + [(1000, 1001), (0, 1), (7, 7)]
    rows = [(a, b, *(float(v) for v in np.array(spot[b]) + rng.normal(0, 3, 2))) for a, b in pairs]
    solved, _ = V.solve_positions(
        spark.createDataFrame(rows, "anchor long, neighbour long, measured_x double, measured_y double"),
        spark.createDataFrame([(i, *p) for i, p in spot.items()], "fov_id long, x double, y double"), block=16)
    got = {r.fov_id: r for r in solved.collect()}
    at = {k: j for j, k in enumerate(spot)}
    pins = [k for k in spot if got[k].pinned]
    a, rhs = np.zeros((len(rows) + len(pins), len(spot))), np.zeros((len(rows) + len(pins), 2))
    for k, (p, q, x, y) in enumerate(rows):
        a[k, at[q]] += 1
        a[k, at[p]] -= 1
        rhs[k] = np.array([x, y]) - spot[p]
    for k, p in enumerate(pins):
        a[len(rows) + k, at[p]], rhs[len(rows) + k] = 1e6, 1e6 * np.array(spot[p])
    want = np.linalg.lstsq(a, rhs, rcond=None)[0]
    assert len(pins) == 2 and max(np.abs(np.array([got[k].x, got[k].y]) - want[j]).max() for k, j in at.items()) < 1e-6


def test_positions_that_do_not_settle_are_an_error(spark, monkeypatch):
    from stagelight.operators import solve as V

    monkeypatch.setattr(V, "solve_block", lambda points, edges: points.assign(zx=0.0, zy=0.0))
    pairs = spark.createDataFrame([(0, 1, 5.0, 0.0)], "anchor long, neighbour long, measured_x double, measured_y double")
    monkeypatch.setattr(V, "ROUNDS", (2, 0))
    with pytest.raises(RuntimeError, match="did not settle"):
        V.solve_positions(pairs, spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 0.0)], "fov_id long, x double, y double"))


def test_square_areas_against_sampling():
    ring = np.array([(0, 0), (10, 1), (8, 9), (5, 4), (1, 8)], float)  # not convex
    rng = np.random.default_rng(15)
    x, y = rng.uniform(-2, 12, 12), rng.uniform(-2, 12, 12)
    got = Q.square_areas(ring, x, y, 1.5)
    t = (np.arange(400) + 0.5) / 400 * 3 - 1.5
    for i in range(12):
        gx, gy = np.meshgrid(x[i] + t, y[i] + t)
        inside = np.zeros(gx.shape, bool)
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
            if y1 != y2:
                inside ^= ((y1 > gy) != (y2 > gy)) & (gx < (x2 - x1) * (gy - y1) / (y2 - y1) + x1)
        assert got[i] == pytest.approx(9 * inside.mean(), abs=0.05)
        if inside.any():
            assert Q.touches(ring, x[i:i + 1], y[i:i + 1], 1.5)[0]


def test_morphology_and_holes(spark):
    ring = [(r, c) for r in range(20) for c in range(20) if 4 <= np.hypot(r - 10, c - 10) <= 8]
    canvas = spark.createDataFrame([(r, c, 500.0 if (r, c) in set(ring) else 10.0) for r in range(22) for c in range(22)], "r long, c long, v double")
    got = Q.segment_tissue(canvas, pixel_um=1.0, threshold=100.0, smooth_um=0, close_um=1, open_um=1, margin_um=0, min_tissue_um2=50, min_hole_um2=5).toPandas()
    hole = got[got["kind"] == "hole"]
    assert {(10, 10)} <= set(zip(hole["r"], hole["c"])) and got[got["kind"] == "tissue"]["label"].nunique() == 1


def test_tissue_over_tiles(spark, monkeypatch):
    """Pieces, holes and near pieces over many small tiles are those of the whole raster, and only tiles' pieces are joined, not cells."""
    rng, h, w = np.random.default_rng(5), 60, 75
    y, x = np.mgrid[:h, :w]
    m = np.zeros((h, w), bool)
    for cy, cx, big, small in ((20, 22, 18, 9), (45, 55, 12, 4), (20, 50, 5, 0), (52, 8, 4, 0), (5, 70, 3, 0)):
        d = np.hypot(y - cy, x - cx)
        m |= (d <= big) & ((d > small) | (small == 0))
    there = rng.random((h, w)) < 0.97
    rows = [(int(r) - 7, int(c) - 9, None if rng.random() < 0.01 else (500.0 if m[r, c] else 10.0)) for r, c in np.argwhere(there)]
    canvas = spark.createDataFrame(rows, "r long, c long, v double")

    def disk(a, k, whole):
        out = np.zeros_like(a)
        p = np.pad(a, k)
        hits = sum(p[k + i : k + i + a.shape[0], k + j : k + j + a.shape[1]].astype(int) for i, j in Q.disk_offsets(k))
        out[:] = hits == len(Q.disk_offsets(k)) if whole else hits > 0
        return out

    def pieces(a):
        label, seen = np.full(a.shape, -1), np.zeros_like(a)
        for r, c in np.argwhere(a):
            todo = [] if seen[r, c] else [(r, c)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] and a[i, j] and not seen[i, j]:
                    seen[i, j], label[i, j] = True, r * a.shape[1] + c
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        return label

    raw = np.zeros((h + 20, w + 20), bool)
    for r, c, v in rows:
        raw[r + 17, c + 19] = v is not None and v > 100
    box = np.s_[9:h + 11, 9:w + 11]  # the canvas and its frame
    a = disk(disk(disk(disk(disk(raw, 2, False), 2, True), 1, True), 1, False), 1, False)
    a[:10] = a[h + 10:] = a[:, :10] = a[:, w + 10:] = False
    a = a[box]
    back = pieces(~a)
    holes = np.where(back > 0, back, -1)
    full = pieces(a | (holes >= 0))
    size = {k: (full == k).sum() for k in set(full.flat) - {-1}}
    large = {k for k, n in size.items() if n >= 300}
    near = disk(np.isin(full, list(large)), 4, False)
    large |= {k for k in size if near[full == k].any() and size[k] >= 20}
    want = {(int(r) - 8, int(c) - 10, "tissue", int(full[r, c]), float(size[full[r, c]])) for r, c in np.argwhere(np.isin(full, list(large)))}
    want |= {(int(r) - 8, int(c) - 10, "hole", int(holes[r, c]), float((holes == holes[r, c]).sum())) for r, c in np.argwhere(holes >= 0) if full[r, c] in large and (holes == holes[r, c]).sum() >= 60}
    joined, plain = [], Q.connected_components
    monkeypatch.setattr(Q, "connected_components", lambda edges, *names: joined.append(edges.count()) or plain(edges, *names))
    monkeypatch.setattr(Q, "TILE", 16, raising=False)
    got = Q.segment_tissue(canvas, pixel_um=1.0, threshold=100.0, smooth_um=0, close_um=2, open_um=1, margin_um=1, min_tissue_um2=300, min_hole_um2=60, near_um=4, min_near_um2=20).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {r.kind for r in got} == {"tissue", "hole"} and len({r.label for r in got if r.kind == "tissue"}) > 1
    assert max(joined) < h * w / 10


def test_fit_similarity(spark):
    yy, xx = np.mgrid[:60, :60]
    src = ((yy - 30) / 10.0) ** 2 + ((xx - 30) / 22.0) ** 2 < 1
    src |= (np.hypot(yy - 18, xx - 44) < 7)
    a = np.radians(35)
    cy, cx = np.mgrid[:90, :90]
    x, y = (cx - 45) / 1.2, (cy - 45) / 1.2
    bx, by = np.cos(a) * x + np.sin(a) * y + 30, np.cos(a) * y - np.sin(a) * x + 30
    ok = (bx >= 0) & (bx < 60) & (by >= 0) & (by < 60)
    tgt = np.zeros((90, 90), bool)
    tgt[ok] = src[by[ok].astype(int), bx[ok].astype(int)]
    df = lambda m: spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(m)], "r long, c long")
    r = Q.fit_similarity(df(src), df(tgt), 1.0).first()
    assert r.flip == 1 and r.angle == pytest.approx(35, abs=1.5) and r.scale == pytest.approx(1.2, abs=0.05) and r.iou > 0.93
