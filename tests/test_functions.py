import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.operators import photos
from aerialframe.functions import geodesy, images, mercator, metadata


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ground_coverage_and_footprints(spark):
    args = dict(lat=10.0, lon=106.0, alt=100.0, yaw=0.0, f=10.0, w=13.2, h=8.8)
    names = ("lat", "lon", "relative_altitude", "yaw_deg", "focal_mm", "sensor_width_mm", "sensor_height_mm")

    def ring(**k):
        row = spark.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(names, (args | k).values(), strict=True)])
        got = photos.with_footprint(row)
        assert got.columns == [*names, "footprint"]
        return got.first().footprint

    w, h = one(spark, *geodesy.ground_coverage(*map(F.lit, (100.0, 10.0, 13.2, 8.8))))
    assert (w, h) == pytest.approx((132, 88))
    got = ring()
    assert len(got) == 5 and got[0] == got[4] and got[0][0] < 106 < got[2][0] and got[0][1] < 10 < got[2][1]
    per_lon = geodesy.M_PER_DEG * math.cos(math.radians(10))
    assert (got[1][0] - got[0][0]) * per_lon == pytest.approx(132, abs=0.1) and (got[2][1] - got[1][1]) * geodesy.M_PER_DEG == pytest.approx(88, abs=0.1)
    turned = ring(lat=0.0, lon=0.0, yaw=90.0, w=0.001, h=10.0)
    assert turned[2][0] > 0 and abs(turned[2][1]) < 1e-6
    for bad in (dict(alt=0.0), dict(f=0.0), dict(f=-1.0), dict(lat=None), dict(yaw=float("nan")), dict(alt=float("nan")), dict(alt=float("inf")), dict(w=0.0), dict(lon=float("inf"))):
        assert ring(**bad) is None, bad


def test_rings(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    ring = F.array(*[F.array(*map(F.lit, p)) for p in square])
    pts = [tuple(map(F.lit, p)) for p in square]
    assert list(one(spark, geodesy.in_ring(F.lit(0.5), F.lit(0.5), pts), geodesy.in_ring(F.lit(1.5), F.lit(0.5), pts))) == [True, False]
    assert list(one(spark, geodesy.in_ring_array(F.lit(0.5), F.lit(0.5), ring), geodesy.in_ring_array(F.lit(1.5), F.lit(0.5), ring), geodesy.ring_area(ring))) == [True, False, 1.0]
    assert list(one(spark, geodesy.in_ring(F.lit(0.5), F.lit(0.5), pts[:2]), geodesy.in_ring_array(F.lit(0.5), F.lit(0.5), F.slice(ring, 1, 2)), geodesy.ring_area(F.slice(ring, 1, 2)))) == [False, False, 0.0]
    assert [r[0] for r in spark.range(7).select(geodesy.level(F.col("id"))).collect()] == ["red"] * 3 + ["yellow"] * 2 + ["green"] * 2


def test_local_metres_and_matrices(spark):
    e, n = geodesy.to_local(F.lit(10.001), F.lit(106.002), F.lit(10.0), F.lit(106.0))
    back = geodesy.from_local(e, n, F.lit(10.0), F.lit(106.0))
    assert list(one(spark, *back)) == pytest.approx([106.002, 10.001])
    m = geodesy.similarity(F.lit(5.0), F.lit(7.0), F.lit(30.0), F.lit(0.1), F.lit(100.0), F.lit(60.0))
    assert list(one(spark, *geodesy.apply_matrix(m, F.lit(50.0), F.lit(30.0)))) == pytest.approx([5, 7])
    got = np.array(one(spark, geodesy.matmul3(m, m))[0]).reshape(3, 3)
    raw = images.similarity_matrix(5, 7, math.radians(30), 0.1, 50, 30)
    assert np.allclose(got, raw @ raw)
    assert list(one(spark, *geodesy.normalised_keypoint(F.lit(0.0), F.lit(30.0), F.lit(100.0), F.lit(60.0)))) == [-1.0, 0.0]
    assert one(spark, geodesy.percent(F.lit(1), F.lit(3)))[0] == 33


def test_labels(spark):
    assert list(one(spark, geodesy.area_label(F.lit(9999.0)), geodesy.area_label(F.lit(12345.0)))) == ["9999 m²", "1.23 ha"]


def test_metadata(spark):
    number = lambda s: metadata.xmp_number(F.lit(f'<a b:R="{s}"/>'), "b:R")
    assert list(one(spark, number("+50.30"), number("-12.50"), number(" 7 "), number("x"), metadata.xmp_number(F.lit("<a/>"), "b:R"))) == [50.3, -12.5, 7.0, None, None]
    subs = ["5", "50", "500", "123456", "", "a1b2"]
    assert list(one(spark, *[metadata.subsec_millis(F.lit(s)) for s in subs])) == [500, 500, 500, 123, 0, 120]
    names = ["DJI_0123.JPG", "IMG_20240501_0007.jpg", "pano.jpg", "18446744073709551615.jpg", "18446744073709551616.jpg", "99999999999999999999999.jpg", "a1"]
    assert [None if v is None else int(v) for v in one(spark, *[metadata.filename_sequence(F.lit(n)) for n in names])] == [123, 7, None, 2**64 - 1, None, None, 1]
    ms = lambda t, s="0": metadata.capture_millis(F.lit(t), F.lit(s))
    got = one(spark, ms("2024:05:01 10:00:01"), ms("2024:05:01 10:00:00"), ms("2024:05:01 10:00:00", "5"), ms("2024-05-01"), ms("2024:13:01 10:00:00"), ms("1970:01:01 00:00:01"))
    assert got[0] - got[1] == 1000 and got[2] - got[1] == 500 and list(got[3:]) == [None, None, 1000]
    parts = lambda *v: F.array(*map(F.lit, v))
    assert list(one(spark, metadata.dms(parts(10.0, 30.0, 36.0), F.lit("S")), metadata.dms(parts(10.0, 30.0, 36.0), F.lit(None).cast("string")), metadata.dms(parts(10.0, 30.0), F.lit("N")))) == [-10.51, 10.51, None]
    key = lambda *v: metadata.capture_key(*[F.lit(x).cast("long") for x in v])
    assert [tuple(map(int, k)) for k in one(spark, key(5, 6, 7), key(None, 6, 7), key(None, None, 7), key(None, None, None))] == [(0, 5), (1, 6), (2, 7), (3, 0)]


def test_sensor_sizes(spark):
    def size(f=None, f35=None, w=6000, h=4000, x=None, y=None, unit=None, model=None):
        kinds = ("double", "long", "long", "long", "double", "double", "long", "string")
        return list(one(spark, *[c.alias(str(i)) for i, c in enumerate(metadata.sensor_size(*[F.lit(v).cast(k) for v, k in zip((f, f35, w, h, x, y, unit, model), kinds, strict=True)]))]))

    assert size(8.8, 24) == pytest.approx([13.2, 8.8, 1])
    assert size(x=6417.0, y=6417.0, unit=2)[:2] == pytest.approx([23.75, 15.8], abs=0.5)
    assert size(x=6417.0, y=6417.0, unit=4, model="DJI FC3305") == [6.3, 4.7, 3]
    assert size(x=0.0, y=1.0, unit=2) == [None, None, None] and size(f=8.8, f35=0) == [None, None, None]
    names = metadata.warnings(F.lit(False), F.lit(None), F.lit(1.0), F.lit(3), F.lit(None), F.lit(1.0), F.lit(None))
    assert one(spark, names)[0] == ["missing_gps", "used_camera_db_fallback", "missing_focal_length", "missing_yaw"]
    assert list(one(spark, *[metadata.is_blurry(F.lit(v).cast("double")).alias(str(v)) for v in (99.9, 100.0, 0.0, None)])) == [True, False, True, False]


def test_boxes(spark):
    box = lambda *v: mercator.Box(*[F.lit(float(x)) for x in v])
    err = lambda b, z=12: one(spark, mercator.box_error(b, F.lit(z)))[0]
    good = box(18.6, 49.4, 18.9, 49.6)
    assert err(good) is None and err(good, 16) and err(box(1, 1, 1, 2)) and err(box(1, 2, 2, 1)) and err(box(-200, 1, 2, 2)) and err(box("nan", 1, 2, 2)) and err(box(1, -91, 2, 2))
    form = lambda b, z: one(spark, mercator.form_error(b, F.lit(z)))[0]
    assert form(good, 3.0) is None and form(good, 3.5) and form(box(1, 1, 2, 86), 3.0)
    assert one(spark, mercator.contains(good, good), mercator.contains(good, box(18.5, 49.4, 18.7, 49.5)))[:] == (True, False)
    grown = one(spark, *[c.alias(str(i)) for i, c in enumerate(mercator.fit_aspect(good, F.lit(100), F.lit(100)))])
    assert grown[0] <= 18.6 and grown[2] >= 18.9 and grown[1] == pytest.approx(49.4, abs=0.1)
    same = one(spark, *[c.alias(str(i)) for i, c in enumerate(mercator.fit_aspect(good, F.lit(0), F.lit(100)))])
    assert list(same) == [18.6, 49.4, 18.9, 49.6]


def test_pictures():
    assert images.laplacian_variance(np.full((32, 32), 9, np.uint8)) == 0 and images.laplacian_variance(np.ones((1, 1))) == 0
    assert images.laplacian_variance((np.indices((32, 32)).sum(0) % 2 * 255).astype(np.uint8)) > 1000
    w = images.feather_weights(101, 61)
    assert w[30, 50] == 1 and w[0, 0] == 0 and w[30, 0] == 0
    big = images.downsample(np.full((3000, 4000, 3), 7, np.uint8))
    assert big.shape == (1200, 1600, 3) and (big == 7).all()
    small = np.arange(320 * 240 * 3, dtype=np.uint8).reshape(240, 320, 3)
    assert images.downsample(small) is small
    assert images.downsample(np.array([[[0], [10], [20], [30]]], np.uint8).repeat(2, 0), 2).ravel().tolist() == [5, 25]


def test_clipping_against_a_fine_grid():
    r = np.random.default_rng(0)

    def quad():
        t, (w, h), c = r.uniform(0, 6.28), r.uniform(0.5, 2, 2), r.uniform(-1, 1, 2)
        m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        return (np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * [w, h]) @ m.T + c

    a, b = np.array([quad() for _ in range(40)]), np.array([quad() for _ in range(40)])
    got = images.clip_areas(a, b)
    g = np.stack(np.meshgrid(*[np.linspace(-4, 4, 400)] * 2), -1).reshape(-1, 2)

    def inside(q):
        e = np.roll(q, -1, 0) - q
        return np.all([(e[k, 0] * (g[:, 1] - q[k, 1]) - e[k, 1] * (g[:, 0] - q[k, 0])) >= 0 for k in range(4)], 0)

    want = [np.mean(inside(x) & inside(y)) * 64 for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, want, atol=0.15)
    assert np.allclose(images.clip_areas(a, a), images.quad_area(a))


def test_homographies():
    r = np.random.default_rng(1)
    src = r.uniform(0, 1000, (60, 2))
    h = np.array([[1.1, 0.05, 30], [-0.04, 0.95, -12], [1e-5, 2e-5, 1]])
    dst = images.apply(h, src)
    dst[:20] = r.uniform(0, 1000, (20, 2))
    found, n = images.ransac_homography(src, dst)
    assert n >= 40 and np.abs(images.apply(found, src[20:]) - dst[20:]).max() < 1e-3
    assert images.ransac_homography(src[:7], dst[:7]) is None
    assert images.ransac_homography(src, r.uniform(0, 1000, (60, 2))) is None
    same, n = images.ransac_homography(src, src)
    assert n == 60 and np.allclose(same, np.eye(3), atol=1e-6)


def test_alignment():
    start = np.array([[0.0, 0, 0], [12.0, 0, 0]])
    scale, centre = np.array([0.05, 0.05]), np.array([[960.0, 540], [960, 540]])
    assert np.abs(images.align(start, scale, centre, []) - start).max() < 1e-3
    pulled = images.align(start, scale, centre, [(0, 1, np.eye(3), 1920, 1080)])
    assert abs(pulled[1, 0] - pulled[0, 0]) < 6
    start[1, 0] = 36.0
    agreed = images.align(start, scale, centre, [(0, 1, np.array([[1, 0, -720.0], [0, 1, 0], [0, 0, 1]]), 1920, 1080)])
    assert np.abs(agreed - start).max() < 0.5


def test_common_areas_of_touching_and_equal_squares():
    at = lambda x, y, s=1.0: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    cases = [(at(3, 4), 1), (at(3.5, 4), 0.5), (at(4, 4), 0), (at(3, 5), 0), (at(4, 5), 0), (at(2, 3, 3), 1), (at(3.25, 4.25, 0.5), 0.25), (at(3, 4, 0.5), 0.25), (at(9, 9), 0)]
    got = images.clip_areas(np.repeat(at(3, 4)[None], len(cases), 0), np.stack([q for q, _ in cases]))
    assert np.allclose(got, [v for _, v in cases])


def plain_common_area(a, b):
    """Clipping of one polygon by the other's sides, a point at a time."""
    poly = [tuple(p) for p in a]
    for k in range(4):
        (px, py), (qx, qy) = b[k], b[(k + 1) % 4]
        side = lambda p: (qx - px) * (p[1] - py) - (qy - py) * (p[0] - px)  # noqa: B023, E731
        new = []
        for cur, prev in zip(poly, poly[-1:] + poly[:-1]):
            if (side(cur) >= 0) != (side(prev) >= 0):
                t = side(prev) / (side(prev) - side(cur))
                new.append((prev[0] + t * (cur[0] - prev[0]), prev[1] + t * (cur[1] - prev[1])))
            if side(cur) >= 0:
                new.append(cur)
        poly = new
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2


def test_common_areas_against_clipping():
    r = np.random.default_rng(0)
    box = np.array([[-5, -3], [5, -3], [5, 3], [-5, 3]], float)
    turned = lambda t, c: box @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + c
    a, b = (np.stack([turned(r.uniform(0, 7), r.uniform(-6, 6, 2)) for _ in range(300)]) for _ in range(2))
    assert np.allclose(images.clip_areas(a, b), [plain_common_area(x, y) for x, y in zip(a, b)])


def test_alignment_against_a_dense_solver():
    """Noisy edges in a grid of photos: the same minimum as a plain Levenberg-Marquardt with numeric derivatives, and 2,000 photos in little time."""
    def made(side, r):
        n = side * side
        true = np.c_[np.repeat(np.arange(side), side) * 30.0, np.tile(np.arange(side), side) * 30.0, r.normal(0, 0.05, n)]
        scale, centre = np.full(n, 0.05), np.tile([960.0, 640.0], (n, 1))
        pose = [images.similarity_matrix(*x, 0.05, 960, 640) for x in true]
        near = [(i, j) for i in range(n) for j in ((i + 1) if (i + 1) % side else -1, i + side) if 0 <= j < n]
        edges = [(i, j, np.linalg.inv(pose[j]) @ pose[i] @ np.array([[1, 0, r.normal(0, 9)], [0, 1, r.normal(0, 9)], [0, 0, 1]]), 1920.0, 1280.0) for i, j in near]
        return true + r.normal(0, 1, true.shape) * [1, 1, 0.02], scale, centre, edges

    def cost(x, start, scale, centre, edges):
        total = (((x - start) / [images.POSITION_SIGMA, images.POSITION_SIGMA, images.HEADING_SIGMA]) ** 2).sum() / 2
        for i, j, h, w, ht in edges:
            p = np.array([[0, 0], [w, 0], [w, ht], [0, ht], [w / 2, ht / 2]])
            on = [images.apply(images.similarity_matrix(*x[k], scale[k], *centre[k]), q) for k, q in ((i, p), (j, images.apply(h, p)))]
            d = np.linalg.norm((on[0] - on[1]) / images.VISUAL_SIGMA)
            total += d**2 / 2 if d <= images.HUBER else images.HUBER * (d - images.HUBER / 2)
        return total

    given = made(4, np.random.default_rng(1))
    x = images.align(*given)
    best = cost(x, *given)
    assert best < cost(given[0], *given)
    for k in range(x.size):  # no coordinate can be moved for the better
        for h in (1e-3, -1e-3):
            y = x.copy()
            y.flat[k] += h
            assert cost(y, *given) > best - 1e-4
    import time

    began = time.time()
    start, scale, centre, edges = made(45, np.random.default_rng(2))
    x = images.align(start, scale, centre, edges)
    assert time.time() - began < 60 and np.isfinite(x).all() and cost(x, start, scale, centre, edges) < cost(start, start, scale, centre, edges)
