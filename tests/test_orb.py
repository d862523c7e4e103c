import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.functions import images, orb
from aerialframe.operators import matching
from aerialframe.plans import stitch


def scene(seed=0, h=420, w=520):
    """Soft blobs of many sizes: corners at several scales."""
    r = np.random.default_rng(seed)
    out = np.zeros((h, w))
    for size in (4, 8, 16, 32):
        out += np.kron(r.uniform(0, 60, (h // size + 2, w // size + 2)), np.ones((size, size)))[:h, :w]
    return np.repeat(np.clip(out, 0, 255).astype(np.uint8)[:, :, None], 3, 2)


def inliers(a, b):
    """Points of ratio-tested nearest neighbours that one homography moves from a to b, and it."""
    (pa, _, _, da), (pb, _, _, db) = orb.features(a), orb.features(b)
    bits = np.bitwise_count(da[:, None].view(np.uint64) ^ db[None].view(np.uint64)).sum(2)
    two = np.sort(bits, 1)[:, :2]
    good = two[:, 0] < 0.75 * two[:, 1]
    return images.ransac_homography(pa[good], pb[bits.argmin(1)[good]])


def moved(a, angle=0.0, scale=1.0, shift=(0, 0)):
    """A picture turned about its centre, made larger and shifted, and the matrix from it to the old one."""
    h, w = a.shape[:2]
    c = np.array([[1, 0, (w - 1) / 2], [0, 1, (h - 1) / 2], [0, 0, 1]])
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]]) / [[scale], [scale], [1]]
    back = c @ turn @ np.linalg.inv(c) + [[0, 0, shift[0]], [0, 0, shift[1]], [0, 0, 0]]
    return np.clip(np.rint(images.warp(a, back, 0, 0, w, h)), 0, 255).astype(np.uint8), back


@pytest.mark.parametrize("change", [dict(shift=(31, -17)), dict(angle=np.pi / 2), dict(angle=0.6), dict(scale=0.5), dict(angle=-1.1, scale=0.8, shift=(12, 9))])
def test_moved_pictures_match(change):
    a = scene()
    b, back = moved(a, **change)
    h, n = inliers(b, a)
    assert n >= 8
    at = np.array([[200.0, 150], [300, 250], [260, 210]])
    assert np.abs(images.apply(h, at) - images.apply(back, at)).max() < 3


def test_no_features():
    blank = np.full((200, 200, 3), 90, np.uint8)
    assert [len(v) for v in orb.features(blank)] == [0] * 4 and [len(v) for v in orb.features(scene()[:30, :30])] == [0] * 4
    assert [len(v) for v in orb.features(scene(), 100)] == [len(orb.features(scene(), 100)[0])] * 4 and 50 < len(orb.features(scene(), 100)[0]) <= 100
    assert inliers(scene(1), scene(2)) is None
    again = orb.features(scene())
    assert all((a == b).all() for a, b in zip(orb.features(scene()), again, strict=True))


def test_stitch_by_corners(spark):
    """From pictures to poses: overlapping cuts of one scene are found to be moved against each other as they were cut."""
    from test_operators import shots

    table = shots(spark, [(10.0, 106.0), (10.0, 106.0003), (10.0, 106.0006)])
    whole = scene(3, 256, 800)
    mpp = 80 / 8.8 * 13.2 / 384
    shift = 0.0003 * np.pi / 180 * 6378137 * np.cos(np.radians(10)) / mpp
    cuts = [round(k * shift) for k in range(3)]
    pictures = spark.createDataFrame([(k, 384, 256, whole[:, c : c + 384].tobytes()) for k, c in enumerate(cuts)] + [(9, 50, 50, bytes(7500))], "photo_id long, width long, height long, data binary")
    found = matching.orb_features(pictures)
    counts = {r.photo_id: r["count"] for r in found.groupBy("photo_id").count().collect()}
    assert set(counts) == {0, 1, 2} and all(100 < n <= 2000 for n in counts.values())
    points = stitch.orb_points(table, pictures)
    moves = points.groupBy("a", "b").agg(F.percentile(F.col("xa") - F.col("xb"), 0.5).alias("dx"), F.percentile(F.col("ya") - F.col("yb"), 0.5).alias("dy"), F.count("*").alias("n")).orderBy("a", "b").collect()
    assert [(m.a, m.b) for m in moves] == [(0, 1), (0, 2), (1, 2)]
    assert all(m.n >= 20 and abs(m.dx - (cuts[m.b] - cuts[m.a])) <= 1 and abs(m.dy) <= 1 for m in moves)
    got = stitch.stitch(table, pictures, points)
    assert got.edges.count() == 3 and got.edges.agg(F.min("inlier_count")).first()[0] >= 8
    with pytest.raises(ValueError):
        stitch.orb_points(table, pictures, "some")
