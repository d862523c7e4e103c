import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.operators import basemap, coverage, matching, mosaic, neighbors, photos, registration
from aerialframe.plans import stitch

COLUMNS = "flight_id long, photo_id long, file_name string, lat double, lon double, relative_altitude double, yaw_deg double, focal_mm double, sensor_width_mm double, sensor_height_mm double, image_width_px long, image_height_px long, blur_score double"


def shots(spark, places, flight=1, altitude=80.0):
    rows = [(flight, i, f"p{i}.jpg", lat, lon, altitude, 0.0, 8.8, 13.2, 8.8, 1920, 1280, 50.0 * i) for i, (lat, lon) in enumerate(places)]
    return photos.with_blur(photos.with_footprint(spark.createDataFrame(rows, COLUMNS)))


def rings(spark, squares):
    """Photos whose footprints are given squares (lon, lat, side)."""
    rows = [(1, i, [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]) for i, (x, y, s) in enumerate(squares)]
    return spark.createDataFrame(rows, "flight_id long, photo_id long, footprint array<array<double>>")


def cover(table, cell):
    grids = coverage.grid(table, cell)
    counts = coverage.cells(table, grids)
    return grids, counts


def test_five_squares_overlap(spark):
    _, counts = cover(rings(spark, [(106 + 0.0002 * i, 10.0, 0.0009) for i in range(5)]), 5.0)
    assert counts.agg(F.max("overlap_count")).first()[0] == 5


def test_a_single_square_is_one_gap(spark):
    grids, counts = cover(rings(spark, [(106.0, 10.0, 0.001)]), 5.0)
    gaps = coverage.gaps(counts, grids).collect()
    assert len(gaps) == 1 and gaps[0].cell_count == counts.count() and gaps[0].area_m2 == pytest.approx(25 * gaps[0].cell_count)
    assert coverage.covered_area(counts, grids).first().covered_area_m2 == gaps[0].area_m2


def test_gaps_against_flood_fill(spark):
    r = np.random.default_rng(0)
    cells = {(int(a), int(b)): int(r.integers(1, 5)) for a, b in r.integers(0, 25, (400, 2))}
    counts = spark.createDataFrame([(1, a, b, n) for (a, b), n in cells.items()], "flight_id long, row long, col long, overlap_count long")
    grids = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 1.0, 25, 25)], "flight_id long, lon0 double, lat0 double, cell_m double, cell_lon double, cell_lat double, cols long, rows long")
    red, seen, want = {k for k, n in cells.items() if n < 3}, set(), []
    for start in sorted(red):
        if start in seen:
            continue
        stack, part = [start], set()
        while stack:
            c = stack.pop()
            if c in red and c not in part:
                part.add(c)
                stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        seen |= part
        want.append((len(want), len(part), sum(p[0] + 0.5 for p in part) / len(part)))
    got = [(g.id, g.cell_count, g.lat) for g in coverage.gaps(counts, grids).orderBy("id").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    areas = [g.area_m2 for g in coverage.by_area(coverage.gaps(counts, grids)).collect()]
    assert areas == sorted(areas, reverse=True)


def test_grids_coarsen(spark):
    g = coverage.grid(rings(spark, [(106.0, 10.0, 0.001), (106.5, 10.5, 0.001)]), 3.0).first()
    assert g.cols * g["rows"] <= coverage.MAX_CELLS < g.cols * g["rows"] * 2.3 and g.cell_m > 3
    assert coverage.grid(rings(spark, [(106.0, 10.0, 0.0001)]), 0.1).first().cell_m == 0.5
    assert coverage.grid(rings(spark, []), 3.0).count() == 0


def test_neighbours(spark):
    near = shots(spark, [(10.0, 106.0), (10.00014, 106.0), (10.006, 106.0)])
    radii = near.select("flight_id").distinct().select("flight_id", F.lit(50.0).alias("radius_m"), F.lit(10.0).alias("mid_lat"))
    assert [(r.a, r.b) for r in neighbors.within_radius(near, radii).collect()] == [(0, 1)]
    same = shots(spark, [(10.0, 106.0), (10.0, 106.0)])
    pair = spark.createDataFrame([(1, 0, 1)], "flight_id long, a long, b long")
    assert neighbors.overlap(pair, same).first().overlap == pytest.approx(1)
    assert neighbors.overlap(pair, same.withColumn("footprint", F.when(F.col("photo_id") == 0, F.col("footprint")))).first().overlap == float("inf")
    grid = shots(spark, [(10 + 0.00014 * i, 106 + 0.00014 * j) for i in range(5) for j in range(5)])
    per = lambda k: max(r["count"] for r in neighbors.neighbor_pairs(grid, k).select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").count().collect())
    assert per(10) <= 24 and per(None) > 20


def test_strongest_is_a_union(spark):
    rows = [(1, 0, 1, 0.9), (1, 0, 2, 0.8), (1, 0, 3, 0.7), (1, 1, 2, 0.95), (1, 1, 3, 0.6), (1, 2, 3, 0.65)]
    df = spark.createDataFrame(rows, "flight_id long, a long, b long, overlap double")
    assert {(r.a, r.b) for r in neighbors.strongest(df, 1).collect()} == {(0, 1), (1, 2), (0, 3)}
    assert neighbors.strongest(df, None).count() == 6


def test_matching(spark):
    feats = spark.createDataFrame([(0, 0, [0, 0]), (0, 1, [1, 2**63 - 1]), (1, 0, [0, 0]), (1, 1, [-1, -1]), (2, 0, [0, 0])], "photo_id long, idx long, descriptor array<long>")
    pairs = spark.createDataFrame([(7, 0, 1), (8, 0, 2)], "pair long, a long, b long")
    got = {(r.pair, r.query_idx, r.train_idx, r.distance) for r in matching.knn_ratio(pairs, feats).collect()}
    assert (7, 0, 0, 0) in got and all(p == 7 for p, *_ in got)
    scores = spark.createDataFrame([(0, i, s) for i, s in enumerate((0.1, 0.9, 0.3, 0.5))], "photo_id long, idx long, score double")
    assert [r.idx for r in matching.cap_keypoints(scores, 2).orderBy(F.desc("score")).collect()] == [1, 3]
    m = spark.createDataFrame([(7, 1, 0, 0.2), (7, 0, 0, 0.19)], "pair long, query_idx long, train_idx long, confidence double")
    assert matching.confident(m).count() == 1
    keys = spark.createDataFrame([(0, [(1.0, 2.0), (3.0, 4.0)]), (1, [(5.0, 6.0)])], "photo_id long, keypoints array<struct<x:double,y:double>>")
    r = matching.point_pairs(matching.confident(m), pairs, keys).first()
    assert (r.xa, r.ya, r.xb, r.yb) == (3, 4, 5, 6)


def test_tiles(spark):
    boxes = spark.createDataFrame([(1, 18.6, 49.4, 18.9, 49.6)], "flight_id long, min_lon double, min_lat double, max_lon double, max_lat double")
    counts = {r.z: r.tiles for r in basemap.tile_counts(boxes, 14).collect()}
    assert counts[0] == 1 and sum(counts.values()) == 327 and all(counts[z] <= counts[z + 1] for z in range(14))
    basemap.check(boxes, 14)
    with pytest.raises(ValueError, match="zoom"):
        basemap.check(boxes, 16)
    wide = spark.createDataFrame([(1, -180.0, -85.0, 180.0, 85.0)], boxes.schema)
    with pytest.raises(ValueError, match="tiles"):
        basemap.check_count(wide, 10)
    assert basemap.check_count(boxes, 14) == 327
    rows = [tuple(r)[1:] for r in basemap.in_order(basemap.tiles(boxes, 11)).collect()]
    assert rows == sorted(rows)
    assert basemap.without_world(basemap.tiles(boxes, 2)).where("z = 0").count() == 0


def test_fetching(spark, tmp_path):
    from aerialframe.sources import rasters

    asked = spark.createDataFrame([(1, x, 0) for x in range(6)], "z int, x long, y long")

    def get(z, x, y):
        return [(200, b"ab"), (404, b""), (401, b""), (500, b""), (200, b"c"), (204, b"")][x]

    found = basemap.fetch(asked, get, sleep=lambda s: None)
    assert [r.status for r in found.orderBy("x").collect()] == ["ok", "missing", "failed", "failed", "ok", "missing"]
    assert tuple(basemap.summary(found).first()) == (2, 2, 3)
    rasters.write_tiles(found, str(tmp_path / "t"))
    assert {(r.z, r.x, bytes(r.data)) for r in rasters.read_tiles(spark, str(tmp_path / "t")).collect()} == {(1, 0, b"ab"), (1, 4, b"c")}
    with pytest.raises(basemap.Refused):
        basemap.fetch(asked, lambda z, x, y: (403, b""))
    assert [basemap.backoff(i) for i in range(6)] == [0.25, 0.5, 1, 2, 4, 4]


def test_reuse_of_a_basemap(spark):
    flight = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0)], "flight_id long, min_lon double, min_lat double, max_lon double, max_lat double")
    cached = lambda failed, zoom, lon: spark.createDataFrame([(lon, 0.0, 3.0, 3.0, failed, zoom)], "c_min_lon double, c_min_lat double, c_max_lon double, c_max_lat double, tiles_failed long, max_zoom int")
    assert [basemap.reusable(flight, cached(*c)).count() for c in ((0, 12, 0.0), (1, 12, 0.0), (0, 11, 0.0), (0, 12, 1.5))] == [1, 0, 0, 0]


def test_stitching_two_photos(spark):
    """Two overlapping pictures of one scene come out as the scene."""
    table = shots(spark, [(10.0, 106.0), (10.0, 106.0003)]).withColumn("sort_key", F.col("photo_id"))
    scene = (np.indices((1280, 2600)).sum(0) // 40 % 2 * 120 + 60).astype(np.uint8)
    mpp = 80 / 8.8 * 13.2 / 192
    shift = 0.0003 * np.pi / 180 * 6378137 * np.cos(np.radians(10)) / mpp
    px = [np.repeat(scene[:128, int(round(s)) : int(round(s)) + 192, None], 3, 2) for s in (0, shift)]
    pictures = spark.createDataFrame([(i, 192, 128, p.tobytes()) for i, p in enumerate(px)], "photo_id long, width long, height long, data binary")
    s = int(round(shift))
    pts = [(1, 0, 1, float(x), float(y), float(x - s), float(y)) for x in range(s, 190, 9) for y in range(5, 120, 25)]
    points = spark.createDataFrame(pts, "flight_id long, a long, b long, xa double, ya double, xb double, yb double")
    got = stitch.stitch(table, pictures, points)
    assert got.edges.count() == 1 and got.poses.count() == 2 and got.warnings.count() == 0
    c = got.canvases.first()
    assert abs(c.out_w - (192 + s)) <= 2 and abs(c.out_h - 128) <= 2
    out = np.zeros((c.out_h, c.out_w, 3), np.uint8)
    for t in got.tiles.collect():
        out[t.tile_y * 256 : t.tile_y * 256 + t.height, t.tile_x * 256 : t.tile_x * 256 + t.width] = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 3)
    assert abs(out[20:100, 20:-20].astype(int) - scene[20:100, 20 : out.shape[1] - 20, None]).mean() < 25
    with pytest.raises(stitch.StitchError):
        stitch.stitch(table.where("photo_id = 0"), pictures, points)
    with pytest.raises(ValueError):
        stitch.candidate_pairs(table, "some")
    assert stitch.candidate_pairs(table, "uncapped").count() == 1
    one = mosaic.compose(mosaic.covered_tiles(mosaic.bounds(got.poses.where("photo_id = 0").join(pictures.select("photo_id", "width", "height"), "photo_id")), got.canvases, 64), pictures, 64)
    assert one.count() >= 6


@pytest.mark.parametrize("kind", ["spread", "nested"])
def test_containment_against_all_pairs(spark, kind):
    """10,000 boxes in 10,000 boxes, without a nested loop; points, lines, edges in common, the whole world and the date line included."""
    r = np.random.default_rng(len(kind))
    n = 10_000

    def some(most):
        x, y = r.uniform(-180, 180, n), r.uniform(-90, 90, n)
        if kind == "nested":
            x, y = np.round(x / 10) * 10, np.round(y / 10) * 10
        w, h = (np.where(r.random(n) < 0.05, 0, 2.0 ** r.uniform(-12, most, n)) for _ in "xy")
        return np.stack([x, y, np.minimum(x + w, 180), np.minimum(y + h, 90)], 1)

    outer, inner = some(3), some(1)
    inner[:50], inner[50] = outer[:50], [-180, -90, 180, 90]
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    flights = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(inner)] + [(n, None, 0.0, 1.0, 1.0)], "flight_id long, " + ", ".join(f"{c} double" for c in names))
    cached = spark.createDataFrame([(*map(float, b), int(i % 7 == 6), 11 + i % 3) for i, b in enumerate(outer)], ", ".join(f"c_{c} double" for c in names) + ", tiles_failed int, max_zoom int")
    good = outer[[i % 7 != 6 and i % 3 > 0 for i in range(n)]]
    want = {i for i, b in enumerate(inner) if ((good[:, :2] <= b[:2]).all(1) & (good[:, 2:] >= b[2:]).all(1)).any()}
    found = basemap.reusable(flights, cached)
    got = [x.flight_id for x in found.collect()]
    assert len(got) == len(want) > 30 and set(got) == want and found.columns == flights.columns
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


class TileServer:
    """Counts the requests that are open at once; tiles of column 3 fail, of column 4 are refused, of column 5 come by drops, of column 6 break off."""

    def __init__(self):
        import http.server
        import threading
        import time

        self.open = self.most = self.asked = 0
        lock, own = threading.Lock(), self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                z, x, _ = map(int, self.path.strip("/").split("/"))
                with lock:
                    own.open, own.asked = own.open + 1, own.asked + 1
                    own.most = max(own.most, own.open)
                try:
                    time.sleep(0.02)
                    code = own.world if z == 0 else {3: 503, 4: 403, 2: 404}.get(x, 200)
                    self.send_response(code)
                    if x == 6:
                        self.send_header("Content-Length", "99")
                    self.end_headers()
                    for _ in range(40 if x == 5 else 1):
                        self.wfile.write(self.path.encode())
                        self.wfile.flush()
                        if x == 5:
                            time.sleep(0.05)
                except OSError:
                    pass
                finally:
                    with lock:
                        own.open -= 1

            def log_message(self, *args):
                pass

        self.world = 200
        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/{{z}}/{{x}}/{{y}}"


def test_requests_of_the_cluster(spark):
    server = TileServer()
    try:
        asked = spark.createDataFrame([(9, x % 8, y) for x in range(8) for y in range(40)], "z int, x long, y long").where("x <> 5 or y = 1")
        get = basemap.http_get(server.url, idle_s=1.0, total_s=0.5)
        got = basemap.fetch(asked, get, sleep=lambda s: None, open_requests=12).collect()
        status = {(r.x, r.status) for r in got}
        assert status == {(0, "ok"), (1, "ok"), (2, "missing"), (3, "failed"), (4, "failed"), (5, "failed"), (6, "failed"), (7, "ok")} and len(got) == 7 * 40 + 1
        assert all(bytes(r.data) == f"/9/{r.x}/{r.y}".encode() for r in got if r.status == "ok")
        assert 1 < server.most <= 12
        for world, error in ((403, basemap.Refused), (500, OSError)):
            server.world, before = world, server.asked
            with pytest.raises(error):
                basemap.fetch(asked, get)
            assert server.asked == before + 1
    finally:
        server.server.shutdown()
    with pytest.raises(OSError):
        basemap.fetch(asked, basemap.http_get("http://127.0.0.1:9/{z}/{x}/{y}", idle_s=0.2))


def test_poses(spark):
    table = shots(spark, [(10.0, 106.0), (10.0, 106.0003)])
    placed = registration.placements(table)
    empty = spark.createDataFrame([], "flight_id long, a long, b long, h array<double>")
    moved = registration.align(placed, empty).join(placed.select("photo_id", F.col("east").alias("e0")), "photo_id").select(F.abs(F.col("east") - F.col("e0")).alias("d"))
    assert moved.agg(F.max("d")).first()[0] < 1e-3
    assert registration.placements(table.withColumn("relative_altitude", F.lit(None).cast("double"))).count() == 0
    assert registration.mean_gsd(table.withColumn("focal_mm", F.when(F.col("photo_id") == 0, 8.8))).first().meters_per_pixel is None
    edge = spark.createDataFrame([(1, 0, 1, [1.0] * 9, 8, 20), (1, 1, 2, [1.0] * 9, 10, 20)], "flight_id long, a long, b long, h array<double>, inlier_count long, match_count long")
    assert registration.weak_edges(edge).count() == 1


def test_basemap_info(spark, tmp_path):
    from aerialframe.sources import rasters

    path = str(tmp_path / "tiles")
    assert basemap.info(spark, path) is None
    asked = spark.createDataFrame([(1, x, 0) for x in range(3)], "z int, x long, y long")
    fetched = basemap.fetch(asked, lambda z, x, y: (200, b"ab") if x < 2 else (404, b""))
    box = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    basemap.write_info(fetched, box, 12, path)
    assert basemap.info(spark, path) is None
    rasters.write_tiles(fetched, path)
    r = basemap.info(spark, path).first()
    assert (r.c_min_lon, r.c_max_lat, r.max_zoom, r.tile_count, r.tiles_failed, r.bytes) == (1, 4, 12, 2, 0, 4) and "T" in r.downloaded_at


def test_queries_against_sql(spark):
    """Every query that has SQL gives the same rows as DuckDB at the smallest scale."""
    import duckdb

    from aerialframe import catalog

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "embeddings", "pages", "documents", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    key = lambda row: tuple((v is None, str(v)) for v in row)
    for name, sql in catalog.ORACLES.items():
        want = con.sql(sql)
        order = sorted(want.columns)
        got = catalog.QUERIES[name](spark, d).select(*order).collect()
        rows = [tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()]
        assert sorted(map(tuple, got), key=key) == sorted(rows, key=key), name


def test_pairs_that_share_too_little_are_left_out_before_they_are_clipped(spark):
    """The same pairs as clipping all that are near, turned photos and one without a footprint among them; what is clipped is less."""
    r = np.random.default_rng(3)
    rows = [(1, i, 10 + float(r.uniform(0, 0.002)), 106 + float(r.uniform(0, 0.002)), None if i == 7 else 60.0, float(r.uniform(-180, 180)), 8.8, 13.2, 8.8) for i in range(120)]
    table = photos.with_footprint(spark.createDataFrame(rows, "flight_id long, photo_id long, lat double, lon double, relative_altitude double, yaw_deg double, focal_mm double, sensor_width_mm double, sensor_height_mm double"))
    radii = neighbors.radius(table)
    every = neighbors.overlaps_within(table, radii).collect()
    want = {(p.a, p.b): p.overlap for p in every if p.overlap > 0.3}
    got = {(p.a, p.b): p.overlap for p in neighbors.overlaps_within(table, radii, 0.3).collect()}
    assert got == want and 0 < len(want) < len(every) and math.inf in want.values()
    assert neighbors._near(neighbors._known(table, neighbors._ring()), radii, [*neighbors.RING, "lat", "lon"]).where(neighbors._may_overlap(0.3)).count() < len(every)


def test_alignment_of_one_matrix_and_by_gradients(spark, monkeypatch):
    """Both ways of solving agree; edges of pictures that are not placed, an edge of a picture with itself and a flight without edges among them."""
    from aerialframe.functions import images

    r = np.random.default_rng(4)
    placed = [(f, i, 30.0 * (i % 5), 30.0 * (i // 5), 0.1 * float(r.normal()), 0.02, 1920.0, 1280.0) for f in (1, 2) for i in range(20)]
    edges = [(1, i, j, np.array([[1, 0, -600.0 * (j - i) + r.normal()], [0, 1, r.normal()], [0, 0, 1]]).ravel().tolist()) for i, j in ((0, 1), (1, 2), (3, 4), (5, 6), (2, 2), (8, 99), (-1, 3))]
    p = spark.createDataFrame(placed, "flight_id long, photo_id long, east double, north double, theta double, scale double, width double, height double")
    e = spark.createDataFrame(edges, "flight_id long, a long, b long, h array<double>")
    found = []
    for most in (160, 0):
        monkeypatch.setattr(images, "DENSE", most)
        known = [(a, b, np.array(h).reshape(3, 3), 1920.0, 1280.0) for _, a, b, h in edges if 0 <= a < 20 and b < 20]
        x = np.array([v[2:5] for v in placed[:20]])
        found.append(images.align(x, np.full(20, 0.02), np.tile([960.0, 640.0], (20, 1)), known))
    assert np.allclose(*found, atol=1e-8) and np.abs(found[0] - x).max() > 0.01
    rows = registration.align(p, e).orderBy("flight_id", "photo_id").collect()
    assert np.allclose([[q.east, q.north, q.theta] for q in rows[:20]], found[0], atol=1e-8) and np.allclose([q.east for q in rows[20:]], [v[2] for v in placed[20:]])
    assert np.allclose(np.reshape(rows[3].pose, (3, 3)), images.similarity_matrix(*found[0][3], 0.02, 960, 640))
