"""Files of ordered pieces, and what is written through them; read back by readers of their own."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.operators import mosaic
from aerialframe.plans import stitch
from aerialframe.sources import files, rasters


def read_png(data: bytes) -> np.ndarray:
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    w, h = struct.unpack(">II", chunks[0][1][:8])
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), np.uint8).reshape(h, 1 + 3 * w)
    assert not raw[:, 0].any()
    return raw[:, 1:].reshape(h, w, 3)


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    big = struct.unpack("<H", data[2:4])[0] == 43
    word, room, kinds = ("Q", 8, {3: "H", 4: "I", 12: "d", 16: "Q"}) if big else ("I", 4, {3: "H", 4: "I", 12: "d"})
    ifd = struct.unpack("<Q", data[8:16])[0] if big else struct.unpack("<I", data[4:8])[0]
    n, at = (struct.unpack("<Q", data[ifd : ifd + 8])[0], ifd + 8) if big else (struct.unpack("<H", data[ifd : ifd + 2])[0], ifd + 2)
    tags = {}
    for _ in range(n):
        tag, kind, count = struct.unpack(f"<HH{word}", data[at : at + 4 + room])
        size = struct.calcsize(f"<{count}{kinds[kind]}")
        start = at + 4 + room if size <= room else struct.unpack(f"<{word}", data[at + 4 + room : at + 4 + 2 * room])[0]
        tags[tag] = struct.unpack(f"<{count}{kinds[kind]}", data[start : start + size])
        at += 4 + 2 * room
    w, h = tags[256][0], tags[257][0]
    pixels = b"".join(data[a : a + s] for a, s in zip(tags[273], tags[279], strict=True))
    return (np.frombuffer(pixels, np.uint8).reshape(h, w, 3) if len(pixels) == 3 * w * h else None), tags


def test_pieces(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"d{k % 7}/f{k % 7}", k, b"%d," % k) for k in range(1000)] + [("last", -1, b"x" * 3_000_000), ("last", 2, b""), ("last", 1, b"y")]
    df = spark.createDataFrame(rows, files.PIECES).repartition(9)
    for _ in range(2):  # a second run replaces the files
        files.write_pieces(df, path)
        for k in range(7):
            assert (tmp_path / "out" / f"d{k}" / f"f{k}").read_bytes() == b"".join(b"%d," % x for x in range(k, 1000, 7))
        assert (tmp_path / "out" / "last").read_bytes() == b"x" * 3_000_000 + b"y"
        assert sorted(os.listdir(path)) == [*[f"d{k}" for k in range(7)], "last"]
    files.write_pieces(df.limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")


def test_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(400).select(F.format_string("f%d", F.col("id") % 40).alias("name"), "id", F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("data"))
    with pytest.raises(Exception, match="lost"):
        files.write_pieces(bad.withColumnRenamed("id", "seq"), str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad") or os.listdir(tmp_path / "bad") == []
    with pytest.raises(Exception, match="sorted"):
        files.save_sorted(spark.createDataFrame([("a", 2, b""), ("a", 1, b"")], files.PIECES).coalesce(1), str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad") or os.listdir(tmp_path / "bad") == []


def test_rasters_of_two_flights(spark, tmp_path):
    """The files hold the pixels of compose, tile by tile, and black elsewhere."""
    r = np.random.default_rng(2)
    sizes = {1: (700, 530), 2: (90, 40), 3: (300, 300)}
    canvases = spark.createDataFrame([(k, -10.0 * k, 20.0, 0.05, w, h) for k, (w, h) in sizes.items()], "flight_id long, origin_east double, origin_north double, meters_per_pixel double, out_w long, out_h long")
    want, tiles = {k: np.zeros((h, w, 3), np.uint8) for k, (w, h) in sizes.items()}, []
    for k, x, y in [(1, 0, 0), (1, 2, 0), (1, 1, 2), (2, 0, 0)]:  # a row of tiles and a whole raster are empty
        w, h = min(256, sizes[k][0] - 256 * x), min(256, sizes[k][1] - 256 * y)
        px = r.integers(0, 256, (h, w, 3), np.uint8)
        want[k][256 * y : 256 * y + h, 256 * x : 256 * x + w] = px
        tiles.append((k, x, y, w, h, px.tobytes()))
    tiles = spark.createDataFrame(tiles, "flight_id long, tile_x long, tile_y long, width long, height long, data binary")
    origins = spark.createDataFrame([(k, 10.0, 106.0) for k in sizes], "flight_id long, lat0 double, lon0 double")
    rasters.write_rasters(tiles, canvases, origins, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}{end}" for k in sizes for end in (".tif", ".preview.png"))
    for k, px in want.items():
        got, tags = read_tiff((tmp_path / f"{k}.tif").read_bytes())
        assert (got == px).all() and (read_png((tmp_path / f"{k}.preview.png").read_bytes()) == px).all()
        lon, lat, dx, dy = rasters.georeference(-10.0 * k, 20.0, 0.05, 10.0, 106.0)
        assert tags[33550] == (dx, dy, 0.0) and tags[33922] == (0.0, 0.0, 0.0, lon, lat, 0.0) and tags[34735][-1] == 4326


def test_files_of_a_stitch(spark, tmp_path):
    from test_operators import shots

    flights = [shots(spark, [(10.0, 106.0), (10.0, 106.0003), (10.0, 106.0006)], flight=f) for f in (1, 2)]
    table = flights[0].union(flights[1].withColumn("photo_id", F.col("photo_id") + 10))
    r = np.random.default_rng(1)
    scene = r.integers(0, 256, (128, 192, 3), np.uint8).tobytes()
    pictures = spark.createDataFrame([(i, 192, 128, scene) for i in (0, 1, 10, 11)], "photo_id long, width long, height long, data binary")
    points = spark.createDataFrame([], "flight_id long, a long, b long, xa double, ya double, xb double, yb double")
    result = stitch.stitch(table, pictures, points)
    assert sorted(map(tuple, result.counts.collect())) == [(1, 2, 1, 0), (2, 2, 1, 0)]
    done = stitch.export(result, str(tmp_path)).collect()
    assert len(done) == 2 and all(d.duration_ms > 0 and d.photos_skipped == 1 and len(d.preview_corners) == 4 for d in done)
    for d in done:
        c = result.canvases.where(F.col("flight_id") == d.flight_id).first()
        want = np.zeros((c.out_h, c.out_w, 3), np.uint8)
        for t in result.tiles.where(F.col("flight_id") == d.flight_id).collect():
            y, x = t.tile_y * mosaic.TILE, t.tile_x * mosaic.TILE
            want[y : y + t.height, x : x + t.width] = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 3)
        with open(d.geotiff_path, "rb") as tif, open(d.preview_path, "rb") as preview:
            got, tags = read_tiff(tif.read())
            assert want.any() and (got == want).all() and (read_png(preview.read()) == want).all()
        assert np.allclose(tags[33922][3:5], d.preview_corners[0], atol=1e-12)


def test_large_headers():
    small = rasters.geotiff_header(1000, 1000, 256, 1.0, 2.0, 3.0, 4.0)
    large = rasters.geotiff_header(60_000, 50_000, 256, 1.0, 2.0, 3.0, 4.0)
    for head, w, h in ((small, 1000, 1000), (large, 60_000, 50_000)):
        _, tags = read_tiff(head)
        assert (tags[256][0], tags[257][0]) == (w, h) and tags[273][0] == len(head) and sum(tags[279]) == 3 * w * h
        assert all(a + n == b for a, n, b in zip(tags[273], tags[279], tags[273][1:], strict=False))
    assert small[2] == 42 and large[2] == 43


def test_joined_checksums():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 256, 100_000, np.uint8).tobytes(), r.integers(0, 256, 7777, np.uint8).tobytes()
    assert rasters.adler_joined(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert rasters.adler_joined(1, zlib.adler32(b), len(b)) == zlib.adler32(b)
