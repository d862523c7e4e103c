import numpy as np
import pytest
from fixture_jpeg import encode_grey, encode_progressive, photo
from pyspark.sql import functions as F

from aerialframe.functions import jpeg
from aerialframe.operators import coverage
from aerialframe.plans import inspect
from aerialframe.sources import photos, rasters
from aerialframe.streaming.ingest import ingest


@pytest.fixture(scope="module")
def flight(tmp_path_factory):
    """Six photos in a grid, the second blurry, one photo apart and one without GPS."""
    d = tmp_path_factory.mktemp("flight")
    for i in range(6):
        (d / f"DJI_{i:04}.{'JPG' if i % 2 else 'jpeg'}").write_bytes(photo(10 + 0.00014 * (i // 3), 106 + 0.00014 * (i % 3), taken=f"2024:05:01 10:00:0{i}", sharp=i != 1))
    (d / "sub").mkdir()
    (d / "isolated.jpg").write_bytes(photo(10.005, 106.005, yaw=45.0, taken="2024:05:01 10:00:09"))
    (d / "nogps.jpg").write_bytes(photo(gps=False))
    (d / "notes.txt").write_bytes(b"no photo")
    (d / "broken.jpg").write_bytes(b"\xff\xd8 nothing here")
    return str(d)


def test_headers():
    h = jpeg.read_header(photo(-10.5, 106.25, yaw=-12.5, extra_exif=[(0x9291, 2, "5")]))
    assert h["model"] == "FC6310" and h["focal_mm"] == 8.8 and h["focal_35mm"] == 24 and (h["pixel_x"], h["pixel_y"]) == (5472, 3648)
    assert h["lat_ref"] == "S" and h["lat_parts"][:2] == [10.0, 30.0] and h["taken"] == "2024:05:01 10:00:00" and h["subsec"] == "5"
    assert (h["frame_w"], h["frame_h"]) == (64, 48) and "GimbalYawDegree" in h["xmp"] and h["thumbnail"][:2] == b"\xff\xd8"
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II*\0\xff\xff\xff\xff", photo()[:200]):
        assert jpeg.read_header(bad)["xmp"] is None


def test_grey_decoder(spark, tmp_path):
    r = np.random.default_rng(0)
    grey = np.clip(np.add.outer(np.arange(45) * 3, np.arange(61) * 2) + r.normal(0, 9, (45, 61)), 0, 255).astype(np.uint8)
    data = encode_grey(grey, 2)
    ours = jpeg.decode_grey(data)
    assert ours.shape == grey.shape and np.abs(ours.astype(int) - grey).max() <= 6
    (tmp_path / "a.jpg").write_bytes(data)
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    other = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)[..., 0]
    assert np.abs(ours.astype(int) - other).max() <= 2
    assert jpeg.decode_grey(b"\xff\xd8\xff") is None and jpeg.decode_grey(data[:60]) is None


def test_progressive_decoder(spark, tmp_path):
    """The same picture stored both ways gives equal greys, and those of Java's decoder."""
    r = np.random.default_rng(1)
    for k, shape in enumerate(((45, 61), (8, 8), (120, 160))):
        grey = np.clip(np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) % 200 + r.normal(0, 20 * (k % 2) + 1, shape), 0, 255).astype(np.uint8)
        data = encode_progressive(grey, 3)
        ours = jpeg.decode_grey(data)
        assert ours.shape == grey.shape and (ours == jpeg.decode_grey(encode_grey(grey, 3))).all()
        (tmp_path / f"{k}.jpg").write_bytes(data)
        row = spark.read.format("image").load(str(tmp_path / f"{k}.jpg")).select("image.*").first()
        other = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1)[..., 0]
        assert np.abs(ours.astype(int) - other).max() <= 2
        for cut in range(10, len(data), 97):  # broken files give something or nothing, but no error
            jpeg.decode_grey(data[:cut])
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jpg").write_bytes(photo(encode=encode_progressive))
    (tmp_path / "p" / "b.jpg").write_bytes(photo())
    scores = {row.blur_score for row in photos.headers(photos.scan(spark, str(tmp_path / "p"))).collect()}
    assert len(scores) == 1 and None not in scores


def test_fronts_of_files(spark, tmp_path):
    """Of a large photo little is read; a lost file is a row with what went wrong."""
    names = {"small": photo(), "late": photo(padding=900_000), "a b%41 é": photo()}
    for name, data in names.items():
        (tmp_path / f"{name}.jpg").write_bytes(data + bytes(5_000_000))
    (tmp_path / "lost.jpg").write_bytes(photo())
    (tmp_path / "endless.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe2\xff\xfe" * 2_000_000)
    files = photos.scan(spark, str(tmp_path)).cache()
    assert files.count() == 5 and "content" not in files.columns
    (tmp_path / "lost.jpg").unlink()
    found = photos.headers(files)
    rows = {r.path.rsplit("/", 1)[1].removesuffix(".jpg"): r for r in found.collect()}
    assert rows["small"].bytes_read == rows["a b%41 é"].bytes_read == photos.FIRST_BYTES and 900_000 < rows["late"].bytes_read < 2_000_000 and rows["endless"].bytes_read == jpeg.HEADER_BYTES
    assert all(rows[k].has_exif and rows[k].xmp and rows[k].error is None for k in names)
    assert rows["lost"].error and not rows["lost"].has_exif and rows["lost"].bytes_read == 0
    assert [r.path.rsplit("/", 1)[1] for r in photos.unreadable(found).collect()] == ["lost.jpg"]
    assert {r.file_name: r.warnings[:1] for r in photos.parse(found).collect()}["lost.jpg"] == ["no_exif_data"]
    whole = {r.path: r.asDict() for r in photos.headers(photos.scan(spark, str(tmp_path), whole=True)).drop("bytes_read").collect()}
    fronts = {r.path: r.asDict() for r in found.drop("bytes_read").where("error is null").collect()}
    assert whole == fronts
    asked = []
    data = photo(padding=900_000)
    got = photos.front(lambda a, n: asked.append((a, n)) or data[a : a + n], len(data))
    assert jpeg.read_header(got) == jpeg.read_header(data) and len(asked) <= 6 and [a for a, _ in asked] == [sum(n for _, n in asked[:k]) for k in range(len(asked))]


def test_first_packet_counts():
    good = photo()
    bad = good[:2] + b"\xff\xe1" + (len(jpeg.XMP_SIGNATURE) + 4).to_bytes(2, "big") + jpeg.XMP_SIGNATURE + b"\xff\xfe" + good[2:]
    assert jpeg.read_header(good)["xmp"] and jpeg.read_header(bad)["xmp"] is None


def test_parsed_photos(spark, flight):
    rows = {r.file_name: r for r in photos.parse(photos.headers(photos.scan(spark, flight))).collect()}
    assert len(rows) == 9 and rows["broken.jpg"].warnings[0] == "no_exif_data"
    a = rows["DJI_0004.jpeg"]
    assert (a.lat, a.lon) == pytest.approx((10.00014, 106.00014), abs=1e-6) and a.relative_altitude == 80 and a.yaw_deg == 0 and a.sensor_width_mm == pytest.approx(13.2) and a.warnings == []
    lost = rows["nogps.jpg"]
    assert (lost.lat, lost.lon, lost.warnings, lost.relative_altitude) == (None, None, ["missing_gps"], 80)
    assert [n for n, r in rows.items() if r.is_blurry] == ["DJI_0001.JPG"] and rows["DJI_0001.JPG"].blur_score < 1


def test_inspection(spark, flight):
    got = inspect.inspect_directory(spark, flight, 3.0)
    table = got.photos.collect()
    assert sum(r.footprint is not None for r in table) == 7 and all(len(r.footprint) == 5 for r in table if r.footprint)
    order = [r.file_name for r in sorted(table, key=lambda r: r.seq)]
    assert order[1:7] == [f"DJI_{i:04}.{'JPG' if i % 2 else 'jpeg'}" for i in range(1, 6)] + ["isolated.jpg"] or order.index("isolated.jpg") > order.index("DJI_0005.JPG")
    counts = got.heatmap.select(F.get_json_object("properties", "$.overlapCount").cast("int").alias("n"))
    assert counts.agg(F.max("n")).first()[0] >= 3 and got.gaps.count() >= 1
    m = got.metrics.first()
    assert (m.photo_count, m.photos_with_gps, m.blurry_count, m.gap_count) == (9, 7, 1, got.gaps.count())
    assert [r.file_name for r in got.blur_alerts.collect()] == ["DJI_0001.JPG"]
    assert got.flight_path.groupBy("type").count().orderBy("type").collect()[0][1] == 1
    assert coverage.by_area(got.gaps).first().area_m2 == got.gaps.agg(F.max("area_m2")).first()[0]


def test_nothing_to_inspect(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"")
    with pytest.raises(inspect.InspectionError, match="JPEG"):
        inspect.inspect_directory(spark, str(tmp_path))
    (tmp_path / "a.jpg").write_bytes(photo(gps=False))
    with pytest.raises(inspect.InspectionError, match="GPS"):
        inspect.inspect_directory(spark, str(tmp_path))


def test_stream(spark, flight, tmp_path):
    out = str(tmp_path / "table")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, flight, out, str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 9


def test_pictures(spark, flight):
    rows = photos.pictures(spark, flight).collect()
    assert len(rows) == 8 and {(r.width, r.height, len(r.data)) for r in rows} == {(64, 48, 64 * 48 * 3)}


def test_raster_files():
    import struct

    rgb = np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    t = rasters.geotiff(rgb, 106.0, 10.0, 1e-6, 2e-6)
    at = struct.unpack_from("<I", t, 4)[0]
    n = struct.unpack_from("<H", t, at)[0]
    tags = {struct.unpack_from("<H", t, at + 2 + 12 * i)[0]: struct.unpack_from("<HII", t, at + 4 + 12 * i) for i in range(n)}
    assert tags[256][2] == 30 and tags[257][2] == 20 and t[tags[273][2] :][:1800] == rgb.tobytes() and list(tags) == sorted(tags)
    assert struct.unpack_from("<3d", t, tags[33550][2])[:2] == (1e-6, 2e-6) and struct.unpack_from("<6d", t, tags[33922][2])[3:5] == (106.0, 10.0)
    assert struct.unpack_from("<16H", t, tags[34735][2])[-1] == 4326
    assert rasters.png(rgb)[:8] == b"\x89PNG\r\n\x1a\n"
    lon, lat, dx, dy = rasters.georeference(0.0, 0.0, 1.0, 10.0, 106.0)
    assert (lon, lat) == (106.0, 10.0) and dx > dy > 0
