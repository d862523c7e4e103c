import random

import pytest
from pyspark.sql import functions as F

from aerialframe.functions import metadata
from aerialframe.operators import cameras
from aerialframe.sources import photos

SCHEMA = "needle string, sensor_width_mm double, sensor_height_mm double, place long"


def table(spark, rows):
    return spark.createDataFrame([(n, w, h, k) for k, (n, w, h) in enumerate(rows)], SCHEMA)


def test_same_as_the_built_in_cameras(spark):
    models = ["FC3305", "DJI FC6310R", "M3T", "xL1D-20c", "unknown", "", None, "M3TFC330", "fc330", "M3E M3T", "FC6540FC6310"] * 30
    df = spark.createDataFrame([(m,) for m in models], "model string").repartition(3)
    w, h = metadata.from_model(F.col("model"))
    both = df.select("model", w.alias("w"), h.alias("h"), cameras.by_camera(table(spark, metadata.CAMERAS))(F.col("model")).alias("c"))
    rows = both.collect()
    assert len(rows) == len(models) and all((r.c.sensor_width_mm, r.c.sensor_height_mm) == (r.w, r.h) for r in rows)
    assert sum(r.w is not None for r in rows) == 30 * 7


def test_many_needles(spark):
    """10,000 needles that hold each other, in any order: the first of the list that fits counts."""
    r = random.Random(1)
    needles = ["".join(r.choice("ABC") for _ in range(r.randrange(1, 12))) for _ in range(10_000)]
    rows = [(n, float(k), k / 2) for k, n in enumerate(needles)]
    models = ["".join(r.choice("ABCD") for _ in range(r.randrange(0, 25))) for _ in range(300)]
    look_up = cameras.by_camera(table(spark, rows).repartition(7))
    got = {x.model: x.place for x in spark.createDataFrame([(m,) for m in models], "model string").select("model", look_up(F.col("model"))["place"].alias("place")).collect()}
    assert got == {m: next((k for k, n in enumerate(needles) if n in m), None) for m in models}


def test_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame([("abc",), (None,)], "model string")
    place = lambda t: [x[0] for x in df.select(cameras.by_camera(t)(F.col("model"))["place"]).collect()]
    assert place(spark.createDataFrame([], SCHEMA)) == [None, None]
    assert place(spark.createDataFrame([(None, 1.0, 1.0, 0), ("b", None, 1.0, 1), ("b", 2.0, None, 2), ("b", 3.0, 3.0, 3), ("", 4.0, 4.0, 4)], SCHEMA)) == [2, None]
    assert place(spark.createDataFrame([("", 4.0, 4.0, 4), ("b", 3.0, 3.0, 9)], SCHEMA)) == [4, None]
    monkeypatch.setattr(cameras, "MOST_CAMERAS", 3)
    with pytest.raises(ValueError, match="3"):
        cameras.by_camera(table(spark, metadata.CAMERAS))


def test_photos_by_a_table(spark, tmp_path):
    from fixture_jpeg import photo

    (tmp_path / "a.jpg").write_bytes(photo(focal_35mm=None, model="NEW9"))
    heads = photos.headers(photos.scan(spark, str(tmp_path)))
    assert photos.parse(heads).first().sensor_width_mm is None
    row = photos.parse(heads, table(spark, [("NEW", 9.5, 7.5)])).first()
    assert (row.sensor_width_mm, row.sensor_height_mm) == (9.5, 7.5) and "used_camera_db_fallback" in row.warnings
