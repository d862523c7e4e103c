"""Photo tables: footprints, filters, flight order, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geodesy, images, metadata


def with_footprint(photos: DataFrame) -> DataFrame:
    """``photos`` with ``footprint``, a closed ring of five [lon, lat], null where anything it needs is missing or out of range."""
    cols = ("lat", "lon", "relative_altitude", "yaw_deg", "focal_mm", "sensor_width_mm", "sensor_height_mm")
    steps = geodesy.footprint_steps(*[F.col(c) for c in cols])
    for step in steps:
        photos = photos.withColumns(step)
    return photos.drop(*steps[0], *steps[1])


def with_blur(photos: DataFrame, threshold: float = 100.0) -> DataFrame:
    return photos.withColumn("is_blurry", metadata.is_blurry(F.col("blur_score"), threshold))


def located(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def missing_gps(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("lat").isNull() | F.col("lon").isNull())


def stitchable(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("footprint").isNotNull())


def blur_alerts(photos: DataFrame) -> DataFrame:
    """(flight_id, file_name, lat, lon, blur_score) of blurry photos with a position, and the sort_key where photos have one."""
    kept = [c for c in ("sort_key",) if c in photos.columns]
    return located(photos).where("is_blurry").select("flight_id", "file_name", "lat", "lon", "blur_score", *kept)


def flight_order(photos: DataFrame) -> DataFrame:
    """``photos`` with ``seq``: the place in the flight from 0, by sort_key and then file name."""
    order = Window.partitionBy("flight_id").orderBy("sort_key", "file_name")
    return photos.withColumn("seq", F.row_number().over(order) - 1)


def metrics(photos: DataFrame, gaps: DataFrame, covered: DataFrame) -> DataFrame:
    """One row for each flight: photos, with GPS, blurry, mean altitude, gaps and covered area."""
    base = photos.groupBy("flight_id").agg(
        F.count("*").alias("photo_count"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("photos_with_gps"),
        F.count_if("is_blurry").alias("blurry_count"),
        F.avg("relative_altitude").alias("avg_altitude"),
    )
    n = gaps.groupBy("flight_id").agg(F.count("*").alias("gap_count"))
    return base.join(n, "flight_id", "left").join(covered, "flight_id", "left").fillna({"gap_count": 0, "covered_area_m2": 0.0})


def sharpness(pictures: DataFrame) -> DataFrame:
    """(photo_id, blur_score) of ``pictures`` (photo_id, width, height, data: RGB bytes): the variance of the Laplacian of their grey values, for photos without a thumbnail.

    A null picture has a null score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if rgb is None else images.laplacian_variance(images.luma(rgb)) for rgb in images.unpacked(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["photo_id", "blur_score"])

    return pictures.select("photo_id", "width", "height", "data").mapInArrow(run, "photo_id long, blur_score double")


def downsampled(pictures: DataFrame, long_edge: int = images.LONG_EDGE) -> DataFrame:
    """``pictures`` (photo_id, width, height, data) at ``long_edge`` pixels on the longer side, by area; smaller ones and null ones stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, rgb in enumerate(images.unpacked(b)):
                if rgb is None:
                    yield b.slice(k, 1)
                    continue
                small = images.downsample(rgb, long_edge)
                sizes = [pa.array([n], pa.int64()) for n in (small.shape[1], small.shape[0])]
                yield pa.RecordBatch.from_arrays([b.slice(k, 1).column(0), *sizes, pa.array([np.ascontiguousarray(small).tobytes()], pa.binary())], ["photo_id", "width", "height", "data"])

    rows = pictures.select("photo_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "data")
    return rows.mapInArrow(run, "photo_id long, width long, height long, data binary")


def flight_bbox(photos: DataFrame) -> DataFrame:
    """The box of the located photos of each flight, not padded."""
    return located(photos).groupBy("flight_id").agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    )


def path_features(photos: DataFrame) -> DataFrame:
    """GeoJSON features: for each flight one line through its located photos in order, and a point for each of them.

    ``place`` orders the features of a flight: the line, then the points in flight order. A line is one value, so it is built from coordinates
    alone, a few bytes for each photo of the flight.
    """
    seen = flight_order(located(photos))
    at = F.array("lon", "lat")
    line = seen.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("seq", at.alias("at")))).alias("p"))
    lines = line.select(
        "flight_id",
        F.lit("LineString").alias("type"),
        F.to_json(F.transform("p", lambda p: p["at"])).alias("coordinates"),
        F.to_json(F.struct(F.lit("flightPath").alias("kind"))).alias("properties"),
        F.lit(0).cast("long").alias("place"),
    )
    points = seen.select(
        "flight_id",
        F.lit("Point").alias("type"),
        F.to_json(at).alias("coordinates"),
        F.to_json(F.struct(F.lit("photoPoint").alias("kind"), F.col("file_name").alias("fileName"), F.col("is_blurry").alias("isBlurry"))).alias("properties"),
        (F.col("seq") + 1).cast("long").alias("place"),
    )
    return lines.unionByName(points)


def footprint_features(photos: DataFrame) -> DataFrame:
    """A GeoJSON polygon for each photo with a footprint, in flight order by ``place``; photos without one are no part of the layer."""
    seen = flight_order(stitchable(photos))
    return seen.select(
        "flight_id", F.lit("Polygon").alias("type"), F.to_json(F.array("footprint")).alias("coordinates"),
        F.to_json(F.struct(F.lit("footprint").alias("kind"), F.col("file_name").alias("fileName"))).alias("properties"), F.col("seq").cast("long").alias("place"),
    )
