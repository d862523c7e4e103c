"""A photo table made from the events table: one serpentine flight of 10 x 10 photos for each 100 events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators.photos import with_blur, with_footprint


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos without footprints; about one in 25 has no position. See ORACLE for the same rows in SQL."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", "event_type")
    r = F.floor((F.col("event_id") % 100) / 10)
    c0 = F.col("event_id") % 10
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    g = e.select(F.col("event_id").alias("photo_id"), F.floor(F.col("event_id") / 100).alias("flight_id"), "ts", "value", lost.alias("lost"), r.alias("r"), F.when(r % 2 == 0, c0).otherwise(9 - c0).alias("c"))
    lat = 10.0 + F.col("flight_id") * 0.01 + F.col("r") * 0.00025 + F.col("value") * 0.00000001
    lon = 106.0 + F.col("c") * 0.00035 + F.col("value") * 0.00000002
    return g.select(
        "photo_id", "flight_id", F.col("ts").alias("capture_ts"),
        F.concat(F.lit("DJI_"), F.lpad(F.col("photo_id").cast("string"), 7, "0"), F.lit(".JPG")).alias("file_name"),
        F.when(~F.coalesce("lost", F.lit(False)), lat).alias("lat"), F.when(~F.coalesce("lost", F.lit(False)), lon).alias("lon"),
        (60.0 + F.col("photo_id") % 7).alias("relative_altitude"),
        (F.when(F.col("r") % 2 == 0, 0.0).otherwise(180.0) + F.col("photo_id") % 11 - 5).alias("yaw_deg"),
        F.lit(8.8).alias("focal_mm"), F.lit(13.2).alias("sensor_width_mm"), F.lit(8.8).alias("sensor_height_mm"),
        F.lit(5472).cast("long").alias("image_width_px"), F.lit(3648).cast("long").alias("image_height_px"),
        (F.col("value") * 20).alias("blur_score"),
    )


def inspected(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """The same with footprint and is_blurry, and with sort_key if ``ordered``."""
    p = photos(spark, sf_dir)
    if ordered:
        taken = metadata.capture_millis(F.date_format("capture_ts", "yyyy:MM:dd HH:mm:ss"), F.date_format("capture_ts", "SSS"))
        p = p.withColumn("sort_key", metadata.capture_key(taken, metadata.filename_sequence(F.col("file_name")), F.lit(None).cast("long")))
    return with_blur(with_footprint(p))


ORACLE = """b AS (
  SELECT event_id AS photo_id, ts, value, event_type, CAST(floor(event_id / 100.0) AS BIGINT) AS flight_id,
         CAST(floor((event_id % 100) / 10.0) AS BIGINT) AS r, event_id % 10 AS c0
  FROM events
), g AS (SELECT *, CASE WHEN r % 2 = 0 THEN c0 ELSE 9 - c0 END AS c, coalesce(event_type = 'error' AND photo_id % 5 = 0, false) AS lost FROM b),
photos AS (
  SELECT photo_id, flight_id, ts AS capture_ts, concat('DJI_', lpad(CAST(photo_id AS VARCHAR), 7, '0'), '.JPG') AS file_name,
    CASE WHEN NOT lost THEN CAST(10.0 AS DOUBLE) + flight_id * CAST(0.01 AS DOUBLE) + r * CAST(0.00025 AS DOUBLE) + value * CAST(0.00000001 AS DOUBLE) END AS lat,
    CASE WHEN NOT lost THEN CAST(106.0 AS DOUBLE) + c * CAST(0.00035 AS DOUBLE) + value * CAST(0.00000002 AS DOUBLE) END AS lon,
    CAST(60.0 AS DOUBLE) + photo_id % 7 AS relative_altitude,
    CASE WHEN r % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(180.0 AS DOUBLE) END + photo_id % 11 - 5 AS yaw_deg,
    CAST(8.8 AS DOUBLE) AS focal_mm, CAST(13.2 AS DOUBLE) AS sensor_width_mm, CAST(8.8 AS DOUBLE) AS sensor_height_mm,
    CAST(5472 AS BIGINT) AS image_width_px, CAST(3648 AS BIGINT) AS image_height_px, value * 20 AS blur_score
  FROM g
)"""
