"""From photos and matched points to a mosaic."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, mosaic, neighbors, photos, registration
from ..sources import files, rasters

BACKENDS, CAPS = ("onnx", "orb"), {"capped": neighbors.MAX_NEIGHBORS, "uncapped": None}
STAGES = ("downsampling", "detecting", "matching", "aligning", "blending", "exporting")


class StitchError(ValueError):
    """There is nothing to stitch."""


@dataclass
class StitchResult:
    edges: DataFrame
    poses: DataFrame
    canvases: DataFrame
    tiles: DataFrame
    warnings: DataFrame
    #: (flight_id, photos_used, photos_skipped, confident_pairs); photos without a footprint count nowhere, those whose picture can't be read as skipped
    counts: DataFrame
    #: (flight_id, corners) of the mosaic on the map
    corners: DataFrame
    #: (flight_id, lat0, lon0) from which a flight's metres count
    origins: DataFrame


def checked(cap: str) -> str:
    if cap not in CAPS:
        raise ValueError(f"cap must be one of {', '.join(CAPS)}")
    return cap


def candidate_pairs(table: DataFrame, cap: str = "capped") -> DataFrame:
    return neighbors.neighbor_pairs(table, CAPS[checked(cap)]).orderBy("flight_id", "a", "b")


def orb_points(table: DataFrame, pictures: DataFrame, cap: str = "capped") -> DataFrame:
    """The points that ``stitch`` takes, from corners of the pictures of neighbouring photos: (flight_id, a, b, xa, ya, xb, yb).

    Features are found once for each picture of a neighbour and written down (checkpoint), as each is matched with several others.
    """
    near = neighbors.neighbor_pairs(table, CAPS[checked(cap)])
    pairs = near.withColumn("pair", F.xxhash64("flight_id", "a", "b"))
    found = matching.orb_features(pictures.join(pairs.select(F.explode(F.array("a", "b")).alias("photo_id")).distinct(), "photo_id", "left_semi"))
    found = files.kept(found)
    matches = matching.knn_ratio(pairs, found)
    end = lambda k, idx: found.select(F.col("photo_id").alias(k), F.col("idx").alias(idx), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = matches.join(pairs, "pair").join(end("a", "query_idx"), ["a", "query_idx"]).join(end("b", "train_idx"), ["b", "train_idx"])
    return both.select("flight_id", "a", "b", "xa", "ya", "xb", "yb")


def stitch(table: DataFrame, pictures: DataFrame, points: DataFrame) -> StitchResult:
    """Poses and mosaic tiles of every flight of ``table`` (with footprints).

    ``pictures`` has photo_id, width, height, data (RGB); ``points`` has flight_id, a, b, xa, ya, xb, yb from any matcher, in pixels of those pictures.
    Photos without a picture become warnings. Raises StitchError if fewer than two photos can be used.
    """
    ready = photos.stitchable(table)
    sizes = pictures.select("photo_id", F.col("width").alias("image_width_px"), F.col("height").alias("image_height_px"))
    used = ready.drop("image_width_px", "image_height_px").join(sizes, "photo_id")
    if used.limit(2).count() < 2:
        raise StitchError("At least two photos with position, altitude and heading are needed.")
    lost = ready.join(sizes, "photo_id", "left_anti").select("flight_id", F.concat("file_name", F.lit(": can't be read")).alias("warning"))
    edges = registration.homographies(points)
    weak = registration.weak_edges(edges).select("flight_id", F.format_string("%d-%d: weak match", "a", "b").alias("warning"))
    placed = registration.placements(used)
    poses = registration.align(placed, edges)
    sized = poses.join(placed.select("photo_id", "width", "height"), "photo_id")
    bounded = mosaic.bounds(sized)
    canvases = mosaic.canvas(bounded, registration.mean_gsd(used))
    n = ready.join(sizes.select("photo_id", F.lit(True).alias("seen")), "photo_id", "left").groupBy("flight_id")
    n = n.agg(F.count_if("seen").alias("photos_used"), F.count_if(F.col("seen").isNull()).alias("photos_skipped"))
    n_pairs = edges.groupBy("flight_id").agg(F.count("*").alias("confident_pairs"))
    counts = n.join(n_pairs, "flight_id", "left").fillna(0)
    tiles = mosaic.compose(mosaic.covered_tiles(bounded, canvases), pictures)
    origins = registration.origins(used)
    return StitchResult(edges, poses, canvases, tiles, lost.union(weak), counts, mosaic.corners(canvases, origins), origins)


def export(result: StitchResult, path: str) -> DataFrame:
    """Write a GeoTIFF and a PNG of every mosaic below ``path``, and say where they are.

    (flight_id, geotiff_path, preview_path, preview_corners, photos_used, photos_skipped, confident_pairs, duration_ms); the duration is that of
    computing and writing all rasters, which are made together.
    """
    began = time.monotonic()
    rasters.write_rasters(result.tiles, result.canvases, result.origins, path)
    took = round((time.monotonic() - began) * 1000)
    named = lambda end: F.concat(F.lit(f"{path.rstrip('/')}/"), F.col("flight_id").cast("string"), F.lit(end))
    return result.corners.join(result.counts, "flight_id").select(
        "flight_id", named(".tif").alias("geotiff_path"), named(".preview.png").alias("preview_path"), F.col("corners").alias("preview_corners"),
        "photos_used", "photos_skipped", "confident_pairs", F.lit(took).cast("long").alias("duration_ms"),
    )
