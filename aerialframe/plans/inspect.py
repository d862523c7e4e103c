"""From a folder of photos to coverage, gaps, alerts and metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, photos
from ..sources import photos as source


class InspectionError(ValueError):
    """The folder holds nothing that can be inspected."""


@dataclass
class InspectionResult:
    photos: DataFrame
    flight_path: DataFrame
    heatmap: DataFrame
    gaps: DataFrame
    blur_alerts: DataFrame
    metrics: DataFrame
    #: Milliseconds that scanning and checking the folder took, as in metrics; computing the results comes on top, when they are read.
    scan_ms: int | None = None


def inspect_photos(table: DataFrame, cell_m: float = coverage.CELL_M, scan_ms: int | None = None) -> InspectionResult:
    """All results for a photo table with a flight_id; each is lazy. Keep ``table`` in storage if several are read.

    ``scan_ms`` is what reading the table took, if it was read from photos; metrics have it as ``scan_duration_ms``.
    """
    table = photos.with_footprint(table)
    grids = coverage.grid(table, cell_m)
    counts = coverage.cells(table, grids)
    gaps = coverage.gaps(counts, grids)
    metrics = photos.metrics(table, gaps, coverage.covered_area(counts, grids)).withColumn("scan_duration_ms", F.lit(scan_ms).cast("long"))
    return InspectionResult(
        photos.flight_order(table), photos.path_features(table), coverage.cell_features(counts, grids), gaps, photos.blur_alerts(table), metrics, scan_ms
    )


def inspect_directory(spark: SparkSession, path: str, cell_m: float = coverage.CELL_M, whole: bool = False) -> InspectionResult:
    """Scan, parse and inspect ``path``. Raises InspectionError if there is no JPEG or no photo has a position.

    Only the fronts of photos are read, unless ``whole`` (see ``sources.photos.scan``). A photo that can't be read is one without metadata.
    """
    began = time.monotonic()
    files = source.scan(spark, path, whole)
    if files.select("path").isEmpty():
        raise InspectionError(f"No JPEG photos found in {path}.")
    table = source.parse(source.headers(files)).persist()
    if table.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).isEmpty():
        raise InspectionError("No photo has a GPS position.")
    return inspect_photos(table, cell_m, round((time.monotonic() - began) * 1000))
