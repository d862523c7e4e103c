"""From matched points to poses: homographies pair by pair, then alignment flight by flight."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..functions.geodesy import finite, ground_coverage, similarity, to_local


def homographies(points: DataFrame) -> DataFrame:
    """(flight_id, a, b, h, inlier_count, match_count) for pairs of which enough points agree; a pair's points are capped by its keypoints."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xa", "ya", "xb", "yb"])
        found = images.ransac_homography(pdf[["xa", "ya"]].to_numpy(), pdf[["xb", "yb"]].to_numpy())
        first = pdf.iloc[0]
        rows = [] if found is None else [(first.flight_id, first.a, first.b, found[0].ravel().tolist(), found[1], len(pdf))]
        return pd.DataFrame(rows, columns=["flight_id", "a", "b", "h", "inlier_count", "match_count"])

    return points.groupBy("flight_id", "a", "b").applyInPandas(fit, "flight_id long, a long, b long, h array<double>, inlier_count long, match_count long")


def weak_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("inlier_count") * 2 < F.col("match_count"))


def origins(photos: DataFrame) -> DataFrame:
    """(flight_id, lat0, lon0): the mean position of the flight's photos with a footprint, from which its metres count."""
    return photos.where(F.col("footprint").isNotNull()).groupBy("flight_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))


def placements(photos: DataFrame) -> DataFrame:
    """(flight_id, photo_id, east, north, theta, scale, width, height, pose): where GPS, heading and altitude put each picture.

    Metres count from the mean position of the flight's photos with a footprint. Photos that lack anything have no row.
    """
    some = photos.where(F.col("footprint").isNotNull())
    w, h = ground_coverage(*[F.col(c) for c in ("relative_altitude", "focal_mm", "sensor_width_mm", "sensor_height_mm")])
    width, height = F.col("image_width_px").cast("double"), F.col("image_height_px").cast("double")
    east, north = to_local(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    out = some.join(origins(photos), "flight_id").where(finite(w) & finite(h) & (w > 0) & (h > 0) & (width > 0) & (height > 0) & F.col("yaw_deg").isNotNull()).select(
        "flight_id", "photo_id", east.alias("east"), north.alias("north"), F.col("yaw_deg"), ((w / width + h / height) / 2).alias("scale"), width.alias("width"), height.alias("height")
    )
    pose = similarity(F.col("east"), F.col("north"), F.col("yaw_deg"), F.col("scale"), F.col("width"), F.col("height"))
    return out.withColumn("pose", pose).withColumn("theta", F.radians("yaw_deg")).drop("yaw_deg")


def mean_gsd(photos: DataFrame) -> DataFrame:
    """(flight_id, meters_per_pixel): the mean over a flight's photos, null if any of them lacks what it takes."""
    w, h = ground_coverage(*[F.col(c) for c in ("relative_altitude", "focal_mm", "sensor_width_mm", "sensor_height_mm")])
    gsd = (w / F.col("image_width_px") + h / F.col("image_height_px")) / 2
    return photos.groupBy("flight_id").agg(F.when(F.count_if(gsd.isNull()) == 0, F.avg(gsd)).alias("meters_per_pixel"))


#: What the alignment reads of a picture.
PLACED = ["east", "north", "theta", "scale", "width", "height"]


def _columns(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in names], 1)


def align(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(flight_id, photo_id, pose, east, north, theta) after alignment; without edges nothing moves.

    The flights' systems are solved side by side, each in one task: a flight is one survey, and its unknowns are three for each photo.
    """
    nodes = placed.select(*[F.col(c).cast("long").alias(c) for c in ("flight_id", "photo_id")], *[F.col(c).cast("double").alias(c) for c in PLACED])
    links = edges.select(*[F.col(c).cast("long").alias(c) for c in ("flight_id", "a", "b")], *[F.col("h")[k].cast("double").alias(f"h{k}") for k in range(9)])

    def solve(p: pa.Table, e: pa.Table) -> pa.Table:
        p, e = p.sort_by("photo_id"), e.sort_by([("a", "ascending"), ("b", "ascending")])
        if not p.num_rows:
            return p.select(["flight_id", "photo_id"]).append_column("pose", pa.array([], pa.list_(pa.float64()))).append_column("east", p["east"]).append_column("north", p["north"]).append_column("theta", p["theta"])
        ids, ends = p["photo_id"].to_numpy(), [e[k].to_numpy() for k in ("a", "b")]
        i, j = (np.searchsorted(ids, k, "right") - 1 for k in ends)
        known = (ids[i] == ends[0]) & (ids[j] == ends[1])
        x, scale, size = _columns(p, PLACED[:3]), p["scale"].to_numpy(), _columns(p, PLACED[4:])
        i, j, h = i[known], j[known], _columns(e, [f"h{k}" for k in range(9)])[known].reshape(-1, 3, 3)
        x = images.aligned(x, scale, size / 2, i, j, h, size[i])
        s, c, (cx, cy) = scale * np.sin(x[:, 2]), scale * np.cos(x[:, 2]), size.T / 2
        none = np.zeros(len(x))
        poses = np.stack([c, -s, x[:, 0] - cx * c + cy * s, -s, -c, x[:, 1] + cx * s + cy * c, none, none, none + 1], 1)
        pose = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 9, pa.int32()), pa.array(poses.ravel()))
        return pa.table({"flight_id": p["flight_id"], "photo_id": p["photo_id"], "pose": pose, "east": x[:, 0], "north": x[:, 1], "theta": x[:, 2]})

    return nodes.groupBy("flight_id").cogroup(links.groupBy("flight_id")).applyInArrow(
        solve, "flight_id long, photo_id long, pose array<double>, east double, north double, theta double"
    )
