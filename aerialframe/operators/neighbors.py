"""Pairs of photos that overlap on the ground."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import M_PER_DEG, ground_coverage
from ..functions.images import clip_areas, quad_area
from .dealing import dealt

MIN_OVERLAP, MAX_NEIGHBORS = 0.3, 10


def radius(photos: DataFrame) -> DataFrame:
    """(flight_id, radius_m, mid_lat): the longest footprint diagonal, 0 if none, and the mean latitude of the photos with a footprint."""
    w, h = ground_coverage(*[F.col(c) for c in ("relative_altitude", "focal_mm", "sensor_width_mm", "sensor_height_mm")])
    mid = F.avg(F.when(F.col("footprint").isNotNull(), F.col("lat")))
    return photos.groupBy("flight_id").agg(F.coalesce(F.max(F.sqrt(w * w + h * h)), F.lit(0.0)).alias("radius_m"), mid.alias("mid_lat"))


def _known(photos: DataFrame, more: dict[str, Column]) -> DataFrame:
    return photos.where("lat is not null and lon is not null").select("flight_id", "photo_id", "lat", "lon", *[c.alias(n) for n, c in more.items()])


def _near(photos: DataFrame, radii: DataFrame, more: list[str]) -> DataFrame:
    """(flight_id, a, b) of ``within_radius`` with the columns ``more`` of either end as <name>_a and <name>_b, in no order of a and b.

    ``photos`` comes from ``_known``. Photos fall in square buckets as wide as the radius. One side goes to its bucket and half of those around it,
    so each pair meets once in an equi-join; buckets are dealt to tasks, however large their flight.
    """
    at = photos.join(radii.where("radius_m > 0").withColumn("scale", M_PER_DEG * F.cos(F.radians("mid_lat"))), "flight_id")
    at = at.withColumns({"x": F.col("lon") * F.col("scale"), "y": F.col("lat") * M_PER_DEG})
    at = dealt(at.withColumns({"bx": F.floor(F.col("x") / F.col("radius_m")), "by": F.floor(F.col("y") / F.col("radius_m"))}), "flight_id", "bx", "by")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])).alias("d")
    ends = lambda k: [F.col("photo_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), *[F.col(n).alias(f"{n}_{k}") for n in more]]
    left = at.select("flight_id", *ends("a"), "radius_m", "bx", "by", around)
    left = left.select("flight_id", *[c for c in left.columns if c not in ("flight_id", "bx", "by", "d")], (F.col("bx") + F.col("d.dx")).alias("bx"), (F.col("by") + F.col("d.dy")).alias("by"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    left = dealt(left, "flight_id", "bx", "by")
    right = at.select("flight_id", *ends("b"), "bx", "by")
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    near = left.join(right, ["flight_id", "bx", "by"]).where((~F.col("own") | (F.col("a") < F.col("b"))) & (F.sqrt(dx * dx + dy * dy) <= F.col("radius_m")))
    return near.select("flight_id", "a", "b", *[f"{n}_{k}" for n in more for k in ("a", "b")])


def within_radius(photos: DataFrame, radii: DataFrame) -> DataFrame:
    """(flight_id, a, b): photos of one flight, a < b, no more than the flight's radius apart."""
    return _near(_known(photos, {}), radii, []).select("flight_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: Corners of a footprint as eight numbers, null without one.
RING = [f"{n}{i}" for i in range(4) for n in ("rx", "ry")]


def _ring() -> dict[str, Column]:
    return {f"{n}{i}": F.col("footprint")[i][k] for i in range(4) for k, n in enumerate(("rx", "ry"))}


def _scored(both: DataFrame, least: float | None = None) -> DataFrame:
    """(flight_id, a, b, overlap), a < b, of rows with a, b and the numbers of RING, lat and lon of both ends; scored where the rows are.

    With ``least`` only pairs that overlap by more.
    """
    numbers = [f"{n}_{k}" for k in ("a", "b") for n in (*RING, "lat", "lon")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            found = np.stack([c.to_numpy(False) for c in batch.columns[3:]], 1)
            swap = a > b
            found[swap] = np.roll(found[swap], 10, 1)
            ring_a, lat, lon, ring_b = found[:, :8], found[:, 8], found[:, 9], found[:, 10:18]
            out = np.full(batch.num_rows, math.inf)
            known = ~np.isnan(ring_a[:, 0]) & ~np.isnan(ring_b[:, 0])
            lat, lon = lat[known], lon[known]
            scale = np.stack([M_PER_DEG * np.cos(np.radians(lat)), np.full(len(lat), M_PER_DEG)], 1)[:, None]
            one, two = ((r[known].reshape(-1, 4, 2) - np.stack([lon, lat], 1)[:, None]) * scale for r in (ring_a, ring_b))
            small = np.minimum(quad_area(one), quad_area(two))
            out[known] = np.where(small > 0, clip_areas(one, two) / np.where(small > 0, small, 1), 0)
            done = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(out)], ["flight_id", "a", "b", "overlap"])
            # NaN is more than any number, as in Spark
            yield done if least is None else done.filter(pa.array(~(out <= least)))

    return both.select("flight_id", "a", "b", *numbers).mapInArrow(score, "flight_id long, a long, b long, overlap double")


def _may_overlap(least: float) -> Column:
    """Whether the bounding boxes of both footprints share as much as an overlap of ``least`` takes; a share is the same in degrees as in metres.

    A thousandth is left for rounding. Where a footprint is missing it may.
    """
    at = lambda n, k: [F.col(f"{n}{i}_{k}") for i in range(4)]
    shared = lambda n: F.greatest(F.lit(0.0), F.least(*[F.greatest(*at(n, k)) for k in "ab"]) - F.greatest(*[F.least(*at(n, k)) for k in "ab"]))

    def area(k: str) -> Column:
        (x0, *x), (y0, *y) = at("rx", k), at("ry", k)
        (ux, vx, wx), (uy, vy, wy) = [v - x0 for v in x], [v - y0 for v in y]
        return F.abs(ux * vy - vx * uy + vx * wy - wx * vy) / 2

    return F.coalesce(~(shared("rx") * shared("ry") < F.least(area("a"), area("b")) * (least * 0.999)), F.lit(True))


def overlap(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """``pairs`` (a < b) with ``overlap``: the common area of both footprints as a share of the smaller, infinite if one has none.

    Measured on the plane around photo a's own position. For pairs that are within the radius ``overlaps_within`` needs no look-up.
    """
    side = lambda k: photos.select("flight_id", F.col("photo_id").alias(k), *[c.alias(f"{n}_{k}") for n, c in ({"lat": F.col("lat"), "lon": F.col("lon")} | _ring()).items()])
    return _scored(pairs.join(side("a"), ["flight_id", "a"]).join(side("b"), ["flight_id", "b"]))


def overlaps_within(photos: DataFrame, radii: DataFrame, least: float | None = None) -> DataFrame:
    """``overlap`` of all pairs of ``within_radius``, or of those that overlap by more than ``least``; corners travel with the photos through the one join."""
    near = _near(_known(photos, _ring()), radii, [*RING, "lat", "lon"])
    return _scored(near if least is None else near.where(_may_overlap(least)), least)


def strongest(scored: DataFrame, k: int | None = MAX_NEIGHBORS) -> DataFrame:
    """(flight_id, a, b): pairs among the ``k`` of highest ``overlap`` of either end (all, if k is None); ties to the smaller other id."""
    pairs = scored.select("flight_id", "a", "b", "overlap")
    if k is None:
        return pairs.drop("overlap")
    # each pair seen from both ends, in one pass over what scored it
    end = lambda me, other: F.struct(F.col(me).alias("me"), F.col(other).alias("other"))
    ends = pairs.select("flight_id", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e"), "overlap").select("flight_id", "e.*", "overlap")
    rank = F.expr("row_number() over (partition by flight_id, me order by overlap desc, other)")
    top = dealt(ends, "flight_id", "me").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("flight_id", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()


def neighbor_pairs(photos: DataFrame, k: int | None = MAX_NEIGHBORS) -> DataFrame:
    """Photos with a footprint that lie within the radius, overlap by more than MIN_OVERLAP and are among the strongest ``k``."""
    some = photos.where(F.col("footprint").isNotNull())
    return strongest(overlaps_within(some, radius(some), MIN_OVERLAP), k)
