"""Ground geometry of a photo as column expressions: metres, footprints, rings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: radius of the sphere on which degrees become metres.
EARTH_RADIUS_M = 6_378_137.0
M_PER_DEG = EARTH_RADIUS_M * math.pi / 180


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite. ``c`` stands here once, as filters copy it; NaN counts as more than infinity."""
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def over(a: Column, b: Column) -> Column:
    """``a / b`` as doubles divide: infinite or NaN, and no error, where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def logarithm(x: Column, of: Callable[[Column], Column] = F.log) -> Column:
    """``of(x)`` as logarithms of doubles are: minus infinity for 0 and NaN, not null, below."""
    return F.when(x > 0, of(x)).when(x == 0, -math.inf).when(x < 0, math.nan)


def ground_coverage(altitude: Column, focal: Column, sensor_w: Column, sensor_h: Column) -> tuple[Column, Column]:
    """Width and height in metres that a camera sees straight down; null where the focal length is 0."""
    per = F.when(focal != 0, altitude / focal)
    return per * sensor_w, per * sensor_h


def offset(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """(lon, lat) moved by metres east and north."""
    return lon + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(lat)))), lat + F.degrees(north / EARTH_RADIUS_M)


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres (east, north) from an origin, on a plane scaled at the origin's latitude."""
    return (lon - lon0) * M_PER_DEG * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEG


def from_local(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(lon, lat) of metres from an origin: the inverse of ``to_local``."""
    return lon0 + east / (M_PER_DEG * F.cos(F.radians(lat0))), lat0 + north / M_PER_DEG


def footprint_steps(lat: Column, lon: Column, altitude: Column, yaw: Column, focal: Column, sensor_w: Column, sensor_h: Column) -> list[dict[str, Column]]:
    """The footprint in three steps, each a set of columns that the next one reads, so that no expression is written out for every corner.

    First the ground seen and the direction, then half of its sides as vectors in degrees, then ``footprint``: a closed ring of five [lon, lat]
    (bottom left, bottom right, top right, top left of the ground seen, turned clockwise by yaw). Null if any input is null, altitude or
    focal length is not above 0, position or yaw is not finite, or the ground seen is not finite and above 0.
    """
    w, h = ground_coverage(altitude, focal, sensor_w, sensor_h)
    c = F.col
    first = {"_w": w / 2, "_h": h / 2, "_sin": F.sin(F.radians(yaw)), "_cos": F.cos(F.radians(yaw)), "_east": 180 / math.pi / (EARTH_RADIUS_M * F.cos(F.radians(lat)))}
    known = (altitude > 0) & (focal > 0) & finite(lat) & finite(lon) & finite(yaw)
    seen = lambda x: (x > 0) & (x < float("inf"))
    north = 180 / math.pi / EARTH_RADIUS_M
    second = {
        "_known": known & seen(c("_w")) & seen(c("_h")),
        "_ux": c("_w") * c("_cos") * c("_east"), "_uy": -c("_w") * c("_sin") * north, "_vx": c("_h") * c("_sin") * c("_east"), "_vy": c("_h") * c("_cos") * north,
    }
    corner = lambda u, v: F.array(lon + u * c("_ux") + v * c("_vx"), lat + u * c("_uy") + v * c("_vy"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return [first, second, {"footprint": F.when(c("_known"), ring)}]


def corners(ring: Column) -> list[tuple[Column, Column]]:
    """The four corners of a footprint as (x, y)."""
    return [(ring[i][0], ring[i][1]) for i in range(4)]


def in_ring(x: Column, y: Column, ring: list[tuple[Column, Column]]) -> Column:
    """Even-odd rule with half-open edges; False for fewer than three corners."""
    inside = F.lit(False)
    if len(ring) < 3:
        return inside
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        crosses = F.when((yi > y) != (yj > y), x < (xj - xi) * (y - yi) / (yj - yi) + xi).otherwise(False)
        inside = inside != crosses
    return inside


def in_ring_array(x: Column, y: Column, ring: Column) -> Column:
    """The same for a ring of any length in an array of [x, y]."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

    def crosses(a: Column, b: Column) -> Column:
        return F.when((a[1] > y) != (b[1] > y), x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]).otherwise(False)

    odd = F.aggregate(F.zip_with(ring, before, crosses), F.lit(False), lambda acc, c: acc != c)
    return F.when(F.size(ring) < 3, False).otherwise(odd)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an open ring of [x, y]; 0 for fewer than three points."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, after, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(twice / 2))


def level(count: Column) -> Column:
    """Coverage level of a cell that is seen ``count`` times."""
    return F.when(count >= 5, "green").when(count >= 3, "yellow").otherwise("red")


def area_label(m2: Column) -> Column:
    return F.when(m2 >= 10_000, F.format_string("%.2f ha", m2 / 10_000)).otherwise(F.format_string("%.0f m²", m2))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).cast("int")


def similarity(east: Column, north: Column, yaw: Column, scale: Column, width: Column, height: Column) -> Column:
    """Pixel to local metres as nine numbers, by rows: up is north at yaw 0, and the picture's centre lands on (east, north)."""
    theta = F.radians(yaw)
    cx, cy = width / 2, height / 2
    m00, m01, m10, m11 = scale * F.cos(theta), -scale * F.sin(theta), -scale * F.sin(theta), -scale * F.cos(theta)
    return F.array(m00, m01, east - cx * m00 - cy * m01, m10, m11, north - cx * m10 - cy * m11, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply_matrix(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def matmul3(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)])


def normalised_keypoint(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    half = F.greatest(width, height) / 2
    return (x - width / 2) / half, (y - height / 2) / half


def feather(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Blending weight of a pixel: 1 at the centre, falling to 0 at the border."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    room = F.least(cx - F.abs(x - cx), cy - F.abs(y - cy))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), room) / F.greatest(F.lit(1.0), F.least(cx, cy)))
