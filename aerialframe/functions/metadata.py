"""Camera metadata as column expressions: sensor sizes, capture order, XMP attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor width and height in mm, by a part of the camera's model name; the first that fits counts.
CAMERAS = (
    ("FC330", 6.3, 4.7),
    ("FC6310", 13.2, 8.8),
    ("FC6360", 13.2, 8.8),
    ("FC6540", 13.2, 8.8),
    ("L1D-20c", 13.2, 8.8),
    ("M3E", 17.3, 13.0),
    ("M3T", 17.3, 13.0),
)
#: Millimetres in a unit of the focal-plane resolution (2 inch, 3 centimetre).
MM_PER_UNIT = {2: 25.4, 3: 10.0}
#: Tiers of the capture order.
TIMESTAMP, SEQUENCE, MODIFIED, UNKNOWN = range(4)


def dms(parts: Column, ref: Column) -> Column:
    """Decimal degrees of [degrees, minutes, seconds], negative where ``ref`` begins with S or W; null for fewer than three parts."""
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60 + F.get(parts, F.lit(2)) / 3600
    return F.when(F.size(parts) >= 3, F.when(ref.rlike("^[SW]"), -value).otherwise(value))


def from_35mm(focal: Column, focal_35mm: Column, width: Column, height: Column) -> tuple[Column, Column]:
    w = F.when((focal_35mm > 0) & (width > 0) & height.isNotNull(), focal * 36.0 / focal_35mm)
    return w, w * (height / width)


def from_focal_plane(width: Column, height: Column, x_res: Column, y_res: Column, unit: Column) -> tuple[Column, Column]:
    mm = F.coalesce(*[F.when(unit == u, F.lit(v)) for u, v in MM_PER_UNIT.items()])
    good = (x_res > 0) & (y_res > 0) & (width > 0) & (height > 0)
    return F.when(good, width / x_res * mm), F.when(good, height / y_res * mm)


def from_model(model: Column) -> tuple[Column, Column]:
    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(model.contains(c[0]), F.lit(c[i])) for c in CAMERAS])

    return pick(1), pick(2)


def sensor_size(
    focal: Column, focal_35mm: Column, width: Column, height: Column, x_res: Column, y_res: Column, unit: Column, model: Column, by_model: tuple[Column, Column] | None = None
) -> tuple[Column, Column, Column]:
    """Sensor width, height (mm) and the tier that gave them: 1 from the 35 mm equivalent, 2 from the focal plane, 3 by model, null for none.

    ``by_model`` is the size that a table of cameras has for the model (see ``operators.cameras``); without it CAMERAS is that table.
    """
    tiers = [from_35mm(focal, focal_35mm, width, height), from_focal_plane(width, height, x_res, y_res, unit), by_model or from_model(model)]
    # a tier counts as a whole: its width decides
    tier = F.coalesce(*[F.when(w.isNotNull(), F.lit(i)) for i, (w, _) in enumerate(tiers, 1)])
    pick = lambda k: F.coalesce(*[F.when(tier == i, t[k]) for i, t in enumerate(tiers, 1)])
    return pick(0), pick(1), tier


def warnings(no_exif: Column, lat: Column, lon: Column, tier: Column, focal: Column, altitude: Column, yaw: Column) -> Column:
    """Names of what is missing or was derived, always in this order."""
    found = [
        ("no_exif_data", no_exif),
        ("missing_gps", lat.isNull() | lon.isNull()),
        ("used_focal_plane_resolution", tier.eqNullSafe(2)),
        ("used_camera_db_fallback", tier.eqNullSafe(3)),
        ("missing_sensor_size", tier.isNull()),
        ("missing_focal_length", focal.isNull()),
        ("missing_altitude", altitude.isNull()),
        ("missing_yaw", yaw.isNull()),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found]))


def xmp_number(xmp: Column, name: str) -> Column:
    """The number in the first ``name="..."``, trimmed and with its sign; null if there is none."""
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in name)
    return F.trim(F.regexp_extract(xmp, f'{quoted}="([^"]*)"', 1)).try_cast("double")


def yaw(xmp: Column) -> Column:
    return F.coalesce(xmp_number(xmp, "drone-dji:GimbalYawDegree"), xmp_number(xmp, "drone-dji:FlightYawDegree"))


def subsec_millis(subsec: Column) -> Column:
    """Milliseconds of an EXIF sub-second text: its first three digits, filled with zeros on the right."""
    digits = F.substring(F.regexp_replace(F.coalesce(subsec, F.lit("")), "[^0-9]", ""), 1, 3)
    return F.rpad(digits, 3, "0").cast("int")


def capture_millis(text: Column, subsec: Column) -> Column:
    """Milliseconds since 1970 of an EXIF date and time, taken without a time zone; null if malformed."""
    # an NTZ timestamp, so the session's time zone does not matter
    well_formed = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    plain = F.when(well_formed, F.concat(F.translate(F.substring(text, 1, 10), ":", "-"), F.lit("T"), F.substring(text, 12, 8))).try_cast("timestamp_ntz")
    days = F.datediff(plain.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(plain) * 3600 + F.minute(plain) * 60 + F.second(plain)
    return (days * 86_400 + seconds) * 1000 + subsec_millis(subsec)


def filename_sequence(name: Column) -> Column:
    """The last run of digits of the name without its extension, as a decimal; null if there is none or it passes 64 bits."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    value = F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1).try_cast("decimal(20,0)")
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def capture_key(taken_ms: Column, sequence: Column, modified_ms: Column) -> Column:
    """(tier, value), which sorts photos: by time taken, else by number in the name, else by file time, else not at all."""
    key = lambda tier, v: F.struct(F.lit(tier).alias("tier"), v.cast("decimal(20,0)").alias("value"))
    return F.coalesce(
        F.when(taken_ms.isNotNull(), key(TIMESTAMP, taken_ms)),
        F.when(sequence.isNotNull(), key(SEQUENCE, sequence)),
        F.when(modified_ms.isNotNull(), key(MODIFIED, modified_ms)),
        key(UNKNOWN, F.lit(0)),
    )


def is_blurry(score: Column, threshold: float = 100.0) -> Column:
    return F.coalesce(score < threshold, F.lit(False))
