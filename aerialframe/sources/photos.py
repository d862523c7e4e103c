"""Reading folders of photos."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jpeg, metadata
from ..functions.images import laplacian_variance
from ..functions.jpeg import TAGS
from ..operators.cameras import by_camera
from .files import located

GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG]}"
_NUMBERS = {"rational": ("double", pa.float64()), "uint": ("long", pa.int64()), "ascii": ("string", pa.string()), "rationals": ("array<double>", pa.list_(pa.float64()))}
FIELDS = {name: _NUMBERS[want] for name, (_, _, want) in TAGS.items()} | {
    "has_exif": ("boolean", pa.bool_()), "xmp": ("string", pa.string()), "frame_w": ("long", pa.int64()), "frame_h": ("long", pa.int64()), "blur_score": ("double", pa.float64()),
    "bytes_read": ("long", pa.int64()), "error": ("string", pa.string()),
}


#: Bytes of a photo's front that are read at first; photos that a task reads at once.
FIRST_BYTES, AT_ONCE = 1 << 16, 16


def scan(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JPEG files under ``path`` as path, modificationTime and length; files are listed, not opened.

    With ``whole`` they come with their content, read by Spark, for stores that only Spark reaches.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=GLOB).load(path)
    return files.select("path", "modificationTime", "length", *["content"] * whole)


def front(read: Callable[[int, int], bytes], length: int) -> bytes:
    """The front of a file of ``length`` bytes, up to the end of its header, through ``read`` (offset, size)."""
    data = b""
    need = min(length, FIRST_BYTES)
    while need > len(data):
        more = read(len(data), need - len(data))
        data += more
        need = min(length, jpeg.wanted(data)) if more else 0
        if need > len(data):
            need = min(length, jpeg.HEADER_BYTES, max(need, 2 * len(data)))
    return data


def _opened(path: str, length: int) -> tuple[bytes, str | None]:
    """The front of a file and what went wrong, if anything."""
    try:
        local = re.sub(r"^file:/+", "/", path)
        store, at = located(local if local.startswith("/") else quote(path, safe="/:@"))
        with store.open_input_file(at) as source:
            return front(lambda offset, size: source.read_at(size, offset), length), None
    except (OSError, pa.ArrowInvalid) as e:
        return b"", f"{type(e).__name__}: {e}"[:500]


def headers(files: DataFrame) -> DataFrame:
    """(path, modificationTime, the fields of each header, bytes_read, error). ``blur_score`` is null without a thumbnail that can be read.

    Of files without ``content`` only the front is read, in ranges, up to the picture's own data or HEADER_BYTES; AT_ONCE of a task wait for their store
    together. A file that can't be read is a row too, with ``error`` and nothing else (see ``unreadable``).
    """
    given = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in batches:
                if given:
                    fronts: Iterable = ((c.as_buffer().to_pybytes() if c.is_valid else b"", None) for c in b.column(3))
                else:
                    fronts = pool.map(_opened, b.column(0).to_pylist(), b.column(2).to_pylist())
                rows = []
                for data, error in fronts:
                    head = jpeg.read_header(data)
                    grey = jpeg.decode_grey(head["thumbnail"]) if head["thumbnail"] else None
                    rows.append(head | {"blur_score": None if grey is None else laplacian_variance(grey), "bytes_read": len(data), "error": error})
                columns = [pa.array([r[n] for r in rows], t) for n, (_, t) in FIELDS.items()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["path", "modificationTime", *FIELDS])

    schema = "path string, modificationTime timestamp, " + ", ".join(f"{n} {t}" for n, (t, _) in FIELDS.items())
    return files.select("path", "modificationTime", "length", *["content"] * given).mapInArrow(run, schema)


def unreadable(headers_: DataFrame) -> DataFrame:
    """(path, error) of files that could not be read."""
    return headers_.where("error is not null").select("path", "error")


def parse(headers_: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """The photo table of headers, footprints left out. A flight is a folder; all but the header reading is done in columns.

    ``cameras`` is a table of sensor sizes by model (see ``operators.cameras``) instead of the few that are built in.
    """
    c = F.col
    by_model = None
    if cameras is not None:
        headers_ = headers_.withColumn("camera", by_camera(cameras)(c("model")))
        by_model = c("camera.sensor_width_mm"), c("camera.sensor_height_mm")
    width, height = F.coalesce("pixel_x", "frame_w"), F.coalesce("pixel_y", "frame_h")
    sensor_w, sensor_h, tier = metadata.sensor_size(c("focal_mm"), c("focal_35mm"), width, height, c("x_res"), c("y_res"), c("res_unit"), c("model"), by_model)
    name = F.element_at(F.split("path", "/"), -1)
    lat, lon = metadata.dms(c("lat_parts"), c("lat_ref")), metadata.dms(c("lon_parts"), c("lon_ref"))
    altitude, yaw = metadata.xmp_number(c("xmp"), "drone-dji:RelativeAltitude"), metadata.yaw(c("xmp"))
    key = metadata.capture_key(metadata.capture_millis(c("taken"), c("subsec")), metadata.filename_sequence(name), F.unix_millis("modificationTime"))
    return headers_.select(
        F.xxhash64("path").alias("photo_id"), F.xxhash64(F.regexp_replace("path", "/[^/]*$", "")).alias("flight_id"), name.alias("file_name"), "path", lat.alias("lat"), lon.alias("lon"),
        altitude.alias("relative_altitude"), metadata.xmp_number(c("xmp"), "drone-dji:AbsoluteAltitude").alias("absolute_altitude"), yaw.alias("yaw_deg"), "focal_mm",
        sensor_w.alias("sensor_width_mm"), sensor_h.alias("sensor_height_mm"), width.alias("image_width_px"), height.alias("image_height_px"),
        c("taken").alias("capture_time"), key.alias("sort_key"), metadata.is_blurry(c("blur_score")).alias("is_blurry"), "blur_score",
        metadata.warnings(~c("has_exif"), lat, lon, tier, c("focal_mm"), altitude, yaw).alias("warnings"),
    )


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded photos as (path, width, height, data: RGB bytes by rows), through Spark's image source; undecodable ones are dropped."""
    raw = spark.read.format("image").options(recursiveFileLookup=True, pathGlobFilter=GLOB, dropInvalid=True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from ..functions.images import downsample

        for b in batches:
            rows = []
            for r in b.to_pylist():
                px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                px = np.repeat(px, 3, 2) if r["nChannels"] == 1 else px[..., 2::-1]  # stored blue first
                px = downsample(np.ascontiguousarray(px))
                rows.append((r["origin"], px.shape[1], px.shape[0], px.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "width", "height", "data"])

    return raw.mapInArrow(run, "path string, width long, height long, data binary")
