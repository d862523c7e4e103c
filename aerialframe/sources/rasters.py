"""GeoTIFF and PNG files of mosaics, written strip by strip, and tables of map tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import M_PER_DEG
from ..operators.mosaic import TILE
from .files import save_sorted

_ADLER = 65521
#: Place of a file's last piece.
_LAST = 1 << 62


def geotiff_header(width: int, height: int, strip: int, lon: float, lat: float, deg_x: float, deg_y: float) -> bytes:
    """All of an RGB8 file but its pixels, which follow in strips of ``strip`` lines, not compressed. The top left corner lies at (lon, lat), pixels are
    ``deg_x`` by ``deg_y`` degrees, EPSG:4326. From 4 GiB on it is a BigTIFF."""
    # Model type geographic, raster type pixel-is-area, EPSG code.
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    lines = [min(strip, height - y) for y in range(0, height, strip)]
    sizes = [3 * width * n for n in lines]
    big = sum(sizes) + 65536 + 16 * len(sizes) >= 1 << 32
    code, size = {3: "H", 4: "I", 12: "d", 16: "Q"}, {3: 2, 4: 4, 12: 8, 16: 8}
    whole = 16 if big else 4
    room, word, start = (8, "Q", 16) if big else (4, "I", 8)

    def table(first: int) -> bytes:
        offsets = (first + np.cumsum([0, *sizes[:-1]])).tolist()
        entries = [
            (256, 4, (width,)), (257, 4, (height,)), (258, 3, (8, 8, 8)), (259, 3, (1,)), (262, 3, (2,)), (273, whole, offsets), (277, 3, (3,)), (278, 4, (strip,)), (279, whole, sizes), (284, 3, (1,)),
            (33550, 12, (deg_x, deg_y, 0.0)), (33922, 12, (0.0, 0.0, 0.0, lon, lat, 0.0)), (34735, 3, keys),
        ]
        count = struct.pack("<Q" if big else "<H", len(entries))
        at = start + len(count) + len(entries) * (4 + 2 * room) + room
        fixed, extra = b"", b""
        for tag, kind, values in entries:
            packed = struct.pack(f"<{len(values)}{code[kind]}", *values)
            if size[kind] * len(values) > room:
                packed, extra = struct.pack(f"<{word}", at + len(extra)), extra + packed
            fixed += struct.pack(f"<HH{word}", tag, kind, len(values)) + packed.ljust(room, b"\0")
        return count + fixed + bytes(room) + extra

    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)
    length = start + len(table(0))
    length += length % 2
    return (head + table(length)).ljust(length, b"\0")


def geotiff(rgb: np.ndarray, lon: float, lat: float, deg_x: float, deg_y: float) -> bytes:
    """A whole file of one strip."""
    h, w = rgb.shape[:2]
    return geotiff_header(w, h, h, lon, lat, deg_x, deg_y) + np.ascontiguousarray(rgb, np.uint8).tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_header(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x01")


def png_strip(rgb: np.ndarray) -> tuple[bytes, int, int]:
    """Lines of a picture as a chunk that ends at a byte, so that strips compressed apart are one stream, and the Adler-32 and length of what it holds."""
    raw = np.concatenate([np.zeros((len(rgb), 1), np.uint8), rgb.reshape(len(rgb), -1)], 1).tobytes()
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return _chunk(b"IDAT", z.compress(raw) + z.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def png_trailer(adler: int) -> bytes:
    return _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b"")


def adler_joined(one: int, other: int, length: int) -> int:
    """The Adler-32 of two texts on end from those of both and the length of the second."""
    a, b = one & 0xFFFF, one >> 16
    return (b + (other >> 16) + length * (a - 1)) % _ADLER << 16 | (a + (other & 0xFFFF) - 1) % _ADLER


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    strip, adler, _ = png_strip(np.ascontiguousarray(rgb, np.uint8))
    return png_header(w, h) + strip + png_trailer(adler)


def georeference(origin_east: float, origin_north: float, meters_per_pixel: float, lat0: float, lon0: float) -> tuple[float, float, float, float]:
    """(lon, lat, degrees per pixel across and down) of a raster whose corner lies at metres from (lat0, lon0)."""
    m_lon = M_PER_DEG * np.cos(np.radians(lat0))
    return lon0 + origin_east / m_lon, lat0 + origin_north / M_PER_DEG, meters_per_pixel / m_lon, meters_per_pixel / M_PER_DEG


def strips(tiles: DataFrame, canvases: DataFrame, tile: int = TILE) -> DataFrame:
    """(flight_id, tile_y, width, lines, data): every row of tiles of every raster as RGB bytes, black where no tile is."""
    rows = canvases.select("flight_id", "out_w", "out_h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("out_h") - 1) / tile))).alias("tile_y"))
    both = rows.join(tiles.select("flight_id", "tile_y", "tile_x", "width", "height", "data"), ["flight_id", "tile_y"], "left")

    def joined(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).to_pylist()[0]
        w, lines = first["out_w"], min(tile, first["out_h"] - tile * first["tile_y"])
        out = np.zeros((lines, w, 3), np.uint8)
        for x, tw, th, data in zip(*(t.column(c).to_pylist() for c in ("tile_x", "width", "height")), t.column("data"), strict=True):
            if x is not None:
                out[:th, x * tile : x * tile + tw] = np.frombuffer(data.as_buffer(), np.uint8).reshape(th, tw, 3)
        return pa.table({"flight_id": pa.array([first["flight_id"]], pa.int64()), "tile_y": pa.array([first["tile_y"]], pa.int64()), "width": pa.array([w], pa.int64()), "lines": pa.array([lines], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    return both.groupBy("flight_id", "tile_y").applyInArrow(joined, "flight_id long, tile_y long, width long, lines long, data binary")


def write_rasters(tiles: DataFrame, canvases: DataFrame, origins: DataFrame, path: str, tile: int = TILE) -> None:
    """``<flight_id>.tif`` and ``<flight_id>.preview.png`` of every flight of ``canvases`` below ``path``, with the pixels of ``mosaic.compose``.

    Strips are made and compressed all over the cluster and flow to the one task that writes their file, so no task holds more than a few rows
    of tiles and the driver none. Files appear together, when all are complete; earlier ones are replaced.
    """
    schema = "name string, seq long, data binary, adler long, raw long"
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "seq", "data", "adler", "raw"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                place = georeference(*(r[c] for c in ("origin_east", "origin_north", "meters_per_pixel", "lat0", "lon0")))
                tif = geotiff_header(r["out_w"], r["out_h"], tile, *place)
                yield batch([(f"{r['flight_id']}.tif", 0, tif, None, None), (f"{r['flight_id']}.preview.png", 0, png_header(r["out_w"], r["out_h"]), None, None)])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flight, y, width, lines = (b.column(c)[k].as_py() for c in range(4))
                data = b.column(4)[k].as_buffer().to_pybytes()
                strip, adler, raw = png_strip(np.frombuffer(data, np.uint8).reshape(lines, width, 3))
                yield batch([(f"{flight}.tif", 1 + y, data, None, None)])
                yield batch([(f"{flight}.preview.png", 1 + y, strip, adler, raw)])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces as they are, and the end of each PNG, whose checksum follows from those of its strips."""
        name, adler = None, 1
        end = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_LAST], pa.int64()), pa.array([png_trailer(adler)], pa.binary())], ["name", "seq", "data"])
        for b in batches:
            for k in range(b.num_rows):
                mine, one, raw = b.column(0)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].as_py()
                if mine != name:
                    if name and name.endswith(".png"):
                        yield end()
                    name, adler = mine, 1
                if one is not None:
                    adler = adler_joined(adler, one, raw)
                yield b.slice(k, 1).select(["name", "seq", "data"])
        if name and name.endswith(".png"):
            yield end()

    known = canvases.join(origins, "flight_id").select("flight_id", "origin_east", "origin_north", "meters_per_pixel", "out_w", "out_h", "lat0", "lon0")
    pieces = known.mapInArrow(heads, schema).union(strips(tiles, canvases, tile).mapInArrow(bodies, schema))
    pieces = pieces.repartition("name").sortWithinPartitions("name", "seq").mapInArrow(ended, "name string, seq long, data binary")
    save_sorted(pieces, path)


def write_tiles(fetched: DataFrame, path: str) -> None:
    """Tiles that exist, as a Parquet table by zoom in the order of ``basemap.in_order``; an earlier table at ``path`` is replaced."""
    fetched.where("status = 'ok'").select("z", "x", "y", "data").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("z int, x long, y long, data binary").parquet(path)
