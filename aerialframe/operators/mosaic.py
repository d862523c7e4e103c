"""Blending pictures into one raster, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..functions.geodesy import apply_matrix

TILE = 256


def bounds(placed: DataFrame) -> DataFrame:
    """``placed`` (flight_id, photo_id, pose, width, height) with the box of each picture on the ground: e0, e1, n0, n1."""
    w, h = F.col("width"), F.col("height")
    at = [apply_matrix(F.col("pose"), x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h))]
    es, ns = [a[0] for a in at], [a[1] for a in at]
    return placed.withColumns({"e0": F.least(*es), "e1": F.greatest(*es), "n0": F.least(*ns), "n1": F.greatest(*ns)})


def canvas(bounded: DataFrame, gsd: DataFrame) -> DataFrame:
    """(flight_id, origin_east, origin_north, meters_per_pixel, out_w, out_h): the raster that holds all pictures, its top left corner at the origin."""
    box = bounded.groupBy("flight_id").agg(F.min("e0").alias("origin_east"), F.max("e1").alias("e"), F.min("n0").alias("n"), F.max("n1").alias("origin_north"))
    size = lambda a, b: F.greatest(F.lit(1), F.ceil((a - b) / F.col("meters_per_pixel"))).cast("long")
    return box.join(gsd.where("meters_per_pixel > 0"), "flight_id").select(
        "flight_id", "origin_east", "origin_north", "meters_per_pixel",
        size(F.col("e"), F.col("origin_east")).alias("out_w"), size(F.col("origin_north"), F.col("n")).alias("out_h"),
    )


def covered_tiles(bounded: DataFrame, canvases: DataFrame, tile: int = TILE) -> DataFrame:
    """Each picture by the tiles of the raster that its box touches."""
    mpp = F.col("meters_per_pixel")
    px = lambda v, n: F.greatest(F.lit(0).cast("long"), F.least(F.col(n), v.cast("long")))
    boxed = bounded.join(canvases, "flight_id").withColumns(
        {
            "x0": px(F.floor((F.col("e0") - F.col("origin_east")) / mpp), "out_w"), "x1": px(F.ceil((F.col("e1") - F.col("origin_east")) / mpp), "out_w"),
            "y0": px(F.floor((F.col("origin_north") - F.col("n1")) / mpp), "out_h"), "y1": px(F.ceil((F.col("origin_north") - F.col("n0")) / mpp), "out_h"),
        }
    )
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    each = boxed.where("x1 > x0 and y1 > y0").withColumn("tile_x", F.explode(span("x0", "x1")))
    return each.withColumn("tile_y", F.explode(span("y0", "y1"))).drop("e0", "e1", "n0", "n1")


def compose(tiled: DataFrame, pictures: DataFrame, tile: int = TILE) -> DataFrame:
    """(flight_id, tile_x, tile_y, width, height, data): the raster's tiles as RGB bytes, by rows.

    A pixel is the mean of the pictures that cover it, weighted by how far inside each it lies, and 0 where none does. ``pictures`` has photo_id,
    width, height and data (RGB bytes). A picture is shuffled once, with the list of its tiles, and warped in one task into sums of 16 bytes for each
    pixel of each tile it reaches; sums of a tile are added up in batches, so a tile that thousands of pictures cover is no more than one tile
    in memory. Tiles that no picture reaches have no row.
    """
    pixels = pictures.select("photo_id", F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("data").alias("rgb"))
    place = F.struct(*[F.col(c).cast("long").alias(c) for c in ("tile_x", "tile_y", "out_w", "out_h")])
    raster = F.struct(*[F.col(c).cast("double").alias(c) for c in ("meters_per_pixel", "origin_east", "origin_north")])
    parts = tiled.groupBy("flight_id", "photo_id").agg(F.first("pose").alias("pose"), F.first(raster).alias("raster"), F.collect_list(place).alias("tiles")).join(pixels, "photo_id")

    def warp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                mpp, east, north = (r["raster"][c] for c in ("meters_per_pixel", "origin_east", "origin_north"))
                at = np.array([[1 / mpp, 0, -east / mpp], [0, -1 / mpp, north / mpp], [0, 0, 1]])
                back = np.linalg.inv(at @ np.array(r["pose"]).reshape(3, 3))
                rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["ph"], r["pw"], 3)
                both = images.framed(np.dstack([rgb, images.feather_weights(r["pw"], r["ph"])]))
                for t in r["tiles"]:
                    w, h = min(tile, t["out_w"] - t["tile_x"] * tile), min(tile, t["out_h"] - t["tile_y"] * tile)
                    seen = images.warp_framed(both, back, t["tile_x"] * tile, t["tile_y"] * tile, w, h)
                    weight = np.maximum(seen[..., 3:], 0)
                    if not weight.any():
                        continue  # the box of a turned picture touches tiles that it does not reach
                    sums = np.dstack([seen[..., :3] * weight, weight]).astype(np.float32).tobytes()
                    row = (r["flight_id"], t["tile_x"], t["tile_y"], w, h, sums)
                    types = [pa.int64()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, types, strict=True)], ["flight_id", "tile_x", "tile_y", "w", "h", "sums"])

    warped = parts.select("flight_id", "pose", "raster", "tiles", "pw", "ph", "rgb").mapInArrow(warp, "flight_id long, tile_x long, tile_y long, w long, h long, sums binary")

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, w, h = None, 0, 0
        for b in batches:
            for r in b.itertuples():
                got = np.frombuffer(r.sums, np.float32).reshape(r.h, r.w, 4).astype(np.float64)
                total, w, h = got if total is None else total + got, r.w, r.h
        weight = total[..., 3:]
        rgb = np.where(weight > 0, total[..., :3] / np.where(weight > 0, weight, 1), 0)
        data = np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes()
        yield pd.DataFrame([(*key, w, h, data)], columns=["flight_id", "tile_x", "tile_y", "width", "height", "data"])

    return warped.groupBy("flight_id", "tile_x", "tile_y").applyInPandas(_streamed(add), "flight_id long, tile_x long, tile_y long, width long, height long, data binary")


def _streamed(fn):
    """``fn`` as a grouped function over batches of a group, which the type hints declare."""

    def run(key: tuple[int, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return fn(tuple(int(k) for k in key), batches)

    run.__annotations__ = {"key": tuple[int, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def weighted_mean(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the same: ``keys`` with the weighted mean of ``value``, rounded and held to 0..255; weights of 0 or less count for nothing."""
    some = pixels.where("weight > 0").groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    return some.select(*keys, F.greatest(F.lit(0), F.least(F.lit(255), F.round("mean"))).cast("int").alias("value"))


def corners(canvases: DataFrame, origins: DataFrame) -> DataFrame:
    """(flight_id, corners): top left, top right, bottom right, bottom left of the raster as [lon, lat]."""
    from ..functions.geodesy import from_local

    w, h = F.col("out_w") * F.col("meters_per_pixel"), F.col("out_h") * F.col("meters_per_pixel")
    e, n = F.col("origin_east"), F.col("origin_north")
    at = lambda x, y: F.array(*from_local(x, y, F.col("lat0"), F.col("lon0")))
    return canvases.join(origins, "flight_id").select("flight_id", F.array(at(e, n), at(e + w, n), at(e + w, n - h), at(e, n - h)).alias("corners"))
