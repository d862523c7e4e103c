"""Map tiles of a box: enumeration, fetching with retries, and what was fetched."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import finite
from ..functions.mercator import Box, box_error, contains, tile_x, tile_y

INFO_SCHEMA = ", ".join(f"c_{c} double" for c in Box._fields) + ", max_zoom int, tile_count long, tiles_failed long, bytes long, downloaded_at string"
MAX_TILES, RETRIES, BACKOFF_S, AUTO_ZOOM = 200_000, 5, 0.25, 12
#: Requests of all tasks together; seconds that a request may hear nothing, and may take.
OPEN_REQUESTS, IDLE_S, TOTAL_S = 32, 20.0, 180.0


def check(boxes: DataFrame, max_zoom: int) -> None:
    """Raise the first complaint about a box."""
    bad = boxes.select(box_error(Box.of(), F.lit(max_zoom)).alias("e")).where("e is not null").first()
    if bad:
        raise ValueError(bad.e)


def _ranges(boxes: DataFrame, max_zoom: int) -> DataFrame:
    """(keys, z, x0, x1, y0, y1): the tiles that each box touches at each zoom, ends included."""
    box = Box.of()
    keys = [c for c in boxes.columns if c not in Box._fields]
    per_zoom = boxes.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))))
    last = F.pow(F.lit(2.0), F.col("z")).cast("long") - 1
    held = lambda c: F.greatest(F.lit(0).cast("long"), F.least(last, c))
    z = F.col("z").cast("double")
    return per_zoom.select(
        *keys, "z", held(tile_x(box.min_lon, z)).alias("x0"), held(tile_x(box.max_lon, z)).alias("x1"),
        held(tile_y(box.max_lat, z)).alias("y0"), held(tile_y(box.min_lat, z)).alias("y1"),
    )


def tiles(boxes: DataFrame, max_zoom: int) -> DataFrame:
    """``boxes`` (min_lon, min_lat, max_lon, max_lat and any keys) by tile: z from 0 to ``max_zoom``, x and y of every tile that the box touches."""
    keys = [c for c in boxes.columns if c not in Box._fields]
    rows = _ranges(boxes, max_zoom).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return rows.select(*keys, "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def in_order(found: DataFrame) -> DataFrame:
    """Tiles by zoom, then column, then row: the order in which they are asked for and stored."""
    return found.orderBy("z", "x", "y")


def tile_counts(boxes: DataFrame, max_zoom: int) -> DataFrame:
    """(keys, z, tiles), computed from the ranges; no tile is listed."""
    keys = [c for c in boxes.columns if c not in Box._fields]
    n = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return _ranges(boxes, max_zoom).groupBy(*keys, "z").agg(F.sum(n).alias("tiles"))


def check_count(boxes: DataFrame, max_zoom: int) -> int:
    """The number of tiles of all boxes; raises before any is listed if there are more than MAX_TILES."""
    n = tile_counts(boxes, max_zoom).agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0]
    if n > MAX_TILES:
        raise ValueError(f"This area needs {n} tiles; {MAX_TILES} at most can be fetched. Choose a smaller area or zoom.")
    return n


def without_world(found: DataFrame) -> DataFrame:
    return found.where("z <> 0")


class Refused(Exception):
    """The server does not accept the key."""


def status_of(code: int) -> str:
    """What a response means: ok, missing (no such tile), refused (bad key) or transient."""
    return "ok" if code == 200 else "missing" if code in (204, 404) else "refused" if code in (401, 403) else "transient"


def backoff(attempt: int) -> float:
    return BACKOFF_S * 2 ** min(attempt, 4)


Get = Callable[[int, int, int], tuple[int, bytes]]


def http_get(url: str, idle_s: float = IDLE_S, total_s: float = TOTAL_S) -> Get:
    """Asks a tile server; ``url`` holds {z}, {x} and {y}. A request that hears nothing for ``idle_s`` or takes longer than ``total_s`` fails
    with OSError, as one that finds no connection."""

    def get(z: int, x: int, y: int) -> tuple[int, bytes]:
        deadline = time.monotonic() + total_s
        try:
            with urllib.request.urlopen(url.format(z=z, x=x, y=y), timeout=min(idle_s, total_s)) as answer:
                parts = []
                while part := answer.read1(1 << 16):
                    parts.append(part)
                    if time.monotonic() > deadline:
                        raise TimeoutError("The tile takes too long.")
                data = b"".join(parts)
                if answer.length:
                    raise ConnectionError("The tile is not complete.")
                return answer.status, data
        except urllib.error.HTTPError as e:
            return e.code, b""

    return get


def fetch(found: DataFrame, get: Get, sleep: Callable[[float], None] = time.sleep, open_requests: int = OPEN_REQUESTS) -> DataFrame:
    """``found`` (z, x, y) with ``status`` (ok, missing, failed) and ``data``. ``get`` returns a status code and bytes (see ``http_get``).

    The world tile is asked for first, on the driver: if that is refused or fails, nothing else is fetched. Elsewhere a refusal or what still
    fails after RETRIES tries counts as failed. The cluster has ``open_requests`` under way at most: tiles are dealt to no more tasks than that, which
    share the permits evenly and ask with as many threads as they have. (A task that Spark starts a second time uses its permits again.)
    """

    def one(z: int, x: int, y: int) -> tuple[str, bytes | None]:
        for attempt in range(RETRIES + 1):
            try:
                code, data = get(z, x, y)
                status = status_of(code)
            except OSError:
                status, data = "transient", None
            if status != "transient":
                return ("failed" if status == "refused" else status), data if status == "ok" else None
            if attempt < RETRIES:
                sleep(backoff(attempt))
        return "failed", None

    code = get(0, 0, 0)[0]
    if status_of(code) == "refused":
        raise Refused("The map service did not accept the key.")
    if status_of(code) == "transient":
        raise OSError("The map service can't be reached.")
    tasks = max(1, min(open_requests, found.sparkSession.sparkContext.defaultParallelism))
    permits = max(1, open_requests // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(permits) as pool:
            for b in batches:
                for a in range(0, b.num_rows, 4 * permits):  # no more tiles in memory than a few for each thread
                    some = b.slice(a, 4 * permits)
                    got = list(pool.map(one, *(c.to_pylist() for c in some.columns)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([s for s, _ in got], pa.string()), pa.array([d for _, d in got], pa.binary())], ["z", "x", "y", "status", "data"])

    asked = found.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return asked.repartition(tasks).mapInArrow(run, "z int, x long, y long, status string, data binary")


def summary(fetched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``): tiles written, failed, and bytes. A tile that does not exist counts nowhere."""
    return fetched.groupBy(*by or []).agg(
        F.count_if(F.col("status") == "ok").alias("tile_count"), F.count_if(F.col("status") == "failed").alias("tiles_failed"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
    )


#: The finest grid in which boxes are looked up: cells of 360 / 2^20 degrees, some 40 m.
FINEST = 20


def _cell(lon: Column, lat: Column, level: Column) -> tuple[Column, Column]:
    size = F.lit(360.0) / F.pow(F.lit(2.0), level)
    return F.floor((lon + 180) / size), F.floor((lat + 90) / size)


#: Degrees up to which an outer box is looked up on the grid; boxes that are compared at once.
WIDEST, BLOCK = 3600.0, 1024


def _plain(box: Box) -> Column:
    """Its sides are finite and the right way round."""
    return finite(box.min_lon) & finite(box.min_lat) & finite(box.max_lon) & finite(box.max_lat) & (box.max_lon >= box.min_lon) & (box.max_lat >= box.min_lat)


def _within(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Which of ``inner`` (n x 4) lies in which of ``outer`` (m x 4), n x m; as in Spark NaN is more than any number."""
    out = np.ones((len(inner), len(outer)), bool)
    for k in range(4):
        less, more = (outer[None, :, k], inner[:, None, k]) if k < 2 else (inner[:, None, k], outer[None, :, k])
        out &= (less <= more) | np.isnan(more)
    return out


def _packed(boxes: DataFrame, name: str, largest: bool) -> DataFrame:
    """Distinct boxes (four columns) as rows of BLOCK at most, in one binary column; with ``largest`` without those that lie in another that is met with them."""

    def row(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], [name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 4))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            for at in range(0, len(x), BLOCK):
                kept = np.concatenate([kept, x[at : at + BLOCK]])
                if largest:
                    held = _within(kept, kept)
                    np.fill_diagonal(held, False)
                    kept = kept[~held.any(1)]
                if len(kept) >= BLOCK:
                    yield row(kept[:BLOCK])
                    kept = kept[BLOCK:]
        if len(kept):
            yield row(kept)

    return boxes.select(*[F.col(c).cast("double") for c in boxes.columns]).mapInArrow(run, f"{name} binary")


def _in_blocks(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The boxes of ``inner`` that lie in one of ``outer``, however their sides lie: each block of boxes meets each.

    Blocks of inner boxes are dealt to tasks; those of outer ones, of which only the largest are kept, go to every task, one at a time.
    """
    tasks = int(inner.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = _packed(inner, "i", False).withColumn("task", F.pmod(F.hash("i"), F.lit(tasks)))
    o = _packed(outer, "o", True).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*batch.columns, strict=True):
                a, b = (np.frombuffer(v.as_py()).reshape(-1, 4) for v in (a, b))
                found = a[_within(a, b).any(1)]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], list(Box._fields))

    return i.join(o, "task").select("i", "o").mapInArrow(run, ", ".join(f"{n} double" for n in Box._fields))


def containing(boxes: DataFrame, outer: DataFrame) -> DataFrame:
    """The distinct boxes of ``boxes`` that lie in a box of ``outer`` (with prefix c_), edges included.

    An outer box is put in the four cells or fewer that it touches on the finest grid whose cells are no smaller than it; an inner one looks up
    the cell of its lower left corner on every grid that has outer boxes. So each pair that may fit meets once, by equality of cells, and is then tested.

    Sides alone decide, also for boxes that no place lies in (a side beyond its opposite one, as where the world's end cuts a box that lies beyond it): such
    an inner box may fit outer ones that its corner does not lie in, so it meets all of them, block by block. So do boxes without end.
    """
    b, c = Box.of(), Box.of("c_")
    inner = boxes.select(*Box._fields).distinct()
    outer = outer.select(*[f"c_{n}" for n in Box._fields]).distinct()
    wide = F.greatest(c.max_lon - c.min_lon, c.max_lat - c.min_lat)
    fitting = F.when(wide <= 0, FINEST).otherwise(F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(360.0 / wide)))))
    on_grid = outer.where(_plain(c) & (wide <= WIDEST)).withColumn("level", fitting.cast("int"))
    (x0, y0), (x1, y1) = _cell(c.min_lon, c.min_lat, F.col("level")), _cell(c.max_lon, c.max_lat, F.col("level"))
    cells = on_grid.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))
    asked = inner.where(_plain(b)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINEST))))
    asked = asked.join(cells.select("level").distinct(), "level", "left_semi")
    at = _cell(b.min_lon, b.min_lat, F.col("level"))
    asked = asked.withColumns({"cx": at[0], "cy": at[1]})
    pairs = asked.alias("i").join(cells.alias("o"), (F.col("i.level") == F.col("o.level")) & (F.col("i.cx") == F.col("o.cx")) & (F.col("i.cy") == F.col("o.cy")) & contains(c, b), "left_semi")
    # the rest: inner boxes that are not plain with all outer ones, plain ones with those too wide for a grid
    outer = outer.where(" and ".join(f"c_{n} is not null" for n in Box._fields))
    odd = _in_blocks(inner.where(" and ".join(f"{n} is not null" for n in Box._fields)).where(~_plain(b)), outer)
    endless = outer.where((c.max_lon >= c.min_lon) & (c.max_lat >= c.min_lat) & ~(_plain(c) & (wide <= WIDEST)))
    return pairs.select(*Box._fields).unionByName(odd).unionByName(_in_blocks(inner.where(_plain(b)), endless)).distinct()


def reusable(flights: DataFrame, cached: DataFrame, zoom: int = AUTO_ZOOM, on: str | None = None) -> DataFrame:
    """Flights whose box lies in a cached basemap that is complete and deep enough. ``cached`` has a box with prefix c_, tiles_failed, max_zoom.

    ``on`` names a column of both that says which basemap is a flight's; without it any basemap may hold any flight (see ``containing``).
    A flight whose box has a null side is in none.
    """
    good = cached.where(f"tiles_failed = 0 and max_zoom >= {int(zoom)}")
    if on is not None:
        return flights.join(good, (flights[on] == good[on]) & contains(Box.of("c_"), Box.of()), "left_semi")
    return flights.join(containing(flights, good), list(Box._fields), "left_semi").select(*flights.columns)


def info(spark: SparkSession, path: str) -> DataFrame | None:
    """The one-row description next to a tile table, or None if either is missing."""
    try:
        found = spark.read.schema(INFO_SCHEMA).json(f"{path.rstrip('/')}.info")
        spark.read.parquet(path)
    except AnalysisException:
        return None
    return found


def write_info(fetched: DataFrame, box: DataFrame, max_zoom: int, path: str) -> None:
    """Describe a tile table: its box, depth, what was fetched, and when."""
    at = box.first()
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("downloaded_at")
    named = [F.lit(at[c]).alias(f"c_{c}") for c in Box._fields]
    summary(fetched).select(*named, F.lit(max_zoom).alias("max_zoom"), "tile_count", "tiles_failed", "bytes", stamp).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.info")
