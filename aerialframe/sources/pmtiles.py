"""PMTiles archives: written from tables of tiles, and read by ranges of bytes."""

from __future__ import annotations

import gzip
import json
import struct
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.mercator import MAX_ZOOM
from .files import located, write_pieces

# Fixed values of the format, version 3: sizes of the header and of header and root together, codes of no compression and gzip, of vector tiles.
HEADER, FRONT, PLAIN, GZIP, VECTOR = 127, 16_384, 1, 2, 1
#: Entries of a leaf directory; tiles of one archive at most, as its directories are made by one task.
LEAF, MOST = 4096, 1 << 20
#: Bytes between wanted tiles that are read along rather than asked for apart; bytes of a partition.
BRIDGE, PART_BYTES = 1 << 16, 16 << 20


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """The place of a tile on the Hilbert curve of its zoom, after all smaller zooms."""
    shifted = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        n = shifted(k)
        right, up = F.when(s.x.bitwiseAND(n) > 0, 1).otherwise(0).cast("long"), F.when(s.y.bitwiseAND(n) > 0, 1).otherwise(0).cast("long")
        d = s.d + n * n * (3 * right).bitwiseXOR(up)
        turned = (up == 0) & (right == 1)
        x, y = F.when(turned, n - 1 - s.x.bitwiseAND(n - 1)).otherwise(s.x.bitwiseAND(n - 1)), F.when(turned, n - 1 - s.y.bitwiseAND(n - 1)).otherwise(s.y.bitwiseAND(n - 1))
        return F.struct(F.when(up == 0, y).otherwise(x).alias("x"), F.when(up == 0, x).otherwise(y).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.call_function("div", shifted(2 * z.cast("int")) - 1, F.lit(3).cast("long")) + F.aggregate(levels, start, step, lambda s: s.d)


def place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, x, y) of tile ids."""
    ids = np.asarray(ids, np.int64)
    starts = np.array([(4**z - 1) // 3 for z in range(32)], np.int64)
    z = np.searchsorted(starts, ids, "right") - 1
    d = ids - starts[z]
    x, y = np.zeros_like(ids), np.zeros_like(ids)
    for k in range(int(z.max(initial=0))):
        n, live = np.int64(1 << k), k < z
        right, up = (d >> 1) & 1, (d ^ (d >> 1)) & 1
        turned = (up == 0) & (right == 1)
        a, b = np.where(turned, n - 1 - x, x), np.where(turned, n - 1 - y, y)
        a, b = np.where(up == 0, b, a), np.where(up == 0, a, b)
        x, y, d = np.where(live, a + n * right, x), np.where(live, b + n * up, y), np.where(live, d >> 2, d)
    return z, x, y


def varints(values: np.ndarray) -> bytes:
    """Numbers in sevens of bits, least first, all but the last of a number marked."""
    left = np.asarray(values, np.uint64).copy()
    digits, live = [], np.ones(len(left), bool)
    keep = []
    while live.any():
        more = left >= 128
        digits.append(((left & np.uint64(127)) | np.where(more, np.uint64(128), np.uint64(0))).astype(np.uint8))
        keep.append(live)
        live, left = live & more, left >> np.uint64(7)
    return np.stack(digits, 1)[np.stack(keep, 1)].tobytes() if digits else b""


def numbers(data: bytes) -> np.ndarray:
    """What ``varints`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(raw) else np.empty(0, np.int64)


def directory(ids: np.ndarray, runs: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> bytes:
    """Entries, compressed: counts of their ids, run lengths, sizes and offsets, 0 where an entry follows the one before."""
    follows = np.concatenate([[False], offsets[1:] == offsets[:-1] + sizes[:-1]]) if len(ids) else np.empty(0, bool)
    columns = [[len(ids)], np.diff(ids, prepend=0), runs, sizes, np.where(follows, 0, offsets + 1)]
    return gzip.compress(b"".join(varints(np.asarray(c)) for c in columns), mtime=0)


def entries(data: bytes, compression: int = GZIP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, runs, sizes, offsets) of a directory."""
    found = numbers(gzip.decompress(data) if compression == GZIP else data)
    n = int(found[0])
    ids, runs, sizes, stored = (found[1 + k * n : 1 + (k + 1) * n] for k in range(4))
    # an entry that follows begins where those since the last written offset end
    fresh = np.flatnonzero(stored > 0)
    since = np.searchsorted(fresh, np.arange(n), "right") - 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.cumsum(ids), runs, sizes, stored[fresh[since]] - 1 + ends[:-1] - ends[fresh[since]] if n else stored


def _directories(ids: np.ndarray, runs: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> tuple[bytes, bytes]:
    """(root, leaves): all entries in the root if they fit, else leaves of LEAF entries or more and a root that lists them."""
    root = directory(ids, runs, sizes, offsets) if len(ids) <= LEAF else b""
    if root and len(root) <= FRONT - HEADER:
        return root, b""
    step = LEAF
    while True:
        cuts = range(0, len(ids), step)
        parts = [directory(*(c[a : a + step] for c in (ids, runs, sizes, offsets))) for a in cuts]
        lengths = np.array([len(p) for p in parts], np.int64)
        root = directory(ids[:: step], np.zeros(len(parts), np.int64), lengths, np.cumsum(lengths) - lengths)
        if len(root) <= FRONT - HEADER:
            return root, b"".join(parts)
        step *= 2


def front(ids: np.ndarray, runs: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, total: int, box: tuple[float, float, float, float], zooms: tuple[int, int], metadata: dict, compression: int) -> bytes:
    """Header, root, metadata and leaves of an archive whose tile data follow, ``total`` bytes."""
    root, leaves = _directories(ids, runs, sizes, offsets)
    about = gzip.compress(json.dumps(metadata).encode(), mtime=0)
    at = HEADER + len(root)
    e7 = [round(v * 1e7) for v in box]
    centre = [(e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2]
    head = struct.pack(
        "<7sB11QBBBBBB4iB2i", b"PMTiles", 3, HEADER, len(root), at, len(about), at + len(about), len(leaves), at + len(about) + len(leaves), total,
        int(runs.sum()), len(ids), len(np.unique(offsets)), 1, GZIP, compression, VECTOR, *zooms, *e7, zooms[0], *centre,
    )
    return head + root + about + leaves


def archive_pieces(tiles: DataFrame, boxes: DataFrame, max_zoom: int, metadata: dict | None = None, compression: int = PLAIN) -> DataFrame:
    """Pieces of ``<archive>.pmtiles`` for each archive of ``tiles`` (archive, z, x, y, data) and ``boxes`` (archive and the four sides).

    Equal tiles of an archive are stored once, in the order in which the Hilbert curve first meets them; neighbours on the curve that are
    equal share an entry. Tiles are never gathered: their sizes and digests give the directories, a task for each archive (MOST tiles
    at most, else it raises), and the data go straight to the sink, by offset. Of tiles that stand repeatedly the one with the smallest digest counts;
    null data are no tile. An archive without tiles has empty directories. ``compression`` says how the tiles' bytes are packed (PLAIN or GZIP).
    """
    keys = ["archive", "id"]
    rows = tiles.where("data is not null").select("archive", tile_id(F.col("z"), F.col("x"), F.col("y")).cast("long").alias("id"), "z", "data")
    rows = rows.withColumns({"digest": F.sha2("data", 256), "size": F.octet_length("data").cast("long")})
    kept = rows.select(*keys, "digest", "size").groupBy(*keys).agg(F.min(F.struct("digest", "size")).alias("d")).select(*keys, "d.*")
    name = F.concat(F.col("archive").cast("string"), F.lit(".pmtiles"))
    about = {"vector_layers": []} | (metadata or {})
    schema = "name string, seq long, data binary"

    def made(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        box = t.slice(0, 1).to_pylist()[0]
        some = t.filter(t.column("size").is_valid())
        ids, sizes = (some.column(c).to_numpy() for c in ("id", "size"))
        if len(ids) > MOST:
            raise ValueError(f"An archive can't hold more than {MOST} tiles.")
        _, first, same = np.unique(np.array(some.column("digest").to_pylist(), object), return_index=True, return_inverse=True) if len(ids) else (None, *[np.empty(0, np.int64)] * 2)
        order = np.argsort(first, kind="stable")  # contents by the first tile that holds them
        ends = np.cumsum(sizes[first[order]])
        offset = np.empty(len(first), np.int64)
        offset[order] = ends - sizes[first[order]]
        offsets = offset[same]
        new = np.concatenate([[True], (offsets[1:] != offsets[:-1]) | (ids[1:] != ids[:-1] + 1)])[: len(ids)] if len(ids) else np.empty(0, bool)
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(ids)))
        zooms = (int(place(ids[:1])[0][0]), int(place(ids[-1:])[0][0])) if len(ids) else (0, max_zoom)
        data = front(ids[at], runs, sizes[at], offsets[at], int(ends[-1]) if len(ends) else 0, (box["min_lon"], box["min_lat"], box["max_lon"], box["max_lat"]), zooms, about, compression)
        return pa.table({"name": pa.array([box["name"]]), "seq": pa.array([-1], pa.int64()), "data": pa.array([data], pa.binary())})

    sides = boxes.select("archive", "min_lon", "min_lat", "max_lon", "max_lat")
    heads = sides.join(kept, "archive", "left").select(name.alias("name"), "id", "digest", "size", *sides.columns[1:]).groupBy("name").applyInArrow(made, schema)
    # one row holds each content: its data lie by the first tile that has it
    firsts = kept.groupBy("archive", "digest").agg(F.min("id").alias("id"))
    firsts = firsts.join(sides.select("archive"), "archive", "left_semi")
    data = rows.join(firsts, ["archive", "digest", "id"]).groupBy("archive", "digest", "id").agg(F.first("data").alias("data"))
    return heads.union(data.select(name.alias("name"), F.col("id").alias("seq"), "data"))


def write_archives(tiles: DataFrame, boxes: DataFrame, max_zoom: int, path: str, metadata: dict | None = None, compression: int = PLAIN) -> None:
    """Write ``archive_pieces`` below ``path``; an archive appears when all are complete, and replaces an earlier one of its name."""
    write_pieces(archive_pieces(tiles, boxes, max_zoom, metadata, compression), path)


Read = Callable[[int, int], bytes]


def opened(path: str) -> Read:
    """Reads (offset, length) of a file in a store of pyarrow's, or of an HTTP server that serves ranges."""
    if urllib.parse.urlparse(path).scheme in ("http", "https"):

        def fetch(offset: int, length: int) -> bytes:
            asked = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
            with urllib.request.urlopen(asked, timeout=60) as answer:
                if answer.status != 206:
                    raise OSError("The server does not serve ranges.")
                return answer.read()

        return fetch
    store, at = located(path)
    source = store.open_input_file(at)
    return lambda offset, length: source.read_at(length, offset)


def header(read: Read) -> dict:
    names = ("root_at", "root_size", "about_at", "about_size", "leaves_at", "leaves_size", "data_at", "data_size", "addressed", "entries", "contents", "clustered", "inner", "outer", "kind", "min_zoom", "max_zoom", "min_lon", "min_lat", "max_lon", "max_lat", "zoom", "lon", "lat")
    data = read(0, HEADER)
    if data[:8] != b"PMTiles\x03":
        raise ValueError("This is no PMTiles archive of version 3.")
    return dict(zip(names, struct.unpack("<11QBBBBBB4iB2i", data[8:HEADER]), strict=True))


@dataclass
class Tiles(InputPartition):
    #: (first id, run, offset, size) of entries that lie close together
    entries: list[tuple[int, int, int, int]]


def wanted(ids: np.ndarray, runs: np.ndarray, box: tuple[int, int, int, int, int, int]) -> np.ndarray:
    """Which entries hold a tile of the box (z0, z1, x0, x1, y0, y1 at z1, ends included)."""
    found = inside(ids, box)
    for k in np.flatnonzero(~found & (runs > 1)).tolist():
        found[k] = meets(int(ids[k]), int(ids[k] + runs[k]) - 1, box)
    return found


def inside(ids: np.ndarray, box: tuple[int, int, int, int, int, int]) -> np.ndarray:
    z0, z1, x0, x1, y0, y1 = box
    z, x, y = place(ids)
    up = np.maximum(z1 - z, 0)
    return (z >= z0) & (z <= z1) & (x >= x0 >> up) & (x <= x1 >> up) & (y >= y0 >> up) & (y <= y1 >> up)


def meets(low: int, high: int, box: tuple[int, int, int, int, int, int]) -> bool:
    """Whether a tile of the box has an id from ``low`` to ``high``; squares of the curve that lie outside of either are left as a whole."""
    z0, z1, x0, x1, y0, y1 = box
    for z in range(z0, z1 + 1):
        start, up = (4**z - 1) // 3, z1 - z
        a, b = max(low - start, 0), min(high - start, 4**z - 1)
        if a > b:
            continue
        squares = [(z, 0)]  # 4^k tiles of zoom z from the number m * 4^k on are a square of side 2^k
        while squares:
            k, m = squares.pop()
            first, last = m << 2 * k, ((m + 1) << 2 * k) - 1
            if last < a or first > b:
                continue
            _, x, y = (int(v[0]) for v in place(np.array([(4 ** (z - k) - 1) // 3 + m])))
            if (x + 1) << k <= x0 >> up or x << k > x1 >> up or (y + 1) << k <= y0 >> up or y << k > y1 >> up:
                continue
            whole = x << k >= x0 >> up and (x + 1) << k <= (x1 >> up) + 1 and y << k >= y0 >> up and (y + 1) << k <= (y1 >> up) + 1
            if k == 0 or whole:
                return True
            squares += [(k - 1, 4 * m + j) for j in range(4)]
    return False


def planned(read: Read, box: tuple[int, int, int, int, int, int] | None = None) -> list[Tiles]:
    """The entries that hold tiles of the box, in parts of about PART_BYTES. Header, root and the leaves that can hold such tiles are read, nothing else."""
    head = header(read)
    box = box or (0, head["max_zoom"], 0, (1 << head["max_zoom"]) - 1, 0, (1 << head["max_zoom"]) - 1)
    level = [entries(read(head["root_at"], head["root_size"]), head["inner"])]
    found = []
    while level:
        below = []
        for ids, runs, sizes, offsets in level:
            last = np.append(ids[1:], np.iinfo(np.int64).max) - 1  # a leaf holds ids up to the next entry
            leaf = np.flatnonzero(runs == 0)
            leaf = [k for k in leaf.tolist() if meets(int(ids[k]), int(last[k]), box)]
            below += [entries(read(head["leaves_at"] + int(offsets[k]), int(sizes[k])), head["inner"]) for k in leaf]
            mine = np.flatnonzero(runs > 0)
            mine = mine[wanted(ids[mine], runs[mine], box)]
            found += zip(ids[mine].tolist(), runs[mine].tolist(), (offsets[mine] + head["data_at"]).tolist(), sizes[mine].tolist(), strict=True)
        level = below
    found.sort(key=lambda e: (e[2], e[0]))
    parts, size = [], PART_BYTES
    for e in found:
        if size >= PART_BYTES:
            parts.append(Tiles([]))
            size = 0
        parts[-1].entries.append(e)
        size += e[3]
    return parts


def ranges(held: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(offset, length, entries) to read: entries that lie within BRIDGE of each other together."""
    now: list[tuple[int, int, int, int]] = []
    end = 0
    for e in held:
        if now and e[2] > end + BRIDGE:
            yield now[0][2], end - now[0][2], now
            now = []
        end = max(end, e[2] + e[3]) if now else e[2] + e[3]
        now.append(e)
    if now:
        yield now[0][2], end - now[0][2], now


def fetched(read: Read, part: Tiles, box: tuple[int, int, int, int, int, int] | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(z, x, y, data) of the tiles of a part."""
    for offset, length, held in ranges(part.entries):
        data = read(offset, length)
        for first, run, at, size in held:
            ids = np.arange(first, first + run)
            ids = ids if box is None else ids[inside(ids, box)]
            for z, x, y in zip(*(v.tolist() for v in place(ids)), strict=True):
                yield z, x, y, data[at - offset : at - offset + size]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, box: tuple[int, int, int, int, int, int] | None):
        self.path, self.box = path, box

    def partitions(self) -> list[Tiles]:
        return planned(opened(self.path), self.box) or [Tiles([])]

    def read(self, partition: Tiles) -> Iterator[tuple]:
        if partition.entries:
            yield from fetched(opened(self.path), partition, self.box)


class Archive(DataSource):
    """``spark.read.format("pmtiles").load(path)``: (z, x, y, data). The options z0 and z1 (zooms), and x0, x1, y0, y1 (at z1, ends included), keep a box."""

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "z int, x long, y long, data binary"

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        if "z1" not in o:
            return ArchiveReader(o["path"], None)
        z1 = int(o["z1"])
        if not 0 <= z1 <= max(MAX_ZOOM, 26):
            raise ValueError("z1 has to be a zoom.")
        most = (1 << z1) - 1
        return ArchiveReader(o["path"], (int(o.get("z0", 0)), z1, int(o.get("x0", 0)), int(o.get("x1", most)), int(o.get("y0", 0)), int(o.get("y1", most))))


def read_archive(spark, path: str, **box: int) -> DataFrame:
    """The tiles of an archive, or those of a box (z0, z1, and x0, x1, y0, y1 at zoom z1): leaf directories and data outside of it are not read."""
    spark.dataSource.register(Archive)
    return spark.read.format("pmtiles").options(**{k: str(v) for k, v in box.items()}).load(path)
