import gzip
import http.server
import json
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.sources import pmtiles


def number(z, x, y):
    """The place of a tile on the curve, by recursion over quadrants."""
    d, n = 0, 1 << z
    while n > 1:
        n //= 2
        q = {(0, 0): 0, (0, 1): 1, (1, 1): 2, (1, 0): 3}[x // n, y // n]
        d += q * n * n
        x, y = x % n, y % n
        if q == 0:
            x, y = y, x
        elif q == 3:
            x, y = n - 1 - y, n - 1 - x
    return (4**z - 1) // 3 + d


def look_up(data: bytes, z: int, x: int, y: int) -> bytes | None:
    """One tile of an archive, read byte by byte as the format describes it."""
    at = struct.unpack("<11Q", data[8:96])
    (root, root_size, _, _, leaves, _, tiles, _, _, _, _), want = at, number(z, x, y)
    offset, size = root, root_size
    for _ in range(4):
        raw, k, values = gzip.decompress(data[offset : offset + size]), 0, []
        while k < len(raw):
            shift = value = 0
            while True:
                value |= (raw[k] & 127) << shift
                shift, k = shift + 7, k + 1
                if raw[k - 1] < 128:
                    break
            values.append(value)
        n, last, rows = values[0], 0, []
        for i in range(n):
            last += values[1 + i]
            o = values[1 + 3 * n + i]
            rows.append([last, values[1 + n + i], values[1 + 2 * n + i], o - 1 if o else rows[-1][3] + rows[-1][2]])
        best = [r for r in rows if r[0] <= want]
        if not best:
            return None
        first, run, size, o = best[-1]
        if run:
            return data[tiles + o : tiles + o + size] if want < first + run else None
        offset = leaves + o
    raise AssertionError


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Two archives; the large one needs leaves and holds equal neighbours, equal tiles far apart, and gaps."""
    path = tmp_path_factory.mktemp("archives")
    r = np.random.default_rng(1)
    tiles = {(z, x, y): b"sea" if (x // 8 + y // 8) % 3 == 0 else b"%d/%d/%d" % (z, x, y) * int(r.integers(1, 9)) for z in range(8) for x in range(1 << z) for y in range(1 << z) if (x + y) % 17}
    rows = [("a", *k, v) for k, v in tiles.items()] + [("b", 3, 1, 2, b"one"), ("b", 3, 1, 2, b"one"), ("b", 3, 1, 3, None), ("lost", 0, 0, 0, b"no box")]
    df = spark.createDataFrame(rows, "archive string, z int, x long, y long, data binary").repartition(6)
    boxes = spark.createDataFrame([(k, -10.0, -20.0, 30.0, 40.5) for k in "abe"], "archive string, min_lon double, min_lat double, max_lon double, max_lat double")
    pmtiles.write_archives(df, boxes, 7, str(path), {"name": "test"})
    return path, tiles


def test_numbers(spark):
    tiles = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)] + [(26, 12345678, 45678901), (15, 3, 32767)]
    want = [number(*t) for t in tiles]
    df = spark.createDataFrame(tiles, "z int, x long, y long")
    assert [r[0] for r in df.select(pmtiles.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()] == want
    assert [tuple(int(v) for v in t) for t in zip(*pmtiles.place(np.array(want)), strict=True)] == tiles
    values = np.array([0, 1, 127, 128, 300, 2**40, 2**62, 5])
    assert (pmtiles.numbers(pmtiles.varints(values)) == values).all() and pmtiles.varints(np.array([300])) == b"\xac\x02"


def test_every_tile_is_found(archive):
    path, tiles = archive
    assert sorted(p.name for p in path.iterdir()) == ["a.pmtiles", "b.pmtiles", "e.pmtiles"]
    data = (path / "a.pmtiles").read_bytes()
    at = struct.unpack("<11Q", data[8:96])
    assert at[5] > 0 and at[1] <= 16_384 - 127 and at[8] == len(tiles) and at[10] == len(set(tiles.values())) and at[6] + at[7] == len(data)
    assert at[7] == sum(map(len, set(tiles.values()))) and at[9] < at[8]
    for k in [*list(tiles)[::37], (7, 127, 127), (0, 0, 0), (7, 1, 16), (8, 0, 0)]:
        assert look_up(data, *k) == tiles.get(k)
    assert struct.unpack("<4i", data[102:118]) == (-100_000_000, -200_000_000, 300_000_000, 405_000_000) and data[99] == 1 and data[100:102] == bytes([1, 7])
    assert json.loads(gzip.decompress(data[at[2] : at[2] + at[3]]))["name"] == "test"
    assert look_up((path / "b.pmtiles").read_bytes(), 3, 1, 2) == b"one" and look_up((path / "b.pmtiles").read_bytes(), 3, 1, 3) is None
    assert look_up((path / "e.pmtiles").read_bytes(), 0, 0, 0) is None


def test_read_back(spark, archive):
    path, tiles = archive
    got = pmtiles.read_archive(spark, str(path / "a.pmtiles")).collect()
    assert len(got) == len(tiles) and {(r.z, r.x, r.y): bytes(r.data) for r in got} == tiles
    box = dict(z0=3, z1=6, x0=5, x1=20, y0=40, y1=47)
    got = pmtiles.read_archive(spark, str(path / "a.pmtiles"), **box).collect()
    want = {(z, x, y): v for (z, x, y), v in tiles.items() if 3 <= z <= 6 and 5 >> 6 - z <= x <= 20 >> 6 - z and 40 >> 6 - z <= y <= 47 >> 6 - z}
    assert len(got) == len(want) > 100 and {(r.z, r.x, r.y): bytes(r.data) for r in got} == want
    assert pmtiles.read_archive(spark, str(path / "e.pmtiles")).collect() == []


def test_only_ranges_of_the_box_are_read(archive, monkeypatch):
    path, tiles = archive
    monkeypatch.setattr(pmtiles, "BRIDGE", 64)
    monkeypatch.setattr(pmtiles, "LEAF", 256)
    data = (path / "a.pmtiles").read_bytes()
    head = pmtiles.header(lambda o, n: data[o : o + n])
    box, asked = (7, 7, 100, 103, 60, 63), []

    def read(offset, length):
        asked.append((offset, length))
        return data[offset : offset + length]

    parts = pmtiles.planned(read, box)
    got = {(z, x, y): v for p in parts for z, x, y, v in pmtiles.fetched(read, p, box)}
    assert got == {k: v for k, v in tiles.items() if k[0] == 7 and 100 <= k[1] <= 103 and 60 <= k[2] <= 63}
    leaves = [a for a in asked if head["leaves_at"] <= a[0] < head["data_at"]]
    body = [a for a in asked if a[0] >= head["data_at"]]
    assert sum(n for _, n in leaves) < head["leaves_size"] and sum(n for _, n in body) < 4000 < head["data_size"] / 20
    for low, high in ((0, 10), (5461, 9000), (12000, 12100), (21844, 21845)):  # against every tile
        ids = np.arange(low, high + 1)
        assert pmtiles.meets(low, high, box) == pmtiles.inside(ids, box).any()


def test_over_http(spark, archive):
    path, tiles = archive
    data, asked = (path / "a.pmtiles").read_bytes(), []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append(b - a + 1)
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = pmtiles.read_archive(spark, f"http://127.0.0.1:{server.server_port}/a.pmtiles", z0=5, z1=5, x0=3, x1=4, y0=9, y1=9).collect()
    finally:
        server.shutdown()
    assert {(r.z, r.x, r.y): bytes(r.data) for r in got} == {k: tiles[k] for k in ((5, 3, 9), (5, 4, 9)) if k in tiles}
    assert 127 in asked and sum(asked) < len(data) / 2


def test_not_an_archive(tmp_path):
    (tmp_path / "x").write_bytes(b"z" * 200)
    with pytest.raises(ValueError, match="PMTiles"):
        pmtiles.header(pmtiles.opened(str(tmp_path / "x")))
