"""Queries over flights that lie near and beyond the poles, as the flights of large tables do, against their SQL."""

import math

import duckdb
import numpy as np
import pytest

from aerialframe import catalog
from aerialframe.operators import basemap, coverage

#: Flights of the derived table lie 0.01 degrees apart from 10 degrees north on: before, at and beyond the end of the map and the poles.
FLIGHTS = (0, 3, 7497, 7504, 7505, 7506, 7508, 7511, 7518, 7521, 7998, 8002, 8003, 8006, 17_000, 25_998, 26_002, 30_003, 44_002, 52_002)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder with an events table of ten photos of each of FLIGHTS."""
    d, con = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    places = ", ".join(f"({k}, {f})" for k, f in enumerate(FLIGHTS))
    con.execute(f"""copy (SELECT e.* REPLACE (p.flight * 100 + e.event_id % 100 AS event_id) FROM '/root/testdata/sf0.01/events.parquet' e
        JOIN (VALUES {places}) p(k, flight) ON e.event_id // 100 = p.k WHERE e.event_id % 10 = e.event_id // 10 % 10) TO '{d}/events.parquet' (FORMAT parquet)""")
    return d


def against_sql(spark, d, name):
    """Rows of the query that are not those of its SQL, and the reverse; numbers may differ by a rounding of the ninth digit."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    want, got = want.fetchall(), [tuple(r) for r in catalog.QUERIES[name](spark, d).select(*columns).collect()]
    key = lambda row: tuple(str(v) for v in row if not isinstance(v, float))
    same = lambda a, b: all((math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-9) if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b, strict=True))
    assert len(got) == len(want), name
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert same(a, b), (name, a, b)
    return got


def test_zoom_of_boxes_beyond_the_map(spark, far):
    zooms = [z for _, z in against_sql(spark, far, "cover_zoom")]
    assert len(zooms) == len(FLIGHTS) and any(math.isnan(z) for z in zooms) and any(0 < z < math.inf for z in zooms)


def test_shape_of_boxes_beyond_the_map(spark, far):
    sides = against_sql(spark, far, "aspect_fit")
    assert any(math.isnan(s[1]) and s[3] == 180 for s in sides) and any(math.isfinite(s[1]) and s[2] > 85 for s in sides)


def test_cells_of_flights_beyond_the_poles(spark, far):
    """No cells run backwards from a flight whose degrees of longitude do."""
    cells = against_sql(spark, far, "coverage_cells")
    assert min(min(row, col) for _, row, col, _ in cells) == 0 and {f for f, *_ in cells} < set(FLIGHTS)


def test_wide_footprints_on_cells_that_do_not_grow(spark):
    """A footprint of 9,500 columns is cut at 4,096 and covers what it would in one piece; its cells stay as asked for."""
    ring = [[106.0, 0.0], [106.852, 0.0], [106.852, 0.0004], [106.0, 0.0004], [106.0, 0.0]]
    photos = spark.createDataFrame([(1, 0, ring)], "flight_id long, photo_id long, footprint array<array<double>>")
    grids = coverage.grid(photos, 10.0, None)
    g, counts = grids.first(), coverage.cells(photos, grids)
    assert g.cell_m == 10 and g.cols > 2 * coverage.ACROSS and coverage.grid(photos, 0.5).first().cell_m > 0.5
    assert coverage.grid(photos, 0.5, None).first().cell_m == 0.5
    assert counts.where("overlap_count = 1").count() == counts.select("row", "col").distinct().count()
    assert (g.cols - 1) * (g["rows"] - 1) <= counts.count() <= g.cols * g["rows"]


def test_levels_of_flights_beyond_the_poles(spark, far):
    assert against_sql(spark, far, "coverage_levels")


def test_area_of_flights_beyond_the_poles(spark, far):
    assert {f for f, _ in against_sql(spark, far, "covered_area")} < set(FLIGHTS)


def test_red_cells_of_flights_beyond_the_poles(spark, far):
    assert against_sql(spark, far, "red_cell_totals")


def test_polygons_of_flights_beyond_the_poles(spark, far):
    """Row by row and to the last bit: halves are rounded as the SQL rounds them."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{far}/events.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["cell_polygons"](spark, far).select("flight_id", "place", "corner", "lon", "lat", "overlap_count", "level").collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT flight_id, place, corner, lon, lat, overlap_count, level FROM ({catalog.ORACLES['cell_polygons']})").fetchall())


def test_basemaps_of_flights_beyond_the_map(spark, far):
    assert len(against_sql(spark, far, "basemap_containment")) > len(FLIGHTS) / 2


def test_boxes_with_sides_in_any_order(spark, monkeypatch):
    """As comparing all pairs, in blocks of a few boxes: turned, endless and very wide boxes, equal sides, NaN and null among them."""
    monkeypatch.setattr(basemap, "BLOCK", 16)
    r = np.random.default_rng(0)
    odd = [math.inf, -math.inf, math.nan, None, 1e9, -1e9, 0.0]
    made = lambda n, grow: [tuple(odd[r.integers(7)] if r.random() < 0.04 else round(float(v), 1) + 0.0 for v in (x - grow, y - grow, x + w + grow, y + h + grow)) for x, y, w, h in zip(*r.uniform(-3, 3, (4, n)), strict=True)]
    inner, outer = made(300, 0.0), made(120, 0.7)
    over = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    fits = lambda i, o: None not in (*i, *o) and all(over(o[k]) <= over(i[k]) for k in (0, 1)) and all(over(o[k]) >= over(i[k]) for k in (2, 3))
    want = {str(i) for i in inner if any(fits(i, o) for o in outer)}
    schema = lambda p: ", ".join(f"{p}{n} double" for n in basemap.Box._fields)
    got = basemap.containing(spark.createDataFrame(inner, schema("")), spark.createDataFrame(outer, schema("c_"))).collect()
    assert {str(tuple(g)) for g in got} == want and len(got) == len(want) and any(i[1] > i[3] for i in inner if None not in i and str(i) in want)
