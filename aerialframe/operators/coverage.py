"""Coverage of the ground: footprints on a grid, levels, and gaps of thin coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import M_PER_DEG, corners, in_ring, level
from .dealing import dealt

CELL_M, MIN_CELL_M, MAX_CELLS = 3.0, 0.5, 400_000
#: Rows and columns of cells whose photos are dealt together.
BAND, ACROSS = 64, 4096
#: Times a cell is made half as large again at most; 1.5 ^ 60 spans any flight on this planet.
COARSER = 60


def grid(photos: DataFrame, cell_m: float = CELL_M, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """One row for each flight with a footprint: the grid's corner, cell size (metres and degrees), columns and rows.

    Cells start at ``cell_m`` (MIN_CELL_M at least) and grow by half until ``max_cells`` are enough for the box of all footprints; None leaves them as they are.
    """
    ring = F.slice("footprint", 1, 4)
    lons, lats = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    box = photos.where(F.col("footprint").isNotNull()).groupBy("flight_id").agg(
        F.min(F.array_min(lons)).alias("lon0"), F.min(F.array_min(lats)).alias("lat0"), F.max(F.array_max(lons)).alias("lon1"), F.max(F.array_max(lats)).alias("lat1")
    )
    box = box.withColumn("m_lon", M_PER_DEG * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2)))
    width, height = (F.col("lon1") - F.col("lon0")) * F.col("m_lon"), (F.col("lat1") - F.col("lat0")) * M_PER_DEG
    cells = lambda size, cell: F.greatest(F.lit(1), F.ceil(size / cell).cast("long"))
    start = max(cell_m, MIN_CELL_M)
    sizes = F.array(*[F.lit(start * 1.5**k) for k in range(COARSER)])
    box = box.withColumns({"w": width, "h": height})
    fits = F.lit(start) if max_cells is None else F.filter(sizes, lambda c: cells(F.col("w"), c) * cells(F.col("h"), c) <= max_cells)[0]
    box = box.withColumn("cell_m", fits)
    return box.select(
        "flight_id", "lon0", "lat0", "cell_m",
        (F.col("cell_m") / F.col("m_lon")).alias("cell_lon"), (F.col("cell_m") / M_PER_DEG).alias("cell_lat"),
        cells(F.col("w"), F.col("cell_m")).alias("cols"), cells(F.col("h"), F.col("cell_m")).alias("rows"),
    )


def cells(photos: DataFrame, grids: DataFrame) -> DataFrame:
    """(flight_id, row, col, overlap_count) of every cell whose centre lies in a footprint.

    Each footprint is spread over the cells of its own box, its corners side by side with the cell's numbers, and the ring
    test keeps those inside: work follows the footprints' areas, there is no join of cells with photos, and counts are summed
    before the shuffle. A footprint that meets no cell (beyond a pole degrees of longitude count backwards) is left out.
    """
    rings = photos.where(F.col("footprint").isNotNull()).select("flight_id", "footprint").join(grids, "flight_id")
    points = corners(F.col("footprint"))
    xs, ys = [p[0] for p in points], [p[1] for p in points]

    def span(values: list, start: str, size: str, count: str) -> list:
        # a cell's centre is (index + 0.5) cells from the corner; one more on each side against rounding
        low = F.floor((F.least(*values) - F.col(start)) / F.col(size) - 0.5) - 1
        high = F.ceil((F.greatest(*values) - F.col(start)) / F.col(size) - 0.5) + 1
        return [F.greatest(F.lit(0).cast("long"), low), F.least(F.col(count) - 1, high)]

    (c0, c1), (r0, r1) = span(xs, "lon0", "cell_lon", "cols"), span(ys, "lat0", "cell_lat", "rows")
    flat = rings.select(
        "flight_id", "lon0", "lat0", "cell_lon", "cell_lat", c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1"),
        *[v.alias(f"{n}{i}") for n, vs in (("x", xs), ("y", ys)) for i, v in enumerate(vs)],
    )
    flat = flat.where("r0 <= r1 and c0 <= c1")
    # footprints wider than ACROSS, as there are near a pole, are cut
    flat = flat.withColumn("across", F.explode(F.sequence(F.floor(F.col("c0") / ACROSS), F.floor(F.col("c1") / ACROSS))))
    flat = flat.withColumns({"c0": F.greatest("c0", F.col("across") * ACROSS), "c1": F.least("c1", F.col("across") * ACROSS + ACROSS - 1)})
    # photos of one band of rows together, so that counts of a cell are mostly summed where it is met
    flat = dealt(flat.withColumn("band", F.floor(F.col("r0") / BAND)), "flight_id", "band", "across")
    each = flat.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    lon = F.col("lon0") + F.col("col") * F.col("cell_lon") + F.col("cell_lon") / 2
    lat = F.col("lat0") + F.col("row") * F.col("cell_lat") + F.col("cell_lat") / 2
    inside = in_ring(lon, lat, [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)])
    return each.where(inside).groupBy("flight_id", "row", "col").agg(F.count("*").alias("overlap_count"))


def levels(counts: DataFrame) -> DataFrame:
    return counts.withColumn("level", level(F.col("overlap_count")))


def covered_area(counts: DataFrame, grids: DataFrame) -> DataFrame:
    """(flight_id, covered_area_m2)."""
    n = counts.groupBy("flight_id").agg(F.count("*").alias("n"))
    return n.join(grids, "flight_id").select("flight_id", (F.col("n") * F.col("cell_m") * F.col("cell_m")).alias("covered_area_m2"))


def cell_features(counts: DataFrame, grids: DataFrame) -> DataFrame:
    """A GeoJSON polygon for each covered cell; ``place`` orders those of a flight by row and column."""
    lon, lat = F.col("lon0") + F.col("col") * F.col("cell_lon"), F.col("lat0") + F.col("row") * F.col("cell_lat")
    east, north = lon + F.col("cell_lon"), lat + F.col("cell_lat")
    ring = F.array(F.array(lon, lat), F.array(east, lat), F.array(east, north), F.array(lon, north), F.array(lon, lat))
    return levels(counts).join(grids, "flight_id").select(
        "flight_id", F.lit("Polygon").alias("type"), F.to_json(F.array(ring)).alias("coordinates"),
        F.to_json(F.struct(F.col("overlap_count").alias("overlapCount"), "level")).alias("properties"), (F.col("row") * F.col("cols") + F.col("col")).alias("place"),
    )


def _label(cells_: pa.Table) -> pa.Table:
    """Four-neighbour components of one flight's cells: labels fall to the smallest among neighbours until none changes."""
    row, col = cells_.column("row").to_numpy(), cells_.column("col").to_numpy()
    width = int(col.max()) + 2  # an empty column keeps rows apart
    key = row * width + col
    order = np.argsort(key)
    key = key[order]
    links = []
    for step in (1, width):
        at = np.searchsorted(key, key + step)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
        links.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    label = np.arange(len(key))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
    return pa.table({"flight_id": cells_.column("flight_id"), "row": row[order], "col": col[order], "first_cell": key[label]})


def gaps(counts: DataFrame, grids: DataFrame) -> DataFrame:
    """(flight_id, id, lat, lon, cell_count, area_m2): connected cells seen once or twice; empty cells are no part of any gap.

    Components are found flight by flight: a flight has MAX_CELLS cells at most, so no group outgrows a task. ``id`` counts from 0 in the order in
    which a scan by rows meets the gaps.
    """
    red = counts.where("overlap_count < 3").select("flight_id", "row", "col")
    found = dealt(red, "flight_id").groupBy("flight_id").applyInArrow(_label, "flight_id long, row long, col long, first_cell long")
    lat = F.col("lat0") + (F.col("row") + 0.5) * F.col("cell_lat")
    lon = F.col("lon0") + (F.col("col") + 0.5) * F.col("cell_lon")
    sized = found.join(grids, "flight_id").groupBy("flight_id", "first_cell").agg(
        F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count("*").alias("cell_count"), F.first(F.col("cell_m") * F.col("cell_m")).alias("cell_area")
    )
    number = F.expr("row_number() over (partition by flight_id order by first_cell) - 1").cast("long")
    return sized.select("flight_id", number.alias("id"), "lat", "lon", "cell_count", (F.col("cell_count") * F.col("cell_area")).alias("area_m2"))


def by_area(gaps_: DataFrame) -> DataFrame:
    return gaps_.orderBy("flight_id", F.desc("area_m2"), "id")


def gap_labels(gaps_: DataFrame) -> DataFrame:
    """(flight_id, id, label): as shown in a list, numbered from 1 in scan order."""
    text = F.format_string("Gap #%d: %.0f m² at %.6f, %.6f", F.col("id") + 1, "area_m2", "lat", "lon")
    return gaps_.select("flight_id", "id", text.alias("label"))
