"""The report of an inspection: its lines and their pages, PDF files, and JSON documents that are written as they come."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import save_sorted

# Fixed values of an A4 page in millimetres: width, height, where text begins, its left edge, and the lowest line.
PAGE_W, PAGE_H, TOP, LEFT, BOTTOM = 210, 297, 280, 15, 20
# Fixed values of each kind of line: space before it, room it needs to stay on the page (the title asks for none), and what it moves down.
STEPS = {"title": (0, None, 12), "heading": (2, 12, 8), "line": (0, 6, 6)}
# What the heading of a further page moves down; sizes of letters.
NEXT_PAGE_MM, SIZES, NEXT_PAGE_SIZE = 10, {"title": 18, "heading": 13, "line": 11}, 11
# Fixed text of the report.
TITLE, GAPS, NO_GAPS, BLURRY, NO_BLURRY = "Flight Inspection Report", "Gaps (fly-back coordinates):", "None - full coverage.", "Blurry photos:", "None detected."
#: Lines that are laid out together.
CHUNK = 4096


def lines(metrics: DataFrame, gaps: DataFrame, blur_alerts: DataFrame) -> DataFrame:
    """(flight_id, n, kind, text): a title, seven summary lines, all gaps by area, then all blurry photos in the order of ``sort_key`` and file name.

    ``n`` counts the lines of a flight from 0. ``kind`` is title, heading or line.
    """
    no_altitude = F.lit("Average altitude: n/a")
    duration = F.col("scan_duration_ms") if "scan_duration_ms" in metrics.columns else F.lit(None).cast("long")
    summary = [
        F.format_string("Total photos: %d", "photo_count"), F.format_string("Photos with GPS: %d", "photos_with_gps"), F.format_string("Blurry photos: %d", "blurry_count"),
        F.format_string("Coverage gaps: %d", "gap_count"), F.when(F.col("avg_altitude").isNull(), no_altitude).otherwise(F.format_string("Average altitude: %.1f m", "avg_altitude")),
        F.format_string("Coverage area: %.0f m^2", "covered_area_m2"), F.when(duration.isNull(), "Scan duration: n/a").otherwise(F.format_string("Scan duration: %d ms", duration)),
    ]
    gap_no = F.expr("row_number() over (partition by flight_id order by area_m2 desc, id)").cast("long")
    key = "sort_key, file_name" if "sort_key" in blur_alerts.columns else "file_name"
    blur_no = F.expr(f"row_number() over (partition by flight_id order by {key})").cast("long")
    gap_lines = gaps.select("flight_id", gap_no.alias("no"), F.format_string("- %.6f, %.6f  (~%.0f m^2)", "lat", "lon", "area_m2").alias("text"))
    blur_lines = blur_alerts.select("flight_id", blur_no.alias("no"), F.format_string("- %s at %.6f, %.6f (score %.0f)", "file_name", "lat", "lon", F.coalesce("blur_score", F.lit(0.0))).alias("text"))
    # the place of what follows a list depends on how long it is
    counts = metrics.join(gap_lines.groupBy("flight_id").agg(F.count("*").alias("n_gaps")), "flight_id", "left").join(blur_lines.groupBy("flight_id").agg(F.count("*").alias("n_blur")), "flight_id", "left").fillna(0, ["n_gaps", "n_blur"])
    first = 2 + len(summary)
    second = first + F.greatest("n_gaps", F.lit(1)) + 1
    one = lambda n, kind, text: F.struct(F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"), F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    fixed = [one(0, "title", TITLE), *[one(k, "line", text) for k, text in enumerate(summary, 1)], one(first - 1, "heading", GAPS), one(second - 1, "heading", BLURRY)]
    nothing = [F.when(F.col(c) == 0, one(n, "line", text)) for c, n, text in (("n_gaps", first, NO_GAPS), ("n_blur", second, NO_BLURRY))]
    frame = counts.select("flight_id", F.explode(F.filter(F.array(*fixed, *nothing), lambda x: x.isNotNull())).alias("l")).select("flight_id", "l.*")
    starts = counts.select("flight_id", second.cast("long").alias("second"))
    kinds = lambda df, start: df.select("flight_id", (F.col("no") - 1 + start).cast("long").alias("n"), F.lit("line").alias("kind"), "text")
    return frame.union(kinds(gap_lines, F.lit(first))).union(kinds(blur_lines.join(starts, "flight_id"), F.col("second")))


#: Heights at which a line may begin: all lines move by an even number of millimetres, and the space before a heading goes below the lowest line.
HEIGHTS = np.arange(TOP, BOTTOM - 4, -2)


def step(kind: str, y: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the line stands, its page, where the next may begin) from any heights and pages."""
    before, need, down = STEPS[kind]
    y = y - before
    turn = y - need < BOTTOM if need is not None else np.zeros(y.shape, bool)
    y = np.where(turn, TOP - NEXT_PAGE_MM, y)
    return y, page + turn, y - down


def pages(report: DataFrame) -> DataFrame:
    """``report`` with ``page`` from 1 and ``y`` in millimetres from the lower edge.

    A line that leaves no room for itself begins a new page, whose heading takes its place there. So where a line stands depends on all before it: each
    CHUNK of lines is a function from the height and page at which it begins to those at which it ends; these functions, a row for each CHUNK,
    are composed flight by flight, and then each chunk is laid out from where it begins.
    """
    chunked = report.withColumn("chunk", F.floor(F.col("n") / CHUNK).cast("long"))
    top = int(HEIGHTS[0])

    def through(t: pa.Table) -> pa.Table:
        y, page = HEIGHTS, np.zeros(len(HEIGHTS), np.int64)
        for kind in t.sort_by("n").column("kind").to_pylist():
            _, page, y = step(kind, y, page)
        ends = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (y, page)]
        return pa.table([t.column("flight_id").slice(0, 1), t.column("chunk").slice(0, 1), *ends], ["flight_id", "chunk", "y", "page"])

    def composed(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        y, page, starts = top, 1, []
        for ys, ps in zip(t.column("y").to_pylist(), t.column("page").to_pylist(), strict=True):
            starts.append((y, page))
            at = (top - y) // 2
            y, page = ys[at], page + ps[at]
        return pa.table([t.column("flight_id"), t.column("chunk"), *[pa.array(list(c), pa.int64()) for c in zip(*starts, strict=True)]], ["flight_id", "chunk", "y0", "page0"])

    def placed(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        y, page = (t.column(c)[0].as_py() for c in ("y0", "page0"))
        at = []
        for kind in t.column("kind").to_pylist():
            here, page, y = (int(x) for x in step(kind, np.int64(y), np.int64(page)))
            at.append((page, here))
        found = [pa.array(list(c), pa.int32()) for c in zip(*at, strict=True)]
        return pa.table([*[t.column(c) for c in ("flight_id", "n", "kind", "text")], *found], ["flight_id", "n", "kind", "text", "page", "y"])

    ends = chunked.select("flight_id", "chunk", "n", "kind").groupBy("flight_id", "chunk").applyInArrow(through, "flight_id long, chunk long, y array<long>, page array<long>")
    starts = ends.groupBy("flight_id").applyInArrow(composed, "flight_id long, chunk long, y0 long, page0 long")
    return chunked.join(starts, ["flight_id", "chunk"]).groupBy("flight_id", "chunk").applyInArrow(placed, "flight_id long, n long, kind string, text string, page int, y int")


PIECES = "name string, seq long, data binary"


def _pieces(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["name", "seq", "data"])


def _framed(make: Callable[[], Callable[[int | None, bytes], bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted pieces, each replaced by what a function made for its file says, which is asked once more, with None, for the end of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tell, last = None, None, 0
        for b in batches:
            rows = []
            for mine, seq, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if mine != name:
                    if tell:
                        rows.append((name, last, tell(None, b"")))
                    name, tell = mine, make()
                last = seq
                rows.append((name, seq, tell(seq, data)))
            yield _pieces(rows)
        if tell:
            yield _pieces([(name, last, tell(None, b""))])

    return run


def _pdf_text(text: str, font: str, size: int, y: float) -> bytes:
    point = 72 / 25.4
    safe = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b" ").replace(b"\n", b" ")
    return b"BT /%s %d Tf %.2f %.2f Td (%s) Tj ET\n" % (font.encode(), size, LEFT * point, y * point, safe)


def _pdf_file() -> Callable[[int | None, bytes], bytes]:
    """Numbers the objects of a file, notes where they begin, and ends it with the page tree and the table of objects."""
    at, offsets = 0, {}

    def written(number: int, body: bytes, before: bytes = b"") -> bytes:
        nonlocal at
        offsets[number] = at + len(before)
        data = before + b"%d 0 obj\n%s\nendobj\n" % (number, body)
        at += len(data)
        return data

    def tell(page: int | None, content: bytes) -> bytes:
        if page is not None:
            out = b""
            if not offsets:
                out = written(1, b"<< /Type /Catalog /Pages 2 0 R >>", b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
                for k, font in ((3, b"Helvetica"), (4, b"Helvetica-Bold")):
                    out += written(k, b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % font)
            k = max(5, max(offsets) + 1)
            out += written(k, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (k + 1))
            return out + written(k + 1, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
        kids = [k for k in offsets if k >= 5 and k % 2]
        size = b"[0 0 %.2f %.2f]" % (PAGE_W * 72 / 25.4, PAGE_H * 72 / 25.4)
        out = written(2, b"<< /Type /Pages /Count %d /MediaBox %s /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % (len(kids), size, b" ".join(b"%d 0 R" % k for k in kids)))
        table = b"".join(b"%010d 00000 n \n" % offsets[k] for k in range(1, len(offsets) + 1))
        return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, table, len(offsets) + 1, at)

    return tell


def write_pdfs(paged: DataFrame, path: str) -> None:
    """``<flight_id>.pdf`` of every flight of ``pages``: A4 pages, each composed in its own group and written as it comes.

    Letters that the built-in fonts lack become question marks.
    """

    def drawn(t: pa.Table) -> pa.Table:
        rows = t.sort_by("n").to_pylist()
        page = rows[0]["page"]
        content = _pdf_text(f"{TITLE} (page {page})", "F2", NEXT_PAGE_SIZE, TOP) if page > 1 else b""
        content += b"".join(_pdf_text(r["text"], "F1" if r["kind"] == "line" else "F2", SIZES[r["kind"]], r["y"]) for r in rows)
        return pa.Table.from_batches([_pieces([(f"{rows[0]['flight_id']}.pdf", page, content)])])

    drawings = paged.groupBy("flight_id", "page").applyInArrow(drawn, PIECES)
    save_sorted(drawings.repartition("name").sortWithinPartitions("name", "seq").mapInArrow(_framed(_pdf_file), PIECES), path)


#: Parts of a document in their order, and the names and order of what a photo and the metrics hold.
PARTS = ("photos", "flightPath", "heatmap", "gaps", "blurAlerts", "metrics")
PHOTO = ("file_name", "path", "lat", "lon", "relative_altitude", "absolute_altitude", "yaw_deg", "focal_mm", "sensor_width_mm", "sensor_height_mm", "image_width_px", "image_height_px", "footprint", "capture_time", "is_blurry", "blur_score", "warnings")
METRICS = {"totalPhotos": "photo_count", "photosWithGps": "photos_with_gps", "blurryCount": "blurry_count", "gapCount": "gap_count", "avgAltitudeM": "avg_altitude", "coverageAreaM2": "covered_area_m2", "scanDurationMs": "scan_duration_ms"}
_PART = 1 << 50


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def json_items(photos: DataFrame, flight_path: DataFrame, heatmap: DataFrame, gaps: DataFrame, blur_alerts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(flight_id, seq, item): what the parts of each flight's document hold, each value as JSON; ``seq`` orders them by part and place in it.

    Photos, flight path and blurry photos are in flight order, cells by row and column, gaps by area. Only flights of ``metrics`` have a document. Nulls
    are written; a field that a table lacks is null, and warnings that it lacks are an empty list.
    """

    def held(df: DataFrame, fields: dict[str, str]) -> Column:
        lack = lambda c: F.array().cast("array<string>") if c == "warnings" else F.lit(None).cast("string")
        return F.to_json(F.struct(*[(F.col(c) if c in df.columns else lack(c)).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})

    def part(name: str, df: DataFrame, place: Column, item: Column) -> DataFrame:
        return df.select("flight_id", (F.lit(PARTS.index(name) * _PART) + place).cast("long").alias("seq"), item.alias("item"))

    as_is = lambda names: {camel(n): n for n in names}
    feature = F.concat(F.lit('{"type": "Feature", "geometry": {"type": "'), "type", F.lit('", "coordinates": '), "coordinates", F.lit('}, "properties": '), "properties", F.lit("}"))
    gap_no = F.expr("row_number() over (partition by flight_id order by area_m2 desc, id)")
    key = "sort_key, file_name" if "sort_key" in blur_alerts.columns else "file_name"
    blur_no = F.expr(f"row_number() over (partition by flight_id order by {key})")
    items = [
        part("photos", photos, F.col("seq"), held(photos, as_is(PHOTO))), part("flightPath", flight_path, F.col("place"), feature), part("heatmap", heatmap, F.col("place"), feature),
        part("gaps", gaps, gap_no, held(gaps, as_is(("id", "lat", "lon", "cell_count", "area_m2")))),
        part("blurAlerts", blur_alerts, blur_no, held(blur_alerts.fillna(0.0, ["blur_score"]), as_is(("file_name", "lat", "lon", "blur_score")))),
    ]
    every = part("metrics", metrics, F.lit(0), held(metrics, METRICS))
    for df in items:
        every = every.union(df.join(metrics.select("flight_id"), "flight_id", "left_semi"))
    return every


def _json_file() -> Callable[[int | None, bytes], bytes]:
    """Puts the values of a document into its lists, indented by two."""
    part, some = -1, False

    def upto(new: int) -> str:
        """The end of the part that is open, and all from there to the beginning of the new one."""
        nonlocal part, some
        out = "{" if part < 0 else "" if part == new else "\n  ]" if some else "]"
        while part < new:
            part += 1
            out += (",\n" if part else "\n") + f'  "{PARTS[part]}": ' + ("[" if part < len(PARTS) - 1 else "")
            if part < new:
                out += "]"
            some = False
        return out

    def tell(seq: int | None, item: bytes) -> bytes:
        nonlocal some
        if seq is None:
            return b"\n}\n"
        last = seq // _PART == len(PARTS) - 1
        out = upto(seq // _PART)
        text = json.dumps(json.loads(item), indent=2, ensure_ascii=False)
        out += text.replace("\n", "\n  ") if last else (",\n    " if some else "\n    ") + text.replace("\n", "\n    ")
        some = True
        return out.encode()

    return tell


def write_json(items: DataFrame, path: str) -> None:
    """``<flight_id>.json`` of every flight of ``json_items``: one indented document, written value by value, so its size is bounded by no memory."""

    def indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _pieces([(f"{f}.json", s, i.encode()) for f, s, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)])

    pieces = items.select("flight_id", "seq", "item").repartition("flight_id").sortWithinPartitions("flight_id", "seq").mapInArrow(indented, PIECES)
    save_sorted(pieces.mapInArrow(_framed(_json_file), PIECES), path)


#: What ``export`` writes.
FORMATS = ("json", "pdf")


def export(result, form: str, path: str) -> None:
    """Write an inspection's report for each flight below ``path``: ``json``, all results in one document, or ``pdf``.

    Any other format raises ValueError before anything is computed.
    """
    if form not in FORMATS:
        raise ValueError(f"Unknown export format: {form}. There are {', '.join(FORMATS)}.")
    if form == "json":
        write_json(json_items(result.photos, result.flight_path, result.heatmap, result.gaps, result.blur_alerts, result.metrics), path)
    else:
        write_pdfs(pages(lines(result.metrics, result.gaps, result.blur_alerts)), path)
