"""Sensor sizes by model name from a table of cameras."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a camera table at most, as it is sent to every task; some 100 bytes each.
MOST_CAMERAS = 1 << 20
_SIZE = "sensor_width_mm double, sensor_height_mm double, place long"


def finder(needles: list[str]) -> Callable[[str], int | None]:
    """The place of the first needle, in the order of the list, that a text holds: one pass over the text, however many needles there are."""
    first: dict[str, int] = {}
    for k, needle in enumerate(needles):
        first.setdefault(needle, k)
    if "" in first:  # which every text holds
        first = {n: k for n, k in first.items() if k <= first[""]}
    empty = first.pop("", None)
    try:
        import ahocorasick
    except ImportError:
        return lambda text: min((k for n, k in first.items() if n in text), default=empty)
    automaton = ahocorasick.Automaton()
    for needle, k in first.items():
        automaton.add_word(needle, k)
    if not first:
        return lambda text: empty
    automaton.make_automaton()
    return lambda text: min((k for _, k in automaton.iter(text)), default=empty)


def by_camera(cameras: DataFrame) -> Callable[[Column], Column]:
    """A function that looks up a model's (sensor_width_mm, sensor_height_mm, place) in ``cameras`` (needle, sensor_width_mm, sensor_height_mm, place).

    Of the rows whose needle is a part of the model's name the one of smallest ``place`` counts, of equal places the smaller needle; rows without a
    needle or a width count nowhere, nor does a null model. The table is collected and sent to all tasks once its size is checked (MOST_CAMERAS, else
    ValueError); a task searches a model once for each batch of rows.
    """
    good = cameras.where("needle is not null and sensor_width_mm is not null").select("place", "needle", "sensor_width_mm", "sensor_height_mm")
    rows = good.limit(MOST_CAMERAS + 1).collect()
    if len(rows) > MOST_CAMERAS:
        raise ValueError(f"A camera table can't hold more than {MOST_CAMERAS} rows.")
    rows.sort(key=lambda r: (r.place is None, r.place or 0, r.needle))
    table = cameras.sparkSession.sparkContext.broadcast([(r.needle, r.sensor_width_mm, r.sensor_height_mm, r.place) for r in rows])

    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, known = finder([r[0] for r in table.value]), {None: None}
        for models in batches:
            known = {None: None} | {m: find(m) for m in models.dropna().unique()}
            found = [(None, None, None) if (k := known[m if isinstance(m, str) else None]) is None else table.value[k][1:] for m in models]
            yield pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=t) for i, (c, t) in enumerate((("sensor_width_mm", "float64"), ("sensor_height_mm", "float64"), ("place", "Int64")))})

    look_up.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(look_up, _SIZE)
    return lambda model: found(model.cast("string"))
