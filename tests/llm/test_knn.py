import random

import pytest
from pyspark.sql import functions as F

from aerialframe.llm import knn


def plain(rows, k=10):
    whole = {}
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in good if c != q)
            whole[q] = [(r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return {(q, *x) for q, xs in whole.items() for x in xs}


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "few", "huge"])
def test_same_as_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 4)
    monkeypatch.setattr(knn, "PIVOTS", 8)
    r = random.Random(kind)
    n = {"few": 4}.get(kind, 200)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]

    def vector(i):
        if kind == "equal" and i % 3:
            return [0.5] * 6
        if kind == "huge":
            return [r.choice([-1, 1]) * 2.0**19 * r.random() for _ in range(6)]
        c = centre[i % 5] if kind == "clusters" else [0] * 6
        return [a + r.gauss(0, 0.05 if kind == "clusters" else 1) for a in c]

    rows = [(i, vector(i)) for i in range(n)]
    rows += [(None, [1.0] * 6), (1000, None), (1010, [1.0, None]), (1020, [float("nan")]), (1030, [float("inf")] * 6), (1040, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert {tuple(x) for x in got} == plain(rows)
    assert len(got) == len(plain(rows))


@pytest.mark.parametrize("kind", ["zero", "outliers", "repeated"])
def test_bounds_with_missing_and_own_rows(spark, monkeypatch, kind):
    """Zero queries where cells have too few rows, and a query whose id fills the places of the k others."""
    monkeypatch.setattr(knn, "PIVOTS", 8)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 4)
    r = random.Random(kind)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(1, 60)]
    if kind == "outliers":
        rows = [(i, [1 + 0.01 * r.random()] * 4) for i in range(1, 200)] + [(300 + i, [(-1) ** i * 1e4 * (1 + i)] * 4) for i in range(4)]
        monkeypatch.setattr(knn, "PIVOTS", 210)
    if kind == "repeated":
        rows = [(i, [r.gauss(0, 1), r.gauss(0, 1), 0.0, 0.0]) for i in range(1, 200)] + [(1000, [9.0, 9.0, 0.0, 0.0])] * 40
    else:
        rows += [(10 * i, [0.0] * 4) for i in (0, 40, 77)]
    rows = [x for x in rows if x[0] % 10 or x[0] in (0, 400, 770, 1000)]  # no other queries, whose bounds would help
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in knn.top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(plain(rows))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")
    assert knn.top_k(df, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(one, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, [1.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(alone, F.col("vec_id") % 10 == 0).collect() == []


def test_a_crowded_cell_is_cut_on_both_sides(spark, monkeypatch):
    """All queries share a cell, all rows may matter to them: no side of a local join holds more than about what it is meant to."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 20)
    monkeypatch.setattr(knn, "GROUPS", 2)
    r = random.Random(5)
    rows = [(i, [1 + r.gauss(0, 1e-3) for _ in range(4)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, sent, _ = knn.dealt(df, F.col("vec_id") % 10 == 0, 10, "vec_id", "embedding")
    for side, most in ((asked, 40), (sent, 160)):
        n = [x["count"] for x in side.groupBy("grp", "part", "block").count().collect()]
        assert len(n) > 100 and max(n) <= most
    assert {tuple(x) for x in knn.top_k(df, F.col("vec_id") % 10 == 0).collect()} == plain(rows)


def test_names_with_dots(spark):
    rows = [(i, [float(i % 7), 1.0], i) for i in range(40)]
    df = spark.createDataFrame(rows, "`a.id` long, `a.v` array<double>, score int")
    got = {tuple(x) for x in knn.top_k(df, F.col("`a.id`") % 10 == 0, key="a.id", vector="a.v").collect()}
    assert got == plain([x[:2] for x in rows])
