"""Exact top-k inner products by a Voronoi join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted

#: Pivots at least and at most (in between their number is the square root of the rows), rows that they are picked from for each; the
#: scale of the whole numbers.
PIVOTS, MOST_PIVOTS, PIVOT_ROWS, SCALE = 64, 1024, 4, 1024.0
#: Groups of queries, at most; queries that one group is worth, and that one local join takes; candidates of one local join.
GROUPS, GROUP_QUERIES, BLOCK_ROWS = 64, 2048, 20_000


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as floor(1024 x). Rows without id, and vectors that are null or hold a null, NaN or infinity take no part."""
    x = F.transform(quoted(vector), lambda e: e.cast("double"))
    fine = quoted(key).isNotNull() & quoted(vector).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(quoted(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("double")).alias("v"))


def matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    """Rows of numbers, filled with zeros to ``dim``."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    if isinstance(column, pa.Array) and len(flat := column.flatten()) == len(rows) * dim:
        return np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: floats where every sum stays below 2^53, else Python's, held to the range of a long."""
    if a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = 256) -> list[np.ndarray]:
    """(query_id, vec_id, score) as three arrays: for each query its k best rows of another id, highest product, then smallest id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
    for a in range(0, len(queries), block):
        score = products(queries[a : a + block], rows)
        own = ids[None, :] == query_ids[a : a + block, None]
        for i in range(len(score)):
            s, other = score[i], ~own[i]
            at = np.flatnonzero(other)
            if len(at) > k:
                least = np.partition(s[at], len(at) - k)[len(at) - k]
                above, equal = at[s[at] > least], at[s[at] == least]
                at = np.concatenate([above, equal[: k - len(above)]])  # ids ascend
            for column, found in zip(out, (np.full(len(at), query_ids[a + i]), ids[at], s[at]), strict=True):
                column.append(found)
    return [np.concatenate(c) for c in out]


def dealt(df: DataFrame, is_query: Column, k: int, key: str, vector: str) -> tuple[DataFrame, DataFrame, int] | None:
    """The local joins of ``top_k``: queries and rows as (grp, part, block, id, v), and the length of the vectors; None if there is nothing to join.

    A group's queries are cut in parts of about GROUP_QUERIES, and the rows that it may need in blocks of about BLOCK_ROWS; each part meets each block.
    """
    query = df.where(is_query)
    data = whole(df, key, vector)
    n, dim = data.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dim or dim < 1:
        return None
    wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n)))
    picked = data.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS * wanted).collect()
    pivots = np.unique(matrix([r.v for r in picked], dim), axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:wanted]]
    p = len(pivots)
    half = (pivots**2).sum(1) / 2

    def cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (v @ pivots.T - half).argmax(1)
        return cell, np.sqrt(((v - pivots[cell]) ** 2).sum(1)) * (1 + 1e-12)

    def assign(batches):
        for b in batches:
            cell, dist = cells(matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(dist)], ["id", "v", "cell", "dist"])

    placed = data.mapInArrow(assign, "id long, v array<double>, cell int, dist double")

    def nearest(batches):
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, dist, ids = (b.column(i).to_numpy() for i in range(3))
            for c in np.unique(cell).tolist():
                old_dist, old_ids = near.get(c, (np.empty(0), np.empty(0, np.int64)))
                d, i = np.concatenate([old_dist, dist[cell == c]]), np.concatenate([old_ids, ids[cell == c]])
                order = np.lexsort((i, d))
                first = order[np.sort(np.unique(i[order], return_index=True)[1])[: k + 1]]  # the nearest row of an id
                near[c] = d[first], i[first]
        for c, (d, i) in near.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), c, np.int32)), pa.array(i), pa.array(d)], ["cell", "id", "dist"])

    # for each cell the nearest rows of k + 1 ids, one of which can be a query's own
    close, close_id = np.full((p, k + 1), np.inf), np.zeros((p, k + 1), np.int64)
    summary = placed.select("cell", "dist", "id").mapInArrow(nearest, "cell int, id long, dist double").groupBy("cell", "id").agg(F.min("dist").alias("dist"))
    place = F.expr("row_number() over (partition by cell order by dist, id)")
    for r in summary.withColumn("place", place).where(F.col("place") <= k + 1).collect():
        close[r.cell, r.place - 1], close_id[r.cell, r.place - 1] = r.dist, r.id

    asked = cut(whole(query, key, vector).distinct().mapInArrow(assign, "id long, v array<double>, cell int, dist double").drop("dist"))
    n_queries = asked.count()
    if not n_queries:
        return None

    def bounds(batches):
        most, least, norm = np.full((p, p), -np.inf), np.full(p, np.inf), np.zeros(p)
        for b in batches:
            ids, v, cell = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy()
            size, reach = np.sqrt((v**2).sum(1)), v @ pivots.T
            for i in range(len(v)):
                # k rows of other ids reach at least this much; a missing row (infinitely far) and the query's own reach nothing
                with np.errstate(invalid="ignore"):
                    lower = reach[i][:, None] - size[i] * close
                floor = np.sort(np.where(np.isfinite(lower) & np.isfinite(close) & (close_id != ids[i]), lower, -np.inf).ravel())[-k]
                most[cell[i]] = np.maximum(most[cell[i]], reach[i])
                least[cell[i]], norm[cell[i]] = min(least[cell[i]], floor), max(norm[cell[i]], size[i])
        seen = np.flatnonzero(np.isfinite(least) | (norm > 0) | np.isfinite(most).any(1))
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(seen.astype(np.int32)), "least": pa.array(least[seen]), "norm": pa.array(norm[seen]), "most": pa.array(most[seen].tolist(), pa.list_(pa.float64()))}
        )

    most, least, norm = np.full((p, p), -np.inf), np.full(p, np.inf), np.zeros(p)
    count = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    parts = asked.mapInArrow(bounds, "cell int, least double, norm double, most array<double>")

    def merge(t: pa.Table) -> pa.Table:
        highest = np.max(np.array(t.column("most").to_pylist()), 0)
        found = {"cell": t.column("cell")[0].as_py(), "least": min(t.column("least").to_pylist()), "norm": max(t.column("norm").to_pylist()), "most": highest.tolist()}
        return pa.Table.from_pylist([found], t.schema)

    for r in parts.groupBy("cell").applyInArrow(merge, "cell int, least double, norm double, most array<double>").collect():
        least[r.cell], norm[r.cell], most[r.cell] = r["least"], r["norm"], r["most"]

    # neighbouring query cells share a group: cells in the order of their products with the first pivot's cell
    groups = min(GROUPS, -(-n_queries // GROUP_QUERIES))
    group, total = np.zeros(p, np.int32), 0
    for c in np.argsort(pivots @ pivots[0], kind="stable").tolist():
        group[c] = min(groups - 1, total * groups // n_queries)
        total += count.get(c, 0)
    used = np.array(sorted(count))
    slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))

    # blocks of a group: by the rows of the cells of which it may need any
    sizes, farthest = np.zeros(p, np.int64), np.zeros(p)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("dist")).collect():
        sizes[r.cell], farthest[r.cell] = r.n, r.dist
    needed = ~(most[used] + norm[used][:, None] * farthest < (least - slack)[used][:, None])
    blocks = [max(1, -(-int(sizes[needed[group[used] == g].any(0)].sum()) // BLOCK_ROWS)) for g in range(groups)]

    def replicate(batches):
        for b in batches:
            cell, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            reach = ~(most[used][:, cell] + norm[used][:, None] * dist < (least - slack)[used][:, None])
            rows, to = [], []
            for g in np.unique(group[used]).tolist():
                at = np.flatnonzero(reach[group[used] == g].any(0))
                rows.append(at)
                to.append(np.full(len(at), g, np.int32))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), b.column(0).take(at), b.column(1).take(at)], ["grp", "id", "v"])

    asking = np.bincount(group, [count.get(c, 0) for c in range(p)], groups)
    parts_of = F.element_at(F.array([F.lit(max(1, -(-int(a) // GROUP_QUERIES))) for a in asking]), F.col("grp") + 1)
    blocks_of = F.element_at(F.array([F.lit(b) for b in blocks]), F.col("grp") + 1)
    sent = placed.mapInArrow(replicate, "grp int, id long, v array<double>")
    block = F.pmod(F.xxhash64("id", "v"), blocks_of).cast("int").alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sent = sent.select("grp", block, "id", "v").select("grp", every(parts_of).alias("part"), "block", "id", "v")
    cell_groups = df.sparkSession.createDataFrame(list(enumerate(group.tolist())), "cell int, grp int")
    part = F.pmod(F.xxhash64(F.lit(13), "id"), parts_of).cast("int").alias("part")
    asked = asked.join(F.broadcast(cell_groups), "cell").select("grp", part, every(blocks_of).alias("block"), "id", "v")
    return asked, sent, dim


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products with all rows of another id; ties to the smaller id.

    Vectors are made whole numbers first (see ``whole``, which also says what takes no part); shorter ones end in zeros.
    Every row is put in the cell of its nearest pivot. Summaries of the cells (the distances of their nearest rows, the
    largest product of a query cell with each pivot) bound from below each query's k-th score and from above what
    a row can reach; a row goes only to the groups of queries where it may matter. Queries and rows of a group are both cut, however many share
    a cell, and each part of one is solved with each part of the other. Repeated rows of a query are one query; repeated candidates are each ranked.
    Only ``key`` and ``vector`` are read, so other columns may have any name; an empty table, and one without queries, give an empty result.
    """
    sides = dealt(df, is_query, k, key, vector)
    if sides is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, sent, dim = sides

    def solve(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)] * 3
        if q.num_rows and c.num_rows:
            vectors = [matrix(t.column("v").combine_chunks(), dim) for t in (q, c)]
            found = best(vectors[0], q.column("id").to_numpy(), vectors[1], c.column("id").to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    at = ["grp", "part", "block"]
    local = asked.groupBy(*at).cogroup(sent.groupBy(*at)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
