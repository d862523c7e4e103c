"""Contiguous shards of nearly equal bytes, cut on a global prefix sum of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, map_batches


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in one global order by ``keys`` (ties in an arbitrary but fixed order), with ``pid``, the partition, written out.

    The row's place in the scan is the last key, so many rows with equal keys still spread over partitions.
    """
    tie = free_name(df, "_tie")
    df = df.withColumn(tie, F.monotonically_increasing_id())
    return cut(df.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie).withColumn("pid", F.spark_partition_id()))


def totals(df: DataFrame, value: str) -> tuple[dict[int, tuple[int, int]], int, int]:
    """For each partition of ``ordered()`` the sum of ``value`` and the count of rows before it; then both totals.

    One row per partition reaches the driver, whatever the rows.
    """
    before, size, rows = {}, 0, 0
    for r in df.groupBy("pid").agg(F.sum(value).alias("size"), F.count("*").alias("rows")).orderBy("pid").collect():
        before[r.pid] = (size, rows)
        size, rows = size + r.size, rows + r.rows
    return before, size, rows


def shard_by_bytes(df: DataFrame, shards: int, size: str = "size", keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot``, the place in the shard from 0.

    Rows are put in the order of ``keys`` (default ``doc_id``; nulls first, ties in scan order) and their sizes summed from
    the front. A row belongs to the shard in whose equal share of the bytes its middle lies, so shards are contiguous, and
    differ in bytes by no more than the two rows at their ends. ``size`` must be a non-null long, at least 0. Rows whose
    sizes are all 0 go to shard 0. Columns ``pid``, ``shard`` and ``slot`` of the input are replaced, in any case; others stay. No row is
    dropped, repeated ones neither; an empty table gives an empty result. What reaches the driver are three numbers for each partition, and
    for each shard one for each partition that it begins or ends in: it grows with the partitions, not with the rows.
    """
    laid = ordered(df.drop("pid", "shard", "slot"), keys or ["doc_id"])
    before, total, _ = totals(laid, size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            pid = b.column(b.schema.get_field_index("pid"))[0].as_py()
            ends = at.get(pid, before[pid][0]) + np.cumsum(v)
            at[pid] = int(ends[-1])
            middle = ends - v + v // 2
            # whole numbers while they fit; floats only beyond 2^63
            shard = middle * shards // max(total, 1) if total * shards < 2**63 else np.floor(middle / max(total, 1) * shards).astype(np.int64)
            yield b.append_column("shard", pa.array(np.clip(shard, 0, shards - 1).astype(np.int32)))

    out = cut(map_batches(laid, place, T.StructType([*laid.schema.fields, T.StructField("shard", T.IntegerType())])))
    # the rows of a shard within one partition are contiguous: a shard has at most one run per partition
    runs = out.groupBy("shard", "pid").agg(F.count("*").alias("n")).orderBy("shard", "pid").collect()
    start: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in runs:
        start[r.shard, r.pid] = seen.get(r.shard, 0)
        seen[r.shard] = seen.get(r.shard, 0) + r.n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = dict(start)
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(b.schema.get_field_index("shard")).to_numpy()
            pid = b.column(b.schema.get_field_index("pid"))[0].as_py()
            slot = np.empty(len(s), np.int64)
            for k in np.unique(s):
                mine = s == k
                slot[mine] = nxt[int(k), pid] + np.arange(mine.sum())
                nxt[int(k), pid] += int(mine.sum())
            yield b.append_column("slot", pa.array(slot))

    return map_batches(out, number, T.StructType([*out.schema.fields, T.StructField("slot", T.LongType())])).drop("pid")
