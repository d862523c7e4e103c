"""Mixing sources to target weights, in fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, salted
from .sharding import ordered, totals

#: Words of a block, output shards, passes over a source at most, weights in turn.
BLOCK, SHARDS, PASSES, WEIGHTS, SEED = 64, 64, 3, (5, 2, 1), 20240501
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = PASSES) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, held to ``most`` times each size; what is cut off is shared anew among the others."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1: a four-round Feistel network on the next even power of two, walked until it falls inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence([SEED, key]).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class Plan:
    """What is drawn for each source; one entry per source, so as small as the list of sources."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    slots: list[int]
    #: For each source the first slot of every output shard, and the number of slots at the end.
    starts: np.ndarray


def plan(rows: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS) -> Plan:
    """Sources in the order of their code points, null last.

    A source's slots are its full passes and as many blocks of one more pass as come nearest to the target. Each output
    shard draws its sources from a multinomial over the slots still open; the last takes what is left, so the totals hold.
    """
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(s) for _, s in rows]
    want = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    blocks = [-(-s // block) for s in sizes]
    slots = []
    for size, target, n in zip(sizes, want, blocks, strict=True):
        full = min(PASSES, int(target // size)) if size else 0
        rest = round((target - full * size) / (size / n)) if size else 0
        slots.append(min(full * n + rest, PASSES * n))
    rng = np.random.default_rng(SEED)
    left = np.array(slots, np.int64)
    drawn = np.zeros((len(rows), shards + 1), np.int64)
    for k in range(shards):
        share = left.sum() // (shards - k)
        took = np.minimum(rng.multinomial(share, left / left.sum()), left) if k < shards - 1 and left.sum() else left.copy()
        drawn[:, k + 1] = took
        left = left - took
    return Plan([n for n, _ in rows], sizes, want, blocks, slots, np.cumsum(drawn, 1))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", block: int = BLOCK) -> tuple[DataFrame, DataFrame, Plan]:
    """Rows, pieces and plan of a mix of the rows of ``df`` by ``source``; ``size`` is a non-null long, the row's words.

    The words of a source, its rows in the order of key (ties by size), are packed in blocks. Slots of the mix are
    mapped to blocks, each pass over a source by a permutation of its own, and meet the rows' parts by block number. Returned:
    the rows (``uid`` numbers them; key, source, size), the pieces of the mix (uid, shard, slot, source_no, block, pass, first,
    words: which words of the row stand where) and the plan. Rows without words are in no piece. The list of sources, a name and some numbers
    for each, is the only thing that reaches the driver and goes to all tasks: it grows with the sources (64 numbers each), not with the rows.
    Only key, source and size are read, so other columns of ``df`` may have any name; an empty table gives no rows and no pieces.
    """
    rows = df.select(quoted(key).alias("key"), quoted(source).alias("src"), quoted(size).alias("n"))
    laid = ordered(rows, [F.col("src").asc_nulls_last(), F.col("key"), F.col("n")])
    spec = plan([(r.src, r.n or 0) for r in laid.groupBy("src").agg(F.sum("n").alias("n")).collect()], block)
    before, _, _ = totals(laid, "n")
    number = {name: i for i, name in enumerate(spec.names)}
    base = np.cumsum([0, *spec.sizes])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, tuple[int, int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column(3)[0].as_py()
            words, uid = at.get(pid, before[pid])
            n = b.column(2).to_numpy()
            ends = words + np.cumsum(n)
            source_no = np.array([number[s] for s in b.column(1).to_pylist()], np.int32)
            at[pid] = (int(ends[-1]), uid + len(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(len(n))), b.column(0), b.column(1), b.column(2), pa.array(source_no), pa.array(ends - n - base[source_no])],
                ["uid", "key", "src", "n", "source_no", "begin"],
            )

    fields = laid.schema.fields
    schema = T.StructType([T.StructField("uid", T.LongType()), *fields[:3], T.StructField("source_no", T.IntegerType()), T.StructField("begin", T.LongType())])
    placed = cut(laid.mapInArrow(place, schema))
    first, last = F.col("begin"), F.col("begin") + F.col("n")
    parts = (
        placed.where("n > 0")
        .select("uid", "source_no", "begin", "n", F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block))).alias("block"))
        .withColumn("from", F.greatest(F.col("block") * block, F.col("begin")))
        .withColumn("to", F.least((F.col("block") + 1) * block, F.col("begin") + F.col("n")))
        .select("uid", "source_no", "block", (F.col("from") - F.col("begin")).alias("first"), (F.col("to") - F.col("from")).alias("words"))
    )
    slot_base = np.cumsum([0, *spec.slots])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(0).to_numpy()
            src = (np.searchsorted(slot_base, slot, "right") - 1).astype(np.int32)
            ordinal = slot - slot_base[src]
            chosen, turn, shard = np.empty(len(slot), np.int64), np.zeros(len(slot), np.int32), np.empty(len(slot), np.int32)
            for s in np.unique(src).tolist():
                mine = np.flatnonzero(src == s)
                n = spec.blocks[s]
                turn[mine] = ordinal[mine] // n
                shard[mine] = np.searchsorted(spec.starts[s], ordinal[mine], "right") - 1
                for t in np.unique(turn[mine]).tolist():
                    some = mine[turn[mine] == t]
                    chosen[some] = permute(ordinal[some] - t * n, n, s * PASSES + t)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, src, chosen, turn, shard)], ["slot", "source_no", "block", "pass", "shard"])

    slots = df.sparkSession.range(int(slot_base[-1])).mapInArrow(draw, "slot long, source_no int, block long, pass int, shard int")
    return placed, slots.join(parts, ["source_no", "block"]), spec


def taken(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", block: int = BLOCK) -> DataFrame:
    """(key, size, source_size, target, taken) for every row of ``df``: how many of its words the mix takes, repeats counted.

    A null source is a source, last in order; a row without words has taken 0; rows that repeat are each a row of their own. No row is taken more
    than PASSES times its size. Reruns agree. An empty table gives an empty result. Other columns of ``df``, whatever their names, are left out.
    """
    rows, pieces, spec = mix(df, key, source, size, block)
    sums = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    sources = df.sparkSession.createDataFrame(
        [(i, s, float(t)) for i, (s, t) in enumerate(zip(spec.sizes, spec.targets, strict=True))], "source_no int, source_size long, target double"
    )
    # a table of sources, one of which may hold most rows; each is met in several tasks
    out = salted(rows.join(sums, "uid", "left"), sources, ["source_no"], "uid")
    return out.select(F.col("key").alias(key), F.col("n").alias(size), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
