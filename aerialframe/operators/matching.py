"""Matching of descriptors between pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import orb

#: The last: keypoints of a picture that are compared at once.
RATIO, MIN_CONFIDENCE, MAX_KEYPOINTS, BLOCK = 0.75, 0.2, 2000, 2048


def orb_features(pictures: DataFrame, most: int = MAX_KEYPOINTS) -> DataFrame:
    """(photo_id, idx, x, y, score, angle, descriptor: four longs) of the corners of ``pictures`` (photo_id, width, height, data: RGB bytes).

    Each picture is worked on where it lies and becomes ``most`` rows at most, of some 80 bytes; one without contrast becomes none. See ``functions.orb``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                photo, w, h = (b.column(c)[k].as_py() for c in range(3))
                rgb = np.frombuffer(b.column(3)[k].as_buffer(), np.uint8).reshape(h, w, 3)
                places, score, angle, bits = orb.features(rgb, most)
                columns = [pa.array(np.full(len(score), photo)), pa.array(np.arange(len(score))), *(pa.array(c) for c in (places[:, 0], places[:, 1], score, angle)), pa.array(list(bits), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["photo_id", "idx", "x", "y", "score", "angle", "descriptor"])

    rows = pictures.select("photo_id", F.col("width").cast("int"), F.col("height").cast("int"), "data")
    return rows.mapInArrow(run, "photo_id long, idx long, x double, y double, score double, angle double, descriptor array<long>")


def ratio_matches(candidates: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(pair, query_idx, train_idx, distance): the nearest of each query's candidates if it is nearer than ``ratio`` times the second.

    ``candidates`` has pair, query_idx, train_idx, distance. A query with one candidate has no second and does not match. Ties go to the smaller
    train_idx. No query's candidates are gathered: a limit on the rank is applied before and after the shuffle.
    """
    rank = F.expr("row_number() over (partition by pair, query_idx order by distance, train_idx)")
    two = candidates.select("pair", "query_idx", "train_idx", "distance").withColumn("rank", rank).where(F.col("rank") <= 2)
    best = two.groupBy("pair", "query_idx").agg(F.min(F.struct("rank", "train_idx", "distance")).alias("one"), F.max("distance").alias("second"), F.count("*").alias("n"))
    good = (F.col("n") == 2) & (F.col("one.distance") < ratio * F.col("second"))
    return best.where(good).select("pair", "query_idx", "one.train_idx", "one.distance")


def packed(features: DataFrame) -> DataFrame:
    """(photo_id, block, ids, words): each picture's keypoints in blocks of about BLOCK, numbers and descriptors end to end as 64-bit integers."""
    count = features.groupBy("photo_id").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).alias("blocks"))
    block = F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int").alias("block")
    rows = features.join(count, "photo_id").select("photo_id", block, F.struct("idx", "descriptor").alias("f")).groupBy("photo_id", "block").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return rows.select("photo_id", "block", F.col("f.idx").alias("ids"), F.flatten("f.descriptor").alias("words"))


def knn_ratio(pairs: DataFrame, features: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Ratio-tested nearest neighbours between the pictures of each pair (pair, a, b), over ``features`` (photo_id, idx, descriptor: array of longs).

    Distances are differing bits. Pictures meet as blocks of packed descriptors, and a row of the join gives the two nearest of each query in
    its block: a pair of pictures is never spread out as pairs of keypoints.
    """
    blocks = packed(features)
    side = lambda k: blocks.select(F.col("photo_id").alias(k), F.col("ids").alias(f"{k}_ids"), F.col("words").alias(f"{k}_words"))
    both = pairs.select("pair", "a", "b").join(side("a"), "a").join(side("b"), "b").select("pair", "a_ids", "a_words", "b_ids", "b_words")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                pair = b.column(0)[r].as_py()
                qi, qw, ti, tw = (b.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 5))
                qw, tw = qw.reshape(len(qi), -1).view(np.uint64), tw.reshape(len(ti), -1).view(np.uint64)
                found: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(qi), 256):
                    some = qw[at : at + 256]
                    bits = sum(np.bitwise_count(some[:, None, k] ^ tw[None, :, k]).astype(np.int32) for k in range(qw.shape[1]))
                    one = bits.argmin(1)  # numbers ascend, so the first of equals
                    rows = np.arange(len(some))
                    nearest_ = bits[rows, one].copy()
                    for k, v in enumerate((qi[at : at + 256], ti[one], nearest_)):
                        found[k].append(v)
                    if len(ti) > 1:
                        bits[rows, one] = 1 << 30
                        two = bits.argmin(1)
                        for k, v in enumerate((qi[at : at + 256], ti[two], bits[rows, two])):
                            found[k].append(v)
                columns = [np.concatenate(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), pair)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True))], ["pair", "query_idx", "train_idx", "distance"])

    return ratio_matches(both.mapInArrow(nearest, "pair long, query_idx long, train_idx long, distance int"), ratio)


def confident(matches: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return matches.where(F.col("confidence") >= least)


def cap_keypoints(features: DataFrame, k: int = MAX_KEYPOINTS) -> DataFrame:
    """The ``k`` keypoints of highest score of each photo; ties to the smaller idx."""
    rank = F.expr("row_number() over (partition by photo_id order by score desc, idx)")
    return features.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def point_pairs(matches: DataFrame, pairs: DataFrame, keypoints: DataFrame) -> DataFrame:
    """``matches`` with the coordinates of both ends (xa, ya, xb, yb), looked up in arrays of (x, y) by number from 0."""
    at = lambda k, idx, s: [F.get(f"k{k}", F.col(idx))["x"].alias(f"x{k}"), F.get(f"k{k}", F.col(idx))["y"].alias(f"y{k}")]
    side = lambda k: keypoints.select(F.col("photo_id").alias(k), F.col("keypoints").alias(f"k{k}"))
    both = matches.join(pairs, "pair").join(side("a"), "a").join(side("b"), "b")
    return both.select("pair", "a", "b", *at("a", "query_idx", 0), *at("b", "train_idx", 0))
