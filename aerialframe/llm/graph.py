"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: longs): the smallest node that can be reached.

    Each round joins every node's larger neighbours to its smallest one, then its smaller ones; the links end as one star
    for each component. Links are written to the shared folder after each round and never leave the executors; the
    driver sees a count and a checksum. The leaves of a node are dealt to several tasks. Repeated links and links of a node to itself
    change nothing; a link with a null end is none; without links there are no rows.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = salted(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least, ["a"], "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
