import numpy as np
import pytest
from pyspark.sql import functions as F

from aerialframe.llm import mixing, queries


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    for key in range(3):
        assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 100, 1000, 0], [5, 2, 1, 5])
    assert got == pytest.approx([30, 300, 780, 0]) and sum(got) == pytest.approx(1110)
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]


def test_query_sums(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op9_block_mixture(spark, d).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_block_mixture(spark, d).collect()))
    import re

    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for k, r in docs.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    names = sorted({r.source for r in docs.values()})
    total = [sum(size[k] for k in docs if docs[k].source == s) for s in names]
    want = dict(zip(names, zip(total, mixing.targets(total, [mixing.WEIGHTS[i % 3] for i in range(len(names))]))))
    for s in names:
        mine = [r for r in rows if docs[r.doc_id].source == s]
        assert {(r.source_size, r.target) for r in mine} == {want[s]}
        assert abs(sum(r.taken for r in mine) - want[s][1]) <= mixing.BLOCK
    assert all(r.taken <= 3 * r["size"] for r in rows)


def test_pieces_are_whole_passes(spark):
    """A source held to three times its size is taken word for word three times."""
    df = spark.createDataFrame([(i, "a" if i < 5 else None if i % 2 else "b", 10 + 37 * (i % 7)) for i in range(200)] + [(500, "b", 0)], "doc_id long, source string, size long")
    _, pieces, spec = mixing.mix(df)
    assert spec.names == ["a", "b", None]
    seen = {}
    for p in pieces.collect():
        for w in range(p["first"], p["first"] + p.words):
            seen[p.uid, w] = seen.get((p.uid, w), 0) + 1
    assert len({(p.shard, p.slot) for p in pieces.collect()}) == sum(spec.slots)
    rows = {r.doc_id: r for r in mixing.taken(df).collect()}
    assert rows[500].taken == 0 and all(rows[i].taken == 3 * rows[i]["size"] for i in range(5)) and max(seen.values()) == 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long, taken int")
    assert mixing.taken(df).collect() == []
    one = spark.createDataFrame([(None, None, 0), (None, None, 3)], "doc_id long, source string, size long")
    assert sorted(r.taken for r in mixing.taken(one).collect()) == [0, 3]


def plain_taken(rows):
    """The draw replayed over lists: blocks of each source, its slots dealt to shards, each slot's block by the permutation of its pass."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    spec = mixing.plan([(s, sum(n for _, t, n in rows if t == s)) for s in names])
    taken = {k: 0 for k, _, _ in rows}
    for i, s in enumerate(names):
        words = [k for k, t, n in rows if t == s for _ in range(n)]
        for ordinal in range(spec.slots[i]):
            turn = ordinal // spec.blocks[i]
            block = int(mixing.permute(np.array([ordinal - turn * spec.blocks[i]]), spec.blocks[i], i * mixing.PASSES + turn)[0])
            for k in words[block * mixing.BLOCK : (block + 1) * mixing.BLOCK]:
                taken[k] += 1
    return taken


def test_words_taken_against_a_replay(spark):
    r = np.random.default_rng(4)
    rows = [(i, [None, "a", "b", "c", "ä", ""][int(r.integers(6))], int(r.integers(0, 300))) for i in range(150)] + [(150, "b", 9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash")).withColumn("UID", F.lit(1)).repartition(5)
    assert {x.doc_id: x.taken for x in mixing.taken(df).collect()} == plain_taken(rows)


def test_many_sources(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 1000) as source", "id % 50 as size")
    rows = mixing.taken(df).collect()
    assert len(rows) == 3000 and abs(sum(x.taken for x in rows) - sum(x["size"] for x in rows)) < 64 * 1000
    want = {x.source: x.t for x in mixing.taken(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("t")).collect()}
    assert abs(sum(want.values()) - sum(x["size"] for x in rows)) < 1


def test_repeated_keys_in_any_order(spark):
    """Rows that share a key differ in size alone; however they are dealt, each gets the same."""
    df = spark.createDataFrame([(i % 20, f"s{i % 2}", 1 + i * 13 % 97) for i in range(400)], "doc_id long, source string, size long")
    got = [sorted(map(tuple, mixing.taken(d).collect())) for d in (df.coalesce(1), df.orderBy(F.desc("size")).coalesce(1), df.repartition(6))]
    assert got[0] == got[1] == got[2]
