import pytest

from aerialframe.llm import queries, sharding


@pytest.mark.parametrize("sizes", [[], [0, 0, 0], [5], [1] * 100, [3, 1, 400, 2, 2] * 20, [10**9] * 7])
def test_shards_are_cut_at_equal_targets(spark, sizes):
    df = spark.createDataFrame([(i % 37 if i % 5 else None, s, 1) for i, s in enumerate(sizes)], "doc_id long, size long, shard long")
    rows = sharding.shard_by_bytes(df, 6).collect()
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for k, members in by.items():
        assert 0 <= k < 6 and sorted(r.slot for r in members) == list(range(len(members)))
    assert all(abs(sum(r["size"] for r in m) - sum(sizes) / 6) <= 2 * max(sizes) for m in by.values())
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op5_prefix_sum_shards(spark, d).collect()
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(k, len(t) + 8, zlib.crc32(t)) for k, t in docs.items()}
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(24)]
    assert max(sums) - min(sums) <= 2 * max(map(len, docs.values())) + 16
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_sql_sums_any_text():
    import zlib

    import duckdb

    texts = [None, "", "a", "é\n\u0000z", "0" * 3000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = con.execute(f"SELECT doc_id, size, text_crc32 FROM ({queries.OP5_SQL}) ORDER BY doc_id").fetchall()
    data = [(t or "").encode() for t in texts]
    assert got == [(i, len(b) + 8, zlib.crc32(b)) for i, b in enumerate(data)]
