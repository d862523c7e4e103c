import zlib

from pyspark.sql import functions as F

from aerialframe.llm import langid, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op7_byte_cnn_language(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_edges(spark):
    rows = [(i, "the cat and the dog are here " * 3, "en") for i in range(40)] + [(i, "der hund und die katze sind hier " * 3, "de") for i in range(40, 80)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", None), (103, "x" * 100_000, None), (None, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert model.labels == ["de", "en"]
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[0].lang_pred == "en" and got[50].lang_pred == "de" and got[None].lang_pred == "en"
    nothing = langid.fit(df.where("lang = 'xx'"))
    assert nothing is None and langid.predict(df, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.where("false"), model).collect() == []


def test_tables_give_what_the_network_gives():
    import numpy as np

    r = np.random.default_rng(0)
    w = r.integers(0, 256, (70, langid.WINDOW), dtype=np.uint8)
    m = langid.train(w, r.integers(0, 3, 70), ["a", "b", "c"])
    z = np.maximum(m.pooled(w)[1], 0) @ m.out + m.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(m.predict(w), z / z.sum(1, keepdims=True), atol=1e-4)


def test_every_label_is_learned(spark):
    """Seventy labels, one of which holds most rows; each is predicted where its own words stand."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)}" for k in range(70)]
    rows = [(1000 * k + i, f"{w} " * (20 + i), f"l{k:02}") for k, w in enumerate(words) for i in range(400 if k == 0 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.labels == [f"l{k:02}" for k in range(70)]
    _, names = langid.training_sample(df, "text", "lang", "doc_id")
    assert names.count("l00") <= langid.DOCS // 70 * langid.WINDOWS_PER_DOC
    some = spark.createDataFrame([(f"{w} " * 30, f"l{k:02}") for k, w in enumerate(words)], "text string, want string")
    got = langid.predict(some, model).collect()
    assert sum(r.lang_pred == r.want for r in got) >= 60
