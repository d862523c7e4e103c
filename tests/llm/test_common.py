import pytest
from pyspark.sql import functions as F

from aerialframe.llm import audio, bpe, common, knn, langid, licenses, mixing, pii, queries, sharding, simhash, warc

D = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_leave_the_session_as_it_is(spark, name):
    """No query changes a setting, neither when it is planned nor when it runs."""
    settings = lambda: {r.key: r.value for r in spark.sql("set").collect()}
    before = settings()
    rows = queries.QUERIES[name](spark, D)
    assert settings() == before
    assert rows.count() and settings() == before


def test_results_do_not_depend_on_the_batch_size(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").limit(60)
    found = []
    try:
        for rows in ("1", "7", "10000"):
            spark.conf.set(BATCH, rows)
            found.append(sorted((r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect()))
    finally:
        spark.conf.unset(BATCH)
    assert found[0] == found[1] == found[2]


def test_clashing_columns_of_any_case(spark):
    """Operators that add columns replace those of the same name in any case and keep all others."""
    path = __import__("public_tokenizers").path(queries.TOKENIZER)
    adds = {
        "fp": simhash.fingerprints, "media": audio.encode, "n_tokens": lambda df: bpe.encode(df, path), "lang_pred": lambda df: langid.predict(df, None), "labels": licenses.scan,
        "spans": pii.find, "shard": lambda df: sharding.shard_by_bytes(df.withColumn("size", F.lit(3).cast("long")), 2),
    }
    for name, fn in adds.items():
        df = spark.createDataFrame([(1, "one two", "mine", "kept"), (1, "one two", "mine", "kept"), (2, None, None, None)], f"doc_id long, text string, {name.upper()} string, `a.b` string")
        rows = fn(df).collect()
        assert len(rows) == 3 and sum(c.lower() == name for c in rows[0].asDict()) == 1, name
        assert sorted(r["a.b"] or "" for r in rows) == ["", "kept", "kept"] and all(r[name] != "mine" for r in rows), name
        assert fn(df.where("false")).collect() == [], name


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, size long, fp string")
    assert mixing.taken(docs).collect() == [] and simhash.near_duplicates(docs).collect() == [] and simhash.first_of_groups(docs).collect() == []
    assert audio.features(audio.encode(docs)).collect() == [] and langid.fit(docs) is None and pii.sanitise(docs).collect() == []
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, score int"), F.lit(True)).collect() == []
    assert warc.resolve(spark.createDataFrame([], "page_id long, url string, payload string, refers_to int")).collect() == []


def test_a_folder_must_be_shared_on_a_cluster():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
