import hashlib
import zlib

import numpy as np

from aerialframe.llm import audio, queries


def test_resampling_keeps_a_low_tone_and_drops_a_high_one():
    t = np.arange(12_000) / audio.RATE
    low = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32))
    want = np.sin(2 * np.pi * 500 * np.arange(len(low)) / 8000 - 2 * np.pi * 500 * 0.5 / audio.RATE / audio.UP)
    assert len(low) == 8000
    assert np.abs(low[100:-100]).max() < 1.1 and np.corrcoef(low[100:-100], want[100:-100])[0, 1] > 0.98
    high = audio.resample(np.sin(2 * np.pi * 5800 * t).astype(np.float32))
    assert np.abs(high[100:-100]).max() < 0.2


def test_segments_have_hysteresis():
    e = np.array([0, 0, 9, 4, 4, 9, 0, 0, 4, 0, 9], float)
    got = audio.segments(e).tolist()
    assert got == [[2, 6], [10, 11]]
    assert audio.segments(np.zeros(5)).tolist() == []


def test_tensors_round_trip():
    mels = np.random.default_rng(0).normal(size=(130, audio.MELS)).astype(np.float32)
    table = audio.read_tensors(audio.tensor_bytes(mels))
    back = np.concatenate([c.to_numpy_ndarray() for c in table["log_mel"].chunks]).reshape(-1, audio.MELS)
    assert table.num_rows == 3 and np.array_equal(back[:130], mels)
    assert table["start_ms"][0].as_py() == 0 and table["end_ms"][0].as_py() > table["start_ms"][1].as_py()


def test_query_against_the_definition(spark):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        data = (r.text or "").encode()
        p = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want[r.doc_id] = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(audio.to_wav(p)).hexdigest())
    rows = queries.op3_audio_features(spark, d).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows} == want


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x" * 64, 0), (4, "é" * 100_000, 0), (5, "x" * 64, 0)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in audio.features(audio.encode(df)).collect()}
    assert bytes(rows[1].payload) == bytes(64) == bytes(rows[2].payload)
    assert bytes(rows[3].payload) == b"x" * 64 and len(rows[4].payload) == 200_000
    assert rows[3].tensors == rows[5].tensors and rows[3].mean_log_mel == rows[5].mean_log_mel
    assert audio.features(audio.encode(df.where("false"))).collect() == []
