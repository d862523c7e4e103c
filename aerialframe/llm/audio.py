"""Audio columns: lossless 8-bit WAV, and log-mel tensors with time spans."""

from __future__ import annotations

import functools
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, with_columns

#: Stored and analysed sample rates, in the ratio DOWN to UP.
RATE, UP, DOWN = 12_000, 2, 3
#: Taps of the resampling filter for each phase.
TAPS = 16
#: Frame and step in samples at the analysed rate, mel bands, frames of a tensor.
FRAME, STEP, MELS, PATCH = 256, 128, 32, 64
FLOOR = 1e-6
#: A segment starts above mean + HIGH deviations of the frame energy and ends below mean + LOW deviations.
HIGH, LOW = 0.75, -0.25


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


@functools.cache
def _phases() -> list[np.ndarray]:
    """A windowed-sinc low pass at the lower of both Nyquist rates, cut into its UP phases (each reversed for a dot product)."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n)
    h *= UP / h.sum()
    return [np.ascontiguousarray(h[p::UP][::-1]).astype(np.float32) for p in range(UP)]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output UP * j + i weighs TAPS inputs around DOWN * j + i * DOWN // UP by phase i * DOWN % UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.pad(x, (TAPS // 2, TAPS // 2 + DOWN))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for i in range(UP):
        y = windows[i * DOWN // UP :: DOWN] @ _phases()[i * DOWN % UP]
        out[i::UP] = y[: len(out[i::UP])]
    return out


@functools.cache
def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(y: np.ndarray, block: int = 4096) -> np.ndarray:
    """Log energies of MELS bands for frames of FRAME samples that overlap by half; the last frame is filled with silence."""
    count = 1 + max(0, -(-(len(y) - FRAME) // STEP))
    y = np.pad(y, (0, (count - 1) * STEP + FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::STEP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((count, MELS), np.float32)
    for a in range(0, count, block):
        spectrum = np.fft.rfft(frames[a : a + block] * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[a : a + block] = np.log(power.astype(np.float32) @ _mel_bank() + FLOOR)
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """Runs of frames that start at or above the high level and last until the energy falls below the low one: rows of (first, end)."""
    mean, dev = float(energy.mean()), float(energy.std())
    mark = np.where(energy >= mean + HIGH * dev, 1, np.where(energy < mean + LOW * dev, -1, 0)) if dev > 0 else np.zeros(len(energy), int)
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (at >= 0) & (mark[np.maximum(at, 0)] == 1)
    change = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], 1)


def tensor_bytes(mels: np.ndarray) -> bytes:
    """An Arrow stream of (start_ms, end_ms, log_mel), where log_mel is a fixed-shape tensor of PATCH x MELS; the last is filled with the floor."""
    n = -(-len(mels) // PATCH)
    full = np.full((n * PATCH, MELS), np.log(FLOOR), np.float32)
    full[: len(mels)] = mels
    ms = STEP * 1000 * DOWN / (RATE * UP)
    first = np.arange(n) * PATCH
    last = np.minimum(first + PATCH, len(mels)) + FRAME // STEP - 1
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(first * ms), pa.array(last * ms), tensor], ["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``media``: the UTF-8 bytes of ``text``, filled with zeros to a positive multiple of 64, as 8-bit WAV samples.

    A null text is empty (64 zeros). A column ``media`` of ``df`` is replaced, in any case; others stay. Repeated rows each get the same media; an
    empty table gives an empty one; texts are stored whole, however long.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data = [t.encode() for t in texts(batch, text)]
        return {"media": pa.array([to_wav(d.ljust(max(64, -(-len(d) // 64) * 64), b"\0")) for d in data], pa.binary())}

    return with_columns(df, "media binary", run)


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what its WAV column holds: ``payload`` (samples), ``tensors``, ``n_frames``, ``segments``, ``mean_log_mel``.

    ``tensors`` is an Arrow stream with a fixed-shape tensor column (see ``read_tensors``); ``segments`` are spans in
    milliseconds. Equal media give equal values, in repeated rows too. A null media gives nulls; an empty table gives an
    empty one. Columns of these names in ``df`` are replaced, in any case.
    """
    names = ["payload", "tensors", "n_frames", "segments", "mean_log_mel"]
    spans = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    types = [pa.binary(), pa.binary(), pa.int64(), spans, pa.float64()]
    ms = STEP * 1000 * DOWN / (RATE * UP)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        payload = from_wav(data)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mels = log_mel(resample(x))
        found = segments(mels.mean(1))
        return payload, tensor_bytes(mels), len(mels), [{"start_ms": a * ms, "end_ms": b * ms} for a, b in found.tolist()], float(mels.mean(dtype=np.float64))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [one(m) for m in batch.column(batch.schema.get_field_index(media)).to_pylist()]
        return {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}

    return with_columns(df, "payload binary, tensors binary, n_frames long, segments array<struct<start_ms double, end_ms double>>, mean_log_mel double", run)
