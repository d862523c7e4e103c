"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, small_batches, texts, with_columns

#: Bytes of a window; widths and number of filters for each; size of a byte's vector.
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 8, 8
#: The bounds of the training sample: documents of a label, of all labels together (but one for each label at least), windows of a document.
DOCS_PER_LABEL, DOCS, WINDOWS_PER_DOC = 400, 12_800, 4
#: Labels up to which their counts are broadcast.
BROADCAST_LABELS = 50_000
#: Passes over the sample and steps at least, rows of a step, its size.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 600, 64, 0.004, 7
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    labels: list[str]
    vectors: np.ndarray  # 256 x DIM; byte 0 only fills windows and stays 0
    filters: np.ndarray  # max(WIDTHS) * DIM x all filters; short filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows (n x WINDOW bytes): the stacked vectors, and each filter's largest answer and where it is."""
        widest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, widest - 1)))
        grams = np.lib.stride_tricks.sliding_window_view(padded, widest, axis=1)
        stacked = self.vectors[grams].reshape(len(windows), WINDOW, widest * DIM)
        answers = (stacked.reshape(-1, widest * DIM) @ self.filters).reshape(len(windows), WINDOW, -1)
        at = answers.argmax(1)
        return stacked, np.take_along_axis(answers, at[:, None], 1)[:, 0] + self.bias, at

    @functools.cached_property
    def tables(self) -> list[np.ndarray]:
        """Each filter's answer to every two bytes, for the first two places under it, the next two, and so on."""
        widest, n = max(WIDTHS), self.filters.shape[1]
        single = np.einsum("bd,wdf->wfb", self.vectors, self.filters.reshape(widest, DIM, n)).astype(np.float32)
        return [np.ascontiguousarray(single[i][:, :, None] + single[i + 1][:, None, :]).reshape(n, 65536) for i in range(0, widest, 2)]

    def predict(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        """Probabilities of the labels, window by window.

        A filter's answer at a place is a sum over the bytes under it, so it is looked up: one entry of a table for each two bytes.
        """
        widest, n, pairs = max(WIDTHS), self.filters.shape[1], self.tables
        width = np.repeat(WIDTHS, FILTERS)
        best = np.empty((len(windows), n), np.float32)
        for a in range(0, len(windows), block):
            w = np.pad(windows[a : a + block], ((0, 0), (0, widest))).astype(np.intp)
            two = w[:, :-1] * 256 + w[:, 1:]
            at = [np.ascontiguousarray(two[:, 2 * k : 2 * k + WINDOW]) for k in range(len(pairs))]
            answers, more = np.empty(at[0].shape, np.float32), np.empty(at[0].shape, np.float32)
            for f in range(n):
                np.take(pairs[0][f], at[0], out=answers, mode="clip")
                for k in range(1, -(-int(width[f]) // 2)):
                    np.add(answers, np.take(pairs[k][f], at[k], out=more, mode="clip"), out=answers)
                best[a : a + block, f] = answers.max(1)
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _mask() -> np.ndarray:
    """Which filter weights may differ from zero."""
    widest = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(widest * DIM) < w * DIM)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str]) -> Model:
    """Adam on the cross entropy; the same rows in the same order always give the same model."""
    rng = np.random.default_rng(SEED)
    mask, n = _mask(), len(WIDTHS) * FILTERS
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    m = Model(labels, draw(256, DIM), draw(max(WIDTHS) * DIM, n) * mask, np.zeros(n, np.float32), draw(n, len(labels)), np.zeros(len(labels), np.float32))
    names = ["vectors", "filters", "bias", "out", "out_bias"]
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    widest = max(WIDTHS)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(windows)))):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            w = windows[rows]
            stacked, raw, at = m.pooled(w)
            hidden = np.maximum(raw, 0)
            z = hidden @ m.out + m.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            back = (p @ m.out.T) * (raw > 0)
            hit = np.take_along_axis(stacked, at[:, :, None], 1)  # rows x filters x widest * DIM
            d_stacked = back[:, :, None] * m.filters.T[None]
            d_vectors = np.zeros_like(m.vectors)
            under = np.pad(w, ((0, 0), (0, widest - 1)))
            for k in range(widest):
                byte = np.take_along_axis(under, at + k, 1)
                np.add.at(d_vectors, byte.ravel(), d_stacked[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
            d_vectors[0] = 0
            grads = {"vectors": d_vectors, "filters": np.einsum("bf,bfk->kf", back, hit) * mask, "bias": back.sum(0), "out": hidden.T @ p, "out_bias": p.sum(0)}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                delta = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, (getattr(m, k) - delta).astype(np.float32))
            m.vectors[0] = 0
    return m


def windows_of(data: bytes) -> np.ndarray:
    """The whole text in windows of WINDOW bytes, the last filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def training_sample(docs: DataFrame, text: str, label: str, key: str) -> tuple[np.ndarray, list[str]]:
    """About DOCS_PER_LABEL documents of each label (all, if fewer), chosen by a hash, or as many fewer as keep all to DOCS, but one at least: every
    label is learned.

    Of each document WINDOWS_PER_DOC windows are taken, spread over it. This is the bound on what reaches the driver: it grows with the
    list of labels only.
    """
    rows = docs.where(quoted(label).isNotNull() & (F.length(quoted(text)) > 0)).select(quoted(text).alias("text"), quoted(label).alias("label"), quoted(key).alias("key"))
    # a document's place between 0 and 1; the first of each label is always taken
    rows = rows.withColumn("place", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30))
    labels = cut(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    names = labels.count()
    each = max(1, min(DOCS_PER_LABEL, DOCS // max(names, 1)))
    # texts stay where they are, unless the list of labels is too long to be sent to them
    chosen = rows.join(F.broadcast(labels) if names <= BROADCAST_LABELS else labels, "label").where((F.col("place") * F.col("n") < each) | (F.col("place") == F.col("first"))).select("text", "label")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            data, labels = [], []
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = windows_of(t.encode())
                for i in sorted({int(i) for i in np.linspace(0, len(w) - 1, WINDOWS_PER_DOC)}):
                    data.append(w[i].tobytes())
                    labels.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(labels, pa.string())], ["window", "label"])

    found = sorted((r.label, bytes(r.window)) for r in chosen.mapInArrow(windows, "window binary, label string").collect())
    return np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW), [name for name, _ in found]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of all labels of ``docs``; rows with a null label or no text teach nothing, repeated rows count as often as they stand. None if
    there is nothing to learn from, as in an empty table. Other columns of ``docs`` are not read."""
    windows, names = training_sample(docs, text, label, key)
    if not names:
        return None
    labels = sorted(set(names))
    return train(windows, np.array([labels.index(n) for n in names]), labels)


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``: the label of highest mean probability over all windows of the text.

    ``und`` with score 0 where the text is null or has no letters, or nothing was learned. Columns of these names are replaced, in any case.
    Repeated rows each get the same label; an empty table gives an empty result; long texts are read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m: Model | None = shared.value
        values = texts(batch, text)
        labels, scores = [UNDETERMINED] * len(values), np.zeros(len(values))
        known = [i for i, v in enumerate(values) if m and any(map(str.isalpha, v))]
        if known:
            parts = [windows_of(values[i].encode()) for i in known]
            probs = m.predict(np.concatenate(parts))
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            means = np.add.reduceat(probs, starts, 0) / np.array([len(p) for p in parts])[:, None]
            for i, row in zip(known, means, strict=True):
                labels[i], scores[i] = m.labels[int(row.argmax())], min(1.0, float(row.max()))
        return {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())}

    return with_columns(df, "lang_pred string, score double", run)
