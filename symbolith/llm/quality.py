"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks of ``WIDTH`` bytes, one
every ``STRIDE``, that cover the whole document; each filter's largest response over all
chunks is kept, and a logistic layer combines them into one probability. Gradients flow
through the winning chunk of each filter, so filters and embedding are learned together.

The network is fitted on the driver from a bounded sample (``sampling.labelled_sample``)
and broadcast: its size is fixed. Both classes weigh the same, at any size of the corpus. Scoring is one pass over the documents without a shuffle,
in pieces of bounded size; a very long text is convolved part by part.

Defined cases: null and empty texts are scored as one chunk of padding; a null id is scored
too and is not held out; repeated rows are scored alike; extra columns are dropped; without
labelled rows of both classes the score is the constant share of label 1 (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, string_buffer
from .sampling import balance, fold, labelled_sample

WIDTH, STRIDE, DIM, FILTERS = 12, 4, 8, 24
BLOCKS = WIDTH // STRIDE
PIECE = 1 << 18
FOLDS, HELD_OUT = 4, 2
KEEP_AT = 0.7


def chunk_counts(lengths: np.ndarray) -> np.ndarray:
    return np.maximum(-(-(lengths - WIDTH) // STRIDE), 0) + 1


def padded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows padded with zero bytes to whole chunks, with each row's first chunk and count."""
    lengths = np.diff(offsets)
    counts = chunk_counts(lengths)
    room = (counts + BLOCKS - 1) * STRIDE
    begin = np.concatenate(([0], np.cumsum(room)))
    out = np.zeros(begin[-1], np.uint8)
    out[np.arange(len(buf)) + np.repeat(begin[:-1] - offsets[:-1], lengths)] = buf
    return out, begin[:-1] // STRIDE, counts


def new_model(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "kernel": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (BLOCKS, STRIDE * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }


def responses(m: dict, data: np.ndarray) -> np.ndarray:
    """Each filter's response at each chunk of a padded buffer."""
    x = m["embed"][data].reshape(-1, STRIDE * DIM)
    n = len(x) - BLOCKS + 1
    y = x[:n] @ m["kernel"][0]
    for b in range(1, BLOCKS):
        y += x[b : b + n] @ m["kernel"][b]
    return y


def pooled(m: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FILTERS): largest response over all chunks of each row."""
    n = len(offsets) - 1
    if n == 1 and len(buf) > 2 * PIECE:  # a long text, part by part; parts overlap by a chunk
        cuts = range(0, len(buf), PIECE)
        parts = [buf[c : c + PIECE + WIDTH - STRIDE] for c in cuts if c == 0 or len(buf) - c > WIDTH - STRIDE]
        return np.max([pooled(m, p, np.array([0, len(p)])) for p in parts], axis=0)
    data, first, counts = padded(buf, offsets)
    y = responses(m, data)
    ends = np.minimum(first + counts, len(y) - 1)
    both = np.stack([first, ends], 1).ravel()
    top = np.maximum.reduceat(y, both, axis=0)[::2]
    last = first[-1]
    top[-1] = y[last : last + counts[-1]].max(axis=0)
    return np.maximum(top + m["bias"], 0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(m: dict, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if "constant" in m:
        return np.full(len(offsets) - 1, m["constant"])
    return sigmoid(pooled(m, buf, offsets) @ m["out"] + m["shift"][0]).astype(np.float64)


def _gradients(m: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data, first, counts = padded(buf, offsets)
    r = responses(m, data)
    at = np.stack([f + r[f : f + c].argmax(axis=0) for f, c in zip(first, counts)])
    top = np.take_along_axis(r, at, axis=0) + m["bias"]
    h = np.maximum(top, 0)
    p = sigmoid(h @ m["out"] + m["shift"][0])
    dz = (weight * (p - y) / len(y)).astype(np.float32)
    dh = dz[:, None] * m["out"] * (top > 0)
    chunk = data[(at * STRIDE)[:, :, None] + np.arange(WIDTH)]
    patch = m["embed"][chunk].reshape(len(y), FILTERS, WIDTH * DIM)
    kernel = m["kernel"].reshape(WIDTH * DIM, FILTERS)
    dpatch = (dh[:, :, None] * kernel.T).reshape(-1, DIM)
    embed = np.stack([np.bincount(chunk.ravel(), dpatch[:, d], 256) for d in range(DIM)], 1)
    return {
        "embed": embed.astype(np.float32),
        "kernel": np.einsum("bf,bfk->kf", dh, patch).reshape(m["kernel"].shape),
        "bias": dh.sum(0),
        "out": h.T @ dz,
        "shift": dz.sum(keepdims=True),
    }


def fit(rows: list[tuple[str, int]], epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 3, least_steps: int = 500) -> dict:
    """Adam on the log loss; rows are (text, label). Few rows are gone through more often."""
    epochs = max(epochs, -(-least_steps * batch // max(len(rows), 1)) if len(rows) < least_steps * batch // epochs else epochs)
    epochs = min(epochs, 60)
    y = np.array([label for _, label in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    texts, weight = [t.encode() for t, _ in rows], np.array(balance([v for _, v in rows]), np.float32)
    m, rng = new_model(seed), np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in m.items()}
    two = {k: np.zeros_like(v) for k, v in m.items()}
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            pick = order[i : i + batch]
            step += 1
            lr = rate * (1 - (step - 1) / steps)
            for k, g in _gradients(m, [texts[j] for j in pick], y[pick], weight[pick]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = m[k] - (lr * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> dict:
    return fit(labelled_sample(documents, labels, label, folds, held_out, **options))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = string_buffer(b.column(2))
            got = [score(m, buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "held_out", "score"]
            )

    return run


def classify(documents: DataFrame, model: dict, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    rows = rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(documents: DataFrame, model: dict, threshold: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, whose text scores at least ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, off = string_buffer(b.column(at))
            got = [score(m, buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off, PIECE)]
            if got:
                yield b.filter(pa.array(np.concatenate(got) >= threshold))

    return documents.mapInArrow(lean(run), documents.schema)
