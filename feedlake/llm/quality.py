"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes, to its end. Learned filters slide
over each chunk and are max-pooled, a small hidden layer describes the chunk (it can
also say what a chunk lacks), and the greatest and mean description over all chunks
give one probability. Memory is bounded by a block of chunks, whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
CHUNK_STEP = 192
WIDTH = 8
STEP = 2
EMBED = 8
FILTERS = 24
HIDDEN = 16
WINDOWS = (CHUNK - WIDTH) // STEP + 1
#: Chunks that are worked on at once.
BLOCK = 256

#: Bounds of the training sample: labelled rows, and bytes of their texts in all, which
#: are whole; the last one may exceed it. Scoring has no such bounds.
TRAIN_ROWS = 4000
TRAIN_BYTES = 32 << 20
STEPS = 800
BATCH = 32
#: Chunks that training goes over in all; longer texts get fewer passes, one at least.
TRAIN_CHUNKS = STEPS * BATCH * 32
RATE = 3e-3

Weights = dict[str, np.ndarray]


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes that cover the text; one chunk of zeros for an empty text."""
    data = (text or "").encode()
    count = max(1, -(-(len(data) - CHUNK + CHUNK_STEP) // CHUNK_STEP))
    padded = np.zeros((count - 1) * CHUNK_STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (CHUNK_STEP, 1))


def _responses(w: Weights, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, WINDOWS, WIDTH * EMBED) and filter responses (n, WINDOWS, FILTERS)."""
    x = w["embed"][block]
    size = x.itemsize
    shape = (len(block), WINDOWS, WIDTH * EMBED)
    view = np.lib.stride_tricks.as_strided(x, shape, (CHUNK * EMBED * size, STEP * EMBED * size, size))
    flat = np.ascontiguousarray(view)
    return flat, (flat.reshape(-1, WIDTH * EMBED) @ w["filters"]).reshape(len(block), WINDOWS, FILTERS)


def _describe(w: Weights, block: np.ndarray) -> np.ndarray:
    pooled = np.maximum(_responses(w, block)[1].max(axis=1) + w["bias"], 0)
    return np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(w: Weights, texts: Iterable[str | None]) -> np.ndarray:
    """One probability per text."""
    texts = list(texts)
    most = np.zeros((len(texts), HIDDEN), np.float32)
    total = np.zeros((len(texts), HIDDEN), np.float64)
    count = np.zeros((len(texts), 1))
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        lengths = [len(part) for _, part in waiting]
        described = _describe(w, np.concatenate([part for _, part in waiting]))
        starts = np.cumsum([0, *lengths[:-1]])
        rows = [k for k, _ in waiting]
        # A text may have one part in a block at most, so rows are distinct.
        most[rows] = np.maximum(most[rows], np.maximum.reduceat(described, starts))
        total[rows] += np.add.reduceat(described, starts)
        count[rows, 0] += lengths
        waiting.clear()

    for k, text in enumerate(texts):
        parts = chunks(text)
        at = 0
        while at < len(parts):
            part = parts[at : at + BLOCK - held]
            waiting.append((k, part))
            at += len(part)
            held += len(part)
            if held == BLOCK:
                flush()
                held = 0
    if waiting:
        flush()
    pooled = np.hstack([most, total / np.maximum(count, 1)])
    return _sigmoid(pooled @ w["out"] + w["out_bias"][0]).astype(np.float64)


def initial(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda a, b, s: rng.normal(0, s, (a, b)).astype(np.float32)
    return {
        "embed": draw(256, EMBED, 0.5),
        "filters": draw(WIDTH * EMBED, FILTERS, 0.2),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": draw(FILTERS, HIDDEN, 0.25),
        "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
        "out": np.zeros(2 * HIDDEN, np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def gradients(w: Weights, parts: list[np.ndarray], labels: np.ndarray) -> Weights:
    """Mean gradient of the log loss over a few documents given as chunk blocks.

    Responses of BLOCK chunks are held at once; of each chunk only the winners of the
    max-pooling are kept, so documents may be of any length."""
    lengths = np.array([len(p) for p in parts])
    block = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), lengths)
    starts = np.cumsum(lengths) - lengths
    slices = [slice(k, k + BLOCK) for k in range(0, len(block), BLOCK)]
    where = np.empty((len(block), FILTERS), np.int64)
    raw = np.empty((len(block), FILTERS), w["filters"].dtype)
    for part in slices:
        responses = _responses(w, block[part])[1]
        where[part] = responses.argmax(axis=1)
        raw[part] = np.take_along_axis(responses, where[part][:, None], axis=1)[:, 0] + w["bias"]
    pooled = np.maximum(raw, 0)
    inner = pooled @ w["hidden"] + w["hidden_bias"]
    described = np.maximum(inner, 0)
    most = np.maximum.reduceat(described, starts)
    features = np.hstack([most, np.add.reduceat(described, starts) / lengths[:, None]])
    error = ((_sigmoid(features @ w["out"] + w["out_bias"][0]) - labels) / len(parts)).astype(np.float32)

    g = {"out": features.T @ error, "out_bias": error.sum(keepdims=True)}
    back = error[:, None] * w["out"]
    d_described = back[doc, HIDDEN:] / lengths[doc, None]
    winner = described == most[doc]
    ties = np.add.reduceat(winner.astype(np.float32), starts)
    d_described = d_described + winner * back[doc, :HIDDEN] / ties[doc]
    d_inner = d_described * (inner > 0)
    g["hidden"], g["hidden_bias"] = pooled.T @ d_inner, d_inner.sum(axis=0)
    d_raw = (d_inner @ w["hidden"].T) * (raw > 0)
    g["bias"] = d_raw.sum(axis=0)
    g["filters"], g["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
    for part in slices:
        chunk, d = block[part], d_raw[part]
        position = where[part][:, :, None] * STEP + np.arange(WIDTH)
        used = chunk[np.arange(len(chunk))[:, None, None], position]
        picked = w["embed"][used].reshape(len(chunk), FILTERS, WIDTH * EMBED)
        g["filters"] += np.einsum("nfd,nf->df", picked, d)
        d_window = (d[:, :, None] * w["filters"].T).reshape(-1, EMBED)
        g["embed"] += np.stack([np.bincount(used.ravel(), d_window[:, e], 256) for e in range(EMBED)], axis=1).astype(raw.dtype)
    return {k: v.astype(np.float32) for k, v in g.items()}


def train(texts: list[str], labels: list[int], seed: int = 7) -> Weights:
    """Adam over shuffled mini-batches. Without rows of both labels the network stays
    at the share of label 1 (one half without any row)."""
    w = initial(seed)
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    w["out_bias"][0] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        return w
    parts = [chunks(t) for t in texts]
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    order: list[int] = []
    size = min(BATCH, len(parts))
    affordable = int(TRAIN_CHUNKS / (size * np.mean([len(p) for p in parts])))
    steps = min(STEPS, max(affordable, -(-len(parts) // size)))
    for step in range(1, steps + 1):
        if len(order) < size:
            order += rng.permutation(len(parts)).tolist()
        batch, order = order[:size], order[size:]
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in gradients(w, [parts[i] for i in batch], y[batch]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            fresh = first[k] / (1 - 0.9**step)
            w[k] -= rate * fresh / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = TRAIN_ROWS
) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts, whole, in the order of a hash of the id until
    they have TRAIN_BYTES.

    ``learn`` is a condition on doc_id for rows that may be learned from. Labels that
    are null, other than 0 and 1 or without a document are passed over.
    """
    sample = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        sample = sample.where(learn)
    sample = sample.select("doc_id", "quality").distinct()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    text = F.coalesce("text", F.lit(""))
    # Broadcast: at most ``rows`` ids and labels.
    sized = docs.select("doc_id", F.octet_length(text).alias("size")).join(F.broadcast(sample), "doc_id")
    sized = sized.groupBy("doc_id", "quality").agg(F.max("size").cast("long").alias("size"))
    sized = sized.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()
    before = np.cumsum([0, *(r.size for r in sized)])[:-1]
    chosen = [(r.doc_id, r.quality) for r, size in zip(sized, before, strict=True) if size < TRAIN_BYTES]
    if not chosen:
        return [], []
    kept = docs.sparkSession.createDataFrame(chosen, sample.schema)
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(kept), "doc_id")
    got = found.dropDuplicates(["doc_id", "quality"]).limit(rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.quality))
    return [r.text for r in got], [r.quality for r in got]


def scorer(weights: Weights, text: Column) -> Column:
    """Probability of good quality, for every row; null counts as empty."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(weights, texts))

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Weights:
    """Train on a bounded sample of labelled rows; the weights are about 40 kB."""
    return train(*training_rows(docs, labels, learn))


def keep_good(docs: DataFrame, weights: Weights, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns as they were."""
    return docs.where(scorer(weights, F.col(text_col)) >= threshold)
