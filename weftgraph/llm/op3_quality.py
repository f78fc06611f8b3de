"""Quality classifier: a convolutional network over a text's bytes.

A text is cut into chunks of 512 bytes that overlap by 64 and cover all of it. Each filter's
largest response is kept in each chunk; the largest and the mean over chunks, and the logarithm
of the text's length, give one probability. It is trained on the driver with a bounded sample of
labelled texts and sent to the tasks (some 30 KB); scoring shuffles nothing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.byte_cnn import PAD, Adam, ByteNet, calibration, sigmoid
from weftgraph.llm.common import mapped, schema_of, table, utf8

CHUNK, STEP = 512, 448
WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 8, 4, 8, 32, 16
THRESHOLD = 0.3
#: Labelled texts to train on at most; training sees all chunks of each.
TRAIN_TEXTS = 3000
PASSES = 14
#: Share of the good texts whose beginnings are trained on besides.
SHORT_SHARE = 0.3
#: Chunks that a task turns over at once.
AT_ONCE = 1024


def chunk_starts(n: int) -> np.ndarray:
    """Where chunks of a text of n bytes begin: every STEP bytes, the last one at the end."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK, STEP)
    return np.append(starts, n - CHUNK)


def _windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if len(data) < CHUNK:
        out = np.full((1, CHUNK), PAD, np.int16)
        out[0, : len(data)] = data
        return out
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts].astype(np.int16)


def _document_features(best: np.ndarray, first: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """best: filters' largest responses by chunk; first: each document's first chunk."""
    count = np.diff(np.append(first, len(best)))[:, None]
    top = np.maximum.reduceat(best, first, axis=0)
    mean = np.add.reduceat(best, first, axis=0) / count
    return np.concatenate([top, mean, np.log1p(n_bytes)[:, None] / 10], axis=1).astype(np.float32)


class QualityModel:
    def __init__(self, net: ByteNet, slope: float, shift: float):
        self.net, self.slope, self.shift = net, slope, shift

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text; chunks of long texts are turned over in pieces, so memory stays bounded."""
        out = np.empty((len(texts), 2 * FILTERS + 1), np.float32)
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if group:
                best = self._best(np.concatenate([w for _, w in group]))
                first = np.cumsum([0, *(len(w) for _, w in group[:-1])])
                ids = [i for i, _ in group]
                out[ids] = _document_features(best, first, np.array([len(texts[i]) for i in ids]))
            group.clear()
            held = 0

        for i, t in enumerate(texts):
            data, starts = np.frombuffer(t, "u1"), chunk_starts(len(t))
            if len(starts) > AT_ONCE:
                best = np.concatenate([self._best(_windows(data, starts[k : k + AT_ONCE])) for k in range(0, len(starts), AT_ONCE)])
                out[i] = _document_features(best, np.zeros(1, int), np.array([len(t)]))[0]
                continue
            if held + len(starts) > AT_ONCE:
                flush()
            group.append((i, _windows(data, starts)))
            held += len(starts)
        flush()
        return self.net.head(out)

    def _best(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), FILTERS), np.float32)
        for k in range(0, len(windows), 128):
            out[k : k + 128] = self.net.responses(self.net.looked_up(windows[k : k + 128])).max(axis=1)
        return np.maximum(out, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(texts) + self.shift) if texts else np.zeros(0)


def train(samples: list[tuple[list[bytes], int, int]], seed: int = 7) -> QualityModel:
    """samples: the chunks of a text, the text's length in bytes, and its label 0 or 1.

    One sample in ten is kept back to calibrate the probability. With no samples, or only one label
    among them, the model gives every text that label's share (0.5 for none).
    """
    net = ByteNet(WIDTH, STRIDE, DIM, FILTERS, 2 * FILTERS + 1, HIDDEN, seed)
    labels = np.array([s[2] for s in samples], np.float64)
    if len(samples) < 20 or labels.min() == labels.max():
        net.p["out"][:] = 0
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(net, 1.0, float(np.log(share / (1 - share))))
    # good texts can be short, and few of the sample are: beginnings of good ones teach that
    r = np.random.default_rng(seed + 2)
    short = [([c[0][: (n := int(r.integers(15, CHUNK)))]], min(n, size), 1) for c, size, label in samples if label == 1 and r.random() < SHORT_SHARE]
    n_own, samples = len(samples), [*samples, *short]
    labels = np.array([s[2] for s in samples], np.float64)
    windows = []
    for chunks, _, _ in samples:
        w = np.full((len(chunks), CHUNK), PAD, np.int16)
        for k, c in enumerate(chunks):
            w[k, : len(c)] = np.frombuffer(c, "u1")
        windows.append(w)
    lengths = np.array([s[1] for s in samples])
    order = np.random.default_rng(seed).permutation(n_own)
    held, used = order[: n_own // 10], np.append(order[n_own // 10 :], np.arange(n_own, len(samples)))
    # the rarer label weighs more, by the square root of how much rarer it is
    share = labels[used].mean()
    weight = np.where(labels == 1, np.sqrt(1 / share), np.sqrt(1 / (1 - share)))
    weight /= weight[used].mean()
    adam, r = Adam(net.p, 4e-3), np.random.default_rng(seed + 1)
    for k in range(PASSES):
        adam.rate = 4e-3 * (1 - k / PASSES) + 2e-4
        mixed = r.permutation(used)
        for a in range(0, len(mixed), 32):
            _train_step(net, adam, mixed[a : a + 32], windows, lengths, labels, weight)
    # calibrate on what was kept back
    logits = np.concatenate([net.head(_forward(net, [windows[i]], lengths[[i]])[2]) for i in held])
    slope, shift = calibration(logits, labels[held])
    return QualityModel(net, max(slope, 0.1), shift)


def _forward(net: ByteNet, windows: list[np.ndarray], lengths: np.ndarray):
    x = net.looked_up(np.concatenate(windows))
    out = net.responses(x)
    place = out.argmax(axis=1)
    best = np.maximum(np.take_along_axis(out, place[:, None], axis=1)[:, 0], 0)
    first = np.cumsum([0, *(len(w) for w in windows[:-1])])
    return x, (place, best, first), _document_features(best, first, lengths)


def _train_step(net, adam, ids, windows, lengths, labels, weight) -> None:
    own = [windows[i] for i in ids]
    x, (place, best, first), features = _forward(net, own, lengths[ids])
    d_logit = ((sigmoid(net.head(features)) - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
    grads = net.no_grads()
    d = net.head_back(features, d_logit, grads)
    count = np.array([len(w) for w in own])
    doc = np.repeat(np.arange(len(own)), count)
    top = features[:, :FILTERS][doc]
    d_best = d[doc, FILTERS : 2 * FILTERS] / count[doc][:, None] + np.where(best.astype(np.float32) == top, d[doc, :FILTERS], 0)
    net.filters_back(np.concatenate(own), x, place, np.where(best > 0, d_best, 0).astype(np.float32), grads)
    adam.step(grads)


def held_out(key: str = "doc_id"):
    """Whether a row belongs to the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> QualityModel:
    """Train on the whole texts of at most that many labelled documents outside the held-out fold, chosen by a hash of doc_id.

    Labels other than 0 and 1 are left out; of repeated labels of a document the larger holds, and of repeated
    rows of a document the text with the smallest hash, so no more than that many texts come to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    found = docs.select("doc_id", utf8("text").alias("data")).join(F.broadcast(chosen), "doc_id")  # texts rows at most
    one = found.groupBy("doc_id", "quality").agg(F.min_by("data", F.struct(F.xxhash64("data"), "data")).alias("data"))
    rows = sorted((r.doc_id, bytes(r.data), r.quality) for r in one.collect())
    return train([([data[s : s + CHUNK] for s in chunk_starts(len(data)).tolist()], len(data), label) for _, data, label in rows])


def _score_batches(batches, model: QualityModel, text: str, out: str):
    for batch in batches:
        got = model.scores([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, out])


def with_score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with each whole text's probability of being good; null and empty texts get a score too. A column named like out is replaced."""
    keep = [c for c in df.columns if c != out]
    return mapped(df.select(*[F.col(f"`{c}`") for c in keep]), partial(_score_batches, model=model, text=text, out=out), schema_of(df, keep, f"`{out}` double"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
