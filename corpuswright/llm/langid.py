"""Language identification by a byte convolutional network.

A text's bytes (A-Z folded) are cut into windows of fixed length.  In each,
byte embeddings pass through filters of several widths, a rectifier and a
maximum over positions, and a softmax over the languages and one more class,
noise, for bytes of no language: it learns from windows whose bytes are shuffled
or drawn at random.  A text's language is the one with the largest sum of
log-probabilities over all its windows, each but the first weighted by the bytes
it adds; noise is never a language.  The network is trained here, in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import lean, remainder, slim
from ._words import pieces, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bounds of the training sample: documents of each language (those whose ids hash least), windows of each
#: document (in a row, from a place that its hash gives), and windows in all.
SAMPLE_DOCS = 1000
SAMPLE_PART = 8
SAMPLE_WINDOWS = 8000
STEPS = 260
BATCH = 64
#: Windows of noise in a batch.
NOISE = 16
UNKNOWN = "und"

#: Places of a filter in a window, the same for every width.
_PLACES = WINDOW - max(WIDTHS) + 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[9:14] = 32


@dataclass
class ByteNet:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def features(self, windows: np.ndarray) -> np.ndarray:
        """(windows, filters): the largest rectified response of each filter, all widths in one product."""
        wide = max(WIDTHS) * EMBEDDING
        every = np.zeros((wide, FILTERS * len(WIDTHS)), np.float32)
        for k, f in enumerate(self.filters):
            every[: len(f), k * FILTERS : (k + 1) * FILTERS] = f
        out = np.empty((len(windows), every.shape[1]), np.float32)
        for a in range(0, len(windows), 16):
            x = self.embedding[windows[a : a + 16]]
            spread = np.lib.stride_tricks.as_strided(x, (len(x), _PLACES, wide), x.strides)
            out[a : a + 16] = (spread.reshape(-1, wide) @ every).reshape(len(x), _PLACES, -1).max(1)
        return np.maximum(out + np.concatenate(self.biases), 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages and last noise)."""
        z = self.features(windows) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, document, weight): every byte of every text is in a window; a text's last window
    reaches back to be full, a shorter text is padded with spaces; weight: bytes not in the window before."""
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    docs = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = sizes[docs]
    begin = np.maximum(np.minimum(nth * window, own - window), 0)
    weight = np.where(nth == 0, window, np.minimum(own - nth * window, window))
    at = (offsets[:-1][docs] + begin)[:, None] + np.arange(window)
    found = _FOLD[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.zeros((0, window), np.uint8)
    short = own < window
    if short.any():
        found[short] = np.where(np.arange(window) < own[short][:, None], found[short], 32)
    return found, docs, weight


def noise(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of no language: half of the given ones with their bytes shuffled, half drawn evenly from 2 to 256 byte
    values, which lie anywhere or (up to 64) in a row, as digits, base64 and other scripts do."""
    out = rng.permuted(windows, axis=1)
    for row in out[: len(out) // 2]:
        size = int(2 ** rng.uniform(1, 8))
        values = rng.permutation(256)[:size] if rng.random() < 0.5 else (rng.integers(33, 256) + np.arange(min(size, 64))) % 256
        row[:] = values[rng.integers(len(values), size=len(row))]
    return _FOLD[out]


def train(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 0) -> ByteNet:
    """Adam on batches of windows, of each language as many, and noise made of some of them."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    windows, docs, weight = windows_of(data, offsets)
    labels = np.array([names.index(x) for x in languages])[docs] if len(docs) else np.zeros(0, int)
    if len(windows) > SAMPLE_WINDOWS:
        pick = np.sort(rng.permutation(len(windows))[:SAMPLE_WINDOWS])
        windows, labels = windows[pick], labels[pick]
    f32 = np.float32
    net = ByteNet(names, rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32), [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS], [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names) + 1)).astype(f32), np.zeros(len(names) + 1, f32))
    if not len(windows):
        return net
    by = [np.flatnonzero(labels == i) for i in range(len(names))]
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        rows = np.concatenate([x[rng.integers(len(x), size=BATCH // len(names) + 1)] for x in by if len(x)])
        made = noise(windows[rng.integers(len(windows), size=NOISE)], rng)
        grads = _gradients(net, np.concatenate([windows[rows], made]), np.concatenate([labels[rows], np.full(NOISE, len(names))]), rng)
        rate = 0.01 * (1 - t / (steps + 1)) + 1e-4
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.005 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.995**t)) + 1e-7)
    return net


def _gradients(net: ByteNet, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Of the mean cross-entropy; a random part of each window is blanked, so that short texts are learned too."""
    windows = windows.copy()
    cut = rng.integers(12, windows.shape[1] + 1, len(windows))
    windows[np.arange(windows.shape[1]) >= cut[:, None]] = 32
    x = net.embedding[windows]
    n, _, d = x.shape
    pooled, where = [], []
    for k, width in enumerate(WIDTHS):
        spread = np.lib.stride_tricks.as_strided(x, (n, _PLACES, width * d), x.strides)
        z = (spread.reshape(-1, width * d) @ net.filters[k]).reshape(n, -1, FILTERS)
        where.append(z.argmax(1))
        pooled.append(np.take_along_axis(z, where[-1][:, None], 1)[:, 0] + net.biases[k])
    h = np.maximum(np.concatenate(pooled, 1), 0)
    z = h @ net.out + net.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p /= n
    dh = (p @ net.out.T) * (h > 0)
    d_embedding, d_filters, d_biases = np.zeros_like(net.embedding), [], []
    for k, width in enumerate(WIDTHS):
        part = dh[:, k * FILTERS : (k + 1) * FILTERS]
        at = where[k][:, :, None] + np.arange(width)
        bytes_at = windows[np.arange(n)[:, None, None], at]
        seen = net.embedding[bytes_at].reshape(n, FILTERS, width * d)
        d_filters.append(np.einsum("nf,nfe->ef", part, seen))
        d_biases.append(part.sum(0))
        back = (part[:, :, None] * net.filters[k].T[None]).reshape(n, FILTERS, width, d)
        np.add.at(d_embedding, bytes_at, back)
    return [d_embedding, *d_filters, *d_biases, h.T @ p, p.sum(0)]


def fit(docs: DataFrame, held_out: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> ByteNet:
    """Trains on at most ``sample_docs`` documents of each language with a text, those not held out whose ids hash least.

    Rows of one id and language count once, with the least of their parts; rows of a null id are not learned from.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    if held_out is not None:
        rows = rows.filter(~held_out)
    most = SAMPLE_PART * WINDOW
    part = F.substring("text", F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - most, F.lit(1))).cast("int"), F.lit(most))
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    #: Half again as many ids as are wanted, at any size of a language, go on to be ranked: the estimate is off by some hundredths.
    share = hashed.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).select("lang", ((1.5 * sample_docs + 50) / F.col("ids")).alias("share"))
    low = hashed.select("doc_id", "lang", "h").join(F.broadcast(share), "lang").filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = low.select("doc_id", "lang", "h").distinct().withColumn("r", rank).filter(F.col("r") <= sample_docs).select("doc_id", "lang")
    texts = hashed.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "h", "doc_id").agg(F.min(part).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["lang"], r["h"], r["doc_id"], r["text"]) for batch in batches for r in batch.to_pylist())
        net = train([r[3] for r in got], [r[0] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    #: A task learns; the driver only sees the network.
    ordered = texts.select("lang", "h", F.col("doc_id").cast("string").alias("doc_id"), "text").repartition(1)
    got = ordered.mapInArrow(lean(learn), "net binary").first()
    return pickle.loads(got[0]) if got else train([], [])


def score(texts: pa.Array, net: ByteNet) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, confidence) for each whole text; ``und``, 0 and 0 where a text has no letter.

    The score is the probability among the languages, which nears 1 as any text grows;
    the confidence is the geometric mean of its windows' probabilities of being no noise, whichever their language.
    """
    names, scores, means = [], [], []
    for a, b in pieces(texts):
        part = texts.slice(a, b - a)
        data, offsets = utf8(part)
        windows, docs, weight = windows_of(data, offsets)
        total = np.zeros((b - a, len(net.languages) + 1))
        length = np.bincount(docs, weight / WINDOW, b - a)
        if len(net.languages) and len(windows):
            for x in range(0, len(windows), 4096):
                y = slice(x, x + 4096)
                logs = net.log_probabilities(windows[y]).astype(np.float64)
                logs[:, -1] = np.logaddexp.reduce(logs[:, :-1], axis=1)
                logs *= (weight[y] / WINDOW)[:, None]
                cuts = np.flatnonzero(np.diff(docs[y], prepend=-1))
                np.add.at(total, docs[y][cuts], np.add.reduceat(logs, cuts))
        mean = np.exp(np.minimum(total[:, -1] / np.maximum(length, 1), 0))
        p = np.exp(total[:, :-1] - total[:, :-1].max(1, keepdims=True, initial=-np.inf)) if net.languages else total
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        best = p.argmax(1)
        for i, t in enumerate(part.to_pylist()):
            if net.languages and t and any(map(str.isalpha, t)):
                names.append(net.languages[best[i]])
                scores.append(float(p[i, best[i]]))
                means.append(float(mean[i]))
            else:
                names.append(UNKNOWN)
                scores.append(0.0)
                means.append(0.0)
    return names, np.array(scores), np.array(means)


def predictor(net: ByteNet):
    """An Arrow function of a text column: struct(lang_pred, score, confidence)."""

    @F.arrow_udf("struct<lang_pred: string, score: double, confidence: double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, means = score(texts, net)
        slim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(means, pa.float64())], names=["lang_pred", "score", "confidence"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of every whole text, learned from the documents that are not held out.

    One row for each input row.  A null, empty or letterless text is ``und``
    with score 0; so is every text if no training row names a language.  Rows
    without a language are predicted but never learned from; an empty table
    gives no rows.
    """
    held = remainder(F.col("doc_id"), 4) == 2
    predict = predictor(fit(docs, held))
    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
