"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network on shape
statistics of whole texts.  The loss is the non-negative unbiased risk
(Kiryo et al., 2017): with class prior p and sigmoid loss l,
``p R(P, +1) + max(0, R(U, -1) - p R(P, -1))``; where the second part turns
negative, its gradient is reversed.  The prior is estimated from the labelled
rows, or, where these are all positive, from a classifier of labelled against
unlabelled by its odds on positives that it was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import remainder
from ._words import mix, pieces, shingles, utf8, word_hashes, words

THRESHOLD = 0.7
#: Bounds of the training sample: positives, unlabelled texts, and negatives for calibration; the least hashes of the ids are taken.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED, SAMPLE_NEGATIVE = 6000, 6000, 2000
HIDDEN, STEPS, BATCH = 16, 700, 256

_CLASSES = [
    range(65, 91), range(97, 123), range(48, 58), (32,), (10,), (9, 11, 12, 13), range(128, 256),
    b".", b",", b"!", b"?", b";:", b"'\"", b"()[]{}", b"|", b"#", b"$", b"%", b"&", b"*", b"=<>/\\_", b"-+@^~`",
]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _i
N_FEATURES = len(_CLASSES) + 1 + 12


def _per_document(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values over the spans that the cuts part."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _repeats(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: share of items that repeat an earlier one; share of the commonest item."""
    total = np.maximum(np.bincount(docs, minlength=n), 1)
    key = np.lexsort((hashes, docs))
    h, d = hashes[key], docs[key]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], runs)
    return (total - np.maximum(distinct, 1)) / total, most / total


def features(texts: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) float32 of whole texts; an empty text's are those of no bytes."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for a, b in pieces(texts):
        data, offsets = utf8(texts.slice(a, b - a))
        n, sizes = b - a, np.diff(offsets)
        doc_of = np.repeat(np.arange(n), sizes)
        classes = len(_CLASSES) + 1
        counts = np.bincount(doc_of * classes + _CLASS_OF[data], minlength=n * classes).reshape(n, classes)
        start, end, first = words(data, offsets)
        hashes = word_hashes(data, start, end)
        n_words = np.diff(first)
        word_doc = np.repeat(np.arange(n), n_words)
        lengths = (end - start).astype(np.float64)
        same = np.zeros(len(hashes))
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
        many = np.maximum(n_words, 1)
        mean = _per_document(lengths, first) / many
        spread = np.sqrt(np.maximum(_per_document(lengths**2, first) / many - mean**2, 0))
        marks = shingles(hashes, first)
        repeated, _ = _repeats(*marks, n)
        word_repeats, commonest = _repeats(hashes, word_doc, n)
        #: A line's hash is the sum of its words' hashes, each mixed with its place.
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, start) + word_doc
        heads = np.ones(len(line), bool)
        heads[1:] = line[1:] != line[:-1]
        at = np.flatnonzero(heads)
        if len(at):
            place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
            line_hash = np.add.reduceat(mix(hashes + place.astype(np.uint64)), at)
            line_repeats, _ = _repeats(line_hash, word_doc[at], n)
            n_lines = np.bincount(word_doc[at], minlength=n)
        else:
            line_repeats, n_lines = np.zeros(n), np.zeros(n)
        solid = np.zeros(len(start))
        if len(start):
            last = data[end - 1]
            solid = (last < 128) & ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)))
        capital = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.zeros(0)
        more = [np.log1p(sizes), np.log1p(n_words), mean / 10, spread / 10, _per_document(same, first) / many, repeated, word_repeats, commonest, line_repeats, np.log1p(n_words / np.maximum(n_lines, 1)), _per_document(solid, first) / many, _per_document(capital, first) / many]
        shares = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
        out[a:b] = np.concatenate([shares, np.stack(more, 1)], 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    parameters: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parameters
        return np.maximum(((x - self.mean) / self.scale) @ w1 + b1, 0) @ w2[:, 0] + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * self.raw(x) + self.offset, -30, 30).astype(np.float64)
        return 1 / (1 + np.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(net: Network, weigh, sets: list[np.ndarray], steps: int, rng: np.random.Generator) -> None:
    """Adam; ``weigh`` maps the sets' scores to the loss's derivatives by score."""
    p = net.parameters
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        batch = [s[rng.integers(len(s), size=min(BATCH, len(s)))] for s in sets]
        x = (np.concatenate(batch) - net.mean) / net.scale
        hidden = x @ p[0] + p[1]
        act = np.maximum(hidden, 0)
        z = act @ p[2][:, 0] + p[3][0]
        d = np.concatenate(weigh(np.split(z, np.cumsum([len(b) for b in batch])[:-1])))[:, None].astype(np.float32)
        back = (d @ p[2].T) * (hidden > 0)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(0), act.T @ d + 1e-4 * p[2], d.sum(0)]
        for q, g, a, b in zip(p, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= 0.01 * (1 - t / (steps + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)


def estimate_prior(net: Network, positive: np.ndarray, unlabelled: np.ndarray, negatives: int, positives: int, rng: np.random.Generator) -> float:
    """Share of positives among all texts."""
    if negatives:
        return min(0.99, max(0.01, positives / (positives + negatives)))
    half = len(positive) // 2
    other = Network(net.mean, net.scale, [q.copy() for q in net.parameters])
    _descend(other, lambda z: [(_sigmoid(z[0]) - 1) / len(z[0]), _sigmoid(z[1]) / len(z[1])], [positive[: max(1, half)], unlabelled], 60, rng)
    #: Odds of "labelled" are the densities' ratio, which is 1 / prior where only positives are.
    return float(min(0.99, max(0.01, np.exp(-np.median(other.raw(positive[half:]))))))


def train(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray, share: tuple[int, int] | None = None, steps: int = STEPS, seed: int = 0) -> Network:
    """``negative`` rows serve the prior and the calibration only; ``share``: numbers of positive and negative labels."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([unlabelled, positive])
    scale = every.std(0) + 1e-3 if len(every) else np.ones(N_FEATURES, np.float32)
    net = Network(every.mean(0) if len(every) else np.zeros(N_FEATURES, np.float32), scale, [rng.normal(0, (2 / N_FEATURES) ** 0.5, (N_FEATURES, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)])
    if not len(positive) or not len(unlabelled):
        net.slope = 0.0
        return net
    n_pos, n_neg = share or (len(positive), len(negative))
    net.prior = p = estimate_prior(net, positive, unlabelled, n_neg, n_pos, rng)

    def risk(z: list[np.ndarray]) -> list[np.ndarray]:
        pos, unl = z
        s, u = _sigmoid(pos), _sigmoid(unl)
        #: Sigmoid loss: l(z, +1) = s(-z), l(z, -1) = s(z).
        inner = u.mean() - p * s.mean()
        d_pos, d_unl = s * (1 - s) / len(s), u * (1 - u) / len(u)
        if inner < 0:
            return [p * d_pos, -d_unl]
        return [-2 * p * d_pos, d_unl]

    _descend(net, risk, [positive, unlabelled], steps, rng)
    if len(negative):  # Platt scaling, each class weighted by its share
        z = np.concatenate([net.raw(positive), net.raw(negative)]).astype(np.float64)
        y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
        w = np.where(y > 0, n_pos / len(positive), n_neg / len(negative)) / (n_pos + n_neg)
        a, b = 1.0, 0.0
        for _ in range(50):
            q = _sigmoid(a * z + b)
            g = np.array([(w * (q - y) * z).sum() + 1e-3 * (a - 1), (w * (q - y)).sum()])
            h = w * q * (1 - q) + 1e-9
            hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
            step = np.linalg.solve(hessian + 1e-6 * np.eye(2), g)
            a, b = a - step[0], b - step[1]
        net.slope, net.offset = (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)
    else:  # the mean score of all texts is the prior
        z, low, high = net.raw(unlabelled), -30.0, 30.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if _sigmoid(z + mid).mean() < p else (low, mid)
        net.offset = low
    return net


def _featurised():
    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array(list(features(texts)), pa.list_(pa.float32()))

    return vectors


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> Network:
    """Trains on bounded samples of the rows that are not held out; features are computed where the texts are."""
    rows = docs.select("doc_id", "text")
    #: Of a document's labels the largest counts.
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    if held_out is not None:
        rows, marks = rows.filter(~held_out), marks.filter(~held_out)
    share = {bool(r[0]): r[1] for r in marks.groupBy(F.col("label") == 1).count().collect()}

    def sample(ids: DataFrame, most: int) -> np.ndarray:
        chosen = ids.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most).select("doc_id").distinct()
        got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", _featurised()("text").alias("v")).orderBy("doc_id", "v").limit(most).toPandas()["v"]
        return np.array(got.tolist(), np.float32).reshape(-1, N_FEATURES)

    return train(sample(marks.filter("label = 1"), SAMPLE_POSITIVE), sample(rows, SAMPLE_UNLABELLED), sample(marks.filter("label <> 1"), SAMPLE_NEGATIVE), (share.get(True, 0), share.get(False, 0)))


def scorer(net: Network):
    """An Arrow function of a text column: the probability of good quality."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(features(texts)), pa.float64())

    return quality


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Quality score of every whole text, learned from the labels that are not held out.

    One row for each input row; a null text is scored as an empty one.  Without
    any positive label all scores are 0.5.  Null labels and labels of unknown
    documents are left out; of a document's labels the largest counts; an empty
    table gives no rows.
    """
    held = remainder(F.col("doc_id"), 4) == 2
    net = fit(docs, labels, held)
    return docs.select("doc_id", held.alias("held_out"), scorer(net)("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
