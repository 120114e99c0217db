"""Language-model scores of whole texts.

The model is one layer of causal self-attention over public subword ids,
trained here in numpy by Adam: it begins with a bounded sample, in one task,
and goes on over every window of all training texts, by tasks whose weights are
averaged in rounds.  A text is the sequence of its words, A-Z
folded, each encoded with the space before it, and an end.  Windows of CONTEXT
ids overlap: a window scores its last STRIDE ids, so every id is scored
once, with more before it in its window; attention is masked to what came
before in the same text.  The next id's probability is that of its class times
that within its class.  Both carry a prior by the id before, from counts of
subword pairs over all training texts, which attention corrects; ids outside
the VOCABULARY most frequent share one class and are told apart by counts.

The base score is a unigram over whole words.  Its counts cover all training
texts: each bucket of texts sends its distinct words once, counts are summed by
word, and come back to the buckets that have the word.

Texts are encoded once, to a table of ids in the shared folder; all else reads that.
A word is known again by its ids, which begin with one that begins with a space.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions, remainder, written
from ._words import pieces, utf8, word_hashes, words
from .tokens import gathered, tokenizer_path

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: Subword ids of the file, and one for the end of a text (also what stands before its first).
N_IDS, END = 50257, 50256
CONTEXT, STRIDE = 16, 12
VOCABULARY, CLASSES = 992, 31
WIDTH, INNER = 16, 32
STEPS, BATCH = 1500, 128
#: After the sample, all texts: rounds of a part of the texts each, windows a step, and the first round's rate.
#: Every window of every text is a step's, once; LEARN_EVERY says so to who counts the steps.
ROUNDS, ROUND_BATCH, RATE, LEARN_EVERY = 4, 256, 0.004, 1
#: Bounds of the sample that the attention weights begin with: texts, and ids of each, from a place that its hash gives.
SAMPLE_DOCS, SAMPLE_IDS = 3000, 800
#: Most ids in a bucket of texts, but for a single longer text; and ids that one step of counting or scoring takes.
BUCKET_IDS, STEP_IDS = 12 << 20, 1 << 19
#: Parts of the shuffle in which buckets meet their words, for each bucket.
PARTS_A_BUCKET = 4
#: Slots for words whose ids a worker keeps, a power of two, and ids beyond which it begins anew.
CACHE_SLOTS, CACHE_IDS = 1 << 19, 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
_encoders: dict[str, SubwordEncoder] = {}


class SubwordEncoder:
    """Ids of whole texts, A-Z folded; words are looked up by hash, all of a batch at once, and only those not kept are encoded."""

    def __init__(self, name: str, slots: int = CACHE_SLOTS, most: int = CACHE_IDS):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Ids that begin a word.
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.shift, self.most = np.uint64(64 - slots.bit_length() + 1), most
        #: A slot for each value of a hash's first bits: the hash, and where its ids lie; an empty slot has a hash of another's.
        self.none = (np.arange(slots, dtype=np.uint64) ^ np.uint64(1)) << self.shift
        self.hashes, self.begin, self.size = self.none.copy(), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) for consecutive row ranges: flat uint16 ids, and ids of each row."""
        for a, b in pieces(column):
            data, offsets = utf8(column.slice(a, b - a))
            start, end, first = words(data, offsets)
            if self.used > self.most:
                self.hashes[:], self.pool, self.used = self.none, np.zeros(1 << 16, np.uint16), 0
            hashes = word_hashes(data, start, end)
            slot = (hashes >> self.shift).astype(np.int64)
            begin, size = self.begin[slot], self.size[slot]
            new = np.flatnonzero(self.hashes[slot] != hashes)
            if len(new):
                unique, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
                where = new[where]
                flat, sizes = self.encode_words(data, start[where], end[where])
                if self.used + len(flat) > len(self.pool):
                    self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(flat), np.uint16)])
                begins = self.used + np.cumsum(sizes) - sizes
                self.pool[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
                begin[new], size[new] = begins[inverse], sizes[inverse]
                #: One of two new words of one slot: the same one's hash and place.
                slot, one = np.unique(slot[where], return_index=True)
                self.hashes[slot], self.begin[slot], self.size[slot] = unique[one], begins[one], sizes[one]
            total = np.cumsum(size, dtype=np.int64)
            ids = self.pool[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - size), size)]
            yield ids, np.diff(np.concatenate([[0], total])[first])

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of the words at these spans in a row, and how many each has: all in one text, but those with
        white space beyond ASCII, which the tokenizer's pattern could join with the next word's space."""
        found, begin = gathered(_FOLD[data], start, end)
        alone = np.logical_or.reduceat(_white(found), begin)
        rest = np.flatnonzero(~alone)
        text, at = gathered(found, begin[rest], begin[rest] + (end - start)[rest])
        flat = np.array(self.encode(np.insert(text, at, 32).tobytes().decode("utf-8", "replace")), np.uint16)
        cuts = np.append(np.flatnonzero(self.begins[flat]), len(flat))
        fits = len(cuts) == len(rest) + 1
        if fits and len(rest) == len(start):
            return flat, np.diff(cuts)
        raw, out = found.tobytes(), [np.zeros(0, np.uint16)] * len(start)
        if fits:
            for i, a, b in zip(rest.tolist(), cuts.tolist(), cuts[1:].tolist()):
                out[i] = flat[a:b]
        for i in (np.flatnonzero(alone) if fits else range(len(start))):
            out[i] = np.array(self.encode(" " + raw[begin[i] : begin[i] + end[i] - start[i]].decode("utf-8", "replace")), np.uint16)
        return np.concatenate(out), np.array([len(x) for x in out])


def _white(found: np.ndarray) -> np.ndarray:
    """Where white space beyond the ASCII one that parts words begins, in UTF-8; and a few other characters."""
    second, third = np.append(found[1:], np.uint8(0)), np.append(found[2:], np.zeros(min(2, len(found)), np.uint8))
    general = (found == 0xE2) & ((second == 0x80) & ((third <= 0x8A) | (third >= 0xA8) & (third <= 0xAF)) | (second == 0x81) & (third == 0x9F))
    return (found >= 0x1C) & (found <= 0x1F) | (found == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (found == 0xE1) & (second == 0x9A) | general | (found == 0xE3) & (second == 0x80) & (third == 0x80)


def encoder(name: str = TOKENIZER_FILE) -> SubwordEncoder:
    if name not in _encoders:
        _encoders[name] = SubwordEncoder(name)
    return _encoders[name]


@dataclass
class Attention:
    #: Place of each subword id among the model's ids; VOCABULARY for a rare one.
    place: np.ndarray
    #: Class of each of the model's ids, first id of each class; the last class holds the rare ids alone.
    of_class: np.ndarray
    firsts: np.ndarray
    #: log10 probability of each subword id among the rare ones.
    rare: np.ndarray
    #: Natural log priors by the id before: of each class, and, for each class, of its ids within it.
    class_prior: np.ndarray
    id_prior: list[np.ndarray]
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def lay_out(counts: np.ndarray, vocabulary: int = VOCABULARY, classes: int = CLASSES, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Attention:
    """The model's ids and classes from subword counts; classes are of like size in ids, by frequency.

    ``pairs``: (first, second, count) of neighbouring ids.  What follows an id is
    as likely as its counts say, with as much weight on the single ids' counts
    as it has different followers (Witten and Bell, 1991).
    """
    order = np.argsort(-counts, kind="stable")
    common = order[:vocabulary]
    place = np.full(N_IDS, vocabulary, np.int64)
    place[common] = np.arange(vocabulary)
    #: Frequent ids are spread over all classes, so that classes have like mass.
    within = np.arange(vocabulary) % classes
    sort = np.argsort(within, kind="stable")
    place[common[sort]] = np.arange(vocabulary)
    of_class = np.append(within[sort], classes)
    firsts = np.searchsorted(of_class, np.arange(classes + 2))
    smoothed = np.where(place == vocabulary, counts + 0.5, 0)
    own = np.zeros(vocabulary + 1)
    np.add.at(own, place, counts + 0.5)
    own /= own.sum()
    followed = np.zeros((vocabulary + 1, vocabulary + 1))
    if pairs is not None:
        np.add.at(followed, (place[pairs[0]], place[pairs[1]]), pairs[2])
    kinds = np.maximum((followed > 0).sum(1, keepdims=True), 1)
    likely = (followed + kinds * own) / (followed.sum(1, keepdims=True) + kinds)
    by_class = np.add.reduceat(likely, firsts[:-1], 1)
    rare = np.log10(smoothed / smoothed.sum(), where=smoothed > 0, out=np.zeros(N_IDS))
    within_class = np.log(likely / by_class[:, of_class]).astype(np.float32)
    blocks = [np.ascontiguousarray(within_class[:, a:b]) for a, b in zip(firsts[:-2], firsts[1:-1])]
    model = Attention(place, of_class, firsts, rare, np.log(by_class).astype(np.float32), blocks)
    f32, rng = np.float32, np.random.default_rng(5)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(f32)
    model.weights = {
        "embedding": rng.normal(0, 0.3, (vocabulary + 2, WIDTH)).astype(f32), "position": rng.normal(0, 0.1, (CONTEXT, WIDTH)).astype(f32),
        "query": normal(WIDTH, WIDTH), "key": normal(WIDTH, WIDTH), "value": normal(WIDTH, WIDTH), "merge": normal(WIDTH, WIDTH), "wide": normal(2 * WIDTH, INNER), "wide_bias": np.zeros(INNER, f32), "narrow": normal(INNER, WIDTH),
        "to_class": (0.1 * normal(WIDTH, classes + 1)).astype(f32), "class_bias": np.zeros(classes + 1, f32), "to_id": (0.1 * rng.normal(0, 1, (vocabulary + 1, WIDTH))).astype(f32), "id_bias": np.zeros(vocabulary + 1, f32),
    }
    return model


def windows_of(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, document): each window's CONTEXT input places and STRIDE targets, as indices
    into ``ids``; -1 is the end before a text, -2 nothing, and for targets -1 is the end and -2 nothing."""
    n = counts + 1
    per = -(-n // STRIDE)
    docs = np.repeat(np.arange(len(n)), per)
    first = ((np.arange(len(docs)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE).astype(np.int32)
    base, size = (x.astype(np.int32)[docs][:, None] for x in (np.cumsum(counts) - counts, counts))
    at = first[:, None] - (CONTEXT - STRIDE) + np.arange(CONTEXT, dtype=np.int32)
    inputs = np.where((at < 0) | (at > size), -2, np.where(at == 0, -1, base + at - 1))
    at = at[:, CONTEXT - STRIDE :]
    targets = np.where(at > size, -2, np.where(at == size, -1, base + at))
    return inputs, targets, docs


#: Which of a window's places a predicting place may look at: itself and all before it.
_OPEN = np.tril(np.ones((STRIDE, CONTEXT), np.float32), CONTEXT - STRIDE)
#: Logits are kept below this, so that no exponential overflows.
_MOST = np.float32(70)


def _forward(w: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states, (windows, STRIDE, WIDTH), of the places that predict; the last of the model's ids is "nothing".

    Values are merged before they are attended to, which is the same and saves a product a place.
    """
    x = np.take(w["embedding"], inputs, 0, mode="clip")
    x += w["position"]
    late = x[:, CONTEXT - STRIDE :].reshape(-1, WIDTH)
    q = (late @ (w["query"] * np.float32(WIDTH**-0.5))).reshape(-1, STRIDE, WIDTH)
    kv = (x.reshape(-1, WIDTH) @ np.concatenate([w["key"], w["value"] @ w["merge"]], 1)).reshape(*x.shape[:2], -1)
    a = _attend(q, kv[:, :, :WIDTH], inputs, len(w["embedding"]) - 1)
    flat = a.reshape(-1, CONTEXT)
    flat *= (1 / (flat @ np.ones(CONTEXT, a.dtype) + np.float32(1e-20)))[:, None]
    seen = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
    y = late + seen
    hidden = y @ w["wide"][:WIDTH]
    hidden += late @ w["wide"][WIDTH:]
    #: Added a window at a time: longer runs than a place's.
    hidden.reshape(len(x), -1)[:] += np.tile(w["wide_bias"], STRIDE)
    kept = hidden > 0
    hidden *= kept
    h = hidden @ w["narrow"]
    h += y
    return h.reshape(-1, STRIDE, WIDTH), (x, late, q, kv, a, seen, y, hidden, kept)


def _attend(q: np.ndarray, k: np.ndarray, inputs: np.ndarray, nothing: int, safe: bool = False) -> np.ndarray:
    """Weights, not yet divided by their sums: 0 for what comes after a place, and for nothing.  ``safe``: no product overflows."""
    a = q @ k.transpose(0, 2, 1)
    if not safe and a.max(initial=0) > _MOST:
        np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    a *= _OPEN
    gone = inputs == nothing
    part = gone.any(1)
    if part.any():
        a[part] *= ~gone[part][:, None]
    return a


class Folded:
    """The model for scoring: what weights make of an id and of a place is looked up, not computed again."""

    def __init__(self, model: Attention):
        w, one = model.weights, np.eye(WIDTH, dtype=np.float32)
        late = np.concatenate([one, w["query"] * np.float32(WIDTH**-0.5), w["wide"][:WIDTH] + w["wide"][WIDTH:]], 1)
        #: A one after each value sums the attention.
        early = np.concatenate([w["key"], w["value"] @ w["merge"], np.zeros((WIDTH, 1), np.float32)], 1)
        self.early, self.early_place = w["embedding"] @ early, w["position"] @ early
        self.early_place[:, -1] = 1
        self.late, self.late_place = w["embedding"] @ late, w["position"][CONTEXT - STRIDE :] @ late
        self.late_place[:, 2 * WIDTH :] += w["wide_bias"]
        self.wide, self.back = w["wide"][:WIDTH], np.concatenate([one, w["narrow"]])
        largest = lambda m: np.sqrt((m * m).sum(1)).max()
        q, k = slice(WIDTH, 2 * WIDTH), slice(0, WIDTH)
        self.safe = (largest(self.late[:, q]) + largest(self.late_place[:, q])) * (largest(self.early[:, k]) + largest(self.early_place[:, k])) < _MOST
        self.of_class, self.firsts, self.to_class = model.of_class, model.firsts, w["to_class"]
        self.class_prior = np.exp(model.class_prior + w["class_bias"])
        spans = list(zip(model.firsts[:-2], model.firsts[1:-1]))
        self.id_prior = [np.exp(p + w["id_bias"][a:b]) for p, (a, b) in zip(model.id_prior, spans)]
        self.to_id = [np.ascontiguousarray(w["to_id"][a:b].T) for a, b in spans]
        self.steepest = max(map(largest, [self.to_class.T, *(x.T for x in self.to_id)]))

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        """Hidden states as those of ``_forward``."""
        kv = np.take(self.early, inputs, 0, mode="clip")
        kv += self.early_place
        own = np.take(self.late, inputs[:, CONTEXT - STRIDE :], 0, mode="clip")
        own += self.late_place
        a = _attend(own[:, :, WIDTH : 2 * WIDTH], kv[:, :, :WIDTH], inputs, len(self.early) - 1, self.safe)
        f = np.empty((len(inputs), STRIDE, WIDTH + INNER), np.float32)
        seen = a @ kv[:, :, WIDTH:]
        np.multiply(seen[:, :, :WIDTH], 1 / (seen[:, :, WIDTH:] + np.float32(1e-20)), out=f[:, :, :WIDTH])
        f = f.reshape(-1, WIDTH + INNER)
        deep = f[:, :WIDTH] @ self.wide
        deep += own[:, :, 2 * WIDTH :].reshape(-1, INNER)
        np.multiply(deep, deep > 0, out=f[:, WIDTH:])
        h = f @ self.back
        h += own[:, :, :WIDTH].reshape(-1, WIDTH)
        return h

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log probabilities of targets after the ids ``before``: priors times exponentials over their sums."""
        steep = np.sqrt(((h * h) @ np.ones(WIDTH, h.dtype)).max(initial=0)) * self.steepest
        classes = np.take(self.of_class, targets)
        order = np.argsort(classes.astype(np.int16), kind="stable")
        h, targets, classes, before = (np.take(x, order, 0, mode="clip") for x in (h, targets, classes, before))
        cuts = np.searchsorted(classes, np.arange(len(self.firsts)))
        logs = np.empty(len(h), np.float32)

        def chosen(h: np.ndarray, weights: np.ndarray, prior: np.ndarray, before: np.ndarray, which: np.ndarray) -> np.ndarray:
            e = h @ weights
            if steep > 60:
                np.clip(e, -60, 60, out=e)
            np.exp(e, out=e)
            e *= np.take(prior, before, 0, mode="clip")
            return np.log(np.take(e.ravel(), np.arange(0, e.size, e.shape[1]) + which) / (e @ np.ones(e.shape[1], np.float32)))

        for a in range(0, len(h), 2048):
            part = slice(a, a + 2048)
            logs[part] = chosen(h[part], self.to_class, self.class_prior, before[part], classes[part])
        for c in range(len(self.firsts) - 2):
            mine = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                logs[mine] += chosen(h[mine], self.to_id[c], self.id_prior[c], before[mine], targets[mine] - self.firsts[c])
        out = np.empty_like(logs)
        out[order] = logs
        return out


class Blocks:
    """The classes' ids and priors side by side, each class as wide as the widest; what pads one has a prior of nothing."""

    def __init__(self, model: Attention):
        firsts, width = model.firsts[:-1], int(np.diff(model.firsts[:-1]).max())
        slots = firsts[:-1, None] + np.arange(width)
        self.held, self.slots = slots < firsts[1:, None], np.minimum(slots, firsts[-1] - 1)
        #: Classes of one size lie in the weights as they do here.
        self.even, self.most = bool(self.held.all()), int(firsts[-1])
        self.prior = np.full((len(slots), len(model.class_prior), width), -np.inf, model.class_prior.dtype)
        for block, p in zip(self.prior, model.id_prior):
            block[:, : p.shape[1]] = p
        self.prior = self.prior.reshape(-1, width)

    def of(self, weights: np.ndarray) -> np.ndarray:
        """Weights of ids, by class and place within it."""
        return weights[: self.most].reshape(*self.slots.shape, *weights.shape[1:]) if self.even else weights[self.slots]

    def add(self, weights: np.ndarray, by_class: np.ndarray) -> None:
        """Adds to weights of ids what is given by class and place within it."""
        if self.even:
            weights[: self.most] += by_class.reshape(self.most, *weights.shape[1:])
        else:
            weights[self.slots[self.held]] += by_class[self.held]


def _softmax(e: np.ndarray, which: np.ndarray, slope: np.float32 | None) -> np.ndarray:
    """Natural log probabilities of the places ``which`` of each row; with ``slope``, the rows become the loss's gradients by them, times that."""
    if e.max(initial=0) > _MOST:
        np.minimum(e, _MOST, out=e)
    at = np.arange(0, e.size, e.shape[1]) + which
    logs = np.take(e.ravel(), at)
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    logs -= np.log(total)
    if slope is not None:
        e *= (slope / total)[:, None]
        e.ravel()[at] -= slope
    return logs


def _log_probabilities(model: Attention, h: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None, before: np.ndarray | None = None, blocks: Blocks | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of targets after the ids ``before`` (rare ones, if not given), by the ``rows``
    of ``h`` (all, if not given); with ``grads``, adds the mean loss's gradients and returns that by h."""
    w, blocks = model.weights, blocks or Blocks(model)
    before = np.full(len(targets), len(model.of_class) - 1) if before is None else before
    classes = np.take(model.of_class, targets)
    order = np.argsort(classes.astype(np.int16), kind="stable")
    rows = order if rows is None else np.take(rows, order)
    s = np.take(h, rows, 0, mode="clip")
    targets, classes, before = np.take(targets, order), np.take(classes, order), np.take(before, order)
    cuts = np.searchsorted(classes, np.arange(len(model.firsts))).tolist()
    slope = None if grads is None else h.dtype.type(1 / max(1, len(s)))
    e = s @ w["to_class"]
    e += np.take(model.class_prior + w["class_bias"], before, 0, mode="clip")
    logs = _softmax(e, classes, slope)
    dh = None
    if grads is not None:
        grads["to_class"] += s.T @ e
        grads["class_bias"] += np.ones(len(e), e.dtype) @ e
        dh = e @ w["to_class"].T
    #: Those of a class of several ids, class by class.
    n = cuts[len(blocks.slots)]
    to_id = blocks.of(w["to_id"])
    mine = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1 : len(blocks.slots) + 1])) if a < b]
    e = np.empty((n, to_id.shape[1]), np.result_type(h, to_id))
    for c, part in mine:
        np.matmul(s[part], to_id[c].T, out=e[part])
    e += np.repeat(blocks.of(w["id_bias"]), np.diff(cuts[: len(blocks.slots) + 1]), 0)
    e += np.take(blocks.prior, classes[:n] * len(model.class_prior) + before[:n], 0, mode="clip")
    logs[:n] += _softmax(e, targets[:n] - np.take(model.firsts, classes[:n]), slope)
    if grads is not None:
        by_id, by_bias, back = np.zeros_like(to_id), np.zeros(to_id.shape[:2], e.dtype), np.empty((n, h.shape[1]), e.dtype)
        ones = np.ones(n, e.dtype)
        for c, part in mine:
            some = e[part]
            np.matmul(some.T, s[part], out=by_id[c])
            np.matmul(some, to_id[c], out=back[part])
            np.matmul(ones[part], some, out=by_bias[c])
        blocks.add(grads["to_id"], by_id)
        blocks.add(grads["id_bias"], by_bias)
        dh[:n] += back
        back = np.zeros_like(h)
        back[rows] = dh
        dh = back
    out = np.empty_like(logs)
    out[order] = logs
    return out, dh


def _gradients(model: Attention, inputs: np.ndarray, targets: np.ndarray, wanted: np.ndarray, blocks: Blocks | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradients by all weights."""
    w, half = model.weights, np.float32(WIDTH**-0.5)
    g = {k: np.zeros_like(w[k]) for k in ("to_class", "class_bias", "to_id", "id_bias")}
    h, (x, late, q, kv, a, seen, y, hidden, kept) = _forward(w, inputs)
    flat = lambda m: m.reshape(-1, m.shape[-1])
    some = np.flatnonzero(wanted)
    logs, dh = _log_probabilities(model, flat(h), np.take(targets.ravel(), some), g, np.take(inputs[:, CONTEXT - STRIDE :].ravel(), some), blocks, some)
    g["narrow"] = hidden.T @ dh
    dz = dh @ w["narrow"].T
    dz *= kept
    g["wide"], g["wide_bias"] = np.concatenate([y.T @ dz, late.T @ dz]), np.ones(len(dz), dz.dtype) @ dz
    dy = dz @ w["wide"][:WIDTH].T
    dy += dh
    d_late = dz @ w["wide"][WIDTH:].T
    d_late += dy
    d_seen = dy.reshape(q.shape)
    ds = d_seen @ kv[:, :, WIDTH:].transpose(0, 2, 1)
    #: What the weights' sum takes away: their products' sum is that of the outputs.
    seen *= dy
    flat(ds)[:] -= (seen @ np.ones(WIDTH, seen.dtype))[:, None]
    ds *= a
    dq, dkv = flat(ds @ kv[:, :, :WIDTH]), np.empty_like(kv)
    #: The queries have their factor already.
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d_seen, out=dkv[:, :, WIDTH:])
    by_kv = flat(x).T @ flat(dkv)
    g["query"], g["key"] = (late.T @ dq) * half, by_kv[:, :WIDTH]
    g["value"], g["merge"] = by_kv[:, WIDTH:] @ w["merge"].T, w["value"].T @ by_kv[:, WIDTH:]
    dx = (flat(dkv) @ np.concatenate([w["key"], w["value"] @ w["merge"]], 1).T).reshape(x.shape)
    d_late += dq @ (w["query"] * half).T
    dx[:, CONTEXT - STRIDE :] += d_late.reshape(q.shape)
    g["position"] = (np.ones(len(dx), dx.dtype) @ dx.reshape(len(dx), -1)).reshape(w["position"].shape)
    at = np.take(np.arange(w["embedding"].size).reshape(-1, WIDTH), inputs.ravel(), 0, mode="clip")
    g["embedding"] = np.bincount(at.ravel(), dx.ravel(), w["embedding"].size).astype(dx.dtype).reshape(w["embedding"].shape)
    return -float(logs.mean()), g


def _look_up(model: Attention, ids: np.ndarray) -> np.ndarray:
    """The texts' ids as the model's, then "nothing" and the end: what indices of -2 and -1 find."""
    return np.append(model.place[ids], [len(model.of_class), model.place[END]]).astype(np.int32)


def train(model: Attention, ids: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 0) -> Attention:
    """Adam on windows drawn at random from the sampled texts."""
    if not len(counts):
        return model
    rng = np.random.default_rng(seed)
    inputs, targets, _ = windows_of(ids, counts)
    own, adam, blocks = _look_up(model, ids), Adam(model), Blocks(model)
    for t in range(1, steps + 1):
        pick = rng.integers(len(inputs), size=BATCH)
        which = targets[pick]
        _, g = _gradients(model, own[inputs[pick]], own[which], which != -2, blocks)
        adam.step(g, 0.01 * min(1.0, t / 50) * (1 - t / (steps + 1)) + 1e-4)
    return model


class Adam:
    """Steps of a model's weights, which become views of one array of its own."""

    def __init__(self, model: Attention):
        self.names, shapes = list(model.weights), [x.shape for x in model.weights.values()]
        self.all = np.concatenate([x.ravel() for x in model.weights.values()])
        cuts = np.cumsum([x.size for x in model.weights.values()])[:-1]
        model.weights = {k: x.reshape(shape) for k, x, shape in zip(self.names, np.split(self.all, cuts), shapes)}
        self.m, self.v, self.t = np.zeros_like(self.all), np.zeros_like(self.all), 0

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        g = np.concatenate([grads[k].ravel() for k in self.names])
        self.m *= 0.9
        self.m += np.float32(0.1) * g
        self.v *= 0.99
        g *= g
        g *= 0.01
        self.v += g
        np.sqrt(self.v, out=g)
        g *= (1 - 0.99**self.t) ** -0.5
        g += 1e-8
        np.divide(self.m, g, out=g)
        g *= rate / (1 - 0.9**self.t)
        self.all -= g


def refine(model: Attention, texts: Iterator[tuple[np.ndarray, np.ndarray]], most: float) -> int:
    """Adam over the texts, (ids, counts) by part: all their windows, once each; the number of these."""
    adam, blocks = Adam(model), Blocks(model)
    rng, seen = np.random.default_rng(1), 0
    for ids, counts in texts:
        inputs, targets, _ = windows_of(ids, counts)
        own, order = _look_up(model, ids), rng.permutation(len(inputs))
        inputs, wanted, targets = np.take(own, inputs), targets != -2, np.take(own, targets)
        for a in range(0, len(order), ROUND_BATCH):
            pick = order[a : a + ROUND_BATCH]
            _, g = _gradients(model, *(np.take(x, pick, 0) for x in (inputs, targets, wanted)), blocks)
            adam.step(g, most * min(1.0, (adam.t + 1) / 50))
        seen += len(order)
    return seen


def refined(model: Attention, encoded: DataFrame, rounds: int = ROUNDS) -> Attention:
    """The weights after all texts: in each round every task learns from its share of a part of the texts,
    and the mean by windows is where the next round begins; a text is in one round."""
    names, shapes = list(model.weights), {k: x.shape for k, x in model.weights.items()}
    ends = np.cumsum([x.size for x in model.weights.values()])
    few = math.ceil(partitions(encoded.sparkSession) ** 0.5)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["part"], r["n"], r["value"]) for batch in batches for r in batch.to_pylist())
        if rows:
            total = sum(np.frombuffer(value) for _, _, value in rows)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([sum(n for _, n, _ in rows)]), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "value"])

    for i in range(rounds):
        mine = encoded.filter(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(rounds)) == i).select("ids")
        most = RATE * (1 - i / rounds)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = refine(model, (x for batch in batches for x in steps_of(batch.column("ids"))), most)  # noqa: B023
            if n:
                flat = n * np.concatenate([x.ravel() for x in model.weights.values()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], names=["part", "n", "value"])

        got = sorted(mine.mapInArrow(learn, SUMS).repartition(few, "part").mapInArrow(summed, SUMS).collect(), key=lambda r: r["part"])
        if got:
            mean = sum(np.frombuffer(bytes(r["value"])) for r in got) / sum(r["n"] for r in got)
            model.weights = {k: x.reshape(shapes[k]).astype(np.float32) for k, x in zip(names, np.split(mean, ends[:-1]))}
    return model


def log10_probabilities(model: Attention, ids: np.ndarray, counts: np.ndarray, folded: Folded | None = None, at_once: int = 128, together: int = 32) -> np.ndarray:
    """log10 probability of each text: all its ids and its end.  Hidden states come from ``at_once`` windows
    at a time, so that they stay in a core's cache, and probabilities from ``together`` times as many."""
    inputs, targets, docs = windows_of(ids, counts)
    out, own = np.zeros(len(counts)), _look_up(model, ids)
    rare, folded = np.append(model.rare[ids], [0.0, model.rare[END]]), folded or Folded(model)
    for a in range(0, len(docs), at_once * together):
        rows = slice(a, a + at_once * together)
        wanted = targets[rows] != -2
        which = targets[rows][wanted]
        seen = own[inputs[rows]]
        h = np.concatenate([folded.hidden(seen[x : x + at_once]) for x in range(0, len(seen), at_once)])
        logs = folded.log_probabilities(h if wanted.all() else h[wanted.ravel()], own[which], seen[:, CONTEXT - STRIDE :][wanted])
        out += np.bincount(np.repeat(docs[rows], wanted.sum(1)), logs * (1 / np.log(10)) + rare[which], len(counts))
    return out


ENCODED = "doc_id long, held_out boolean, learn boolean, bucket long, ids binary"


def encoded(rows: DataFrame, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, held_out, learn, bucket, ids) of (doc_id, text, held_out, learn), written to the shared folder.

    A bucket is a part of one task's texts, of about BUCKET_IDS ids at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, size = encoder(tokenizer), TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            row = 0
            for ids, counts in encode(batch.column("text")):
                if size and size + len(ids) > BUCKET_IDS:
                    bucket, size = bucket + 1, 0
                size += len(ids)
                n = len(counts)
                offsets = np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in ("doc_id", "held_out", "learn")), pa.array(np.full(n, bucket)), raw], names=["doc_id", "held_out", "learn", "bucket", "ids"])
                row += n

    return written(rows.select("doc_id", "text", "held_out", "learn").mapInArrow(run, ENCODED), "ids")


def steps_of(column: pa.Array, most: int = STEP_IDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, counts) for consecutive row ranges of about ``most`` ids; a longer text is a range of its own."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from steps_of(chunk, most)
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2 if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, "<u2", int(offsets[-1])) if data is not None else np.zeros(0, np.uint16)
    row = 0
    while row < len(column):
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1), len(column))
        yield flat[offsets[row] : offsets[end]], np.diff(offsets[row : end + 1])
        row = end


def word_ids(ids: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text): a 64-bit hash of each word's ids, and the text that has it."""
    start = np.flatnonzero(begins[ids])
    return word_hashes(ids, start, np.append(start[1:], len(ids)), _VALUE) if len(start) else np.zeros(0, np.uint64), np.repeat(np.arange(len(counts)), np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(counts)]))))


class WordIndex:
    """Places of words among some distinct ones, by hash: a look at where hashes of the same first bits begin, then a step or two."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        bits = max(1, min(24, len(hashes).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, all of which must be among the words."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.sorted[at] != hashes)
        while len(left):
            at[left] += 1
            left = left[self.sorted[at[left]] != hashes[left]]
        return self.order[at]


def subword_counts(encoded: DataFrame) -> np.ndarray:
    """Counts of all N_IDS ids over every text; an end a text is counted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_IDS, np.int64)
        for batch in batches:
            total[END] += len(batch)
            for ids, _ in steps_of(batch.column("ids")):
                total += np.bincount(ids, minlength=N_IDS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counts = np.zeros(N_IDS)
    for r in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def subword_pairs(encoded: DataFrame, counts: np.ndarray, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of neighbouring ids over every text, an end before and after each; all ids outside
    the ``vocabulary`` most frequent are as the most frequent of them, so at most (vocabulary + 1) ** 2 pairs."""
    order = np.argsort(-counts, kind="stable")
    place, wide = np.full(N_IDS, vocabulary), vocabulary + 1
    place[order[:vocabulary]] = np.arange(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for ids, n in steps_of(batch.column("ids")):
                second = np.insert(place[ids], np.cumsum(n), place[END])
                first = np.concatenate([[place[END]], second[:-1]])
                total += np.bincount(first * wide + second, minlength=len(total))
        some = np.flatnonzero(total)
        for a in range(0, len(some), 100_000):
            part = some[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    got = encoded.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pair = got["pair"].to_numpy(np.int64)
    return order[pair // wide], order[pair % wide], got["n"].to_numpy(np.int64)


def fit(learned: DataFrame) -> Attention:
    """From encoded texts: counts from all; attention weights begin with a bounded sample of them, in one task, and go on over all."""
    counts = subword_counts(learned)
    model = lay_out(counts, pairs=subword_pairs(learned, counts))
    n = (F.length("ids") / 2).cast("int")
    part = F.expr(f"substring(ids, cast(1 + 2 * pmod(xxhash64(ids), greatest(length(ids) div 2 - {SAMPLE_IDS}, 1)) as int), {2 * SAMPLE_IDS})")
    chosen = learned.filter(n > 0).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    texts = learned.join(F.broadcast(chosen), "doc_id").select("doc_id", part.alias("part")).orderBy("doc_id", "part").limit(SAMPLE_DOCS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for batch in batches for x in steps_of(batch.column("part"))]
        if got:
            train(model, np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got]))
            yield pa.RecordBatch.from_arrays([pa.array(list(model.weights)), pa.array([w.tobytes() for w in model.weights.values()], pa.binary())], names=["name", "value"])

    for r in texts.coalesce(1).mapInArrow(learn, "name string, value binary").collect():
        model.weights[r["name"]] = np.frombuffer(bytes(r["value"]), np.float32).reshape(model.weights[r["name"]].shape)
    return refined(model, learned)


SUMS = "part int, n long, value binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double"


def scores(docs: DataFrame, learn: Column | None = None, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """Base and model scores of every whole text.

    ``learn`` says which rows are learned from (all but those held out by
    crc32, if not given).  A null text is an empty one, of the end alone;
    repeated rows are scored each and counted each; a null doc_id counts as not
    held out; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), *([] if learn is None else [learn.alias("learn")]))
    table = encoded(rows if learn is not None else rows.withColumn("learn", ~F.col("held_out")), tokenizer)
    learned = table.filter("learn")
    model, begins = fit(learned), encoder(tokenizer).begins

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

        for batch in batches:
            bucket, learned, row = batch.column("bucket").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False), 0
            for ids, counts in steps_of(batch.column("ids")):
                hashes, text = word_ids(ids, counts, begins)
                own, counted = bucket[row:][text], learned[row:][text]
                row += len(counts)
                for k in np.unique(own).tolist():
                    mine = own == k
                    parts = held.setdefault(k, [])
                    parts.append(merged([(hashes[mine], counted[mine].astype(np.int64))]))
                    if len(parts) >= 8:
                        held[k] = [merged(parts)]
        for k, parts in held.items():
            keys, counts = merged(parts)
            for a in range(0, len(keys), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), k)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["bucket", "word", "n"])

    #: A word's rows are as many as buckets have it.  Written once, as the sums and the scores both read it.
    same = Window.partitionBy("word")
    local = table.select("bucket", "learn", "ids").mapInArrow(distinct_words, "bucket long, word long, n long")
    located = written(local.withColumns({"total": F.sum("n").over(same), "first": F.min("bucket").over(same) == F.col("bucket")}), "words")
    ends = learned.agg(F.count("*").alias("ends"))
    totals = located.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count_if(F.col("first") & (F.col("total") > 0)).alias("distinct")).withColumn("one", F.lit(1)).join(ends.withColumn("one", F.lit(1)), "one")

    def score(key: tuple, texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(SCORES.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        known, total = WordIndex(vocabulary.column("word").to_numpy().view(np.uint64)), vocabulary.column("total").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        folded = Folded(model)
        for ids, counts in steps_of(texts.column("ids")):
            hashes, text = word_ids(ids, counts, begins)
            c = total[known(hashes)]
            n_words = np.bincount(text, minlength=len(counts))
            out.append((n_words + 1, np.bincount(text[c > 0], minlength=len(counts)), np.bincount(text, np.log10(c + 0.5), len(counts)).astype(float), log10_probabilities(model, ids, counts, folded)))
        n_tokens, n_known, logs, value = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "known_log": logs, "score": value})

    #: So many parts that few hold two buckets, whatever the session's number: a task stays as large as a bucket.
    n = max(partitions(docs.sparkSession), PARTS_A_BUCKET * table.select("bucket").distinct().count())
    texts, vocabulary = (df.repartition(n, "bucket").groupBy("bucket") for df in (table.select("bucket", "doc_id", "held_out", "ids"), located.select("bucket", "word", "total")))
    scored = texts.cogroup(vocabulary).applyInArrow(score, SCORES)
    #: The end is a token of its own: as often as texts are learned from, known if any is.
    size = F.col("words") + F.col("ends") + 0.5 * (F.col("distinct") + F.when(F.col("ends") > 0, 1).otherwise(0) + 1)
    return scored.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.when(F.col("ends") > 0, 1).otherwise(0)).alias("n_known"), (F.col("words") + F.col("ends")).alias("train_tokens"),
        (F.col("known_log") + F.log10(F.col("ends") + 0.5) - F.col("n_tokens") * F.log10(size)).alias("base_score"), "score",
    )
