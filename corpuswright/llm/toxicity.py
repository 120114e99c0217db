"""Toxicity by a subsequence string-kernel support vector machine.

Two segments (words; runs of single letters joined) are alike in the measure
of the letter subsequences they share, each weighted by decay to the span that
it covers (Lodhi et al., 2002), gaps included: characters put into an insult,
or left out, stretch its subsequences but keep them.  A machine with squared
hinge loss is trained, in one task, on the Nystroem map of a segment's likenesses to a few
hundred landmarks.  Labels are known for documents, not for sentences: the
sentences of clean documents are all clean, and of a toxic one those segments
stand for its sentences that the machine scores near the document's highest,
found anew after each round; a document's score is its highest sentence's.

The machine is linear in the kernel's features.  So after training the
landmarks' coefficients collapse into one weight a subsequence, and a segment
costs one pass over its own subsequences, whatever the number of landmarks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._spark import lean, remainder, slim
from ._words import pieces, utf8, word_hashes, words

THRESHOLD = 0.3
#: Letters of a subsequence, longest span of one, weight of each further place it spans.
ORDER, SPAN, DECAY = 4, 7, 0.6
#: Subsequences are hashed to this many buckets.
BUCKETS = 1 << 20
#: Longer segments are learned and scored in overlapping pieces of this many letters.
LONGEST = 24
#: Bounds of the training sample, in labelled documents; the least hashes of the ids are taken, with their whole texts.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 160, 96
ROUNDS = 3
#: Segment scores that a worker keeps between batches; beyond it the older half is dropped.
CACHE_SEGMENTS = 150_000

_STEPS = np.array(list(itertools.combinations(range(1, SPAN), ORDER - 1)))
_WEIGHTS = (DECAY ** (_STEPS[:, -1] + 1 - ORDER)).astype(np.float32)
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 32, ORDER, dtype=np.uint32) | np.uint32(1)
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|[\x0A\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def segment(word: str) -> str:
    """Letters of a word, lower case; what stands between them goes."""
    return "".join(_LETTERS.findall(word.lower()))


def spelled(found: list[str]) -> list[str]:
    """What a text's segments spell: each run of three or more single letters, joined.  Words without a letter do not part a run."""
    runs = (list(run) for single, run in itertools.groupby(filter(None, found), lambda s: len(s) == 1) if single)
    return ["".join(run) for run in runs if len(run) > 2]


def sentences(text: str) -> list[set[str]]:
    """A text's sentences as sets of segments; what is spelled in single letters is one more."""
    found = [[segment(w) for w in _SPACE.split(x)] for x in _SENTENCE.split(text)]
    return [{s for s in x if s} for x in found] + [set(spelled([s for x in found for s in x]))]


def parts_of(s: str) -> list[str]:
    """A long segment's overlapping pieces."""
    return [s[a : a + LONGEST] for a in range(0, max(1, len(s) - LONGEST // 2), LONGEST // 2)] if len(s) > LONGEST else [s]


def subsequences(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight, length): buckets are (segments, n), BUCKETS where there is no subsequence;
    weights are (n,); lengths, one a segment, normalise by the squared weights of all its places.

    A mark stands before and after each segment.
    """
    most = max(max(map(len, found), default=0) + 2, ORDER)
    codes = np.zeros((len(found), most + SPAN), np.uint32)
    codes[:, :most] = np.array([f"\x01{s}\x02" for s in found], dtype=f"<U{most}").view(np.uint32).reshape(len(found), most)
    places = most - ORDER + 1
    key = np.zeros((len(found), places, len(_STEPS)), np.uint32)
    key += (codes[:, :places] * _MULTIPLIERS[0])[:, :, None]
    for j in range(ORDER - 1):
        scaled = codes * _MULTIPLIERS[j + 1]
        for k, step in enumerate(_STEPS[:, j]):
            key[:, :, k] += scaled[:, step : step + places]
    key >>= np.uint32(12)
    for k, step in enumerate(_STEPS[:, -1]):
        key[:, :, k][codes[:, step : step + places] == 0] = BUCKETS
    key = key.reshape(len(found), -1)
    weight = np.tile(_WEIGHTS, places)
    return key, weight, np.sqrt(np.maximum((key < BUCKETS) @ weight**2, 1e-9))


def _batches(found: list[str], most: int = 512):
    """Index ranges of segments of like length, so that padding stays small."""
    order = np.argsort([len(s) for s in found], kind="stable")
    for a in range(0, len(order), most):
        yield order[a : a + most]


@dataclass
class Machine:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    coefficients: np.ndarray
    landmarks: list[str]

    def table(self) -> np.ndarray:
        dense = np.zeros(BUCKETS + 1, np.float32)
        dense[self.buckets] = self.weights
        return dense

    def probability(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def decide(found: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each segment; a long one's is that of its highest piece."""
    out = np.full(len(found), bias, np.float64)
    parts, owner = [], []
    for i, s in enumerate(found):
        for part in parts_of(s):
            parts.append(part)
            owner.append(i)
    owner, value = np.array(owner, np.int64), np.empty(len(parts))
    for rows in _batches(parts):
        key, weight, length = subsequences([parts[i] for i in rows])
        value[rows] = table[key] @ weight / length
    best = np.full(len(found), -np.inf)
    np.maximum.at(best, owner, value)
    return np.where(np.isfinite(best), best, 0) + out


def likeness(found: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, (segments, landmarks)."""
    key, weight, length = subsequences(landmarks)
    used = np.unique(key[key < BUCKETS])
    place = np.full(BUCKETS + 1, -1, np.int64)
    place[used] = np.arange(len(used))
    table = np.zeros((len(used), len(landmarks)), np.float32)
    rows, cols = np.nonzero(key < BUCKETS)
    np.add.at(table, (place[key[rows, cols]], rows), weight[cols] / length[rows])
    out = np.zeros((len(found), len(landmarks)), np.float32)
    for at in _batches(found, 64):
        key, weight, length = subsequences([found[i] for i in at])
        where = place[key]
        rows, cols = np.nonzero(where >= 0)
        if len(rows):
            cuts = np.flatnonzero(np.diff(rows, prepend=-1))
            out[at[rows[cuts]]] = np.add.reduceat(table[where[rows, cols]] * weight[cols][:, None], cuts) / length[rows[cuts]][:, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 25) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps on its active rows; the last coefficient is the bias."""
    x = np.append(x, np.ones((len(x), 1), x.dtype), 1)
    w = np.zeros(x.shape[1])
    keep = np.ones(len(w))
    keep[-1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        gradient, hessian = keep * w, np.diag(keep)
        for a in range(0, len(on), 4096):  # few rows at a time, in double precision
            some = np.flatnonzero(on[a : a + 4096]) + a
            part = x[some].astype(np.float64)
            gradient -= 2 * part.T @ (cost * weight[some] * y[some] * slack[some])
            hessian += 2 * (part * (cost * weight[some])[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(found: list[str], toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """First guess: a segment's best letter run, by the lower bound of its log odds among toxic documents."""
    best = np.full(len(found), -9.0)

    def runs(n: int):
        """(segments, bucket of each run of n letters, where there is one), for some segments at a time."""
        for rows in _batches(found, 20_000):
            most = max(len(found[rows[-1]]) + 2, n)
            codes = np.array([f"\x01{found[i]}\x02" for i in rows], dtype=f"<U{most}").view(np.uint32).reshape(len(rows), most)
            key = np.zeros((len(rows), most - n + 1), np.uint32)
            for j in range(n):
                key = key * np.uint32(0x01000193) ^ codes[:, j : most - n + 1 + j] * np.uint32(0x9E3779B1)
            yield rows, key >> np.uint32(12), codes[:, n - 1 :] > 0

    for n in (4, 5, 6):
        t, c = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for rows, key, there in runs(n):
            owner = np.broadcast_to(rows[:, None], key.shape)[there]
            t += np.bincount(key[there], toxic[owner], BUCKETS)
            c += np.bincount(key[there], clean[owner], BUCKETS)
        odds = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / (clean.sum() + 1)) - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        for rows, key, there in runs(n):
            best[rows] = np.maximum(best[rows], np.where(there, odds[key], -9).max(1))
    return best


def _disguised(s: str, rng: np.random.Generator) -> str:
    """A letter put in, doubled or left out."""
    if len(s) < 4:
        return s
    at, kind = int(rng.integers(1, len(s))), int(rng.integers(3))
    return s[:at] + ("abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] if kind == 0 else s[at - 1] if kind == 1 else "") + s[at + (kind == 2) :]


def train(toxic: list[str], clean: list[str], rate: float, seed: int = 0) -> Machine:
    """From the texts of toxic and clean documents; ``rate``: share of toxic ones among all labelled."""
    even = np.array([0, 0, 0, np.log(max(rate, 1e-4) / max(1 - rate, 1e-4))])
    learned = _learned(toxic, clean, seed)
    if learned is None:
        return Machine(np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0, even, [])
    #: All that it was learned from but the texts is gone by now.
    slim()
    table, bias, landmarks = learned
    buckets = np.flatnonzero(table)
    machine = Machine(buckets, table[buckets], bias, even, landmarks)
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weight = np.where(y > 0, rate / len(toxic), (1 - rate) / len(clean)) * 400
    #: The same summaries as when it scores.
    machine.coefficients = calibrate(Scorer(machine)(pa.array(toxic + clean, pa.large_string())), y, weight)
    return machine


def _learned(toxic: list[str], clean: list[str], seed: int) -> tuple[np.ndarray, float, list[str]] | None:
    """A weight for each bucket, the bias and the landmarks; nothing, if no segment tells toxic texts."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}

    def numbered(found: set[str]) -> np.ndarray:
        return np.array(sorted({index.setdefault(part, len(index)) for s in found for part in parts_of(s)}), np.int32)

    #: Each toxic document as the distinct segments, or their pieces, of each of its sentences; a clean one as all of them.
    bags = [[numbered(x) for x in sentences(t)] for t in toxic]
    docs = [np.unique(np.concatenate(b)) for b in bags] + [numbered(set().union(*sentences(t))) for t in clean]
    found = list(index)
    if not toxic or not clean or not found:
        return None
    seen = np.zeros((2, len(found)))
    for i, d in enumerate(docs):
        seen[int(i >= len(toxic)), d] += 1
    score = _odds(found, *seen)
    floor, witness = np.log(2.0), np.zeros(len(found))
    for turn in range(ROUNDS):
        #: The segments that stand for each toxic sentence: those near the document's highest.
        witness *= 0.5
        for b, d in zip(bags, docs):
            if len(d) and score[d].max() > floor:
                low = max(floor, 0.6 * score[d].max())
                for members in b:
                    witness[members[score[members] >= low]] += 1
        #: A segment as common in clean documents stands for no toxic sentence.
        positive = np.flatnonzero((witness > 0) & (seen[0] / len(toxic) > 2 * seen[1] / len(clean)))
        if not len(positive):
            return None
        positive = positive[np.argsort(-witness[positive], kind="stable")][:4000]
        negatives = np.flatnonzero(seen[1] > 0)
        hard = negatives[np.argsort(-score[negatives], kind="stable")[:6000]]
        common = negatives[np.argsort(-seen[1][negatives], kind="stable")[:4000]]
        negative = np.unique(np.concatenate([hard, common, rng.choice(negatives, min(len(negatives), 6000), replace=False)]))
        negative = np.setdiff1d(negative, positive)
        if turn < 2:
            half = positive[: LANDMARKS_TOXIC // 2]
            rest = positive[LANDMARKS_TOXIC // 2 :]
            picked = np.concatenate([half, rng.choice(rest, min(len(rest), LANDMARKS_TOXIC - len(half)), replace=False)]) if len(rest) else half
            landmarks = [found[i] for i in np.concatenate([picked, hard[:LANDMARKS_CLEAN]])]
            landmarks = list(dict.fromkeys(landmarks))
            gram = likeness(landmarks, landmarks).astype(np.float64)
            values, vectors = np.linalg.eigh(gram)
            root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
        names = [found[i] for i in positive]
        disguised = [_disguised(s, rng) for s in names]
        x = likeness(names + disguised + [found[i] for i in negative], landmarks) @ root.astype(np.float32)
        y = np.concatenate([np.ones(2 * len(names)), -np.ones(len(negative))])
        share = np.sqrt(witness[positive])
        weight = np.concatenate([share / share.sum(), 0.5 * share / share.sum(), np.sqrt(seen[1][negative]) / np.sqrt(seen[1][negative]).sum()]) * 1000
        w = svm(x, y, weight)
        beta, bias = root @ w[:-1], float(w[-1])
        key, weights, length = subsequences(landmarks)
        table = np.bincount(key.reshape(-1), (weights[None, :] * (beta / length)[:, None]).reshape(-1), BUCKETS + 1).astype(np.float32)
        table[BUCKETS] = 0
        score = decide(found, table, bias)
        floor = 0.0
    return table, bias, landmarks


def summary(highest, total, n):
    """What a document's score is made of: its highest decision, the sum of its positive ones, and
    that sum against its number of distinct segments; all are 0 where no decision is positive."""
    return np.stack([np.maximum(highest, 0), np.log1p(total), np.log1p(50 * total / (n + 20))], axis=-1)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last coefficient is the offset."""
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    w = np.array([1.0, 0.0, 0.0, -1.0])
    for _ in range(80):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (q - y)) + 1e-2 * w
        hessian = (z * (weight * q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    return w


class Scorer:
    """Summaries of whole texts' decisions: each distinct segment of a text counts once, and so does each
    distinct spelled one.  A word's segment is decided once and kept."""

    def __init__(self, machine: Machine):
        #: Per word hash: its segment's decision, the segment's hash, and its letter if it is a single one.
        self.machine, self.dense, self.kept = machine, machine.table(), {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        bias = self.machine.bias
        out = np.tile(summary(bias, 0.0, 0), (len(texts), 1))
        for a, b in pieces(texts):
            data, offsets = utf8(texts.slice(a, b - a))
            start, end, first = words(data, offsets)
            if not len(start):
                continue
            unique, where, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
            keys = unique.tolist()
            got = list(map(self.kept.get, keys))
            new = [i for i, x in enumerate(got) if x is None]
            if new:
                raw = data.tobytes()
                names = [segment(raw[s:e].decode("utf-8", "replace")) for s, e in zip(start[where[new]].tolist(), end[where[new]].tolist())]
                for i, name, x in zip(new, names, decide(names, self.dense, bias).tolist()):
                    got[i] = self.kept[keys[i]] = (x, hash(name) if name else 0, name if len(name) == 1 else "")
                if len(self.kept) > CACHE_SEGMENTS:
                    for k in list(self.kept)[: len(self.kept) // 2]:
                        del self.kept[k]
            values, marks, letters = zip(*got)
            docs = np.repeat(np.arange(b - a), np.diff(first))
            #: Words whose segments are equal share a place.
            marks, at, place = np.unique(np.array(marks, np.int64), return_index=True, return_inverse=True)
            value, there = np.array(values)[at], (marks != 0)[place[inverse]]
            pairs = np.unique(docs[there] * len(marks) + place[inverse[there]])
            owner, value = pairs // len(marks), value[pairs % len(marks)]
            best, total = np.full(b - a, -np.inf), np.zeros(b - a)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(cuts):
                best[owner[cuts]] = np.maximum.reduceat(value, cuts)
                total[owner[cuts]] = np.add.reduceat(np.maximum(value, 0), cuts)
            number = np.bincount(owner, minlength=b - a)
            best = np.where(number > 0, best, bias)
            #: Only texts with three single letters in a row, words without letters aside, spell anything.
            letter = np.array([bool(x) for x in letters])[inverse[there]]
            among, own = np.flatnonzero(there), docs[there]
            three = np.flatnonzero(letter[2:] & letter[1:-1] & letter[:-2] & (own[2:] == own[:-2])) if len(letter) > 2 else []
            for d in np.unique(own[three]).tolist() if len(three) else ():
                found = [letters[inverse[i]] or "--" for i in among[np.searchsorted(own, d) : np.searchsorted(own, d, "right")]]
                names = sorted(set(spelled(found)))
                extra = decide(names, self.dense, bias)
                best[d], total[d], number[d] = max(best[d], extra.max()), total[d] + np.maximum(extra, 0).sum(), number[d] + len(names)
            out[a:b] = summary(best, total, number)
        return out


_scorers: dict[str, Scorer] = {}


def scorer(machine: Machine):
    """An Arrow function of a text column: the probability that it is toxic."""
    import uuid

    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(machine)
        out = pa.array(machine.probability(_scorers[name](texts)), pa.float64())
        slim()
        return out

    return toxicity


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): a document's largest label, where it has several that differ."""
    return labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).alias("label"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> Machine:
    """Trains on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents that are not held out.

    One task learns, from their whole texts; only the weights reach the driver."""
    rows = docs.select("doc_id", "text")
    marks = one_label(labels, "toxic")
    if held_out is not None:
        marks = marks.filter(~held_out)
    share = {bool(r[0]): r[1] for r in marks.groupBy(F.col("label") == 1).count().collect()}
    n = sum(share.values())
    rate = share.get(True, 0) / n if n else 0.0

    def sample(toxic: bool, most: int) -> DataFrame:
        ids = marks.filter((F.col("label") == 1) == toxic).select("doc_id", F.xxhash64("doc_id").alias("h"))
        chosen = ids.orderBy("h", "doc_id").limit(most).select("doc_id")
        return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", F.lit(toxic).alias("toxic"), F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id", "text").limit(most)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["toxic"], r["doc_id"], r["text"]) for batch in batches for r in batch.to_pylist())
        #: What other steps have left in this worker.
        tokens._encoders.clear()
        slim()
        machine = train([t for x, _, t in got if x], [t for x, _, t in got if not x], rate)
        columns = [machine.buckets.astype(np.int64).tobytes(), machine.weights.astype(np.float32).tobytes(), machine.bias, machine.coefficients.tolist(), machine.landmarks]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())))], names=["buckets", "weights", "bias", "coefficients", "landmarks"])

    both = sample(True, SAMPLE_TOXIC).unionByName(sample(False, SAMPLE_CLEAN)).repartition(1)
    got = both.mapInArrow(lean(learn), "buckets binary, weights binary, bias double, coefficients array<double>, landmarks array<string>").collect()
    if not got:
        return train([], [], rate)
    r = got[0]
    return Machine(np.frombuffer(bytes(r["buckets"]), np.int64), np.frombuffer(bytes(r["weights"]), np.float32), r["bias"], np.array(r["coefficients"]), list(r["landmarks"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity score of every whole text, learned from the labels that are not held out.

    One row for each input row; a null text is scored as an empty one, which
    has the score of a text without any segment.  Without labels of both
    classes every score is the toxic share.  Null labels and labels of unknown
    documents are left out; of a document's labels the largest counts; an empty
    table gives no rows.
    """
    held = remainder(F.col("doc_id"), 4) == 2
    machine = fit(docs, labels, held)
    return docs.select("doc_id", held.alias("held_out"), scorer(machine)(F.coalesce("text", F.lit(""))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
