"""Two tokenizers' ids of the same bytes, aligned where both end a token.

A is a byte-level vocabulary and gets a space and the text; B is a piece
vocabulary, which puts that space before the text itself.  An Arrow batch is one
byte buffer with the documents' offsets.  Both encoders split it at the same
places, before a space between words, where no token of either goes across, so
a batch's distinct words are encoded once each.  From then on a batch is arrays: the ends
of A's and of B's tokens are counted by byte once, groups are cut where both
occur, every end of either is a link between the two tokens that hold the byte
before it, and prefix sums over the batch, taken at the documents' offsets, are
the documents' own numbers.

How often a pair of ids is linked is counted over all documents.  The pairs are
then gone through in slices of at most SLICE_PAIRS, each of which is broadcast
to the documents' links; more pairs make more slices, not larger ones.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import lean, written
from ._words import CHUNK_BYTES, pieces, utf8, word_hashes
from .tokens import _byte_alphabet, gathered, tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids that are broadcast at once; an A id has fewer (one for each of B's ids) if this is at least B's size.
SLICE_PAIRS = 1 << 20
#: Bits of a B id in a pair's code; A ids come above.
B_BITS = 15

_rng = np.random.Generator(np.random.PCG64(20250113))
#: A value a byte, for hashing words as they are.
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, lengths): of each id below n its decimal digits from the left, in a row of six places."""
    ids = np.arange(n)
    length = np.maximum(1, sum((ids >= 10**k).astype(np.int64) for k in range(6)))
    places = length[:, None] - 1 - np.arange(6)[None, :]
    digits = ids[:, None] // 10 ** np.maximum(places, 0) % 10 + 48
    return digits.astype(np.uint8), length


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(tokenizer_path(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b_file))
        alphabet = _byte_alphabet()
        #: A token that the vocabulary adds is text as it stands.
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        size = max(self.a.get_vocab(True).values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(True).items():
            self.a_bytes[i] = added[i].encode() if i in added else bytes(alphabet[c] for c in token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        if self.b.get_piece_size() > 1 << B_BITS or size >= 1 << (31 - B_BITS):
            raise ValueError("a vocabulary is too large for pair codes of 31 bits")
        #: The same merges, as ids are ranks of the bytes they join; for many words in one call.
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in added}
        self.merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.digits, self.digit_counts = _decimals(max(size, len(self.b_bytes)))
        self.sizes = [np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes)]

    def _one(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """A's and B's ids of a word, which begins with a space, and whether the bytes of both are the word's."""
        word = raw.decode()
        a, b = self.a.encode(word, add_special_tokens=False).ids, self.b.encode(word[1:])
        return np.array(a, np.int64), np.array(b, np.int64), b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids, counts, same): for each side all words' ids in a row, and each word's number; whether a word's tokens have its bytes.

        Words of a space and then ASCII or Latin-1 letters, no other space and none but a visible character at either end, follow each
        other in one call; a word's end is then where tokens of either side have given its bytes.  Any other word is a call of its own.
        """
        ids, counts, same = [np.zeros(0, np.int64)] * 2, [np.zeros(len(start), np.int64) for _ in range(2)], np.ones(len(start), bool)
        if not len(start):
            return ids, counts, same
        flat, begin = gathered(data, start, end)
        good = (flat > 0) & (flat < 127) & (flat != 32)
        latin = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0xBF)
        good[1:] |= latin
        good[:-1] |= latin
        good[begin] = True
        plain = np.logical_and.reduceat(good, begin) & (end - start > 1) & (flat[np.minimum(begin + 1, len(flat) - 1)] > 32) & (data[end - 1] > 32)
        raw = flat[np.repeat(plain, end - start)].tobytes()
        stops, text = np.cumsum((end - start)[plain]), raw.decode()
        b_ids = chain.from_iterable(self.b.encode(text[1:].split(" "), num_threads=1)) if text else []
        for side, (found, known) in enumerate(((self.merge(text), self.a_bytes), (list(b_ids), self.b_bytes))):
            got = np.array(found, np.int64)
            upto = np.cumsum(self.sizes[side][got])
            at = np.searchsorted(upto, stops)
            if b"".join([known[i] for i in found]) != raw or not np.array_equal(upto[at], stops):
                plain = np.zeros(len(start), bool)  # never seen: then every word is encoded alone
                break
            ids[side], counts[side][plain] = got, np.diff(at + 1, prepend=0)
        rest = np.flatnonzero(~plain)
        if len(rest):
            alone = [self._one(data[p:q].tobytes()) for p, q in zip(start[rest].tolist(), end[rest].tolist())]
            same[rest] = [x[2] for x in alone]
            for side in range(2):
                counts[side][rest] = [len(x[side]) for x in alone]
                merged = np.empty(int(counts[side].sum()), np.int64)
                own = np.repeat(plain, counts[side])
                merged[own], merged[~own] = ids[side] if plain.any() else ids[side][:0], np.concatenate([x[side] for x in alone])
                ids[side] = merged
        return ids, counts, same


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    """The worker's encoders; tasks in one worker share them."""
    if (a_file, b_file) not in _pairs:
        _pairs[a_file, b_file] = Pair(a_file, b_file)
    return _pairs[a_file, b_file]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a word begins: at a text's start, and at a space that stands between a printable ASCII character or a Latin-1 letter
    and a byte that is no white space (as a text's last space has: a text begins with one).  No token of a vocabulary without white space after other characters goes across."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    if n > 2:
        solid = (data > 32) & (data < 127)
        solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        begins[1 : n - 1] |= (data[1:-1] == 32) & solid[:-2] & ~_SPACE[data[2:]]
    return np.flatnonzero(begins[:n])


def _picked(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of words in the order of ``which``."""
    n = counts[which]
    upto = np.cumsum(n)
    return ids[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat((np.cumsum(counts) - counts)[which] - upto + n, n)]


def align(data: np.ndarray, offsets: np.ndarray, encoders: Pair) -> dict[str, object]:
    """Of texts as ``spaced`` makes them, in one buffer: per text its numbers, its groups' text, its distinct pairs and their times.

    A text whose tokens' bytes are not its own has none.
    """
    n_docs = len(offsets) - 1
    start = word_starts(data, offsets)
    end = np.append(start, len(data))[1:]
    _, first, which = np.unique(word_hashes(data, start, end, _VALUES), return_index=True, return_inverse=True)
    ids, counts, same = encoders.encode(data, start[first], end[first])
    doc_of_word = np.searchsorted(offsets, start, "right") - 1
    right = np.ones(n_docs, bool)
    right[doc_of_word[~same[which]]] = False
    use = right[doc_of_word]
    #: Only right texts' bytes stay in the batch.
    lengths = np.where(right, np.diff(offsets), 0)
    offsets, which = np.concatenate([[0], np.cumsum(lengths)]), which[use]
    size = int(offsets[-1])
    a, b = (_picked(i, c, which) for i, c in zip(ids, counts))
    ends_a, ends_b = np.cumsum(encoders.sizes[0][a]), np.cumsum(encoders.sizes[1][b])
    at_a, at_b = np.bincount(ends_a, minlength=size + 1), np.bincount(ends_b, minlength=size + 1)
    cut = at_a & at_b
    upto_a, upto_b, upto_cut, upto_link = (np.cumsum(x) for x in (at_a, at_b, cut, at_a | at_b))
    per = lambda upto: upto[offsets[1:]] - upto[offsets[:-1]]
    #: A link ends at every end of either; its tokens are those that hold the byte before.
    last = np.flatnonzero(at_a | at_b) - 1
    codes = a[upto_a[last]] << B_BITS | b[upto_b[last]] if len(last) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), per(upto_link))
    pairs, times = np.unique(doc << 31 | codes, return_counts=True)
    pair_counts = np.bincount(pairs >> 31, minlength=n_docs)
    #: Groups as text: A's tokens of a group, then B's; a token's separator tells what follows it.
    group_a, group_b = upto_cut[ends_a - 1], upto_cut[ends_b - 1]
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    shift_b = np.cumsum(n_a)
    shift_a = np.cumsum(n_b) - n_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + shift_a[group_a]] = np.arange(len(a))
    order[np.arange(len(b)) + shift_b[group_b]] = np.arange(len(b)) + len(a)
    ids = np.concatenate([a, b])[order]
    marks = np.full(len(ids), ord(","), np.uint8)
    marks[shift_b + shift_a - 1] = ord("|")
    marks[shift_b + shift_a + n_b - 1] = ord(";")
    digits = encoders.digit_counts[ids]
    stop = np.cumsum(digits + 1)
    text = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    begin = stop - digits - 1
    for place in range(6):
        has = digits > place
        if not has.any():
            break
        text[begin[has] + place] = encoders.digits[ids[has], place]
    text[stop - 1] = marks
    upto_token = np.concatenate([[0], stop])
    return {
        "n_a": per(upto_a), "n_b": per(upto_b), "n_groups": per(upto_cut), "n_links": per(upto_link), "text": text, "cuts": upto_token[upto_a[offsets] + upto_b[offsets]],
        "pairs": (pairs & 0x7FFFFFFF).astype(np.int32), "times": times.astype(np.int32), "pair_cuts": np.concatenate([[0], np.cumsum(pair_counts)]), "right": right,
    }


def _long(data: np.ndarray, encoders: Pair, most: int) -> dict[str, object]:
    """One long text by parts that begin where a word does, so that memory follows the part; a group ends at each."""
    start = word_starts(data, np.array([0, len(data)]))
    cuts, at = [0], 0
    while at < len(data):
        i = int(np.searchsorted(start, at + most))
        at = int(start[i]) if i < len(start) else len(data)
        cuts.append(at)
    sums, right, digest, pairs, times = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0), True, hashlib.sha256(), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for i, (p, q) in enumerate(zip(cuts, cuts[1:])):
        got = align(data[p:q], np.array([0, q - p]), encoders)
        if not (right := bool(got["right"][0])):
            break
        for k in sums:
            sums[k] += int(got[k][0])
        digest.update(b";" * bool(i) + got["text"].tobytes()[:-1])
        pairs, back = np.unique(np.concatenate([pairs, got["pairs"]]), return_inverse=True)
        times = np.bincount(back, np.concatenate([times, got["times"]]), len(pairs)).astype(np.int64)
    if not right:
        return dict.fromkeys(sums, 0) | {"sha": "", "pairs": np.zeros(0, np.int32), "times": np.zeros(0, np.int32)}
    return sums | {"sha": digest.hexdigest(), "pairs": pairs, "times": times.astype(np.int32)}


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row a document (doc_id, text): its numbers, its groups' digest, and its distinct linked pairs with their times.

    ``row`` tells apart rows of one id, or of none.  A null or empty text, and one whose tokens' bytes are not a space and the text
    (as with U+2581), has zeros, an empty digest and no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = pair(a_file, b_file)
        for batch in batches:
            for p, q in pieces(batch.column("text")):
                data, offsets = spaced(*utf8(batch.column("text").slice(p, q - p)))
                own = [batch.column("row").slice(p, q - p), batch.column("doc_id").slice(p, q - p)]
                if len(data) > 2 * CHUNK_BYTES and q == p + 1:
                    got = _long(data, encoders, CHUNK_BYTES)
                    rest = [pa.array([got[k]], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(got["pairs"])], pa.int32()), pa.array(got[k])) for k in ("pairs", "times")]
                    yield pa.RecordBatch.from_arrays([*own, *rest, pa.array([got["sha"]]), *lists], schema=_SCHEMA)
                    continue
                got = align(data, offsets, encoders)
                raw, cuts = memoryview(got["text"]), got["cuts"].tolist()
                sha = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]
                lists = [pa.ListArray.from_arrays(pa.array(got["pair_cuts"], pa.int32()), pa.array(got[k])) for k in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(got[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(sha), *lists], schema=_SCHEMA)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more.

    A window holds an A id's pairs, at most one for each id of B.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    return counts.withColumn("best", F.col("n") == most)


def slices(counts: DataFrame, most: int = SLICE_PAIRS) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``most`` pairs each (or one A id); the driver sees one number for each A id, of a vocabulary's size."""
    sizes = sorted(tuple(r) for r in counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.count("*").alias("n")).collect())
    found, held = [], 0
    for a, n in sizes:
        if found and held + n <= most:
            found[-1][1], held = a, held + n
        else:
            found.append([a, a])
            held = n
    return [(a, b) for a, b in found]


def cross_tokenizer(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most: int = SLICE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row a document, repeated ids included.

    ``n_best``: links whose pair is in as many documents as any pair of their A id; ``count_sum``: the sum of those numbers over links.
    """
    rows = written(aligned(docs, a_file, b_file), "aligned")
    counts = written(pair_counts(rows), "pairs")
    links = rows.select("row", F.arrays_zip("pairs", "times").alias("l")).select("row", F.inline("l").alias("pair", "times"))
    sums = []
    for first, last in slices(counts, most):
        inside = F.col("pair").between(first << B_BITS, (last + 1 << B_BITS) - 1)
        met = links.filter(inside).join(F.broadcast(counts.filter(inside)), "pair")
        sums.append(met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    own = rows.drop("pairs", "times")
    if not sums:
        both = own.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    else:
        total = sums[0] if len(sums) == 1 else reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        both = own.join(total, "row", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", number("n_best"), number("count_sum"), "groups_sha256")
