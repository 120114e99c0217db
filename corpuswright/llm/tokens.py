"""Token ids of whole texts, cached by word.

White space always parts the vocabulary's pre-tokens, so a text's ids are its
words' ids joined.  A chunk of texts is hashed to words in numpy, only words
not met before are encoded, and all ids are gathered by index.  Plain words
(letters, then ASCII punctuation) take the vocabulary's merges directly, all
new ones in one call; any other goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ._words import pieces, utf8, word_hashes, words

TOKENIZER_FILE = "word_bpe_49k.json"
#: Words whose ids a worker keeps between batches; beyond it the older half is dropped.
CACHE_WORDS = 200_000
#: What stands for a word's end while merges are looked up; no plain word has it.
_END = "\x01"
#: 1: ASCII letters; 2: ASCII punctuation without the apostrophe; 0: all else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_encoders: dict[tuple[str, bool], WordEncoder] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; an existing path is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begin): the spans' bytes in a row, and where each begins among them."""
    sizes = end - start
    begin = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(start - begin, sizes)], begin


def _plain_parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain, parts, bytes): which words are letters (ASCII, or Latin-1 by two bytes), then ASCII punctuation, either
    perhaps none; how many of both each of those has; their bytes, in lower case, with an end's mark after each part."""
    found, begin = gathered(data, start, end)
    follows = np.append(found[1:], np.uint8(0))
    latin = (found == 0xC3) & (follows >= 0x80) & (follows < 0xC0) & (follows != 0x97) & (follows != 0xB7)
    second = np.insert(latin[:-1], 0, False) if len(latin) else latin
    kind = _KIND[found]
    kind[latin | second] = 1
    head = np.zeros(len(found), bool)
    head[begin] = True
    back = np.insert((kind[1:] == 1) & (kind[:-1] == 2) & ~head[1:], 0, False) if len(found) else head
    plain = ~np.logical_or.reduceat((kind == 0) | back, begin) if len(begin) else np.zeros(0, bool)
    keep = np.repeat(plain, end - start)
    lower = np.where((kind == 1) & ((found >= 65) & (found <= 90) | second & (found <= 0x9E)), found + np.uint8(32), found)
    last = np.append((kind[1:] != kind[:-1]) | head[1:], True) if len(found) else head
    n_parts = np.add.reduceat(last, begin, dtype=np.int64)[plain] if len(begin) else np.zeros(0, np.int64)
    return plain, n_parts, np.insert(lower[keep], np.flatnonzero(last[keep]) + 1, ord(_END))


class WordEncoder:
    """Ids of whole texts.  ``plain``: special tokens' strings in a text are ordinary text."""

    def __init__(self, name: str, cache_words: int = CACHE_WORDS, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(name)
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = plain
        special = set(self.exact.get_added_tokens_decoder())
        alphabet, end = _byte_alphabet(), _END.encode()
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks, last = {end: 1 << 20}, np.zeros((1 << 20) + 1, bool)
        for token, i in vocabulary.items():
            ends = token.endswith("</w>")
            raw = bytes(alphabet[c] for c in (token[:-4] if ends else token)) if i not in special else b""
            if raw and (ends or raw != end):
                ranks[raw + end * ends] = i
                last[i] = ends
        #: A word's end is one more byte, which joins the last byte before any other merge.
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ends = last
        self.cache: dict[int, bytes] = {}
        self.cache_words = cache_words

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """uint16 ids, as bytes, of the words at these spans."""
        out: list[bytes] = [b""] * len(start)
        plain, n_parts, parts = _plain_parts(data, start, end)
        some = np.flatnonzero(plain)
        if len(some):
            flat = np.array(self.merge(parts.tobytes().decode()), np.int64)
            upto = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
            cuts = (upto[np.concatenate([[0], np.cumsum(n_parts)])] * 2).tolist()
            raw = flat.astype(np.uint16).tobytes()
            for i, a, b in zip(some.tolist(), cuts, cuts[1:]):
                out[i] = raw[a:b]
        rest = np.flatnonzero(~plain)
        if len(rest):
            raw, spans = data.tobytes(), zip(start[rest].tolist(), end[rest].tolist())
            for i, e in zip(rest.tolist(), self.exact.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in spans], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint16).tobytes()
        return out

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) for consecutive row ranges: flat uint16 ids, and ids of each row."""
        for a, b in pieces(column):
            data, offsets = utf8(column.slice(a, b - a))
            start, end, first = words(data, offsets)
            unique, where, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
            keys = unique.tolist()
            got = list(map(self.cache.get, keys))
            new = [i for i, x in enumerate(got) if x is None]
            if new:
                at = where[new]
                for i, ids in zip(new, self.encode_words(data, start[at], end[at])):
                    got[i] = self.cache[keys[i]] = ids
                if len(self.cache) > self.cache_words:
                    for k in list(self.cache)[: len(self.cache) // 2]:
                        del self.cache[k]
            flat = np.frombuffer(b"".join(got), np.uint16)
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 2
            begin = np.cumsum(sizes) - sizes
            n = sizes[inverse]
            total = np.cumsum(n)
            ids = flat[np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n, n) + np.repeat(begin[inverse], n)]
            upto = np.concatenate([[0], total])
            yield ids, np.diff(upto[first])


def encoder(name: str = TOKENIZER_FILE, plain: bool = False) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The worker's encoder for a vocabulary file; tasks in one worker share it."""
    if (name, plain) not in _encoders:
        _encoders[name, plain] = WordEncoder(name, plain=plain)
    return _encoders[name, plain]
