"""Spelling variants: words one letter apart, grouped under the most frequent form.

Words are counted by SQL functions.  Two words that differ by one replaced
letter agree in what stands before and after it; two that differ by one inserted
letter agree once it is deleted.  A task takes a batch of words as arrays of
code points and makes all their deletion keys at once: prefix and suffix
polynomial hashes, joined around each place, give 64-bit integers in numpy.  Keys
are radix-partitioned by their upper bits, sorted, and met where they are equal,
and every meeting is verified on the strings themselves.

No meeting place is crowded: a replaced letter's place holds a word for each
letter of the alphabet at most, and an inserted letter's the shorter word and a
word for each of its places and letters.  Meetings give a word partial numbers
(its near words there, and the best of them), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import lean, partitions, written

#: Runs of these characters are words' occurrences.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Every so many (document, run), by hash, a run loses a letter.
NOISE = 97
#: A form is at least so many times as frequent.
FACTOR = 2
#: Words, of as many code points at most in sum as fit a step, that one vectorised step takes.
STEP_CELLS = 1 << 18

#: What a word meets others as: with a letter left out, which another may have in its place (REPLACED) or not have (LONGER);
#: or as it is, to meet those with a letter more (SHORTER).
REPLACED, LONGER, SHORTER = 0, 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)

KEYS = "key long, kind int, place int, word string, n long"
_KEY_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
MET = "word string, n_near long, best_n long, best string"
_MET_SCHEMA = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def lower_ascii(run: Column) -> Column:
    """Only A-Z become small."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(run.rlike("[A-Z]"), F.translate(run, upper, small)).otherwise(run)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): distinct words of enough letters and occurrences in whole texts (doc_id, text).

    Some occurrences lose a letter first, by crc32 of "<doc_id>:<run>" (a null id is empty there), as spelling errors would have it.
    Null and empty texts have none.  Counted in part before the shuffle, so a frequent word is a row a task.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.select("_id", lower_ascii(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("_run")))
    at = (h % F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    words = runs.select(F.when(h % NOISE == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def deletion_keys(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, place, which) of all words of a batch: their code points in a row, and how many each has.

    With P_i the polynomial of the first i letters, and places of later letters one less once letter i is gone, a word's
    polynomial without it is P_i + (P_n - P_{i+1}) / base.  A letter in a run of equal ones gives one LONGER key for the run.
    """
    start = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - start[word]
    power = np.full(int(lengths.max(initial=0)) + 1, _BASE, np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    term = _mixed(points.astype(np.uint64) + _PLACE) * power[place]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    prefix, after = upto[:-1] - upto[start][word], upto[start + lengths][word] - upto[1:]
    without, whole = prefix + after * _INVERSE, upto[start + lengths] - upto[start]
    n = lengths.astype(np.uint64)
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    short = np.flatnonzero(first)
    key = np.concatenate([_mixed(without + (place.astype(np.uint64) + np.uint64(1)) * _PLACE + n[word] * _BASE), _mixed(without + (n[word] - np.uint64(1)) * _BASE)[short], _mixed(whole + n * _BASE)])
    kind = np.repeat(np.array([REPLACED, LONGER, SHORTER], np.int32), [len(points), len(short), len(lengths)])
    return key.view(np.int64), kind, np.concatenate([place, place[short], np.zeros(len(lengths), np.int64)]).astype(np.int32), np.concatenate([word, word[short], np.arange(len(lengths))])


def keys(words: DataFrame) -> DataFrame:
    """(key, kind, place, word, n): each word (word, n) once for every letter replaced, every run of letters shortened, and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            row = 0
            upto = np.cumsum(lengths)
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + STEP_CELLS, "right")))
                points = np.frombuffer("".join(texts[row:stop]).encode("utf-32-le"), np.uint32)
                key, kind, place, which = deletion_keys(points, lengths[row:stop])
                own = pa.array(which + row)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(place), batch.column("word").take(own), batch.column("n").take(own)], schema=_KEY_SCHEMA)
                row = stop

    return words.select("word", "n").mapInArrow(lean(run), KEYS)


def _verified(kinds: list[int], places: list[int], words: list[str]) -> Iterator[list[int]]:
    """Of rows of one key, those that truly are one string: REPLACED ones at one place, or LONGER and SHORTER ones."""
    same: dict[tuple, list[int]] = {}
    for i, (kind, place, word) in enumerate(zip(kinds, places, words)):
        rest = word if kind == SHORTER else word[:place] + word[place + 1 :]
        same.setdefault((place, rest) if kind == REPLACED else (-1, rest), []).append(i)
    return iter(same.values())


def _best(rows: list[tuple[int, str]]) -> tuple[int, str] | None:
    """(n, word) of the most frequent; of equals the first in code-point order."""
    return min(rows, key=lambda r: (-r[0], r[1])) if rows else None


def meetings(kinds: list[int], places: list[int], words: list[str], ns: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for each word that meets others in rows of one key."""
    for rows in _verified(kinds, places, words):
        if len(rows) < 2:
            continue
        if kinds[rows[0]] == REPLACED:
            ranked = sorted(((ns[i], words[i]) for i in rows), key=lambda r: (-r[0], r[1]))
            for i in rows:
                best = ranked[1] if ranked[0][1] == words[i] else ranked[0]
                yield words[i], len(rows) - 1, *best
        else:
            short, long = [i for i in rows if kinds[i] == SHORTER], [i for i in rows if kinds[i] == LONGER]
            best = _best([(ns[i], words[i]) for i in long])
            for i in short:  # words are distinct: one at most
                if best:
                    yield words[i], len(long), *best
                for j in long:
                    yield words[j], 1, ns[i], words[i]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of each word (word, n; distinct) with a near one how many it has, and the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = both.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from met(both.slice(0, last))
            held = both.slice(last)  # its key may go on in the next batch
        if held is not None:
            yield from met(held)

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        if len(key) < 2:
            return
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        several = np.flatnonzero(np.diff(cuts) > 1)
        if not len(several):
            return
        picked = rows.take(pa.array(np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in several])))
        lists = [picked.column(c).to_pylist() for c in ("kind", "place", "word", "n")]
        stops = np.cumsum(np.diff(cuts)[several]).tolist()
        found = [m for a, b in zip([0, *stops], stops) for m in meetings(*(x[a:b] for x in lists))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], schema=_MET_SCHEMA)

    #: A radix of the key: its upper bits name the partition, within which keys are sorted.
    dealt = keys(words).repartition(partitions(words.sparkSession), F.shiftright("key", 32)).sortWithinPartitions("key")
    partial = dealt.mapInArrow(lean(run), MET)
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", F.struct(-F.col("best_n"), F.col("best"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), forms being at least twice as frequent: the last of each chain, whose length is so
    logarithmic; links double in length with each round, and every round is written to the shared folder."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-links")
        links = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return links


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every counted word of documents (doc_id, text).

    ``form``: its near word of largest n (ties: first in code-point order), if that is FACTOR times its own or more, else null with
    ``form_n``; ``root``: the last word along forms, itself without one; ``n_near``: 0 without a near word.
    """
    words = written(word_counts(docs, least_letters, least_times), "spelling-words")
    joined = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= FACTOR * F.col("n")
    both = written(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(both.filter("form is not null").select("word", "form"))
    return both.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
