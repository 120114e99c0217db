"""Benchmark decontamination by fingerprints of item-sized windows.

Every benchmark item of m words is compared with the documents' windows of m
words by five-word shingles: sum of minima over sum of maxima of the shingles'
counts.  A window without any shingle of the item has similarity 0, so windows
are taken where documents have a benchmark's shingle, found first by a set or a join.

Each window and item has FINGERPRINTS SimHash fingerprints of 64 bits, each of its own
hashes.  A text and an item that share a shingle are candidates if any window is within the radius of
the item by any of them; blocks of the bits are tested before all 64, since two fingerprints within
the radius are alike, but for a quarter of it, in one of four blocks at least.  The radius is such that one fingerprint
misses about 7 in 100 windows at the least similarity that counts; four miss all about 2 in 100,000, and fewer above it.
Candidates are then compared exactly at every window that can be best.
Everything runs as DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

SHINGLE_WORDS = 5
SIMILARITY = 0.75
RADIUS, BLOCKS, FINGERPRINTS = 15, 4, 4
BLOCK_BITS = 64 // BLOCKS
#: The lowest bit of each byte; and up to how many shingles a byte counts them.
_LANES, _LANE_MOST = 0x0101010101010101, 63

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words, A-Z folded."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """64-bit hash of each k-word window; of the whole where there are fewer words; none without words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit b is set where more than half of the shingles' hashes have it set."""

    def weight(b: Column) -> Column:
        count = F.aggregate(shingles, F.lit(0), lambda s, h: s + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(count * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), weight), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def fingerprint(shingles: Column, number: int | Column) -> Column:
    """The window's SimHash by the ``number``-th hash of its shingles.

    Eight sums count all 64 bits, one byte a bit, where there are few enough shingles.
    """
    marks = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(number) if isinstance(number, int) else number))
    n = F.size(shingles)
    none = F.lit(0).cast("bigint")
    sums = [F.aggregate(marks, none, lambda s, x: s + F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_LANES))) for j in range(8)]
    #: A byte's next to last bit is set where it counts more than half.
    majority = lambda c: F.shiftrightunsigned(c + (F.lit(_LANE_MOST) - F.floor(n / 2)) * F.lit(_LANES), 6).bitwiseAND(F.lit(_LANES))
    bits = reduce(Column.bitwiseOR, [F.shiftleft(majority(c), j) for j, c in enumerate(sums)])
    return F.when(n <= _LANE_MOST, bits).otherwise(simhash(marks))


def radius_for(similarity: float) -> int:
    """Bits of 64 that a fingerprint may differ in: the mean at this similarity and four thirds of a deviation."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * differ + 1.33 * math.sqrt(64 * differ * (1 - differ)))


def near(a: Column, b: Column, radius: int = RADIUS) -> Column:
    """Whether fingerprints are within the radius; one in four blocks is within a quarter of it then."""
    turned = a.bitwiseXOR(b)
    block = lambda i: F.bit_count(F.shiftrightunsigned(turned, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
    return reduce(or_, [block(i) <= radius // BLOCKS for i in range(BLOCKS)]) & (F.bit_count(turned) <= radius)


def blocks_of(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for i in range(BLOCKS)])


def changed(value: Column, bits: int = BLOCK_BITS, most: int = RADIUS // BLOCKS) -> Column:
    """The value with every choice of at most ``most`` bits turned."""
    masks = [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(bits), n)]
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: value.bitwiseXOR(m.cast("bigint")))


def counts_of(shingles: Column) -> Column:
    """Sorted (hash, count) of a window's shingles."""
    return F.transform(F.array_distinct(shingles), lambda h: F.struct(h.alias("hash"), F.size(F.filter(shingles, lambda x: x == h)).alias("n")))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the shingles' counts."""
    common = F.aggregate(
        F.array_distinct(F.array_intersect(a, b)), F.lit(0),
        lambda s, h: s + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))),
    )
    return common / (F.size(a) + F.size(b) - common)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column behind a generator, which filters are not pushed through: else the optimizer would
    put its expression into every use, within functions of each element too."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, item): items' shingles; those without a word match nothing and are left out."""
    words = benchmark.select("item_id", word_list(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return words.select("item_id", F.size("words").alias("m"), shingle_hashes(F.col("words")).alias("item")).dropDuplicates()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, length, similarity): windows of documents that hold an item.

    One row for each document and item, with its best window (the first of
    equals); ``start`` counts words from 0.  A document shorter than the item
    is one window of all its words.  An item of fewer than five words
    is one shingle of all its words, and matches where a document is that
    sequence.  Null and empty texts, and empty tables, match nothing; repeated
    rows of a document give one row.
    """
    known = written(items(benchmark).withColumn("item_key", F.xxhash64("item")), "items")
    entries = known.select("item_id", "item_key", "m", F.inline(counts_of(F.col("item"))))
    wanted = written(entries.select("hash").distinct(), "wanted")
    #: Equal texts are compared once.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    worded = once(texts, "words", word_list(F.col("text"))).drop("text")
    hashed = lambda df: once(df.withColumn("n_words", F.size("words")), "shingles", shingle_hashes(F.col("words"))).drop("words")
    #: Spark broadcasts the benchmark's shingles, and the texts that have any, while they are few by their files' size; else it joins by shuffles.
    hit = written(hashed(worded.drop("doc_id")).select("text_key", F.explode("shingles").alias("hash")).join(wanted, "hash", "left_semi").select("text_key").distinct(), "hit")
    some = texts.join(hit, "text_key", "left_semi")
    held = written(hashed(once(some, "words", word_list(F.col("text"))).drop("text")).select("doc_id", "text_key", "n_words", "shingles"), "held")
    once_each = held.dropDuplicates(["text_key"]).select("text_key", "n_words", "shingles")
    met = once_each.select("text_key", "n_words", F.posexplode("shingles").alias("i", "hash")).join(entries, "hash")
    best = written(best_windows(met, once_each, known, similarity), "best")
    named = held.select("doc_id", "text_key").distinct().join(best, "text_key")
    #: Different texts of one id may hold the same item.
    first = F.max_by(F.struct("start", "length", "similarity"), F.struct("similarity", -F.col("start"))).alias("w")
    return named.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "w.start", "w.length", "w.similarity")


def best_windows(met: DataFrame, texts: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Best windows (text_key, item_id, start, length, similarity) from ``met``: a row for each place i of a text
    (text_key, n_words) with a shingle (hash) that an item (item_id, item_key, m) has n times.

    A window's common shingles are counted by their places alone: of equal ones as many as the item has, so a
    place counts where the n-th equal one before it (``q``) lies before the window.  The count grows only
    where a window's last shingle is a shared one, so those windows, and the document's first, hold the best.
    """
    met = met.filter((F.col("m") >= SHINGLE_WORDS) | (F.col("n_words") == F.col("m")))
    pair = ["text_key", "n_words", "item_id", "item_key", "m"]
    equal = met.groupBy(*pair, "hash", "n").agg(F.sort_array(F.collect_set("i")).alias("is"))
    placed = equal.select(*pair, F.transform("is", lambda p, j: F.struct(p.alias("p"), F.when(j >= F.col("n"), F.get("is", j - F.col("n"))).otherwise(-1).alias("q"))).alias("places"))
    spans = placed.groupBy(*pair).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    of_words = lambda c: F.greatest(c - (SHINGLE_WORDS - 1), F.lit(1))
    sized = spans.select("text_key", "item_id", "item_key", "n_words", "m", "places", of_words(F.least("m", "n_words")).alias("span"), of_words(F.col("m")).alias("wanted"))
    value = lambda common: common / (F.col("span") + F.col("wanted") - common)
    #: A pair with too few shared places in all is done with.
    able = sized.filter(value(F.least(F.size("places"), "span")) >= similarity)
    first = lambda k: F.greatest(F.get("places", k)["p"] - F.col("span") + 1, F.lit(0))
    prints = once(known.select("item_key", "item").dropDuplicates(["item_key"]), "prints", F.transform(F.array(*map(F.lit, range(FINGERPRINTS))), lambda t: fingerprint(F.col("item"), t))).drop("item")
    radius = radius_for(similarity)

    def close(k: Column) -> Column:
        window = F.slice("shingles", first(k) + 1, F.col("span"))
        return F.exists(F.array(*map(F.lit, range(FINGERPRINTS))), lambda t: near(fingerprint(window, t), F.get("prints", t), radius))

    with_prints = able.join(prints, "item_key").join(texts.select("text_key", "shingles"), "text_key")
    #: From the last window on, as most of a passage's shingles are behind its later ones.
    candidates = with_prints.filter(F.exists(F.sequence(F.size("places") - 1, F.lit(0)), close)).drop("shingles", "prints")
    ends = candidates.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("places") - 1)))
    seen = ends.withColumn("start", first(F.col("k"))).withColumn("near", F.slice("places", F.greatest(F.col("k") - F.col("span") + 2, F.lit(1)), F.least(F.col("span"), F.col("k") + 1)))
    common = F.size(F.filter("near", lambda x: (x["p"] >= F.col("start")) & (x["q"] < F.col("start"))))
    pairs = seen.select("text_key", "item_id", "start", F.least("m", "n_words").alias("length"), value(common).alias("similarity")).filter(F.col("similarity") >= similarity)
    best = pairs.groupBy("text_key", "item_id").agg(F.max_by(F.struct("start", "length", "similarity"), F.struct("similarity", -F.col("start"))).alias("w"))
    return best.select("text_key", "item_id", F.col("w.start").cast("long").alias("start"), F.col("w.length").cast("long").alias("length"), F.col("w.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all their columns, without those that hold an item; rows of a null id stay.

    The ids found are a table of their own: the driver is done with the matching's plan, its largest, before
    the documents are read again, and few ids are sent to the documents rather than these dealt out by id.
    """
    found = written(matches(docs, benchmark, similarity).filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_held_id")).distinct(), "found")
    return docs.join(found, docs["doc_id"] == found["_held_id"], "left_anti")
