"""Best-fit packing of token pieces by a grouping genetic algorithm.

A document's ids end with id 0 and are cut into pieces of ``capacity``; full
pieces fill a sequence alone.  The others are dealt over shards of bounded size
by a hash of their key, so no document or source makes a shard large.  Every
shard is evolved by several islands: a chromosome is a list of bins, crossover
injects whole well-filled bins of one parent into another, bins that hold any
injected piece are broken up, and displaced pieces go back by best fit.
Between epochs each island's elite migrates to the next island of its shard.
The poorly filled bins that shards leave are packed again over wider shards.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, lean, partitions, slim
from .tokens import TOKENIZER_FILE, encoder

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 6
#: Bins filled to less than this share are broken up and packed again over wider shards.
REPACK_BELOW = 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """One row a piece: its place in its document's ids, its length and the crc32 of its ids.

    ``salt`` tells apart rows of one doc_id (and of none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row = 0
            for ids, counts in encode(batch.column("text")):
                n = counts + 1
                flat = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
                begin = np.cumsum(n) - n
                cuts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw = memoryview(flat.tobytes())
                at = (begin[doc] + start) * 4
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(n)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), batch.column("salt").slice(row, len(n)).take(pa.array(doc))], names=[f.split()[0] for f in PIECES.split(", ")])
                row += len(n)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("salt")).mapInArrow(lean(run), PIECES)


class Bins:
    """Open bins by remaining room, for best fit."""

    def __init__(self, rooms: list[int]):
        self.order = sorted((r, i) for i, r in enumerate(rooms) if r > 0)
        self.count = len(rooms)

    def put(self, length: int, capacity: int) -> int:
        at = bisect.bisect_left(self.order, (length, -1))
        if at == len(self.order):
            room, i = capacity, self.count
            self.count += 1
        else:
            room, i = self.order.pop(at)
        if room > length:
            bisect.insort(self.order, (room - length, i))
        return i


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins with the items added, longest first, each to the fullest bin that has room."""
    open_bins = Bins([capacity - int(lengths[b].sum()) for b in bins])
    out = [list(b) for b in bins]
    for i in items[np.argsort(-lengths[items], kind="stable")].tolist():
        at = open_bins.put(int(lengths[i]), capacity)
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def fitness(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, the mean squared fill."""
    fill = np.array([lengths[b].sum() for b in bins]) / capacity
    return -len(bins), float((fill**2).mean()) if len(bins) else 0.0


def crossover(a: list[list[int]], b: list[list[int]], lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject a run of a's well-filled bins into b; drop b's bins that repeat a piece; best-fit what they held besides."""
    fill = np.array([lengths[x].sum() for x in a])
    best = np.argsort(-fill, kind="stable")[: max(1, len(a) // 2)]
    first = int(rng.integers(len(best)))
    injected = [a[i] for i in best[first : first + max(1, len(best) // 3)]]
    taken = np.zeros(len(lengths), bool)
    for x in injected:
        taken[x] = True
    kept, displaced = list(injected), []
    for x in b:
        hit = taken[x]
        if hit.any():
            displaced += [i for i, h in zip(x, hit) if not h]
        else:
            kept.append(x)
    #: A mutation: the two emptiest bins are broken up too.
    rooms = sorted(range(len(injected), len(kept)), key=lambda i: int(lengths[kept[i]].sum()))[:2]
    displaced += [i for r in rooms for i in kept[r]]
    kept = [x for i, x in enumerate(kept) if i not in set(rooms)]
    return best_fit(lengths, np.array(displaced, np.int64), kept, capacity)


def evolve(lengths: np.ndarray, capacity: int, seed: int, guests: list[list[list[int]]], crossovers: int = CROSSOVERS, population: int = POPULATION) -> list[list[int]]:
    """The best chromosome of one island after one epoch; stops where no fewer bins are possible."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    everything = np.arange(len(lengths))
    people = list(guests)
    while len(people) < population:
        if not people and not guests:
            people.append(best_fit(lengths, everything, [], capacity))
        else:
            noisy = np.argsort(-lengths * rng.uniform(0.9, 1.1, len(lengths)), kind="stable")
            open_bins, out = Bins([]), []
            for i in noisy.tolist():
                at = open_bins.put(int(lengths[i]), capacity)
                if at == len(out):
                    out.append([])
                out[at].append(i)
            people.append(out)
        if len(people[-1]) <= least:
            return people[-1]
    score = [fitness(p, lengths, capacity) for p in people]
    for _ in range(crossovers):
        x, y = rng.choice(len(people), 2, replace=False)
        if score[x] < score[y]:
            x, y = y, x
        child = crossover(people[x], people[y], lengths, capacity, rng)
        value, worst = fitness(child, lengths, capacity), min(range(len(people)), key=lambda i: score[i])
        if value > score[worst]:
            people[worst], score[worst] = child, value
        if len(child) <= least:
            break
    return people[max(range(len(people)), key=lambda i: score[i])]


def _flat(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out


def _grouped(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def _epoch(epoch: int, capacity: int, crossovers: int):
    """An Arrow function: the elite of each (shard, island) row after this epoch."""

    @F.arrow_udf("array<int>")
    def elite(shard: pa.Array, island: pa.Array, sizes: pa.Array, guests: pa.Array) -> pa.Array:
        out = []
        for s, i, n, g in zip(shard.to_pylist(), island.to_pylist(), sizes, guests):
            known = [_grouped(np.asarray(x, np.int64)) for x in g.as_py()]
            n = n.values.to_numpy().astype(np.int64)
            out.append(_flat(evolve(n, capacity, (s * 1009 + i) * 31 + epoch, known, crossovers), len(n)))
        slim()
        return pa.array(out, pa.list_(pa.int32()))

    return elite


def solve(pieces: DataFrame, shards: int, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """The pieces with ``shard`` and ``bin`` (its number within the shard)."""
    key = ["length", "doc_id", "piece", "start", "ids_crc32", "salt"]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)))
    #: A shard's lengths in a fixed order; equal rows are interchangeable.
    lengths = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))
    state = lengths.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.expr("cast(array() as array<array<int>>)").alias("guests"))
    #: A number of partitions of its own: a shard is little data but much work.
    tasks = min(shards * islands, 4 * partitions(pieces.sparkSession))
    for epoch in range(epochs):
        state = state.repartition(tasks, "shard", "island")
        epoch_of = _epoch(epoch, capacity, crossovers)
        evolved = state.withColumn("elite", epoch_of("shard", "island", "lengths", "guests"))
        if epoch < epochs - 1:  # an island keeps its elite and gets that of the island before
            sent = evolved.select("shard", "lengths", "elite", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"))
            state = sent.groupBy("shard", "island").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_set("elite")).alias("guests"))
    best = evolved.groupBy("shard").agg(F.min_by("elite", F.struct(F.array_max("elite"), "island")).alias("elite"))

    def place(group: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ascending=[False] + [True] * (len(key) - 1), kind="stable", na_position="first")
        return group.assign(bin=np.asarray(elite["elite"].iloc[0], np.int64))[[*columns, "shard", "bin"]]

    columns = [f.split()[0] for f in PIECES.split(", ")]
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, PIECES + ", shard long, bin long")


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER_FILE, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """One row a piece with its sequence and its place there.

    A null or empty text is a document of the end id alone; repeated rows are
    packed each; a null doc_id stays null; an empty table gives no rows.
    Sequences have at most ``capacity`` tokens, and offsets have no gaps.
    """
    pieces = checkpointed(cut_pieces(docs, capacity, tokenizer))
    part = pieces.filter(F.col("length") < capacity)
    n, tokens = part.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    full = pieces.filter(F.col("length") >= capacity).select(*[f.split()[0] for f in PIECES.split(", ")][:-1], (F.lit(3 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not n:
        return full
    shards = max(1, round(n / shard_pieces))
    first = checkpointed(solve(part, shards, capacity, islands, epochs, crossovers))
    fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    poor = fill.filter(F.col("fill") < REPACK_BELOW * capacity).select("shard", "bin")
    stay = first.join(poor, ["shard", "bin"], "left_anti").select("*", F.lit(1).alias("level"))
    again = checkpointed(first.join(poor, ["shard", "bin"], "left_semi").drop("shard", "bin"))
    left = again.count()
    parts = [stay]
    if left:
        parts.append(solve(again, max(1, round(left / shard_pieces)), capacity, islands, epochs, crossovers).select("*", F.lit(2).alias("level")))
    packed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    order = Window.partitionBy("level", "shard", "bin").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32", "salt").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("level").cast("long") * (1 << 60) + F.col("shard") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    return packed.unionByName(full)
