"""Document frequency, dictionaries and contingency tables over long rows (doc_id, feature, extra)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import weight
from .tables import written


def binarized(labels: DataFrame, label: str, class_threshold: float = 0.0) -> DataFrame:
    """(doc_id, y): 1 above the threshold, else -1; rows of a null label are left out."""
    return labels.filter(F.col(label).isNotNull()).select("doc_id", F.when(F.col(label) > class_threshold, 1).otherwise(-1).alias("y"))


def feature_counts(features: DataFrame) -> DataFrame:
    """(doc_id, feature, extra): one row a pair; ``extra`` is occurrences less one, at most 255."""
    return features.groupBy("doc_id", "feature").agg(F.least(F.lit(255), F.count("*") - 1).cast("smallint").alias("extra"))


def listed(texts: DataFrame, features: Column, distinct: bool = True) -> DataFrame:
    """(doc_id, w): a row a document, ``w`` all features of its rows, each once if ``distinct``; rows without a doc_id are left out.

    Lists are shuffled, not a row a feature, and what is made of a document's features stays where the list is.
    """
    each = texts.filter("doc_id is not null").select("doc_id", (F.array_distinct(features) if distinct else features).alias("w"))
    joined = F.flatten(F.collect_list("w"))
    return each.groupBy("doc_id").agg((F.array_distinct(joined) if distinct else joined).alias("w"))


def list_features(lists: DataFrame) -> DataFrame:
    """(doc_id, feature) of ``listed`` documents."""
    return lists.select("doc_id", F.explode("w").alias("feature"))


def list_counts(lists: DataFrame) -> DataFrame:
    """``feature_counts`` of ``listed`` documents: runs of equal features in each sorted list, so no table of pairs is held or shuffled."""
    ordered = lists.filter(F.size("w") > 0).select("doc_id", F.explode(F.array(F.array_sort("w"))).alias("w"))
    first = lambda i: (i == 1) | (F.element_at("w", i) != F.element_at("w", F.greatest(i - 1, F.lit(1))))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), first)
    begun = ordered.select("doc_id", "w", F.explode(F.array(starts)).alias("s"))
    run = lambda at, k: F.struct(F.element_at("w", at).alias("feature"), F.least(F.lit(255), F.coalesce(F.get("s", k + 1), F.size("w") + 1) - at - 1).cast("smallint").alias("extra"))
    return begun.select("doc_id", F.inline(F.transform("s", run)))


def document_frequency(features: DataFrame) -> DataFrame:
    """(feature, df) from rows distinct by (doc_id, feature)."""
    return features.groupBy("feature").agg(F.count("*").alias("df"))


def vocabulary(features: DataFrame, threshold: int = 2) -> DataFrame:
    """Features in at least so many documents."""
    if threshold < 1:
        raise ValueError("the minimum document frequency is 1 or more")
    return document_frequency(features).filter(F.col("df") >= threshold)


def dictionary(vocab: DataFrame) -> DataFrame:
    """(feature, idx): dense ids from 1, ascending by feature.

    Ranks are counted within range partitions and offset by the partitions'
    sizes, so no task sorts the whole vocabulary.  Ranges are found by sampling, which
    may differ the next time, so ranks are written before sizes are counted.
    """
    spark = vocab.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = vocab.select("feature").distinct().repartitionByRange(n, "feature").sortWithinPartitions("feature")
    placed = ordered.select("feature", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).withColumn("rank", F.col("id") - F.shiftleft(F.col("part").cast("long"), 33))
    placed = written(placed, "dictionary")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("feature", (F.col("before") + F.col("rank") + 1).alias("idx"))


def known_only(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose feature is in the vocabulary; Spark broadcasts it only below its size threshold."""
    return features.join(vocab.select("feature"), "feature", "left_semi")


def contingency(features: DataFrame, y: DataFrame) -> DataFrame:
    """(feature, tp, fp): positive and negative documents with the feature."""
    return features.join(y, "doc_id").groupBy("feature").agg(F.count_if(F.col("y") > 0).alias("tp"), F.count_if(F.col("y") < 0).alias("fp"))


def class_sizes(y: DataFrame) -> DataFrame:
    """One row (pos, neg), over all labelled documents."""
    return y.agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") < 0).alias("neg"))


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row with the one row of totals (a broadcast of a single row)."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def weights(features: DataFrame, y: DataFrame, kind: str = "log-odds", threshold: int = 2, min_count: float = 0.1) -> DataFrame:
    """(feature, weight) of the features with enough support."""
    table = with_totals(contingency(features, y), class_sizes(y)).filter(F.col("tp") + F.col("fp") >= threshold)
    return table.select("feature", weight(kind, F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg"), threshold, min_count).alias("weight"))


def count_thresholds(counts: DataFrame, y: DataFrame, kind: str = "log-odds", threshold: int = 2, min_count: float = 0.1) -> DataFrame:
    """(feature, weight, min_extra): per feature the "extra >= v" whose weight is largest by size; the larger v of equals."""
    levels = counts.join(y, "doc_id").groupBy("feature", "extra").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") < 0).alias("q"))
    down = Window.partitionBy("feature").orderBy(F.desc("extra")).rowsBetween(Window.unboundedPreceding, 0)
    sums = with_totals(levels.select("feature", "extra", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp")), class_sizes(y))
    valued = sums.select("feature", "extra", weight(kind, F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg"), threshold, min_count).alias("w"))
    best = valued.groupBy("feature").agg(F.max_by(F.struct("w", "extra"), F.struct(F.round(F.abs("w"), 9), "extra")).alias("b"))
    none = F.col("b.w") == 0
    return best.select("feature", F.col("b.w").alias("weight"), F.when(none, 0).otherwise(F.col("b.extra")).cast("smallint").alias("min_extra"))


@dataclass(frozen=True)
class Part:
    """A training set of documents with classes: those of ``topic`` (a place in their ``topics``) against all others, without fold ``held`` (-1: all)."""

    topic: int
    held: int = -1


def part_sizes(docs: DataFrame, parts: list[Part]) -> list[tuple[int, int]]:
    """(positives, negatives) of each part's training set, of documents (doc_id, fold, topics array<int>); one number a topic and fold is collected."""
    rows = docs.select("fold", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct("topics"))).alias("topic")).groupBy("fold", "topic").agg(F.count("*").alias("n")).collect()
    of = lambda p, t: sum(r["n"] for r in rows if r["topic"] == t and r["fold"] != p.held)
    return [(of(p, p.topic), of(p, -1) - of(p, p.topic)) for p in parts]


def part_weights(counts: DataFrame, docs: DataFrame, parts: list[Part], kind: str = "log-odds", threshold: int = 2, min_count: float = 0.1, levels: bool = False) -> DataFrame:
    """(feature, weights array<double>, mins array<smallint>): each part's weight of a feature, and least ``extra`` that counts.

    One grouped count by feature, fold and topic serves all parts: a training set's table is the total less the held fold's.
    ``counts``: (doc_id, feature, extra), one row a pair; ``docs``: (doc_id, fold, topics).  Without ``levels`` any ``extra`` counts.
    Features without a weight in any part are left out.
    """
    sizes = part_sizes(docs, parts)
    extra = F.col("extra") if levels else F.lit(0).cast("smallint").alias("extra")
    marked = docs.select("doc_id", "fold", F.concat(F.array(F.lit(-1)), F.array_distinct("topics")).alias("_of"))
    seen = counts.select("doc_id", "feature", extra).join(marked, "doc_id").select("feature", "extra", "fold", F.explode("_of").alias("topic"))
    held = sorted({p.held for p in parts})
    inside = lambda h: (F.col("fold") != h)
    totals = [F.sum(F.when((F.col("topic") == -1) & inside(h), F.col("n"))).alias(f"_all{h}") for h in held]
    of_topic = [F.sum(F.when((F.col("topic") == p.topic) & inside(p.held), F.col("n"))).alias(f"_p{i}") for i, p in enumerate(parts)]
    tables = seen.groupBy("feature", "extra", "fold", "topic").agg(F.count("*").alias("n")).groupBy("feature", "extra").agg(*totals, *of_topic)
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    pair = lambda i: F.struct(number(F.col(f"_p{i}")).alias("p"), number(F.col(f"_all{parts[i].held}")).alias("all"))

    def value(p: Column, all_: Column, pos: Column, neg: Column) -> Column:
        return weight(kind, p, all_ - p, pos, neg, threshold, min_count)

    if not levels:
        each = [F.when(pair(i)["all"] > 0, value(pair(i)["p"], pair(i)["all"], F.lit(pos), F.lit(neg))).otherwise(0.0) for i, (pos, neg) in enumerate(sizes)]
        rows = tables.select("feature", F.array(*each).alias("weights")).withColumn("mins", F.array_repeat(F.lit(0).cast("smallint"), len(parts)))
    else:
        sized = F.array(*[F.struct(F.lit(a).alias("pos"), F.lit(b).alias("neg")) for a, b in sizes])
        spread = tables.select("feature", "extra", F.posexplode(F.array(*[pair(i) for i in range(len(parts))])).alias("part", "_p"))
        down = Window.partitionBy("feature", "part").orderBy(F.desc("extra")).rowsBetween(Window.unboundedPreceding, 0)
        summed = spread.select("feature", "part", "extra", F.sum("_p.p").over(down).alias("p"), F.sum("_p.all").over(down).alias("all"), F.get(sized, F.col("part")).alias("_s"))
        valued = summed.select("feature", "part", "extra", F.when(F.col("all") > 0, value(F.col("p"), F.col("all"), F.col("_s.pos"), F.col("_s.neg"))).otherwise(0.0).alias("w"))
        best = valued.groupBy("feature", "part").agg(F.max_by(F.struct("w", "extra"), F.struct(F.round(F.abs("w"), 9), "extra")).alias("b"))
        least = F.when(F.col("b.w") == 0, 0).otherwise(F.col("b.extra")).cast("smallint")
        listed = best.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("part", F.col("b.w").alias("w"), least.alias("least")))).alias("_l"))
        rows = listed.select("feature", F.col("_l.w").alias("weights"), F.col("_l.least").alias("mins"))
    return rows.filter(F.exists("weights", lambda w: w != 0))


#: Counters of a sketch are 2 to this many, in stretches of 2 to that many.
SKETCH_BITS, STRETCH_BITS = 22, 16


def candidates(rows: DataFrame, keys: list[str], threshold: int = 2, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows whose keys may occur ``threshold`` times: all that do, and those that share a counter with others.

    A first pass counts hashes of keys, up to 255, in a sketch of fixed size a task; sketches are added, and what comes of
    them, a bit a counter (0.5 MB in all), is broadcast.  So keys that are too rare are gone before rows are shuffled by key.
    """
    if not 1 <= threshold <= 255:
        raise ValueError("a counter counts to 255")
    stretch = 1 << STRETCH_BITS
    counter = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            which, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            total[which] = np.minimum(255, total[which] + n)
        for i in range(0, 1 << bits, stretch):
            part = total[i : i + stretch]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i >> STRETCH_BITS], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["stretch", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None
        for batch in parts:
            for i, raw in zip(batch.column("stretch").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(raw.as_buffer(), np.uint8)
                if i != number:
                    if number is not None:
                        yield marked(number, total)
                    number, total = i, np.zeros(len(counts), np.uint16)
                total = np.minimum(255, total + counts)
        if number is not None:
            yield marked(number, total)

    def marked(number: int, total: np.ndarray) -> pa.RecordBatch:
        words = np.packbits(total >= threshold, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([words])], names=["stretch", "marks"])

    sketches = rows.select(counter.alias("c")).mapInArrow(count, "stretch long, counts binary")
    marks = sketches.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(add, "stretch long, marks array<long>")
    place = F.col("_counter").bitwiseAND(F.lit(stretch - 1)).cast("int")
    met = rows.withColumn("_counter", counter).join(F.broadcast(marks.withColumnRenamed("stretch", "_stretch")), F.shiftright("_counter", STRETCH_BITS) == F.col("_stretch"))
    word = F.get("marks", F.shiftright(place, 6))
    return met.filter(F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)
