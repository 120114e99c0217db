"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch keeps the ``k`` smallest of a text's distinct 64-bit shingle hashes.
Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles.  A text of at
most ``k`` distinct shingles is kept whole, so its estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions
from ._words import pieces, shingle_sets

#: Hashes in a sketch; the standard error of a likeness is at most 0.5 / sqrt(K).
K = 256
#: Buckets of consecutive ids for each shuffle partition.
BUCKETS_PER_PARTITION = 8


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """One ascending uint64 array of at most k hashes for each text; an empty text has none."""
    return [s[:k] for s in shingle_sets(texts)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike (1), an empty and another are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(same)
    if union <= k:
        return len(same) / union
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    last = both[new][k - 1]
    return int(np.searchsorted(same, last, "right")) / k


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too (1 for an empty a)."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return min(1.0, common / distinct(a, k))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ascending (doc_id, text) order within buckets of consecutive ids.

    One shuffle moves each text once.  The first document of every bucket is
    also sent, as a ghost, to the bucket before (of the first, to the last), so
    that a sorted partition holds the successor of each of its documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    keys = rows.select("key")
    cuts = keys.agg(F.percentile_approx("key", [i / (n * BUCKETS_PER_PARTITION) for i in range(1, n * BUCKETS_PER_PARTITION)], 20 * n * BUCKETS_PER_PARTITION)).first()[0]
    cuts = sorted(set(cuts or []))

    @F.arrow_udf("long")
    def bucket(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(cuts, np.int64), key.to_numpy(zero_copy_only=False)))

    firsts = {r[0]: r[1] for r in keys.groupBy(bucket("key").alias("b")).agg(F.min("key")).collect()}
    order = sorted(firsts)
    ghosts = {firsts[b]: order[i - 1] for i, b in enumerate(order)}

    @F.arrow_udf("array<struct<bucket: long, ghost: boolean>>")
    def placed(key: pa.Array) -> pa.Array:
        own = np.searchsorted(np.array(cuts, np.int64), key.to_numpy(zero_copy_only=False))
        places = [[{"bucket": b, "ghost": False}] + ([{"bucket": ghosts[k], "ghost": True}] if k in ghosts else []) for b, k in zip(own.tolist(), key.to_pylist())]
        return pa.array(places, pa.list_(pa.struct([("bucket", pa.int64()), ("ghost", pa.bool_())])))

    return rows.withColumn("at", placed("key")).select("key", "doc_id", "text", F.inline("at")).repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", "key", "text").select("bucket", "ghost", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document's, by ascending doc_id; the last
    document's next is the first.  Nulls are empty texts; rows of one doc_id
    are ordered by text and a null doc_id comes last; an empty text has an
    empty fingerprint; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for whole in batches:
            for a, b in pieces(whole.column("text")):
                rows = pa.Table.from_batches([whole.slice(a, b - a)])
                rows = rows if carried is None else pa.concat_tables([carried, rows])
                yield _scored(rows, k)
                carried = rows.slice(len(rows) - 1)

    return with_next(docs).mapInArrow(run, SCHEMA)


def _scored(rows: pa.Table, k: int) -> pa.RecordBatch:
    texts, ids = rows.column("text").to_pylist(), rows.column("doc_id").to_pylist()
    buckets, ghosts = rows.column("bucket").to_pylist(), rows.column("ghost").to_pylist()
    kept = [i for i in range(len(texts) - 1) if not ghosts[i] and buckets[i] == buckets[i + 1]]
    edited = []
    for i in kept:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    marks = sketches(rows.column("text"), k) if kept else []
    changed = sketches(pa.array(edited, pa.large_string()), k) if kept else []
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = [
        pa.array([ids[i] for i in kept], pa.int64()), pa.array([len(texts[i]) for i in kept], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([encode(marks[i]) for i in kept], pa.string()), pa.array([encode(s) for s in changed], pa.string()),
        pa.array([resemblance(marks[i], s, k) for i, s in zip(kept, changed)], pa.float64()),
        pa.array([resemblance(marks[i], marks[i + 1], k) for i in kept], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)
