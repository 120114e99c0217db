"""Token counts from flat token streams by a separator scan.

A flat stream is nothing but fixed-width ids with an end-of-document id after
each document: no index says where documents lie.  Blocks of a stream are
searched for separators in parallel, one vectorised comparison a block.  Each
block then reports three numbers, and a prefix scan over those reports carries
the open document across block borders, however many blocks it spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, written
from .tokens import TOKENIZER_FILE, encoder

END_ID = 49407
BLOCK_IDS = 1 << 16
WIDTH = 2
BLOCKS = "stream long, block long, ids binary"
REPORTS = "stream long, block long, n_ids long, n_ends long, head long, tail long, inner array<int>"


def flat_streams(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """(stream, block, ids): flat streams of little-endian uint16 ids, cut every ``block_ids`` ids wherever a
    document stands, and written to the shared folder.

    A stream holds the documents of one piece of one input file, in their order, and is named by a hash of both;
    rows that come from no file are one stream a partition, named by its number.  A null text is an empty
    document.  A separator's name within a text is ordinary text, so that the separator's id cannot arise from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, plain=True)
        stream, kept, size, block = None, [], 0, 0

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal kept, size, block
            flat = np.concatenate(kept) if kept else np.zeros(0, np.uint16)
            whole = len(flat) // block_ids
            parts = [flat[i * block_ids : (i + 1) * block_ids] for i in range(whole)]
            rest = flat[whole * block_ids :].copy()
            if last and len(rest):
                parts, rest = [*parts, rest], rest[:0]
            out = pa.RecordBatch.from_arrays([pa.array([stream] * len(parts), pa.int64()), pa.array(range(block, block + len(parts)), pa.int64()), pa.array([p.astype("<u2").tobytes() for p in parts], pa.binary())], names=["stream", "block", "ids"])
            kept, size, block = [rest], len(rest), block + len(parts)
            return out

        for batch in batches:
            names, text = batch.column("stream").to_numpy(), batch.column("text")
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)] if len(names) else []
            for a, b in zip(edges, edges[1:]):
                if stream is not None and stream != names[a]:
                    yield cut(True)
                    kept, size, block = [], 0, 0
                stream = int(names[a])
                for ids, counts in encode(text.slice(a, b - a)):
                    kept.append(np.insert(ids, np.cumsum(counts), end_id).astype(np.uint16))
                    size += len(kept[-1])
                    if size >= 16 * block_ids:
                        yield cut(False)
        yield cut(True)

    name = F.when(F.input_file_name() == "", F.spark_partition_id().cast("long")).otherwise(F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    return written(docs.select("text", name.alias("stream")).mapInArrow(run, BLOCKS), "streams")


def read_flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, width: int = WIDTH) -> DataFrame:
    """(stream, block, ids) of flat token files, through Spark's binaryFile reader (any store that
    Spark reads; a file holds at most 2 GB and is cut in one task).  The stream number is a hash of the file's path.
    A file whose length is no multiple of the id width is refused."""
    step = block_ids * width
    content = F.when(F.col("length") % width == 0, F.col("content")).otherwise(F.raise_error(F.lit("not a whole number of ids")))
    #: Cut before the blocks become rows, so that no row but the file's own carries its bytes.
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step)), lambda i: F.substring(content, (i * step + 1).cast("int"), F.lit(step)))
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    return files.select(F.xxhash64("path").alias("stream"), F.posexplode(blocks).alias("block", "ids")).withColumn("block", F.col("block").cast("long"))


def scan(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Per block: ids, separators, ids before the first and after the last, and the gaps between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                none = not len(ends)
                rows.append((len(ids), len(ends), len(ids) if none else int(ends[0]), len(ids) if none else len(ids) - 1 - int(ends[-1]), (np.diff(ends) - 1).astype(np.int32)))
            n, k, head, tail, inner = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (n, k, head, tail)), pa.array(list(inner), pa.list_(pa.int32()))], names=[f.split()[0] for f in REPORTS.split(", ")])

    return blocks.select("stream", "block", "ids").mapInArrow(run, REPORTS)


def stitch(reports: DataFrame) -> DataFrame:
    """(stream, doc_no, start, n_tokens) for every document from the blocks' reports.

    The scan runs over one row a block.  Where a block's first separator closes
    a document that began earlier, its length is this block's head plus all ids
    since the last earlier separator: the running id count minus the running
    maximum of "ids up to the last separator".  A last document without a
    separator counts if it has ids.
    """
    upto = Window.partitionBy("stream").orderBy("block")
    past = upto.rowsBetween(Window.unboundedPreceding, -1)
    at = reports.withColumn("base", F.coalesce(F.sum("n_ids").over(past), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n_ends").over(past), F.lit(0)))
    at = at.withColumn("after_end", F.when(F.col("n_ends") > 0, F.col("base") + F.col("n_ids") - F.col("tail")))
    at = at.withColumn("open_at", F.coalesce(F.max("after_end").over(past), F.lit(0))).withColumn("is_last", F.lead("block").over(upto).isNull())
    first = F.col("base") + F.col("head")
    closing = F.when(F.col("n_ends") > 0, F.array(F.struct(F.col("docs_before").alias("doc_no"), F.col("open_at").alias("start"), (first - F.col("open_at")).alias("n_tokens")))).otherwise(F.array())
    tail_start = F.coalesce(F.col("after_end"), F.col("open_at"))
    total = F.col("base") + F.col("n_ids")
    unfinished = F.when(F.col("is_last") & (total > tail_start), F.array(F.struct((F.col("docs_before") + F.col("n_ends")).alias("doc_no"), tail_start.alias("start"), (total - tail_start).alias("n_tokens")))).otherwise(F.array())
    edges = at.select("stream", F.inline(F.concat(closing, unfinished)))
    inner = at.select("stream", F.posexplode("inner").alias("i", "n"), "docs_before", first.alias("first"), "block")
    order = Window.partitionBy("stream", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.select("stream", (F.col("docs_before") + 1 + F.col("i")).alias("doc_no"), (F.col("first") + 1 + F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0))).alias("start"), F.col("n").cast("long").alias("n_tokens"))
    return edges.unionByName(inner)


def token_counts(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Token count of every document in the streams; empty documents count 0, an empty table gives no rows."""
    return stitch(checkpointed(scan(blocks, end_id, width)))
