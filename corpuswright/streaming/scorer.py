"""Structured Streaming: score documents as they arrive, or append their features to a store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import ClassifierModel
from ..sources.feature_store import FeatureStore, tokenize


def score_stream(docs: DataFrame, model: ClassifierModel, path: str, checkpoint: str, strategy: str | None = None) -> StreamingQuery:
    """Scores each micro-batch (doc_id, text) by the batch operators and appends Parquet; a batch is
    written under its own number, so that one run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select("doc_id", "text")
        scores = model.transform(batch, tokenize(batch, strategy or model.parameters.strategy))
        scores.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_stream(docs: DataFrame, store: FeatureStore, checkpoint: str, strategy: str = "html") -> StreamingQuery:
    """Appends each micro-batch (doc_id, text, label) to the store, under a name of the checkpoint and the
    batch's number, so that one run again replaces what it wrote."""
    name = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, batch["label"], strategy, batch=f"stream-{name}-{number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
