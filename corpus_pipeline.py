"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import decontamination, langid, near_copies, packing
from corpuswright.llm import toxicity as toxic
from corpuswright.llm._spark import fresh, shared_folder, table

#: A document is rejected if its windows' probabilities of being in some language rather than noise are less than this
#: on (geometric) average, as one without a letter is.
LANGUAGE_CONFIDENCE = 0.1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not find toxic; it learns from all labels.

    A null or empty text scores as empty; rows of a null id and repeated rows are scored as any; no documents give none.
    """
    machine = toxic.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh()
    return docs.withColumn(name, toxic.scorer(machine)(F.coalesce("text", F.lit("")))).filter(F.col(name) < toxic.THRESHOLD).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose windows the network does not take for noise, at any length; mixed languages stay.

    A null text and one without a letter go; rows of a null id and repeated rows are judged as any; no documents give none.
    """
    net = langid.fit(docs)
    name = fresh()
    scored = docs.withColumn(name, langid.predictor(net)("text"))
    return scored.filter((F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["confidence"] >= LANGUAGE_CONFIDENCE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: that of the smallest id; what it links with nothing stays.

    Texts that are null or without a word are linked with nothing and all stay; of rows that repeat one stays; no documents give none.
    """
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay, as do rows of a null id; an empty benchmark removes nothing; no documents give none.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row a piece.

    A null or empty text is its end's id alone; repeated rows are packed as often as they occur; no documents give no rows.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: Trained models and packing by evolution are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
