"""Corpus readers: SGML news collections, and zip archives of pages with a CSV of labels."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.html import CONTENT, Node, parse

SGML = "source string, test boolean, skip boolean, topics array<string>, date string, text string"


def sgml_documents(page: str) -> Iterator[tuple[bool, bool, list[str], str, str]]:
    """(test, skip, topics, date, text) of every REUTERS element; marks in its text are escaped again."""
    doc = parse(page)
    below: dict[int, list[Node]] = {}
    for node in doc.nodes[1:]:
        below.setdefault(id(node.parent), []).append(node)

    def text(node: Node) -> str:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x.name == CONTENT:
                out.append(x.content)
            stack.extend(reversed(below.get(id(x), [])))
        return "".join(out)

    for node in doc.nodes:
        if node.name != "REUTERS":
            continue
        split = node.attribute("LEWISSPLIT") or ""
        topics, date, body = [], "", ""
        for child in below.get(id(node), []):
            if child.name == "TOPICS":
                topics = [text(d) for d in below.get(id(child), []) if d.name == "D"]
            elif child.name == "DATE":
                date = text(child).strip()
            elif child.name == "TEXT":
                body = text(child).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        yield split == "TEST", split not in ("TEST", "TRAIN") or not topics, topics, date, body


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name, *d) for d in sgml_documents(bytes(raw).decode("latin-1"))], columns=[f.split()[0] for f in SGML.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SGML)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the members of zip archives; empty ones have an empty content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, content binary")


def labelled_zip(spark: SparkSession, archives: str, labels_csv: str, label: str = "sponsored") -> DataFrame:
    """(file, content, label) of labelled members with content, joined by base name."""
    labels = spark.read.schema(f"file string, {label} int").csv(labels_csv, header=True)
    return read_zip(spark, archives).filter(F.length("content") > 0).join(labels, "file").withColumnRenamed(label, "label")


def write_submission(scores: DataFrame, path: str, label: str = "sponsored") -> None:
    """CSV with a header: file and score."""
    scores.select(F.col(scores.columns[0]).alias("file"), F.col(scores.columns[1]).alias(label)).write.mode("overwrite").csv(path, header=True)
