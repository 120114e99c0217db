"""Append-only store of labelled feature sets: Parquet rows (doc_id, label, features)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import feature_hash
from ..functions.text import feature_set, genotypes, lenient_points, skip_grams, substrings, tokens
from ..operators import html

def _joined(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def plain_symbols(text: Column) -> Column:
    grams = F.transform(skip_grams(tokens(text)), lambda g: _joined("w", g["tok"], F.when(g["distance"] > 0, F.concat(g["distance"].cast("string"), F.lit("|"), g["prev"]))))
    return F.concat(grams, F.transform(lenient_points(text), lambda c: _joined("point", c.cast("string"))))


#: Tokenizers by name: symbolic features (``kind|a|b`` strings) of a text column; None: the HTML parser, which takes whole rows.
_tokenizers: dict[str, Callable[[Column], Column] | None] = {
    "plain": plain_symbols, "html": None, "substrings": lambda text: F.transform(substrings(text), lambda s: _joined("s", s)),
    "23andme": lambda text: F.transform(genotypes(text), lambda g: _joined("g", g["chrom"], g["pos"], g["alleles"])),
}


def register_tokenizer(name: str, symbols: Callable[[Column], Column]) -> None:
    """Adds a tokenizer: a function from a text column to an array<string> column of features."""
    if name in _tokenizers:
        raise ValueError(f"already registered: {name}")
    _tokenizers[name] = symbols


def strategies() -> tuple[str, ...]:
    return tuple(_tokenizers)


def symbols(strategy: str, text: Column) -> Column:
    """Symbolic features of a text, for all strategies but html."""
    if (found := _tokenizers.get(strategy)) is None:
        raise ValueError(f"no such strategy: {strategy}")
    return found(text)


def tokenize(docs: DataFrame, strategy: str = "html", hashed: bool = True) -> DataFrame:
    """(doc_id, feature), repeated as features occur, from rows (doc_id, text); hashes or symbols."""
    if strategy == "html":
        rows = html.html_features(docs, "doc_id", "text").withColumn("feature", F.concat_ws("|", "kind", "a", "b")).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.explode(F.array_repeat("feature", F.col("n").cast("int"))).alias("feature"))
    else:
        rows = docs.select("doc_id", F.explode(symbols(strategy, F.col("text"))).alias("feature"))
    return rows.withColumn("feature", feature_hash("feature")).filter("feature <> 0") if hashed else rows


class FeatureStore:
    """Two folders: ``data/attempt=<id>`` of rows, and ``commits/commit=<id>`` of what was done, one file each, written last.

    Readers see rows that a commit names, so an append that is broken off leaves none, and appends that
    run at once do not touch each other's files.  A batch's newest append counts; its rows are in the
    folder that last took them over (see ``compact``).  Newest is by the clocks of the drivers that append.
    Commits are as many as appends, and Spark joins the rows' folders with them, so those of others are not read.
    """

    _ROWS = "doc_id string, label float, features array<long>, part string, attempt string"
    _COMMITS = "batch string, part string, moved array<string>, at long, commit string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _commit(self, attempt: str, batch: str | None, moved: list[str]) -> None:
        row = self.spark.createDataFrame([(batch, attempt, moved, time.time_ns())], self._COMMITS.rsplit(",", 1)[0])
        row.coalesce(1).write.parquet(f"{self.path}/commits/commit={attempt}")

    def append(self, docs: DataFrame, label: Column | float, strategy: str = "html", unique: bool = True, strict: bool = False, batch: str | None = None) -> int:
        """Adds documents (doc_id, text); those without a feature are skipped, or refused if ``strict``.  Returns how many were added.

        In the store each row has an id of its own, of its batch's name and a
        number, so that documents of one name stay apart.  A batch of the same name is replaced.
        """
        attempt = uuid.uuid4().hex
        batch = batch or attempt
        label = label if isinstance(label, Column) else F.lit(float(label))
        #: Kept, as the ids are read twice.
        rows = docs.select(F.concat(F.lit(f"{batch}:"), F.monotonically_increasing_id().cast("string")).alias("doc_id"), "text", label.cast("float").alias("label")).persist()
        try:
            sets = tokenize(rows, strategy).groupBy("doc_id").agg(feature_set(F.collect_list("feature"), unique).alias("features"))
            both = rows.select("doc_id", "label").join(sets, "doc_id", "left")
            if strict and not both.filter("features is null").isEmpty():
                raise ValueError("a document has no features")
            added = Observation()
            kept = both.filter("features is not null").withColumn("part", F.lit(attempt))
            kept.observe(added, F.count("*").alias("n")).write.parquet(f"{self.path}/data/attempt={attempt}")
            self._commit(attempt, batch, [])
            return added.get["n"]
        finally:
            rows.unpersist()

    def compact(self) -> None:
        """Copies all rows that count into one folder, in files of a size that Spark chooses.

        Appends may run beside it: a batch that is replaced meanwhile stays replaced.  Folders
        that no longer count are left to delete.
        """
        if not self._begun():
            return
        homes = self._homes().collect()  # two short ids a batch
        attempt = uuid.uuid4().hex
        rows = self._rows(self.spark.createDataFrame(homes, "part string, attempt string"))
        rows.drop("attempt").hint("rebalance").write.parquet(f"{self.path}/data/attempt={attempt}")
        self._commit(attempt, None, [r["part"] for r in homes])

    def _homes(self) -> DataFrame:
        """(part, attempt): each batch's newest append, and the folder where its rows are."""
        commits = self.spark.read.schema(self._COMMITS).parquet(f"{self.path}/commits")
        newest = commits.filter("batch is not null").groupBy("batch").agg(F.max_by("part", F.struct("at", "part")).alias("part"))
        moves = commits.filter("batch is null").select(F.explode("moved").alias("part"), F.struct("at", F.col("commit").alias("to")).alias("move"))
        last = moves.groupBy("part").agg(F.max("move").alias("move"))
        return newest.join(last, "part", "left").select("part", F.coalesce("move.to", "part").alias("attempt"))

    def _rows(self, homes: DataFrame) -> DataFrame:
        return self.spark.read.schema(self._ROWS).parquet(f"{self.path}/data").join(homes, ["attempt", "part"], "left_semi")

    def _begun(self) -> bool:
        try:
            self._homes()
            return True
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise

    def count(self) -> int:
        return self.read().count() if self._begun() else 0

    def read(self) -> DataFrame:
        return self._rows(self._homes()).select("doc_id", "label", "features")

    def features(self) -> DataFrame:
        """(doc_id, feature) rows."""
        return self.read().select("doc_id", F.explode("features").alias("feature"))

    def labels(self) -> DataFrame:
        return self.read().select("doc_id", "label")
