"""Command line: learn, batch-learn, analyze, classify, batch-classify and print-model."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.model import ClassifierModel, Parameters, estimator
from .sources import framed
from .sources.feature_store import FeatureStore, strategies, tokenize

_NAMES = {"cost": "C", "min_cost": "min-c", "max_iterations": "max-iter"}
_FLAGS = {"do_unique": "no-unique", "do_shuffle": "no-shuffle", "do_normalize": "no-normalize"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpuswright", description=__doc__)
    for f in fields(Parameters):
        if f.name in _FLAGS:
            out.add_argument(f"--{_FLAGS[f.name]}", dest=f.name, action="store_false")
        elif f.name == "mode":
            out.add_argument("--regression", dest="mode", action="store_const", const="regression", default="classification")
        elif f.name == "compat":
            out.add_argument("--no-compat", dest="compat", action="store_false")
        elif f.name == "strategy":
            out.add_argument("--strategy", choices=strategies(), default="html")
        else:
            out.add_argument(f"--{_NAMES.get(f.name, f.name.replace('_', '-'))}", dest=f.name, type=type(f.default), default=None if f.name == "cost_function" else f.default)
    out.add_argument("--model-type")
    commands = out.add_subparsers(dest="command", required=True)
    for name, words in {"learn": "store label paths*", "batch-learn": "store path", "analyze": "store model", "classify": "model paths*", "batch-classify": "model path", "print-model": "model"}.items():
        sub = commands.add_parser(name)
        for w in words.split():
            sub.add_argument(w.rstrip("*"), nargs="*" if w.endswith("*") else None)
    return out


def _text() -> Column:
    """The content's bytes as they are, well-formed or not."""
    return F.col("content").cast("string")


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = framed.whole_files(spark, paths) if paths else framed.one_document(spark, sys.stdin.buffer.read())
    return rows.select(F.col("key").alias("doc_id"), _text().alias("text"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    chosen = {f.name: getattr(args, f.name) for f in fields(Parameters)}
    chosen["cost_function"] = chosen["cost_function"] or ("rmse" if args.mode == "regression" else "auroc")
    parameters = Parameters(**chosen)
    parameters.check()
    spark = spark or SparkSession.builder.appName("corpuswright").getOrCreate()
    framed.register(spark)
    if args.command == "learn":
        FeatureStore(spark, args.store).append(_documents(spark, args.paths), float(args.label), parameters.strategy, parameters.do_unique, strict=True)
    elif args.command == "batch-learn":
        docs = framed.read_framed(spark, args.path).select(F.monotonically_increasing_id().cast("string").alias("doc_id"), _text().alias("text"), "label")
        FeatureStore(spark, args.store).append(docs, F.col("label"), parameters.strategy, parameters.do_unique)
    elif args.command == "analyze":
        store = FeatureStore(spark, args.store)
        estimator(args.model_type)(parameters).fit(store.features(), store.labels()).save(args.model)
    else:
        model = ClassifierModel.load(spark, args.model)
        if args.command == "print-model":
            rows = model.summary().orderBy("key")
            for r in rows.toLocalIterator():
                print(f"{r['key']}: {r['value']:.9g}")
            return 0
        docs = _documents(spark, args.paths) if args.command == "classify" else framed.read_framed(spark, args.path, labels=False).select(F.col("key").alias("doc_id"), _text().alias("text"))
        for r in model.transform(docs, tokenize(docs, model.parameters.strategy)).toLocalIterator():
            print(f"{r['doc_id']}\t{r['score']:.9g}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
