"""The registered queries over the whole tables of a folder, but for those of subpackages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import folds, grams, html, metrics, scoring, vocabulary
from ..operators.model import Classifier, OneVsRest, Parameters
from ..operators.tables import shared_folder
from ..operators.vocabulary import Part
from ..sources import framed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _y(spark, sf_dir):
    return vocabulary.binarized(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")


def _words(spark, sf_dir):
    """Word occurrences of the labelled documents."""
    return _labelled(spark, sf_dir).select("doc_id", F.explode(tx.words(F.col("text"))).alias("feature"))


def _features(spark, sf_dir):
    return vocabulary.list_features(vocabulary.listed(_labelled(spark, sf_dir), tx.words(F.col("text"))))


def _counts(spark, sf_dir):
    return vocabulary.list_counts(vocabulary.listed(_labelled(spark, sf_dir), tx.words(F.col("text")), distinct=False))


def _weighted(spark, sf_dir, kind="log-odds"):
    return vocabulary.weights(_features(spark, sf_dir), _y(spark, sf_dir), kind)


def _r(column: str, name: str | None = None):
    return F.round(column, 6).alias(name or column)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_odds_weights(spark, sf_dir).orderBy(F.desc(F.abs("weight")), "feature")


def word_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))


def skipgrams(spark, sf_dir):
    return grams.gram_counts(_table(spark, sf_dir, "documents"), "text", tx.words(F.col("text")))


def codepoint_features(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.code_points(F.col("text"))).alias("point")).groupBy("doc_id", "point").agg(F.count("*").alias("n"))


def malformed_codepoints(spark, sf_dir):
    """Lenient code points of the documents' bytes without every third one."""
    mangled = F.encode(F.regexp_replace(tx.latin1(F.col("text")), "(?s)(..).", "$1"), "ISO-8859-1")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.lenient_points(mangled)).alias("point"))
    return rows.groupBy("doc_id", "point").agg(F.count("*").alias("n"))


def byte_skipgrams(spark, sf_dir):
    """Skip-grams of all tokens, punctuation and bytes from 0x80 among them, one character a byte."""
    return grams.gram_counts(_table(spark, sf_dir, "documents"), "text", tx.tokens(F.col("text")))


def framed_documents(spark, sf_dir):
    """Documents with a text, written as framed files to the shared folder and read again by runs of records."""
    framed.register(spark)
    path = f"{shared_folder(spark)}/framed-{uuid.uuid4().hex}"
    texts = _table(spark, sf_dir, "documents").filter("text <> ''").select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("content"))
    texts.write.format("framed_keys").mode("append").save(path)
    rows = framed.read_framed(spark, path, labels=False)
    return rows.select("key", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def substring_features(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.explode(tx.substrings(F.col("p_name"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def stopword_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.without_stop_words(tx.words(F.col("text")))).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))


def url_components(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(tx.url_parts(F.col("url"))).alias("part")).groupBy("page_id", "part").agg(F.count("*").alias("n"))


def genotype_features(spark, sf_dir):
    alleles = F.when(F.col("l_returnflag") == "R", "--").when(F.col("l_linenumber") % 2 == 0, F.concat_ws("\t", "l_returnflag", "l_linestatus")).otherwise(F.concat("l_returnflag", "l_linestatus"))
    line = F.concat_ws("\t", F.concat(F.lit("rs"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), alleles)
    dumps = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("# rsid\tchrom\tpos\tgenotype\n"), F.array_join(F.collect_list(line), "\n")).alias("content"))
    return dumps.select(F.inline(tx.genotypes(F.col("content")))).groupBy("chrom", "pos", "alleles").agg(F.count("*").alias("n"))


def doc_feature_sets(spark, sf_dir):
    sets = _table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(tx.words(F.col("text")))).alias("f"))
    return sets.select("doc_id", F.size("f").cast("long").alias("n_features"), F.md5(F.array_join("f", " ").cast("binary")).alias("digest"))


def label_binarize(spark, sf_dir):
    return _y(spark, sf_dir)


def doc_frequency(spark, sf_dir):
    return vocabulary.document_frequency(_features(spark, sf_dir))


def df_filter(spark, sf_dir):
    return vocabulary.vocabulary(_features(spark, sf_dir), 2)


def feature_pass_stats(spark, sf_dir):
    return doc_frequency(spark, sf_dir).agg(F.count("*").alias("n_features"), F.count_if(F.col("df") >= 2).alias("n_passing"))


def feature_dictionary(spark, sf_dir):
    return vocabulary.dictionary(df_filter(spark, sf_dir))


def vocab_semi_join(spark, sf_dir):
    features = _features(spark, sf_dir)
    return vocabulary.known_only(features, vocabulary.vocabulary(features, 2)).select("doc_id", "feature")


def feature_counts(spark, sf_dir):
    return _counts(spark, sf_dir).withColumn("extra", F.col("extra").cast("long"))


def empty_docs(spark, sf_dir):
    features = _features(spark, sf_dir)
    return _labelled(spark, sf_dir).select("doc_id").join(vocabulary.known_only(features, vocabulary.vocabulary(features, 25)), "doc_id", "left_anti")


def max_doc_features(spark, sf_dir):
    return vocab_semi_join(spark, sf_dir).groupBy("doc_id").count().agg(F.max("count").alias("most"))


def target_centering(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return vocabulary.with_totals(rows, rows.agg(F.avg("quality").alias("bias"))).select("doc_id", F.round(F.col("quality") - F.col("bias"), 6).alias("target"))


def contingency(spark, sf_dir):
    return vocabulary.contingency(_features(spark, sf_dir), _y(spark, sf_dir))


def bns_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "bns").select("feature", _r("weight"))


def idf_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "idf").select("feature", _r("weight"))


def log_odds_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("feature", _r("weight"))


def unit_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, "none").select("feature", _r("weight"))


def count_threshold_search(spark, sf_dir):
    found = vocabulary.count_thresholds(_counts(spark, sf_dir), _y(spark, sf_dir))
    return found.select("feature", _r("weight"), F.col("min_extra").cast("long").alias("min_extra"))


def _active(spark, sf_dir):
    return scoring.active(_features(spark, sf_dir), _weighted(spark, sf_dir))


def doc_l2_norm(spark, sf_dir):
    return scoring.l2_norms(_active(spark, sf_dir)).select("doc_id", _r("scale"))


def doc_svr_scale(spark, sf_dir):
    return scoring.regression_scales(_active(spark, sf_dir)).select("doc_id", F.round("scale", 9).alias("scale"))


def doc_dot(spark, sf_dir):
    return scoring.dots(_active(spark, sf_dir), _weighted(spark, sf_dir, "idf").withColumnRenamed("weight", "w")).select("doc_id", F.round("dot", 5).alias("dot"))


def _lengths(spark, sf_dir):
    return _labelled(spark, sf_dir).filter("quality is not null").select("doc_id", F.length("text").cast("double").alias("score"), F.when(F.col("quality") > 0, 1).otherwise(-1).alias("y"), F.col("quality").cast("double").alias("target"))


def auroc(spark, sf_dir):
    return metrics.auroc(_lengths(spark, sf_dir)).select(_r("auroc"))


def auroc_by_language(spark, sf_dir):
    rows = _lengths(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.auroc(rows, ["lang"]).select("lang", _r("auroc"))


def f_beta(spark, sf_dir):
    return metrics.f_beta(_lengths(spark, sf_dir).withColumn("score", F.col("score") - 1000), 2.0).select(_r("f_beta"))


def precision(spark, sf_dir):
    return metrics.f_beta(_lengths(spark, sf_dir).withColumn("score", F.col("score") - 1000), 0.0).select(_r("f_beta", "precision"))


def eps_rmse(spark, sf_dir):
    return metrics.eps_rmse(_lengths(spark, sf_dir).withColumn("prediction", F.col("score") / 2500)).select(_r("eps_rmse"))


def cv_summary(spark, sf_dir):
    rows = _lengths(spark, sf_dir).withColumn("fold", F.col("doc_id") % 5).withColumn("cost", F.explode(F.array(*map(F.lit, (1.0, 2.0, 4.0)))))
    per = metrics.eps_rmse(rows.withColumn("prediction", F.col("score") / (1000 * F.col("cost"))), 0.1, ["cost", "fold"]).withColumnRenamed("eps_rmse", "metric")
    return metrics.summary(per, ["cost"]).select("cost", _r("mean_metric"), _r("min_metric"), _r("max_metric"))


def _sizes(spark, sf_dir):
    return vocabulary.class_sizes(_y(spark, sf_dir))


def fold_count(spark, sf_dir):
    half = lambda c: F.floor(F.col(c) / 2)
    return _sizes(spark, sf_dir).select(F.greatest(F.lit(2), F.least(half("pos"), half("neg"), F.lit(10))).cast("long").alias("k"))


def stratified_folds(spark, sf_dir):
    return folds.stratified(_y(spark, sf_dir), 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


def round_robin_folds(spark, sf_dir):
    return folds.round_robin(_y(spark, sf_dir)).select("doc_id", F.col("fold").cast("long").alias("fold"))


def c_min(spark, sf_dir):
    docs = _y(spark, sf_dir).agg(F.count("*").alias("docs"))
    rows = vocabulary.with_totals(max_doc_features(spark, sf_dir), docs)
    return rows.select(F.pow(F.lit(2.0), F.greatest(F.lit(-10), F.floor(F.log2(1 / (2.0 * F.col("docs") * F.col("most")))))).alias("c_min"))


def class_balance(spark, sf_dir):
    total = F.col("pos") + F.col("neg")
    return _sizes(spark, sf_dir).select(F.round(2.0 * F.col("neg") / total, 6).alias("cost_pos"), F.round(2.0 * F.col("pos") / total, 6).alias("cost_neg"))


def _scores(spark, sf_dir):
    model = _weighted(spark, sf_dir).withColumn("w", F.col("weight"))
    return scoring.classify(_table(spark, sf_dir, "documents"), _all_features(spark, sf_dir), model)


def _all_features(spark, sf_dir):
    return vocabulary.list_features(vocabulary.listed(_table(spark, sf_dir, "documents"), tx.words(F.col("text"))))


def classify_docs(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", _r("score"))


def decisions(spark, sf_dir):
    return classify_docs(spark, sf_dir).groupBy((F.col("score") > 0).alias("positive")).agg(F.count("*").alias("n"))


def minmax_calibrate(spark, sf_dir):
    return scoring.min_max(_scores(spark, sf_dir)).select("doc_id", _r("calibrated"))


def _fitted(spark, sf_dir, **chosen):
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col(chosen.pop("label", "quality")).cast("float").alias("label"))
    words = _words(spark, sf_dir)
    return Classifier(Parameters(strategy="plain", **chosen)).fit(words, labels), words, labels


def svc_train(spark, sf_dir):
    """Training at a given cost, bi-normal separation and count thresholds; the labelled documents' scores."""
    model, words, labels = _fitted(spark, sf_dir, weight="bns", threshold=3, cost=4.0, do_unique=False)
    return model.transform(labels, words)


def svc_search(spark, sf_dir):
    """Training with the cross-validated cost search."""
    model, words, labels = _fitted(spark, sf_dir, epsilon=0.5)
    return model.transform(labels, words)


def svr_train(spark, sf_dir):
    model, words, labels = _fitted(spark, sf_dir, mode="regression", cost_function="rmse", cost=1.0)
    return model.transform(labels, words)


def model_print(spark, sf_dir):
    return _fitted(spark, sf_dir, cost=1.0)[0].summary()


def skipgram_vocabulary(spark, sf_dir):
    """Skip-grams of at least two documents."""
    return grams.gram_counts(_table(spark, sf_dir, "documents"), "text", tx.words(F.col("text")), documents=True, least=2).withColumnRenamed("n", "df")


def fold_weights(spark, sf_dir):
    """Each feature's log-odds by each of five training sets, those without a fold, from one count."""
    dealt = folds.stratified(_y(spark, sf_dir), 5).select("doc_id", "fold", F.when(F.col("y") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("topics"))
    table = vocabulary.part_weights(_features(spark, sf_dir), dealt, [Part(0, f) for f in range(5)])
    return table.select("feature", F.posexplode("weights").alias("held", "weight")).filter("weight <> 0").select("feature", F.col("held").cast("long").alias("held"), _r("weight"))


def svc_objective(spark, sf_dir):
    """The least objective of a machine at a low cost, and whether training has certified it."""
    model = _fitted(spark, sf_dir, cost=2.0**-8, epsilon=0.01)[0]
    return spark.createDataFrame([(round(model.objective, 3), model.gap <= 0.01)], "objective double, certified boolean")


def topic_machines(spark, sf_dir):
    """Languages as topics, all machines from one count: learned from three documents in four, judged on the rest.

    ``separated``: an AUROC above 0.98 over the documents held out; ``certified``: trained to within epsilon of the least objective.
    """
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null")
    held = F.col("doc_id") % 4 == 2
    words = lambda df: df.select("doc_id", F.explode(tx.words(F.col("text"))).alias("feature"))
    chosen = Parameters(strategy="plain", cost=1.0)
    models = OneVsRest(chosen).fit(words(documents.filter(~held)), documents.filter(~held).select("doc_id", F.col("lang").alias("topic")))
    rest = documents.filter(held)
    scores = OneVsRest.transform(models, rest, words(rest)).join(rest.select("doc_id", "lang"), "doc_id").withColumn("y", F.when(F.col("lang") == F.col("topic"), 1).otherwise(-1))
    per = metrics.auroc(scores, ["topic"]).join(scores.groupBy("topic").agg(F.count("*").alias("documents"), F.count_if(F.col("y") > 0).alias("positive")), "topic")
    sure = spark.createDataFrame([(t, bool(m.gap <= chosen.epsilon)) for t, m in models.items()], "topic string, certified boolean")
    return per.join(sure, "topic").select("topic", "documents", "positive", (F.col("auroc") > 0.98).alias("separated"), "certified")


def html_tag_features(spark, sf_dir):
    return html.html_features(_table(spark, sf_dir, "pages"), kinds=("tag", "tag2", "attr", "attrval", "url", "attrurl"))


def html_word_features(spark, sf_dir):
    return html.html_features(_table(spark, sf_dir, "pages"), kinds=("word", "gram1", "gram2", "ctx", "point")).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        "word_tokens skipgrams codepoint_features substring_features stopword_filter url_components genotype_features doc_feature_sets label_binarize doc_frequency df_filter "
        "feature_pass_stats feature_dictionary vocab_semi_join feature_counts empty_docs max_doc_features target_centering contingency bns_weights idf_weights log_odds_weights unit_weights "
        "count_threshold_search doc_l2_norm doc_svr_scale doc_dot auroc auroc_by_language f_beta precision eps_rmse cv_summary fold_count stratified_folds round_robin_folds c_min class_balance "
        "classify_docs decisions minmax_calibrate svc_train svc_search svr_train model_print html_tag_features html_word_features "
        "skipgram_vocabulary fold_weights svc_objective topic_machines malformed_codepoints byte_skipgrams framed_documents"
    )
    return {n: globals()[n] for n in names.split()}
