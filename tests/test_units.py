"""Hand-written vectors, solver optimality, sources, streaming and the command line."""

import os
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswright.cli import main
from corpuswright.functions import hashing
from corpuswright.functions import text as tx
from corpuswright.operators import folds, grams, html, metrics
from corpuswright.operators import dual
from corpuswright.operators.model import Classifier, ClassifierModel, OneVsRest, Parameters, estimator, hill_climb
from corpuswright.operators.solver import Local, Rows, hinge, minimum, tube
from corpuswright.sources import corpora, framed
from corpuswright.sources.feature_store import FeatureStore, tokenize
from corpuswright.streaming.scorer import learn_stream, score_stream


@pytest.mark.parametrize("value,want", [
    ("", 6142509188972423790), ("a", 4993892634952068459), ("abc", 3663726644998027833), ("hello", 2762169579135187400), ("12345678", -8332907654791504731), ("sixteen letters!", -6099954007389354058),
])
def test_hash_vectors(value, want):
    assert hashing.hash_one(value) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=10))
def test_hashes_do_not_depend_on_company(values):
    assert hashing.hash_bytes(values).tolist() == [hashing.hash_one(v) for v in values]


def test_modular_arithmetic(spark):
    df = spark.createDataFrame([((1 << 62) + 5, 9, 7), (-3, 17, 2)], "a long, m long, b long")
    assert [r[0] for r in df.select(hashing.combine("a", "m", "b")).collect()] == [hashing.wrap(((1 << 62) + 5) * 9 + 7), -49]
    assert [r[0] for r in spark.createDataFrame([("a",), (None,), ("a",)], "s string").select(hashing.feature_hash("s")).collect()] == [4993892634952068459, None, 4993892634952068459]


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_tokenizers(spark):
    tokens = [t.encode("latin-1") for t in column(spark, "don't stop -- xéy éa, \"ok\"!", tx.tokens)]
    assert tokens == [b"don't", b"stop", b"--", b"x\xc3\xa9y", b"\xc3", b"\xa9", b"a", b",", b'"', b"ok", b'"!']
    assert column(spark, "foo_bar 'tis", tx.tokens) == ["foo", "_", "bar", "'", "tis"]
    grams = column(spark, "a b c", lambda c: tx.skip_grams(tx.words(c)))
    assert sorted((g.tok, g.prev or "", g.distance) for g in grams) == [("a", "", 0), ("b", "", 0), ("b", "a", 1), ("c", "", 0), ("c", "a", 2), ("c", "b", 1)]
    assert column(spark, "é€", tx.code_points) == [233, 8364]
    assert sorted(column(spark, "abcd", tx.substrings)) == ["abc", "abcd", "bcd"] and column(spark, "ab", tx.substrings) == []
    dump = "# x\nrs1\t1\t100\tAG\nrs1\t1\t100\tA\tG\nrs2\t1\t100\t--\nrs2\t1\t100\t-\t-\nrs3\t1\t100\tA\tGT\nrs4\t1\t100\tGA"
    assert [tuple(g) for g in column(spark, dump, tx.genotypes)] == [("1", "100", "AG"), ("1", "100", "AG"), ("1", "100", "GA")]
    assert column(spark, "a,b,", lambda c: tx.explode_text(c, ",")) == ["a", "b"]
    assert tx.decode_lenient("é€x".encode()) == [233, 8364] and tx.decode_lenient(b"\xc3") == []
    assert tx.decode_lenient(b"\x85a\xfe\xff") == [0x85, 0xFE, 0xFF] and tx.decode_lenient(b"\xe2\x82a\xc3\xa9") == [0x82, 0xE9]
    assert tx.shortest(0.1) == "0.1" and float(tx.shortest(1 / 3)) == 1 / 3


def tree(page, **options):
    doc = html.parse(page, **options)
    below = {}
    for n in doc.nodes[1:]:
        below.setdefault(id(n.parent), []).append(n)

    def show(n):
        if n.name == html.CONTENT:
            return f'#"{n.content}"'
        if n.name == html.COMMENT:
            return f'comment"{n.content}"'
        attributes = "{" + ",".join(f"{k}={v}" for k, v in n.attributes) + "}" if n.attributes else ""
        inside = ", ".join(show(c) for c in below.get(id(n), []))
        return f"{n.name}{attributes}" + (f"[{inside}]" if inside else "")

    return ", ".join(show(c) for c in below.get(id(doc.nodes[0]), []))


@pytest.mark.parametrize("page,want", [
    ("<p>a<p>b", 'p[#"a"], p[#"b"]'), ("<b>x<p>y", 'b[#"x", p[#"y"]]'), ("<p><b>x</b></i>y", 'p[b[#"x"]], #"y"'), ("<!DOCTYPE html><p>t", '#"html>", p[#"t"]'),
    ('<img src="x">t', 'img{src=x}, #"t"'), ("<img src=x>t", 'img{src=x}[#"t"]'), ("<br clear>t", 'br{clear=clear}[#"t"]'), ('<META NAME="A">t', 'META{NAME=A}[#"t"]'),
    ('<script>v="</p>";</script>z', 'script[#"v="</p>";"], #"z"'), ("<!--a-->b", 'comment"a", #"b"'), ("a &amp b &#65;&#x42; &nope;", '#"a & b AB &nope;"'), ("&euro;", '#"€"'),
    ("<dd>a<dt>b", 'dd[#"a", dt[#"b"]]'), ("<tr><td>a<tr><td>b", 'tr[td[#"a"]], tr[td[#"b"]]'), ("<a/>t", 'a, #"t"'), ("<?x?>t", '#"t"'), ("< b", ""), ("<a b='c>d", "a{b='c}[#\"d\"]"),
])
def test_html_trees(page, want):
    assert tree(page) == want


def test_html_legacy_entities_and_serialiser():
    assert tree("&euro;", legacy_entities=True) == f'#"{chr(0x8364)}"'
    page = '<p a="1">x &amp; y</p><!--c--><br>'
    assert html.serialise(html.parse(page)) == page
    assert html.parse('<a b="1" b="2">').nodes[1].attribute("b") == "1"
    assert len(html.parse("<b>" * 20000).nodes) == 20001


def test_html_features():
    found = list(html.features('<a href="http://x.y/z">t</a>'))
    assert sorted(found, key=str) == sorted([
        ("tag", "a", None), ("attr", "a.href", None), ("attrval", "a.href", "http://x.y/z"), ("word", "t", None), ("ctx", "a", "t"),
        *[("url", p, None) for p in ("http:", "x.y", "z")], *[("attrurl", "a.href", p) for p in ("http:", "x.y", "z")],
    ], key=str)
    assert list(html.features("the cat")) == [("word", "cat", None)]
    assert list(html.features("cat the dog")) == [("word", "cat", None), ("word", "dog", None), ("gram1", "dog", "cat")]
    assert ("tag", "meta[a]", None) in list(html.features('<meta name="A" content="b">'))


def test_metrics_and_folds(spark):
    rows = spark.createDataFrame([(0.1, -1), (0.1, 1), (0.3, -1), (0.5, 1)], "score double, y int")
    assert metrics.auroc(rows).first()[0] == 0.5
    rng = np.random.default_rng(1)
    many = [(g, float(s), int(y)) for g in ("a", "b") for s, y in zip(np.concatenate([rng.normal(0, 1, 200).round(2), rng.normal(0, 1e-6, 50), [0.0, -0.0]]), rng.choice([-1, 1], 252))] + [("c", 1.0, 1)]
    got = {r.g: r.auroc for r in metrics.auroc(spark.createDataFrame(many, "g string, score double, y int"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in many if h == g and y == c] for c in (1, -1))
        assert got[g] == pytest.approx(sum(n < p for p in pos for n in neg) / (len(pos) * len(neg)))
    assert got["c"] is None
    y = spark.createDataFrame([(i, 1) for i in range(5)] + [(i, -1) for i in range(10, 17)], "doc_id long, y int")
    assert [r.fold for r in folds.stratified(y, 2).filter("y = 1").orderBy("doc_id").collect()] == [0, 0, 0, 1, 1]
    assert [folds.fold_count(*x) for x in ((76, 11), (341, 58), (1, 50))] == [5, 10, 2]
    assert [r.fold for r in folds.round_robin(y, 3).orderBy("y", "doc_id").collect()] == [i % 3 for i in range(12)]


def problem(seed, n=60, width=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) * (rng.random((n, width)) < 0.3)
    row, col = np.nonzero(x)
    return Rows(row, col, x[row, col], n, width), rng


@pytest.mark.parametrize("seed", range(4))
def test_classifier_reaches_its_optimum(seed):
    """Every dual point bounds the optimum from below; the optimum's own dual point meets it."""
    rows, rng = problem(seed)
    y = np.where(rng.random(60) < 0.3, 1.0, -1.0)
    costs = np.where(y > 0, 5.0, 0.5)
    w = minimum(Local(rows, hinge(y, costs)), np.zeros(rows.width))
    primal, _ = Local(rows, hinge(y, costs)).at(w)
    alpha = 2 * costs * np.maximum(1 - y * rows.dot(w), 0)
    turned = rows.back(alpha * y)
    dual = alpha.sum() - 0.5 * turned @ turned - 0.25 * (alpha**2 / costs).sum()
    assert 0 <= primal - dual + 1e-9 < 1e-4 * max(1, primal)
    again = minimum(Local(rows, hinge(y, costs)), w + 0.1)
    assert np.allclose(again, w, atol=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_regressor_reaches_its_optimum(seed):
    rows, rng = problem(seed)
    y = rng.normal(0, 1, 60)
    objective = Local(rows, tube(y, 2.0, 0.1))
    w = minimum(objective, np.zeros(rows.width))
    best, _ = objective.at(w)
    for _ in range(50):
        assert objective.at(w + rng.normal(0, 1e-3, len(w)))[0] >= best - 1e-9


def test_hill_climb_doubles_then_turns():
    seen = []

    def score(pairs):
        seen.extend(pairs)
        return [-abs(np.log2(a) - 3) - abs(np.log2(b) - 1) for a, b in pairs]

    best, value = hill_climb(score, (1.0, 1.0))
    assert best == (8.0, 2.0) and value == 0 and len(seen) == len(set(seen))


def test_parameters_are_checked():
    for bad in ({"cost_function": "rmse"}, {"mode": "regression"}, {"threshold": 0}, {"weight": "x"}, {"mode": "x"}, {"cost_function": "fx"}):
        with pytest.raises(ValueError):
            Classifier(Parameters(**bad))
    assert estimator() is estimator("l-svm")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    good, bad, any_ = (["sun", "sea", "calm"], ["storm", "wreck"], ["boat", "sail", "port", "wind", "crew"])
    rows = [(f"d{i}", " ".join(rng.choice([*any_, *(good if i % 2 else bad)], 12)), float(i % 2)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id string, text string, label float").cache()


def test_training_persistence_and_streaming(spark, corpus, tmp_path):
    features = tokenize(corpus, "plain")
    model = Classifier(Parameters(strategy="plain")).fit(features, corpus.select("doc_id", "label"))
    scores = {r.doc_id: r.score for r in model.transform(corpus, features).collect()}
    right = sum((scores[r.doc_id] > 0) == (r.label > 0) for r in corpus.collect())
    assert right >= 58
    model.save(str(tmp_path / "model"))
    again = ClassifierModel.load(spark, str(tmp_path / "model"))
    assert {r.doc_id: pytest.approx(r.score) for r in again.transform(corpus, features).collect()} == scores
    assert again.summary().filter("key = 'bias'").count() == 1
    corpus.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, again, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id: pytest.approx(r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == scores
    store = FeatureStore(spark, str(tmp_path / "store"))
    learn_stream(stream, store, str(tmp_path / "cp2"), "plain").awaitTermination()
    assert store.count() == 60


def test_regression_beats_the_mean(spark, corpus):
    labels = corpus.select("doc_id", (F.col("label") * 2 + 1).cast("float").alias("label"))
    features = tokenize(corpus, "plain")
    model = Classifier(Parameters(mode="regression", cost_function="rmse", strategy="plain", cost=1.0, class_threshold=2.0, compat=False, epsilon=0.01)).fit(features, labels)
    rows = model.transform(corpus, features).join(labels, "doc_id").toPandas()
    assert ((rows["score"] - rows["label"]) ** 2).mean() < 0.5 * ((rows["label"].mean() - rows["label"]) ** 2).mean()


def test_framed_streams_and_command_line(spark, corpus, tmp_path, capsys):
    rows = corpus.collect()
    (tmp_path / "train").write_bytes(b"".join(framed.frame(float(r.label), r.text.encode()) for r in rows) + b"broken 12")
    (tmp_path / "score").write_bytes(b"".join(framed.frame(r.doc_id, r.text.encode()) for r in rows))
    framed.register(spark)
    assert spark.read.format("framed_labels").load(str(tmp_path / "train")).count() == 60
    assert framed.from_bytes(spark, b"k 2\nabx 0\n", labels=False).collect()[0].key == "k"
    store, model = str(tmp_path / "store"), str(tmp_path / "model")
    (tmp_path / "one.txt").write_text("sun sea calm boat")
    assert main(["--strategy=plain", "batch-learn", store, str(tmp_path / "train")], spark) == 0
    assert main(["--strategy=plain", "learn", store, "1", str(tmp_path / "one.txt")], spark) == 0
    assert FeatureStore(spark, store).count() == 61
    assert main(["--strategy=plain", "--C=1", "analyze", store, model], spark) == 0
    capsys.readouterr()
    main(["batch-classify", model, str(tmp_path / "score")], spark)
    lines = [x.split("\t") for x in capsys.readouterr().out.split("\n") if "\t" in x]
    assert len(lines) == 60 and sum((float(s) > 0) == (int(k[1:]) % 2 == 1) for k, s in lines) >= 58
    main(["print-model", model], spark)
    assert "bias: 0" in capsys.readouterr().out
    with pytest.raises(Exception):
        framed.whole_files(spark, str(tmp_path / "missing")).count()


def test_two_batches_and_bytes_that_are_no_text(spark, corpus, tmp_path, capsys):
    """Batches are numbered apart; a byte that is not UTF-8 stops nothing."""
    rows, store, model = corpus.collect(), str(tmp_path / "store"), str(tmp_path / "model")
    framed.register(spark)
    for name, label in (("good", 1.0), ("bad", 0.0)):
        (tmp_path / name).write_bytes(b"".join(framed.frame(label, r.text.encode() + b" \xff\x80") for r in rows if r.label == label))
        assert main(["--strategy=plain", "batch-learn", store, str(tmp_path / name)], spark) == 0
    kept = FeatureStore(spark, store).read()
    assert kept.count() == kept.select("doc_id").distinct().count() == 60
    assert main(["--strategy=plain", "--C=1", "analyze", store, model], spark) == 0
    (tmp_path / "score").write_bytes(framed.frame("a", b"sun sea \xff") + framed.frame("b", b"storm wreck \xc3"))
    capsys.readouterr()
    main(["batch-classify", model, str(tmp_path / "score")], spark)
    got = dict(x.split("\t") for x in capsys.readouterr().out.split("\n") if "\t" in x)
    assert float(got["a"]) > 0 > float(got["b"])


def test_one_machine_a_topic_and_spread_training(spark, corpus, monkeypatch):
    features = tokenize(corpus, "plain").cache()
    topics = corpus.select("doc_id", F.when(F.col("label") > 0, "calm").otherwise("rough").alias("topic"))
    exact = Parameters(strategy="plain", cost=1.0, intercept=1.0, epsilon=1e-3)
    found = OneVsRest(exact).fit(features, topics)
    scores = OneVsRest.transform(found, corpus, features).join(topics.withColumnRenamed("topic", "own"), "doc_id")
    per = metrics.auroc(scores.withColumn("y", F.when(F.col("topic") == F.col("own"), 1).otherwise(-1)), ["topic"])
    assert metrics.macro_mean(per).first()[0] > 0.98
    monkeypatch.setattr(dual, "BLOCK_CELLS", 100)
    spread = OneVsRest(exact).fit(features, topics.filter("topic = 'calm'").unionByName(topics.filter("topic <> 'calm'").withColumn("topic", F.lit(None).cast("string"))))
    a, b = ({r.doc_id: r.score for r in m.transform(corpus, features).collect()} for m in (found["calm"], spread["calm"]))
    assert all(a[k] == pytest.approx(b[k], abs=1e-3) for k in a)


def test_corpora(spark, tmp_path):
    page = '<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN"><DATE>1-JAN</DATE><TOPICS><D>earn</D><D>ship</D></TOPICS><TEXT><TITLE>T</TITLE><BODY>a &lt; b</BODY></TEXT></REUTERS><REUTERS LEWISSPLIT="TEST"><TOPICS></TOPICS><TEXT>x</TEXT></REUTERS>'
    assert list(corpora.sgml_documents(page)) == [(False, False, ["earn", "ship"], "1-JAN", "Ta &lt; b"), (True, True, [], "", "x")]
    (tmp_path / "a.sgm").write_text(page)
    assert corpora.read_sgml(spark, str(tmp_path / "a.sgm")).count() == 2
    with zipfile.ZipFile(tmp_path / "0.zip", "w") as z:
        z.writestr("x/one.html", "<p>1")
        z.writestr("two.html", "")
    (tmp_path / "l.csv").write_text("file,sponsored\none.html,1\ntwo.html,0\n")
    assert [(r.file, r.label) for r in corpora.labelled_zip(spark, str(tmp_path / "0.zip"), str(tmp_path / "l.csv")).collect()] == [("one.html", 1)]


def test_entry_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", ".hypothesis"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[-1] == "False", out.stderr


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0




def test_html_features_of_many_pages_come_in_bounded_batches(monkeypatch):
    """However many pages a task gets at once, it gives so many rows at once, and of the kinds asked for alone."""
    import pyarrow as pa

    monkeypatch.setattr(html, "BATCH_ROWS", 50, raising=False)
    runs = []

    class Pages:
        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            runs.append(run)

    html.html_features(Pages())
    html.html_features(Pages(), kinds=("tag",))
    pages = [f"<p>one two w{i} é<b>x</b>" for i in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(202)]), pa.array([p if p is None else p.encode() for p in pages], pa.binary())], names=["doc_id", "html"])
    every, tags = ([b for b in run(iter([batch]))] for run in runs)
    assert max(b.num_rows for b in every) == 50
    found = [tuple(r.values()) for b in every for r in b.to_pylist()]
    want = []
    for i, page in enumerate(pages):
        counted = {}
        for f in html.features(page) if page else ():
            counted[f] = counted.get(f, 0) + 1
        want += [(str(i), *f, n) for f, n in counted.items()]
    assert found == [(k, kind, html._valid(a), html._valid(b), n) for k, kind, a, b, n in want]
    assert [(r["kind"], r["n"]) for b in tags for r in b.to_pylist()] == [("tag", 1)] * 400


def test_lists_of_features_are_counted_as_rows_are_and_not_shuffled_as_pairs(spark):
    """Equal doc_ids are one document; nulls and empty lists have no feature; counts end at 255."""
    from pyspark.sql import functions as F

    from corpuswright.functions import text as tx
    from corpuswright.operators import vocabulary

    texts = spark.createDataFrame([(1, "b a b"), (1, "b c"), (2, None), (3, ""), (4, "x " * 300 + "y"), (None, "q q"), (5, "é a é")], "doc_id long, text string")
    words = texts.filter("doc_id is not null").select("doc_id", F.explode(tx.words(F.col("text"))).alias("feature"))
    key = lambda df: sorted(map(tuple, df.collect()))
    counts = vocabulary.list_counts(vocabulary.listed(texts, tx.words(F.col("text")), distinct=False))
    assert key(counts) == key(vocabulary.feature_counts(words)) and (4, "x", 255) in key(counts) and counts.schema["extra"].dataType.simpleString() == "smallint"
    features = vocabulary.list_features(vocabulary.listed(texts, tx.words(F.col("text"))))
    assert key(features) == key(words.distinct())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan(counts).count("Exchange hashpartitioning") == plan(features).count("Exchange hashpartitioning") == 1
    assert "HashAggregate" not in plan(counts).replace("ObjectHashAggregate", "")


def test_skip_grams_are_counted_in_slices_and_buckets_as_one_by_one(spark, monkeypatch):
    """Null, empty, short and long lists; more documents than a slice; one longer than a slice; equal documents; many buckets."""
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(grams, "SLICE_TOKENS", 40, raising=False)
    texts = [None, "", "a", "a a", "b a b a b a", *[f"x y w{i % 7} z é" for i in range(90)], " ".join(f"v{i % 23}" for i in range(300)), "a"]
    lists = [None if t is None else t.split() for t in texts]
    want = {False: Counter(), True: Counter()}
    for words in filter(None, lists):
        mine = [(t, None if d == 0 else words[i - d], d) for i, t in enumerate(words) for d in range(4) if i >= d]
        want[False].update(mine)
        want[True].update(set(mine))
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 37], pa.list_(pa.string()))], names=["w"]) for i in range(0, len(lists), 37)]
    cut = list(grams.slices(iter(batches)))
    assert [w for s in cut for w in s.to_pylist()] == lists and all(len(s.flatten()) <= 40 or len(s) == 1 for s in cut) and len(cut) < len(texts) / 4
    for documents in (False, True):
        parts = [grams.dealt(*grams.slice_counts(s, 3, documents), 300) for s in cut if len(s.flatten())]
        rows = pa.Table.from_batches(parts).sort_by("bucket")
        assert rows.num_rows < sum(len(s.flatten()) * 4 for s in cut) and rows.column("bucket").to_numpy().max() < 300
        for least in (1, 2):
            found = [tuple(r.values()) for p in grams.by_bucket(iter(rows.to_batches(max_chunksize=5))) for b in grams.merged(p, least) for r in b.to_pylist()]
            assert len(found) == len({f[:3] for f in found}) and {f[:3]: f[3] for f in found} == {g: n for g, n in want[documents].items() if n >= least}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for documents in (False, True):
        found = grams.gram_counts(df, "text", F.when(F.col("text") != "", F.split("text", " ")), documents=documents).collect()
        assert {tuple(r)[:3]: r.n for r in found} == want[documents] and len(found) == len(want[documents])
    assert grams.gram_counts(df.limit(0), "text", F.split("text", " ")).count() == 0


def test_skip_gram_queries_shuffle_buckets_and_not_rows_a_gram(spark, capsys):
    """A shuffled row holds many skip-grams: no aggregate by skip-gram, whose rows grow with the occurrences, is in the plans."""
    from corpuswright.plans import registry

    for name in ("skipgrams", "byte_skipgrams", "skipgram_vocabulary"):
        registry.queries()[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "Exchange hashpartitioning(bucket" in plan and "HashAggregate" not in plan and plan.count("Exchange") == 1
