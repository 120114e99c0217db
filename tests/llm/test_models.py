"""Trained operators: held-out quality, edge cases, gradients, and plain versions of their scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpuswright.llm import extraction, langid, lm, quality, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "  \n", "en", "s", 0), (None, "The and attion to thanedble", "en", "s", 0), (9004, "x" * 5000, "en", "s", 0), (9004, "x" * 5000, "en", "s", 0), (9005, "123 !!", "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table.unionByName(spark.createDataFrame(EDGES, table.schema)).withColumnRenamed("n_chars", "score").cache()


@pytest.fixture(scope="module")
def labels(spark):
    table = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    return table.unionByName(spark.createDataFrame([(9001, None, None), (None, 1, 1), (777777, 1, 0)], "doc_id long, quality int, toxic int")).cache()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def auc(score, y):
    pos, neg = score[y == 1], score[y != 1]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def check_scores(out, docs, labels, column, least):
    rows = out.toPandas()
    assert len(rows) == docs.count()
    assert rows["score"].between(0, 1).all() and rows["predicted"].isin([0, 1]).all()
    assert [held(None if math.isnan(i) else int(i)) for i in rows["doc_id"].astype(float)] == rows["held_out"].tolist()
    known = rows.merge(labels.toPandas().dropna(), on="doc_id")
    known = known[known["held_out"]]
    assert auc(known["score"].to_numpy(), known[column].to_numpy()) > least
    return rows


def test_toxicity(docs, labels):
    check_scores(toxicity.classify(docs, labels), docs, labels, "toxic", 0.85)


def test_toxicity_sees_through_insertions_and_gaps():
    clean = ["the cat sat on the mat and went home", "all the good things come to those who wait", "nothing much happened in the town today", "he said what they all know it is", "you are an old friend that sat here"] * 20
    toxic = ["you are an idiot and all know it", "what a moron he is they said", "the idiot went home to the town", "that moron sat on the mat"] * 10
    machine = toxicity.train(toxic, clean, 0.4)
    score = machine.probability(toxicity.Scorer(machine)(pa.array(["the i.d.i.o.t sat", "the idixot sat", "i d i o t", "the m-o-r-o-n went home", "the cat sat", "", "the town is nice"])))
    assert min(score[:4]) > max(score[4:])


def test_kernel_against_plain_sum():
    def features(s):
        s, out = f"\x01{s}\x02", Counter()
        for i in range(len(s)):
            for step in toxicity._STEPS:
                at = [i, *(i + step)]
                if at[-1] < len(s):
                    out["".join(s[j] for j in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
        return out

    def length(s):
        n = len(s) + 2
        return math.sqrt(sum(toxicity.DECAY ** (2 * (int(step[-1]) + 1 - toxicity.ORDER)) for i in range(n) for step in toxicity._STEPS if i + step[-1] < n))

    names = ["idiot", "idixot", "clown", "theaea", "ab", "a"]
    got = toxicity.likeness(names, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            x, y = features(a), features(b)
            want = sum(x[k] * y[k] for k in x) / max(length(a) * length(b), 1e-9)
            assert got[i, j] == pytest.approx(want, abs=1e-4)


def test_toxicity_without_labels(spark, docs):
    out = toxicity.classify(docs.limit(5), spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.count() == 5
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_quality(docs, labels):
    rows = check_scores(quality.classify(docs, labels), docs, labels, "quality", 0.9)
    known = rows.merge(labels.toPandas().dropna(), on="doc_id")
    assert known[known["quality"] == 1]["predicted"].mean() > 0.95


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs.limit(5), none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).count() == 0


def test_quality_risk_learns_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(0)
    good, bad = (rng.normal(m, 1, (600, quality.N_FEATURES)).astype(np.float32) for m in (0.5, -0.5))
    net = quality.train(good[:300], np.concatenate([good[300:], bad[:200]]), good[:0])
    assert auc(net.raw(np.concatenate([good, bad[200:]])), np.concatenate([np.ones(600), np.zeros(400)])) > 0.95
    assert abs(net.prior - 0.6) < 0.2


def test_quality_features_of_edges():
    x = quality.features(pa.array([None, "", " \n ", "a", "a a a", "b\nb\nb"]))
    assert x.shape == (6, quality.N_FEATURES) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()


def test_language(docs):
    rows = langid.identify(docs).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    table = docs.select("doc_id", "lang").toPandas().dropna()
    known = rows[rows["held_out"] & (rows["doc_id"] < 9000)].merge(table, on="doc_id")
    assert (known["lang_pred"] == known["lang"]).mean() > 0.97
    edge = rows[rows["doc_id"].isin([9001, 9002, 9003, 9005])]
    assert (edge["lang_pred"] == "und").all() and (edge["score"] == 0).all()


def test_language_of_nothing(spark, docs):
    assert langid.identify(docs.limit(0)).count() == 0
    unknown = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(unknown).first().lang_pred == "und"


def test_language_windows_cover_every_byte():
    data = np.arange(1000) % 251
    found, docs_, weight = langid.windows_of(data.astype(np.uint8), np.array([0, 0, 5, 261, 262, 1000]))
    assert Counter(docs_.tolist()) == {1: 1, 2: 1, 3: 1, 4: 3} and found.shape == (6, langid.WINDOW)


def test_attention_gradients():
    rng = np.random.default_rng(2)
    counts = np.zeros(lm.N_IDS)
    counts[:40] = rng.integers(1, 50, 40)
    counts[lm.END] = 5
    model = lm.lay_out(counts, 20, 4, (rng.integers(0, 40, 99), rng.integers(0, 40, 99), np.ones(99)))
    model.id_prior, model.class_prior = [x.astype(np.float64) for x in model.id_prior], model.class_prior.astype(np.float64)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, n = rng.integers(0, 40, 70), np.array([30, 0, 40])
    inputs, targets, _ = lm.windows_of(ids, n)
    own = lm._look_up(model, ids)
    args = (own[inputs], own[targets], targets != -2)
    _, g = lm._gradients(model, *args)
    for k, w in model.weights.items():
        flat = w.reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            kept = flat[i]
            values = []
            for step in (1e-5, -1e-5):
                flat[i] = kept + step
                values.append(lm._gradients(model, *args)[0])
            flat[i] = kept
            assert g[k].reshape(-1)[i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=2e-5)


def test_next_id_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    counts = np.zeros(lm.N_IDS)
    counts[:12], counts[lm.END] = 10, 10
    model = lm.lay_out(counts, 8, 2, (rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.integers(1, 9, 30)))
    h = rng.normal(0, 1, (1, lm.WIDTH)).astype(np.float32)
    places = np.arange(len(model.of_class))
    for before in (None, *(np.full(len(places), b) for b in places)):
        logs, _ = lm._log_probabilities(model, np.repeat(h, len(places), 0), places, before=before)
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-5)
    rare = model.place == len(model.of_class) - 1
    assert (10 ** model.rare[rare]).sum() == pytest.approx(1)


def test_a_window_sees_nothing_of_what_comes_after():
    rng = np.random.default_rng(4)
    counts = np.ones(lm.N_IDS)
    model = lm.lay_out(counts, 64, 8)
    a = rng.integers(0, 60, 40)
    b = np.append(a[:25], rng.integers(0, 60, 15))
    n = np.array([40])
    inputs, targets, _ = lm.windows_of(a, n)
    x, y = (lm._forward(model.weights, lm._look_up(model, t)[inputs])[0][(targets >= 0) & (targets <= 25)] for t in (a, b))
    assert np.allclose(x, y)


def test_lm_scores_against_brute_base(spark, docs):
    few = docs.filter("doc_id is null or doc_id >= 9000 or doc_id % 7 = 0").cache()
    rows = few.select("doc_id", "text").collect()
    out = lm.scores(few).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not out_of(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(((r.doc_id, out_of(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text))) for r in rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=str)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.scores(few.limit(0)).count() == 0


def test_lm_beats_its_base_on_held_out_texts_in_total(spark, docs):
    out = lm.scores(docs.filter("doc_id < 9000")).filter("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum()


def lm_rows(texts):
    import pyspark.sql.functions as F

    return lambda spark: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({"held_out": F.lit(False), "learn": F.lit(True)})


def lm_ids(text):
    """A text's ids, word by word."""
    plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [i for w in plain for i in lm.encoder().encode(" " + w)]


ODD_TEXTS = ["one two one two", None, "", "Two one", "a\u00a0 \u00a0b c\u2003 d \u3000 e", "it's 'tis \x1c \x85x É\u00e9 \u6f22\u5b57 <|endoftext|>", "x" * 3000 + " y", "\U0001f642 \u0130 , . !!"]


def test_subword_ids_and_counts_of_every_text(spark):
    table = lm.encoded(lm_rows(ODD_TEXTS)(spark))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in table.collect()}
    assert got == {i: lm_ids(t) for i, t in enumerate(ODD_TEXTS)}
    counts = lm.subword_counts(table)
    want = Counter(x for t in got.values() for x in [*t, lm.END])
    assert {i: c for i, c in enumerate(counts.tolist()) if c} == want
    first, second, n = lm.subword_pairs(table, counts)
    assert {(a, b): c for a, b, c in zip(first.tolist(), second.tolist(), n.tolist())} == Counter(x for t in got.values() for x in zip([lm.END] + t, t + [lm.END]))


def test_words_are_known_by_their_ids():
    words = [w for t in ODD_TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    ids, counts = next(lm.encoder()(pa.array([" ".join(words)])))
    hashes, text = lm.word_ids(ids, counts, lm.encoder().begins)
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    assert len(hashes) == len(words) and not text.any()
    assert all((hashes[i] == hashes[j]) == (fold[i] == fold[j]) for i in range(len(words)) for j in range(i))


def test_words_are_kept_between_batches(monkeypatch):
    """Of more words than a worker kept before few are encoded again, and ids are the same after slots are taken by other words or emptied."""
    rng = np.random.default_rng(8)
    found = np.unique(rng.integers(97, 123, (150_000, 7), np.uint8).view("S7").ravel()).astype(str)
    texts = pa.array([" ".join(found[a : a + 1000]) for a in range(0, len(found), 1000)])
    some, encoded = lm.SubwordEncoder(lm.TOKENIZER_FILE), []
    plain = some.encode_words
    monkeypatch.setattr(some, "encode_words", lambda data, start, end: encoded.append(len(start)) or plain(data, start, end))
    first = np.concatenate([ids for ids, _ in some(texts)])
    assert sum(encoded) == len(found)
    encoded.clear()
    assert (np.concatenate([ids for ids, _ in some(texts)]) == first).all()
    assert sum(encoded) < 0.25 * len(found)
    few = lm.SubwordEncoder(lm.TOKENIZER_FILE, slots=64, most=500)
    for text in [*ODD_TEXTS, "one two", *ODD_TEXTS, " ".join(found[:300]), *ODD_TEXTS]:
        assert np.concatenate([np.zeros(0, np.uint16), *(ids for ids, _ in few(pa.array([text], pa.string())))]).tolist() == lm_ids(text)


def test_places_of_words_by_hash():
    rng = np.random.default_rng(9)
    for hashes in (rng.integers(0, 1 << 64, 5000, np.uint64), np.arange(300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.array([7], np.uint64)):
        hashes = rng.permutation(np.unique(hashes))
        at = rng.integers(0, len(hashes), 1000)
        assert (lm.WordIndex(hashes)(hashes[at]) == at).all()
    assert not len(lm.WordIndex(np.zeros(0, np.uint64))(np.zeros(0, np.uint64)))


def test_tasks_of_scoring_grow_in_number_with_the_buckets(spark):
    """The session's number of shuffle parts, which may be small, does not put many buckets into a task."""
    rows = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string").repartition(10)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        out = lm.scores(rows)
        assert out.rdd.getNumPartitions() >= 20 and out.count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_score_of_a_text_against_a_plain_loop():
    """Every id of a text by its own: attention over what its window shows, then class and id by full softmaxes."""
    rng = np.random.default_rng(6)
    counts = np.zeros(lm.N_IDS)
    counts[:60], counts[lm.END] = rng.integers(1, 40, 60), 9
    model = lm.lay_out(counts, 40, 5, (rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(1, 9, 200)))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    texts = [rng.integers(0, 60, n) for n in (0, 1, 11, 12, 13, 53)]
    want = []
    for t in texts:
        line, total = [lm.END, *t.tolist(), lm.END], 0.0
        for i in range(1, len(line)):
            first = (i - 1) // lm.STRIDE * lm.STRIDE - (lm.CONTEXT - lm.STRIDE)
            seen = range(max(first, 0), i)
            x = np.array([w["embedding"][model.place[line[j]]] + w["position"][j - first] for j in seen])
            a = np.exp(x @ w["key"] @ (x[-1] @ w["query"]) / lm.WIDTH**0.5)
            y = x[-1] + (a / a.sum()) @ (x @ w["value"]) @ w["merge"]
            h = y + np.maximum(np.concatenate([y, x[-1]]) @ w["wide"] + w["wide_bias"], 0) @ w["narrow"]
            target, before = model.place[line[i]], model.place[line[i - 1]]
            c = model.of_class[target]
            z = h @ w["to_class"] + w["class_bias"] + model.class_prior[before]
            total += z[c] - np.log(np.exp(z).sum())
            if c < len(model.id_prior):
                at = slice(model.firsts[c], model.firsts[c + 1])
                z = w["to_id"][at] @ h + w["id_bias"][at] + model.id_prior[c][before]
                total += z[target - model.firsts[c]] - np.log(np.exp(z).sum())
            total += model.rare[line[i]] * np.log(10)
        want.append(total / np.log(10))
    got = lm.log10_probabilities(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_extraction_of_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in extraction.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (out[p.page_id].text, out[p.page_id].n_chars, out[p.page_id].url) == (want, len(want), p.url)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<", "<"), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>a", ""), ("<!-- x", ""), ("<div>" * 5000 + "deep", "deep"), ("&am &amp; &eacute;", "&am & é"),
    ("<body><nav><a>m</a></nav><article><h1>T</h1><p>one\n two<br>three</p></article><aside>s</aside><footer>f</footer>", "T\none two three"),
    ("<body><div class='cookie-notice'>We use cookies on this site, and so on and on</div><main><p>Text of the page</p><form>Name</form></main><div id=comments><p>I disagree with every word that was said</p></div>", "Text of the page"),
    ("<body><ul class=menu><li><a>Home page of the site</a></ul><div class=post><p>A first paragraph, long enough.</p><div class='ad'>Buy</div><p>Second.</p></div>", "A first paragraph, long enough.\nSecond."),
])
def test_extraction_cases(page, text):
    assert extraction.main_text(page) == text


def test_density_chooses_among_parts_that_nothing_marks(monkeypatch):
    links = "".join(f"<li><a href='/{i}'>Some other page {i}</a></li>" for i in range(30))
    prose = "".join(f"<p>Paragraph {i} says at some length what the page is about.</p>" for i in range(6))
    page = f"<body><div class=x1><p>Welcome, dear reader</p><ul>{links}</ul></div><div class=x2>{prose}</div><div class=x3>All done</div></body>"
    want = "\n".join(f"Paragraph {i} says at some length what the page is about." for i in range(6))
    assert extraction.main_text(page) == want
    chosen = extraction.main_node
    monkeypatch.setattr(extraction, "main_node", lambda nodes: (chosen(nodes) and next(n for n in nodes if n.name == "body"), 0.0))
    assert extraction.main_text(page) != want


def test_prose_in_a_wrapper_of_doubtful_name_stays():
    words = " ".join(f"word{i}" for i in range(120))
    for name in ("search-result", "form-text", "related content", "notice", "widget-body"):
        assert extraction.main_text(f"<body><div class='{name}'><p>{words}</p></div></body>") == words
    assert extraction.main_text(f"<body><div id=comments><p>{words}</p></div><article><p>Short.</p></article></body>") == "Short."
    #: A wrapper of nearly all prose is the main text whatever its words, where the page has no article.
    for mark in ("class='ad-free-story'", "id='menu-page'", "class='comment-policy-article'", "class='footer'"):
        assert extraction.main_text(f"<body><h1>Title</h1><div {mark}><p>{words}</p><p>{words}</p></div><p>Other.</p></body>").count(words) == 2


def test_extraction_of_long_and_deep_pages_takes_no_square_time():
    import time

    start = time.time()
    assert extraction.main_text("<div><p>" * 30000 + "deep") == "deep"
    assert extraction.main_text("<div>" * 30000 + "</span>" * 30000 + "deep") == "deep"
    assert len(extraction.main_text("<p>" + "long " * 400_000)) == 5 * 400_000 - 1
    assert time.time() - start < 60


def test_extraction_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a", "t", 7), (1, "u", "<p>a", "t", 7), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((tuple(r) for r in extraction.extract(rows).collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)


def test_extraction_of_nothing(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_model_weights_learn_from_texts_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(lm, "LEARN_EVERY", 1)
    texts = [f"the cat sat on mat number {i} and a dog ran" for i in range(60)]
    table = lm.encoded(lm_rows(texts)(spark))
    only = lm.fit(table)
    with monkeypatch.context() as m:
        m.setattr(lm, "refined", lambda model, *a: model)
        first = lm.fit(table)
    assert any((only.weights[k] != x).any() for k, x in first.weights.items())
    ids, counts = map(np.concatenate, zip(*lm.encoder()(pa.array(texts))))
    assert lm.log10_probabilities(only, ids, counts).sum() > lm.log10_probabilities(first, ids, counts).sum()


def test_steps_grow_with_the_windows():
    model = lm.lay_out(np.ones(lm.N_IDS), 64, 8)
    parts = [(np.arange(n) % 50, np.array([n])) for n in (100, 1000, 5, 333)]
    windows = sum(len(lm.windows_of(*p)[0]) for p in parts)
    assert lm.refine(model, iter(parts), 0.001) == -(-windows // lm.LEARN_EVERY)


def test_every_window_is_learned_from_once(monkeypatch):
    model = lm.lay_out(np.ones(lm.N_IDS), 64, 8)
    parts = [(np.arange(n) % 50, np.array([n - 7, 7])) for n in (100, 1000, 9, 333)]
    seen, gradients = Counter(), lm._gradients

    def counted(model, inputs, targets, wanted, *rest):
        seen.update(np.concatenate([inputs, targets, wanted], 1)[i].tobytes() for i in range(len(inputs)))
        return gradients(model, inputs, targets, wanted, *rest)

    monkeypatch.setattr(lm, "_gradients", counted)
    want = Counter()
    for ids, n in parts:
        inputs, targets, _ = lm.windows_of(ids, n)
        own = lm._look_up(model, ids)
        want.update(x.tobytes() for x in np.concatenate([own[inputs], own[targets], targets != -2], 1))
    assert lm.refine(model, iter(parts), 0.001) == sum(want.values())
    assert seen == want


def test_gradients_with_classes_of_unlike_size():
    rng = np.random.default_rng(6)
    counts = np.zeros(lm.N_IDS)
    counts[:30], counts[lm.END] = rng.integers(1, 50, 30), 5
    model = lm.lay_out(counts, 18, 4, (rng.integers(0, 30, 99), rng.integers(0, 30, 99), np.ones(99)))
    assert len(set(np.diff(model.firsts[:-1]))) > 1
    model.id_prior, model.class_prior = [x.astype(np.float64) for x in model.id_prior], model.class_prior.astype(np.float64)
    h, targets, before = rng.normal(0, 1, (60, lm.WIDTH)), rng.integers(0, 19, 60), rng.integers(0, 19, 60)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    g = {k: np.zeros_like(v) for k, v in model.weights.items()}
    _, dh = lm._log_probabilities(model, h, targets, g, before)
    loss = lambda: -lm._log_probabilities(model, h, targets, None, before)[0].mean()
    for array, slope in ((h, dh), *((model.weights[k], g[k]) for k in ("to_id", "id_bias", "to_class", "class_bias"))):
        for i in rng.choice(array.size, min(4, array.size), replace=False):
            kept, values = array.flat[i], []
            for step in (1e-5, -1e-5):
                array.flat[i] = kept + step
                values.append(loss())
            array.flat[i] = kept
            assert slope.flat[i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-7)


def test_toxicity_summaries_are_the_same_in_training_and_scoring(monkeypatch):
    """Repeats of a word count once whatever is beside it; spelled words count wherever their letters stand."""
    toxic, clean = ["you are an idiot and all know it", "that moron sat"] * 20, ["the cat sat on the mat", "all the good things come"] * 20
    seen = []
    monkeypatch.setattr(toxicity, "calibrate", lambda z, *_: seen.append(z) or np.array([1.0, 0.0, 0.0, -1.0]))
    machine = toxicity.train(toxic, clean, 0.5)
    assert np.allclose(seen[0], toxicity.Scorer(machine)(pa.array(toxic + clean)))
    same = toxicity.Scorer(machine)(pa.array(["idiot, idiot. idiot! (idiot) calm", "idiot calm", "calm IDIOT", "i, d, i -- o. t", "i d i o t", "i d\ni o t"]))
    assert np.allclose(same[0], same[1]) and np.allclose(same[1], same[2])
    assert np.allclose(same[3], same[4]) and np.allclose(same[4], same[5]) and same[3][0] > 0
    long = "x" * 100 + "idiot" + "y" * 50
    assert toxicity.Scorer(machine)(pa.array([long]))[0][0] > 0


def plain_log_probabilities(net, window):
    """One window by loops: each filter's largest response, then the softmax."""
    features = []
    for filters, biases, width in zip(net.filters, net.biases, langid.WIDTHS):
        for k in range(langid.FILTERS):
            found = [sum(float(net.embedding[window[at + i], e]) * float(filters[i * langid.EMBEDDING + e, k]) for i in range(width) for e in range(langid.EMBEDDING)) for at in range(langid.WINDOW - max(langid.WIDTHS) + 1)]
            features.append(max(0.0, max(found) + float(biases[k])))
    z = np.array(features) @ net.out.astype(float) + net.out_bias
    return z - np.log(np.exp(z - z.max()).sum()) - z.max()


def test_language_scores_against_plain_convolution():
    net = langid.train(["the cat sat on the mat and that was it " * 9, "el gato se sienta en la mesa y nada mas " * 9] * 4, ["en", "es"] * 4, steps=40)
    texts = ["The cat sat on the mat and el gato y nada " * n for n in (1, 9)] + ["", None, "12 !"]
    names, scores, means = langid.score(pa.array(texts, pa.string()), net)
    for t, name, score, mean in zip(texts[:2], names, scores, means):
        data = np.frombuffer(t.lower().encode(), np.uint8)
        windows, _, weight = langid.windows_of(data, np.array([0, len(data)]))
        logs = np.array([plain_log_probabilities(net, w) for w in windows])
        total = (logs[:, :2] * (weight / langid.WINDOW)[:, None]).sum(0)
        assert net.languages.index(name) == total.argmax() and abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-4
        assert abs(np.log(mean) - np.average(np.log(1 - np.exp(logs[:, 2])), weights=weight)) < 1e-3
    assert names[2:] == ["und"] * 3 and not scores[2:].any() and not means[2:].any()


def test_noise_is_told_from_language_at_any_length(docs):
    table = docs.filter("doc_id < 9000 and lang is not null").select("doc_id", "text", "lang").toPandas()
    learn = table["doc_id"] % 4 != 2
    net = langid.train(table["text"][learn].tolist(), table["lang"][learn].tolist())
    rng = np.random.default_rng(0)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    junk = [draw(x, n) for x in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for n in (80, 300, 5000)]
    clean = [t for t in table["text"][~learn] if len(t) >= 80]
    assert (langid.score(pa.array(junk, pa.string()), net)[2] < corpus_pipeline.LANGUAGE_CONFIDENCE).all()
    assert (langid.score(pa.array(clean, pa.string()), net)[2] >= corpus_pipeline.LANGUAGE_CONFIDENCE).mean() > 0.99


def test_language_sample_is_bounded_by_language(spark, monkeypatch):
    got = []
    monkeypatch.setattr(langid, "train", lambda texts, languages: got.append(list(zip(languages, texts))))
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(7, f"again {i}", "xx") for i in range(500)] + [(i, "t", "xx") for i in range(8, 12)] + [(None, "t", "xx"), (1, None, "yy"), (2, "", "yy")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16), sample_docs=50)
    assert Counter(x for x, _ in got[0]) == {"en": 50, "xx": 5} and ("xx", "again 0") in got[0]
    ranked = spark.range(3000).selectExpr("id", "xxhash64(id) h").orderBy("h").limit(50).collect()
    assert [t for x, t in got[0] if x == "en"] == [f"text {r.id}" for r in ranked]


def test_calibration_begins_when_all_that_was_learned_from_is_gone(monkeypatch):
    import tracemalloc

    held = []
    monkeypatch.setattr(toxicity, "slim", lambda: held.append(tracemalloc.get_traced_memory()[0]))
    clean = [" ".join(f"word{i}x{j}" for j in range(400)) for i in range(100)]
    tracemalloc.start()
    try:
        machine = toxicity.train(["you are an idiot and all know it", "that idiot sat"] * 20, clean, 0.3)
    finally:
        tracemalloc.stop()
    #: The weights are 4 MB; 40,000 words' segments and scores beside them would be more than 5 MB.
    assert len(machine.buckets) and held and held[0] < 7e6


def test_workers_are_slim_after_a_task_even_if_it_is_cut_short(monkeypatch):
    from corpuswright.llm import _spark

    calls = []
    monkeypatch.setattr(_spark, "slim", lambda: calls.append(1))
    assert list(_spark.lean(lambda batches: (2 * x for x in batches))(iter([1, 2]))) == [2, 4] and len(calls) == 1
    some = _spark.lean(lambda batches: iter(batches))(iter([1, 2]))
    next(some)
    some.close()
    assert len(calls) == 2
