"""The pipeline's stages on small fixtures: what they keep, and the cases that must not stop them."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
ROWS = [(9001, None), (9002, ""), (9003, " \n"), (None, "The and of to in it is that was for on"), (9004, "x" * 5000), (9004, "x" * 5000), (9005, "123 !!")]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    edges = spark.createDataFrame(ROWS, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    #: Names that stages use themselves.
    return table.unionByName(edges).withColumns({"score": F.lit(1), "h": F.lit("h"), "label": F.lit(0)}).cache()


def test_stages_keep_columns_and_rows_of_their_input(spark, docs):
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        assert set(got) <= rows and 0.5 * len(rows) < len(got), name


def test_nothing_in_nothing_out(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_decontaminate_is_done_with_the_matching_before_it_reads_the_documents_again(spark, docs):
    from corpuswright.llm import decontamination

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = decontamination.clean(docs, bench)
    assert "Generate" not in kept._jdf.queryExecution().optimizedPlan().toString()
    found = {r.doc_id for r in decontamination.matches(docs, bench).collect()}
    want = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is None or r.doc_id not in found]
    assert found and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_one_document_of_each_group_of_all_pairs_stays(spark):
    """Against all pairs of whole texts: every document linked with nothing stays, and one of each group."""
    from corpuswright.llm.near_copies import keep_one

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some = [r for r in table.collect() if r.text][:150]
    turned = [(100_000 + r.doc_id, r.text.replace(r.text.split()[len(r.text.split()) // 2], "instead")) for r in some[:40]]
    copies = [(200_000 + r.doc_id, r.text.upper()) for r in some[20:60]] + [(300_000 + r.doc_id, " ".join(r.text.split()[:40])) for r in some[:30]]
    rows = [(r.doc_id, r.text) for r in some] + turned + copies + [(400_000, None), (400_001, ""), (400_002, "a b"), (400_003, "A  b")]
    words = {i: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w] for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                old, new = sorted((group[a], group[b]), reverse=True)
                group = {i: new if g == old else g for i, g in group.items()}
    kept = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(group.values())) < len(rows) - 40
    assert sorted(group[i] for i in kept) == sorted(set(group.values()))


def test_rejecting_stages_agree_with_their_scores(spark, docs):
    """toxicity and language keep just the rows whose score, taken on its own, is on the right side."""
    from pyspark.sql import functions as F

    from corpuswright.llm import langid, toxicity

    machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clean = texts.select("doc_id", "text", toxicity.scorer(machine)("text").alias("s")).collect()
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.toxicity(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in clean if r.s < toxicity.THRESHOLD), key=str) and len(got) < len(clean)
    net = langid.fit(docs)
    told = docs.select("doc_id", "text", langid.predictor(net)("text").alias("p")).collect()
    got = [(r.doc_id, r.text) for r in corpus_pipeline.language(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in told if r.p["lang_pred"] != "und" and r.p["confidence"] >= 0.1), key=str)
    assert not {9001, 9002, 9003, 9005} & {i for i, _ in got}


def test_packed_pieces_tile_every_document(spark, docs):
    """Pieces of a document follow each other without a gap, and sequences are filled from 0 to at most 2048."""
    distinct = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = corpus_pipeline.pack(spark, distinct, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == {r.doc_id for r in distinct.select("doc_id").collect()}
    for found in pieces.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and all(s == 2048 * p for p, s, _ in found) and all(n == 2048 for _, _, n in found[:-1])
    for found in sequences.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) <= 2048
    total = sum(r.length for r in rows)
    assert -(-total // 2048) <= len(sequences) <= 1.05 * total / 2048 + 1
