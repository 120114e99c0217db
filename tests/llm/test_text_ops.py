"""Word hashing, token ids, fingerprints, token counts and packing against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuswright.llm import fingerprint, packing, token_counts
from corpuswright.llm._words import shingle_sets
from corpuswright.llm.tokens import encoder, tokenizer_path

DOCS = [
    (5, "The quick brown fox jumps over the lazy dog, again and again."), (1, None), (2, ""), (3, "a b c d e f"), (4, "  \n\t "),
    (7, "Été à la plage!! <|endoftext|> it's 2024 x<|startoftext|>"), (8, "word " * 6000), (9, "The quick brown fox jumps over the lazy dog, again and again."),
    (9, "The quick brown fox jumps over the lazy dog, again and again."), (None, "no id here"), (10, "x" * 20000), (11, "ΣΑΣ ΟΔΟΣ   é 日本語 ﬁ"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "piece", 1, "s") for i, t in DOCS], "doc_id long, text string, piece string, n_chars long, bucket string").repartition(3).cache()


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té", max_size=40)), max_size=8))
def test_shingle_sets(texts):
    sets = list(shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_set(a) & plain_set(b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_ids_equal_the_tokenizers(texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = [x for ids, n in encoder()(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.tolist() for x in got] == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_real_texts_equal_the_tokenizers():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text")
    got = [x for ids, n in encoder()(texts.combine_chunks()) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.tolist() for x in got] == [e.ids for e in exact.encode_batch(texts.to_pylist(), add_special_tokens=False)]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.9):
        common = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 4000 - len(common), dtype=np.uint64)])) * np.uint64(2) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = a[: fingerprint.K], b[: fingerprint.K]
        assert abs(fingerprint.resemblance(x, y) - true) < 0.12
        assert abs(fingerprint.containment(x, y) - share) < 0.2
        assert abs(fingerprint.distinct(x) / len(a) - 1) < 0.25
        assert (fingerprint.merge(x, y) == np.union1d(a, b)[: fingerprint.K]).all()
        assert (fingerprint.decode(fingerprint.encode(x)) == x).all()


def test_fingerprints_against_brute_force(spark, docs):
    got = sorted(map(tuple, fingerprint.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint").collect()), key=str)
    rows = sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] if r[0] is not None else 1 << 62, r[1]))
    want, marks = [], {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        near = [len(a & b) / len(a | b) if a and b else float(len(a) == len(b)) for a, b in ((plain_set(t), plain_set(x)) for x in (edited, following))]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
        marks[t] = None
    assert [r[:3] for r in got] == sorted((w[:3] for w in want), key=str)
    for a, b in zip(got, sorted(want, key=str)):
        assert a[3:5] == pytest.approx(b[3:5], abs=1e-9)
    assert len({r[5] for r in got if r[0] == 9}) == 1
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.filter("doc_id = 3")).select("near_next").first()[0] == 1.0


def test_token_counts_against_direct_counts(spark, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    exact.encode_special_tokens = True  # a separator's name in a text is ordinary text
    assert any("<|endoftext|>" in (t or "") for _, t in DOCS)
    want = sorted(len(exact.encode(t or "", add_special_tokens=False).ids) for _, t in DOCS)
    for block in (3, 64, 1 << 16):
        blocks = token_counts.flat_streams(docs, block_ids=block)
        got = token_counts.token_counts(blocks).collect()
        assert sorted(r.n_tokens for r in got) == want
        by = {}
        for r in sorted(got, key=lambda r: (r.stream, r.start, r.doc_no)):
            before = by.get(r.stream, (-1, 0))
            assert (r.doc_no, r.start) == (before[0] + 1, before[1])
            by[r.stream] = (r.doc_no, r.start + r.n_tokens + 1)
    assert token_counts.token_counts(token_counts.flat_streams(docs.limit(0))).count() == 0


def test_flat_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.choice([7, 8, 9, token_counts.END_ID], 1000).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    ends = [-1, *np.flatnonzero(ids == token_counts.END_ID).tolist()]
    want = [b - a - 1 for a, b in zip(ends, ends[1:])] + ([len(ids) - 1 - ends[-1]] if ends[-1] < len(ids) - 1 else [])
    got = token_counts.token_counts(token_counts.read_flat_files(spark, str(tmp_path), block_ids=13)).orderBy("doc_no").collect()
    assert [r.n_tokens for r in got] == want


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing_is_whole_and_tight(spark, docs):
    for capacity in (64, 2048):
        got, least = check_packing(packing.pack(docs, capacity=capacity).collect(), DOCS, capacity)
        assert got <= least + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_real_texts_in_small_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    got, least = check_packing(packing.pack(table, shard_pieces=60).collect(), texts, 2048)
    assert got <= least * 1.02 + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 200)
    a, b = (packing.best_fit(lengths, rng.permutation(200), [], 128) for _ in range(2))
    for _ in range(5):
        child = packing.crossover(a, b, lengths, 128, rng)
        assert sorted(i for x in child for i in x) == list(range(200))
        assert all(lengths[x].sum() <= 128 for x in child)
        a, b = b, child
