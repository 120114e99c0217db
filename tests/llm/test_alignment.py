"""Cross-tokenizer alignment against a token-by-token version that encodes whole texts."""

import hashlib
import re

import numpy as np
import pytest

from corpuswright.llm import alignment
from corpuswright.llm.tokens import _byte_alphabet, tokenizer_path

EDGES = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "▁ marked"), (6, "a\n b\tc  d e  f"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "été à l’Île, naïve — ça"), (9, "日本語 テキスト 🙂 ok"),
    (10, "x" * 3000), (11, "don't I'll 12,345.67 !!!"), (11, "don't I'll 12,345.67 !!!"), (12, "a" + " " * 50 + "b"), (None, "no id"), (13, "　wide 　space"), (14, "é combining ́"), (15, "nul \x00 byte"),
    (16, "the the the the"), (17, "\n"), (18, "tail "), (19, "end "),
]


def brute(texts):
    """Rows in order: by whole encodings, two pointers over token ends, and counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(tokenizer_path(alignment.A_FILE))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.B_FILE))
    alphabet, rows, counts = _byte_alphabet(), [], {}
    for text in texts:
        groups, links = [], []
        if text:
            raw = (" " + text).encode()
            a = [(i, bytes(alphabet[c] for c in a_tok.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_tok.encode(text):
                p = b_tok.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                i = j = end_a = end_b = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if end_a <= end_b:
                        end_a += len(a[i][1])
                        group[0].append(a[i][0])
                        i += 1
                    else:
                        end_b += len(b[j][1])
                        group[1].append(b[j][0])
                        j += 1
                    if end_a == end_b:
                        groups.append(group)
                        group = ([], [])
                span = lambda t: [(x, int(p), int(p) + len(y)) for (x, y), p in zip(t, np.cumsum([0] + [len(y) for _, y in t]))]
                sb, k = span(b), 0
                for x, p, q in span(a):
                    while sb[k][2] <= p:
                        k += 1
                    m = k
                    while m < len(sb) and sb[m][1] < q:
                        links.append((x, sb[m][0]))
                        m += 1
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
        rows.append((groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    text_of = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [
        (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else "")
        for groups, links in rows
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    some = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return some + EDGES


@pytest.fixture(scope="module")
def want(docs):
    return sorted(((d, *row) for (d, _), row in zip(docs, brute([t for _, t in docs]))), key=str)


def test_equals_token_by_token_alignment(spark, docs, want):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "pairs": F.lit("x"), "n_a": F.lit(0)}).repartition(3)
    got = alignment.cross_tokenizer(table)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert brute(["▁ marked"])[0][:2] == (0, 0)


def test_slices_of_pairs_and_long_texts_change_nothing(spark, docs, want, monkeypatch):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.cross_tokenizer(table, most=500).collect()), key=str) == want
    encoders = alignment.pair()
    for text in [t for _, t in docs if t and len(t) > 200][:40] + [t for _, t in EDGES if t]:
        data, offsets = alignment.spaced(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        whole, parts = alignment.align(data, offsets, encoders), alignment._long(data, encoders, 50)
        assert [int(whole[k][0]) for k in COLUMNS[:4]] == [parts[k] for k in COLUMNS[:4]]
        assert (hashlib.sha256(whole["text"].tobytes()[:-1]).hexdigest() if whole["right"][0] else "") == parts["sha"]
        assert whole["pairs"].tolist() == parts["pairs"].tolist() and whole["times"].tolist() == parts["times"].tolist()


def test_no_documents(spark):
    assert alignment.cross_tokenizer(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_are_bounded(spark):
    counts = spark.createDataFrame([(a << alignment.B_BITS | b,) for a in range(10) for b in range(a + 1)], "pair int")
    found = alignment.slices(counts, 12)
    assert [(x, y) for x, y in found] == [(0, 3), (4, 5), (6, 6), (7, 7), (8, 8), (9, 9)]
