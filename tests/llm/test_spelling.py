"""Spelling variants against all pairs of words, and both queries with SQL against DuckDB."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """Rows by comparing every two words."""
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(close[w]), counts[form[w]] if form[w] else None))
    return rows


def test_keys_meet_exactly_the_near_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(300)} | {"aaaaa", "aaaaaa", "aaaaaaa"})
    lengths = np.array([len(w) for w in words])
    key, kind, place, which = spelling.deletion_keys(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths)
    at = {}
    for k, *rest in zip(key.tolist(), kind.tolist(), place.tolist(), which.tolist()):
        at.setdefault(k, []).append(rest)
    found = Counter()
    for rows in at.values():
        kinds, places, whichs = zip(*rows)
        for word, n, _, _ in spelling.meetings(list(kinds), list(places), [words[w] for w in whichs], [1] * len(rows)):
            found[word] += n
    assert found == Counter({w: n for w in words if (n := sum(near(w, v) for v in words))})
    assert [list(x) for x in spelling._verified([0, 0, 0, 2], [0, 0, 1, 0], ["axxxx", "bxxxx", "axxxx", "xxxx"])] == [[0, 1], [2], [3]]


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in links}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    base = ["color", "colour", "grammar", "Éclair", "naïveté", "aaaaaa", "Straße", "weather"]
    out = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeÿ×") + w[k + 1 :], w[:k] + "s" + w[k:], w.upper()])
            words.append(w)
        out.append((i if i % 50 else None, rng.choice([" ", "-", "\n", "9"]).join(words)))
    return out + [(7, None), (8, ""), (9, "123 ж !"), (5000, "longest" * 30000)] + [(6000, "repeat rows here")] * 3


def test_variants_equal_all_pairs(spark, docs):
    counts = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
                counts[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit(2)}).repartition(4)
    got = spelling.variants(table)
    assert {tuple(r) for r in got.collect()} == grouped(counts) and got.count() == len(counts)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
