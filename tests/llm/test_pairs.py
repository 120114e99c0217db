"""Near copies and decontamination against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import decontamination, near_copies

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def brute_components(rows, percent=75):
    sets = [(d, frozenset(shingles(words(t)))) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(s), names.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def got_components(df):
    return sorted(map(tuple, near_copies.near_copies(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited_group(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at : at + (kind != 0)] = [] if kind == 1 else [f"x{rng.randrange(10**6)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_edited_groups(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 160))]
        texts += edited_group(rng, base, 12, 12)
    texts += [" ".join([rng.choice(vocabulary) for _ in range(30)] + passage + [rng.choice(vocabulary) for _ in range(rng.randrange(20))]) for _ in range(20)]
    texts += [texts[0]] * 5 + [texts[0].upper(), "", None, " ", "a b", "A  b", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[7]), (None, "alone here without any id"), (2000, "zz " * 300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, node int, token string")
    assert got_components(df) == brute_components(rows)


def test_near_copies_of_real_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert got_components(table) == brute_components([(r.doc_id, r.text) for r in table.collect()])


def test_near_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_copies(empty).count() == 0
    assert near_copies.keep_one(empty).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    chain = list(range(60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, 101), (102, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*chain, 100, 101, 102, 200]], "node long")
    got = {r.node: r.component for r in near_copies.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in chain}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_keep_one_keeps_columns_and_smallest_ids(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words are here to stay", "z"), (3, "other words are here to stay", "z"), (4, None, "n"), (None, "a b c d e f g", "q"), (None, "of no id and no copy at all", "q"), (None, "of no id and no copy at all", "q"), (3, "one id but not one text at all", "z"), (None, None, "n"), (None, " \n", "n")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (3, rows[2][1]), (4, None), (None, "of no id and no copy at all"), (3, "one id but not one text at all"), (None, None), (None, " \n")], key=str)


def brute_matches(docs, items, least=0.75):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if not v or len(v) < 5 and w != v:
                continue
            want = Counter(shingles(v))
            best = None
            for s in range(len(w) - len(v) + 1):
                have = Counter(shingles(w[s : s + len(v)]))
                value = sum((want & have).values()) / sum((want | have).values())
                if value >= least and (best is None or value > best):
                    best = value
            if best is not None:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.randrange(5, 50)))) for i in range(12)] + [(90, "two words"), (91, None), (92, "")]
    docs = []
    for d in range(30):
        w = some(rng.randrange(80))
        if d % 3 == 0:
            passage = words(items[rng.randrange(12)][1])
            if d % 2 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((d, " ".join(w).title()))
    return docs + [(50, None), (51, ""), (52, "Two  words"), (53, "there are two words"), (0, docs[0][1]), (None, docs[0][1])], items


@pytest.mark.parametrize("seed", [0, 2])
def test_matches_against_all_windows(spark, seed):
    docs, items = planted(seed)
    rows = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, m int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(rows, bench).collect()}
    want = brute_matches(docs, items)
    assert got == pytest.approx(want)
    kept = decontamination.clean(rows, bench)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want if d is not None}


def test_items_clipped_by_the_borders(spark):
    rng = random.Random(11)
    item = [f"w{i}" for i in rng.sample(range(1000), 40)]
    other = [f"x{i}" for i in range(30)]
    texts = {0: item[1:] + other, 1: other + item[:-1], 2: item[1:-1], 3: item[:-2], 4: item[2:] + other, 5: other + item[:-2], 6: item[:20]}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.start, r.length, r.similarity) for r in decontamination.matches(rows, bench).collect()}
    want = {0: (0, 40, 35 / 37), 1: (29, 40, 35 / 37), 2: (0, 38, 34 / 36), 3: (0, 38, 34 / 36), 4: (0, 40, 34 / 38), 5: (28, 40, 34 / 38)}
    assert {d: w[:2] for d, w in got.items()} == {d: w[:2] for d, w in want.items()}
    assert {d: w[2] for d, w in got.items()} == pytest.approx({d: w[2] for d, w in want.items()})


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_matches_of_null_and_repeated_ids_by_broadcast_and_by_shuffle(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    docs, items = planted(3)
    held = [t for d, t in docs if d is not None and brute_matches([(d, t)], items)]
    docs += [(60, "short text of six words here"), (60, held[0]), (61, held[0]), (61, f"{'before ' * 90}{held[1]}"), (None, held[1]), (None, "alone here without any item"), (None, held[1])]
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(rows, bench).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute_matches(docs, items)
    assert {None, 60, 61} <= {d for d, _ in want} and got == pytest.approx(want)


def test_edited_items_near_the_threshold_are_all_found(spark):
    rng = random.Random(12)
    items, docs = [], []
    for i in range(400):
        w = [f"w{x}" for x in rng.sample(range(5000), rng.randrange(39, 46))]
        items.append((i, " ".join(w)))
        w[rng.randrange(4, len(w) - 4)] = "changed"
        docs.append((i, " ".join(["before"] * rng.randrange(9) + w + ["after"] * rng.randrange(9))))
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(rows, bench).collect()}
    want = {(d, i): brute_matches([(d, t)], [(i, x)])[d, i] for (d, t), (i, x) in zip(docs, items)}
    assert len(want) == 400 and got == pytest.approx(want)


def test_first_of_the_best_windows(spark):
    rng = random.Random(13)
    items = [(i, " ".join(rng.choice("ab c d".split()) for _ in range(rng.randrange(5, 14)))) for i in range(6)]
    docs = [(d, " ".join(rng.choice("ab c d".split()) for _ in range(rng.randrange(60)))) for d in range(40)]
    want = {}
    for d, t in docs:
        for i, x in items:
            w, v = words(t), words(x)
            n = min(len(w), len(v))
            for s in range(len(w) - n + 1):
                have, need = Counter(shingles(w[s : s + n])), Counter(shingles(v))
                value = sum((need & have).values()) / sum((need | have).values())
                if value >= 0.5 and value > want.get((d, i), (0, 0, 0))[2]:
                    want[d, i] = (s, n, value)
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.length, r.similarity) for r in decontamination.matches(rows, bench, 0.5).collect()}
    assert want and got == want


def test_matches_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontamination.matches(none, items).count() == decontamination.matches(some, items).count() == 0
    assert decontamination.clean(some, items).count() == 1


@pytest.mark.parametrize("n", [1, 2, 7, 36, 63, 64, 150])
def test_lanes_count_as_single_bits_do(spark, n):
    rng = random.Random(n)
    rows = [([rng.getrandbits(63) for _ in range(n)],) for _ in range(5)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    marks = F.transform("h", lambda h: F.xxhash64(h, F.lit(2)))
    assert all(r[0] == r[1] for r in df.select(decontamination.fingerprint(F.col("h"), 2), decontamination.simhash(marks)).collect())


def test_radius_leaves_few_windows_out(spark):
    """At similarity 0.75 one fingerprint misses some windows, all of them hardly any."""
    assert decontamination.radius_for(0.75) == decontamination.RADIUS
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = [rng.getrandbits(62) for _ in range(35)]
        rows.append((a, a[:30] + [rng.getrandbits(62) for _ in range(5)]))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    found = [decontamination.near(decontamination.fingerprint(F.col("a"), t), decontamination.fingerprint(F.col("b"), t)) for t in range(decontamination.FINGERPRINTS)]
    got = df.select(*[f.alias(f"f{t}") for t, f in enumerate(found)]).collect()
    assert 0.88 < sum(r.f0 for r in got) / len(got) < 0.98
    assert sum(any(r) for r in got) >= len(got) - 1


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(50):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontamination.RADIUS):
            y ^= 1 << b
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x long, y long").select("*", F.monotonically_increasing_id().alias("i"))
    left = df.select("i", F.inline(decontamination.blocks_of(F.col("x"))))
    right = df.select("i", F.inline(decontamination.blocks_of(F.col("y")))).select("i", "block", F.explode(decontamination.changed(F.col("value"))).alias("value"))
    assert left.join(right, ["i", "block", "value"]).select("i").distinct().count() == 50


def test_fingerprint_against_plain_simhash(spark):
    df = spark.createDataFrame([("one two three four five six seven eight",)], "t string")
    hashes = decontamination.shingle_hashes(decontamination.word_list(F.col("t")))
    r = df.select(hashes.alias("h"), decontamination.simhash(hashes).alias("f")).first()
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in r.h) * 2 > len(r.h))
    assert r.f & (1 << 64) - 1 == want
