"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

Documents whose sets of five-word shingles have a Jaccard likeness of at least
PERCENT link; linked documents form components.  The join is exact:

1. Equal sets are one node, named by a 64-bit mark.
2. Coarse prefixes.  In any fixed order of shingles two linked sets share l of
   their first n - ceil(t n) + l.  In the order of the hashes and with l of n/16
   these are joined on equality; a node that shares less than l of them with
   any others at all can have no link and is done.
3. Among the others each shingle's document frequency is counted, and sets are
   ordered by it.  A prefix longer by l - 1 holds at least l common shingles
   of every linked pair (Wang, Li and Feng, 2012).  Each node takes the l that
   costs least by estimate: list entries to scan, and candidates left to
   verify, at most a 1/l of those entries.  Shingles that no other node has
   fill prefixes without any entry, and bound the overlap of a pair from above.
4. Within each shingle's nodes first only pairs with one hub are verified: the
   node with the least share of shingles of its own.  That ties a group of
   copies together with as many pairs as it has members.
5. Then all pairs of nodes in different components that share at least
   min(l, l') prefix shingles and pass the bounds are verified.  What two nodes
   lack of the same hub bounds what they can share with each other.

No set is compared with all of a group, and no list, link or component goes to
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, fresh, lean, partitions, release
from ._words import mix, pieces, shingle_sets

PERCENT = 75
#: The coarse prefixes are lengthened by one in so many shingles.
COARSE = 16
#: Longest extension of a prefix that is weighed, and the cost of a verification in list entries.
MOST_MATCHES, VERIFY_COST = 8, 20.0
#: Words of 64 buckets that note which of its reference's shingles a node lacks.
LOST_WORDS = 4

_SALT = np.uint64(0x243F6A8885A308D3)


def mark(shingles: np.ndarray) -> np.int64:
    """64-bit mark of a set, the same in any order; it names the set as a node."""
    return np.add.reduce(mix(shingles ^ _SALT)).view(np.int64)


def _text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def set_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node) of every row; id and hash lead back to the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks = [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                marks.append(mark(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(marks, pa.int64())], names=["doc_id", "text_hash", "n_shingles", "node"])

    return docs.select("doc_id", _text_hash(), "text").mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, node long")


def _least_overlap(n: np.ndarray | int, percent: int):
    return -(-n * percent // 100)


def coarse_prefixes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node): in the order of the hashes, the prefix of every row's set; of equal sets in one task, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                tokens, marks = [], []
                for s in shingle_sets(batch.column("text").slice(a, b - a)):
                    if len(s) and (name := int(mark(s))) not in seen:
                        seen.add(name)
                        head = s[: len(s) - _least_overlap(len(s), percent) + max(1, len(s) // COARSE)]
                        tokens.append(head)
                        marks.append(np.full(len(head), name))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(marks).astype(np.int64))], names=["token", "node"])

    return docs.select("text").mapInArrow(lean(run), "token long, node long")


def node_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of every row; rows of equal sets are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                sets = list(shingle_sets(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([pa.array([mark(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(lean(run), "node long, shingles array<long>")


def adaptive_prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node, n, shared, l, p): each node's prefix of shingles that other nodes have too.

    ``p`` is the shingle's place (from 1) in the node's whole set, by frequency;
    ``shared`` is the number of its shingles that are not its own alone.
    """
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token")).repartition(partitions(sets.sparkSession), "token")
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter(F.col("df") > 1)
    common = counted.groupBy("node", "n").agg(F.collect_list(F.struct("df", "token")).alias("common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            flat = batch.column("common").flatten()
            df_all, token_all = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in batch.column("common")])])
            for i, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("n").to_pylist())):
                df, token = df_all[cuts[i] : cuts[i + 1]], token_all[cuts[i] : cuts[i + 1]]
                order = np.lexsort((token, df))
                df, token, own = df[order], token[order], n - len(df)
                least = _least_overlap(n, percent)
                if len(token) < least:  # too many shingles of its own for any link
                    continue
                entries = np.concatenate([[0], np.cumsum(df - 1.0)])
                choices = np.arange(1, min(MOST_MATCHES, least) + 1)
                ends = np.clip(n - least + choices - own, 0, len(df))
                cost = entries[ends] * (1 + VERIFY_COST / choices)
                best = int(np.argmin(cost))
                k = int(ends[best])
                for column, value in zip(out, (token[:k], np.full(k, node), np.full(k, n), np.full(k, len(token)), np.full(k, choices[best]), own + 1 + np.arange(k))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out], names=["token", "node", "n", "shared", "l", "p"])

    return common.mapInArrow(lean(run), "token long, node long, n long, shared long, l long, p long")


def _possible(n: Column, shared: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether two sets of n and m shingles, of which so many are not their own alone, can be alike enough."""
    most = F.least(shared, other)
    return most * 100 >= percent * (n + m - most)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their whole sets and of what both have."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("common"))


def linked(found: DataFrame, percent: int) -> DataFrame:
    return found.filter(F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, by alternating large and small stars.

    Each round is a join and a minimum by node; a hub's many links are only
    ever reduced to their minimum.  The links are checkpointed each round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    while True:
        #: Large star: every larger neighbour of a node links to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        #: Small star: every smaller neighbour of a node, and the node, link to its smallest neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        after = checkpointed(small.filter("u <> v").distinct())
        same = after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return nodes.select("node").join(edges.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def candidates(docs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(node, doc_id): nodes that share enough of their coarse prefixes with others, and a document of each."""
    nodes_of = marks.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    prefixes = coarse_prefixes(docs, percent).repartition(partitions(docs.sparkSession), "token")
    #: One exchange: a window in place of a sum and a join back to its rows.  It holds two numbers a row, and spills.
    same = Window.partitionBy("token")
    shared = prefixes.withColumns({"least": F.min("node").over(same), "most": F.max("node").over(same)}).filter("least <> most")
    #: Rows of equal sets count more than once, which only keeps more.
    near = shared.groupBy("node").agg(F.count("*").alias("matches"))
    return checkpointed(nodes_of.join(near, "node").filter(F.col("matches") >= F.greatest(F.lit(1), F.floor(F.col("n") / COARSE))).select("node", "doc_id"))


def chosen_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, shingles) of the chosen nodes.

    A doc_id may have rows of several texts; those of other sets are left out by their marks.
    """
    ids = chosen.select(F.col("doc_id").alias("c")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("c")), "left_semi")
    return checkpointed(node_sets(texts).join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def hub_overlaps(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Overlaps of nodes (a) with hubs (b) of their prefix shingles: those that they may link with, and their reference.

    A node's reference is, of its lists' hubs, that with the most nodes; it is
    compared with it even where the two cannot link, so one pair a node is
    added.  ``lost`` are buckets of the hub's shingles that the node lacks.
    """
    hub = prefix.groupBy("token").agg(F.max_by(F.struct("node", "n", "shared"), F.struct(F.col("shared") / F.col("n"), -F.col("node"))).alias("hub"), F.count("*").alias("df")).filter("df > 1")
    may = _possible(F.col("n"), F.col("shared"), F.col("hub.n"), F.col("hub.shared"), percent)
    starred = prefix.join(hub, "token").groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.first(may).alias("may"))
    members = starred.groupBy("b").agg(F.count("*").alias("members"))
    reference = starred.join(members, "b").groupBy("a").agg(F.max_by("b", F.struct("members", "b")).alias("b")).select("a", "b", F.lit(True).alias("reference"))
    pairs = starred.filter("may and a <> b").select("a", "b", F.lit(False).alias("reference")).unionByName(reference).groupBy("a", "b").agg(F.max("reference").alias("reference"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    lacks = both.select("a", "b", "reference", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.array_except("y", "x").alias("lacks"))

    def word(i: int) -> Column:
        bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(s, 8), F.lit(64)).cast("int"))
        return F.aggregate("lacks", F.lit(0).cast("long"), lambda got, s: got.bitwiseOR(F.when(F.pmod(s, F.lit(LOST_WORDS)) == i, bit(s)).otherwise(F.lit(0).cast("long"))))

    return checkpointed(lacks.select("a", "b", "reference", "n_a", "n_b", (F.col("n_b") - F.size("lacks")).alias("common"), *[word(i).alias(f"lost{i}") for i in range(LOST_WORDS)]))


def _most_common() -> Column:
    """What two nodes with one reference have in common at most.

    Of the hub's shingles: all but those that either lacks; one lacks its own,
    and the other at least one more for each bucket that only it has lost.
    Besides: the lesser of what they share with any others.
    """
    def more(mine: str, its: str) -> Column:
        return sum((F.bit_count(F.col(f"lost{i}{its}").bitwiseAND(F.bitwise_not(F.col(f"lost{i}{mine}")))) for i in range(LOST_WORDS)), F.lit(0))

    in_both = F.least(F.col("in_hub") - more("", "_b"), F.col("in_hub_b") - more("_b", ""))
    return in_both + F.least(F.col("shared") - F.col("in_hub"), F.col("shared_b") - F.col("in_hub_b"))


def cross_links(prefix: DataFrame, label: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components; lists with nodes of one component only need no pair.

    A list's largest component is not joined with itself.  What two nodes
    with one reference can have in common bounds most pairs of a group's
    outliers from above, without a look at their sets.
    """
    labelled = prefix.join(label, "node")
    sizes = labelled.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("components")).filter("components > 1").select("token", "largest")
    lost = [f"lost{i}" for i in range(LOST_WORDS)]
    refs = known.filter("reference").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("common").alias("in_hub"), *lost)
    open_lists = labelled.join(mixed, "token").join(refs, "node", "left")
    other = open_lists.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "shared", "l", "p", "component", "hub", "in_hub", *lost)])
    least = F.least("l", "l_b")
    length = lambda n: n - F.ceil(n * percent / 100) + least
    most = _most_common()
    bounded = F.coalesce((F.col("hub") != F.col("hub_b")) | (most * 100 >= percent * (F.col("n") + F.col("n_b") - most)), F.lit(True))
    pairs = (
        open_lists.filter("component <> largest").join(other, "token").filter("component <> component_b and (component_b = largest or node < node_b)")
        .filter(_possible(F.col("n"), F.col("shared"), F.col("n_b"), F.col("shared_b"), percent)).filter(bounded)
        .filter((F.col("p") <= length(F.col("n"))) & (F.col("p_b") <= length(F.col("n_b"))))
        .groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).agg(F.count("*").alias("matches"), F.first(least).alias("least")).filter("matches >= least").select("a", "b")
    )
    return checkpointed(linked(overlaps(pairs, sets), percent))


def labelled_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component) of every row; a row without a shingle has no component."""
    spark = docs.sparkSession
    marks = checkpointed(set_marks(docs))
    chosen = candidates(docs, marks, percent)
    release(spark)
    sets = chosen_sets(docs, chosen)
    release(spark)
    prefix = checkpointed(adaptive_prefixes(sets, percent))
    release(spark)
    known = hub_overlaps(prefix, sets, percent)
    first = linked(known, percent)
    release(spark)
    nodes = sets.select("node").distinct()
    label = checkpointed(components(nodes, first))
    release(spark)
    second = cross_links(prefix, label, known, sets, percent)
    release(spark)
    joined = components(nodes, first.unionByName(second))
    return marks.join(joined, "node", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    A null or empty text has no shingle and links with nothing: its component
    is its own doc_id.  Rows with equal sets share a component, repeated rows
    too.  A row of a null doc_id takes part as a copy of others, but never
    names a component unless there is no other.  An empty table gives no rows.
    """
    rows = labelled_rows(docs, percent)
    names = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("name"))
    return rows.join(names, "component", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, with one of each component: that of the smallest doc_id, once.

    A row of a null id stays only if its component has no other id; of rows
    with one id, that whose text's hash is least.  Rows of one id that nothing
    links all stay, as do all without a shingle, repeated ones included.
    """
    rows = labelled_rows(docs, percent).filter("component is not null")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("kept"))
    at, kept_id, kept_hash = fresh(), fresh(), fresh()
    kept = least.select(F.col("kept.doc_id").alias(kept_id), F.col("kept.text_hash").alias(kept_hash))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(has_words).withColumn(at, F.xxhash64("text"))
    chosen = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(at) == F.col(kept_hash)), "left_semi")
    return chosen.dropDuplicates(["doc_id", at]).drop(at).unionByName(docs.filter(~has_words))
