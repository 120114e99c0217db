"""Framed streams that split and restart, the store's commits, and bytes that are no text."""

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text as tx
from corpuswright.operators import html, order
from corpuswright.sources import framed
from corpuswright.sources.feature_store import FeatureStore, tokenize

RECORDS = [(f"k{i}", b"1 2\n" * (i % 5) + b"body %d\n" % i + b"x" * (i * 37 % 900)) for i in range(400)]


def held(rows, head="key"):
    return sorted((r[head], bytes(r["content"])) for r in rows)


@pytest.mark.parametrize("size", [1, 1000, 20_000, 1 << 30])
def test_runs_hold_every_record_once(tmp_path, size):
    """Bodies hold what looks like heads, and no new line need end them."""
    path = str(tmp_path / "f")
    content = b"".join(framed.frame(*r) for r in RECORDS)
    (tmp_path / "f").write_bytes(content + b"k 100\nshort")
    runs = list(framed.stretches(path, 0, (tmp_path / "f").stat().st_size, False, size))
    assert runs[0][0] == 0 and runs[-1][1] == len(content) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert [r for run in runs for r in framed.read_stretch(path, *run, False)] == RECORDS
    assert len(runs) == {1: 400, 1 << 30: 1}.get(size, len(runs))


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"".join(framed.frame(*r) for r in RECORDS))
    (tmp_path / "empty").write_bytes(b"")
    rows = framed.read_framed(spark, f"file:{tmp_path}", labels=False, stretch=5000).withColumn("task", F.spark_partition_id()).collect()
    assert held(rows) == sorted(RECORDS) and len({r["task"] for r in rows}) > 5
    (tmp_path / "labels").write_bytes(framed.frame(1.5, b"a\xff") + framed.frame(-2.0, b"b") + b"word 1\nc" + framed.frame(1.0, b"d"))
    assert held(framed.read_framed(spark, str(tmp_path / "lab*")).collect(), "label") == [(-2.0, b"b"), (1.5, b"a\xff")]
    with pytest.raises(FileNotFoundError):
        framed.read_framed(spark, str(tmp_path / "missing"))
    (tmp_path / "none").mkdir()
    assert framed.read_framed(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    """A record that is half there comes once, when it is whole; a restart neither loses nor repeats."""
    framed.register(spark)
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("framed_keys").option("stretch", 4000).load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
        return held(spark.read.parquet(out).collect())

    whole = b"".join(framed.frame(*r) for r in RECORDS)
    cut = len(b"".join(framed.frame(*r) for r in RECORDS[:150])) + 7
    (folder / "a").write_bytes(whole[:cut])
    assert run() == sorted(RECORDS[:150])
    with open(folder / "a", "ab") as f:
        f.write(whole[cut:])
    (folder / "b").write_bytes(framed.frame("other", b"file"))
    assert run() == sorted([*RECORDS, ("other", b"file")])
    assert run() == sorted([*RECORDS, ("other", b"file")])


def test_framed_files_are_written_and_read(spark, tmp_path):
    framed.register(spark)
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in RECORDS], "key string, content binary").repartition(3)
    rows.write.format("framed_keys").mode("append").save(str(tmp_path / "w"))
    assert held(framed.read_framed(spark, str(tmp_path / "w"), labels=False).collect()) == sorted(RECORDS)
    for key, body in (("two words", b"x"), ("k", b""), (None, b"x")):
        with pytest.raises(Exception, match="no framed record"):
            spark.createDataFrame([(key, bytearray(body))], "key string, content binary").write.format("framed_keys").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").iterdir() if not p.name.startswith(("_", "."))]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_an_append_counts_once_it_is_committed(spark, tmp_path, monkeypatch):
    store = FeatureStore(spark, str(tmp_path / "s"))
    assert store.count() == 0
    store.append(docs(spark, "one two", "three"), 1.0, "plain", batch="a")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.append(docs(spark, "lost"), 1.0, "plain", batch="b")
    assert store.count() == 2
    store.append(docs(spark, "four"), 0.0, "plain", batch="b")
    store.append(docs(spark, "five", "six", "seven"), 0.0, "plain", batch="a")
    assert store.count() == 4 and {r.doc_id.split(":")[0] for r in store.read().collect()} == {"a", "b"}


def test_appends_at_once_and_compaction(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = FeatureStore(spark, str(tmp_path / "s"))
    store.compact()  # nothing yet
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda i: store.append(docs(spark, f"word{i}", "more"), 1.0, "plain", batch=f"b{i}"), range(4))) == [2] * 4
    before = sorted(map(tuple, store.read().collect()))
    assert len(before) == 8
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before
    store.append(docs(spark, "newer"), 1.0, "plain", batch="b1")
    store.compact()
    store.append(docs(spark, "last"), 1.0, "plain", batch="b9")
    kept = sorted(r.doc_id.split(":")[0] for r in store.read().collect())
    assert kept == ["b0", "b0", "b1", "b2", "b2", "b3", "b3", "b9"]


def test_bytes_that_are_no_text(spark):
    raw = [bytes.fromhex("78857920FE"), b"\xe2\x82a\xc3\xa9", b"\xfd\xbf\xbf\xbf\xbf\xbf", b"\xf8\x88\x80\x80\x80", b"\xc3", b"", None, "é€😀".encode()]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(raw)], "i int, b binary")
    got = {r.i: r.p for r in rows.select("i", tx.lenient_points(F.col("b")).alias("p")).collect()}
    assert got[0] == [133, 254] and got[6] is None
    assert all(got[i] == tx.decode_lenient(x) for i, x in enumerate(raw) if x is not None)
    texts = rows.filter("i = 0").select(F.lit("d").alias("doc_id"), F.col("b").cast("string").alias("text"))
    for strategy in ("plain", "html"):
        assert sorted(r.feature for r in tokenize(texts, strategy, hashed=False).collect() if r.feature.startswith("point")) == ["point|133", "point|254"]
    pages = spark.createDataFrame([(1, bytearray(b"<p class='\xff'>na\xefve \xc3\xa9</p>&#xD800;"))], "page_id long, html binary")
    assert {"point"} < {r.kind for r in html.html_features(pages).collect()}


def test_random_bytes_as_by_a_plain_walk(spark):
    import random

    def walk(raw):
        out, i = [], 0
        while i < len(raw):
            value, i = raw[i], i + 1
            ones = next((k for k in range(8) if not value << k & 0x80), 8)
            if 2 <= ones <= 6:
                value &= (1 << 7 - ones) - 1
                end = min(i + ones - 1, len(raw))
                while i < end and 0x80 <= raw[i] < 0xC0:
                    value, i = value * 64 + raw[i] % 64, i + 1
            out += [value] * (value >= 128)
        return out

    draw = random.Random(4)
    raw = [bytes(draw.choices([*range(256), *range(128, 256), *range(128, 192)], k=draw.randrange(40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, b binary")
    got = {r.i: r.p for r in rows.select("i", tx.lenient_points(F.col("b")).alias("p")).collect()}
    assert all(got[i] == walk(x) == tx.decode_lenient(x) for i, x in enumerate(raw))


def test_ids_of_one_batch_are_cut_into_many_parts(spark):
    rows = spark.range(4000).select(F.concat(F.lit("0123456789abcdef0123456789abcdef:"), F.col("id").cast("string")).alias("doc_id"))
    assert len(order._cuts(rows.withColumn("_key", order.coarse("doc_id", rows)))) > order.PARTS // 2
    placed = order.sum_before(rows, [], order.coarse("doc_id", rows), ["doc_id"], F.lit(1).cast("bigint"), "place")
    assert [r.doc_id for r in placed.orderBy("place").collect()] == sorted(r.doc_id for r in rows.collect())
    none = rows.limit(0)
    assert order.sum_before(none, [], order.coarse("doc_id", none), ["doc_id"], F.lit(1).cast("bigint"), "place").count() == 0
