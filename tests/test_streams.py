"""Streams over several micro-batches, each held against the batch operators; batches that are repeated change nothing."""

import shutil
from datetime import datetime, timedelta

import pytest
from lantern.fixtures import spark_views
from lantern.operators import dups, hashing, stats
from lantern.sources import catalog
from lantern.sources.snapshots import HASHES, Rules, publish, snapshot
from lantern.streaming import stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return dict(zip(("f", "h0", "h", "o", "n"), (x.persist() for x in spark_views(spark, SF, "f_line", "f_hashes0", "f_hashes", "f_folders", "f_listing")), strict=True))


class Arriving:
    """A stream of tables that arrive one micro-batch after another."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir(parents=True)
        self.stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        self.checkpoint = str(folder / "checkpoint")

    def add(self, df):
        df.coalesce(1).write.parquet(f"{self.folder}/staged{self.n}")
        for p in sorted((self.folder / f"staged{self.n}").glob("*.parquet")):
            shutil.move(p, self.folder / "in" / f"{self.n:03}-{p.name}")
        self.n += 1

    def repeat_last(self):
        """As if the driver had died before it could note that the last micro-batch is done."""
        last = max((self.folder / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(cols), b.select(cols)
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_listing(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("F\td/x.txt\t5\t1\t2\t3\nH\td/x.txt\tabc\nbad\n")
    q = stream.stream_listing(spark, str(tmp_path)).writeStream.format("memory").queryName("listed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("listed").count() == catalog.read_listing(spark, str(tmp_path)).count() == 2


def test_ingest(spark, tmp_path, views):
    base = views["f"].select("location_id", "rel_path", "file_id", "file_size", "modified_at", "description", "stale")
    batch = views["n"].select("location_id", "rel_path", "file_size", "modified_at")
    folder = str(tmp_path / "cat")
    publish(spark, folder, {"files": base}, {"files": stream.FILES})
    arriving = Arriving(spark, tmp_path / "s", batch.schema)
    want = base
    for k, part in enumerate((batch.where("location_id < 3"), batch.where("location_id > 1").withColumn("file_size", F.col("file_size") + 1), batch.limit(0))):
        arriving.add(part)
        stream.stream_ingest(arriving.stream, folder, arriving.checkpoint, compact_every=2).awaitTermination(120)
        want = catalog.upsert_files(want, part).persist()
        assert same(stream.newest(spark, folder), want), k
    version = snapshot(spark, folder).version
    arriving.repeat_last()
    stream.stream_ingest(arriving.stream, folder, arriving.checkpoint).awaitTermination(60)
    assert snapshot(spark, folder).version == version


def test_counters(spark, tmp_path, views):
    deltas = views["f"].where("stale = 0").select("location_id", "rel_dir", F.lit(1).cast("long").alias("file_count"), F.col("file_size").alias("total_size"))
    folder = str(tmp_path / "cat")
    arriving = Arriving(spark, tmp_path / "s", deltas.schema)
    for part in (deltas.where("location_id <> 2"), deltas.where("location_id = 2")):
        arriving.add(part)
        stream.stream_stats(arriving.stream, folder, arriving.checkpoint).awaitTermination(120)
    full = stats.folder_stats(views["f"], views["o"], views["h"]).where("file_count > 0").select("location_id", "rel_path", "file_count", "total_size")
    assert full.exceptAll(stream.counters(spark, folder)).count() == 0
    now, before = snapshot(spark, folder), snapshot(spark, folder, 1)
    assert all(now.pieces("counters")[p] == x for p, x in before.pieces("counters").items() if p != "part=2")  # only touched folders are written
    rows = stream.counters(spark, folder).persist()
    rows.count()
    arriving.repeat_last()
    stream.stream_stats(arriving.stream, folder, arriving.checkpoint).awaitTermination(60)
    assert snapshot(spark, folder).version == now.version and same(stream.counters(spark, folder), rows)
    arriving.add(spark.createDataFrame([(1, "late", -3, -30)], deltas.schema))
    stream.stream_stats(arriving.stream, folder, arriving.checkpoint).awaitTermination(60)
    assert stream.counters(spark, folder).where("rel_path = 'late'").first().file_count == 0


def test_bursts_are_recounted_once(spark, tmp_path):
    row = "file_id long, location_id long, file_size long, hash_partial string, hash_fast string, hash_strong string, dup_count long, excluded int, stale int"
    hashes = spark.createDataFrame([(i, 1, 9, "p", h, None, 0, 0, 0) for i, h in ((1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"))], row)
    folder = str(tmp_path / "cat")
    publish(spark, folder, {"hashes": hashes}, {"hashes": HASHES})
    start = datetime(2024, 1, 1)
    at = lambda *xs: spark.createDataFrame([(h, start + timedelta(minutes=m)) for h, m in xs], "hash string, at timestamp")
    arriving = Arriving(spark, tmp_path / "s", "hash string, at timestamp")
    run = lambda: stream.stream_dup_recount(arriving.stream, folder, arriving.checkpoint, gap="10 minutes", late="0 seconds").awaitTermination(120)
    for m in (0, 5, 10):  # three micro-batches, each within the gap
        arriving.add(at(("a", m)))
        run()
    assert "recounts" not in snapshot(spark, folder) or snapshot(spark, folder).table("recounts").count() == 0
    version = snapshot(spark, folder).version
    stream.ingest_batch(hashes.where("file_id = 5").withColumn("hash_fast", F.lit("a")), version, folder, "other", "hashes")  # c becomes a meanwhile
    arriving.add(at(("z", 60)))
    run()
    done = snapshot(spark, folder)
    assert [(r.hash, r.changes) for r in done.table("recounts").collect()] == [("a", 3)]
    assert {r.file_id: r.dup_count for r in done.table("hashes").collect()} == {1: 2, 2: 2, 5: 2, 3: 0, 4: 0}
    flips = done.table("flips").collect()
    assert {(r.file_id, r.old_count, r.new_count, r.delta) for r in flips} == {(1, 0, 2, 1), (2, 0, 2, 1), (5, 0, 2, 1)}
    assert done.version - 1 in {r.version for r in flips}  # of the version that was current
    arriving.repeat_last()
    run()
    assert snapshot(spark, folder).table("flips").count() == 3


@pytest.mark.parametrize("cuts", [(0.5,), (0.02, 0.03, 0.9)])
def test_hash_queue_batches_do_not_depend_on_arrivals(spark, tmp_path, views, cuts):
    cap = 3_000_000
    work = views["f"].where("location_id < 4").select("location_id", "file_id", "inode", "file_size")
    want = hashing.byte_batches(work, cap).select("location_id", "file_id", "batch").persist()
    known = views["h0"].withColumn("dup_count", F.lit(0).cast("long")).withColumn("hash_fast", F.lit(None).cast("string")).withColumn("hash_strong", F.lit(None).cast("string")).persist()
    folder = str(tmp_path / "cat")
    publish(spark, folder, {"hashes": known}, {"hashes": HASHES})
    truth = views["f"].select("file_id", F.col("content_fast").alias("hash_fast"))
    hasher = lambda rows: rows.join(truth, "file_id")
    inodes = work.approxQuantile("inode", list(cuts), 0.0)
    arriving = Arriving(spark, tmp_path / "s", work.schema)

    def right(closed):
        after = catalog.upsert_hashes(known, truth.join(closed, "file_id", "left_semi"))
        return same(snapshot(spark, folder).table("hashes").select("file_id", "hash_fast", "dup_count"), dups.dup_recount(after).select("file_id", "hash_fast", "dup_count"))

    for low, high in zip((-1, *inodes), (*inodes, 1e18), strict=True):
        arriving.add(work.where((F.col("inode") > low) & (F.col("inode") <= high)))
        stream.stream_hash_queue(arriving.stream, folder, arriving.checkpoint, hasher, cap).awaitTermination(200)
        now = snapshot(spark, folder)
        assert now.table("queue_open").groupBy("location_id").agg(F.sum("file_size").alias("b")).where(F.col("b") >= 2 * cap).count() == 0
        assert right(now.table("queue_closed").select("file_id"))  # counts right after each arrival's batches
    version = now.version
    arriving.repeat_last()
    stream.stream_hash_queue(arriving.stream, folder, arriving.checkpoint, hasher, cap).awaitTermination(60)
    assert snapshot(spark, folder).version == version
    stream.close_queue(spark, folder, cap, hasher)
    done = snapshot(spark, folder)
    assert done.table("queue_open").count() == 0 and same(done.table("queue_closed").select("location_id", "file_id", "batch"), want)
    assert right(work.select("file_id"))


def test_arrivals_match_each_other(spark, tmp_path):
    row = "file_id long, location_id long, file_size long, hash_partial string, hash_fast string, hash_strong string, dup_count long, excluded int, stale int"
    known = spark.createDataFrame([(1, 1, 9, "p1", "k", None, 0, 0, 0), (2, 1, 9, "p2", None, None, 0, 0, 0), (3, 1, 9, "p9", "stale", None, 0, 0, 1)], row)
    shape = "arrival_id long, hash_fast string, hash_partial string, file_size long"
    first = [(10, "k", "p1", 9), (11, "x", "p3", 9), (12, "x", "p3", 9), (13, None, "p2", 9), (14, None, "p4", 9), (15, None, "p5", 9), (16, None, None, 9), (17, "stale", None, 0), (18, None, "p7", 0)]
    second = [(8, "x", "p3", 9), (20, "k", None, 9), (21, None, "p4", 9), (22, "y", "p5", 9), (23, None, "p3", 9), (24, None, "p6", 9), (25, None, "p6", 9), (26, "stale", None, 0), (27, None, "p7", 0)]
    arriving = Arriving(spark, tmp_path / "s", shape)
    out = str(tmp_path / "out")
    for rows in (first, second):
        arriving.add(spark.createDataFrame(rows, shape))
        stream.stream_arrivals(arriving.stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", arriving.checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.arrival_id, r.match_id, r.to_hash) for r in spark.read.parquet(out).collect())
    assert got == sorted(
        [(10, 1, False), (11, None, False), (12, 11, False), (13, None, True), (14, None, False), (15, None, False), (16, None, False), (17, None, False), (18, None, False)]
        + [(8, 11, False), (20, 1, False), (21, None, True), (14, None, True), (22, None, False), (15, None, True), (23, None, True), (24, None, True), (25, None, True), (26, 17, False), (27, None, False)],
    )


def test_many_equal_arrivals_reach_a_task_as_few_rows(spark):
    import pandas as pd

    rows = pd.DataFrame({"key": ["f:a"] * 1000 + ["g:b"], "asks": [True] * 1000 + [False], "arrival_id": range(1001), "known_id": pd.array([None] * 1001, "Int64"), "met": [False] * 1001})
    (out,) = stream._gathered(iter([rows]))
    assert list(out["key"]) == ["f:a", "g:b"] and [len(x) for x in out["asking"]] == [1000, 0] and list(out["silent"]) == [False, True]
