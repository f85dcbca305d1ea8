"""What must not grow faster than the input: rows of one task, calls, and how often a plan runs what it comes from."""

import time

import pandas as pd
from lantern import queries, tables
from lantern.fixtures import spark_views
from lantern.operators import dups, hashing
from lantern.plans import actions
from lantern.sources import catalog, snapshots
from lantern.streaming import stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HASHES = "file_id long, location_id long, file_size long, hash_partial string, hash_fast string, hash_strong string, dup_count long, excluded int, stale int"


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def reads(df, path):
    return any(str(path) in x for x in df.inputFiles())


def test_files_come_from_one_grouping_of_lineitem(spark):
    files, listing = spark_views(spark, SF, "f_line", "f_listing")
    assert not reads(files, "lineitem") and not reads(listing, "lineitem")


def test_arrivals_of_a_bucket_are_one_call():
    class State:
        exists, kept = False, None

        def get(self):
            return self.kept

        get = property(get)

        def update(self, value):
            self.exists, self.kept = True, value

    def told(rows, state):
        part = pd.DataFrame(rows, columns=["key", "asking", "silent", "known_id", "met"])
        (out,) = stream._answered((0,), iter([part]), state)
        return [(a, None if pd.isna(m) else m, t) for a, m, t in zip(out["arrival_id"], out["match_id"], out["to_hash"], strict=True)]

    state = State()
    first = [("f:x", [2, 1], False, None, False), ("f:k", [3], False, 9.0, False), ("g:p:1", [4], False, None, False), ("g:q:1", [5], False, None, True), ("o:6", [6], False, None, False)]
    assert told(first, state) == [(1, None, False), (2, 1, False), (3, 9, False), (4, None, False), (5, None, True), (6, None, False)]
    assert told([("f:x", [7], False, None, False), ("g:p:1", [], True, None, False), ("g:q:1", [8], False, None, False)], state) == [(7, 1, False), (4, None, True), (8, None, True)]
    assert set(state.kept[0]) == {"f:x", "f:k", "g:p:1", "g:q:1"}


def test_byte_batches_cut_a_disk_of_few_inodes(spark):
    n, coalesce = 40_000, "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(0, n, 1, 4).selectExpr("1L as location_id", "id as file_id", "id % 100 as inode", "10L as file_size")
    spark.conf.set(coalesce, "false")
    try:
        parts = hashing.byte_batches(rows, 1000)
        assert parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n
    finally:
        spark.conf.unset(coalesce)
    ahead = F.col("inode") * 400 + F.floor(F.col("file_id") / 100)
    assert parts.where(F.col("batch") != F.floor(ahead * 10 / 1000)).count() == 0 and parts.count() == n


def test_recount_runs_its_hashes_once(spark, tmp_path):
    h = stored(spark.createDataFrame([(1, 1, 9, "p", "a", None, 5, 0, 0), (2, 1, 9, "p", "a", None, 1, 0, 0), (3, 1, 9, "p", "a", None, 1, 1, 0), (4, 1, 9, "p", "b", None, 7, 0, 0)], HASHES), tmp_path / "h")
    flips = dups.recount_hashes(h, spark.createDataFrame([("a",)], "hash string"))
    assert not reads(flips, tmp_path)
    assert {tuple(r) for r in flips.collect()} == {(1, 1, 5, 1, 0), (3, 1, 1, 0, -1)}


def test_listing_is_grouped_once(spark):
    lines = [(1, "F\ta\t5\t1\t2\t3"), (1, "H\ta\tx"), (1, "H\ta\t"), (1, "H\tb\ty"), (None, "F\ta\t6\t1\t2\t3"), (None, "H\ta\tz"), (1, "F\tc\tno"), (1, None)]
    listed = catalog.assemble_listing(catalog.parse_listing(spark.createDataFrame(lines, "location_id long, value string")), ["location_id"])
    assert "Join" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.location_id, r.rel_path, r.file_size, r.hash_partial) for r in listed.collect()} == {(1, "a", 5, "x"), (None, "a", 6, None)}


def test_several_tasks_write_a_folders_text(spark, monkeypatch):
    monkeypatch.setattr(queries, "_BLOCK", 50)
    rows = [("en" if i % 3 else "de", None if i == 7 else f"text é {i}") for i in range(200)]
    root = queries._texts(spark.createDataFrame(rows, "rel_dir string, content string").repartition(5))
    for folder in ("en", "de"):
        with open(f"{root}/rel_dir={folder}/part-0.txt", encoding="utf-8") as f:
            assert sorted(f.read().split("\n")[:-1]) == sorted(c or "" for d, c in rows if d == folder)


def test_claims_are_run_once(spark, tmp_path):
    claims = stored(spark.createDataFrame([(1, "d", "a.txt", "x/a.txt"), (2, "d", "A.txt", "y/A.txt"), (3, "d", "a_1.txt", "z"), (4, "d", "b.txt", "b")], "id long, directory string, filename string, rel_path string"), tmp_path / "c")
    named = actions.resolve_names(claims, claims.limit(0).select("directory", "filename"))
    assert not reads(named, tmp_path)
    assert {r.id: r.final_name for r in named.collect()} == {1: "a.txt", 2: "A_2.txt", 3: "a_1.txt", 4: "b.txt"}


def test_copies_to_move_are_run_once(spark, tmp_path):
    h = stored(spark.createDataFrame([(1, 1, 9, "p", "a", None, 0, 0, 0), (2, 1, 9, "p", "a", None, 0, 1, 0), (3, 2, 9, "p", "a", None, 0, 0, 0), (4, 2, 9, "p", "a", "s", 0, 0, 0), (5, 1, 9, None, None, None, 0, 0, 0)], HASHES), tmp_path / "h")
    f = stored(h.selectExpr("file_id", "location_id", "'d' as rel_dir", "excluded", "stale").union(spark.createDataFrame([(6, 1, "e", 0, 0)], "file_id long, location_id long, rel_dir string, excluded int, stale int")), tmp_path / "f")
    picked = spark.createDataFrame([(i, 10 - i) for i in (1, 2, 5, 6)], "file_id long, position long")
    plan = actions.consolidate_plan(f, h, picked, spark.createDataFrame([(1,)], "location_id long"), "move_to", 2, "d")
    assert not reads(plan, tmp_path)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in plan.collect())
    assert got == [(2, 1, "stub", "stubbed"), (2, 2, "skipped", "skipped (excluded)"), (2, 3, "canonical", "kept"), (5, -1, "canonical", "copied"), (5, 5, "stub", "stubbed"), (6, -1, "canonical", "copied"), (6, 6, "stub", "stubbed")]


def test_a_copys_plan_is_run_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    h = stored(spark.createDataFrame([(1, 1, 9, "p", "a", None, 0, 0, 0), (2, 1, 9, "p", "b", None, 0, 0, 0), (3, 1, 9, "p", "c", None, 0, 0, 0), (4, 2, 9, "p", "a", None, 0, 0, 0)], HASHES), tmp_path / "h")
    names = spark.createDataFrame([(1, "d", "x.txt", "x"), (2, "e", "X.txt", None), (3, "d", "z.txt", "z"), (4, "e", "y.txt", "y")], "file_id long, rel_dir string, filename string, description string")
    kept = h.select("file_id", "location_id", "file_size", "stale", F.lit("2024-01-01").cast("timestamp").alias("modified_at"), F.lit(0).alias("hidden"), F.lit("text").alias("type_high"))
    f = stored(kept.join(names, "file_id").withColumn("rel_path", F.concat_ws("/", "rel_dir", "filename")), tmp_path / "f")
    tags = spark.createDataFrame([(4, "red"), (2, "blue")], "file_id long, tag string")
    plan = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "selected_id long, source_id long").withColumn("selected_id", counted("selected_id"))
    rows, hashed, tagged = actions.copied_rows(plan, f, h, tags, 3, "copies")
    words = {(r.rel_path, r.tag) for r in rows.join(tagged, "file_id").collect()}
    assert {(r.rel_path, r.description, r.hash_fast) for r in rows.join(hashed.select("file_id", "hash_fast"), "file_id").collect()} == {("copies/x.txt", "x", "a"), ("copies/X_1.txt", None, "b")}
    assert words == {("copies/x.txt", "red"), ("copies/X_1.txt", "blue")}
    assert seen.value == 3


def test_copies_metadata_reads_files_once(spark, tmp_path):
    h = spark.createDataFrame([(1, 1, 9, "p", "a", None, 0, 0, 0), (2, 1, 9, "p", "a", None, 0, 0, 0)], HASHES)
    f = stored(spark.createDataFrame([(1, "x", None, None, 0), (2, "y", "said", None, 0)], "file_id long, filename string, description string, modified_at timestamp, stale int"), tmp_path / "f")
    told = actions.merged_metadata(f, h, spark.createDataFrame([(2, "red")], "file_id long, tag string"), h.select("file_id"))
    assert not reads(told, tmp_path / "f")
    assert {(r.selected_id, *r.tags, r.description) for r in told.collect()} == {(1, "red", "said"), (2, "red", "said")}


def test_rows_of_a_key_are_sorted_once(spark):
    schema = "location_id long, rel_path string, file_id long, description string, __at long, __row long"
    rows = spark.createDataFrame([(1, "a", 5, None, -1, 0), (1, "a", 6, "later", 1, 0), (1, "a", 7, "last", 2, 0), (1, "b", None, "b", 1, 1)], schema)
    merged = snapshots.FILES.merged(rows, rows.drop("__at", "__row").schema)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 5, "later"), (1, "b", None, "b")}


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in (f.getName() for f in seq(disk.getAllFiles())) if x.startswith("shuffle_")}
    seq = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    before, was = held(), spark.conf.get(tables._CLEANED)
    table = tables.written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.monotonic() + 10
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(tables._CLEANED) == was
    assert {r["count"] for r in table.collect()} == {100} and all(x.endswith(".zstd.parquet") for x in table.inputFiles())


def test_metadata_finds_selected_files_once(spark, tmp_path):
    h = stored(spark.createDataFrame([(1, 1, 9, "p", "a", None, 0, 0, 0), (2, 2, 9, "p", "a", None, 0, 0, 0)], HASHES), tmp_path / "h")
    f = spark.createDataFrame([(1, "x", None, None, 0), (2, "y", "said", None, 0)], "file_id long, filename string, description string, modified_at timestamp, stale int")
    told = actions.merged_metadata(f, h, spark.createDataFrame([(2, "red")], "file_id long, tag string"), spark.createDataFrame([(1,)], "file_id long"))
    assert not reads(told, tmp_path)
    assert [(r.selected_id, *r.tags, r.description) for r in told.collect()] == [(1, "red", "said")]
