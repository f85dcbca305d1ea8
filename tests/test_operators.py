"""Small cases: golden demo layout, properties, edge cases, sources and streams."""

import pytest
from lantern.fixtures import spark_views
from lantern.functions import fn
from lantern.operators import diff, dups, hashing, search, stats, tree
from lantern.operators.tree import KEY
from lantern.plans import actions
from lantern.plans.repair import repair
from lantern.sources import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HASHES = "file_id long, location_id long, file_size long, hash_partial string, hash_fast string, hash_strong string, dup_count long, excluded int, stale int"


@pytest.fixture(scope="module")
def views(spark):
    return dict(zip(("f", "h0", "h", "o", "n", "w"), (x.persist() for x in spark_views(spark, SF, "f_line", "f_hashes0", "f_hashes", "f_folders", "f_listing", "f_locations")), strict=True))


def hashes(spark, rows):
    return spark.createDataFrame(rows, HASHES)


def test_golden_demo_groups(spark):
    """28 files of 17 contents in three locations: 7 groups, 18 files with copies; equal sizes of two contents stay apart."""
    contents = {"panorama": (153600, 3), "img0421": (40960, 2), "img0423": (51200, 4), "videoclip": (512000, 2), "family02": (40960, 3), "track02": (358400, 2), "taxreturn": (20480, 2)} | {f"single{i}": (1000 + i, 1) for i in range(10)}
    rows, files, truth, i = [], [], [], 0
    for name, (size, copies) in contents.items():
        for c in range(copies):
            i += 1
            rows.append((i, c % 3 + 1, size, f"p-{name}", None, None, 0, 0, 0))
            files.append((i, c % 3 + 1, f"d/{name}{c}", i, 0))
            truth.append((i, f"h-{name}"))
    f = spark.createDataFrame(files, "file_id long, location_id long, rel_path string, inode long, stale int")
    done = dups.three_gate(f, hashes(spark, rows), spark.createDataFrame(truth, "file_id long, content_hash string")).collect()
    assert len(done) == 28
    assert sum(r.dup_count > 0 for r in done) == 18
    assert len({r.hash_fast for r in done if r.dup_count > 0}) == 7
    assert sorted({r.dup_count for r in done}) == [0, 1, 2, 3]
    assert all(r.hash_fast is None for r in done if r.dup_count == 0)  # the funnel reads candidates only


def test_verified_files_group_apart_and_empty_hashes_never(spark):
    rows = [(1, 1, 9, "p", "f", "s" * 64, 0, 0, 0), (2, 1, 9, "p", "f", None, 0, 0, 0), (3, 1, 9, "p", "f", "", 0, 0, 0), (4, 1, 9, "", "", "", 5, 0, 0), (5, 1, 9, "p", "f", None, 7, 1, 0), (6, 1, 9, None, None, None, 0, 0, 0)]
    got = {r.file_id: r.dup_count for r in dups.dup_recount(hashes(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    live = {r.hash: r.dup_count for r in dups.live_dup_counts(hashes(spark, rows), fast=spark.createDataFrame([("f",)], "hash string")).collect()}
    assert live == {"f": 2}  # live counts include the verified file


def test_recount_is_idempotent_and_consistent(views):
    once = dups.dup_recount(views["h"])
    assert dups.dup_recount(once).exceptAll(once).count() == 0
    assert dups.dup_inconsistencies(once).count() == 0


def test_empty_tables(spark, views):
    none = views["h"].where("false")
    assert dups.dup_recount(none).count() == dups.candidate_groups(none).count() == 0
    assert diff.diff(views["f"].where("false"), views["n"]).where("change <> 'new'").count() == 0
    assert stats.folder_stats(views["f"].where("false"), views["o"], none).where("file_count <> 0").count() == 0


def test_diff_then_apply_gives_the_listing(views):
    changes = diff.diff(views["f"], views["n"])
    after, _ = diff.apply_diff(views["f"], views["h"], changes)
    left = after.where("stale = 0").select("location_id", "rel_path", "file_size", "modified_at")
    want = views["n"].select("location_id", "rel_path", "file_size", "modified_at")
    assert left.exceptAll(want).count() == want.exceptAll(left).count() == 0
    assert diff.diff(after, views["n"]).where("change <> 'unchanged'").count() == 0


def test_incremental_counters_equal_full_ones(views):
    f, n, h, o = (views[x] for x in ("f", "n", "h", "o"))
    h = h.withColumn("dup_count", F.lit(0).cast("long"))
    typed = lambda files, own: stats.folder_stats(files, o, own).join(stats.type_maps(stats.folder_types(files), *KEY), KEY, "left")
    shown = lambda df: df.where("rel_path <> ''").select(*KEY, "file_count", "total_size", "hidden_count", fn.type_counts_json(F.coalesce("type_counts", F.create_map().cast("map<string,bigint>"))).alias("types"))
    changes = diff.diff(f, n)
    after, hashes_after = diff.apply_diff(f, h, changes)
    full, inc = shown(typed(after, hashes_after)).persist(), shown(stats.apply_deltas(typed(f, h), diff.stat_deltas(changes, types=True))).persist()
    assert full.exceptAll(inc).count() == inc.exceptAll(full).count() == 0 and full.where("file_count > 0").count() > 50
    assert after.select("file_id").exceptAll(hashes_after.select("file_id")).count() == 0  # a hashes row for each file
    assert after.where("rel_dir is null or hidden is null or type_high is null").count() == 0
    assert diff.diff(after, n).where("change <> 'unchanged'").count() == 0
    assert diff.affected_ids(changes).join(after, "file_id", "left_anti").count() == 0


def test_covered_paths(spark):
    import random

    random.seed(3)
    name = lambda: random.choice(["a", "a-", "a.b", "ab", "a0", "b", "é", "a b"])
    path = lambda: "/".join(name() for _ in range(random.randint(1, 5)))
    paths = [(random.choice([1, 2, 3, None]), path()) for _ in range(1500)] + [(1, None), (None, None)]
    roots = [(random.choice([1, 3]), path()) for _ in range(40)] + [(None, "a"), (1, None), (1, "a/b"), (1, "a/b"), (1, "a")]
    df, at = spark.createDataFrame(paths, "location_id long, rel_path string"), spark.createDataFrame(roots, "location_id long, rel_path string")
    for itself in (False, True):
        inside = lambda k, p: any(k is not None and p is not None and x is not None and k == i and (p.startswith(x + "/") or itself and p == x) for i, x in roots)  # noqa: E731, B023
        want = sorted(((k, p, inside(k, p)) for k, p in paths), key=str)
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted((tuple(r) for r in tree.covered(df, at, itself).collect()), key=str) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tree.covered(df, at.limit(0)).where("covered").count() == 0 and tree.covered(df.limit(0), at).count() == 0


def test_quick_diff_of_folders(spark):
    folders = spark.createDataFrame([(1, "a", 0), (1, "a/x", 0), (1, "a/x/y", 0), (1, "a/z", 1), (1, "a/z/q", 1), (2, "a/x", 0), (1, "ab", 0)], "location_id long, rel_path string, stale int")
    files = spark.createDataFrame([(1, "a/x/y/f", 0), (1, "a/x-", 0), (1, "a/z/f", 1), (2, "a/x/f", 0)], "location_id long, rel_path string, stale int")
    listed = spark.createDataFrame([(1, "a/z"), (1, "a/new"), (1, "b"), (2, "a/x")], "location_id long, rel_path string")
    changes = diff.quick_diff_folders(folders, listed, 1, "a")
    assert {(r.rel_path, r.name, r.change) for r in changes.collect()} == {("a/x", "x", "missing"), ("a/z", "z", "recovered"), ("a/new", "new", "new")}
    f, o = diff.apply_quick_diff(files, folders, changes, 1)
    assert {tuple(r) for r in f.collect()} == {(1, "a/x/y/f", 1), (1, "a/x-", 0), (1, "a/z/f", 1), (2, "a/x/f", 0)}
    assert {tuple(r) for r in o.collect()} == {(1, "a", 0), (1, "a/x", 1), (1, "a/x/y", 1), (1, "a/z", 0), (1, "a/z/q", 1), (2, "a/x", 0), (1, "ab", 0), (1, "a/new", 0)}


def test_merge_plan_loses_no_hash(views):
    plan = actions.merge_plan(views["f"], views["h"], 1, 2)
    there = actions.dest_hash_index(views["f"], views["h"], 2).select("hash")
    copied = plan.where("action = 'unique'").select("hash")
    assert plan.where("hash is not null").select("hash").distinct().exceptAll(copied.union(there).distinct()).count() == 0
    assert copied.where("hash is not null").groupBy("hash").count().where("count > 1").count() == 0


def test_resolved_names_are_unique_and_follow_order(spark):
    claims = spark.createDataFrame([(1, "d", "a.txt", "p1"), (2, "d", "A.txt", "p2"), (3, "d", "a.TXT", "p3"), (4, "d", "a_1.txt", "p4"), (5, "e", ".bashrc", "p5"), (6, "e", ".bashrc", "p6")], "id long, directory string, filename string, rel_path string")
    taken = spark.createDataFrame([("d", "A_2.TXT")], "directory string, filename string")
    got = {r.id: r.final_name for r in actions.resolve_names(claims, taken).collect()}
    assert got == {1: "a.txt", 2: "A_3.txt", 3: "a_4.TXT", 4: "a_1.txt", 5: ".bashrc", 6: ".bashrc_1"}


def test_three_valued_exclusion(spark):
    f = spark.createDataFrame([(1, "note"), (2, None), (3, "x")], "file_id long, description string")
    got = search.where_all(f, [{"field": "description", "value": "note", "op": "exclude"}]).collect()
    assert [r.file_id for r in got] == [3]


def test_functions_on_odd_values(spark):
    df = spark.createDataFrame([("",), (".",), ("a.",), ("noext",), (".hidden.JPG",), ("x.tar.gz",), (None,)], "n string")
    got = {r.n: (r.c.high, r.c.low) if r.n is not None else None for r in df.select("n", fn.classify(F.col("n")).alias("c")).collect()}
    assert got == {"": ("other", "unknown"), ".": ("text", "dotfile"), "a.": ("other", "unknown"), "noext": ("other", "unknown"), ".hidden.JPG": ("image", "jpg"), "x.tar.gz": ("compressed", "gz"), None: None}
    sizes = spark.createDataFrame([("5MB",), (" 1.5 gb",), ("12",), ("x",), ("",), ("1.2.3MB",), (None,)], "t string").select(fn.parse_size(F.col("t")).alias("s")).collect()
    assert [r.s for r in sizes] == [5 << 20, 3 << 29, 12, None, None, None, None]
    assert spark.range(1).select(fn.utf8_safe(F.unhex(F.lit("61FF62"))).alias("t")).first().t == "a�b"
    nodes = spark.createDataFrame([("loc-5",), ("fld-7",), ("x",)], "n string").select(fn.parse_node_id(F.col("n")).alias("p")).collect()
    assert [tuple(r.p) for r in nodes] == [("location", 5), ("folder", 7), (None, None)]


def test_hashing_edges(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"abcd")), (3, bytearray(b"abXXcd")), (4, bytearray(b"abYYcd"))], "id long, content binary")
    got = {r.id: r.hash_partial for r in hashing.hash_partial(df, k=2).collect()}
    assert got[1] is None and got[3] == got[4] == got[2]
    assert spark.range(1).select(hashing.xxhash64_seed0(F.lit(b"abc")).alias("h")).first().h == "44bc2cf5ad770999"


def test_invalid_names(spark):
    df = spark.range(2).select(F.when(F.col("id") == 0, F.unhex(F.lit("61FF"))).otherwise(F.unhex(F.lit("6162"))).alias("path_bytes"))
    assert diff.invalid_names(df).count() == 1


def test_scan_catalog_and_log(spark, tmp_path, views):
    root = tmp_path / "tree"
    (root / "a/b").mkdir(parents=True)
    (root / "a/b/x.txt").write_bytes(b"hello")
    (root / "a/.dot").write_bytes(b"1")
    (root / "top.bin").write_bytes(b"0123456789")
    assert {(r.rel_path, r.file_size) for r in catalog.scan_tree(spark, f"file://{root}").collect()} == {("a/b/x.txt", 5), ("top.bin", 10)}
    assert {r.rel_path for r in catalog.scan_level(spark, f"file://{root}").collect()} == {"top.bin"}
    (root / ".h/deep").mkdir(parents=True)
    (root / ".h/deep/_y").write_bytes(b"12")
    (root / "a/link").symlink_to(root / "top.bin")
    (root / "b").symlink_to(root / "a")
    import os

    os.mkfifo(root / "a/pipe")
    want = {("a/b/x.txt", 0, 5), ("a/.dot", 1, 1), ("top.bin", 0, 10), (".h/deep/_y", 1, 2)}
    for at in (str(root), f"file://{root}/"):
        assert {(r.rel_path, r.hidden, r.file_size) for r in catalog.scan_all(spark, at).collect()} == want
    assert {r.rel_path for r in catalog.scan_all(spark, str(root), "a").collect()} == {"a/b/x.txt", "a/.dot"}
    assert catalog.scan_all(spark, str(root / "none")).count() == 0
    (root / "wide").mkdir()
    for i in range(3000):
        (root / f"wide/{i}").write_bytes(b"")
    wide = catalog.scan_all(spark, str(root), "wide").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in wide) == 3000 and len(wide) > 8 and max(r["count"] for r in wide) < 1500  # one folder, many tasks
    paths = spark.createDataFrame([(f"file://{root}/top.bin",)], "path string")
    import hashlib

    assert hashing.hash_partial_files(paths, k=2).first().hash_partial == hashlib.md5(b"0189").hexdigest()[:16]
    log = spark.createDataFrame([("A", "x", "B", "y", "copied", "")], ", ".join(f"{c} string" for c in catalog.LOG_COLUMNS))
    catalog.write_op_log(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).columns == catalog.LOG_COLUMNS
    assert catalog.op_log_catalog_row(spark, "merge", 2, "logs", 10, "2024-05-06 07:08:09").first().rel_path == "logs/merge-result-20240506-070809.csv"


def test_sizes_in_plans_follow_the_column_rule(spark):
    texts = ["5MB", " 1.5 gb", "12", "1e6", "x", "", None, "1.2.3MB", "0.2 mb", "7 B", "-5"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", fn.parse_size(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: fn.size_of(t) for t in texts}


def test_folded_tags(spark):
    rows = spark.createDataFrame([("ﬁne, Ｆine ,ﬁne，x,ｘ",), (None,), ("a,A",)], "t string")
    assert [r[0] for r in rows.select(fn.parse_tags(F.col("t"), nfkc=True)).collect()] == [["fine", "fine x", "x"], [], ["a"]]


def test_failed_listing(spark):
    records = catalog.parse_listing(spark.createDataFrame([("X\tboom",), ("F\ta",), ("Q\tx",), (None,)], "value string"))
    assert [r.message for r in catalog.failed_listing(records).collect()] == ["boom"]
    assert records.count() == 1


def test_repair_phases(views):
    done, sizes = repair(views["f"], views["o"], views["h0"], views["f"].select("file_id", "hash_partial"), views["f"].select("file_id", F.col("content_fast").alias("content_hash")), ("duplicates",))
    assert sizes is None and done.count() == views["h0"].count()


def test_tree_from_ids(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id long, parent_id long, name string")
    assert {(r.id, r.rel_path, r.depth) for r in tree.materialise_paths(rows).collect()} == {(1, "a", 1), (2, "a/b", 2), (3, "a/b/c", 3)}


def test_type_maps_and_subtrees(spark, views):
    f, o, h = views["f"], views["o"], views["h"]
    types = stats.folder_types(f)
    maps = stats.type_maps(types, "location_id", "rel_path").withColumn("json", fn.type_counts_json(F.col("type_counts")))
    back = maps.select("location_id", "rel_path", F.explode(fn.parse_type_counts(F.col("json"))).alias("type_high", "n")).select("location_id", "rel_path", "type_high", F.col("n").cast("long").alias("n"))
    assert back.exceptAll(types).count() == types.exceptAll(back).count() == 0
    assert stats.apply_type_deltas(types, types.withColumn("n", -F.col("n"))).count() == 0
    one = stats.folder_stats(f, o, h).where("location_id = 1 and rel_path = 'nation_15'").first()
    own = stats.subtree_stats(f, h, 1, "nation_15").first()
    assert all(own[c] == one[c] for c in stats.COUNTERS)


def test_moves_settle_names_and_copies_get_ids(spark):
    files = spark.createDataFrame(
        [(1, 1, "a/x.txt", "a", "x.txt", 5, 0, 0), (2, 1, "b/X.TXT", "b", "X.TXT", 6, 0, 0), (3, 2, "d/x.txt", "d", "x.txt", 7, 0, 0), (4, 3, "e/y.txt", "e", "y.txt", 8, 0, 0)],
        "file_id long, location_id long, rel_path string, rel_dir string, filename string, file_size long, stale int, hidden int",
    )
    online = spark.createDataFrame([(1,), (2,)], "location_id long")
    plan = actions.move_plan(files, files.where("file_id <> 3").select("file_id"), 2, "d", online)
    assert {r.file_id: (r.rel_path, r.state, r.stub) for r in plan.collect()} == {1: ("d/x_1.txt", "done", True), 2: ("d/X_2.TXT", "done", True), 4: ("d/y.txt", "deferred", False)}
    rename = actions.move_plan(files, files.where("file_id = 1").select("file_id"), 2, "d", online, new_name="X.txt").first()
    assert rename.state == "error: name taken" and not rename.stub
    copy = actions.move_plan(files, files.where("file_id in (1, 4)").select("file_id"), 2, "new", online, copy=True)
    assert {r.file_id: r.state for r in copy.collect()} == {1: "done", 4: "refused"}
    own = hashes(spark, [(1, 1, 5, "p", "f", None, 0, 0, 0)])
    made, hashed, tagged = actions.copy_rows(copy, files, own, spark.createDataFrame([(1, "red"), (4, "blue")], "file_id long, tag string"))
    assert [(r.file_id, r.location_id, r.rel_path, r.rel_dir) for r in made.collect()] == [(5, 2, "new/x.txt", "new")]
    assert [(r.file_id, r.location_id, r.hash_fast) for r in hashed.collect()] == [(5, 2, "f")] and [tuple(r) for r in tagged.collect()] == [(5, "red")]
    deltas = {(r.location_id, r.rel_dir): (r.file_count, r.total_size) for r in actions.move_deltas(files, plan).collect()}
    assert deltas == {(2, "d"): (2, 11), (1, "a"): (-1, -5), (1, "b"): (-1, -6)}


def test_batches_without_inodes_and_pages_behind_a_row(spark):
    rows = spark.createDataFrame([(i, 1, None if i % 2 else i << 18, 10) for i in range(1, 41)], "file_id long, location_id long, inode long, file_size long")
    want, total = {}, 0
    for r in sorted(rows.collect(), key=lambda r: (r.inode is not None, r.inode or 0, r.file_id)):
        want[r.file_id], total = total // 25, total + r.file_size
    assert {r.file_id: r.batch for r in hashing.byte_batches(rows, 25).collect()} == want
    named = rows.select("file_id", F.concat(F.lit("N"), F.col("file_id") % 7).alias("filename"))
    whole = [(r.filename, r.file_id) for r in search.paged(named, "name", size=100).collect()]
    behind = search.paged(named, "name", size=5, after=(whole[9][0].lower(), whole[9][1])).collect()
    assert [(r.filename, r.file_id) for r in behind] == whole[10:15]
