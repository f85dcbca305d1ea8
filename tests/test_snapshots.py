"""Snapshots of catalog tables: publishing, upserts, compaction, and readers of old versions."""

import pytest
from lantern.sources import catalog, snapshots
from lantern.sources.snapshots import Rules, compact, drop_versions, publish, snapshot, upsert
from pyspark.sql import functions as F

FILE = "location_id long, rel_path string, file_id long, file_size long, stale int, description string"
RULES = {"files": snapshots.FILES}


def files(spark, *rows):
    return spark.createDataFrame(list(rows), FILE)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tables_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "cat")
    assert snapshot(spark, folder).names() == []
    a, b = files(spark, (1, "x", 1, 5, 0, None), (None, "y", 2, 6, 0, "n")), spark.createDataFrame([("t", 1)], "tag string, file_id long")
    assert publish(spark, folder, {"files": a, "tags": b}) == 1
    old = snapshot(spark, folder)
    assert content(old.table("files").where("location_id = 1")) == content(a.where("location_id = 1")) and old.table("files").count() == 2
    broken = b.withColumn("file_id", F.raise_error(F.lit("disk full")).cast("long"))
    with pytest.raises(Exception, match="disk full"):  # between two tables: the first one is written by then
        publish(spark, folder, {"files": a.limit(0), "tags": broken})
    assert snapshot(spark, folder).version == 1 and snapshot(spark, folder).table("files").count() == 2
    assert publish(spark, folder, {"files": a.limit(1)}) == 2
    assert snapshot(spark, folder).table("files").count() == 1 and snapshot(spark, folder).table("tags").count() == 1
    assert old.table("files").count() == snapshot(spark, folder, 1).table("files").count() == 2  # a reader stays where it is
    with pytest.raises(ValueError, match="no version 9"):
        snapshot(spark, folder, 9)


def test_two_writers_take_turns(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cat")
    row = files(spark, (1, "x", 1, 5, 0, None))
    publish(spark, folder, {"files": row})
    write_new, others = snapshots._Folder.write_new, []

    def late(self, name, text):
        if not others:  # another writer publishes between this one's reading and writing
            others.append(1)
            publish(spark, folder, {"tags": row.select("file_id")})
        return write_new(self, name, text)

    monkeypatch.setattr(snapshots._Folder, "write_new", late)
    assert publish(spark, folder, {"more": row}) == 3
    assert snapshot(spark, folder).names() == ["files", "more", "tags"]


def test_upserts_equal_the_batch_form(spark, tmp_path):
    folder = str(tmp_path / "cat")
    base = files(spark, (1, "a", 1, 5, 1, "kept"), (1, "b", 2, 6, 0, None), (2, "c", 3, 7, 1, None))
    publish(spark, folder, {"files": base}, RULES)
    rows = spark.createDataFrame([(1, "a", 50, 1), (1, "a", 51, 2), (1, "new", 8, 3), (1, "new", 9, 0), (3, "far", 1, 4)], "location_id long, rel_path string, file_size long, seq long")
    batch = catalog.with_ids(rows.withColumn("stale", F.lit(0)))
    assert upsert(spark, folder, {"files": batch}, "s", 0, order="seq") == 2
    want = catalog.upsert_files(base, rows, order="seq")
    got = snapshot(spark, folder).table("files")
    assert content(got.select(sorted(got.columns))) == content(want.select(sorted(got.columns)))
    assert {r.rel_path: r.file_size for r in got.collect()} == {"a": 51, "b": 6, "c": 7, "new": 8, "far": 1}  # a row per key, the last one's size
    assert {r.file_id for r in got.collect()} >= {1, 2, 3} and got.where("file_id is null").count() == 0
    before = snapshot(spark, folder)
    assert upsert(spark, folder, {"files": batch}, "s", 0, order="seq") == 2  # the batch is applied already
    assert snapshot(spark, folder).manifest == before.manifest
    assert before.pieces("files")["part=2"] == snapshot(spark, folder, 1).pieces("files")["part=2"]  # untouched parts are not written


def test_compaction_keeps_readers_and_later_upserts(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cat")
    publish(spark, folder, {"files": files(spark, (1, "a", 1, 5, 0, None), (2, "c", 3, 7, 0, None))}, RULES)
    for n in range(3):
        upsert(spark, folder, {"files": files(spark, (1, "a", None, 10 + n, 0, None), (1, f"n{n}", 100 + n, n, 0, None))}, "s", n)
    reader = snapshot(spark, folder)
    want = content(reader.table("files"))
    write_new, others = snapshots._Folder.write_new, []

    def late(self, name, text):
        if not others:
            others.append(1)
            upsert(spark, folder, {"files": files(spark, (1, "z", 200, 1, 0, None))}, "s", 3)
        return write_new(self, name, text)

    monkeypatch.setattr(snapshots._Folder, "write_new", late)
    compact(spark, folder, "files")
    now = snapshot(spark, folder)
    assert {p: len(x) for p, x in now.pieces("files").items()} == {"part=1": 2, "part=2": 1}  # merged rows, and what came meanwhile
    assert content(now.table("files")) == sorted([*want, (1, "z", 200, 1, 0, None)], key=str)
    assert content(reader.table("files")) == want
    assert drop_versions(spark, folder, keep=1) == 4  # the parts of location 1 that were merged
    assert content(snapshot(spark, folder).table("files")) == sorted([*want, (1, "z", 200, 1, 0, None)], key=str)


def test_a_first_upsert_may_repeat_a_key(spark, tmp_path):
    folder = str(tmp_path / "cat")
    rows = spark.createDataFrame([(1, "x", 1, 1), (1, "x", 2, 2)], "location_id long, rel_path string, file_count long, seq long")
    upsert(spark, folder, {"counters": rows}, "s", 0, rules={"counters": Rules(("location_id", "rel_path"), by="location_id")}, order="seq")
    assert content(snapshot(spark, folder).table("counters")) == [(1, "x", 2)]
    compact(spark, folder, "counters")
    assert content(snapshot(spark, folder).table("counters")) == [(1, "x", 2)]
    upsert(spark, folder, {"counters": rows.limit(0)}, "s", 1, order="seq")  # an empty batch is applied, too
    assert snapshots.applied(snapshot(spark, folder), "s", 1) and snapshot(spark, folder).table("counters").count() == 1


def test_an_upsert_writes_one_file_a_part(spark, tmp_path):
    """However many tasks its rows come from; of equal keys the last read still counts."""
    folder, rules = str(tmp_path / "s"), {"h": snapshots.HASHES}
    snapshots.publish(spark, folder, {"h": spark.range(500).selectExpr("id as file_id", "0L as n")}, rules)
    rows = spark.range(0, 1000, 1, 8).selectExpr("id % 500 as file_id", "id as n")
    snapshots.upsert(spark, folder, {"h": rows}, "x", 0, rules=rules)
    pieces = snapshots.snapshot(spark, folder).pieces("h")
    assert all(len(list((tmp_path / "s" / x[-1]).glob("*.parquet"))) == 1 for x in pieces.values() if len(x) > 1) and max(map(len, pieces.values())) == 2
    got = {r.file_id: r.n for r in snapshots.snapshot(spark, folder).table("h").collect()}
    assert got == {i: i + 500 for i in range(500)}
