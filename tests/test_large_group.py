"""A hash that many files share, all of them selected: nothing may make rows in proportion to all pairs."""

import time

from lantern.operators import dups
from lantern.plans import actions
from pyspark.sql import functions as F


def test_one_group_of_all_files(spark):
    n = 60_000
    ids = spark.range(1, n + 1, 1, 8)
    h = ids.selectExpr("id as file_id", "1L as location_id", "10L as file_size", "'p' as hash_partial", "'f' as hash_fast", "cast(null as string) as hash_strong", f"{n - 1}L as dup_count", "cast(id % 3 = 0 as int) as excluded", "0 as stale")
    f = ids.selectExpr("id as file_id", "1L as location_id", "cast(id as string) as rel_path", "cast(id % 7 as string) as filename")
    w = spark.createDataFrame([(1, "here", "agent")], "location_id long, name string, agent_name string")
    live = [i for i in range(1, n + 1) if i % 3]
    began = time.time()
    assert dups.expand_to_duplicates(h, h.select("file_id")).count() == n
    shown = dups.consolidate_preview(h, f, h.select("file_id"))
    assert {tuple(r) for r in shown.where("selected_id in (1, 3)").collect()} == {(1, len(live), sum(i % 7 == 1 for i in live)), (3, len(live), sum(i % 7 == 3 for i in live))}
    assert shown.agg(F.count("*")).first()[0] == n
    found = dups.duplicates_of(h, f, w, h.select("file_id"), 3)
    assert [(r.file_id, r.total) for r in found.where("selected_id = 1").orderBy("rank").collect()] == [(i, len(live) - 1) for i in (2, 4, 5)]
    assert [(r.file_id, r.total) for r in found.where("selected_id = 3").orderBy("rank").collect()] == [(i, len(live)) for i in (1, 2, 4)]
    assert found.count() == 3 * n
    assert time.time() - began < 60  # all pairs would be 2.4 billion rows


def test_plans_over_one_group_of_all_files(spark):
    n = 60_000
    ids = spark.range(1, n + 1, 1, 8)
    h = ids.selectExpr("id as file_id", "1L as location_id", "10L as file_size", "'p' as hash_partial", "'f' as hash_fast", "cast(null as string) as hash_strong", f"{n - 1}L as dup_count", "0 as excluded", "0 as stale")
    f = ids.selectExpr("id as file_id", "id % 2 as location_id", "cast(id % 7 as string) as filename", "if(id = 9, 'text', '') as description", "id as modified_at", "0 as stale")
    online = spark.createDataFrame([(1,)], "location_id long")
    sources = actions.copy_plan(f, h, h.select("file_id"), online)
    assert sources.where("source_id = if(selected_id % 2 = 1, selected_id, 1) and result = 'copied'").count() == n
    merged = actions.merged_metadata(f, h, spark.createDataFrame([(5, "red"), (6, "blue")], "file_id long, tag string"), h.select("file_id"))
    assert merged.where("tags = array('blue', 'red') and description = 'text' and modified_at = 1").count() == n
    own = actions.merged_metadata(f, h, spark.createDataFrame([(5, "red"), (6, "blue")], "file_id long, tag string"), h.select("file_id"), same_name=True)
    assert own.where("selected_id % 7 = 5 and tags = array('red') and modified_at = 5").count() == sum(i % 7 == 5 for i in range(1, n + 1))
