"""Folder paths from ids beyond the limits of a recursive query."""

from lantern.operators import tree


def test_paths_of_a_deep_tree_with_orphans_and_cycles(spark):
    chain = [(i, i - 1 or None, f"d{i}") for i in range(1, 151)]
    odd = [(1001, 999, "orphan"), (1002, 1001, "below"), (2001, 2002, "x"), (2002, 2001, "y"), (3000, None, "top")]
    got = {(r.id, r.rel_path, r.depth) for r in tree.materialise_paths(spark.createDataFrame(chain + odd, "id long, parent_id long, name string")).collect()}
    assert got == {(i, "/".join(f"d{k}" for k in range(1, i + 1)), i) for i in range(1, 151)} | {(3000, "top", 1)}


def test_more_folders_than_a_recursive_query_gives(spark):
    rows = spark.range(1, 1_100_001).selectExpr("id", "case when id > 1 then 1L end as parent_id", "cast(id as string) as name")
    assert tree.materialise_paths(rows).count() == 1_100_000
