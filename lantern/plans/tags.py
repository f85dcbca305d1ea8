"""Tags of files: (file_id, tag) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.dups import expand_to_duplicates
from lantern.tables import numbered


def file_tags(tags: DataFrame, file_ids: DataFrame) -> DataFrame:
    return tags.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def all_tags(tags: DataFrame) -> DataFrame:
    return tags.select("tag").distinct()


def add_tags(tags: DataFrame, hashes: DataFrame, file_ids: DataFrame, new: list[str]) -> DataFrame:
    """Tags after adding to the files and every active duplicate; adding twice changes nothing."""
    more = expand_to_duplicates(hashes, file_ids).select("file_id", F.explode(F.array(*map(F.lit, new))).alias("tag"))
    return tags.select("file_id", "tag").union(more).distinct()


def remove_tags(tags: DataFrame, file_ids: DataFrame, old: list[str]) -> DataFrame:
    """Tags after removing from the given files alone."""
    gone = file_ids.select("file_id", F.explode(F.array(*map(F.lit, old))).alias("tag"))
    return tags.join(gone, ["file_id", "tag"], "left_anti")


def set_tags(tags: DataFrame, hashes: DataFrame, file_id: int, wanted: list[str]) -> DataFrame:
    """Tags after one file has exactly the wanted ones: what it gains its duplicates gain too, what it loses they keep."""
    own = F.col("file_id") == file_id
    one = hashes.where(own).select("file_id")
    lost = tags.where(~own | F.col("tag").isin(*wanted) if wanted else ~own)
    gained = hashes.sparkSession.createDataFrame([(t,) for t in wanted], "tag string").join(tags.where(own).select("tag"), "tag", "left_anti")
    more = expand_to_duplicates(hashes, one).crossJoin(gained).select("file_id", "tag")  # the call's few tags
    return lost.select("file_id", "tag").union(more).distinct()


def propagated(tags: DataFrame, hashes: DataFrame, file_id: int, wanted: list[str]) -> DataFrame:
    """One row: how many other files set_tags gives tags that they lack."""
    own = F.col("file_id") == file_id
    gained = hashes.sparkSession.createDataFrame([(t,) for t in wanted], "tag string").join(tags.where(own).select("tag"), "tag", "left_anti")
    others = expand_to_duplicates(hashes, hashes.where(own).select("file_id")).where(~own)
    more = others.crossJoin(gained).join(tags, ["file_id", "tag"], "left_anti")  # the call's few tags
    return more.agg(F.countDistinct("file_id").alias("propagated"))


def copy_tags(tags: DataFrame, source_id: int, target_ids: DataFrame) -> DataFrame:
    own = tags.where(F.col("file_id") == source_id).select("tag")
    more = target_ids.select("file_id").crossJoin(own)  # one file's tags
    return tags.select("file_id", "tag").union(more.select("file_id", "tag")).distinct()


def intern_tags(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """The (tag_id, tag) vocabulary with the new names, numbered on by name."""
    new = names.select("tag").distinct().join(vocabulary, "tag", "left_anti")
    top = vocabulary.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("top"))
    added = numbered(new, "tag").crossJoin(top)  # one row
    return vocabulary.select("tag_id", "tag").unionByName(added.select((F.col("top") + F.col("number")).cast("long").alias("tag_id"), "tag"))
