"""Repair: any of its phases, always in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.dups import dup_recount, three_gate
from lantern.operators.hashing import missing_partial
from lantern.operators.stats import folder_stats

PHASES = ("partials", "hashes", "duplicates", "sizes")


def repair(files: DataFrame, folders: DataFrame, hashes: DataFrame, partials: DataFrame, contents: DataFrame, phases: tuple[str, ...] = PHASES) -> tuple[DataFrame, DataFrame | None]:
    """(hashes, folder stats): partial hashes filled in from (file_id, hash_partial), the funnel, counts, sizes."""
    if "partials" in phases:
        found = missing_partial(files, hashes).select("file_id").join(partials.select("file_id", F.col("hash_partial").alias("__p")), "file_id")
        hashes = hashes.join(found, "file_id", "left").withColumn("hash_partial", F.coalesce("hash_partial", "__p")).drop("__p")
    if "hashes" in phases:
        hashes = three_gate(files, hashes, contents)
    if "duplicates" in phases:
        hashes = dup_recount(hashes)
    return hashes, folder_stats(files, folders, hashes) if "sizes" in phases else None
