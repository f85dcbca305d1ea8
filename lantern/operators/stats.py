"""Counters by folder, location and catalog. Files are summed per folder before anything goes up the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.fn import ancestors, basename
from lantern.operators.tree import KEY, below

COUNTERS = ["file_count", "total_size", "hidden_count", "duplicate_count"]


def _countable(files: DataFrame, hashes: DataFrame) -> DataFrame:
    dups = hashes.where("excluded = 0 and stale = 0 and dup_count > 0").select("file_id", F.lit(1).alias("__dup"))
    return files.where("stale = 0").join(dups, "file_id", "left")


def _sums() -> list:
    return [
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.count_if(F.col("hidden") == 1).alias("hidden_count"),
        F.count("__dup").alias("duplicate_count"),
    ]


def direct_stats(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Counters of the files right in each folder; rel_path '' is a location's root."""
    return _countable(files, hashes).groupBy("location_id", F.col("rel_dir").alias("rel_path")).agg(*_sums())


def direct_types(files: DataFrame) -> DataFrame:
    """(location_id, rel_path, type_high, n) of the files right in each folder, as rows."""
    return files.where("stale = 0").groupBy("location_id", F.col("rel_dir").alias("rel_path"), "type_high").agg(F.count("*").alias("n"))


def folder_stats(files: DataFrame, folders: DataFrame, hashes: DataFrame) -> DataFrame:
    """Counters of every folder with all below it; empty folders have 0. What is exploded is folders, not files."""
    up = direct_stats(files, hashes).select("location_id", F.explode(ancestors(F.col("rel_path"))).alias("rel_path"), *COUNTERS)
    sums = up.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in COUNTERS))
    return folders.select(*KEY).join(sums, KEY, "left").select(*KEY, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def folder_types(files: DataFrame) -> DataFrame:
    """(location_id, rel_path, type_high, n) of every folder with all below it."""
    up = direct_types(files).select("location_id", F.explode(ancestors(F.col("rel_path"))).alias("rel_path"), "type_high", "n")
    return up.groupBy(*KEY, "type_high").agg(F.sum("n").alias("n"))


def type_maps(types: DataFrame, *key: str) -> DataFrame:
    """type_counts map per key from (key, type_high, n) rows."""
    return types.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type_high", "n")))).alias("type_counts"))


def location_stats(files: DataFrame, hashes: DataFrame) -> DataFrame:
    return _countable(files, hashes).groupBy("location_id").agg(*_sums())


def folder_dup_rollup(files: DataFrame, folders: DataFrame, hashes: DataFrame) -> DataFrame:
    """folder_stats' duplicate_count alone; only duplicates are summed and exploded."""
    dups = hashes.where("excluded = 0 and stale = 0 and dup_count > 0").select("file_id")
    direct = files.where("stale = 0").join(dups, "file_id", "left_semi").groupBy("location_id", "rel_dir").agg(F.count("*").alias("n"))
    up = direct.select("location_id", F.explode(ancestors(F.col("rel_dir"))).alias("rel_path"), "n").groupBy(*KEY).agg(F.sum("n").alias("n"))
    return folders.select(*KEY).join(up, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("duplicate_count"))


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """stats after signed (location_id, rel_dir, file_count, total_size, ...) deltas went up the tree; no counter falls below 0.

    A delta of a location's root counts at rel_path '', which stands for the location. Where stats have type_counts
    (a map) and deltas type_high, types go up with the counters, and one that falls to 0 or less disappears.
    """
    types = ["type_high"] if "type_counts" in stats.columns and "type_high" in deltas.columns else []
    direct = deltas.groupBy("location_id", F.col("rel_dir").alias("rel_path"), *types).agg(*(F.sum(c).alias(c) for c in COUNTERS))
    up = direct.select("location_id", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("rel_path")))).alias("rel_path"), *types, *COUNTERS)
    if types:  # one row per folder and type first, so that a folder gathers no more rows than types
        up = up.groupBy(*KEY, *types).agg(*(F.sum(c).alias(c) for c in COUNTERS))
    own = F.collect_list(F.when(F.col("type_high").isNotNull(), F.struct("type_high", "file_count"))) if types else None
    sums = up.groupBy(*KEY).agg(*(F.sum(c).alias(f"__{c}") for c in COUNTERS), *([F.map_from_entries(own).alias("__types")] if types else []))
    both = stats.join(sums, KEY, "full_outer")
    counters = [F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).cast("long").alias(c) for c in COUNTERS]
    if not types:
        return both.select(*KEY, *counters)
    none = F.create_map().cast("map<string,bigint>")
    merged = F.map_zip_with(F.coalesce("type_counts", none), F.coalesce("__types", none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return both.select(*KEY, *counters, F.map_filter(merged, lambda _, n: n > 0).alias("type_counts"))


def apply_type_deltas(types: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, type_high, n) rows after signed rows of the same shape; a type at 0 or less disappears."""
    return types.unionByName(deltas).groupBy(*KEY, "type_high").agg(F.sum("n").alias("n")).where("n > 0")


def dashboard(files: DataFrame, hashes: DataFrame, locations: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: locations, files, bytes, duplicates, operations pending, and types with their numbers, the commonest first."""
    f = _countable(files, hashes).agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count("__dup").alias("duplicates"))
    n = locations.where(~F.col("name").startswith("__deleting_")).agg(F.count("*").alias("locations"))
    p = pending.where("status = 'pending'").agg(F.count("*").alias("pending"))
    by_type = files.where("stale = 0").groupBy("type_high").agg(F.count("*").alias("n"))
    t = by_type.agg(breakdown().alias("types"))
    return n.crossJoin(f).crossJoin(p).crossJoin(t)  # one row each


def breakdown() -> Column:
    """An aggregate of (type_high, n) rows: structs, the largest number first, then by name."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("type_high").alias("type"))))
    return F.transform(ranked, lambda x: F.struct(x["type"].alias("type"), (-x["less"]).alias("n")))


def recent_scans(scans: DataFrame, locations: DataFrame, limit: int = 5) -> DataFrame:
    """The scans that began last, with the names of their locations; those of locations being deleted are left out."""
    known = locations.where(~F.col("name").startswith("__deleting_")).select("location_id", F.col("name").alias("location_name"))
    return scans.join(known, "location_id").orderBy(F.desc("started_at"), F.desc("scan_id")).limit(limit)


def location_detail(files: DataFrame, folders: DataFrame, hashes: DataFrame, locations: DataFrame) -> DataFrame:
    """location_stats with the numbers of folders and stale files, the types, and the schedule where locations have one.

    schedule_days (a comma list of day numbers) becomes an array; schedule_time is 03:00 where it is not set.
    """
    sub = folders.groupBy("location_id").agg(F.count("*").alias("folder_count"))
    gone = files.where("stale = 1").groupBy("location_id").agg(F.count("*").alias("stale_count"))
    types = files.where("stale = 0").groupBy("location_id", "type_high").agg(F.count("*").alias("n")).groupBy("location_id").agg(breakdown().alias("types"))
    plan = [c for c in ("schedule_days", "schedule_time", "schedule_enabled") if c in locations.columns]
    out = locations.select("location_id", "name", *plan)
    for df in (location_stats(files, hashes), sub, gone, types):
        out = out.join(df, "location_id", "left")
    set_to = {
        "schedule_days": F.filter(F.transform(F.split(F.coalesce("schedule_days", F.lit("")), ","), lambda x: F.btrim(x).try_cast("int")), lambda x: x.isNotNull()),
        "schedule_time": F.coalesce(F.nullif("schedule_time", F.lit("")), F.lit("03:00")),
        "schedule_enabled": F.coalesce(F.col("schedule_enabled").cast("boolean"), F.lit(False)),
    } if plan else {}
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTERS, "folder_count", "stale_count")]
    none = F.array().cast("array<struct<type:string,n:bigint>>")
    return out.select("location_id", "name", *counts, F.coalesce("types", none).alias("types"), *(set_to[c].alias(c) for c in plan))


def folder_detail(files: DataFrame, folders: DataFrame, hashes: DataFrame) -> DataFrame:
    """folder_stats with the numbers of folders and stale files below, and the breadcrumb: (name, path) from the top folder down to it."""
    sub = folders.select("location_id", F.col("rel_path").alias("own"), F.explode(ancestors(F.col("rel_path"))).alias("rel_path")).where("own <> rel_path").groupBy(*KEY).agg(F.count("*").alias("subfolder_count"))
    gone = files.where("stale = 1").groupBy("location_id", "rel_dir").agg(F.count("*").alias("n"))
    gone = gone.select("location_id", F.explode(ancestors(F.col("rel_dir"))).alias("rel_path"), "n").groupBy(*KEY).agg(F.sum("n").alias("stale_count"))
    out = folder_stats(files, folders, hashes).join(sub, KEY, "left").join(gone, KEY, "left")
    crumbs = F.transform(ancestors(F.col("rel_path")), lambda p: F.struct(basename(p).alias("name"), p.alias("path")))
    return out.select(*KEY, *COUNTERS, F.coalesce("subfolder_count", F.lit(0)).alias("subfolder_count"), F.coalesce("stale_count", F.lit(0)).alias("stale_count"), crumbs.alias("breadcrumb"))


def type_breakdown(files: DataFrame) -> DataFrame:
    return files.where("stale = 0").groupBy("type_high").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type_high")


def pending_ops_count(pending: DataFrame) -> DataFrame:
    return pending.groupBy("status").agg(F.count("*").alias("n"))


def missing_stats(locations: DataFrame, stats: DataFrame) -> DataFrame:
    return locations.join(stats.select("location_id").distinct(), "location_id", "left_anti").select("location_id", "name")


def scan_summary(diff: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(location_id, change, n) of a diff's files; with folders (location_id, change), such as a diff of folders gives, also folder_n."""
    n = diff.groupBy("location_id", "change").agg(F.count("*").alias("n"))
    if folders is None:
        return n
    both = n.join(folders.groupBy("location_id", "change").agg(F.count("*").alias("folder_n")), ["location_id", "change"], "full_outer")
    return both.select("location_id", "change", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "folder_n")))


def selection_summary(files: DataFrame, file_ids: DataFrame, folder_stats_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: selected files and folders, and bytes, folders counting all below them."""
    f = files.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("fb"))
    d = folder_stats_rows.join(selected.select(*KEY).distinct(), KEY, "left_semi").agg(F.count("*").alias("folders"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("db"))
    return f.crossJoin(d).select("files", "folders", (F.col("fb") + F.col("db")).alias("bytes"))  # one row each


def subtree_stats(files: DataFrame, hashes: DataFrame, location_id: int, folder: str) -> DataFrame:
    """Counters of one folder with all below it, read through its path alone."""
    return _countable(files.where((F.col("location_id") == location_id) & below(F.col("rel_path"), folder)), hashes).agg(*_sums())
