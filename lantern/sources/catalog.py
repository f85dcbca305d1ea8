"""Reading, writing and updating catalog tables, and the listings they come from."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.fn import classify_high, hidden_inherited, parse_tags
from lantern.operators.tree import KEY
from lantern.tables import prepare, written

# The columns of an operation's log, and the fields that a listing's records have at least.
LOG_COLUMNS = ["source_location", "source_path", "destination_location", "destination_path", "result", "detail"]
MINIMUM_FIELDS = {"F": 6, "D": 2, "H": 3}


def scan_tree(spark: SparkSession, path: str, recursive: bool = True, prefix: str | None = None) -> DataFrame:
    """(rel_path, file_size, modified_at, hidden, type_high) of the files below path, or below its folder `prefix`; their content is not read.

    Paths are relative to path either way. Spark's file index leaves out names with a leading dot or underscore;
    scan_all() lists those too.
    """
    root = path.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(f"{root}/{prefix}" if prefix else root)
    rel = F.regexp_replace("path", f"^[a-z0-9]+:/+{_quoted(root.split('://')[-1].strip('/'))}/", "")
    return df.select(rel.alias("rel_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), hidden_inherited(rel).cast("int").alias("hidden"), classify_high(F.substring_index(rel, "/", -1)).alias("type_high"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text).replace("/", "/+")


def scan_level(spark: SparkSession, path: str) -> DataFrame:
    return scan_tree(spark, path, recursive=False)


#: Names that a task hands on together, and files that a task looks up at a time.
NAMES = 10_000


def scan_all(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(rel_path, file_size, modified_at, hidden, type_high) of all regular files below root, or below its folder `prefix`, hidden names included.

    Folders are listed level by level, the folders of a level dealt over tasks; then all names are dealt anew to be
    looked up, so a folder of many files is one task's listing but not one task's files. Symbolic links, other special
    files and folders that cannot be read are skipped. root is a folder that all executors reach: a path or file: URI,
    or a URI of another file system that pyarrow knows (it lists sizes and times at once).
    """
    prepare(spark)
    root = root.rstrip("/")
    many = spark.sparkContext.defaultParallelism * 4
    level = spark.createDataFrame([(prefix.strip("/"),)], "rel_dir string")
    found = []
    while True:
        names = written(level.mapInPandas(lambda parts: _listed(root, parts), "rel_path string, folder boolean, file_size long, modified_at timestamp"))
        found.append(names.where("not folder").drop("folder"))
        below = names.where("folder").select(F.col("rel_path").alias("rel_dir"))
        n = below.count()
        if not n:
            break
        level = below.repartition(min(n, many))
    files = found[0]
    for df in found[1:]:
        files = files.unionByName(df)
    looked_up = files.repartition(many).mapInPandas(lambda parts: _looked_up(root, parts), "rel_path string, file_size long, modified_at timestamp")
    rel = F.col("rel_path")
    return looked_up.select(rel, "file_size", "modified_at", hidden_inherited(rel).cast("int").alias("hidden"), classify_high(F.substring_index(rel, "/", -1)).alias("type_high"))


def _local(root: str) -> str | None:
    """The path of a local root; None for other file systems."""
    from urllib.parse import unquote, urlparse

    if "://" not in root and not root.startswith("file:"):
        return root
    parts = urlparse(root)
    return unquote(parts.path) if parts.scheme == "file" else None


def _listed(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names right in each folder: folders, and files, with size and time where listing gives them."""
    import os

    columns = ["rel_path", "folder", "file_size", "modified_at"]
    local, rows = _local(root), []
    for b in parts:
        for folder in b["rel_dir"]:
            top = f"{folder}/" if folder else ""
            try:
                if local is None:
                    from pyarrow import fs

                    system, base = fs.FileSystem.from_uri(root)
                    for x in system.get_file_info(fs.FileSelector(f"{base}/{top}".rstrip("/"))):
                        if x.type in (fs.FileType.File, fs.FileType.Directory):
                            rows.append((top + x.base_name, x.type == fs.FileType.Directory, x.size, x.mtime and pd.Timestamp(x.mtime).tz_localize(None)))
                        if len(rows) >= NAMES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                    continue
                with os.scandir(f"{local}/{top}") as entries:
                    for x in entries:
                        try:
                            if x.is_symlink() or not (x.is_dir(follow_symlinks=False) or x.is_file(follow_symlinks=False)):
                                continue
                            rows.append((top + x.name, x.is_dir(follow_symlinks=False), None, None))
                        except OSError:
                            continue
                        if len(rows) >= NAMES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except OSError:
                continue
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _looked_up(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes and times of files whose listing gave none; files that are gone by then are left out."""
    import os
    import stat

    local = _local(root)
    for b in parts:
        if local is None:
            yield b
            continue
        rows = []
        for path in b["rel_path"]:
            try:
                s = os.lstat(f"{local}/{path}")
            except OSError:
                continue
            if stat.S_ISREG(s.st_mode):
                rows.append((path, s.st_size, pd.Timestamp(s.st_mtime_ns, unit="ns").floor("us")))
        yield pd.DataFrame(rows, columns=["rel_path", "file_size", "modified_at"])


def parse_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows of tab-separated records D, F, P, H, E, X; records with too few fields or unknown kinds are dropped."""
    # exploded, as an array of one: the optimizer would put the whole expression of a line in each place that names a field
    fields = lines.select(*(c for c in lines.columns if c != column), F.explode(F.array(F.split(F.col(column), "\t"))).alias("__parts"))
    parts = F.col("__parts")
    field = lambda i: F.get(parts, F.lit(i))
    kind = field(0)
    enough = F.when(kind.isin("P", "E", "X"), True)
    for k, n in MINIMUM_FIELDS.items():
        enough = F.when(kind == k, F.size(parts) >= n).otherwise(enough)
    is_file = kind == "F"
    return fields.where(enough).select(
        *(c for c in lines.columns if c != column),
        kind.alias("kind"),
        F.when(kind.isin("D", "F", "H", "X"), field(1)).alias("path"),
        F.when(is_file, field(2).try_cast("long")).alias("file_size"),
        F.when(is_file, field(3).try_cast("double")).alias("mtime"),
        F.when(is_file, field(4).try_cast("double")).alias("ctime"),
        F.when(is_file, field(5).try_cast("decimal(20,0)")).alias("inode"),
        F.when(kind == "H", field(2)).alias("hash_partial"),
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return parse_listing(spark.read.text(path))


def failed_listing(records: DataFrame) -> DataFrame:
    """The messages of a listing that failed; none if it did not."""
    return records.where("kind = 'X'").select(F.col("path").alias("message"))


def assemble_listing(records: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files with their partial hashes, one row per path; a hash may be missing. Of repeated files the smallest record counts."""
    key = [*(key or []), "path"]
    file = F.when(F.col("kind") == "F", F.struct("file_size", "mtime", "inode"))
    found = F.when(F.col("kind") == "H", F.nullif("hash_partial", F.lit("")))
    both = records.where("kind in ('F', 'H')").groupBy(*key).agg(F.min(file).alias("f"), F.max(found).alias("__found")).where("f is not null")
    known = reduce(and_, (F.col(c).isNotNull() for c in key))  # a null key equals none
    return both.select(*key, "f.*", F.when(known, F.col("__found")).alias("hash_partial")).withColumnRenamed("path", "rel_path")


def _upsert(old: DataFrame, new: DataFrame, key: list[str], take: dict[str, Column]) -> DataFrame:
    o = old.select(*key, *(F.col(c).alias(f"__o_{c}") for c in old.columns if c not in key), F.lit(True).alias("__old"))
    n = new.select(*key, *(F.col(c).alias(f"__n_{c}") for c in new.columns if c not in key), F.lit(True).alias("__new"))
    return o.join(n, key, "full_outer").select(*(F.col(c) if c in key else take[c].alias(c) for c in old.columns))


def with_ids(rows: DataFrame) -> DataFrame:
    """rows with file_id set, where it is missing, from their key."""
    own = F.shiftrightunsigned(F.xxhash64(*KEY), 1)
    return rows.withColumn("file_id", F.coalesce("file_id", own) if "file_id" in rows.columns else own)


def last_of_key(batch: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key: that of the largest `order`; without it, or where it ties, the largest row."""
    rest = [c for c in batch.columns if c not in key]
    row = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    return batch.groupBy(*key).agg(F.max(row).alias("__row")).select(*key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def upsert_files(catalog: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Insert or update by (location_id, rel_path). An update keeps file_id, description, excluded; stale becomes 0.

    Of a key that the batch repeats the row of the largest `order` counts. New rows get an id from their key.
    """
    batch = with_ids(last_of_key(batch, KEY, order))
    new = F.col("__new").isNotNull()
    take = {}
    for c in catalog.columns:
        if c in KEY:
            continue
        o = F.col(f"__o_{c}")
        n = F.col(f"__n_{c}") if c in batch.columns else F.lit(None)
        if c == "stale":
            take[c] = F.when(new, 0).otherwise(o)
        elif c in ("file_id", "description", "excluded", "date_cataloged"):
            take[c] = F.coalesce(o, n)
        else:
            take[c] = F.when(new, n if c in batch.columns else o).otherwise(o)
    return _upsert(catalog, batch, KEY, take)


def upsert_hashes(hashes: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or update by file_id (each once in the batch); a null new hash keeps the old one, the size is replaced."""
    new = F.col("__new").isNotNull()
    take = {}
    for c in hashes.columns:
        if c == "file_id":
            continue
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}") if c in batch.columns else F.lit(None)
        take[c] = F.coalesce(n, o) if c.startswith("hash_") or c not in batch.columns else F.when(new, n).otherwise(o)
    return _upsert(hashes, batch, ["file_id"], take)


def write_op_log(plan: DataFrame, path: str) -> None:
    plan.select(*LOG_COLUMNS).write.option("header", True).csv(path)


def op_log_path(op: str, folder: str, at: Column) -> Column:
    """The path of an operation's log, named by operation and UTC time."""
    return F.concat(F.lit(f"{folder}/" if folder else ""), F.lit(f"{op}-result-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(".csv"))


def op_log_catalog_row(spark: SparkSession, op: str, location_id: int, folder: str, size: int, at: str) -> DataFrame:
    """The catalog row of a written log."""
    path = op_log_path(op, folder, F.lit(at).cast("timestamp"))
    return spark.range(1).select(
        F.lit(location_id).cast("long").alias("location_id"), path.alias("rel_path"), F.substring_index(path, "/", -1).alias("filename"), F.lit("text").alias("type_high"), F.lit("csv").alias("type_low"), F.lit(size).cast("long").alias("file_size")
    )


def split_wide_catalog(wide_files: DataFrame) -> DataFrame:
    """The hashes table of a wide file table: non-stale rows with any hash."""
    any_hash = F.coalesce("hash_partial", "hash_fast", "hash_strong").isNotNull()
    return wide_files.where((F.col("stale") == 0) & any_hash).select("file_id", "location_id", "file_size", "hash_partial", "hash_fast", "hash_strong", "dup_count", F.col("excluded"), F.lit(0).alias("stale"))


def split_wide_stats(wide_locations: DataFrame) -> DataFrame:
    """Location stats of wide rows: nulls become 0 or {}, locations being deleted are dropped."""
    own = wide_locations.where(~F.col("name").startswith("__deleting_"))
    return own.select("location_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("file_count", "total_size")), F.coalesce("type_counts", F.lit("{}")).alias("type_counts"))


def split_wide_folder_stats(wide_folders: DataFrame, wide_locations: DataFrame) -> DataFrame:
    """Folder stats of wide rows (location_id, rel_path): nulls become 0 or {}; folders of locations being deleted are dropped."""
    kept = wide_locations.where(~F.col("name").startswith("__deleting_")).select("location_id")
    own = wide_folders.join(kept, "location_id", "left_semi")
    return own.select(*KEY, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("file_count", "total_size")), F.coalesce("type_counts", F.lit("{}")).alias("type_counts"))


def explode_legacy_tags(files: DataFrame) -> DataFrame:
    """(file_id, tag) of comma lists in column tags, normalised, each once."""
    return files.select("file_id", F.explode(parse_tags(F.col("tags"))).alias("tag")).distinct()


def add_ignore_rule(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules with those new ones that none equals; a global rule (no location) is its own key."""
    n = new.select("filename", "file_size", "location_id").distinct()
    same = (rules["filename"] == n["filename"]) & (rules["file_size"] == n["file_size"]) & rules["location_id"].eqNullSafe(n["location_id"])
    return rules.select("filename", "file_size", "location_id").unionByName(n.join(rules, same, "left_anti"))


def read_ignore_rules(rules: DataFrame, locations: DataFrame) -> DataFrame:
    return rules.join(locations.select("location_id", F.col("name").alias("location_name")), "location_id", "left").select("filename", "file_size", "location_id", "location_name")
