"""Snapshot diff and the life of catalog rows. A row is its (location_id, rel_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.fn import ancestors, basename, classify_high, classify_low, dirname, hidden_inherited
from lantern.operators.dups import dup_recount
from lantern.operators.tree import KEY, below, covered


def _scope(df: DataFrame, prefix: str | None, location_id: int | None = None) -> DataFrame:
    if location_id is not None:
        df = df.where(F.col("location_id") == location_id)
    return df if prefix is None else df.where(below(F.col("rel_path"), prefix))


def _differs(a: str, b: str) -> Column:
    return ~F.col(f"{a}.file_size").eqNullSafe(F.col(f"{b}.file_size")) | ~F.col(f"{a}.modified_at").eqNullSafe(F.col(f"{b}.modified_at"))


def new_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files that the catalog lacks, even as stale ones."""
    return listing.join(catalog.select(*KEY), KEY, "left_anti")


def changed_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Non-stale catalog rows whose listed size or time differs."""
    c, n = catalog.where("stale = 0").alias("c"), listing.alias("n")
    return c.join(n, KEY).where(_differs("c", "n")).select(*KEY, F.col("c.file_id").alias("file_id"), F.col("n.file_size").alias("file_size"), F.col("n.modified_at").alias("modified_at"))


def gone_files(catalog: DataFrame, listing: DataFrame, prefix: str | None = None) -> DataFrame:
    """Non-stale catalog rows below prefix that are not listed."""
    return _scope(catalog.where("stale = 0"), prefix).join(listing.select(*KEY), KEY, "left_anti")


def recovered_files(catalog: DataFrame, listing: DataFrame, prefix: str | None = None) -> DataFrame:
    """Stale catalog rows that are listed again, and whether their size or time changed meanwhile."""
    c, n = _scope(catalog.where("stale = 1"), prefix).alias("c"), listing.alias("n")
    return c.join(n, KEY).select(*KEY, F.col("c.file_id").alias("file_id"), _differs("c", "n").alias("recovered_changed"))


def diff(catalog: DataFrame, listing: DataFrame, prefix: str | None = None) -> DataFrame:
    """(location_id, rel_path, file_id, change, old and new size and time): everything in one full outer join.

    change: new, changed, gone, recovered, recovered_changed or unchanged; stale rows that stay away are left out.
    """
    c = _scope(catalog, prefix).select(*KEY, "file_id", F.col("stale").alias("__stale"), F.col("file_size").alias("old_size"), F.col("modified_at").alias("old_modified"), F.lit(True).alias("__c"))
    n = _scope(listing, prefix).select(*KEY, F.col("file_size").alias("new_size"), F.col("modified_at").alias("new_modified"), F.lit(True).alias("__n"))
    differs = ~F.col("old_size").eqNullSafe(F.col("new_size")) | ~F.col("old_modified").eqNullSafe(F.col("new_modified"))
    there, stale = F.col("__n").isNotNull(), F.col("__stale") == 1
    change = (
        F.when(F.col("__c").isNull(), "new")
        .when(there & stale, F.when(differs, "recovered_changed").otherwise("recovered"))
        .when(there, F.when(differs, "changed").otherwise("unchanged"))
        .when(~stale, "gone")
    )
    out = c.join(n, KEY, "full_outer").withColumn("change", change).where("change is not null")
    return out.select(*KEY, "file_id", "change", "old_size", "new_size", "old_modified", "new_modified")


def apply_diff(catalog: DataFrame, hashes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, hashes) after a diff: rows added, updated, marked stale or recovered; changed files lose their hashes.

    New files get all that follows from their path (new_rows) and a hashes row without hashes; other columns are null.
    """
    ch = changes.where("change <> 'unchanged'").select(*KEY, F.col("change").alias("__ch"), "new_size", "new_modified")
    both = catalog.join(ch.where("__ch <> 'new'"), KEY, "left")
    seen = F.col("__ch").isin("changed", "recovered", "recovered_changed")
    kept = both.withColumns(
        {
            "file_size": F.when(seen, F.col("new_size")).otherwise(F.col("file_size")),
            "modified_at": F.when(seen, F.col("new_modified")).otherwise(F.col("modified_at")),
            "stale": F.when(F.col("__ch") == "gone", 1).when(seen, 0).otherwise(F.col("stale")),
        }
    ).select(*catalog.columns)
    added = new_rows(ch.where("__ch = 'new'").select(*KEY, F.col("new_size").alias("file_size"), F.col("new_modified").alias("modified_at")))
    after = kept.unionByName(added.select([c for c in added.columns if c in catalog.columns]), allowMissingColumns=True)
    state = changes.where("file_id is not null").select("file_id", F.col("change").alias("__ch"), "new_size")
    marked = hashes.join(state, "file_id", "left")
    lost = F.col("__ch").isin("changed", "recovered_changed")
    next_hashes = marked.withColumns(
        {h: F.when(~F.coalesce(lost, F.lit(False)), F.col(h)) for h in ("hash_partial", "hash_fast", "hash_strong")}
        | {"stale": F.when(F.col("__ch") == "gone", 1).when(F.col("__ch").startswith("recovered"), 0).otherwise(F.col("stale")), "file_size": F.when(lost, F.col("new_size")).otherwise(F.col("file_size"))}
    ).select(*hashes.columns)
    return after, next_hashes.unionByName(new_hash_rows(added).select([c for c in NEW_HASHES if c in hashes.columns]), allowMissingColumns=True)


def affected_ids(changes: DataFrame) -> DataFrame:
    """(file_id) of the files that a diff adds, changes, loses or finds again: those whose hashes are to be read or recounted."""
    own = F.coalesce("file_id", F.shiftrightunsigned(F.xxhash64(*KEY), 1))
    return changes.where("change <> 'unchanged'").select(own.alias("file_id"))


def stat_deltas(changes: DataFrame, types: bool = False) -> DataFrame:
    """(location_id, rel_dir, file_count, total_size) signed, of a diff; with types also by type_high, and with hidden_count and a duplicate_count of 0."""
    c = F.col("change")
    arrived, left = c.isin("new", "recovered", "recovered_changed"), c == "gone"
    n = F.when(arrived, 1).when(left, -1).otherwise(0)
    size = F.when(arrived, F.col("new_size")).when(left, -F.col("old_size")).otherwise(F.col("new_size") - F.col("old_size"))
    sums = [F.sum(n).cast("long").alias("file_count"), F.sum(size).cast("long").alias("total_size")]
    key = ["location_id", dirname(F.col("rel_path")).alias("rel_dir")]
    if types:
        hidden = F.when(hidden_inherited(F.col("rel_path")), n).otherwise(0)
        key.append(classify_high(basename(F.col("rel_path"))).alias("type_high"))
        sums += [F.sum(hidden).cast("long").alias("hidden_count"), F.lit(0).cast("long").alias("duplicate_count")]
    return changes.where("change <> 'unchanged'").groupBy(*key).agg(*sums)


def new_rows(listing: DataFrame) -> DataFrame:
    """Catalog rows of listed files (each once): ids from keys; folder, hidden and types from paths."""
    name = basename(F.col("rel_path"))
    return listing.select(
        F.shiftrightunsigned(F.xxhash64(*KEY), 1).alias("file_id"), *KEY, dirname(F.col("rel_path")).alias("rel_dir"), name.alias("filename"), "file_size", "modified_at",
        hidden_inherited(F.col("rel_path")).cast("int").alias("hidden"), classify_high(name).alias("type_high"), classify_low(name).alias("type_low"), F.lit(0).alias("stale"), F.lit(0).alias("excluded"),
    )


NEW_HASHES = ["file_id", "location_id", "file_size", "hash_partial", "hash_fast", "hash_strong", "dup_count", "excluded", "stale"]


def new_hash_rows(files: DataFrame) -> DataFrame:
    """Hashes rows of new files, without any hash yet."""
    none = {c: F.lit(None).cast("string") for c in ("hash_partial", "hash_fast", "hash_strong")}
    return files.select("file_id", "location_id", "file_size").withColumns({**none, "dup_count": F.lit(0).cast("long"), "excluded": F.lit(0), "stale": F.lit(0)}).select(*NEW_HASHES)


def first_scan(listing: DataFrame) -> DataFrame:
    """Catalog rows of a first listing, one per path."""
    return new_rows(listing.dropDuplicates(KEY))


def mark_unseen(catalog: DataFrame, scan_id: int, prefix: str | None = None, location_id: int | None = None) -> DataFrame:
    """Catalog with non-stale rows of another scan marked stale; rows without a scan id are not, as null differs from nothing."""
    unseen = (F.col("scan_id") != scan_id) & (F.col("stale") == 0)
    if prefix is not None:
        unseen &= below(F.col("rel_path"), prefix)
    if location_id is not None:
        unseen &= F.col("location_id") == location_id
    return catalog.withColumn("stale", F.when(unseen, 1).otherwise(F.col("stale")))


def stale_folders(folders: DataFrame, seen: DataFrame, prefix: str | None = None) -> DataFrame:
    """Folders with stale set where unseen and cleared where seen, and newly_stale."""
    marked = folders.join(seen.select(*KEY, F.lit(True).alias("__s")).distinct(), KEY, "left")
    inside = F.lit(True) if prefix is None else below(F.col("rel_path"), prefix, True)
    now = F.when(F.col("__s").isNotNull(), 0).when(inside, 1).otherwise(F.col("stale"))
    return marked.withColumn("newly_stale", ((now == 1) & (F.col("stale") == 0)).cast("int")).withColumn("stale", now).drop("__s")


def quick_diff(catalog: DataFrame, listing: DataFrame, location_id: int, folder: str) -> DataFrame:
    """(filename, change) of one folder's own files, by name alone: new, missing or recovered."""
    c = catalog.where((F.col("location_id") == location_id) & (F.col("rel_dir") == folder)).select("filename", F.col("stale").alias("__stale"))
    n = listing.where((F.col("location_id") == location_id) & (F.col("rel_dir") == folder)).select("filename", F.lit(1).alias("__n")).distinct()
    change = F.when(F.col("__stale").isNull(), "new").when(F.col("__n").isNull() & (F.col("__stale") == 0), "missing").when(F.col("__n").isNotNull() & (F.col("__stale") == 1), "recovered")
    return c.join(n, "filename", "full_outer").select("filename", change.alias("change")).where("change is not null")


def quick_diff_folders(folders: DataFrame, listed: DataFrame, location_id: int, folder: str) -> DataFrame:
    """(rel_path, name, change) of the folders right below one folder ('' for the root), by name: new, missing or recovered. listed: location_id, rel_path."""
    own = lambda df: df.where((F.col("location_id") == location_id) & (F.col("rel_path") != "") & (dirname(F.col("rel_path")) == folder))
    c = own(folders).select("rel_path", F.col("stale").alias("__stale"))
    n = own(listed).select("rel_path", F.lit(1).alias("__n")).distinct()
    change = F.when(F.col("__stale").isNull(), "new").when(F.col("__n").isNull() & (F.col("__stale") == 0), "missing").when(F.col("__n").isNotNull() & (F.col("__stale") == 1), "recovered")
    return c.join(n, "rel_path", "full_outer").select("rel_path", basename(F.col("rel_path")).alias("name"), change.alias("change")).where("change is not null")


def stale_subtrees(files: DataFrame, folders: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, folders) with all that lies in missing folders (location_id, rel_path) stale, the folders themselves too."""
    mark = lambda df, inside: df.withColumn("stale", F.when(inside, 1).otherwise(F.col("stale")))
    f, o = covered(files, missing), covered(folders, missing, itself=True)
    return tuple(mark(df, F.col("covered")).drop("covered") for df in (f, o))


def apply_quick_diff(files: DataFrame, folders: DataFrame, changes: DataFrame, location_id: int) -> tuple[DataFrame, DataFrame]:
    """(files, folders) after a quick diff of folders: missing ones are stale with all below them, recovered ones by themselves
    alone, as what lies below was not looked at; new ones are added."""
    at = changes.withColumn("location_id", F.lit(location_id).cast(folders.schema["location_id"].dataType))
    files, folders = stale_subtrees(files, folders, at.where("change = 'missing'").select(*KEY))
    back = at.where("change = 'recovered'").select(*KEY, F.lit(True).alias("__back"))
    folders = folders.join(back, KEY, "left").withColumn("stale", F.when(F.col("__back"), 0).otherwise(F.col("stale"))).drop("__back")
    new = at.where("change = 'new'").select(*KEY, F.lit(0).alias("stale"))
    return files, folders.unionByName(new, allowMissingColumns=True)


def stale_subtree(files: DataFrame, location_id: int, folder: str | None = None) -> DataFrame:
    """Files with all of a location, or all below a folder, stale."""
    inside = F.col("location_id") == location_id
    if folder is not None:
        inside &= below(F.col("rel_path"), folder)
    return files.withColumn("stale", F.when(inside, 1).otherwise(F.col("stale")))


def purge_stale(files: DataFrame, folders: DataFrame, location_id: int, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, folders) that remain: stale files in scope go, then stale folders with no file or live folder left below.

    The scope folder itself stays.
    """
    inside = F.col("location_id") == location_id
    if scope is not None:
        inside &= below(F.col("rel_path"), scope)
    left = files.where(~(inside & (F.col("stale") == 1)))
    alive = left.select("location_id", F.col("rel_dir").alias("rel_path")).union(folders.where("stale = 0").select("location_id", "rel_path")).distinct()
    held = alive.select("location_id", F.explode(ancestors(F.col("rel_path"))).alias("rel_path")).distinct()  # folders go up, not files
    empty = folders.where(inside & (F.col("stale") == 1)).join(held, KEY, "left_anti").select(*KEY)
    return left, folders.join(empty, KEY, "left_anti")


def touch_seen(catalog: DataFrame, scan_id: int, now: str, location_id: int) -> DataFrame:
    own = (F.col("location_id") == location_id) & (F.col("stale") == 0)
    return catalog.withColumns({"scan_id": F.when(own, scan_id).otherwise(F.col("scan_id")), "last_seen": F.when(own, F.lit(now).cast("timestamp"))})


def reclassify(catalog: DataFrame, only_other: bool = False) -> DataFrame:
    """(file_id, old_type, new_type) of files whose type by name differs; offline, of those typed other only."""
    new = classify_high(F.col("filename"))
    rows = catalog.where("type_high = 'other'") if only_other else catalog
    return rows.select("file_id", F.col("type_high").alias("old_type"), new.alias("new_type")).where("old_type <> new_type")


def freshness(catalog: DataFrame, stat: DataFrame) -> DataFrame:
    """(file_id, action) for looked-up files: stale if gone, clear if back, update if the size differs. stat: file_id, found, size."""
    both = catalog.select("file_id", "stale", "file_size").join(stat, "file_id")
    action = F.when(~F.col("found") & (F.col("stale") == 0), "stale").when(F.col("found") & (F.col("stale") == 1), "clear").when(F.col("found") & (F.col("size") != F.col("file_size")), "update")
    return both.select("file_id", action.alias("action")).where("action is not null")


def invalid_names(paths: DataFrame, column: str = "path_bytes") -> DataFrame:
    return paths.where(~F.is_valid_utf8(F.col(column).cast("string")))


def purge_location(files: DataFrame, hashes: DataFrame, location_id: int) -> tuple[DataFrame, DataFrame]:
    """(files, hashes) without a location; the duplicate counts of hashes that it shared are made anew."""
    left = hashes.where(F.col("location_id") != location_id)
    return files.where(F.col("location_id") != location_id), dup_recount(left)


def purge_everywhere(tables: dict[str, DataFrame], location_id: int) -> dict[str, DataFrame]:
    """All catalog tables, by name, without a location.

    Tables with a location_id lose its rows (a rule or a table row without location stays); those with a file_id alone,
    such as tags and pending operations, lose the rows of its files. files and hashes must be among them.
    """
    gone = tables["files"].where(F.col("location_id") == location_id).select("file_id")
    out = {}
    for name, df in tables.items():
        if "location_id" in df.columns:
            out[name] = df.where(F.col("location_id").isNull() | (F.col("location_id") != location_id))
        else:
            out[name] = df.join(gone, "file_id", "left_anti")
    return out | {"hashes": dup_recount(out["hashes"])}
