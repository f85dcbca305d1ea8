"""Search: predicates as Columns or semi joins, composed; sorting, paging and top lists."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.functions.fn import KNOWN_TYPES, effective_hash, escape_like, name_matches, size_of, spread_key
from lantern.operators.dups import live_dup_counts
from lantern.operators.tree import KEY, below
from lantern.tables import written

PAGE = 120
RESULT = ["file_id", "filename", "type_high", "file_size", "modified_at", "stale", "hidden", "location_id", "location_name", "hash_strong", "hash_fast", "dup_count", "file_count"]


def _count_bound(value) -> int | None:
    try:
        return n if (n := int(value)) >= 0 else None
    except (TypeError, ValueError):
        return None


def of_type(kind: str) -> Column:
    """Of a type; "other" is none of the known ones, and a null type never matches."""
    return ~F.col("type_high").isin(*KNOWN_TYPES) if kind == "other" else F.col("type_high") == kind


def described(value: str) -> Column:
    return F.col("description").ilike(f"%{escape_like(value)}%")


def between(column: str, low=None, high=None) -> Column | None:
    parts = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
    return reduce(Column.__and__, parts) if parts else None


def dated(low: str | None = None, high: str | None = None) -> Column | None:
    """From a day to the end of another."""
    at = F.col("modified_at")
    parts = [at >= F.lit(low).cast("timestamp")] * bool(low) + [at < F.lit(high).cast("timestamp") + F.expr("interval 1 day")] * bool(high)
    return reduce(Column.__and__, parts) if parts else None


def tagged(files: DataFrame, tags: DataFrame, wanted: list[str], exclude: bool = False) -> DataFrame:
    """Files with any of the tags, or with none of them."""
    ids = tags.where(F.col("tag").isin(*wanted)).select("file_id").distinct()
    return files.join(ids, "file_id", "left_anti" if exclude else "left_semi")


def with_hash(files: DataFrame, hashes: DataFrame, value: str) -> DataFrame:
    ids = hashes.where("excluded = 0 and stale = 0").where((F.col("hash_strong") == value) | (F.col("hash_fast") == value)).select("file_id")
    return files.join(ids, "file_id", "left_semi")


def folder_name_is(value: str, mode: str = "anywhere") -> Column:
    """By the name of the folder that the file lies in; files at a location's root have none."""
    name = F.when(F.col("rel_dir") != "", F.substring_index("rel_dir", "/", -1))
    return name_matches(name, value, mode)


def online_only(files: DataFrame, online: DataFrame) -> DataFrame:
    return files.join(online.select("location_id").distinct(), "location_id", "left_semi")


def ignored(files: DataFrame, rules: DataFrame, drop: bool = False) -> DataFrame:
    """Files that a rule of the same name and size ignores, everywhere or at its location; with drop, the others.

    Global rules and rules of a location are two equi-joins, so neither becomes a nested loop.
    """
    every = rules.where("location_id is null").select("filename", "file_size").distinct()
    local = rules.where("location_id is not null").select("filename", "file_size", "location_id").distinct()
    if drop:
        return files.join(every, ["filename", "file_size"], "left_anti").join(local, ["filename", "file_size", "location_id"], "left_anti")
    hit = files.join(every, ["filename", "file_size"], "left_semi").select("file_id").union(files.join(local, ["filename", "file_size", "location_id"], "left_semi").select("file_id"))
    return files.join(hit.distinct(), "file_id", "left_semi")


def not_deleting(locations: DataFrame) -> DataFrame:
    return locations.where(~F.col("name").startswith("__deleting_"))


def condition(c: dict) -> Column | None:
    """The predicate of one condition on a file's own columns; None if it asks for nothing."""
    field, value, mode = c["field"], c.get("value", ""), c.get("match", "wildcard")
    if field == "size":
        return between("file_size", size_of(c.get("min")), size_of(c.get("max")))
    if field == "date":
        return dated(c.get("from"), c.get("to"))
    if field == "duplicates":
        return between("dup_count", _count_bound(c.get("from")), _count_bound(c.get("to")))
    if not value:
        return None
    if field == "folder":
        return folder_name_is(value, mode)
    return {"name": lambda: name_matches(F.col("filename"), value, mode), "type": lambda: of_type(value), "description": lambda: described(value)}.get(field, lambda: None)()


def where_all(files: DataFrame, conditions: list[dict], tags: DataFrame | None = None) -> DataFrame:
    """All conditions together; an excluded one is negated with SQL's three values, so a null drops the row."""
    for c in conditions:
        exclude = c.get("op") == "exclude"
        if c["field"] == "tags":
            wanted = [t.strip().lower() for t in c.get("value", "").split(",") if t.strip()]
            files = tagged(files, tags, wanted, exclude) if wanted else files
        elif (p := condition(c)) is not None:
            files = files.where(~p if exclude else p)
    return files


def folder_condition(c: dict) -> Column | None:
    """A condition's predicate on folders with their stats; other fields than these four say nothing."""
    field, value = c["field"], c.get("value", "")
    if field == "name":
        return name_matches(F.substring_index("rel_path", "/", -1), value, c.get("match", "wildcard")) if value else None
    if field == "size":
        return between("total_size", size_of(c.get("min")), size_of(c.get("max")))
    column = {"duplicates": "duplicate_count", "files": "file_count"}.get(field)
    return between(column, _count_bound(c.get("from")), _count_bound(c.get("to"))) if column else None


def live_counts(rows: DataFrame, hashes: DataFrame, few: bool = False) -> DataFrame:
    """rows with their hashes and live duplicate counts (of the strong hash, or else the fast one). few: rows are a page's, so hashes need not be dealt anew to meet them."""
    own = hashes.select("file_id", "hash_strong", "hash_fast")
    if few:
        own = own.join(F.broadcast(rows.select("file_id")), "file_id", "left_semi")
    rows = rows.drop("dup_count", "hash_strong", "hash_fast").join(own, "file_id", "left")
    rows = rows.withColumn("hash", effective_hash(F.col("hash_strong"), F.col("hash_fast")))
    strong = rows.where("hash_strong <> ''").select(F.col("hash_strong").alias("hash")).distinct()
    fast = rows.where("coalesce(hash_strong, '') = '' and hash_fast <> ''").select(F.col("hash_fast").alias("hash")).distinct()
    counts = live_dup_counts(hashes, strong=strong, fast=fast)
    keyed = rows.withColumn("hash", spread_key(F.col("hash"), F.col("file_id")))
    return keyed.join(counts, "hash", "left").withColumn("dup_count", F.coalesce("dup_count", F.lit(0)))


def _shown(files: DataFrame, hashes: DataFrame, locations: DataFrame, few: bool = False) -> DataFrame:
    """Search results: names of locations, hashes, and live duplicate counts of the hashes found."""
    rows = files.join(locations.select("location_id", F.col("name").alias("location_name")), "location_id")
    return live_counts(rows, hashes, few).withColumn("file_count", F.lit(None).cast("long")).select(*RESULT)


def matching(
    files: DataFrame, hashes: DataFrame, *, name: str = "", name_match: str = "anywhere", file_type: str = "", description: str = "", tags: list[str] | None = None,
    tag_rows: DataFrame | None = None, size_min=None, size_max=None, date_from: str = "", date_to: str = "", dupes_only: bool = False, min_dups=None, max_dups=None, hash_value: str = "",
    location_id: int | None = None, folder: str | None = None, show_hidden: bool = True,
) -> DataFrame:
    """The files that pass all given filters. files needs the stored dup_count where a filter asks for it; stale files are included."""
    if location_id is not None:
        files = files.where(F.col("location_id") == location_id)
    if folder is not None:
        files = files.where(below(F.col("rel_path"), folder))
    if not show_hidden:
        files = files.where("hidden = 0")
    if dupes_only:
        files = files.where("dup_count > 0")
    files = where_all(
        files,
        [
            {"field": "name", "value": name, "match": name_match}, {"field": "type", "value": file_type}, {"field": "description", "value": description},
            {"field": "size", "min": size_min, "max": size_max}, {"field": "date", "from": date_from, "to": date_to}, {"field": "duplicates", "from": min_dups, "to": max_dups},
        ],
    )
    if tags:
        files = tagged(files, tag_rows, tags)
    if hash_value:
        files = with_hash(files, hashes, hash_value)
    return files


def search(files: DataFrame, hashes: DataFrame, locations: DataFrame, **filters) -> DataFrame:
    """All results of matching()'s filters, as they are shown."""
    return _shown(matching(files, hashes, **filters), hashes, locations)


def search_page(
    files: DataFrame, hashes: DataFrame, locations: DataFrame, folders_found: DataFrame | None = None, by: str = "name", descending: bool = False, page: int = 0, size: int = PAGE, after: tuple | None = None, **filters
) -> DataFrame:
    """One page of search() and the folders found, sorted. The page is cut first and only its rows are joined with hashes,
    counts and locations, unless duplicates, which must be counted for that, are sorted by."""
    found = matching(files, hashes, **filters)
    none = found.sparkSession.createDataFrame([], _shown(files.limit(0), hashes, locations).schema) if folders_found is None else folders_found
    if by == "dups":
        return paged(search_all(_shown(found, hashes, locations), none), by, descending, page, size, after)
    known = locations.select("location_id").distinct()
    narrow = found.join(known, "location_id", "left_semi").select("file_id", "filename", "type_high", "file_size", "modified_at", F.lit(True).alias("__file"))
    cut = written(paged(narrow.unionByName(none.withColumn("__file", F.lit(False)), allowMissingColumns=True), by, descending, page, size, after))
    ids = F.broadcast(cut.where("__file").select("file_id"))  # at most a page
    rows = written(files.join(ids, "file_id", "left_semi"))
    return search_all(_shown(rows, hashes, locations, few=True), cut.where("not __file").select(*RESULT)).orderBy(*_sort(by, descending))


def search_advanced(files: DataFrame, hashes: DataFrame, locations: DataFrame, conditions: list[dict], tags: DataFrame | None = None) -> DataFrame:
    return _shown(where_all(files, conditions, tags), hashes, locations)


def search_folders(folders: DataFrame, stats: DataFrame, locations: DataFrame, conditions: list[dict]) -> DataFrame:
    """Folders in the shape of results, by the conditions that apply to folders; none if none does. file_id is a negative key."""
    own = [(c.get("op") == "exclude", p) for c in conditions if (p := folder_condition(c)) is not None]
    counted = folders.join(stats, KEY, "left").na.fill(0, ["total_size", "duplicate_count", "file_count"])
    rows = reduce(lambda df, x: df.where(~x[1] if x[0] else x[1]), own, counted) if own else counted.where(F.lit(False))
    rows = rows.join(locations.select("location_id", F.col("name").alias("location_name")), "location_id")
    blank = {"modified_at": "timestamp", "hash_strong": "string", "hash_fast": "string"}
    rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in blank.items()} | {
        "file_id": -F.shiftrightunsigned(F.xxhash64("location_id", "rel_path"), 1), "filename": F.substring_index("rel_path", "/", -1), "type_high": F.lit("folder"), "file_size": F.col("total_size"),
        "stale": F.lit(0), "hidden": F.col("rel_path").rlike(r"(^|/)\.").cast("int"), "dup_count": F.col("duplicate_count"),
    })
    return rows.select(*RESULT)


def search_all(files_found: DataFrame, folders_found: DataFrame) -> DataFrame:
    return files_found.unionByName(folders_found)


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("type_high") == "folder").alias("folders"))


def search_by_hash(files: DataFrame, hashes: DataFrame, locations: DataFrame, value: str) -> DataFrame:
    ids = hashes.where(F.col("hash_strong") == value).select("file_id").union(hashes.where(F.col("hash_fast") == value).select("file_id")).distinct()
    return _shown(files.join(ids, "file_id", "left_semi"), hashes, locations)


def run_saved_search(saved_params: str, files: DataFrame, hashes: DataFrame, locations: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """A saved search's JSON: {"conditions": [...]} or the keyword arguments of search()."""
    params = json.loads(saved_params)
    if "conditions" in params:
        return search_advanced(files, hashes, locations, params["conditions"], tags)
    return search(files, hashes, locations, tag_rows=tags, **params)


def media_ids(files: DataFrame, media_type: str, online: DataFrame | None = None, location_id: int | None = None, folder: str | None = None, found: DataFrame | None = None, by: str = "name", descending: bool = False) -> DataFrame:
    """(file_id, filename) of image or video files, sorted: of a search result (found, with file_id), or of a folder's own
    files, or of all. Stale files and those at locations offline are left out."""
    own = files.where((F.col("type_high") == media_type) & (F.col("stale") == 0))
    if found is not None:
        own = own.join(found.select("file_id").distinct(), "file_id", "left_semi")
    elif folder is not None:
        own = own.where((F.col("location_id") == location_id) & (F.col("rel_dir") == folder))
    if online is not None:
        own = online_only(own, online)
    return own.orderBy(*_sort(by, descending)).select("file_id", "filename")


SORTS = {"name": F.lower, "type": lambda _: F.col("type_high"), "size": lambda _: F.col("file_size"), "date": lambda _: F.col("modified_at"), "dups": lambda _: F.col("dup_count")}


def _key(by: str) -> Column:
    return F.lower("filename") if by == "name" else SORTS[by](None)


def _sort(by: str, descending: bool) -> list[Column]:
    key = _key(by)
    return [key.desc() if descending else key.asc(), F.col("file_id").asc()]


def paged(df: DataFrame, by: str = "name", descending: bool = False, page: int = 0, size: int = PAGE, after: tuple | None = None) -> DataFrame:
    """One page of the sorted rows; file_id settles ties.

    after, the sort key and file_id of the last row seen (a name in lower case), starts right behind it, so a deep page costs
    no more than the first; `page` counts from there.
    """
    if after is not None:
        key, file_id = _key(by), F.col("file_id")
        value, last = (F.lit(x) for x in after)
        beyond = (key < value) | key.isNull() if descending else key > value
        if after[0] is None:
            beyond = F.lit(False) if descending else key.isNotNull()
        df = df.where(beyond | (key.eqNullSafe(value) & (file_id > last)))
    return df.orderBy(*_sort(by, descending)).offset(page * size).limit(size)


def page_of(df: DataFrame, file_id: int, by: str = "name", descending: bool = False, size: int = PAGE) -> DataFrame:
    """(page): the page that shows a file, by counting the rows that sort before it; no shuffle of the rows."""
    rows = df.select("file_id", _key(by).alias("k"))
    own = rows.where(F.col("file_id") == file_id).limit(1).select(F.col("k").alias("k0"))
    before = (F.col("k") > F.col("k0")) if descending else (F.col("k") < F.col("k0"))
    counted = rows.crossJoin(own).where(before | ((F.col("k") == F.col("k0")) & (F.col("file_id") < file_id)))  # one row broadcast
    return counted.agg(F.floor(F.count("*") / size).cast("long").alias("page"))


def top_files(files: DataFrame, k: int = 50) -> DataFrame:
    """The k largest files right in each folder. Partial ranks cut each partition before the shuffle."""
    order = Window.partitionBy("location_id", "rel_dir").orderBy(F.desc("file_size"), "file_id")
    return files.where("stale = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recent_scans(scans: DataFrame, locations: DataFrame, k: int = 5) -> DataFrame:
    return scans.join(locations.select("location_id", F.col("name").alias("location_name")), "location_id").orderBy(F.desc("started_at"), F.desc("scan_id")).limit(k)


def last_scan_attempt(scans: DataFrame) -> DataFrame:
    """(location_id, scan_id, status, attempted_at): the latest attempt per location; its date is its end, or else its start."""
    last = scans.groupBy("location_id").agg(F.max_by(F.struct("scan_id", "status", F.coalesce("completed_at", "started_at").alias("attempted_at")), F.struct("started_at", "scan_id")).alias("s"))
    return last.select("location_id", "s.*")


def inode_order(worklist: DataFrame) -> DataFrame:
    return worklist.sortWithinPartitions("location_id", "inode")
