"""Folder trees. A folder is its (location_id, rel_path); ancestors come from the path, without recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.functions.fn import ancestors, basename, depth, dirname, hidden_inherited
from lantern.tables import written

KEY = ["location_id", "rel_path"]


def below(path: Column, folder: str, include_self: bool = False) -> Column:
    own = path.startswith(folder + "/")
    return own | (path == folder) if include_self else own


def covered(paths: DataFrame, roots: DataFrame, itself: bool = False) -> DataFrame:
    """paths (location_id, rel_path, ...) with `covered`: whether they lie below one of the roots (location_id, rel_path), or with itself are one.

    What lies below a folder is an interval of sorted paths, and two such intervals lie apart or one in the other. So all
    are sorted together, and a path is covered when the largest end of the intervals begun before lies behind it. The
    rows are dealt by ranges and the ends of earlier ranges carried over, a row per range: no path meets all roots, no
    ancestor is listed, and no location need fit a task. Paths or roots of null are covered by nothing and cover nothing.
    """
    starts = roots.where("location_id is not null and rel_path is not null").select("location_id", F.concat("rel_path", F.lit("/")).alias("__at"), F.concat("rel_path", F.lit("0")).alias("__end")).distinct()  # '0' follows '/'
    place = F.concat("rel_path", F.lit("/")) if itself else F.col("rel_path")
    own = paths.withColumns({"__at": place, "__end": F.lit(None).cast("string"), "__path": F.lit(True)})
    both = own.unionByName(starts.withColumn("__path", F.lit(False)), allowMissingColumns=True)
    order = ["location_id", "__at", "__path"]  # a root comes before the same path
    dealt = written(both.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    end = F.when(~F.col("__path"), F.struct("location_id", "__end"))
    ends = dealt.groupBy("__part").agg(F.max(end).alias("__last"))
    carried = ends.select("__part", F.max("__last").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))  # a row per range
    before = F.max(end).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    top = F.greatest(F.col("__before"), F.col("__carried"))
    inside = (top["location_id"] == F.col("location_id")) & (top["__end"] > F.col("__at"))
    out = dealt.withColumn("__before", before).join(F.broadcast(carried), "__part").where("__path")
    return out.withColumn("covered", F.coalesce(inside, F.lit(False))).select(*paths.columns, "covered")


def build_folders(rel_dirs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """All folders of (location_id, rel_dir) and the missing ones above them; existing ones keep dup_exclude, hidden is set anew."""
    paths = rel_dirs.select("location_id", "rel_dir").distinct().select("location_id", F.explode(ancestors(F.col("rel_dir"))).alias("rel_path")).distinct()
    p = F.col("rel_path")
    out = paths.select("location_id", "rel_path", basename(p).alias("name"), dirname(p).alias("parent_path"), depth(p).alias("depth"), hidden_inherited(p).cast("int").alias("hidden"))
    if existing is None:
        return out.withColumn("dup_exclude", F.lit(0))
    return out.join(existing.select(*KEY, "dup_exclude"), KEY, "left").withColumn("dup_exclude", F.coalesce("dup_exclude", F.lit(0)))


def descendants(folders: DataFrame, location_id: int, folder: str, include_self: bool = True) -> DataFrame:
    return folders.where((F.col("location_id") == location_id) & below(F.col("rel_path"), folder, include_self))


def breadcrumb(folders: DataFrame, locations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(location_id, rel_path, level, name, path): for each wanted folder, its location (level 0) and the chain down to it."""
    up = wanted.select(*KEY, F.posexplode(ancestors(F.col("rel_path"))).alias("level", "path")).withColumn("level", F.col("level") + 1)
    known = up.join(folders.select("location_id", F.col("rel_path").alias("path")), ["location_id", "path"]).select(*KEY, "level", basename(F.col("path")).alias("name"), "path")
    top = wanted.join(locations.select("location_id", "name"), "location_id").select(*KEY, F.lit(0).alias("level"), "name", F.lit("").alias("path"))
    return top.unionByName(known)


def children(folders: DataFrame, parents: DataFrame, stats: DataFrame) -> DataFrame:
    """(location_id, parent_path, rel_path, name, has_children, total_size): folders right below each parent; '' is a location's root."""
    own = folders.withColumn("parent_path", dirname(F.col("rel_path")))
    with_children = own.select("location_id", F.col("parent_path").alias("rel_path")).distinct().withColumn("__c", F.lit(True))
    found = own.join(parents.select("location_id", F.col("rel_path").alias("parent_path")), ["location_id", "parent_path"], "left_semi")
    found = found.join(with_children, KEY, "left").join(stats.select(*KEY, "total_size"), KEY, "left")
    return found.select(
        "location_id", "parent_path", "rel_path", basename(F.col("rel_path")).alias("name"), F.coalesce("__c", F.lit(False)).alias("has_children"), F.coalesce("total_size", F.lit(0)).alias("total_size")
    )


def shallow_tree(locations: DataFrame, folders: DataFrame) -> DataFrame:
    """(location_id, name, roots): locations with the sorted names of their root folders."""
    roots = folders.where(~F.contains(F.col("rel_path"), F.lit("/"))).groupBy("location_id").agg(F.array_sort(F.collect_list("rel_path")).alias("roots"))
    return locations.select("location_id", "name").join(roots, "location_id", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))


def expand_path(folders: DataFrame, location_id: int, folder: str, stats: DataFrame) -> DataFrame:
    """The folders on every level from the location's root down to below the folder."""
    here = folders.where(F.col("location_id") == location_id)
    parents = here.where(F.col("rel_path") == folder).select("location_id", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("rel_path")))).alias("rel_path"))
    return children(here, parents, stats)


def treemap(files: DataFrame, folders: DataFrame, stats: DataFrame, location_id: int, folder: str, k: int = 50) -> DataFrame:
    """(kind, name, size, files): child folders with cumulative sizes and direct file counts, and the k largest direct files."""
    here = files.where((F.col("location_id") == location_id) & (F.col("stale") == 0))
    parents = folders.where((F.col("location_id") == location_id) & (F.col("rel_path") == folder)).select(*KEY)
    direct = here.groupBy("location_id", F.col("rel_dir").alias("rel_path")).agg(F.count("*").alias("n"))
    sub = children(folders.where(F.col("location_id") == location_id), parents, stats).join(direct, KEY, "left")
    sub = sub.select(F.lit("folder").alias("kind"), "name", F.col("total_size").alias("size"), F.coalesce("n", F.lit(0)).alias("files"))
    top = here.where(F.col("rel_dir") == folder).orderBy(F.desc("file_size"), "file_id").limit(k)
    return sub.unionByName(top.select(F.lit("file").alias("kind"), F.col("filename").alias("name"), F.col("file_size").alias("size"), F.lit(1).cast("long").alias("files")))


def treemap_totals(files: DataFrame, folders: DataFrame, stats: DataFrame, location_id: int, folder: str) -> DataFrame:
    """One row: folders, folder_size, direct_files, direct_size and total_size of a folder's treemap, over all direct files, not only those shown."""
    here = files.where((F.col("location_id") == location_id) & (F.col("stale") == 0) & (F.col("rel_dir") == folder))
    own = here.agg(F.count("*").alias("direct_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("direct_size"))
    right_below = (F.col("location_id") == location_id) & (F.col("rel_path") != "") & (dirname(F.col("rel_path")) == folder)
    sub = folders.where(right_below).join(stats.select(*KEY, "total_size"), KEY, "left").agg(F.count("*").alias("folders"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("folder_size"))
    return sub.crossJoin(own).withColumn("total_size", F.col("folder_size") + F.col("direct_size"))  # one row each


def treemap_items(treemap_rows: DataFrame) -> DataFrame:
    """(kind, name, size): folders above 0 bytes, files of a hundredth of the total or more, and the rest as one item."""
    total = treemap_rows.agg(F.sum("size").alias("total"))
    rows = treemap_rows.where("size > 0").crossJoin(total)  # one row
    small = (F.col("kind") == "file") & (F.col("size") < F.col("total") * 0.01)
    big = rows.where(~small).select("kind", "name", "size")
    rest = rows.where(small).groupBy().agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 0")
    return big.unionByName(rest.select(F.lit("other").alias("kind"), F.format_string("[%d other files]", "n").alias("name"), "size"))


def materialise_paths(folders: DataFrame) -> DataFrame:
    """(id, rel_path, depth) from (id, parent_id, name), for the folders that a root can be reached from.

    Each round joins a path with that of the folder it ends below, so paths double and a tree of depth d takes some
    log2(d) rounds, each a written table, whatever its depth and its number of folders. A round that brings no path to
    a root leaves cycles only.
    """
    now = written(folders.select("id", F.col("parent_id").alias("up"), F.col("name").alias("rel_path"), F.lit(1).alias("depth")))
    left = now.where("up is not null").count()
    while left:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("rel_path").alias("__path"), F.col("depth").alias("__depth"))
        longer = now.join(above, "up").select("id", F.col("__up").alias("up"), F.concat("__path", F.lit("/"), "rel_path").alias("rel_path"), (F.col("depth") + F.col("__depth")).alias("depth"))
        rooted = now.where("up is null").count()
        now = written(now.where("up is null").unionByName(longer))
        left = now.where("up is not null").count()
        if now.where("up is null").count() == rooted:
            break
    return now.where("up is null").select("id", "rel_path", "depth")


def list_folder(files: DataFrame, folders: DataFrame, location_id: int, folder: str, name: str | None = None, page: int = 0, size: int = 120, by: str = "name", descending: bool = False, hashes: DataFrame | None = None) -> DataFrame:
    """(kind, name, size): sub-folders by name, then one page of the folder's files, sorted like search results.

    With hashes also file_id and dup_count, the live count of copies of the files shown; a sort by "dups" uses the stored counts.
    """
    from lantern.functions.fn import name_matches
    from lantern.operators.search import live_counts, paged

    sub = folders.where((F.col("location_id") == location_id) & (dirname(F.col("rel_path")) == folder)).select(basename(F.col("rel_path")).alias("name"))
    own = files.where((F.col("location_id") == location_id) & (F.col("rel_dir") == folder))
    if name:
        own = own.where(name_matches(F.col("filename"), name))
    if by == "dups" and hashes is not None:
        own = own.drop("dup_count").join(hashes.select("file_id", "dup_count"), "file_id", "left")
    shown = paged(own, by, descending, page=page, size=size)
    extra = []
    if hashes is not None:
        shown = live_counts(shown, hashes)
        extra = ["file_id", "dup_count"]
    top = sub.select(F.lit("folder").alias("kind"), "name", F.lit(None).cast("long").alias("size"), *(F.lit(None).cast("long").alias(c) for c in extra))
    return top.unionByName(shown.select(F.lit("file").alias("kind"), F.col("filename").alias("name"), F.col("file_size").alias("size"), *extra))


def favourites(locations: DataFrame, folders: DataFrame) -> DataFrame:
    """(kind, location_id, label): flagged locations and folders, a folder's label being its path from the location."""
    own = locations.where("is_favourite = 1").select(F.lit("location").alias("kind"), "location_id", F.col("name").alias("label"))
    sub = folders.where("is_favourite = 1").join(locations.select("location_id", "name"), "location_id")
    return own.unionByName(sub.select(F.lit("folder").alias("kind"), "location_id", F.concat_ws(" / ", "name", F.replace("rel_path", F.lit("/"), F.lit(" / "))).alias("label")))


def nested_tree(locations: DataFrame, folders: DataFrame) -> DataFrame:
    """(location_id, sort_key, name, depth): the whole tree as rows in the order to draw them."""
    top = locations.select("location_id", F.lit("").alias("sort_key"), "name", F.lit(0).alias("depth"))
    p = F.col("rel_path")
    return top.unionByName(folders.select("location_id", F.lower(p).alias("sort_key"), basename(p).alias("name"), depth(p).alias("depth")))


def download_manifest(files: DataFrame, selected: DataFrame, locations: DataFrame) -> DataFrame:
    """(full_path, archive_name, location_id): files below selected folders, named by folder and the path below it.

    What is exploded is folders that hold files, not files.
    """
    wanted = selected.select("location_id", F.col("rel_path").alias("folder"))
    dirs = files.where("stale = 0").select("location_id", "rel_dir").distinct()
    held = dirs.select("location_id", "rel_dir", F.explode(ancestors(F.col("rel_dir"))).alias("folder")).join(wanted, ["location_id", "folder"])
    found = files.where("stale = 0").select("location_id", "rel_dir", "rel_path").join(held, ["location_id", "rel_dir"]).join(locations.select("location_id", "root_path"), "location_id")
    name = F.concat(basename(F.col("folder")), F.substring(F.col("rel_path"), F.length("folder") + 1, F.length("rel_path")))
    return found.select(F.concat_ws("/", "root_path", "rel_path").alias("full_path"), name.alias("archive_name"), "location_id")
