"""Duplicate detection: the three-gate funnel, stored and live duplicate counts, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.functions.fn import SMALL, effective_hash, spread_key
from lantern.tables import written

ACTIVE = "excluded = 0 and stale = 0"
GATE = ["hash_partial", "file_size"]


def active(hashes: DataFrame) -> DataFrame:
    return hashes.where(ACTIVE)


def _gated(hashes: DataFrame) -> DataFrame:
    return active(hashes).where("hash_partial is not null and hash_partial <> '' and file_size > 0")


def candidate_groups(hashes: DataFrame, location_id: int | None = None, file_ids: DataFrame | None = None) -> DataFrame:
    """(hash_partial, file_size, n): groups of two or more active files.

    With location_id, or file_ids, only groups with a member there, or among them; members count everywhere.
    """
    rows = _gated(hashes)
    if location_id is not None:
        rows = rows.join(_gated(hashes).where(F.col("location_id") == location_id).select(*GATE).distinct(), GATE, "left_semi")
    if file_ids is not None:
        rows = rows.join(_gated(hashes).join(file_ids.select("file_id"), "file_id", "left_semi").select(*GATE).distinct(), GATE, "left_semi")
    return rows.groupBy(*GATE).agg(F.count("*").alias("n")).where("n > 1")


def dup_candidates(hashes: DataFrame, files: DataFrame, location_id: int | None = None, file_ids: DataFrame | None = None) -> DataFrame:
    """Members of candidate groups that lack a fast hash, with the paths of their non-stale files."""
    own = _gated(hashes).where("hash_fast is null").join(candidate_groups(hashes, location_id, file_ids).select(*GATE), GATE, "left_semi")
    return own.select("file_id", "hash_partial", "file_size").join(files.where("stale = 0").select("file_id", "location_id", "rel_path", "inode"), "file_id")


def _verified() -> Column:
    return F.coalesce(F.col("hash_strong"), F.lit("")) != ""


def kind_and_hash() -> list[Column]:
    """A verified file groups by its strong hash only, any other by its fast hash with other unverified files."""
    return [_verified().alias("__verified"), effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("__hash")]


def dup_recount(hashes: DataFrame, location_id: int | None = None) -> DataFrame:
    """Hashes with dup_count anew: members of the file's group less one, 0 on inactive and unhashed rows.

    Groups are counted by aggregation and joined back, so a hash that very many files share makes no large window.
    Unhashed rows join nothing and are spread over all tasks.
    With location_id, only hashes present there are recounted, over all locations; other rows keep their counts.
    """
    rows = hashes.withColumns(dict(zip(("__verified", "__hash"), kind_and_hash(), strict=True)))
    live = rows.where(ACTIVE).where("__hash is not null")
    touched = None
    if location_id is not None:
        touched = live.where(F.col("location_id") == location_id).select("__verified", "__hash").distinct()
        live = live.join(touched, ["__verified", "__hash"], "left_semi")
    groups = live.groupBy("__verified", "__hash").agg((F.count("*") - 1).alias("__n"))
    counted = rows.withColumn("__hash", spread_key(F.col("__hash"), F.col("file_id"))).join(groups, ["__verified", "__hash"], "left")
    n = F.when(F.expr(ACTIVE), F.coalesce("__n", F.lit(0))).otherwise(0).cast("long")
    if touched is not None:
        n = F.when(F.col("__n").isNotNull(), n).otherwise(F.col("dup_count"))
    return counted.withColumn("dup_count", n).select(*hashes.columns)


def recount_hashes(hashes: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_id, location_id, old_count, new_count, delta): rows of the changed hashes (column hash) whose count differs; delta is ±1 where being a duplicate flipped."""
    key = ["__verified", "__hash"]
    rows = hashes.select("file_id", "location_id", *(c.alias(k) for c, k in zip(kind_and_hash(), key, strict=True)), F.coalesce(F.expr(ACTIVE), F.lit(False)).alias("__active"), F.col("dup_count").alias("old_count"))
    # written, as it is counted and joined back: hashes may be a merge of many upserts
    own = written(rows.join(changed.select(F.col("hash").alias("__hash")).distinct(), "__hash", "left_semi"))
    groups = own.where("__active").groupBy(*key).agg((F.count("*") - 1).alias("__n"))
    new = F.when(F.col("__active"), F.coalesce("__n", F.lit(0))).otherwise(0).cast("long")
    both = own.join(groups, key, "left").select("file_id", "location_id", "old_count", new.alias("new_count")).where("old_count <> new_count")
    return both.withColumn("delta", (F.col("new_count") > 0).cast("int") - (F.col("old_count") > 0).cast("int"))


def live_dup_counts(hashes: DataFrame, strong: DataFrame | None = None, fast: DataFrame | None = None) -> DataFrame:
    """(hash, dup_count): counts over active rows, only above 0. Unlike stored counts, fast groups include verified files."""
    parts = []
    for column, wanted in (("hash_strong", strong), ("hash_fast", fast)):
        if wanted is not None:
            rows = active(hashes).where(f"{column} <> ''").join(wanted.select(F.col("hash").alias(column)).distinct(), column, "left_semi")
            parts.append(rows.groupBy(F.col(column).alias("hash")).agg((F.count("*") - 1).alias("dup_count")).where("dup_count > 0"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def dup_inconsistencies(hashes: DataFrame) -> DataFrame:
    """(hash, problem): hashes of active rows stored as unique though a twin exists (missed), or as duplicates without one (phantom)."""
    true = dup_recount(active(hashes)).select("file_id", F.col("dup_count").alias("__true"))
    rows = active(hashes).join(true, "file_id").withColumn("hash", effective_hash(F.col("hash_strong"), F.col("hash_fast"))).where("hash is not null")
    problem = F.when((F.col("dup_count") == 0) & (F.col("__true") > 0), "missed").when((F.col("dup_count") > 0) & (F.col("__true") == 0), "phantom")
    return rows.select("hash", problem.alias("problem")).where("problem is not null").distinct()


def group_members(hashes: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(selected_id, file_id, location_id): each selected file beside every active member of its group."""
    rows = hashes.withColumns(dict(zip(("__verified", "__hash"), kind_and_hash(), strict=True))).where("__hash is not null")
    own = rows.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").select("__verified", "__hash", F.col("file_id").alias("selected_id"))
    return own.join(rows.where(ACTIVE).select("__verified", "__hash", "file_id", "location_id"), ["__verified", "__hash"]).select("selected_id", "file_id", "location_id")


def selected_groups(hashes: DataFrame, file_ids: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The selected files (selected_id, __active) with their group's __verified and __hash, and the groups' active rows: in proportion to the files.

    With `once` the selected files are written, for a caller that reads both: all hashes are dealt by file to find them.
    """
    rows = hashes.withColumns(dict(zip(("__verified", "__hash"), kind_and_hash(), strict=True))).where("__hash is not null")
    own = rows.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").select("__verified", "__hash", F.col("file_id").alias("selected_id"), F.coalesce(F.expr(ACTIVE), F.lit(False)).alias("__active"))
    own = written(own) if once else own
    return own, rows.where(ACTIVE).join(own.select("__verified", "__hash").distinct(), ["__verified", "__hash"], "left_semi")


def duplicates_of(hashes: DataFrame, files: DataFrame, locations: DataFrame, file_ids: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` other members of each selected file's group by file_id, with their number in all."""
    key = ["__verified", "__hash"]
    own, members = selected_groups(hashes, file_ids)
    total = members.groupBy(*key).agg(F.count("*").alias("__n"))
    # one more than the limit, as a selected file may be among them
    first = members.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("file_id"))).where(F.col("__r") <= limit + 1).select(*key, "file_id", "location_id")
    other = own.join(total, key).join(first, key).where("file_id <> selected_id").withColumn("total", F.col("__n") - F.col("__active").cast("long"))
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy("selected_id").orderBy("file_id"))).where(F.col("rank") <= limit)
    named = ranked.join(files.select("file_id", "rel_path"), "file_id").join(locations.select("location_id", "name", "agent_name"), "location_id")
    return named.select("selected_id", "file_id", "rank", "total", "rel_path", F.col("name").alias("location_name"), "agent_name")


def expand_to_duplicates(hashes: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(file_id): the selected files and all active members of their groups."""
    return file_ids.select("file_id").union(selected_groups(hashes, file_ids)[1].select("file_id")).distinct()


def location_dup_counts(hashes: DataFrame) -> DataFrame:
    return active(hashes).where("dup_count > 0").groupBy("location_id").agg(F.count("*").alias("duplicates"))


def set_dup_exclude(files: DataFrame, hashes: DataFrame, location_id: int, prefix: str, flag: bool = True) -> DataFrame:
    """Hashes with a subtree's non-stale files excluded (or taken back), and all counts anew."""
    own = files.where((F.col("location_id") == location_id) & (F.col("stale") == 0) & F.col("rel_path").startswith(prefix + "/")).select("file_id", F.lit(int(flag)).alias("__x"))
    return dup_recount(hashes.join(own, "file_id", "left").withColumn("excluded", F.coalesce("__x", "excluded")).select(*hashes.columns))


def exclude_folders(folders: DataFrame, location_id: int, prefix: str, flag: bool = True) -> DataFrame:
    """Folders with dup_exclude set (or taken back) on a folder and all below it; set_dup_exclude does so for its files."""
    inside = (F.col("location_id") == location_id) & ((F.col("rel_path") == prefix) | F.col("rel_path").startswith(prefix + "/"))
    old = F.coalesce("dup_exclude", F.lit(0)) if "dup_exclude" in folders.columns else F.lit(0)
    return folders.withColumn("dup_exclude", F.when(inside, int(flag)).otherwise(old))


def affected_hashes(hashes: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(hash): effective hashes of the given files that count as duplicates; to recount once the files are gone."""
    own = hashes.where("dup_count > 0").join(file_ids.select("file_id"), "file_id", "left_semi")
    return own.select(effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("hash")).where("hash is not null").distinct()


def cross_location_candidates(hashes: DataFrame, location_id: int) -> DataFrame:
    """Active files elsewhere without a fast hash whose partial hash and size equal those of a hashed file here."""
    here = _gated(hashes).where((F.col("location_id") == location_id) & F.col("hash_fast").isNotNull()).select(*GATE).distinct()
    return _gated(hashes).where((F.col("location_id") != location_id) & F.col("hash_fast").isNull()).join(here, GATE, "left_semi")


def known_hashes(hashes: DataFrame) -> DataFrame:
    """(hash_fast, match_id): the smallest active file of each fast hash."""
    return active(hashes).where("hash_fast <> ''").groupBy("hash_fast").agg(F.min("file_id").alias("match_id"))


def known_gates(hashes: DataFrame) -> DataFrame:
    """The (hash_partial, file_size) of active files with content, marked by __met."""
    return _gated(hashes).select(*GATE).distinct().withColumn("__met", F.lit(True))


def arrivals_dup_check(arrivals: DataFrame, hashes: DataFrame) -> DataFrame:
    """Arrivals with match_id, the smallest active file of equal fast hash, and whether they need hashing (partial and size met, no fast hash)."""
    found = arrivals.join(known_hashes(hashes), "hash_fast", "left").join(known_gates(hashes), GATE, "left")
    return found.withColumn("to_hash", F.col("hash_fast").isNull() & F.col("__met").isNotNull()).drop("__met")


def consolidate_preview(hashes: DataFrame, files: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(selected_id, members, same_name): sizes of the selected files' groups; a group selected twice counts twice."""
    key = ["__verified", "__hash"]
    own, members = selected_groups(hashes, file_ids)
    names = files.select("file_id", "filename")
    by_name = members.join(names, "file_id").groupBy(*key, "filename").agg(F.count("*").alias("same_name"))
    sizes = by_name.groupBy(*key).agg(F.sum("same_name").alias("members"))
    mine = own.join(names.select(F.col("file_id").alias("selected_id"), "filename"), "selected_id")
    return mine.join(sizes, key).join(by_name, [*key, "filename"], "left").select("selected_id", "members", F.coalesce("same_name", F.lit(0)).cast("long").alias("same_name"))


def preview_places(hashes: DataFrame, files: DataFrame, locations: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(file_id, filename, rel_path, location_name, agent_name, selected): each member of the selected files' groups once, and where it lies."""
    _, members = selected_groups(hashes, file_ids)
    mine = file_ids.select("file_id", F.lit(True).alias("selected")).distinct()
    rows = members.select("file_id").distinct().join(files.select("file_id", "location_id", "filename", "rel_path"), "file_id")
    places = locations.select("location_id", F.col("name").alias("location_name"), "agent_name")
    out = rows.join(places, "location_id").join(mine, "file_id", "left")
    return out.select("file_id", "filename", "rel_path", "location_name", "agent_name", F.coalesce("selected", F.lit(False)).alias("selected"))


def batch_unique(hashes: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(file_id): of selected files with equal effective hash the first by column position; unhashed ones all."""
    own = file_ids.select("file_id", "position").join(hashes.select("file_id", effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("__h")), "file_id", "left")
    hashed = own.where("__h is not null").groupBy("__h").agg(F.min_by("file_id", F.struct("position", "file_id")).alias("file_id"))
    return hashed.select("file_id").union(own.where("__h is null").select("file_id"))


def three_gate(files: DataFrame, hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """The whole funnel: hashes with fast hashes for all candidates, and duplicate counts.

    Gate 1 and 2 group by partial hash and size; small members take their partial hash, the others that of contents
    (file_id, content_hash; each file once); gate 3 counts equal hashes. hashes is scanned twice, for the groups and for the
    rows, and its rows are dealt by gate and then once by file, to files and contents together; the filled rows are
    written before they are counted.
    """
    groups = candidate_groups(hashes).select(*GATE, F.lit(True).alias("__met"))
    key = spread_key(F.col("hash_partial"), F.col("file_id"))
    gated = hashes.withColumn("__partial", F.col("hash_partial")).withColumn("hash_partial", key).join(groups, GATE, "left").withColumn("hash_partial", F.col("__partial"))
    read = files.where("stale = 0").select("file_id", F.lit(True).alias("__there")).join(contents.select("file_id", F.col("content_hash").alias("__fast")), "file_id", "left")
    wanted = F.expr(ACTIVE) & F.col("hash_fast").isNull() & F.col("__met").isNotNull() & F.col("__there")
    fast = F.when(F.col("file_size") <= SMALL, F.col("hash_partial")).otherwise(F.col("__fast"))
    filled = gated.join(read, "file_id", "left").withColumn("hash_fast", F.coalesce("hash_fast", F.when(wanted, fast)))
    return dup_recount(written(filled.select(*hashes.columns)))


def top_groups(hashes: DataFrame, k: int = 20) -> DataFrame:
    """(hash, copies, file_size, wasted): the k groups that waste most bytes."""
    rows = active(hashes).where("dup_count > 0").withColumn("hash", effective_hash(F.col("hash_strong"), F.col("hash_fast"))).withColumn("__v", _verified())
    groups = rows.groupBy("hash", "__v").agg(F.count("*").alias("copies"), F.max("file_size").alias("file_size"))
    return groups.select("hash", "copies", "file_size", ((F.col("copies") - 1) * F.col("file_size")).alias("wasted")).orderBy(F.desc("wasted"), "hash").limit(k)
