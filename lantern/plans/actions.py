"""Plans: tables that say which copy to keep, merge, stub, move or delete. No plan touches a disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.functions.fn import classify_high, classify_low, dirname, effective_hash, hidden_inherited, location_label, sources_text, spread_key, stub_text, suffix_name
from lantern.operators.dups import ACTIVE, dup_recount, expand_to_duplicates, kind_and_hash, selected_groups
from lantern.operators.tree import below
from lantern.tables import numbered, written


def merge_source(files: DataFrame, location_id: int, folder: str | None = None) -> DataFrame:
    """Non-stale files of a location or subtree that are no stub and no sources list."""
    own = files.where((F.col("location_id") == location_id) & (F.col("stale") == 0) & ~F.col("filename").endswith(".moved") & ~F.col("filename").endswith(".sources"))
    return own if folder is None else own.where(below(F.col("rel_path"), folder))


def dest_hash_index(files: DataFrame, hashes: DataFrame, location_id: int, folder: str | None = None) -> DataFrame:
    """(hash, dest_file_id, dest_path): per effective hash the destination's non-stale file of the smallest id."""
    own = files.where((F.col("location_id") == location_id) & (F.col("stale") == 0))
    if folder is not None:
        own = own.where(below(F.col("rel_path"), folder))
    rows = own.select("file_id", "rel_path").join(hashes.select("file_id", effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("hash")), "file_id").where("hash is not null")
    return rows.groupBy("hash").agg(F.min_by(F.struct("file_id", "rel_path"), "file_id").alias("d")).select("hash", F.col("d.file_id").alias("dest_file_id"), F.col("d.rel_path").alias("dest_path"))


def merge_plan(files: DataFrame, hashes: DataFrame, source_id: int, dest_id: int, mode: str = "copy", source_folder: str | None = None, dest_folder: str | None = None) -> DataFrame:
    """(file_id, rel_path, hash, action, dest_file_id, result) per source file.

    unique files are to be copied; a file whose hash is at the destination, or came earlier by path in this merge, is
    a duplicate. Unhashed files are unique. mode "move" leaves stubs. The first of each hash is found by aggregation.
    """
    src = merge_source(files, source_id, source_folder).select("file_id", "rel_path").join(hashes.select("file_id", effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("hash")), "file_id", "left")
    first = src.where("hash is not null").groupBy("hash").agg(F.min(F.struct("rel_path", "file_id")).alias("first"))
    both = src.join(first, "hash", "left").join(dest_hash_index(files, hashes, dest_id, dest_folder), "hash", "left")
    unique = F.col("hash").isNull() | (F.col("dest_file_id").isNull() & (F.col("first.file_id") == F.col("file_id")))
    texts = ("copied", "duplicate (skipped)") if mode == "copy" else ("copied + stubbed", "duplicate + stubbed")
    return both.select(
        "file_id", "rel_path", "hash", F.when(unique, "unique").otherwise("duplicate").alias("action"), F.coalesce("dest_file_id", F.when(~unique, F.col("first.file_id"))).alias("dest_file_id"),
        F.when(unique, texts[0]).otherwise(texts[1]).alias("result"),
    )


def merged_metadata(files: DataFrame, hashes: DataFrame, tags: DataFrame, file_ids: DataFrame, same_name: bool = False) -> DataFrame:
    """(selected_id, tags, description, modified_at) over each selected file's active, non-stale copies: all tags, the first description by id, the earliest time."""
    info = files.where("stale = 0").select("file_id", "filename", "description", "modified_at")
    own, members = selected_groups(hashes, file_ids, once=True)
    key = ["__verified", "__hash"] + ["filename"] * same_name
    if same_name:
        own = own.join(files.select(F.col("file_id").alias("selected_id"), "filename"), "selected_id")
    copies = written(members.select("__verified", "__hash", "file_id").join(info, "file_id"))  # read for tags, and for what else they say
    words = copies.join(tags, "file_id").groupBy(*key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.col("file_id"))
    rest = copies.groupBy(*key).agg(F.min_by("description", said).alias("description"), F.min("modified_at").alias("modified_at"))
    rest, words = own.select("selected_id", *key).join(rest, key), own.select("selected_id", *key).join(words, key).select("selected_id", "tags")
    return rest.join(words, "selected_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).select("selected_id", "tags", "description", "modified_at")


def consolidate_plan(files: DataFrame, hashes: DataFrame, file_ids: DataFrame, online: DataFrame, mode: str = "keep_here", dest_id: int | None = None, dest_folder: str = "") -> DataFrame:
    """(selected_id, file_id, role, result): the copy to keep of each selected group, and what becomes of the others.

    Of selected files with one hash the first by position counts. keep_here keeps it; move_to keeps the copy that lies in
    the destination folder, or a new one there (file_id null). Excluded copies are skipped, offline ones queued.
    """
    key = ["__verified", "__hash"]
    rows = hashes.select("file_id", *(c.alias(k) for c, k in zip(kind_and_hash(), key, strict=True)), F.coalesce(F.expr(ACTIVE), F.lit(False)).alias("__active"))
    wanted = file_ids.groupBy("file_id").agg(F.min("position").alias("position"), F.lit(True).alias("__wanted"))
    both = rows.join(wanted, "file_id", "full_outer").withColumn("__key", spread_key(F.col("__hash"), F.col("file_id")))
    # the first of each hash by position; a file without hash is its own group
    own = both.where("__wanted").groupBy("__key").agg(F.min(F.struct("position", "file_id", "__verified")).alias("__own")).select("__key", F.col("__own.file_id").alias("selected_id"), F.col("__own.__verified").alias("__as"))
    in_group = (F.col("file_id") == F.col("selected_id")) | (F.col("__hash").isNotNull() & F.col("__active") & (F.col("__verified") == F.col("__as")))
    members = both.join(own, "__key").where(in_group).select("selected_id", "file_id")
    there = (F.col("location_id") == dest_id) & (F.col("rel_dir") == dest_folder) if mode != "keep_here" else F.lit(False)
    copies = members.join(files.where("stale = 0").select("file_id", "location_id", "excluded", there.alias("__there")), "file_id")
    copies = copies.join(online.select("location_id", F.lit(True).alias("__on")).distinct(), "location_id", "left").select("selected_id", "file_id", "excluded", "__on", "__there")
    if mode == "keep_here":
        kept = F.col("file_id") == F.col("selected_id")
        rows = copies
    else:
        copies = written(copies)  # read for the copies there, all copies, and groups without one there
        best = copies.where("__there").groupBy("selected_id").agg(F.min("file_id").alias("__best"))
        rows = copies.join(best, "selected_id", "left")
        kept = F.coalesce(F.col("file_id") == F.col("__best"), F.lit(False))
    role = F.when(kept, "canonical").when(F.col("excluded") == 1, "skipped").otherwise("stub")
    result = F.when(kept, "kept").when(F.col("excluded") == 1, "skipped (excluded)").when(F.col("__on"), "stubbed").otherwise("queued")
    out = rows.select("selected_id", "file_id", role.alias("role"), result.alias("result"))
    if mode != "keep_here":
        new = rows.groupBy("selected_id").agg(F.max("__best").alias("b")).where("b is null").select("selected_id", F.lit(None).cast("long").alias("file_id"), F.lit("canonical").alias("role"), F.lit("copied").alias("result"))
        out = out.unionByName(new)
    return out


def copy_plan(files: DataFrame, hashes: DataFrame, file_ids: DataFrame, online: DataFrame) -> DataFrame:
    """(selected_id, source_id, result): an online copy to read each selected file from, itself if it is online, or an error."""
    key = ["__verified", "__hash"]
    own, members = selected_groups(hashes, file_ids)
    there = files.where("stale = 0").select("file_id", "location_id").join(online.select("location_id").distinct(), "location_id", "left_semi").select("file_id")
    first = members.select(*key, "file_id").join(there, "file_id").groupBy(*key).agg(F.min("file_id").alias("__first"))
    itself = there.select(F.col("file_id").alias("selected_id"), F.col("file_id").alias("__self"))
    wanted = file_ids.select(F.col("file_id").alias("selected_id")).distinct().join(own.join(first, key).select("selected_id", "__first"), "selected_id", "left")
    best = wanted.join(itself, "selected_id", "left").select("selected_id", F.coalesce("__self", "__first").alias("source_id"))
    out = file_ids.select(F.col("file_id").alias("selected_id")).distinct().join(best, "selected_id", "left")
    return out.withColumn("result", F.when(F.col("source_id").isNotNull(), "copied").otherwise("error: no online copy"))


def copied_rows(plan: DataFrame, files: DataFrame, hashes: DataFrame, tags: DataFrame, location_id: int, folder: str, same_name: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, hashes, tags) to add for a copy_plan's copies into a folder, with the metadata of all their copies.

    Names that are taken there, or wanted twice, get a number. Description, time and tags are merged_metadata's over the
    selected file's group (of its name alone with same_name); a file without hash keeps its own. The originals stay.
    """
    # the plan is run once and by itself, so that its shuffles are gone when names are joined; all that follows comes from the claims
    done = written(plan.where("source_id is not null").select("selected_id"))
    wanted = done.join(files.select(F.col("file_id").alias("selected_id"), "filename", "rel_path"), "selected_id")
    claims = wanted.select(F.col("selected_id").alias("id"), F.lit(folder).alias("directory"), "filename", "rel_path")
    taken = files.where((F.col("location_id") == location_id) & (F.col("rel_dir") == folder)).select(F.col("rel_dir").alias("directory"), "filename")
    path = F.concat(F.lit(f"{folder}/" if folder else ""), F.col("final_name"))
    at = written(resolve_names(claims, taken).select(F.col("id").alias("file_id"), F.lit(location_id).cast("long").alias("location_id"), path.alias("rel_path")))
    made, hashed, _ = copy_rows(at, files, hashes, tags.limit(0))
    made = written(made)
    ids = made.select("location_id", "rel_path", F.col("file_id").alias("__new")).join(at, ["location_id", "rel_path"]).select(F.col("file_id").alias("selected_id"), "__new")
    merged = merged_metadata(files, hashes, tags, at.select("file_id"), same_name)
    own = tags.groupBy(F.col("file_id").alias("selected_id")).agg(F.collect_set("tag").alias("__own"))
    meta = written(ids.join(merged, "selected_id", "left").join(own, "selected_id", "left"))
    new = meta.select(F.col("__new").alias("file_id"), F.col("description").alias("__d"), F.col("modified_at").alias("__m"), F.col("tags").isNotNull().alias("__grouped"))
    rows = made.join(new, "file_id").select(*(F.when(F.col("__grouped"), F.col("__d")).otherwise(F.col(c)).alias(c) if c == "description" else F.coalesce("__m", c).alias(c) if c == "modified_at" else F.col(c) for c in files.columns))
    words = F.coalesce("tags", "__own", F.array().cast("array<string>"))
    return rows, hashed, meta.select(F.col("__new").alias("file_id"), F.explode(words).alias("tag"))


def stub_rows(plan: DataFrame, files: DataFrame, date: str, banner: str = "Consolidated") -> DataFrame:
    """Catalog rows after the plan's files (file_id, dest_path, dest_location, dest_agent) became stubs."""
    rows = plan.join(files.select("file_id", "location_id", "rel_path", "filename"), "file_id")
    text = stub_text(F.col("filename"), F.col("dest_path"), location_label(F.col("dest_location"), F.col("dest_agent")), F.lit(date), banner)
    return rows.select(
        "file_id", "location_id", F.concat("rel_path", F.lit(".moved")).alias("rel_path"), F.concat("filename", F.lit(".moved")).alias("filename"),
        F.lit("text").alias("type_high"), F.lit("moved").alias("type_low"), F.octet_length(text).cast("long").alias("file_size"),
    )


def apply_stubs(files: DataFrame, stubs: DataFrame) -> DataFrame:
    """Catalog after stubbing: the stubbed files' rows changed to stub_rows' values; another file's row at a stub's path goes."""
    at = stubs.select("location_id", "rel_path", F.col("file_id").alias("__id"))
    other = files.join(at, ["location_id", "rel_path"]).where("file_id <> __id").select("file_id").join(stubs.select("file_id"), "file_id", "left_anti")
    new = stubs.select("file_id", *(F.col(c).alias(f"__s_{c}") for c in stubs.columns if c != "file_id"), F.lit(True).alias("__s"))
    rows = files.join(other, "file_id", "left_anti").join(new, "file_id", "left")
    return rows.select(*(F.when(F.col("__s"), F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c) if c in stubs.columns and c != "file_id" else F.col(c) for c in files.columns))


def source_entries(plan: DataFrame) -> DataFrame:
    """(canonical_path, entry) from (canonical_path, location, agent, rel_path): a row per copy, in any number."""
    return plan.select("canonical_path", sources_text(location_label(F.col("location"), F.col("agent")), F.col("rel_path")).alias("entry"))


def sources_rows(plan: DataFrame) -> DataFrame:
    """(canonical_path, content): the sources list of each kept file, its entries sorted. A list is one file's text; source_entries has its rows."""
    return source_entries(plan).groupBy("canonical_path").agg(F.array_join(F.sort_array(F.collect_list("entry")), "").alias("content"))


def sources_catalog_rows(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """Catalog rows of the sources lists: one beside each kept file (location_id, rel_path), of sources_rows' (canonical_path, content)."""
    rows = kept.select("location_id", F.col("rel_path").alias("canonical_path")).join(sources, "canonical_path")
    path = F.concat("canonical_path", F.lit(".sources"))
    return rows.select(
        "location_id", path.alias("rel_path"), dirname(path).alias("rel_dir"), F.substring_index(path, "/", -1).alias("filename"), hidden_inherited(path).cast("int").alias("hidden"),
        F.lit("text").alias("type_high"), F.lit("sources").alias("type_low"), F.octet_length("content").cast("long").alias("file_size"), F.lit(0).alias("stale"),
    )


def resolve_names(claims: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, directory, filename, final_name): names without case-insensitive collisions.

    claims: id, directory, filename, rel_path; taken: directory, filename. Per directory and lower-cased name, the first
    claimant by path takes the bare name if it is free; the k-th other takes the k-th free base_n. Bare names are
    settled first, so no generated name meets one. What is exploded grows with a name's claimants and taken forms.
    """
    return _named(claims, taken).select("id", "directory", "filename", "final_name")


def _named(claims: DataFrame, taken: DataFrame) -> DataFrame:
    """claims with final_name; they may have further columns.

    Claims are written once they are ranked, so that what they come from is run once.
    """
    low = F.lower("filename")
    order = Window.partitionBy("directory", "__low").orderBy("rel_path", "id")
    held = taken.select("directory", F.lower("filename").alias("__low")).distinct()
    ranked = written(claims.withColumn("__low", low).withColumn("__k", F.row_number().over(order)).join(held.withColumn("__held", F.lit(1)), ["directory", "__low"], "left"))
    bare = (F.col("__k") == 1) & F.col("__held").isNull()
    got = ranked.where(bare).select(*claims.columns, F.col("filename").alias("final_name"))
    rest = ranked.where(~bare).withColumn("__need", F.col("__k") - F.when(F.col("__held").isNull(), 1).otherwise(0))
    names = written(rest.groupBy("directory", "__low").agg(F.max("__need").alias("need")))
    # names that are gone: the destination's, and the bare names just given out
    gone = held.union(ranked.where(bare).select("directory", "__low"))
    base_n = F.regexp_extract("__low", r"^(.*)_([0-9]+)(\.[^.]*)?$", 2)
    base = F.regexp_replace("__low", r"_([0-9]+)(\.[^.]*)?$", "$2")
    forms = gone.select("directory", base.alias("__low"), base_n.try_cast("long").alias("n")).where("n >= 1").join(names.select("directory", "__low"), ["directory", "__low"], "left_semi")
    extra = forms.groupBy("directory", "__low").agg(F.count("*").alias("extra"))
    tries = names.join(extra, ["directory", "__low"], "left").select("directory", "__low", F.explode(F.sequence(F.lit(1), F.col("need") + F.coalesce("extra", F.lit(0)))).alias("n"))
    free = tries.withColumn("n", F.col("n").cast("long")).join(forms, ["directory", "__low", "n"], "left_anti")
    free = free.withColumn("__need", F.row_number().over(Window.partitionBy("directory", "__low").orderBy("n")))
    given = rest.join(free, ["directory", "__low", "__need"]).select(*claims.columns, suffix_name(F.col("filename"), F.col("n")).alias("final_name"))
    return got.unionByName(given)


def move_files(files: DataFrame, file_ids: DataFrame, dest_location: int, dest_folder: str, new_name: str | None = None) -> DataFrame:
    """(file_id, old_path, location_id, rel_path, filename, type_high, type_low, stub, clash): where selected files go.

    On a move a clash with a file there takes a suffix (resolve_names settles it); a new name makes it an error. A
    stub stays behind where the folder changes.
    """
    return _moves(files, file_ids, dest_location, dest_folder, new_name).drop("__from", "__stays")


def _moves(files: DataFrame, file_ids: DataFrame, dest_location: int, dest_folder: str, new_name: str | None) -> DataFrame:
    """move_files' rows with each file's location before (__from), and whether it lies in the folder already (__stays)."""
    own = files.join(file_ids.select("file_id"), "file_id", "left_semi")
    name = F.lit(new_name) if new_name else F.col("filename")
    path = F.concat(F.lit(dest_folder + "/" if dest_folder else ""), name)
    there = files.where((F.col("location_id") == dest_location) & (F.col("rel_dir") == dest_folder)).select(F.lower("filename").alias("__low")).distinct().withColumn("__taken", F.lit(True))
    stays = (F.col("location_id") == dest_location) & (F.col("rel_dir") == dest_folder)
    rows = own.withColumn("__low", F.lower(name)).join(there, "__low", "left")
    return rows.select(
        "file_id", F.col("rel_path").alias("old_path"), F.lit(dest_location).cast("long").alias("location_id"), path.alias("rel_path"), name.alias("filename"), classify_high(name).alias("type_high"),
        classify_low(name).alias("type_low"), (~stays).alias("stub"), F.when(stays & (F.lower("filename") == F.lower(name)), False).otherwise(F.coalesce("__taken", F.lit(False))).alias("clash"),
        F.col("location_id").alias("__from"), stays.alias("__stays"),
    )


def move_plan(files: DataFrame, file_ids: DataFrame, dest_location: int, dest_folder: str, online: DataFrame, new_name: str | None = None, copy: bool = False) -> DataFrame:
    """(file_id, location_id, rel_path, filename, type_high, type_low, state, stub): a move or copy with names settled.

    On a move or copy a name that is taken takes a suffix; as a new name it is an error. A move waits (deferred) while
    either side is offline; a copy waits for its destination and is refused while its source is offline. A move whose
    folder changes leaves a stub.
    """
    rows = _moves(files, file_ids, dest_location, dest_folder, new_name)
    if not copy and not new_name:
        rows = rows.where(~F.col("__stays"))
    if new_name:
        settled = rows.withColumn("final_name", F.col("filename"))
    else:
        claims = rows.select(F.col("file_id").alias("id"), F.lit(dest_folder).alias("directory"), "filename", F.col("old_path").alias("rel_path"), "stub", "clash", "__from")
        taken = files.where((F.col("location_id") == dest_location) & (F.col("rel_dir") == dest_folder)).select(F.lit(dest_folder).alias("directory"), "filename")
        settled = _named(claims, taken).withColumnRenamed("id", "file_id")
    there = online.select("location_id").distinct()
    up = settled.join(there.select(F.col("location_id").alias("__from"), F.lit(True).alias("__up")), "__from", "left").crossJoin(there.where(F.col("location_id") == dest_location).agg((F.count("*") > 0).alias("__dest_up")))  # one row
    source_up, dest_up = F.coalesce("__up", F.lit(False)), F.col("__dest_up")
    offline = F.when(~source_up, "refused").when(~dest_up, "deferred") if copy else F.when(~source_up | ~dest_up, "deferred")
    state = F.coalesce(F.when(F.col("clash"), "error: name taken") if new_name else F.lit(None).cast("string"), offline, F.lit("done"))
    name = F.col("final_name")
    return up.select(
        "file_id", F.lit(dest_location).cast("long").alias("location_id"), F.concat(F.lit(dest_folder + "/" if dest_folder else ""), name).alias("rel_path"), name.alias("filename"),
        classify_high(name).alias("type_high"), classify_low(name).alias("type_low"), state.alias("state"), (F.col("stub") & (state == "done") & F.lit(not copy)).alias("stub"),
    )


def move_deltas(files: DataFrame, plan: DataFrame, copy: bool = False) -> DataFrame:
    """Signed stats (location_id, rel_dir, counters) of a plan's done rows: what leaves a folder, and what comes to one. Stale files do not count."""
    done = plan.where("state = 'done'").join(files.where("stale = 0").select("file_id", F.col("location_id").alias("__from"), "rel_dir", "file_size", "hidden"), "file_id")
    rows = done.select("location_id", dirname(F.col("rel_path")).alias("rel_dir"), F.lit(1).alias("s"), "file_size", hidden_inherited(F.col("rel_path")).cast("int").alias("hidden"))
    if not copy:
        rows = rows.unionByName(done.select(F.col("__from").alias("location_id"), "rel_dir", F.lit(-1).alias("s"), "file_size", "hidden"))
    return _signed(rows)


def _signed(rows: DataFrame) -> DataFrame:
    sums = (F.sum("s"), F.sum(F.col("s") * F.col("file_size")), F.sum(F.col("s") * F.col("hidden")))
    out = rows.groupBy("location_id", "rel_dir").agg(*(x.cast("long").alias(n) for x, n in zip(sums, ("file_count", "total_size", "hidden_count"), strict=True)))
    return out.withColumn("duplicate_count", F.lit(0).cast("long"))  # a recount settles these


def copy_rows(plan: DataFrame, files: DataFrame, hashes: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, hashes, tags) to add for a plan's (file_id, location_id, rel_path) copies, under new file ids behind the largest."""
    rows = plan.where("state = 'done'") if "state" in plan.columns else plan
    top = files.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("__top"))
    new = written(numbered(rows.select(F.col("file_id").alias("__old"), F.col("location_id").alias("__location"), F.col("rel_path").alias("__path")), "__path", "__old").crossJoin(top).withColumn("file_id", F.col("__top") + F.col("number")))
    path = F.col("__path")
    own = {"file_id": F.col("file_id"), "location_id": F.col("__location"), "rel_path": path, "rel_dir": dirname(path), "filename": F.substring_index(path, "/", -1), "hidden": hidden_inherited(path).cast("int")}
    before = files.select(F.col("file_id").alias("__old"), *(F.col(c).alias(f"__f_{c}") for c in files.columns))
    made = new.join(before, "__old").select(*(own[c].alias(c) if c in own else F.col(f"__f_{c}").alias(c) for c in files.columns))
    ids = new.select("__old", F.col("file_id").alias("__new"), F.col("__location"))
    kept = hashes.withColumnRenamed("file_id", "__old").join(ids, "__old")
    hashed = kept.select(*(F.col("__new").alias(c) if c == "file_id" else F.col("__location").alias(c) if c == "location_id" else F.col(c) for c in hashes.columns))
    tagged = tags.withColumnRenamed("file_id", "__old").join(ids, "__old").select(F.col("__new").alias("file_id"), "tag")
    return made, hashed, tagged


def move_folder(files: DataFrame, folders: DataFrame, location_id: int, folder: str, dest_folder: str, new_name: str | None = None, dest_location: int | None = None) -> DataFrame:
    """(file_id, location_id, rel_path, hidden, refused): new paths of all files below a folder; refused if it would go into itself or onto another.

    The same rows plan a copy, which keeps the old ones: see copy_rows.
    """
    name, goal = new_name or folder.rpartition("/")[2], location_id if dest_location is None else dest_location
    target = f"{dest_folder}/{name}" if dest_folder else name
    cycle = goal == location_id and (target == folder or (dest_folder + "/").startswith(folder + "/"))
    clash = folders.where((F.col("location_id") == goal) & (F.lower("rel_path") == target.lower())).agg((F.count("*") > 0).alias("__clash"))
    own = files.where((F.col("location_id") == location_id) & below(F.col("rel_path"), folder)).crossJoin(clash)  # one row
    path = F.concat(F.lit(target), F.substring("rel_path", len(folder) + 1, 1 << 20))
    return own.select("file_id", F.lit(goal).cast("long").alias("location_id"), path.alias("rel_path"), hidden_inherited(path).cast("int").alias("hidden"), (F.lit(cycle) | F.col("__clash")).alias("refused"))


def delete_plan(files: DataFrame, hashes: DataFrame, file_ids: DataFrame, online: DataFrame, all_duplicates: bool = False) -> DataFrame:
    """(file_id, location_id, action): files to delete now, or once their location is online."""
    ids = expand_to_duplicates(hashes, file_ids) if all_duplicates else file_ids.select("file_id").distinct()
    own = files.join(ids, "file_id", "left_semi").join(online.select("location_id", F.lit(True).alias("__on")).distinct(), "location_id", "left")
    return own.select("file_id", "location_id", F.when(F.col("__on"), "delete").otherwise("deferred").alias("action"))


def after_delete(hashes: DataFrame, plan: DataFrame) -> DataFrame:
    """Hashes without the deleted files, their former twins counted anew."""
    return dup_recount(hashes.join(plan.where("action = 'delete'").select("file_id"), "file_id", "left_anti"))


def delete_deltas(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Signed stats, for apply_deltas, of the non-stale files that a delete_plan deletes now."""
    own = files.where("stale = 0").join(plan.where("action = 'delete'").select("file_id"), "file_id", "left_semi")
    return _signed(own.select("location_id", "rel_dir", F.lit(-1).alias("s"), "file_size", "hidden"))


def delete_folder(files: DataFrame, folders: DataFrame, location_id: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files, folders) without a subtree."""
    own = (F.col("location_id") == location_id) & below(F.col("rel_path"), folder, True)
    return files.where(~own), folders.where(~own)


def delete_folder_effects(files: DataFrame, hashes: DataFrame, location_id: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(deltas, hashes) of a deleted subtree: signed stats of its non-stale files, and the hashes left, their former twins counted anew."""
    own = files.where((F.col("location_id") == location_id) & below(F.col("rel_path"), folder, True))
    gone = own.select("file_id")
    return _signed(own.where("stale = 0").select("location_id", "rel_dir", F.lit(-1).alias("s"), "file_size", "hidden")), dup_recount(hashes.join(gone, "file_id", "left_anti"))


def drain_pending(pending: DataFrame, files: DataFrame, online: DataFrame) -> DataFrame:
    """(op_id, file_id, state) of pending operations: run if the file is there, marked for it and online; wait offline; else completed without action."""
    known = files.select("file_id", "location_id", F.col("pending_op").alias("__mark"))
    both = pending.where("status = 'pending'").join(known, "file_id", "left").join(online.select("location_id", F.lit(True).alias("__on")).distinct(), "location_id", "left")
    state = F.when(F.col("__mark").isNull() | (F.col("__mark") != F.col("op_type")), "completed").when(F.col("__on"), "run").otherwise("wait")
    return both.select("op_id", "file_id", state.alias("state"))


def record_outcomes(pending: DataFrame, states: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """Pending operations after a drain: those of drain_pending's states that had nothing to do, or ran without error, are
    completed at that time; those whose outcome (op_id, error) has an error are failed, with it; the rest stay as they are."""
    told = outcomes.groupBy("op_id").agg(F.max("error").alias("__error"), F.lit(True).alias("__ran"))
    both = pending.join(states.select("op_id", F.col("state").alias("__state")), "op_id", "left").join(told, "op_id", "left")
    ran = (F.col("__state") == "run") & F.coalesce("__ran", F.lit(False))
    failed = ran & F.col("__error").isNotNull()
    done = (F.col("__state") == "completed") | ran
    status = F.when(failed, "failed").when(done, "completed").otherwise(F.col("status"))
    old = {c: F.col(c) if c in pending.columns else F.lit(None).cast(t) for c, t in (("error", "string"), ("completed_at", "timestamp"))}
    set_to = {"status": status, "error": F.when(failed, F.col("__error")).otherwise(old["error"]), "completed_at": F.when(failed | done, F.lit(at).cast("timestamp")).otherwise(old["completed_at"])}
    return both.withColumns(set_to).drop("__state", "__error", "__ran")


def cancel_pending(pending: DataFrame, ids: DataFrame) -> DataFrame:
    return pending.join(ids.select("op_id").distinct(), "op_id", "left_anti")


def clear_marks(files: DataFrame, pending: DataFrame, ids: DataFrame) -> DataFrame:
    """files without the pending mark of the operations that are cancelled."""
    gone = pending.join(ids.select("op_id").distinct(), "op_id", "left_semi").select("file_id", F.col("op_type").alias("__type")).distinct().groupBy("file_id").agg(F.collect_set("__type").alias("__types"))
    both = files.join(gone, "file_id", "left")
    cleared = F.when(F.coalesce(F.array_contains("__types", F.col("pending_op")), F.lit(False)), F.lit(None)).otherwise(F.col("pending_op"))
    return both.select(*(cleared.alias(c) if c == "pending_op" else F.col(c) for c in files.columns))
