"""Registered queries over the catalog operators, each with SQL that computes the same independently."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.fixtures import CTES, duck_views, spark_views
from lantern.functions import fn
from lantern.operators import diff, dups, hashing, search, stats, tree
from lantern.plans import actions, tags
from lantern.plans.repair import repair
from lantern.sources import catalog
from lantern.sources.snapshots import publish, snapshot
from lantern.streaming import stream
from lantern.tables import prepare, shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, views: str, run: Callable[..., DataFrame], sql: str | None, once: tuple[str, ...] = ()) -> None:
    """run gets the named views as DataFrames, which stand as written tables where `once` names them or what they come from."""
    import re

    names = views.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(*spark_views(spark, sf_dir, *names, once=once))

    QUERIES[name] = query
    if sql is not None:
        used = [x for x in CTES if re.search(rf"\b{x}\b", sql)]
        head = duck_views(*used)
        ORACLES[name] = head + (", " + sql.strip()[5:] if sql.strip().lower().startswith("with ") else sql)


EFF = "coalesce(nullif(hash_strong,''), nullif(hash_fast,''))"
VER = "(coalesce(hash_strong,'') <> '')"
ACT = "(excluded = 0 and stale = 0)"


def recount_sql(source: str) -> str:
    """source's rows with n, their duplicate counts, by a window."""
    return f"select *, case when {ACT} and eff is not null then count(*) filter (where {ACT}) over (partition by ver, eff) - 1 else 0 end as n from (select *, {EFF} as eff, {VER} as ver from {source})"


HERE, DIR = 1, "nation_15"
_LEAF = "nation_15/supplier_000000079/2000"
every = lambda df: df.select("file_id")
here = lambda df: df.where(F.col("location_id") == HERE).select("file_id")
online = lambda locations: locations.where("online").select("location_id")
counted = dups.dup_recount



def stored(df: DataFrame, write: Callable[..., None] | None = None) -> str:
    """The folder that df is written to, as Parquet unless write(writer, folder) says otherwise."""
    folder = shared_folder(df.sparkSession)
    (write or (lambda w, f: w.parquet(f)))(df.write, folder)
    return folder


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input is read."""
    spark, out, checkpoint = rows.sparkSession, shared_folder(rows.sparkSession), shared_folder(rows.sparkSession)
    work = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")
    rows.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(out)


# --- sources and sinks ---
#: Bytes of lines that are written at a time.
_BLOCK = 4 << 20


def _lines(parts):
    """Blocks of the lines of each folder."""
    import pandas as pd

    for b in parts:
        rows, folders = [], b["rel_dir"].fillna("__HIVE_DEFAULT_PARTITION__")
        for folder, own in b["content"].groupby(folders):
            block, size = [], 0
            for text in own:
                line = (text or "").encode() + b"\n"
                if block and size + len(line) > _BLOCK:
                    rows.append((folder, b"".join(block), size))
                    block, size = [], 0
                block.append(line)
                size += len(line)
            rows.append((folder, b"".join(block), size))
        yield pd.DataFrame(rows, columns=["rel_dir", "lines", "size"])


def _texts(docs: DataFrame) -> str:
    """A tree of one text file per folder, a line per document.

    Many tasks write a file, each its blocks of lines at their places, so none reads a whole folder. Where the shared folder is
    no path, a file has one writer, as file systems there have it.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in root:
        return stored(docs.select("rel_dir", "content").repartition("rel_dir"), lambda w, f: w.partitionBy("rel_dir").text(f))
    blocks = written(docs.select("rel_dir", "content").mapInPandas(_lines, "rel_dir string, lines binary, size long").withColumn("block", F.monotonically_increasing_id()))
    before = Window.partitionBy("rel_dir").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = blocks.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    def place(parts):
        import os

        for b in parts:
            for folder, lines, start in zip(b["rel_dir"], b["lines"], b["start"], strict=True):
                at = Path(root, f"rel_dir={folder}", "part-0.txt")
                at.parent.mkdir(parents=True, exist_ok=True)
                file = os.open(at, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    done = 0
                    while done < len(lines):
                        done += os.pwrite(file, lines[done:], start + done)
                finally:
                    os.close(file)
            yield b[["block"]]

    blocks.join(starts, "block").select("block", "rel_dir", "lines", "start").mapInPandas(place, "block long").write.format("noop").mode("overwrite").save()
    return root


def _scanned(docs: DataFrame, level: bool = False) -> DataFrame:
    folder = _texts(docs)
    found = catalog.scan_level(docs.sparkSession, f"{folder}/rel_dir=en") if level else catalog.scan_tree(docs.sparkSession, folder)
    return found.select(F.when(F.contains("rel_path", F.lit("/")), F.substring_index("rel_path", "/", 1)).otherwise("").alias("folder"), "file_size", "type_high").groupBy("folder", "type_high").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


add("src_01_scan_tree", "f_docs", _scanned, "select concat('rel_dir=', rel_dir) as folder, 'text' as type_high, 1 as files, cast(sum(coalesce(strlen(content), 0) + 1) as bigint) as bytes from f_docs group by rel_dir")
def _planted(docs: DataFrame) -> DataFrame:
    """A tree of one file per document, some of them and of their folders hidden, with a symbolic link beside each hidden file."""
    prepare(docs.sparkSession)
    root = shared_folder(docs.sparkSession).removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError("a tree with symbolic links needs a shared folder that is a path")

    def plant(parts):
        for b in parts:
            for path, text in zip(b["path"], b["content"], strict=True):
                at = Path(root, path)
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(text.encode())
                if at.name.startswith("."):
                    with contextlib.suppress(FileExistsError):
                        at.with_name(f"link{at.name}").symlink_to(at)
            yield b[["path"]]

    rows = docs.select(F.expr(_TREE_PATH).alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    rows.mapInPandas(plant, "path string").write.format("noop").mode("overwrite").save()
    found = catalog.scan_all(docs.sparkSession, root)
    return found.select(F.regexp_replace("rel_path", "/[^/]*$", "").alias("folder"), "hidden", "file_size", "type_high").groupBy("folder", "hidden", "type_high").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


_TREE_PATH = "concat(rel_dir, '/', case when file_id % 7 = 0 then '.h/deep/' when file_id % 3 = 0 then 'sub/' else '' end, case when file_id % 5 = 0 then '.' else '' end, filename)"
add("src_01_scan_all", "f_docs", _planted,
    f"""with t as (select {_TREE_PATH} as path, coalesce(file_size, 0) as size from f_docs)
    select regexp_replace(path, '/[^/]*$', '') as folder, (path like '%/.%')::int as hidden, 'text' as type_high, count(*) as files, cast(sum(size) as bigint) as bytes from t group by 1, 2""")  # fmt: skip
add("src_02_scan_level", "f_docs", lambda d: _scanned(d, True), "select '' as folder, 'text' as type_high, 1 as files, cast(sum(coalesce(strlen(content), 0) + 1) as bigint) as bytes from f_docs where rel_dir = 'en'")
add("src_03_parse_listing", "f_listing_tsv", lambda v: catalog.parse_listing(v).select("location_id", "kind", "path", "file_size", F.col("inode").cast("long").alias("inode"), "hash_partial"),
    """with p as (select location_id, string_split(value, chr(9)) as x from f_listing_tsv)
    select location_id, x[1] as kind, x[2] as path, case when x[1]='F' then cast(x[3] as bigint) end as file_size, case when x[1]='F' then cast(x[6] as bigint) end as inode, case when x[1]='H' then x[3] end as hash_partial
    from p where (x[1]='F' and len(x)>=6) or (x[1]='D' and len(x)>=2) or (x[1]='H' and len(x)>=3)""")  # fmt: skip
add("src_04_assemble_listing", "f_listing_tsv", lambda v: catalog.assemble_listing(catalog.parse_listing(v), ["location_id"]).select("location_id", "rel_path", "file_size", "hash_partial"),
    """with p as (select location_id, string_split(value, chr(9)) as x from f_listing_tsv),
    f as (select location_id, x[2] as rel_path, cast(x[3] as bigint) as file_size from p where x[1]='F' and len(x)>=6), h as (select location_id, x[2] as rel_path, max(nullif(x[3],'')) as hash_partial from p where x[1]='H' group by all)
    select f.*, hash_partial from f left join h using (location_id, rel_path)""")  # fmt: skip


def _round_trip(h: DataFrame, f: DataFrame) -> DataFrame:
    """Two versions: the hashes of one location with the files, then all hashes; the files come along."""
    spark, folder = h.sparkSession, shared_folder(h.sparkSession)
    publish(spark, folder, {"hashes": h.where(F.col("location_id") == HERE), "files": f})
    publish(spark, folder, {"hashes": h})
    last = snapshot(spark, folder)
    return last.table("hashes").join(last.table("files").select("file_id", "filename"), "file_id").select("file_id", "location_id", "filename", "hash_partial", "hash_fast", "hash_strong")


add("src_05_write_read_catalog", "f_hashes f_line", _round_trip, "select h.file_id, h.location_id, filename, hash_partial, hash_fast, h.hash_strong from (select file_id, location_id, hash_fast, hash_strong from f_hashes) h join (select file_id, filename, hash_partial from f_line) f using (file_id)")

# A listing that names some files twice; the later row counts.
_CATALOG = ("location_id", "rel_path", "file_id", "file_size", "modified_at", "description", "stale")
_TWICE = lambda n: n.select("location_id", "rel_path", "file_size", "modified_at", F.lit(1).alias("seq")).unionByName(n.where("file_size % 3 = 0").select("location_id", "rel_path", (F.col("file_size") + 1).alias("file_size"), "modified_at", F.lit(2).alias("seq")))
_KNOWN_ID = lambda c, rows: rows.join(c.select("location_id", "rel_path", F.col("file_id").alias("__id")), ["location_id", "rel_path"], "left").select("location_id", "rel_path", F.when(F.col("file_id") == F.col("__id"), F.col("__id")).alias("known_id"), F.col("file_id").isNotNull().alias("has_id"), "file_size", "modified_at", "description", "stale")
_UPSERTED = """with n as (select location_id, rel_path, file_size + case when file_size % 3 = 0 then 1 else 0 end as file_size, modified_at from f_listing)
    select coalesce(c.location_id, n.location_id) as location_id, coalesce(c.rel_path, n.rel_path) as rel_path, c.file_id as known_id, true as has_id, case when n.rel_path is not null then n.file_size else c.file_size end as file_size,
    case when n.rel_path is not null then n.modified_at else c.modified_at end as modified_at, c.description, case when n.rel_path is not null then 0 else c.stale end as stale
    from f_line c full join n on c.location_id=n.location_id and c.rel_path=n.rel_path"""
add("src_06_upsert_files", "f_line f_listing", lambda c, n: _KNOWN_ID(c, catalog.upsert_files(c.select(*_CATALOG), _TWICE(n), "seq")), _UPSERTED)
add("src_07_upsert_hashes", "f_hashes0 f_hashes",
    lambda o, n: catalog.upsert_hashes(o.where("location_id <> 1").select("file_id", "file_size", "hash_fast", "hash_strong"), n.where("location_id < 4").select("file_id", (F.col("file_size") + 1).alias("file_size"), F.when(F.col("file_id") % 4 == 0, F.col("hash_fast")).alias("hash_fast"))),
    """with o as (select * from f_hashes0 where location_id <> 1), n as (select file_id, file_size + 1 as file_size, case when file_id % 4 = 0 then hash_fast end as hash_fast from f_hashes where location_id < 4)
    select coalesce(o.file_id, n.file_id) as file_id, case when n.file_id is not null then n.file_size else o.file_size end as file_size, coalesce(n.hash_fast, o.hash_fast) as hash_fast, o.hash_strong from o full join n on o.file_id = n.file_id""")  # fmt: skip


def _log(plan: DataFrame, f: DataFrame) -> DataFrame:
    rows = plan.join(f.select("file_id", "rel_path"), "file_id").select(F.lit("AFRICA").alias("source_location"), F.col("rel_path").alias("source_path"), F.lit("AMERICA").alias("destination_location"), F.col("dest_path").alias("destination_path"), "result", F.lit("").alias("detail"))
    folder = shared_folder(f.sparkSession)
    catalog.write_op_log(rows, folder)
    return f.sparkSession.read.schema(rows.schema).option("header", True).csv(folder).select("source_path", "result")


add("src_08_write_op_log", "f_line f_hashes", lambda f, h: _log(actions.merge_plan(f, h, HERE, 2).select("file_id", "result").withColumn("dest_path", F.lit(None).cast("string")), f),
    "with s as (select f.file_id, f.rel_path, coalesce(nullif(h.hash_strong,''), nullif(h.hash_fast,'')) as hash from f_line f join f_hashes h using (file_id) where f.location_id = 1 and f.stale = 0), k as (select *, first_value(file_id) over (partition by hash order by rel_path, file_id) as f0 from s), d as (select distinct coalesce(nullif(h.hash_strong,''), nullif(h.hash_fast,'')) as hash from f_line f join f_hashes h using (file_id) where f.location_id = 2 and f.stale = 0) select rel_path as source_path, case when k.hash is null or (d.hash is null and f0 = file_id) then 'copied' else 'duplicate (skipped)' end as result from k left join d on d.hash = k.hash")
add("src_09_op_log_row", "f_line", lambda f: f.agg(F.sum("file_size").alias("size")).select(catalog.op_log_path("merge", "logs", F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("rel_path"), "size"), "select 'logs/merge-result-20240506-070809.csv' as rel_path, cast(sum(file_size) as bigint) as size from f_line")
add("src_10_split_wide_catalog", "f_line", lambda v: catalog.split_wide_catalog(v.withColumn("hash_fast", F.col("content_fast")).withColumn("dup_count", F.lit(0))).select("file_id", "location_id", "file_size", "hash_partial", "hash_fast", "hash_strong", "excluded"),
    "select file_id, location_id, file_size, hash_partial, content_fast as hash_fast, hash_strong, excluded from f_line where stale = 0 and coalesce(hash_partial, content_fast, hash_strong) is not null")
add("src_11_split_wide_stats", "f_scans", lambda v: catalog.split_wide_stats(v.select(F.col("scan_id").alias("location_id"), F.when(F.col("scan_id") % 3 == 0, F.lit("__deleting_x")).otherwise(F.col("status")).alias("name"), F.when(F.col("scan_id") % 2 == 0, F.col("scan_id")).alias("file_count"), F.col("location_id").alias("total_size"), F.when(F.col("scan_id") % 5 == 0, F.lit('{"text":1}')).alias("type_counts"))),
    """select scan_id as location_id, coalesce(case when scan_id % 2 = 0 then scan_id end, 0) as file_count, location_id as total_size, case when scan_id % 5 = 0 then '{"text":1}' else '{}' end as type_counts from f_scans where scan_id % 3 <> 0""")  # fmt: skip
add("src_11_split_wide_folders", "f_folders f_locations", lambda o, w: catalog.split_wide_folder_stats(o.select("location_id", "rel_path", F.when(F.length("rel_path") > 12, F.length("rel_path")).alias("file_count"), F.lit(7).alias("total_size"), F.lit(None).cast("string").alias("type_counts")), w.select("location_id", F.when(F.col("location_id") == 3, F.lit("__deleting_x")).otherwise(F.col("name")).alias("name"))),
    "select location_id, rel_path, cast(case when length(rel_path) > 12 then length(rel_path) else 0 end as bigint) as file_count, cast(7 as bigint) as total_size, '{}' as type_counts from f_folders where location_id <> 3")
add("src_12_explode_legacy_tags", "f_legacy", catalog.explode_legacy_tags,
    "with t as (select file_id, unnest(string_split(tags, ',')) as x from f_legacy) select distinct file_id, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) as tag from t where trim(x) <> ''")
add("src_13_add_ignore_rule", "f_ignore", lambda v: catalog.add_ignore_rule(v.where("file_size % 3 = 0"), v), "select distinct filename, file_size, location_id from f_ignore")
add("src_13_read_ignore_rules", "f_ignore f_locations", catalog.read_ignore_rules, "select i.filename, i.file_size, i.location_id, l.name as location_name from f_ignore i left join f_locations l using (location_id)")

# --- functions ---
_HIGH = "case " + " ".join(f"when e in ({', '.join(repr(x) for x in own)}) then '{high}'" for high, own in fn.TYPES.items()) + " when filename like '.%' then 'text' else 'other' end"
_LOW = "case e when 'jpeg' then 'jpg' when 'tif' then 'tiff' when 'mpg' then 'mpeg' when 'aif' then 'aiff' when 'mid' then 'midi' when 'ram' then 'ra' else e end"
_KNOWN = "e in (" + ", ".join(repr(x) for x in fn.EXTENSIONS) + ")"
_CLASS = "(select *, case when filename like '%.%' then lower(regexp_extract(filename, '[^.]*$')) else '' end as e from f_line)"
add("fn_01_classify", "f_line", lambda v: v.select("file_id", fn.classify_high(F.col("filename")).alias("high"), fn.classify_low(F.col("filename")).alias("low")),
    f"select file_id, {_HIGH} as high, case when {_KNOWN} then {_LOW} when filename like '.%' then 'dotfile' when e = '' then 'unknown' else e end as low from {_CLASS}")
add("fn_02_format_size", "f_line", lambda v: v.select("file_id", fn.format_size(F.col("file_size") * F.col("file_id") + 1).alias("text")),
    "select file_id, case when s < 1024 then printf('%d B', s) when s < 1048576 then printf('%.1f KB', s/1024.0) when s < 1073741824 then printf('%.1f MB', s/1048576.0) when s < 1099511627776 then printf('%.1f GB', s/1073741824.0) else printf('%.1f TB', s/1099511627776.0) end as text from (select file_id, file_size * file_id + 1 as s from f_line)")
_SIZES = "case file_id % 7 when 0 then '5MB' when 1 then ' 1.5 gb' when 2 then '12' when 3 then 'x' when 4 then '' when 5 then '1.2.3MB' else concat(q, ' kb') end"
add("fn_03_parse_size", "f_line", lambda v: v.select("file_id", fn.parse_size(F.expr(_SIZES)).alias("size")),
    "select file_id, case file_id % 7 when 0 then 5*1048576 when 1 then 1610612736 when 2 then 12 when 3 then null when 4 then null when 5 then null else q*1024 end as size from f_line")
# Whole texts; two thirds have bytes before and behind them that are no text, and a cut character.
_BYTES = "case file_id % 3 when 0 then encode(content, 'UTF-8') when 1 then concat(unhex('FF'), encode(content, 'UTF-8'), unhex('C3')) else concat(unhex('E282'), encode(content, 'UTF-8'), unhex('80')) end"
add("fn_04_utf8_safe", "f_docs", lambda d: d.select("file_id", fn.utf8_safe(F.expr(_BYTES)).alias("text")), "select file_id, case when file_id % 3 = 0 then content else chr(65533) || content || chr(65533) end as text from f_docs")
add("fn_05_norm_inode", "f_line", lambda v: v.select("file_id", fn.norm_inode(F.expr("cast(18446744073709551615 as decimal(20,0)) - file_id * (inode % 2) * 1 - case when inode % 3 = 0 then cast(9223372036854775808 as decimal(20,0)) else 0 end")).alias("inode")),
    "select file_id, cast(case when x >= 9223372036854775808 then x - 18446744073709551616 else x end as bigint) as inode from (select file_id, cast(18446744073709551615 as hugeint) - file_id * (inode % 2) - case when inode % 3 = 0 then 9223372036854775808 else 0 end as x from f_line)")
add("fn_06_normalise_tag", "f_legacy", lambda v: v.select("file_id", fn.normalise_tag(F.col("tags"), nfkc=True).alias("tag")), "select file_id, lower(trim(regexp_replace(replace(tags, ',', ' '), '\\s+', ' ', 'g'))) as tag from f_legacy")
# Every other list has its letters f and i joined to one sign, which folding takes apart again.
add("fn_07_parse_tags", "f_legacy", lambda v: v.select("file_id", F.array_join(fn.parse_tags(F.expr("case when file_id % 2 = 0 then replace(tags, 'fi', '\ufb01') else tags end"), nfkc=True), "|").alias("tags")),
    "with t as (select file_id, unnest(string_split(tags, ',')) as x, unnest(range(len(string_split(tags, ',')))) as i from f_legacy), n as (select file_id, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) as tag, min(i) as i from t group by all) select file_id, string_agg(tag, '|' order by i) as tags from n where tag <> '' group by file_id")
add("fn_08_parse_mtime", "f_line", lambda v: v.select("file_id", fn.parse_mtime(F.expr("case file_id % 4 when 0 then cast(file_id as string) when 1 then date_format(modified_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 2 then 'never' else date_format(modified_at, 'yyyy-MM-dd') end")).alias("mtime")),
    "select file_id, case file_id % 4 when 0 then cast(file_id as double) when 2 then null else epoch(modified_at) end as mtime from f_line")
add("fn_09_node_id", "f_line", lambda v: v.select("file_id", fn.node_id("folder", F.col("file_id")).alias("node"), fn.parse_node_id(fn.node_id("folder", F.col("file_id")))["id"].alias("back")), "select file_id, concat('fld-', file_id) as node, file_id as back from f_line")
for _mode, _value, _sql in (("wildcard", "F_*1?.JPG", "filename ilike 'f\\_%1_.jpg' escape '\\'"), ("exact", "f_100018.jpg", "filename = 'f_100018.jpg'"), ("starts", "readme", "filename ilike 'readme%'"), ("ends", ".jpeg", "filename ilike '%.jpeg'"), ("anywhere", "_1", "filename ilike '%\\_1%' escape '\\'")):
    add(f"fn_10_name_{_mode}", "f_line", lambda v, m=_mode, x=_value: v.where(fn.name_matches(F.col("filename"), x, m)).select("file_id", "filename"), f"select file_id, filename from f_line where {_sql}")
add("fn_11_hidden", "f_line", lambda v: v.select("file_id", fn.hidden_own(F.col("rel_path")).cast("int").alias("own"), fn.hidden_inherited(F.col("rel_path")).cast("int").alias("inherited")),
    "select file_id, (filename like '.%')::int as own, (rel_path like '.%' or rel_path like '%/.%')::int as inherited from f_line")
add("fn_12_path_parts", "f_line", lambda v: v.select("file_id", *(fn.path_parts(F.col("rel_path"))[x].alias(x) for x in ("basename", "dirname", "stem", "ext", "depth"))),
    "select file_id, filename as basename, rel_dir as dirname, case when position('.' in substr(filename, 2)) > 0 then regexp_replace(filename, '\\.[^.]*$', '') else filename end as stem, case when position('.' in substr(filename, 2)) > 0 then regexp_extract(filename, '\\.[^.]*$') else '' end as ext, len(string_split(rel_path, '/'))::int as depth from f_line")
add("fn_13_effective_hash", "f_hashes0", lambda v: v.select("file_id", *(fn.effective(F.col("hash_strong"), F.col("hash_fast"))[x].alias(x) for x in ("hash", "column"))),
    f"select file_id, {EFF} as hash, case when {VER} then 'hash_strong' when coalesce(hash_fast,'') <> '' then 'hash_fast' end as \"column\" from f_hashes0")
add("fn_14_hash_kind", "f_hashes", lambda v: v.select("file_id", fn.hash_kind(fn.effective_hash(F.col("hash_strong"), F.col("hash_fast"))).alias("kind")), f"select file_id, case length({EFF}) when 64 then 'strong' when 16 then 'fast' end as kind from f_hashes")
add("fn_15_stub_text", "f_line f_locations", lambda v, w: v.join(w, "location_id").select("file_id", F.octet_length(fn.stub_text(F.col("filename"), F.col("rel_path"), F.when(F.col("online"), F.col("name")), F.lit("2024-01-01"))).cast("long").alias("size"), fn.sources_text(F.col("name"), F.col("rel_path")).alias("entry")),
    "select file_id, cast(strlen(concat('Consolidated', chr(10), 'Original: ', filename, chr(10), 'Moved to: ', case when online then concat(name, ': ') else '' end, rel_path, chr(10), 'Date: 2024-01-01', chr(10))) as bigint) as size, concat('- ', name, ': ', rel_path, chr(10)) as entry from f_line join f_locations using (location_id)")
add("fn_16_suffix_name", "f_line", lambda v: v.select("file_id", fn.suffix_name(F.col("filename"), F.col("file_id") % 3 + 1).alias("a"), fn.suffix_name(F.col("filename"), F.lit(2), "brackets").alias("b")),
    "select file_id, concat(stem, '_', file_id % 3 + 1, ext) as a, concat(stem, ' (2)', ext) as b from (select file_id, case when position('.' in substr(filename, 2)) > 0 then regexp_replace(filename, '\\.[^.]*$', '') else filename end as stem, case when position('.' in substr(filename, 2)) > 0 then regexp_extract(filename, '\\.[^.]*$') else '' end as ext from f_line)")
add("fn_17_type_counts", "f_line", lambda v: stats.type_maps(stats.direct_types(v).groupBy("location_id", "type_high").agg(F.sum("n").alias("n")), "location_id").select("location_id", fn.type_counts_json(F.col("type_counts")).alias("json")),
    "with t as (select location_id, type_high, count(*) as n from f_line where stale = 0 group by all) select location_id, concat('{', string_agg(concat('\"', type_high, '\":', n), ',' order by type_high), '}') as json from t group by location_id")
add("fn_18_location_label", "f_locations", lambda v: v.select("location_id", fn.location_label(F.col("name"), F.col("agent_name")).alias("label")), "select location_id, case when agent_name is null then name else concat(name, ' [', agent_name, ']') end as label from f_locations")

# --- hashing ---
add("hsh_01_hash_partial", "f_docs", lambda v: hashing.hash_partial(v, k=64).select("file_id", "hash_partial"),
    "select file_id, case when file_size = 0 then null when file_size <= 128 then substr(md5(content), 1, 16) else substr(md5(from_hex(concat(substr(hex(encode(content)), 1, 128), right(hex(encode(content)), 128)))), 1, 16) end as hash_partial from f_docs")
add("hsh_02_hash_fast", "f_docs", lambda v: hashing.hash_fast(v).select("file_id", "hash_fast"), "select file_id, substr(md5(content), 1, 16) as hash_fast from f_docs")
add("hsh_03_hash_strong", "f_docs", lambda v: hashing.hash_strong(v).select("file_id", "hash_strong"), "select file_id, sha256(content) as hash_strong from f_docs")
add("hsh_04_promote_small", "f_hashes0", lambda v: hashing.promote_small(v, here(v)).select("file_id", "hash_fast"), f"select file_id, case when location_id = {HERE} and file_size <= 131072 then coalesce(hash_fast, hash_partial) else hash_fast end as hash_fast from f_hashes0")
add("hsh_05_missing_partial", "f_line f_hashes", lambda f, h: hashing.missing_partial(f, h.where("hash_strong is null"), HERE, DIR).select("file_id"), f"select file_id from f_line where stale = 0 and file_size > 0 and location_id = {HERE} and rel_path like '{DIR.replace('_', '~_')}/%' escape '~' and hash_strong is not null")
add("hsh_05_missing_in_folder", "f_line f_hashes", lambda f, h: hashing.missing_partial(f, h.where("hash_strong is null"), HERE, folder=_LEAF).select("file_id"), f"select file_id from f_line where stale = 0 and file_size > 0 and location_id = {HERE} and rel_dir = '{_LEAF}' and hash_strong is not null")
add("hsh_06_unhashed", "f_hashes0", lambda v: hashing.unhashed_candidates(v).select("file_id", "location_id"), f"select file_id, location_id from f_hashes0 where {ACT} and hash_partial is not null and hash_fast is null")
_RESULTS = "case when file_id % 9 = 0 then 'File not found' end"
add("hsh_07_apply_results", "f_hashes0 f_line", lambda h, f: hashing.apply_hash_results(h, f, f.where("location_id < 4").select("location_id", "rel_path", F.col("content_fast").alias("hash"), F.expr("case when file_id % 4 = 0 then 'File not found' end").alias("error")))[0].select("file_id", "hash_fast", "stale"),
    "select h.file_id, case when h.location_id < 4 and h.file_id % 4 <> 0 then coalesce(content_fast, h.hash_fast) else h.hash_fast end as hash_fast, case when h.location_id < 4 and h.file_id % 4 = 0 then 1 else h.stale end as stale from f_hashes0 h join f_line f using (file_id)")
add("hsh_08_clear_changed", "f_hashes", lambda v: hashing.clear_changed_hashes(v, here(v)).select("file_id", "hash_partial", "hash_fast", "hash_strong"), f"select file_id, case when location_id <> {HERE} then hash_partial end as hash_partial, case when location_id <> {HERE} then hash_fast end as hash_fast, case when location_id <> {HERE} then hash_strong end as hash_strong from f_hashes")
_REHASH = lambda v: hashing.rehash(v, v.where("location_id < 3").select("file_id", F.lit(None).cast("string").alias("hash_partial"), F.concat(F.lit("x"), F.substring("hash_fast", 2, 15)).alias("hash_fast")))
add("hsh_09_rehash", "f_hashes", lambda v: _REHASH(v)[0].select("file_id", "hash_partial", "hash_fast", "hash_strong"), "select file_id, hash_partial, case when location_id < 3 then 'x' || substr(hash_fast, 2, 15) else hash_fast end as hash_fast, case when location_id >= 3 then hash_strong end as hash_strong from f_hashes")
add("hsh_09_rehash_affected", "f_hashes", lambda v: _REHASH(v)[1], "with r as (select * from f_hashes where location_id < 3) select hash_fast as hash from r where hash_fast is not null union select hash_strong from r where hash_strong is not null union select 'x' || substr(hash_fast, 2, 15) from r where hash_fast is not null")
add("hsh_10_verify_group", "f_hashes f_line f_locations", lambda h, f, w: hashing.verify_group(h, every(h), f, online(w)),
    f"select file_id, location_id, case when hash_strong is not null then 'have' when location_id in (select location_id from f_locations where online) then 'todo' else 'offline' end as state from f_hashes where {ACT} and hash_fast is not null")
_STRONG = lambda h: hashing.apply_strong(h, h.where("file_id % 3 <> 0").select("file_id", F.when(F.col("file_id") % 3 == 1, F.sha2("hash_fast", 256)).alias("hash_strong")))
add("hsh_10_strong", "f_hashes", lambda h: _STRONG(h)[0].select("file_id", "hash_strong"), "select file_id, case when file_id % 3 = 1 and hash_fast is not null then sha256(hash_fast) else hash_strong end as hash_strong from f_hashes")
add("hsh_10_strong_affected", "f_hashes", lambda h: _STRONG(h)[1],
    "with r as (select *, sha256(hash_fast) as s from f_hashes where file_id % 3 = 1 and hash_fast is not null), c as (select * from r where s is distinct from hash_strong) select hash_fast as hash from c union select s from c union select hash_strong from c where hash_strong is not null")
add("hsh_11_apply_partial", "f_hashes", lambda h: hashing.apply_partial(h, h.where("location_id = 1").select("file_id", F.when(F.col("file_id") % 2 == 0, F.reverse("hash_partial")).otherwise(F.col("hash_partial")).alias("hash_partial"))).select("file_id", "hash_partial", "hash_fast", "hash_strong"),
    f"with r as (select *, location_id = {HERE} and file_id % 2 = 0 and hash_partial is not null and reverse(hash_partial) <> hash_partial as c from f_hashes) select file_id, case when c then reverse(hash_partial) else hash_partial end as hash_partial, case when not coalesce(c, false) then hash_fast when file_size <= 131072 then reverse(hash_partial) end as hash_fast, case when not coalesce(c, false) then hash_strong end as hash_strong from r")
add("hsh_11_mark_backfill", "f_locations", lambda w: hashing.mark_backfill(w, HERE).select("location_id", "backfill_needed"), f"select location_id, (location_id = {HERE})::int as backfill_needed from f_locations")
add("hsh_11_rehash_worklist", "f_hashes", lambda v: hashing.rehash_partial_worklist(v, HERE).select("file_id"), f"select file_id from f_hashes where location_id = {HERE} and stale = 0 and file_size > 0 and hash_partial is not null")
add("hsh_12_byte_batches", "f_line", lambda v: hashing.byte_batches(v, 10_000_000).select("file_id", "batch"), "select file_id, cast(floor(coalesce(sum(file_size) over (partition by location_id order by inode, file_id rows between unbounded preceding and 1 preceding), 0) / 10000000) as bigint) as batch from f_line")

# --- duplicates ---
_GATED = f"{ACT} and hash_partial is not null and file_size > 0"
_GROUPS = f"select hash_partial, file_size, count(*) as n from f_hashes0 where {_GATED} group by all having count(*) > 1"
add("dup_01_active", "f_hashes", lambda v: dups.active(v).select("file_id"), f"select file_id from f_hashes where {ACT}")
add("dup_02_candidate_groups", "f_hashes0", dups.candidate_groups, _GROUPS)
add("dup_03_groups_of_location", "f_hashes0", lambda v: dups.candidate_groups(v, location_id=HERE), f"select g.* from ({_GROUPS}) g where exists (select 1 from f_hashes0 h where {_GATED} and h.location_id = {HERE} and h.hash_partial = g.hash_partial and h.file_size = g.file_size)")
add("dup_04_groups_of_files", "f_hashes0", lambda v: dups.candidate_groups(v, file_ids=every(v.where("hash_strong is not null"))), f"select g.* from ({_GROUPS}) g where exists (select 1 from f_hashes0 h where {_GATED} and h.hash_strong is not null and h.hash_partial = g.hash_partial and h.file_size = g.file_size)")
_CANDIDATES = f"select h.file_id, h.hash_partial, h.file_size from f_hashes0 h join ({_GROUPS}) g using (hash_partial, file_size) where {_GATED} and hash_fast is null"
add("dup_05_candidates", "f_hashes0 f_line", dups.dup_candidates, f"select c.*, f.location_id, f.rel_path, f.inode from ({_CANDIDATES}) c join f_line f using (file_id) where f.stale = 0")
_FUNNEL = f"(select h.file_id, h.location_id, h.file_size, h.hash_partial, case when c.file_id is not null then coalesce(h.hash_fast, l.content_fast) else h.hash_fast end as hash_fast, h.hash_strong, h.excluded, h.stale from f_hashes0 h join f_line l using (file_id) left join ({_CANDIDATES}) c on c.file_id = h.file_id)"
three_gate = lambda h, f: dups.three_gate(f, h, f.select("file_id", F.col("content_fast").alias("content_hash")))
add("dup_06_three_gate", "f_hashes0 f_line", lambda h, f: three_gate(h, f).select("file_id", "hash_fast", "dup_count"), f"select file_id, hash_fast, n as dup_count from ({recount_sql(_FUNNEL)})")
add("dup_07_recount", "f_hashes", lambda v: counted(v).select("file_id", "dup_count"), f"select file_id, n as dup_count from ({recount_sql('f_hashes')})")
add("dup_08_recount_location", "f_hashes", lambda v: counted(v, HERE).select("file_id", "dup_count"),
    f"with r as ({recount_sql('f_hashes')}), t as (select distinct ver, eff from r where {ACT} and location_id = {HERE} and eff is not null) select file_id, case when t.eff is not null then n else dup_count end as dup_count from r left join t using (ver, eff)")
_CHANGED = lambda h: h.where("location_id < 3").select(fn.effective_hash(F.col("hash_strong"), F.col("hash_fast")).alias("hash"))
add("dup_09_recount_hashes", "f_hashes", lambda v: dups.recount_hashes(v, _CHANGED(v)).select("file_id", "old_count", "new_count", "delta"),
    f"with r as ({recount_sql('f_hashes')}) select file_id, dup_count as old_count, n as new_count, (n > 0)::int - (dup_count > 0)::int as delta from r where eff in (select eff from r where location_id < 3) and n <> dup_count")
add("dup_10_live_counts", "f_hashes", lambda v: dups.live_dup_counts(v, strong=v.select(F.col("hash_strong").alias("hash")), fast=v.select(F.col("hash_fast").alias("hash"))),
    f"select hash_strong as hash, count(*) - 1 as dup_count from f_hashes where {ACT} and hash_strong is not null group by 1 having count(*) > 1 union all select hash_fast, count(*) - 1 from f_hashes where {ACT} and hash_fast is not null group by 1 having count(*) > 1")
add("dup_11_inconsistencies", "f_hashes", dups.dup_inconsistencies, f"with r as ({recount_sql('f_hashes')}) select distinct eff as hash, case when dup_count = 0 then 'missed' else 'phantom' end as problem from r where {ACT} and eff is not null and ((dup_count = 0 and n > 0) or (dup_count > 0 and n = 0))")
_PAIRS = f"select s.file_id as selected_id, m.file_id, m.location_id from (select *, {EFF} as eff, {VER} as ver from f_hashes) s join (select *, {EFF} as eff, {VER} as ver from f_hashes) m on s.eff = m.eff and s.ver = m.ver and m.excluded = 0 and m.stale = 0"
add("dup_12_duplicates_of", "f_hashes f_line f_locations", lambda h, f, w: dups.duplicates_of(h, f, w, every(h)).select("selected_id", "file_id", "total", "rel_path", "location_name", "agent_name"),
    f"with p as (select *, count(*) over (partition by selected_id) as total, row_number() over (partition by selected_id order by file_id) as k from ({_PAIRS} where s.file_id <> m.file_id)) select selected_id, file_id, total, rel_path, name as location_name, agent_name from p join f_line f using (file_id) join f_locations l on l.location_id = f.location_id where k <= 10")
add("dup_13_expand", "f_hashes", lambda v: dups.expand_to_duplicates(v, here(v)), f"select file_id from ({_PAIRS} where s.location_id = {HERE}) union select file_id from f_hashes where location_id = {HERE}")
add("dup_14_location_counts", "f_hashes", dups.location_dup_counts, f"select location_id, count(*) as duplicates from f_hashes where {ACT} and dup_count > 0 group by 1")
_IN_DIR = f"location_id = {HERE} and rel_path like '{DIR.replace('_', '~_')}/%' escape '~'"
_EXCLUDED = f"(select h.file_id, h.hash_strong, h.hash_fast, case when {_IN_DIR.replace('location_id', 'f.location_id')} and f.stale = 0 then 1 else h.excluded end as excluded, h.stale from f_hashes h join f_line f using (file_id))"
add("dup_15_set_exclude", "f_line f_hashes", lambda f, h: dups.set_dup_exclude(f, h, HERE, DIR).select("file_id", "excluded", "dup_count"), f"select file_id, excluded, n as dup_count from ({recount_sql(_EXCLUDED)})")
add("dup_15_folders", "f_folders", lambda o: dups.exclude_folders(o, HERE, DIR).select("location_id", "rel_path", "dup_exclude"), f"select location_id, rel_path, (location_id = {HERE} and (rel_path = '{DIR}' or starts_with(rel_path, '{DIR}/')))::int as dup_exclude from f_folders")
add("dup_16_affected", "f_hashes", lambda v: dups.affected_hashes(v, every(v)), f"select distinct {EFF} as hash from f_hashes where dup_count > 0 and {EFF} is not null")
add("dup_17_cross_location", "f_hashes0", lambda v: dups.cross_location_candidates(v, HERE).select("file_id"), f"select file_id from f_hashes0 h where {_GATED} and location_id <> {HERE} and hash_fast is null and exists (select 1 from f_hashes0 x where x.excluded = 0 and x.stale = 0 and x.location_id = {HERE} and x.hash_fast is not null and x.hash_partial = h.hash_partial and x.file_size = h.file_size)")
_ARRIVALS = lambda f: f.where("location_id = 1").select(F.col("file_id").alias("arrival_id"), "hash_partial", "file_size", F.when(F.col("file_id") % 24 == 0, F.col("content_fast")).alias("hash_fast"))
add("dup_18_arrivals", "f_line f_hashes0", lambda f, h: dups.arrivals_dup_check(_ARRIVALS(f), h.where("location_id <> 1")).select("arrival_id", "match_id", "to_hash"),
    f"with k as (select * from f_hashes0 where location_id <> 1 and {ACT}), a as (select file_id as arrival_id, hash_partial, file_size, case when file_id % 24 = 0 then content_fast end as hash_fast from f_line where location_id = 1) select arrival_id, (select min(file_id) from k where k.hash_fast = a.hash_fast) as match_id, a.hash_fast is null and exists (select 1 from k where k.hash_partial = a.hash_partial and k.file_size = a.file_size and k.file_size > 0) as to_hash from a")
add("dup_19_preview", "f_hashes f_line", lambda h, f: dups.consolidate_preview(h, f, every(h)), f"select selected_id, count(*) as members, count(*) filter (where a.filename = b.filename) as same_name from ({_PAIRS}) p join f_line a on a.file_id = p.file_id join f_line b on b.file_id = p.selected_id group by 1")
add("dup_19_places", "f_hashes f_line f_locations", lambda h, f, w: dups.preview_places(h, f, w, here(h)),
    f"with m as (select distinct file_id from ({_PAIRS} where s.location_id = {HERE})) select f.file_id, filename, rel_path, name as location_name, agent_name, location_id = {HERE} as selected from m join f_line f using (file_id) join f_locations using (location_id)")
_PICK = lambda h: h.select("file_id", (F.col("file_id") * 7919 % 10007).alias("position"))
add("dup_20_batch_unique", "f_hashes", lambda v: dups.batch_unique(v, _PICK(v)), f"with p as (select file_id, {EFF} as eff, row_number() over (partition by {EFF} order by file_id * 7919 % 10007, file_id) as k from f_hashes) select file_id from p where eff is null or k = 1")
add("dup_top_groups", "f_hashes0 f_line", lambda h, f: dups.top_groups(three_gate(h, f)), f"with r as ({recount_sql(_FUNNEL)}) select eff as hash, count(*) as copies, max(file_size) as file_size, (count(*) - 1) * max(file_size) as wasted from r where {ACT} and n > 0 group by eff, ver order by wasted desc, hash limit 20")

# --- filters, search, sorting ---
_OTHER = "type_high not in ('image','video','audio','document','text','compressed','font')"
shown = lambda v: v.select("file_id")
dup = lambda f, h: f.join(counted(h).select("file_id", "dup_count"), "file_id")
add("flt_02_type_other", "f_line", lambda v: shown(v.where(search.of_type("other"))), f"select file_id from f_line where {_OTHER}")
add("flt_03_description", "f_line", lambda v: shown(v.where(search.described("NOTE 1"))), "select file_id from f_line where description ilike '%note 1%'")
add("flt_04_tags_any", "f_line f_tags", lambda f, t: shown(search.tagged(f, t, ["promo", "brand#3"])), "select distinct file_id from f_tags where tag in ('promo', 'brand#3')")
add("flt_04_tags_none", "f_line f_tags", lambda f, t: shown(search.tagged(f, t, ["promo", "brand#3"], exclude=True)), "select file_id from f_line where file_id not in (select file_id from f_tags where tag in ('promo', 'brand#3'))")
add("flt_05_size", "f_line", lambda v: shown(v.where(search.between("file_size", fn.size_of("100KB"), fn.size_of("0.2 mb")))), "select file_id from f_line where file_size between 102400 and 209715")
add("flt_06_duplicates", "f_hashes", lambda v: shown(v.where(search.condition({"field": "duplicates", "from": "1", "to": "x"}))), "select file_id from f_hashes where dup_count >= 1")
add("flt_07_dates", "f_line", lambda v: shown(v.where(search.dated("1996-02-01", "1996-03-05"))), "select file_id from f_line where modified_at >= timestamp '1996-02-01' and modified_at < timestamp '1996-03-06'")
_ONE_FAST, _ONE_STRONG = "000a0a094fd74cb2", "0215dac47c79725ba27e669f719e6773645409d52dd1acf39046cdae9b5762ff"
add("flt_08_hash", "f_line f_hashes", lambda f, h: shown(search.with_hash(f, h, _ONE_FAST)), f"select file_id from f_hashes where {ACT} and (hash_fast = '{_ONE_FAST}' or hash_strong = '{_ONE_FAST}')")
add("flt_09_folder_name", "f_line", lambda v: shown(v.where(search.folder_name_is("199?", "wildcard"))), "select file_id from f_line where regexp_extract(rel_dir, '[^/]*$') like '199_'")
add("flt_11_subtree", "f_line", lambda v: shown(v.where((F.col("location_id") == HERE) & tree.below(F.col("rel_path"), DIR))), f"select file_id from f_line where {_IN_DIR}")
_CONDITIONS = [{"field": "name", "value": "f_*", "match": "wildcard"}, {"field": "type", "value": "other", "op": "exclude"}, {"field": "description", "value": "note 2", "op": "exclude"}, {"field": "size", "min": "16KB", "max": ""}, {"field": "date", "from": "", "to": ""}, {"field": "tags", "value": "promo", "op": "exclude"}]
_COND_SQL = f"filename ilike 'f\\_%' escape '\\' and not ({_OTHER}) and not (description ilike '%note 2%') and file_size >= 16384 and file_id not in (select file_id from f_tags where tag = 'promo')"
add("flt_13_compose", "f_line f_tags", lambda f, t: shown(search.where_all(f, _CONDITIONS, t)), f"select file_id from f_line where {_COND_SQL}")
add("flt_15_online", "f_line f_locations", lambda f, w: shown(search.online_only(f, online(w))), "select file_id from f_line where location_id in (select location_id from f_locations where online)")
_RULE = "exists (select 1 from f_ignore i where i.filename = f.filename and i.file_size = f.file_size and (i.location_id is null or i.location_id = f.location_id))"
add("flt_16_ignored", "f_line f_ignore", lambda f, i: shown(search.ignored(f, i)), f"select file_id from f_line f where {_RULE}")
add("flt_16_not_ignored", "f_line f_ignore", lambda f, i: shown(search.ignored(f, i, drop=True)), f"select file_id from f_line f where not {_RULE}")
add("flt_17_not_deleting", "f_scans", lambda v: search.not_deleting(v.withColumn("name", F.when(F.col("scan_id") % 4 == 0, F.lit("__deleting_a")).otherwise(F.lit("deleting")))).select("scan_id"), "select scan_id from f_scans where scan_id % 4 <> 0")


def _found_sql(where: str) -> str:
    """Results over f_line with live counts."""
    return f"""with s as (select hash_strong as h, count(*) - 1 as c from f_hashes where {ACT} and hash_strong is not null group by 1), q as (select hash_fast as h, count(*) - 1 as c from f_hashes where {ACT} and hash_fast is not null group by 1)
    select f.file_id, f.filename, l.name as location_name, hs.hash_strong, hs.hash_fast, coalesce(case when hs.hash_strong is not null then s.c else q.c end, 0) as dup_count
    from f_line f join f_locations l on l.location_id = f.location_id join f_hashes hs on hs.file_id = f.file_id left join s on s.h = hs.hash_strong left join q on q.h = hs.hash_fast where {where}"""


_COLS = ["file_id", "filename", "location_name", "hash_strong", "hash_fast", "dup_count"]
add("sch_01_search", "f_line f_hashes f_locations", lambda f, h, w: search.search(dup(f, h), h, w, name="f_", name_match="starts", size_min="64KB", file_type="image", show_hidden=False, location_id=HERE).select(*_COLS),
    _found_sql(f"f.filename ilike 'f\\_%' escape '\\' and f.file_size >= 65536 and f.type_high = 'image' and f.hidden = 0 and f.location_id = {HERE}"))
add("sch_02_advanced", "f_line f_hashes f_locations f_tags", lambda f, h, w, t: search.search_advanced(f, h, w, _CONDITIONS, t).select(*_COLS), _found_sql(_COND_SQL.replace("file_id not", "f.file_id not").replace("file_size >=", "f.file_size >=")))
_FSTATS = f"""select o.location_id, o.rel_path, count(f.file_id) as file_count, cast(coalesce(sum(f.file_size), 0) as bigint) as total_size, count(f.file_id) filter (where f.hidden = 1) as hidden_count, count(f.file_id) filter (where h.n > 0) as duplicate_count
    from f_folders o left join f_line f on f.location_id = o.location_id and f.stale = 0 and starts_with(f.rel_path, o.rel_path || '/') left join ({recount_sql('f_hashes')}) h on h.file_id = f.file_id group by 1, 2"""
fstats = lambda f, o, h: stats.folder_stats(f, o, counted(h))
_FOLDER_CONDITIONS = [{"field": "name", "value": "199*", "match": "wildcard"}, {"field": "files", "from": "20", "to": ""}, {"field": "date", "from": "1990-01-01"}]
add("sch_03_folders", "f_line f_folders f_hashes f_locations", lambda f, o, h, w: search.search_folders(o, fstats(f, o, h), w, _FOLDER_CONDITIONS).select("filename", "location_id", "file_size", "file_count", "dup_count"),
    f"select regexp_extract(rel_path, '[^/]*$') as filename, location_id, total_size as file_size, file_count, duplicate_count as dup_count from ({_FSTATS}) where regexp_extract(rel_path, '[^/]*$') like '199%' and file_count >= 20")
for _page, _name in enumerate(("sch_04_first_page", "sch_04_search_all")):
    add(_name, "f_line f_folders f_hashes f_locations",
        lambda f, o, h, w, page=_page: search.search_page(f, h, w, search.search_folders(o, fstats(f, o, h), w, _FOLDER_CONDITIONS), "size", True, page=page, name="9", location_id=HERE).select("filename", "type_high", "file_size"),
        f"""with r as (select filename, type_high, file_size, file_id from f_line where filename like '%9%' and location_id = {HERE} union all select regexp_extract(rel_path, '[^/]*$'), 'folder', total_size, -1 from ({_FSTATS}) where regexp_extract(rel_path, '[^/]*$') like '199%' and file_count >= 20)
        select filename, type_high, file_size from (select *, row_number() over (order by file_size desc, file_id) as k from r) where k between {120 * _page + 1} and {120 * _page + 120}""")  # fmt: skip
add("sch_04_totals", "f_line f_folders f_hashes f_locations", lambda f, o, h, w: search.totals(search.search_all(search.search(dup(f, h), h, w, name="9"), search.search_folders(o, fstats(f, o, h), w, _FOLDER_CONDITIONS))),
    f"select (select count(*) from f_line where filename like '%9%') + count(*) as total, count(*) as folders from ({_FSTATS}) where regexp_extract(rel_path, '[^/]*$') like '199%' and file_count >= 20")
add("sch_05_by_hash", "f_line f_hashes f_locations", lambda f, h, w: search.search_by_hash(f, h, w, _ONE_STRONG).select(*_COLS), _found_sql(f"hs.hash_strong = '{_ONE_STRONG}' or hs.hash_fast = '{_ONE_STRONG}'"))
add("sch_06_saved", "f_line f_hashes f_locations", lambda f, h, w: search.run_saved_search('{"name": "readme", "name_match": "starts", "location_id": 2}', dup(f, h), h, w).select(*_COLS), _found_sql("f.filename ilike 'readme%' and f.location_id = 2"))
add("sch_07_media_found", "f_line f_locations f_hashes", lambda f, w, h: search.media_ids(f, "image", online(w), found=search.search(dup(f, h), h, w, name="9", size_min="64KB"), by="size", descending=True), "select file_id, filename from f_line where type_high = 'image' and stale = 0 and filename like '%9%' and file_size >= 65536 and location_id in (select location_id from f_locations where online)")
add("sch_07_media", "f_line f_locations", lambda f, w: search.media_ids(f, "image", online(w)), "select file_id, filename from f_line where type_high = 'image' and stale = 0 and location_id in (select location_id from f_locations where online)")
add("srt_01_page", "f_line", lambda v: search.paged(v, "name", page=2).select("file_id", "filename"), "select file_id, filename from (select *, row_number() over (order by lower(filename), file_id) as k from f_line) where k between 241 and 360")
add("srt_01_page_after", "f_line", lambda v: search.paged(v, "size", True, after=(65536, 30000)).select("file_id", "file_size"), "select file_id, file_size from f_line where file_size < 65536 or (file_size = 65536 and file_id > 30000) order by file_size desc, file_id limit 120")
add("srt_02_page_of", "f_line", lambda v: search.page_of(v, 47838, "size", True), "select cast(floor(count(*) / 120) as bigint) as page from f_line f, (select file_size as s from f_line where file_id = 47838) where f.file_size > s or (f.file_size = s and f.file_id < 47838)")
add("srt_03_top_files", "f_line", lambda v: search.top_files(v).select("location_id", "rel_dir", "file_id", "rank"), "select location_id, rel_dir, file_id, k::int as rank from (select *, row_number() over (partition by location_id, rel_dir order by file_size desc, file_id) as k from f_line where stale = 0) where k <= 50")
add("srt_04_recent_scans", "f_scans f_locations", lambda s, w: search.recent_scans(s, w).select("scan_id", "location_name", "started_at"), "select scan_id, name as location_name, started_at from f_scans join f_locations using (location_id) order by started_at desc, scan_id desc limit 5")
add("srt_05_last_attempt", "f_scans", search.last_scan_attempt, "select location_id, scan_id, status, coalesce(completed_at, started_at) as attempted_at from (select *, row_number() over (partition by location_id order by started_at desc, scan_id desc) as k from f_scans) where k = 1")
_TURN = lambda: Window.partitionBy("part", "location_id").orderBy("place")
add("srt_06_inode_order", "f_line", lambda v: search.inode_order(v).select("file_id", "inode", "location_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).select("file_id", "inode", F.coalesce(F.lag("inode").over(_TURN()) <= F.col("inode"), F.lit(True)).alias("in_order")), "select file_id, inode, true as in_order from f_line")

# --- aggregations ---
_DIRECT = f"select f.location_id, f.rel_dir as rel_path, count(*) as file_count, cast(sum(f.file_size) as bigint) as total_size, count(*) filter (where hidden = 1) as hidden_count, count(*) filter (where n > 0) as duplicate_count from f_line f join ({recount_sql('f_hashes')}) h using (file_id) where f.stale = 0 group by 1, 2"
add("agg_01_direct_stats", "f_line f_hashes", lambda f, h: stats.direct_stats(f, counted(h)), _DIRECT)
add("agg_02_folder_stats", "f_line f_folders f_hashes", fstats, _FSTATS)
add("agg_02_folder_types", "f_line", stats.folder_types, "select o.location_id, o.rel_path, f.type_high, count(*) as n from f_folders o join f_line f on f.location_id = o.location_id and f.stale = 0 and starts_with(f.rel_path, o.rel_path || '/') group by all")
add("agg_03_location_stats", "f_line f_hashes", lambda f, h: stats.location_stats(f, counted(h)), f"select location_id, cast(sum(file_count) as bigint) as file_count, cast(sum(total_size) as bigint) as total_size, cast(sum(hidden_count) as bigint) as hidden_count, cast(sum(duplicate_count) as bigint) as duplicate_count from ({_DIRECT}) group by 1")
add("agg_04_dup_rollup", "f_line f_folders f_hashes", lambda f, o, h: stats.folder_dup_rollup(f, o, counted(h)), f"select location_id, rel_path, duplicate_count from ({_FSTATS})")


def _deltas(f: DataFrame) -> DataFrame:
    sign = F.when(F.col("file_id") % 2 == 0, 1).otherwise(-3)
    return f.select("location_id", "rel_dir", *(x.cast("long").alias(n) for n, x in zip(stats.COUNTERS, (sign, sign * F.col("file_size"), sign * F.col("hidden"), F.lit(0)), strict=True)))


add("agg_05_apply_deltas", "f_line f_folders f_hashes", lambda f, o, h: stats.apply_deltas(fstats(f, o, h), _deltas(f)),
    f"""with d as (select location_id, rel_dir, case when file_id % 2 = 0 then 1 else -3 end as s, file_size, hidden from f_line),
    u as (select o.location_id, o.rel_path, sum(s) as a, sum(s * file_size) as b, sum(s * hidden) as c from (select location_id, rel_path from f_folders) o join d on d.location_id = o.location_id and (d.rel_dir = o.rel_path or starts_with(d.rel_dir, o.rel_path || '/')) group by 1, 2
      union all select location_id, '', sum(s), sum(s * file_size), sum(s * hidden) from d group by 1)
    select coalesce(t.location_id, u.location_id) as location_id, coalesce(t.rel_path, u.rel_path) as rel_path, cast(greatest(0, coalesce(file_count, 0) + coalesce(a, 0)) as bigint) as file_count, cast(greatest(0, coalesce(total_size, 0) + coalesce(b, 0)) as bigint) as total_size,
      cast(greatest(0, coalesce(hidden_count, 0) + coalesce(c, 0)) as bigint) as hidden_count, coalesce(duplicate_count, 0) as duplicate_count from ({_FSTATS}) t full join u on t.location_id = u.location_id and t.rel_path = u.rel_path""")  # fmt: skip
def _typed(f: DataFrame, o: DataFrame, h: DataFrame) -> DataFrame:
    """Folder stats with types after every file left its folder and a third of those sized in even megabytes came back twice."""
    before = fstats(f, o, h).join(stats.type_maps(stats.folder_types(f), "location_id", "rel_path"), ["location_id", "rel_path"], "left")
    sign = F.when(F.col("stale") == 1, 2).otherwise(-1)
    one = f.select("location_id", "rel_dir", "type_high", sign.cast("long").alias("file_count"), (sign * F.col("file_size")).alias("total_size"), (sign * F.col("hidden")).cast("long").alias("hidden_count"), F.lit(0).cast("long").alias("duplicate_count"))
    out = stats.apply_deltas(before, one)
    return out.select("location_id", "rel_path", "file_count", "total_size", "hidden_count", fn.type_counts_json(F.col("type_counts")).alias("types"))


add("agg_05_typed_deltas", "f_line f_folders f_hashes", _typed,
    """with u as (select o.location_id, o.rel_path, f.type_high, f.stale, f.file_size, f.hidden from (select location_id, rel_path from f_folders union all select location_id, '' from f_locations) o
      join f_line f on f.location_id = o.location_id and (o.rel_path = '' or starts_with(f.rel_path, o.rel_path || '/'))),
    t as (select location_id, rel_path, type_high, sum(case when stale = 1 then 2 when rel_path = '' then -1 else 0 end) as n from u group by 1, 2, 3),
    j as (select location_id, rel_path, string_agg('"' || type_high || '":' || n, ',' order by type_high) as own from t where n > 0 group by 1, 2),
    c as (select location_id, rel_path, greatest(0, cast(sum(case when stale = 1 then 2 when rel_path = '' then -1 else 0 end) as bigint)) as file_count,
      greatest(0, cast(sum(case when stale = 1 then 2 * file_size when rel_path = '' then -file_size else 0 end) as bigint)) as total_size,
      greatest(0, cast(sum(case when stale = 1 then 2 * hidden when rel_path = '' then -hidden else 0 end) as bigint)) as hidden_count from u group by 1, 2),
    a as (select location_id, rel_path from f_folders union all select location_id, '' from f_locations)
    select a.location_id, a.rel_path, coalesce(file_count, 0) as file_count, coalesce(total_size, 0) as total_size, coalesce(hidden_count, 0) as hidden_count, '{' || coalesce(own, '') || '}' as types from a left join c using (location_id, rel_path) left join j using (location_id, rel_path)""")  # fmt: skip
_SHOWN = lambda types: F.array_join(F.transform(types, lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), "|")
_BY_TYPE = "string_agg(type_high || ':' || n, '|' order by n desc, type_high)"
add("agg_06_dashboard", "f_line f_hashes f_locations f_pending", lambda f, h, w, p: stats.dashboard(f, counted(h), w, p).withColumn("types", _SHOWN(F.col("types"))),
    f"select (select count(*) from f_locations) as locations, (select {_BY_TYPE} from (select type_high, count(*) as n from f_line where stale = 0 group by 1)) as types, cast(sum(file_count) as bigint) as files, cast(sum(total_size) as bigint) as bytes, cast(sum(duplicate_count) as bigint) as duplicates, (select count(*) from f_pending where status = 'pending') as pending from ({_DIRECT})")
add("agg_06_recent_scans", "f_scans f_locations", lambda v, w: stats.recent_scans(v, w.withColumn("name", F.when(F.col("location_id") == 2, "__deleting_x").otherwise(F.col("name")))).select("scan_id", "location_name", "status", "started_at", "completed_at"),
    "select scan_id, name as location_name, status, started_at, completed_at from f_scans join f_locations using (location_id) where location_id <> 2 order by started_at desc, scan_id desc limit 5")
_PLANNED = lambda w: w.withColumns({"schedule_days": F.when(F.col("location_id") < 4, F.concat(F.col("location_id").cast("string"), F.lit(", 6,,x"))), "schedule_time": F.when(F.col("location_id") == 1, "22:15"), "schedule_enabled": F.col("location_id") % 2})
add("agg_07_location_detail", "f_line f_folders f_hashes f_locations", lambda f, o, h, w: stats.location_detail(f, o, counted(h), _PLANNED(w)).withColumns({"types": _SHOWN(F.col("types")), "schedule_days": F.array_join("schedule_days", ",")}),
    f"select l.location_id, l.name, (select {_BY_TYPE} from (select type_high, count(*) as n from f_line f where stale = 0 and f.location_id = l.location_id group by 1)) as types, case when l.location_id < 4 then l.location_id || ',6' else '' end as schedule_days, case when l.location_id = 1 then '22:15' else '03:00' end as schedule_time, l.location_id % 2 = 1 as schedule_enabled, cast(sum(file_count) as bigint) as file_count, cast(sum(total_size) as bigint) as total_size, cast(sum(hidden_count) as bigint) as hidden_count, cast(sum(duplicate_count) as bigint) as duplicate_count, (select count(*) from f_folders o where o.location_id = l.location_id) as folder_count, (select count(*) from f_line f where f.location_id = l.location_id and stale = 1) as stale_count from f_locations l join ({_DIRECT}) d using (location_id) group by 1, 2")
add("agg_08_folder_detail", "f_line f_folders f_hashes", lambda f, o, h: stats.folder_detail(f, o, counted(h)).withColumn("breadcrumb", F.array_join(F.transform("breadcrumb", lambda x: F.concat(x["name"], F.lit("="), x["path"])), "|")),
    f"select t.*, (select string_agg(regexp_extract(x.rel_path, '[^/]*$') || '=' || x.rel_path, '|' order by length(x.rel_path)) from f_folders x where x.location_id = t.location_id and (x.rel_path = t.rel_path or starts_with(t.rel_path, x.rel_path || '/'))) as breadcrumb, (select count(*) from f_folders x where x.location_id = t.location_id and starts_with(x.rel_path, t.rel_path || '/')) as subfolder_count, (select count(*) from f_line f where f.stale = 1 and f.location_id = t.location_id and starts_with(f.rel_path, t.rel_path || '/')) as stale_count from ({_FSTATS}) t")
add("agg_09_types", "f_line", stats.type_breakdown, "select type_high, count(*) as n from f_line where stale = 0 group by 1")
add("agg_10_pending", "f_pending", stats.pending_ops_count, "select status, count(*) as n from f_pending group by 1")
add("agg_11_missing_stats", "f_locations f_line", lambda w, f: stats.missing_stats(w, f.where("location_id < 4")), "select location_id, name from f_locations where location_id >= 4")
_DIFF = """select coalesce(c.location_id, n.location_id) as location_id, coalesce(c.rel_path, n.rel_path) as rel_path, c.file_id, case when c.rel_path is null then 'new' when n.rel_path is not null and stale = 1 then case when c.file_size <> n.file_size or c.modified_at <> n.modified_at then 'recovered_changed' else 'recovered' end
    when n.rel_path is not null then case when c.file_size <> n.file_size or c.modified_at <> n.modified_at then 'changed' else 'unchanged' end when stale = 0 then 'gone' end as change, c.file_size as old_size, n.file_size as new_size from f_line c full join f_listing n on c.location_id = n.location_id and c.rel_path = n.rel_path"""
_DIRS = lambda df, mark: df.select("location_id", "rel_dir").distinct().withColumn(mark, F.lit(1))
_NEW_DIRS = lambda c, n: _DIRS(c.where("stale = 0"), "c").join(_DIRS(n, "n"), ["location_id", "rel_dir"], "full_outer").where("c is null or n is null").select("location_id", F.when(F.col("c").isNull(), "new").otherwise("gone").alias("change"))
add("agg_12_scan_summary", "f_line f_listing", lambda c, n: stats.scan_summary(diff.diff(c, n), _NEW_DIRS(c, n)),
    f"""with d as (select location_id, change, count(*) as n from ({_DIFF}) where change is not null group by 1, 2),
    o as (select coalesce(a.location_id, b.location_id) as location_id, case when a.rel_dir is null then 'new' else 'gone' end as change, count(*) as folder_n
      from (select distinct location_id, rel_dir from f_line where stale = 0) a full join (select distinct location_id, rel_dir from f_listing) b on a.location_id = b.location_id and a.rel_dir = b.rel_dir where a.rel_dir is null or b.rel_dir is null group by 1, 2)
    select location_id, change, coalesce(n, 0) as n, coalesce(folder_n, 0) as folder_n from d full join o using (location_id, change)""")
add("agg_13_selection", "f_line f_folders f_hashes", lambda f, o, h: stats.selection_summary(f, here(f), fstats(f, o, h), o.where("rel_path like '%5'")),
    f"select (select count(*) from f_line where location_id = {HERE}) as files, count(*) as folders, cast(sum(total_size) + (select sum(file_size) from f_line where location_id = {HERE}) as bigint) as bytes from ({_FSTATS}) where rel_path like '%5'")

# --- folder tree ---
add("tree_01_build_folders", "f_line", lambda v: tree.build_folders(v), "select location_id, rel_path, regexp_extract(rel_path, '[^/]*$') as name, case when rel_path like '%/%' then regexp_replace(rel_path, '/[^/]*$', '') else '' end as parent_path, len(string_split(rel_path, '/'))::int as depth, (rel_path like '.%')::int as hidden, 0 as dup_exclude from f_folders where rel_path <> 'empty'")
add("tree_02_descendants", "f_folders", lambda v: tree.descendants(v, HERE, DIR), f"select location_id, rel_path from f_folders where location_id = {HERE} and (rel_path = '{DIR}' or starts_with(rel_path, '{DIR}/'))")
add("tree_03_breadcrumb", "f_folders f_locations", lambda o, w: tree.breadcrumb(o, w, o.where("rel_path like '%/1995'")),
    "with t as (select location_id, rel_path from f_folders where rel_path like '%/1995') select t.location_id, t.rel_path, 0 as level, name, '' as path from t join f_locations using (location_id) union all select t.location_id, t.rel_path, len(string_split(a.rel_path, '/'))::int, regexp_extract(a.rel_path, '[^/]*$'), a.rel_path from t join f_folders a on a.location_id = t.location_id and (a.rel_path = t.rel_path or starts_with(t.rel_path, a.rel_path || '/'))")
_KIDS = f"select o.location_id, case when o.rel_path like '%/%' then regexp_replace(o.rel_path, '/[^/]*$', '') else '' end as parent_path, o.rel_path, regexp_extract(o.rel_path, '[^/]*$') as name, exists (select 1 from f_folders k where k.location_id = o.location_id and starts_with(k.rel_path, o.rel_path || '/')) as has_children, o.total_size from ({_FSTATS}) o"
add("tree_04_children", "f_line f_folders f_hashes", lambda f, o, h: tree.children(o, o.where("rel_path like '%5'"), fstats(f, o, h)), f"select * from ({_KIDS}) where parent_path like '%5'")
add("tree_05_shallow", "f_locations f_folders", lambda w, o: tree.shallow_tree(w, o).select("location_id", "name", F.array_join("roots", "|").alias("roots")), "select location_id, name, string_agg(rel_path, '|' order by rel_path) as roots from f_locations join f_folders using (location_id) where rel_path not like '%/%' group by 1, 2")
add("tree_06_expand", "f_line f_folders f_hashes", lambda f, o, h: tree.expand_path(o, HERE, DIR, fstats(f, o, h)), f"select * from ({_KIDS}) where location_id = {HERE} and parent_path in ('', '{DIR}')")
_MAP = f"""select 'folder' as kind, name, total_size as size, (select count(*) from f_line f where f.stale = 0 and f.location_id = k.location_id and f.rel_dir = k.rel_path) as files from ({_KIDS}) k where location_id = {HERE} and parent_path = '{DIR}'
    union all select * from (select 'file', filename, file_size, 1 from f_line where stale = 0 and location_id = {HERE} and rel_dir = '{DIR}' order by file_size desc, file_id limit 50)"""
add("tree_07_treemap", "f_line f_folders f_hashes", lambda f, o, h: tree.treemap(f, o, fstats(f, o, h), HERE, DIR), _MAP)
add("tree_07_totals", "f_line f_folders f_hashes", lambda f, o, h: tree.treemap_totals(f, o, fstats(f, o, h), HERE, _LEAF.rpartition("/")[0]),
    f"""with a as (select count(*) as folders, coalesce(sum(total_size), 0) as s from ({_FSTATS}) where location_id = {HERE} and regexp_matches(rel_path, '^{_LEAF.rpartition("/")[0]}/[^/]*$')), b as (select count(*) as n, coalesce(sum(file_size), 0) as s from f_line where stale = 0 and location_id = {HERE} and rel_dir = '{_LEAF.rpartition("/")[0]}')
    select folders, cast(a.s as bigint) as folder_size, n as direct_files, cast(b.s as bigint) as direct_size, cast(a.s + b.s as bigint) as total_size from a, b""")  # fmt: skip
add("tree_08_treemap_items", "f_line f_folders f_hashes", lambda f, o, h: tree.treemap_items(tree.treemap(f, o, fstats(f, o, h), HERE, _LEAF)),
    f"""with t as (select 'file' as kind, filename as name, file_size as size from f_line where stale = 0 and location_id = {HERE} and rel_dir = '{_LEAF}' order by file_size desc, file_id limit 50), s as (select *, size >= (select sum(size) from t) * 0.01 as big from t where size > 0)
    select kind, name, size from s where big union all select 'other', printf('[%d other files]', count(*)), cast(sum(size) as bigint) from s where not big having count(*) > 0""")  # fmt: skip
_ADJACENT = "select xxhash64(location_id, rel_path) as id, case when rel_path like '%/%' then xxhash64(location_id, regexp_replace(rel_path, '/[^/]*$', '')) end as parent_id, substring_index(rel_path, '/', -1) as name from {o}"
add("tree_09_materialise", "f_folders", lambda o: tree.materialise_paths(o.sparkSession.sql(_ADJACENT, o=o)).select("rel_path", "depth"), "select rel_path, len(string_split(rel_path, '/'))::int as depth from f_folders")
add("tree_10_list_folder", "f_line f_folders", lambda f, o: tree.list_folder(f, o, HERE, _LEAF, "f_"), f"select 'file' as kind, filename as name, file_size as size from f_line where location_id = {HERE} and rel_dir = '{_LEAF}' and filename ilike '%f\\_%' escape '\\' order by lower(filename), file_id limit 120")
add("tree_10_list_sorted", "f_line f_folders f_hashes", lambda f, o, h: tree.list_folder(f, o, HERE, _LEAF, by="size", descending=True, hashes=h),
    f"""with s as (select hash_strong as h, count(*) - 1 as c from f_hashes where {ACT} and hash_strong is not null group by 1), q as (select hash_fast as h, count(*) - 1 as c from f_hashes where {ACT} and hash_fast is not null group by 1)
    select 'file' as kind, f.filename as name, f.file_size as size, f.file_id, coalesce(case when hs.hash_strong is not null then s.c else q.c end, 0) as dup_count from (select * from f_line where location_id = {HERE} and rel_dir = '{_LEAF}' order by file_size desc, file_id limit 120) f join f_hashes hs on hs.file_id = f.file_id left join s on s.h = hs.hash_strong left join q on q.h = hs.hash_fast""")  # fmt: skip
add("tree_11_favourites", "f_locations f_folders", lambda w, o: tree.favourites(w.withColumn("is_favourite", (F.col("location_id") % 2).cast("int")), o.withColumn("is_favourite", F.col("rel_path").endswith("/1995").cast("int"))),
    "select 'location' as kind, location_id, name as label from f_locations where location_id % 2 = 1 union all select 'folder', location_id, concat(name, ' / ', replace(rel_path, '/', ' / ')) from f_folders join f_locations using (location_id) where rel_path like '%/1995'")
add("tree_12_nested", "f_locations f_folders", tree.nested_tree, "select location_id, '' as sort_key, name, 0 as depth from f_locations union all select location_id, lower(rel_path), regexp_extract(rel_path, '[^/]*$'), len(string_split(rel_path, '/'))::int from f_folders")
add("tree_13_manifest", "f_line f_folders f_locations", lambda f, o, w: tree.download_manifest(f, o.where("rel_path like '%/1995'"), w),
    "select concat(root_path, '/', f.rel_path) as full_path, concat('1995/', f.filename) as archive_name, f.location_id from f_line f join f_locations l on l.location_id = f.location_id where f.stale = 0 and f.rel_dir like '%/1995'")

# --- snapshot diff ---
def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


add("dif_01_new", "f_line f_listing", lambda c, n: diff.new_files(c, n).select("location_id", "rel_path"), f"select location_id, rel_path from ({_DIFF}) where change = 'new'")
add("dif_02_changed", "f_line f_listing", lambda c, n: diff.changed_files(c, n).select("file_id", "file_size"), f"select file_id, new_size as file_size from ({_DIFF}) where change = 'changed'")
add("dif_03_gone", "f_line f_listing", lambda c, n: diff.gone_files(c, n, DIR).select("file_id"), f"select file_id from ({_DIFF}) where change = 'gone' and starts_with(rel_path, '{DIR}/')")
add("dif_04_recovered", "f_line f_listing", lambda c, n: diff.recovered_files(c, n).select("file_id", "recovered_changed"), f"select file_id, change = 'recovered_changed' as recovered_changed from ({_DIFF}) where change like 'recovered%'")
add("dif_05_diff", "f_line f_listing", lambda c, n: diff.diff(c, n).select("location_id", "rel_path", "file_id", "change", "old_size", "new_size"), f"select * from ({_DIFF}) where change is not null")
_PATH = "regexp_replace(rel_path, '/[^/]*$', '') as rel_dir, (rel_path like '.%' or rel_path like '%/.%')::int as hidden"
add("dif_06_apply_catalog", "f_line f_hashes f_listing", lambda c, h, n: diff.apply_diff(c, h, diff.diff(c, n))[0].select("location_id", "rel_path", "rel_dir", "hidden", "type_high", "file_size", "stale"),
    f"""with n as (select location_id, rel_path, {_PATH}, case when change in ('new', 'changed', 'recovered', 'recovered_changed') then new_size else old_size end as file_size, case when change = 'gone' or change is null then 1 else 0 end as stale, regexp_extract(rel_path, '[^/]*$') as filename from ({_DIFF})),
    e as (select *, case when filename like '%.%' then lower(regexp_extract(filename, '[^.]*$')) else '' end as e from n) select location_id, rel_path, rel_dir, hidden, {_HIGH} as type_high, file_size, stale from e""")  # fmt: skip
_OLD_ID = lambda h, rows: rows.join(h.select("file_id", F.col("file_id").alias("known_id")), "file_id", "left").drop("file_id")
add("dif_06_apply_hashes", "f_line f_hashes f_listing", lambda c, h, n: _OLD_ID(h, diff.apply_diff(c, h, diff.diff(c, n))[1].select("file_id", "location_id", "hash_fast", "stale", "file_size", "excluded")),
    f"""with d as ({_DIFF}) select h.file_id as known_id, h.location_id, case when change in ('changed', 'recovered_changed') then null else h.hash_fast end as hash_fast, case when change = 'gone' then 1 when change like 'recovered%' then 0 else h.stale end as stale, case when change in ('changed', 'recovered_changed') then new_size else h.file_size end as file_size, h.excluded from f_hashes h left join d using (file_id)
    union all select null, location_id, null, 0, new_size, 0 from d where change = 'new'""")  # fmt: skip
add("dif_06_affected", "f_line f_listing", lambda c, n: _OLD_ID(c, diff.affected_ids(diff.diff(c, n))), f"select file_id as known_id from ({_DIFF}) where change is not null and change <> 'unchanged'")
add("dif_06_typed_deltas", "f_line f_listing", lambda c, n: diff.stat_deltas(diff.diff(c, n), types=True),
    f"""with d as (select *, {_PATH}, regexp_extract(rel_path, '[^/]*$') as filename, case when change in ('new', 'recovered', 'recovered_changed') then 1 when change = 'gone' then -1 else 0 end as s, case when change = 'gone' then -old_size when change = 'changed' then new_size - old_size else new_size end as b from ({_DIFF}) where change is not null and change <> 'unchanged'),
    e as (select *, case when filename like '%.%' then lower(regexp_extract(filename, '[^.]*$')) else '' end as e from d)
    select location_id, rel_dir, {_HIGH} as type_high, cast(sum(s) as bigint) as file_count, cast(sum(b) as bigint) as total_size, cast(sum(s * hidden) as bigint) as hidden_count, cast(0 as bigint) as duplicate_count from e group by 1, 2, 3""")  # fmt: skip
add("dif_06_deltas", "f_line f_listing", lambda c, n: diff.stat_deltas(diff.diff(c, n)),
    f"select location_id, regexp_replace(rel_path, '/[^/]*$', '') as rel_dir, cast(sum(case when change in ('new', 'recovered', 'recovered_changed') then 1 when change = 'gone' then -1 else 0 end) as bigint) as file_count, cast(sum(case when change = 'gone' then -old_size when change = 'changed' then new_size - old_size else new_size end) as bigint) as total_size from ({_DIFF}) where change is not null and change <> 'unchanged' group by 1, 2")
add("dif_07_first_scan", "f_listing", lambda n: diff.first_scan(n).select("location_id", "rel_path", "rel_dir", "hidden", "file_size", "type_high", "type_low", "stale"),
    f"select location_id, rel_path, {_PATH}, file_size, {_HIGH} as type_high, case when {_KNOWN} then {_LOW} when filename like '.%' then 'dotfile' when e = '' then 'unknown' else e end as type_low, 0 as stale from {_CLASS.replace('f_line', 'f_listing')}")
add("dif_08_mark_unseen", "f_line", lambda v: diff.mark_unseen(v, 1).select("file_id", "stale"), "select file_id, case when scan_id <> 1 and stale = 0 then 1 else stale end as stale from f_line")
add("dif_09_stale_folders", "f_folders", lambda o: diff.stale_folders(o.withColumn("stale", F.col("rel_path").endswith("6").cast("int")), o.where("rel_path not like '%7'")), "select location_id, rel_path, case when rel_path like '%7' then 1 else 0 end as stale, case when rel_path like '%7' then 1 else 0 end as newly_stale from f_folders")
add("dif_10_quick", "f_line f_listing", lambda c, n: diff.quick_diff(c, n, HERE, _LEAF), f"select regexp_extract(rel_path, '[^/]*$') as filename, case change when 'gone' then 'missing' when 'recovered_changed' then 'recovered' else change end as change from ({_DIFF}) where location_id = {HERE} and rel_path like '{_LEAF.replace('_', '~_')}/%' escape '~' and change in ('new', 'gone', 'recovered', 'recovered_changed')")
_AGED = lambda o: o.withColumn("stale", F.col("rel_path").endswith("3").cast("int"))
_SEEN_FOLDERS = lambda o: o.where("rel_path not like '%7'").select("location_id", "rel_path").unionByName(o.select("location_id", F.concat("rel_path", F.lit("_new")).alias("rel_path")))
add("dif_10_folders", "f_folders", lambda o: diff.quick_diff_folders(_AGED(o), _SEEN_FOLDERS(o), HERE, DIR),
    f"""with o as (select *, rel_path like '%3' as old from f_folders where {_IN_DIR} and rel_path not like '{DIR.replace('_', '~_')}/%/%' escape '~')
    select rel_path, regexp_extract(rel_path, '[^/]*$') as name, case when rel_path like '%7' and not old then 'missing' else 'recovered' end as change from o where (rel_path like '%7') <> old
    union all select rel_path || '_new', regexp_extract(rel_path, '[^/]*$') || '_new', 'new' from o""")  # fmt: skip
_GONE_FOLDERS = lambda o: o.where("rel_path like '%5'").select("location_id", "rel_path")
add("dif_10_subtrees", "f_line f_folders", lambda f, o: diff.stale_subtrees(f, _AGED(o), _GONE_FOLDERS(o))[0].select("file_id", "stale"),
    "select file_id, case when exists (select 1 from f_folders o where o.rel_path like '%5' and o.location_id = f.location_id and starts_with(f.rel_path, o.rel_path || '/')) then 1 else stale end as stale from f_line f")
add("dif_10_subtree_folders", "f_line f_folders", lambda f, o: diff.stale_subtrees(f, _AGED(o), _GONE_FOLDERS(o))[1].select("location_id", "rel_path", "stale"),
    "select location_id, rel_path, case when exists (select 1 from f_folders o where o.rel_path like '%5' and o.location_id = f.location_id and (o.rel_path = f.rel_path or starts_with(f.rel_path, o.rel_path || '/'))) then 1 else (rel_path like '%3')::int end as stale from f_folders f")
add("dif_11_stale_subtree", "f_line", lambda v: diff.stale_subtree(v, HERE, DIR).select("file_id", "stale"), f"select file_id, case when {_IN_DIR} then 1 else stale end as stale from f_line")
_STALE_YEAR = lambda f, o: diff.purge_stale(f.withColumn("stale", F.when(F.col("rel_dir").endswith("1995"), 1).otherwise(F.col("stale"))), o.withColumn("stale", F.col("rel_path").rlike("(5|supplier_[0-9]*9)$").cast("int")), HERE)
add("dif_12_purge_files", "f_line f_folders", lambda f, o: _STALE_YEAR(f, o)[0].select("file_id"), f"select file_id from f_line where not (location_id = {HERE} and (stale = 1 or rel_dir like '%1995'))")
add("dif_12_purge_folders", "f_line f_folders", lambda f, o: _STALE_YEAR(f, o)[1].select("location_id", "rel_path"),
    f"""with o as (select *, regexp_matches(rel_path, '(5|supplier_[0-9]*9)$') as gone from f_folders), f as (select * from f_line where not (location_id = {HERE} and (stale = 1 or rel_dir like '%1995')))
    select location_id, rel_path from o where not (location_id = {HERE} and gone and not exists (select 1 from f where f.location_id = o.location_id and starts_with(f.rel_path, o.rel_path || '/')) and not exists (select 1 from o k where k.location_id = o.location_id and not k.gone and starts_with(k.rel_path, o.rel_path || '/')))""")  # fmt: skip
add("dif_13_touch_seen", "f_line", lambda v: diff.touch_seen(v, 99, "2024-01-01 00:00:00", HERE).select("file_id", "scan_id"), f"select file_id, case when location_id = {HERE} and stale = 0 then 99 else scan_id end as scan_id from f_line")
add("dif_14_reclassify", "f_line", lambda v: diff.reclassify(v.withColumn("type_high", F.when(F.col("file_id") % 5 == 0, "other").otherwise(F.col("type_high")))), f"select file_id, 'other' as old_type, {_HIGH} as new_type from {_CLASS} where file_id % 5 = 0 and {_HIGH} <> 'other'")
add("dif_15_freshness", "f_line", lambda v: diff.freshness(v, v.where("location_id < 4").select("file_id", (F.col("file_id") % 6 == 0).alias("found"), (F.col("file_size") + F.col("file_id") % 4).alias("size"))),
    "select * from (select file_id, case when file_id % 6 <> 0 and stale = 0 then 'stale' when file_id % 6 = 0 and stale = 1 then 'clear' when file_id % 6 = 0 and file_id % 4 <> 0 then 'update' end as action from f_line where location_id < 4) where action is not null")
add("dif_16_invalid_names", "f_docs", lambda d: diff.invalid_names(d.select("file_id", F.expr(_BYTES).alias("path_bytes"))).select("file_id"), "select file_id from f_docs where content is not null and file_id % 3 <> 0")
add("dif_17_purge_everywhere", "f_line f_hashes f_folders f_tags f_scans f_ignore", lambda f, h, o, t, s, i: _sizes(diff.purge_everywhere({"files": f, "hashes": h, "folders": o, "tags": t, "scans": s, "rules": i}, HERE)),
    f"select 'files' as name, count(*) as n from f_line where location_id <> {HERE} union all select 'hashes', count(*) from f_hashes where location_id <> {HERE} union all select 'folders', count(*) from f_folders where location_id <> {HERE} union all select 'tags', count(*) from f_tags where file_id not in (select file_id from f_line where location_id = {HERE}) union all select 'scans', count(*) from f_scans where location_id <> {HERE} union all select 'rules', count(*) from f_ignore where location_id is distinct from {HERE}")
add("dif_17_purge_location", "f_line f_hashes", lambda f, h: diff.purge_location(f, h, HERE)[1].select("file_id", "dup_count"), f"select file_id, n as dup_count from ({recount_sql(f'(select * from f_hashes where location_id <> {HERE})')})")

# --- plans and tags ---
add("plan_01_merge_source", "f_line", lambda v: actions.merge_source(v, HERE, DIR).select("file_id"), f"select file_id from f_line where {_IN_DIR} and stale = 0")
_HEFF = EFF.replace("hash_", "h.hash_")
_INDEX = f"select {_HEFF} as hash, min(file_id) as dest_file_id from f_hashes h join f_line f using (file_id) where f.location_id = 2 and f.stale = 0 and {_HEFF} is not null group by 1"
add("plan_02_dest_index", "f_line f_hashes", lambda f, h: actions.dest_hash_index(f, h, 2).select("hash", "dest_file_id"), _INDEX)
add("plan_03_merge", "f_line f_hashes", lambda f, h: actions.merge_plan(f, h, HERE, 2, "move"),
    f"""with s as (select f.file_id, f.rel_path, {_HEFF} as hash from f_line f join f_hashes h using (file_id) where f.location_id = {HERE} and f.stale = 0), k as (select *, first_value(file_id) over (partition by hash order by rel_path, file_id) as f0 from s),
    r as (select k.*, i.dest_file_id as d, k.hash is null or (i.dest_file_id is null and f0 = file_id) as u from k left join ({_INDEX}) i on i.hash = k.hash)
    select file_id, rel_path, hash, case when u then 'unique' else 'duplicate' end as action, coalesce(d, case when not u then f0 end) as dest_file_id, case when u then 'copied + stubbed' else 'duplicate + stubbed' end as result from r""")  # fmt: skip
add("plan_04_metadata", "f_line f_hashes f_tags", lambda f, h, t: actions.merged_metadata(f, h, t, every(h)).select("selected_id", F.array_join("tags", "|").alias("tags"), "description", "modified_at"),
    f"""with p as ({_PAIRS}), c as (select p.selected_id, f.* from p join f_line f on f.file_id = p.file_id where f.stale = 0)
    select selected_id, coalesce((select string_agg(distinct tag, '|' order by tag) from c x join f_tags t on t.file_id = x.file_id where x.selected_id = c.selected_id), '') as tags, arg_min(description, file_id) filter (where description is not null) as description, min(modified_at) as modified_at from c group by selected_id""")  # fmt: skip
_COPIES = f"with o as (select file_id, row_number() over (partition by {EFF} order by file_id * 7919 % 10007, file_id) as k, {EFF} as eff from f_hashes), m as ({_PAIRS}), own as (select file_id from o where eff is null or k = 1), c as (select selected_id, file_id from m where selected_id in (select file_id from own) union select file_id, file_id from own), r as (select c.selected_id, f.file_id, f.location_id, f.excluded, f.rel_dir, f.location_id in (select location_id from f_locations where online) as up from c join f_line f on f.file_id = c.file_id where f.stale = 0)"
add("plan_05_keep_here", "f_line f_hashes f_locations", lambda f, h, w: actions.consolidate_plan(f, h, _PICK(h), online(w)),
    f"{_COPIES} select selected_id, file_id, case when file_id = selected_id then 'canonical' when excluded = 1 then 'skipped' else 'stub' end as role, case when file_id = selected_id then 'kept' when excluded = 1 then 'skipped (excluded)' when up then 'stubbed' else 'queued' end as result from r")
add("plan_05_move_to", "f_line f_hashes f_locations", lambda f, h, w: actions.consolidate_plan(f, h, _PICK(h), online(w), "move_to", HERE, _LEAF),
    f"""{_COPIES}, b as (select selected_id, min(file_id) filter (where location_id = {HERE} and rel_dir = '{_LEAF}') as best from r group by 1)
    select r.selected_id, file_id, case when file_id = best then 'canonical' when excluded = 1 then 'skipped' else 'stub' end as role, case when file_id = best then 'kept' when excluded = 1 then 'skipped (excluded)' when up then 'stubbed' else 'queued' end as result from r join b using (selected_id)
    union all select selected_id, null, 'canonical', 'copied' from b where best is null""")  # fmt: skip
add("plan_06_copy", "f_line f_hashes f_locations", lambda f, h, w: actions.copy_plan(f, h, every(h), online(w)),
    f"""with c as (select selected_id, file_id from ({_PAIRS}) union select file_id, file_id from f_hashes), u as (select c.* from c join f_line f on f.file_id = c.file_id and f.stale = 0 where f.location_id in (select location_id from f_locations where online)),
    b as (select selected_id, arg_min(file_id, case when file_id = selected_id then -1 else file_id end) as source_id from u group by 1) select h.file_id as selected_id, source_id, case when source_id is null then 'error: no online copy' else 'copied' end as result from f_hashes h left join b on b.selected_id = h.file_id""")  # fmt: skip
_LOCAL = lambda f: f.select("file_id", "location_id", "rel_path", "rel_dir", "filename", "file_size", "modified_at", "description", "hidden", "type_high", "stale")


def _copied(f: DataFrame, h: DataFrame, t: DataFrame, w: DataFrame) -> DataFrame:
    """Copies of one location's files into a folder of another, with their metadata; names of the copies are settled by the plan."""
    rows, hashed, tagged = actions.copied_rows(actions.copy_plan(f, h, here(h), online(w)), _LOCAL(f), h, t, 3, "copies")
    words = tagged.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))
    both = rows.join(hashed.select("file_id", "hash_fast"), "file_id").join(words, "file_id", "left")
    return both.select("location_id", "rel_dir", "file_size", "hidden", "hash_fast", "description", "modified_at", F.coalesce("tags", F.lit("")).alias("tags"))


add("plan_06_copied_rows", "f_line f_hashes f_tags f_locations", _copied,
    f"""with s as (select file_id from f_hashes where location_id = {HERE}), p as (select p.* from ({_PAIRS}) p where selected_id in (select file_id from s)),
    live as (select p.selected_id, f.* from p join f_line f on f.file_id = p.file_id and f.stale = 0),
    c as (select selected_id, file_id from p union select file_id, file_id from s),
    ok as (select distinct c.selected_id from c join f_line f on f.file_id = c.file_id and f.stale = 0 where f.location_id in (select location_id from f_locations where online)),
    g as (select selected_id, arg_min(description, file_id) filter (where coalesce(description, '') <> '') as d, min(modified_at) as m from live group by 1),
    t as (select selected_id, string_agg(distinct tag, '|' order by tag) as tags from live join f_tags using (file_id) group by 1),
    o as (select file_id as selected_id, string_agg(tag, '|' order by tag) as tags from f_tags group by 1)
    select cast(3 as bigint) as location_id, 'copies' as rel_dir, f.file_size, (filename like '.%')::int as hidden, h.hash_fast, case when g.selected_id is null then f.description else d end as description, coalesce(m, f.modified_at) as modified_at, coalesce(case when g.selected_id is null then o.tags else t.tags end, '') as tags
    from ok join f_line f on f.file_id = ok.selected_id join f_hashes h on h.file_id = ok.selected_id left join g on g.selected_id = ok.selected_id left join t on t.selected_id = ok.selected_id left join o on o.selected_id = ok.selected_id""", once=("f_line",))  # fmt: skip
_STUB_PLAN = lambda f, w: f.join(w, "location_id").select("file_id", F.concat(F.lit("kept/"), "filename").alias("dest_path"), F.col("name").alias("dest_location"), F.col("agent_name").alias("dest_agent"))
add("plan_07_stub_rows", "f_line f_locations", lambda f, w: actions.stub_rows(_STUB_PLAN(f, w), f, "2024-01-01"),
    "select file_id, location_id, rel_path || '.moved' as rel_path, filename || '.moved' as filename, 'text' as type_high, 'moved' as type_low, cast(strlen(concat('Consolidated', chr(10), 'Original: ', filename, chr(10), 'Moved to: ', name, case when agent_name is null then '' else concat(' [', agent_name, ']') end, ': kept/', filename, chr(10), 'Date: 2024-01-01', chr(10))) as bigint) as file_size from f_line join f_locations using (location_id)")
# One file in three becomes a stub; another file stands at the place of every other stub.
_TAKEN = lambda f: f.unionByName(f.where("file_id % 6 = 0").withColumns({"file_id": -F.col("file_id"), "rel_path": F.concat("rel_path", F.lit(".moved")), "filename": F.concat("filename", F.lit(".moved"))}))
add("plan_07_apply_stubs", "f_line f_locations", lambda f, w: actions.apply_stubs(_TAKEN(_LOCAL(f)), actions.stub_rows(_STUB_PLAN(f.where("file_id % 3 = 0"), w), f, "2024-01-01")).select("file_id", "rel_path", "filename", "type_high", F.when(F.col("type_high") != "text", F.col("file_size")).alias("other_size")),
    """select file_id, case when file_id % 3 = 0 then rel_path || '.moved' else rel_path end as rel_path, case when file_id % 3 = 0 then filename || '.moved' else filename end as filename, case when file_id % 3 = 0 then 'text' else type_high end as type_high, case when file_id % 3 <> 0 and type_high <> 'text' then file_size end as other_size from f_line""")  # fmt: skip
_KEPT = lambda f: f.where("content_fast is not null").groupBy("content_fast").agg(F.min("location_id").alias("location_id")).select("location_id", F.concat(F.lit("kept/"), F.col("content_fast")).alias("rel_path"))
add("plan_08_catalog_rows", "f_line f_locations", lambda f, w: actions.sources_catalog_rows(_KEPT(f), actions.sources_rows(f.join(w, "location_id").select(F.concat(F.lit("kept/"), F.col("content_fast")).alias("canonical_path"), F.col("name").alias("location"), F.col("agent_name").alias("agent"), "rel_path").where("canonical_path is not null"))).select("location_id", "rel_path", "filename", "file_size", "type_low"),
    "select min(location_id) as location_id, 'kept/' || content_fast || '.sources' as rel_path, content_fast || '.sources' as filename, cast(sum(strlen(concat('- ', name, case when agent_name is null then '' else concat(' [', agent_name, ']') end, ': ', rel_path, chr(10)))) as bigint) as file_size, 'sources' as type_low from f_line join f_locations using (location_id) where content_fast is not null group by content_fast")
add("plan_08_sources_rows", "f_line f_locations", lambda f, w: actions.sources_rows(f.join(w, "location_id").select(F.concat(F.lit("kept/"), F.col("content_fast")).alias("canonical_path"), F.col("name").alias("location"), F.col("agent_name").alias("agent"), "rel_path").where("canonical_path is not null")),
    "select 'kept/' || content_fast as canonical_path, string_agg(concat('- ', name, case when agent_name is null then '' else concat(' [', agent_name, ']') end, ': ', rel_path, chr(10)), '' order by concat('- ', name, case when agent_name is null then '' else concat(' [', agent_name, ']') end, ': ', rel_path, chr(10))) as content from f_line join f_locations using (location_id) where content_fast is not null group by 1")
_CLAIMS = lambda f: f.select(F.col("file_id").alias("id"), F.concat(F.lit("d"), F.col("location_id")).alias("directory"), F.expr("concat(case when file_id % 2 = 0 then 'A' else 'a' end, file_id % 100, '.txt')").alias("filename"), "rel_path")
add("plan_09_resolve_names", "f_line", lambda f: actions.resolve_names(_CLAIMS(f), f.where("stale = 1").select(F.concat(F.lit("d"), F.col("location_id")).alias("directory"), F.expr("concat('A', file_id % 100, case when file_id % 62 = 0 then '_3' else '' end, '.TXT')").alias("filename"))).select("id", F.lower("final_name").alias("final_name")),
    """with c as (select file_id as id, 'd' || location_id as directory, concat('a', file_id % 100) as base, rel_path from f_line),
    t as (select distinct 'd' || location_id as directory, concat('a', file_id % 100) as base, case when file_id % 62 = 0 then 3 else 0 end as n from f_line where stale = 1),
    k as (select *, row_number() over (partition by directory, base order by rel_path, id) as k from c), g as (select directory, base, max(k) as m from k group by all),
    s as (select g.directory, g.base, x.n, row_number() over (partition by g.directory, g.base order by x.n) as k from g, lateral (select unnest(range(0, g.m + 2)) as n) x where not exists (select 1 from t where t.directory = g.directory and t.base = g.base and t.n = x.n))
    select id, concat(k.base, case when s.n = 0 then '' else '_' || s.n end, '.txt') as final_name from k join s using (directory, base, k)""")  # fmt: skip
add("plan_10_move_files", "f_line", lambda f: actions.move_files(f, every(f), HERE, _LEAF).select("file_id", "rel_path", "type_high", "stub", "clash"),
    f"select file_id, '{_LEAF}/' || filename as rel_path, type_high, not (location_id = {HERE} and rel_dir = '{_LEAF}') as stub, not (location_id = {HERE} and rel_dir = '{_LEAF}') and lower(filename) in (select lower(filename) from f_line where location_id = {HERE} and rel_dir = '{_LEAF}') as clash from f_line")
_UP = "(select location_id from f_locations where online)"
_DEST = f"{HERE} and rel_dir = '{_LEAF}'"
add("plan_10_move", "f_line f_locations", lambda f, w: actions.move_plan(f, every(f.where("location_id < 3")), HERE, _LEAF, online(w)).select("file_id", "rel_path", "state", "stub"),
    f"select file_id, '{_LEAF}/' || filename as rel_path, case when location_id in {_UP} then 'done' else 'deferred' end as state, location_id in {_UP} as stub from f_line where location_id < 3 and not (location_id = {_DEST})")
add("plan_10_copy", "f_line f_locations", lambda f, w: actions.move_plan(f, every(f.where("location_id > 2")), HERE, _LEAF, online(w), copy=True).select("file_id", "rel_path", "state", "stub"),
    f"select file_id, '{_LEAF}/' || filename as rel_path, case when location_id in {_UP} then 'done' else 'refused' end as state, false as stub from f_line where location_id > 2")
add("plan_10_rename", "f_line f_locations", lambda f, w: actions.move_plan(f, every(f), HERE, _LEAF, online(w), new_name="One.TXT").select("file_id", "filename", "type_high", "state"),
    f"select file_id, 'One.TXT' as filename, 'text' as type_high, case when location_id in {_UP} then 'done' else 'deferred' end as state from f_line")
add("plan_10_deltas", "f_line f_locations", lambda f, w: actions.move_deltas(f, actions.move_plan(f, every(f.where("location_id < 3")), HERE, _LEAF, online(w))),
    f"""with m as (select * from f_line where location_id < 3 and location_id in {_UP} and not (location_id = {_DEST}) and stale = 0)
    select cast({HERE} as bigint) as location_id, '{_LEAF}' as rel_dir, count(*) as file_count, cast(sum(file_size) as bigint) as total_size, count(*) filter (where filename like '.%') as hidden_count, cast(0 as bigint) as duplicate_count from m
    union all select location_id, rel_dir, -count(*), cast(-sum(file_size) as bigint), cast(-sum(hidden) as bigint), 0 from m group by 1, 2""")  # fmt: skip
add("plan_10_copy_rows", "f_line f_hashes f_tags f_locations", lambda f, h, t, w: actions.copy_rows(actions.move_plan(f, every(f.where("location_id = 3")), HERE, _LEAF, online(w), copy=True), f, h, t)[1].select("location_id", "file_size", "hash_partial", "hash_fast", "hash_strong"),
    f"select cast({HERE} as bigint) as location_id, file_size, hash_partial, hash_fast, hash_strong from f_hashes where location_id = 3")
add("plan_11_copy_folder", "f_line f_folders f_hashes f_tags", lambda f, o, h, t: actions.copy_rows(actions.move_folder(f, o, HERE, DIR, "nation_0/.old", dest_location=2).where("not refused"), f, h, t)[0].select("location_id", "rel_path", "hidden", "file_size"),
    f"select cast(2 as bigint) as location_id, 'nation_0/.old/' || rel_path as rel_path, 1 as hidden, file_size from f_line where {_IN_DIR}")
add("plan_11_move_folder", "f_line f_folders", lambda f, o: actions.move_folder(f, o, HERE, DIR, "nation_0/.old").drop("location_id"), f"select file_id, 'nation_0/.old/' || rel_path as rel_path, 1 as hidden, false as refused from f_line where {_IN_DIR}")
add("plan_12_delete", "f_line f_hashes f_locations", lambda f, h, w: actions.delete_plan(f, h, here(h), online(w), all_duplicates=True),
    f"select file_id, location_id, case when location_id in (select location_id from f_locations where online) then 'delete' else 'deferred' end as action from f_line where file_id in (select file_id from ({_PAIRS} where s.location_id = {HERE}) union select file_id from f_hashes where location_id = {HERE})")
add("plan_12_after_delete", "f_line f_hashes f_locations", lambda f, h, w: actions.after_delete(h, actions.delete_plan(f, h, every(h.where("location_id < 3")), online(w))).select("file_id", "dup_count"),
    f"select file_id, n as dup_count from ({recount_sql('(select * from f_hashes where not (location_id < 3 and location_id in (select location_id from f_locations where online)))')})")
add("plan_12_deltas", "f_line f_hashes f_locations", lambda f, h, w: actions.delete_deltas(f, actions.delete_plan(f, h, every(h.where("location_id < 3")), online(w))),
    "select location_id, rel_dir, -count(*) as file_count, cast(-sum(file_size) as bigint) as total_size, cast(-sum(hidden) as bigint) as hidden_count, cast(0 as bigint) as duplicate_count from f_line where location_id < 3 and stale = 0 and location_id in (select location_id from f_locations where online) group by 1, 2")
add("plan_13_delete_folder", "f_line f_folders", lambda f, o: actions.delete_folder(f, o, HERE, DIR)[0].select("file_id"), f"select file_id from f_line where not ({_IN_DIR})")
add("plan_13_deltas", "f_line f_hashes", lambda f, h: actions.delete_folder_effects(f, h, HERE, DIR)[0], f"select location_id, rel_dir, -count(*) as file_count, cast(-sum(file_size) as bigint) as total_size, cast(-sum(hidden) as bigint) as hidden_count, cast(0 as bigint) as duplicate_count from f_line where {_IN_DIR} and stale = 0 group by 1, 2")
add("plan_13_recount", "f_line f_hashes", lambda f, h: actions.delete_folder_effects(f, h, HERE, DIR)[1].select("file_id", "dup_count"), f"select file_id, n as dup_count from ({recount_sql(f'(select * from f_hashes where file_id not in (select file_id from f_line where {_IN_DIR}))')})")
add("plan_14_drain", "f_pending f_line f_locations", lambda p, f, w: actions.drain_pending(p, f.withColumn("pending_op", F.when(F.col("file_id") % 4 == 0, "click").otherwise("view")), online(w)),
    "select op_id, p.file_id, case when f.file_id is null or (case when f.file_id % 4 = 0 then 'click' else 'view' end) <> op_type then 'completed' when l.online then 'run' else 'wait' end as state from f_pending p left join f_line f on f.file_id = p.file_id left join f_locations l on l.location_id = f.location_id where status = 'pending'")
_MARKED = lambda f: f.withColumn("pending_op", F.when(F.col("file_id") % 4 == 0, "click").otherwise("view"))
_RAN = lambda p: p.where("op_id % 3 < 2 or op_id % 5 = 0").select("op_id", F.when(F.col("op_id") % 5 == 0, F.concat(F.lit("no access to "), F.col("op_id").cast("string"))).alias("error"))
add("plan_14_outcomes", "f_pending f_line f_locations", lambda p, f, w: actions.record_outcomes(p, actions.drain_pending(p, _MARKED(f), online(w)), _RAN(p), "2024-01-01").select("op_id", "status", "error", F.col("completed_at").isNotNull().alias("closed")),
    """with d as (select op_id, case when f.file_id is null or (case when f.file_id % 4 = 0 then 'click' else 'view' end) <> op_type then 'completed' when l.online then 'run' else 'wait' end as state from f_pending p left join f_line f on f.file_id = p.file_id left join f_locations l on l.location_id = f.location_id where status = 'pending'),
    s as (select p.*, state, (op_id % 3 < 2 or op_id % 5 = 0) as told, op_id % 5 = 0 as bad from f_pending p left join d using (op_id))
    select op_id, case when state = 'run' and told and bad then 'failed' when state = 'completed' or (state = 'run' and told) then 'completed' else status end as status, case when state = 'run' and told and bad then 'no access to ' || op_id end as error, coalesce(state = 'completed' or (state = 'run' and told), false) as closed from s""")  # fmt: skip
add("plan_15_cancel", "f_pending", lambda p: actions.cancel_pending(p, p.where("op_id % 2 = 0")).select("op_id"), "select op_id from f_pending where op_id % 2 <> 0")
add("plan_15_clear_marks", "f_pending f_line", lambda p, f: actions.clear_marks(f.withColumn("pending_op", F.when(F.col("file_id") % 4 == 0, "click").otherwise("view")), p, p.where("status = 'pending'")).select("file_id", "pending_op"),
    "select file_id, case when exists (select 1 from f_pending p where p.status = 'pending' and p.file_id = f.file_id and p.op_type = m) then null else m end as pending_op from (select *, case when file_id % 4 = 0 then 'click' else 'view' end as m from f_line) f")
add("tag_01_file_tags", "f_tags", lambda t: tags.file_tags(t, every(t)).select("file_id", F.array_join("tags", "|").alias("tags")), "select file_id, string_agg(tag, '|' order by tag) as tags from f_tags group by 1")
add("tag_01_all_tags", "f_tags", tags.all_tags, "select distinct tag from f_tags")
add("tag_02_add", "f_tags f_hashes", lambda t, h: tags.add_tags(t, h, here(h), ["red", "promo"]), f"with e as (select file_id from ({_PAIRS} where s.location_id = {HERE}) union select file_id from f_hashes where location_id = {HERE}) select file_id, tag from f_tags union select file_id, 'red' from e union select file_id, 'promo' from e")
add("tag_03_remove", "f_tags", lambda t: tags.remove_tags(t, every(t), ["promo", "brand#3"]), "select file_id, tag from f_tags where tag not in ('promo', 'brand#3')")
add("tag_04_set", "f_tags f_hashes", lambda t, h: tags.set_tags(t, h, 20250, ["medium", "new"]),
    f"with g as (select x as tag from (values ('medium'), ('new')) v(x) where x not in (select tag from f_tags where file_id = 20250)), e as (select file_id from ({_PAIRS} where s.file_id = 20250) union select file_id from f_hashes where file_id = 20250) select file_id, tag from f_tags where file_id <> 20250 or tag in ('medium', 'new') union select e.file_id, g.tag from e, g")
add("tag_04_propagated", "f_tags f_hashes", lambda t, h: tags.propagated(t, h, 20250, ["medium", "new"]),
    f"with g as (select x as tag from (values ('medium'), ('new')) v(x) where x not in (select tag from f_tags where file_id = 20250)) select count(distinct p.file_id) as propagated from ({_PAIRS}) p, g where p.selected_id = 20250 and p.file_id <> 20250 and not exists (select 1 from f_tags t where t.file_id = p.file_id and t.tag = g.tag)")
add("tag_05_copy", "f_tags f_line", lambda t, f: tags.copy_tags(t, 684, here(f)), f"select file_id, tag from f_tags union select f.file_id, t.tag from f_line f, f_tags t where f.location_id = {HERE} and t.file_id = 684")
add("tag_06_intern", "f_tags", lambda t: tags.intern_tags(t.where("tag like 'b%'").select("tag").distinct().withColumn("tag_id", F.length("tag").cast("long")), t),
    "with v as (select distinct tag, length(tag) as tag_id from f_tags where tag like 'b%'), n as (select distinct tag from f_tags where tag not like 'b%') select tag_id, tag from v union all select (select max(tag_id) from v) + row_number() over (order by tag), tag from n")
add("rep_01_repair", "f_line f_folders f_hashes0", lambda f, o, h: repair(f, o, h.withColumn("hash_partial", F.when(F.col("file_id") % 6 != 0, F.col("hash_partial"))), f.select("file_id", "hash_partial"), f.select("file_id", F.col("content_fast").alias("content_hash")))[0].where("stale = 0").select("file_id", "dup_count"),
    f"select file_id, n as dup_count from ({recount_sql(_FUNNEL)}) where stale = 0")


# --- streams, most of several micro-batches, held against what the whole input gives ---
def in_turns(parts: list[DataFrame], start: Callable[[DataFrame, str], Any]) -> None:
    """Runs start(stream, checkpoint) after each part has arrived."""
    spark, folder, checkpoint = parts[0].sparkSession, shared_folder(parts[0].sparkSession), shared_folder(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(part.schema).parquet(folder), checkpoint).awaitTermination()


def _ingested(c: DataFrame, n: DataFrame) -> DataFrame:
    """Two arrivals, which name some files twice within and some across them, the second one compacted."""
    spark, folder, rows = c.sparkSession, shared_folder(c.sparkSession), _TWICE(n)
    publish(spark, folder, {"files": c.select(*_CATALOG)}, {"files": stream.FILES})
    first = (F.col("location_id") < 3) | ((F.col("location_id") == 3) & (F.col("seq") == 1))
    in_turns([rows.where(first), rows.where(~first)], lambda s, at: stream.stream_ingest(s, folder, at, order="seq", compact_every=2))
    return _KNOWN_ID(c, stream.newest(spark, folder))


def _counted_up(f: DataFrame) -> DataFrame:
    spark, folder = f.sparkSession, shared_folder(f.sparkSession)
    deltas = f.where("stale = 0").select("location_id", "rel_dir", "inode", F.lit(1).cast("long").alias("file_count"), F.col("file_size").alias("total_size"))
    in_turns([deltas.where("inode < 500000"), deltas.where("inode >= 500000")], lambda s, at: stream.stream_stats(s, folder, at))
    return stream.counters(spark, folder)


def _bursts(h: DataFrame) -> DataFrame:
    """Every changed hash is reported twice, five minutes apart; an event an hour later ends the bursts."""
    spark, folder = h.sparkSession, shared_folder(h.sparkSession)
    publish(spark, folder, {"hashes": h}, {"hashes": stream.HASHES})
    h = snapshot(spark, folder).table("hashes")  # the version's own rows: hashes are not made again for each turn
    changed = written(_CHANGED(h).distinct())
    at = lambda rows, clock: rows.withColumn("at", F.lit(f"2024-01-01 {clock}").cast("timestamp"))
    turns = [at(changed, "00:00:00"), at(changed, "00:05:00"), at(h.agg(F.lit("end").alias("hash")), "01:00:00")]
    in_turns(turns, lambda s, to: stream.stream_dup_recount(s, folder, to, late="0 seconds"))
    return snapshot(spark, folder).table("flips").select("file_id", "old_count", "new_count", "delta")


_CAP = 1 << 28


def _drained_queue(f: DataFrame, h: DataFrame) -> DataFrame:
    """Three arrivals in inode order, then the rest is closed; no hash is known before."""
    spark, folder = f.sparkSession, shared_folder(f.sparkSession)
    work, none = f.select("location_id", "file_id", "inode", "file_size"), F.lit(None).cast("string")
    publish(spark, folder, {"hashes": h.withColumns({"hash_fast": none, "hash_strong": none, "dup_count": F.lit(0).cast("long")})}, {"hashes": stream.HASHES})
    hasher = lambda rows: rows.join(f.select("file_id", F.col("content_fast").alias("hash_fast")), "file_id")
    in_turns([work.where("inode < 300000"), work.where("inode >= 300000 and inode < 310000"), work.where("inode >= 310000")], lambda s, at: stream.stream_hash_queue(s, folder, at, hasher, _CAP))
    stream.close_queue(spark, folder, _CAP, hasher)
    done = snapshot(spark, folder)
    return done.table("queue_closed").select("file_id", "batch").join(done.table("hashes").select("file_id", "dup_count"), "file_id")


def _arrived(f: DataFrame, h: DataFrame) -> DataFrame:
    """Two arrivals; the last word on each file."""
    spark, out = f.sparkSession, shared_folder(f.sparkSession)
    first, second = _ARRIVALS(f.where("inode < 500000")), _ARRIVALS(f.where("inode >= 500000"))
    in_turns([first, second], lambda s, at: stream.stream_arrivals(s, h.where("location_id <> 1")).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start())
    rows = spark.read.schema("arrival_id long, match_id long, to_hash boolean").parquet(out)
    return rows.groupBy("arrival_id").agg(F.max("match_id").alias("match_id"), F.max("to_hash").alias("to_hash"))


add("str_01_listing", "f_listing_tsv", lambda v: drained(stream.stream_listing(v.sparkSession, stored(v.select("value"), lambda w, f: w.text(f)))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")),
    """with p as (select string_split(value, chr(9)) as x from f_listing_tsv) select x[1] as kind, count(*) as n, cast(sum(case when x[1]='F' then cast(x[3] as bigint) end) as bigint) as bytes from p where (x[1]='F' and len(x)>=6) or (x[1]='D' and len(x)>=2) or (x[1]='H' and len(x)>=3) group by 1""")  # fmt: skip
add("str_02_ingest", "f_line f_listing", _ingested, _UPSERTED, once=("f_listing",))
add("str_03_stats", "f_line", _counted_up,
    "select o.location_id, o.rel_path, count(*) as file_count, cast(sum(f.file_size) as bigint) as total_size from (select location_id, rel_path from f_folders union all select location_id, '' from f_locations) o join f_line f on f.location_id = o.location_id and f.stale = 0 and (o.rel_path = '' or starts_with(f.rel_path, o.rel_path || '/')) group by 1, 2")
add("str_04_dup_recount", "f_hashes", _bursts, ORACLES["dup_09_recount_hashes"][len(duck_views("f_hashes")):].lstrip().replace(", r as", "with r as", 1))
add("str_05_hash_queue", "f_line f_hashes0", _drained_queue,
    f"""with q as (select file_id, cast(floor(coalesce(sum(file_size) over (partition by location_id order by inode, file_id rows between unbounded preceding and 1 preceding), 0) / {_CAP}) as bigint) as batch from f_line)
    select file_id, batch, n as dup_count from q join ({recount_sql("(select file_id as fid, null::varchar as hash_strong, content_fast as hash_fast, excluded, stale from f_line)")}) r on r.fid = q.file_id""")  # fmt: skip
add("str_06_arrivals", "f_line f_hashes0", _arrived,
    f"""with a as (select file_id as arrival_id, hash_partial, file_size, case when file_id % 24 = 0 then content_fast end as hash_fast, case when inode < 500000 then 1 else 2 end as turn from f_line where location_id = 1),
    k as (select hash_fast, min(file_id) as match_id from f_hashes0 where {ACT} and location_id <> 1 and hash_fast <> '' group by 1),
    g as (select distinct hash_partial, file_size from f_hashes0 where {ACT} and location_id <> 1 and hash_partial <> '' and file_size > 0),
    w as (select a.*, first_value(arrival_id) over (partition by hash_fast order by turn, arrival_id) as first_id, count(*) over (partition by hash_partial, file_size) as twins from a)
    select arrival_id, case when w.hash_fast is not null then coalesce(k.match_id, case when first_id <> arrival_id then first_id end) end as match_id,
      w.hash_fast is null and w.hash_partial is not null and w.file_size > 0 and (g.file_size is not null or twins > 1) as to_hash
    from w left join k on k.hash_fast = w.hash_fast left join g on g.hash_partial = w.hash_partial and g.file_size = w.file_size""")  # fmt: skip


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of identical files that waste most, found by the three-gate funnel, with their locations."""
    h, f, w = spark_views(spark, sf_dir, "f_hashes0", "f_line", "f_locations")
    done = three_gate(h, f)
    rows = dups.active(done).withColumn("hash", fn.effective_hash(F.col("hash_strong"), F.col("hash_fast")))
    places = rows.join(dups.top_groups(done).select("hash"), "hash").join(w.select("location_id", "name"), "location_id")
    return places.groupBy("hash").agg(F.count("*").alias("copies"), F.max("file_size").alias("file_size"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("locations")).orderBy(F.desc("file_size"), "hash")
