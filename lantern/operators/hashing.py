"""Content hashes in three tiers: partial (head and tail), fast (whole content) and strong."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lantern.functions.fn import SMALL
from lantern.tables import written

EDGE = 64 * 1024


def _short(data: Column) -> Column:
    return F.substring(F.md5(data), 1, 16)


def hash_partial(df: DataFrame, content: str = "content", k: int = EDGE) -> DataFrame:
    """Adds hash_partial: of the first and last k bytes, or of all content of up to 2k; null for empty content."""
    data = F.col(content).cast("binary")
    size = F.octet_length(data)
    edges = F.concat(F.substring(data, 1, k), F.substring(data, -k, k))
    return df.withColumn("hash_partial", F.when(size > 2 * k, _short(edges)).when(size > 0, _short(data)))


def hash_fast(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("hash_fast", _short(F.col(content).cast("binary")))


def hash_strong(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("hash_strong", F.sha2(F.col(content).cast("binary"), 256))


def hash_partial_files(paths: DataFrame, path: str = "path", k: int = EDGE) -> DataFrame:
    """(path, file_size, hash_partial) of files on storage that every executor reaches; only their ends are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import pyarrow.fs as pafs

        for b in batches:
            rows = []
            for uri in b[path]:
                fs, own = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(own) as f:
                    size = f.size()
                    data = f.read(k) + f.read_at(k, size - k) if size > 2 * k else f.read()
                rows.append((uri, size, hashlib.md5(data).hexdigest()[:16] if size else None))
            yield pd.DataFrame(rows, columns=["path", "file_size", "hash_partial"])

    return paths.select(path).mapInPandas(run, "path string, file_size long, hash_partial string")


def xxhash64_seed0(content: Column) -> Column:
    """16 hex digits of XXH64 with seed 0, for catalogs whose fast hashes were made that way."""

    @F.pandas_udf("string")
    def digest(x: pd.Series) -> pd.Series:
        import xxhash

        return x.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b), 0))

    return digest(content.cast("binary"))


def promote_small(hashes: DataFrame, candidates: DataFrame | None = None, limit: int = SMALL) -> DataFrame:
    """The fast hash of files up to limit is their partial hash, where it is missing; of candidates only, if given."""
    small = (F.col("file_size") <= limit) & F.col("hash_fast").isNull()
    if candidates is None:
        return hashes.withColumn("hash_fast", F.when(small, F.col("hash_partial")).otherwise(F.col("hash_fast")))
    marked = hashes.join(candidates.select("file_id", F.lit(True).alias("__own")).distinct(), "file_id", "left")
    return marked.withColumn("hash_fast", F.when(small & F.col("__own"), F.col("hash_partial")).otherwise(F.col("hash_fast"))).drop("__own")


def missing_partial(files: DataFrame, hashes: DataFrame, location_id: int | None = None, prefix: str | None = None, folder: str | None = None) -> DataFrame:
    """Non-stale files with content that have no partial hash; in a location, below a folder (prefix), or right in one ('' for the root)."""
    own = files.where("stale = 0 and file_size > 0")
    if location_id is not None:
        own = own.where(F.col("location_id") == location_id)
    if prefix is not None:
        own = own.where(F.col("rel_path").startswith(prefix + "/"))
    if folder is not None:
        own = own.where(F.col("rel_dir") == folder)
    return own.join(hashes.where("hash_partial is not null").select("file_id"), "file_id", "left_anti")


def unhashed_candidates(hashes: DataFrame, location_id: int | None = None) -> DataFrame:
    """Active rows with a partial and without a fast hash."""
    own = hashes.where("excluded = 0 and stale = 0 and hash_partial is not null and hash_fast is null")
    return own if location_id is None else own.where(F.col("location_id") == location_id)


def apply_hash_results(hashes: DataFrame, files: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashes, files) after (location_id, rel_path, hash, error) results: hashes filled in, files not found marked stale."""
    known = results.join(files.select("file_id", "location_id", "rel_path"), ["location_id", "rel_path"])
    got = known.where("error is null").groupBy("file_id").agg(F.max("hash").alias("__h"))
    lost = known.where("error = 'File not found'").select("file_id", F.lit(1).alias("__lost")).distinct()
    filled = hashes.join(got, "file_id", "left").join(lost, "file_id", "left")
    filled = filled.withColumns({"hash_fast": F.coalesce("__h", "hash_fast"), "stale": F.coalesce("__lost", "stale")}).drop("__h", "__lost")
    return filled, files.join(lost, "file_id", "left").withColumn("stale", F.coalesce("__lost", "stale")).drop("__lost")


def clear_changed_hashes(hashes: DataFrame, changed: DataFrame) -> DataFrame:
    """All three hashes of changed files become null."""
    marked = hashes.join(changed.select("file_id", F.lit(True).alias("__c")).distinct(), "file_id", "left")
    return marked.withColumns({h: F.when(F.col("__c").isNull(), F.col(h)) for h in ("hash_partial", "hash_fast", "hash_strong")}).drop("__c")


def rehash(hashes: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashes, affected): new partial (kept where null) and fast hashes, strong ones dropped; hashes to recount."""
    new = results.select("file_id", F.col("hash_partial").alias("__p"), F.col("hash_fast").alias("__f"), F.lit(True).alias("__n"))
    both = hashes.join(new, "file_id", "left")
    affected = both.where("__n").select(F.explode(F.array("hash_fast", "hash_strong", "__f")).alias("hash")).where("hash is not null and hash <> ''").distinct()
    done = both.withColumns(
        {
            "hash_partial": F.coalesce("__p", "hash_partial"),
            "hash_fast": F.when(F.col("__n"), F.col("__f")).otherwise(F.col("hash_fast")),
            "hash_strong": F.when(F.col("__n").isNull(), F.col("hash_strong")),
        }
    ).drop("__p", "__f", "__n")
    return done, affected


def verify_group(hashes: DataFrame, file_ids: DataFrame, files: DataFrame, online: DataFrame) -> DataFrame:
    """(file_id, location_id, state): members of the files' fast groups; have a strong hash, are to get one, or are offline."""
    fast = hashes.join(file_ids.select("file_id"), "file_id", "left_semi").where("hash_fast is not null").select("hash_fast").distinct()
    group = hashes.where("excluded = 0 and stale = 0").join(fast, "hash_fast", "left_semi")
    marked = group.join(online.select("location_id", F.lit(True).alias("__on")).distinct(), "location_id", "left")
    state = F.when(F.col("hash_strong").isNotNull(), "have").when(F.col("__on"), "todo").otherwise("offline")
    return marked.select("file_id", "location_id", state.alias("state"))


def apply_strong(hashes: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashes, affected) after (file_id, hash_strong) results: strong hashes stored, and the hashes to recount, as a file that
    gets one leaves the group of its fast hash. Results that are null, or what the file has already, change nothing."""
    new = results.where("hash_strong is not null and hash_strong <> ''").groupBy("file_id").agg(F.max("hash_strong").alias("__s"))
    both = hashes.join(new, "file_id", "left")
    changed = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(F.col("hash_strong"))
    affected = both.where(changed).select(F.explode(F.array("hash_fast", "hash_strong", "__s")).alias("hash")).where("hash is not null and hash <> ''").distinct()
    return both.withColumn("hash_strong", F.coalesce("__s", "hash_strong")).select(*hashes.columns), affected


def mark_backfill(locations: DataFrame, location_id: int, needed: bool = True) -> DataFrame:
    """Locations with the mark that a location's full hashes are to be read anew, after its partial ones changed, set or taken back."""
    old = F.col("backfill_needed") if "backfill_needed" in locations.columns else F.lit(0)
    return locations.withColumn("backfill_needed", F.when(F.col("location_id") == location_id, int(needed)).otherwise(F.coalesce(old, F.lit(0))))


def apply_partial(hashes: DataFrame, results: DataFrame, limit: int = SMALL) -> DataFrame:
    """Hashes after (file_id, hash_partial) results: of a file whose partial hash changed the others go, save that up to limit it is the fast one, too."""
    new = results.where("hash_partial is not null").groupBy("file_id").agg(F.max("hash_partial").alias("__p"))
    both = hashes.join(new, "file_id", "left")
    changed = F.col("__p").isNotNull() & ~F.col("__p").eqNullSafe(F.col("hash_partial"))
    small = F.when(F.col("file_size") <= limit, F.col("__p"))
    return both.select(*(
        F.coalesce("__p", "hash_partial").alias(c) if c == "hash_partial" else F.when(changed, small).otherwise(F.col(c)).alias(c) if c == "hash_fast" else F.when(~changed, F.col(c)).alias(c) if c == "hash_strong" else F.col(c)
        for c in hashes.columns
    ))


def rehash_partial_worklist(hashes: DataFrame, location_id: int) -> DataFrame:
    """Non-stale rows of a location, excluded or not, with content and a partial hash."""
    return hashes.where((F.col("location_id") == location_id) & (F.col("stale") == 0) & (F.col("file_size") > 0) & F.col("hash_partial").isNotNull())


def byte_batches(worklist: DataFrame, cap: int = 500 << 20, before: DataFrame | None = None) -> DataFrame:
    """Adds batch: a location's rows in inode order, cut where the bytes before a row pass a multiple of cap; no batch exceeds cap plus one file.

    Running sums are taken within ranges of rows, which Spark cuts to like sizes, and shifted by the bytes of the ranges before,
    so no task sorts a whole disk, however many files it has an inode. before (location_id, bytes): what locations have come to
    already, one row each.
    """
    rows = written(worklist.repartitionByRange("location_id", "inode", "file_id").withColumn("__run", F.spark_partition_id()))
    sizes = rows.groupBy("location_id", "__run").agg(F.sum("file_size").alias("__bytes"))
    earlier = Window.partitionBy("location_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("location_id", "__run", F.coalesce(F.sum("__bytes").over(earlier), F.lit(0)).alias("__start"))
    if before is not None:
        had = starts.join(before.select("location_id", F.col("bytes").alias("__had")), "location_id", "left")
        starts = had.select("location_id", "__run", (F.col("__start") + F.coalesce("__had", F.lit(0))).alias("__start"))
    order = Window.partitionBy("location_id", "__run").orderBy("inode", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__sum", F.coalesce(F.sum("file_size").over(order), F.lit(0)))
    same = (summed["location_id"].eqNullSafe(starts["location_id"])) & (summed["__run"] == starts["__run"])
    placed = summed.join(F.broadcast(starts), same)  # a row per range, and one more per location
    return placed.select(*(summed[c] for c in worklist.columns), F.floor((F.col("__sum") + F.col("__start")) / cap).cast("long").alias("batch"))
