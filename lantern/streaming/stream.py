"""Incremental versions over Structured Streaming, kept in snapshots (lantern.sources.snapshots).

What a micro-batch changes becomes one version, in which the batch is marked as applied: a batch that Spark repeats
after a failure changes nothing. State is what the streams' own operators keep, or small tables in the same version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lantern.functions.fn import ancestors
from lantern.operators.dups import GATE, known_gates, known_hashes, recount_hashes
from lantern.operators.hashing import byte_batches
from lantern.sources import snapshots
from lantern.sources.catalog import parse_listing, upsert_hashes, with_ids
from lantern.sources.snapshots import COUNTERS, FILES, HASHES, LOG, applied, compact, snapshot, upsert
from lantern.tables import prepare, written

#: Versions after which a stream compacts the tables that it adds to.
COMPACT_EVERY = 16


def stream_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Listing records as their files arrive."""
    return parse_listing(spark.readStream.text(folder))


def _each(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _compacted(spark: SparkSession, folder: str, batch: int, every: int, *names: str) -> None:
    if every and batch % every == every - 1:
        for name in names:
            compact(spark, folder, name, every)


def ingest_batch(batch: DataFrame, number: int, folder: str, stream: str, name: str = "files", order: str | None = None) -> int:
    """The version with a micro-batch of listed files, or hashes, added to the table of that name.

    The batch's rows alone are written. Of rows with equal keys that of the largest `order` counts (without it, the last
    read); new files get an id from their key, known ones keep theirs. Seen files are no longer stale.
    """
    rows = batch if name == "hashes" else with_ids(batch.withColumn("stale", F.lit(0)))
    return upsert(batch.sparkSession, folder, {name: rows}, stream, number, rules={name: HASHES if name == "hashes" else FILES}, order=order)


def stream_ingest(stream: DataFrame, folder: str, checkpoint: str, name: str = "files", order: str | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Adds each micro-batch to a table of the snapshots in folder. Readers of a version go on with it while parts are compacted."""

    def work(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, number, folder, checkpoint, name, order)
        _compacted(batch.sparkSession, folder, number, compact_every, name)

    return _each(stream, checkpoint, work)


def newest(spark: SparkSession, folder: str, name: str = "files") -> DataFrame:
    """A table as the last version has it."""
    return snapshot(spark, folder).table(name)


def running_stats(deltas: DataFrame) -> DataFrame:
    """Running (location_id, rel_path, file_count, total_size), '' for the location, of streamed signed deltas."""
    paths = F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("rel_dir"))))
    return deltas.select("location_id", paths.alias("rel_path"), "file_count", "total_size").groupBy("location_id", "rel_path").agg(F.sum("file_count").alias("file_count"), F.sum("total_size").alias("total_size"))


def stream_stats(deltas: DataFrame, folder: str, checkpoint: str, name: str = "counters", compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps a table of counters by folder. Each micro-batch writes only the folders that its deltas touch, with their new sums.

    Sums are Spark's state and may fall below 0 when a delta comes before the one it undoes; counters() shows 0 then.
    """

    def work(batch: DataFrame, number: int) -> None:
        if applied(snapshot(batch.sparkSession, folder), checkpoint, number):
            batch.write.format("noop").mode("overwrite").save()  # the sums' state must follow even so
        upsert(batch.sparkSession, folder, {name: batch}, checkpoint, number, rules={name: COUNTERS})
        _compacted(batch.sparkSession, folder, number, compact_every, name)

    return _each(running_stats(deltas), checkpoint, work, "update")


def counters(spark: SparkSession, folder: str, name: str = "counters") -> DataFrame:
    rows = newest(spark, folder, name)
    return rows.select("location_id", "rel_path", *(F.greatest(F.lit(0), F.col(c)).alias(c) for c in ("file_count", "total_size")))


def recount_batch(changed: DataFrame, number: int, folder: str, stream: str, more: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, results: DataFrame | None = None, rules: dict | None = None) -> int:
    """The version in which the duplicate counts of the changed hashes (column hash) are right, as of the newest version before it.

    results (file_id, hash_fast) are hashes that come in with the same version. What flipped is added to table
    'flips', with the version that was read; more and replace are further tables of the same version.
    """
    spark = changed.sparkSession
    last = snapshot(spark, folder)
    if applied(last, stream, number):
        return last.version
    hashes = last.table("hashes")
    after = hashes if results is None else upsert_hashes(hashes, results)
    flips = written(recount_hashes(after, changed))
    counts = flips.select("file_id", F.col("new_count").alias("dup_count"))
    rows = counts if results is None else counts.join(results, "file_id", "full_outer")
    log = flips.withColumns({"batch": F.lit(number).cast("long"), "version": F.lit(last.version).cast("long")})
    return upsert(spark, folder, {"hashes": rows, "flips": log, **(more or {})}, stream, number, replace, {"hashes": HASHES, "flips": LOG, **(rules or {})})


def stream_dup_recount(changed: DataFrame, folder: str, checkpoint: str, gap: str = "10 minutes", late: str = "10 minutes", compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Recounts the changed hashes (hash, at) once their bursts are over: changes of a hash less than `gap` apart are one
    session, which closes when events later than its end by `late` have come.

    A closed session is recounted in the version that is newest then, so hashes that changed in between count as they are.
    """
    bursts = changed.withWatermark("at", late).groupBy(F.session_window("at", gap), "hash").agg(F.count("*").alias("changes"))

    def work(batch: DataFrame, number: int) -> None:
        sessions = batch.select("hash", "changes", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"))
        sessions = written(sessions.withColumn("batch", F.lit(number).cast("long")))  # also of a repeated batch, as the sessions' state must follow
        recount_batch(sessions.select("hash").distinct(), number, folder, checkpoint, {"recounts": sessions}, rules={"recounts": LOG})
        _compacted(batch.sparkSession, folder, number, compact_every, "hashes")

    return _each(bursts, checkpoint, work)


Hasher = Callable[[DataFrame], DataFrame]


def queue_batch(worklist: DataFrame, number: int, folder: str, stream: str, cap: int, hasher: Hasher, last: bool = False) -> int:
    """The version after a part of the work-list (location_id, file_id, inode, file_size) came in.

    Each location's rows go on where its bytes so far stopped. Batches whose bytes reached cap are closed (`last` closes
    all): hasher gives (file_id, hash_fast) of their rows, those hashes are recounted, and the rows go to table
    'queue_closed'. The rows of batches still open, of less than cap bytes a location, replace table 'queue_open'.
    """
    spark = worklist.sparkSession
    before = snapshot(spark, folder)
    if applied(before, stream, number):
        return before.version
    totals = before.table("queue_totals") if "queue_totals" in before else None
    dealt = byte_batches(worklist, cap, totals).select("location_id", "file_id", "inode", "file_size", "batch")
    new = dealt.groupBy("location_id").agg(F.sum("file_size").alias("bytes"))
    after = new if totals is None else totals.unionByName(new).groupBy("location_id").agg(F.sum("bytes").alias("bytes"))
    waiting = dealt.unionByName(before.table("queue_open")) if "queue_open" in before else dealt
    marked = waiting.join(after.withColumn("__bytes", F.col("bytes")).drop("bytes"), "location_id").withColumn("closed", F.lit(True) if last else F.col("batch") < F.floor(F.col("__bytes") / cap)).drop("__bytes")
    marked = written(marked)
    closed = marked.where("closed").drop("closed")
    results = written(hasher(closed).select("file_id", "hash_fast").where("hash_fast is not null"))
    tables = {"queue_closed": closed, "queue_totals": after.select("location_id", "bytes").join(marked.select("location_id").distinct(), "location_id", "left_semi")}
    rules = {"queue_closed": LOG, "queue_totals": snapshots.Rules(("location_id",)), "queue_open": LOG}
    return recount_batch(results.select(F.col("hash_fast").alias("hash")).distinct(), number, folder, stream, tables, {"queue_open": marked.where("not closed").drop("closed")}, results, rules)


def stream_hash_queue(worklist: DataFrame, folder: str, checkpoint: str, hasher: Hasher, cap: int = 500 << 20, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Drains a work-list in batches of cap bytes, carried over from one arrival to the next, and recounts after each.

    However a list in (location, inode) order is cut into arrivals, its batches are those of byte_batches over all of it.
    """

    def work(batch: DataFrame, number: int) -> None:
        queue_batch(batch, number, folder, checkpoint, cap, hasher)
        _compacted(batch.sparkSession, folder, number, compact_every, "hashes", "queue_totals")

    return _each(worklist, checkpoint, work)


def close_queue(spark: SparkSession, folder: str, cap: int, hasher: Hasher, stream: str = "close") -> int:
    """Closes the batches that are still open, once no more work is to come."""
    at = snapshot(spark, folder)
    none = at.table("queue_open").select("location_id", "file_id", "inode", "file_size").limit(0)
    return queue_batch(none, at.manifest["applied"].get(stream, -1) + 1, folder, stream, cap, hasher, last=True)


#: Groups of keys that arrivals' state is kept by.
BUCKETS = 1 << 14


def stream_arrivals(arrivals: DataFrame, hashes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(arrival_id, match_id, to_hash) of streamed files (arrival_id, hash_fast, hash_partial, file_size), against the catalog and each other.

    match_id: the smallest active catalog file of equal fast hash; else the first arrival of that hash, which is the one
    of smallest id in the first micro-batch that had any; null for that one itself. An arrival without fast hash is to be
    hashed when its partial hash and size are known, from the catalog or another arrival. One whose twin comes in a later
    micro-batch gets a second row then, with to_hash true. State has an entry per hash, and per partial hash and size.
    Rows of one key that a task reads together travel as one, so a hash that fills a batch is a few rows to its task.
    Keys are dealt to `buckets`, each one call and one row of state, as a call costs far more than a key: a micro-batch
    makes no more calls than that. It rewrites the state of the buckets that it touches. A checkpoint stays with its number.
    """
    prepare(arrivals.sparkSession)
    with_match = arrivals.join(known_hashes(hashes), "hash_fast", "left")
    marked = with_match.join(known_gates(hashes), GATE, "left")
    full = (F.col("hash_partial").isNotNull()) & (F.col("file_size") > 0)
    gate = F.when(full, F.concat(F.lit("g:"), F.col("hash_partial"), F.lit(":"), F.col("file_size").cast("string")))
    fast = F.when(F.col("hash_fast") != "", F.concat(F.lit("f:"), F.col("hash_fast")))
    event = lambda key, asks: F.struct(key.alias("key"), asks.alias("asks"))
    # An arrival asks under its fast hash or, without one, under its gate; one with a fast hash makes its gate known too.
    # One that can ask under neither is a key of its own, so that it is answered like any other.
    own = F.concat(F.lit("o:"), F.col("arrival_id").cast("string"))
    events = F.array_compact(F.array(event(F.coalesce(fast, gate, own), F.lit(True)), F.when(fast.isNotNull() & gate.isNotNull(), event(gate, F.lit(False)))))
    rows = marked.select("arrival_id", F.col("match_id").alias("known_id"), F.coalesce("__met", F.lit(False)).alias("met"), F.explode(events).alias("e"))
    rows = rows.select("e.key", "e.asks", "arrival_id", "known_id", "met")
    met = rows.mapInPandas(_gathered, "key string, asking array<long>, silent boolean, known_id long, met boolean")
    return met.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        _answered, "arrival_id long, match_id long, to_hash boolean", "keys array<string>, firsts array<long>, mets array<boolean>", "append", GroupStateTimeout.NoTimeout
    )


def _gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key of what a task reads together."""
    for rows in parts:
        if len(rows):
            asking = rows[rows["asks"]].groupby("key")["arrival_id"].agg(list)
            by_key = rows.groupby("key")
            out = pd.DataFrame({"silent": ~by_key["asks"].all(), "known_id": by_key["known_id"].min(), "met": by_key["met"].any()})
            out["asking"] = asking.reindex(out.index)
            out["asking"] = out["asking"].map(lambda x: x if isinstance(x, list) else [])
            yield out.astype({"known_id": "Int64"}).reset_index()[["key", "asking", "silent", "known_id", "met"]]


def _answered(bucket: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Answers the arrivals of a bucket's keys. State, by key: the first arrival that asked under it, and whether a gate is known already."""
    asked: dict[str, tuple[list[int], list[bool], list[int]]] = {}  # of each key: who asks, whether it is met, its known file
    for rows in parts:
        for key, asking, silent, known_id, met in zip(*(rows[c] for c in ("key", "asking", "silent", "known_id", "met")), strict=True):
            ids, told, known = asked.setdefault(key, ([], [], []))
            ids += map(int, asking)
            told.append(bool(silent) or bool(met))
            if not pd.isna(known_id):
                known.append(int(known_id))
    firsts, mets = {}, {}
    if state.exists:
        keys, first_ids, met_before = state.get
        firsts, mets = dict(zip(keys, first_ids, strict=True)), dict(zip(keys, met_before, strict=True))
    out: list[tuple[int, int | None, bool]] = []
    for key, (ids, told, known) in asked.items():
        ids.sort()
        kind = key[:2]
        if kind == "f:":
            first = firsts[key] if firsts.get(key) is not None else ids[0] if ids else None
            firsts[key], mets[key] = first, False
            out += [(i, known[0] if known else first if i != first else None, False) for i in ids]
        elif kind == "g:":
            first, met = firsts.get(key), mets.get(key, False)
            waiting = [first] if first is not None and not met else []  # an arrival that was told not to be hashed
            met = met or any(told) or len(ids) + len(waiting) > 1
            firsts[key], mets[key] = first if first is not None else ids[0] if ids else None, met
            out += [(i, None, met) for i in (*(waiting if met else ()), *ids)]
        else:
            out += [(i, None, False) for i in ids]
    if firsts:
        state.update((list(firsts), list(firsts.values()), [mets[k] for k in firsts]))
    ids, match, to_hash = zip(*out, strict=True) if out else ((), (), ())
    yield pd.DataFrame({"arrival_id": ids, "match_id": pd.array(match, "Int64"), "to_hash": to_hash})
