"""Snapshots of catalog tables: what a version holds is named by one manifest, whose rename publishes it.

Data folders are never changed once written. A manifest lists, for each part of each table, the folders that make it
up: one with whole rows, and behind it those with later upserts, which reading merges and compaction replaces by one.
Whoever holds a snapshot goes on reading its own folders, whatever is published meanwhile. A writer that finds its
version taken applies its change to the newer one. The shared file system must rename files atomically.

    folder/data/<name>/<table>/part=<value>/...    folder/manifests/<version>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lantern.tables import shuffles_dropped

#: Parts of tables that are not kept by location.
PARTS = 64
#: A part that starts with upserts, which may repeat a key: as if they came upon no rows.
_EMPTY = [""]
#: The commit and the row within it that an upserted row comes from.
_AT, _ROW = "__at", "__row"


@dataclass(frozen=True)
class Rules:
    """How rows of one key become one: `keep` columns have their first value that is not null, all others the last one
    that is not null, so a column that an upsert lacks stays as it is. Without a key all rows stay. `by` is the column
    that parts are made of; without it they are made of the key."""

    key: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    by: str | None = None

    def part(self) -> Column:
        if self.by:
            return F.col(self.by)
        return F.pmod(F.xxhash64(*self.key), F.lit(PARTS)) if self.key else F.lit(0)

    def merged(self, rows: DataFrame, schema: StructType) -> DataFrame:
        if not self.key:
            return rows.select(*schema.names)
        order = F.struct(_AT, _ROW)
        value = []
        for c in (c for c in schema.names if c not in self.key):
            given = F.when(F.col(c).isNotNull(), order)
            value.append((F.min_by if c in self.keep else F.max_by)(c, given).alias(c))
        # dealt as they are, and so sorted once: most keys have one row, which aggregating before the shuffle would sort, too, and widen by each column's place
        return rows.repartition(*self.key).groupBy(*self.key).agg(*value).select(*schema.names)


FILES = Rules(("location_id", "rel_path"), keep=("file_id", "description", "excluded", "date_cataloged"), by="location_id")
HASHES = Rules(("file_id",))
COUNTERS = Rules(("location_id", "rel_path"), by="location_id")
LOG = Rules()


class _Folder:
    """The files below a folder, through the file system that Spark reads it by."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.root = spark._jvm, folder.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.fs.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether the file was made: whole under another name, then renamed; False if there is one already."""
        other = self.path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(other, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(other), self.fs.makeQualified(self.path(name)), none)
        except Py4JJavaError as e:
            self.fs.delete(other, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables."""

    spark: SparkSession
    folder: str
    version: int
    manifest: dict = field(repr=False)

    def __contains__(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def names(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def table(self, name: str) -> DataFrame:
        """Its rows: parts of one folder as they stand, others merged by the table's rules."""
        own = self.manifest["tables"][name]
        schema = StructType.fromJson(own["schema"])
        plain = [x[0] for x in own["parts"].values() if len(x) == 1]
        mixed = [y for x in own["parts"].values() if len(x) > 1 for y in x]
        out = _read(self.spark, self.folder, plain, schema).select(*schema.names)
        return out.unionByName(_rules(own).merged(_read(self.spark, self.folder, mixed, schema), schema)) if mixed else out

    def pieces(self, name: str) -> dict[str, list[str]]:
        return self.manifest["tables"][name]["parts"]


def _rules(entry: dict) -> Rules:
    return Rules(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry["rules"].items()})


def _read(spark: SparkSession, folder: str, pieces: list[str], schema: StructType) -> DataFrame:
    whole = StructType(schema.fields[:]).add(_AT, "long").add(_ROW, "long")
    paths = [f"{folder}/{x}" for x in pieces if x]
    return spark.read.schema(whole).parquet(*paths) if paths else spark.createDataFrame([], whole)


def snapshot(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot:
    """The newest version, or the one asked for. A folder without any is version 0, of no tables."""
    at = _Folder(spark, folder)
    known = [int(x[:-5]) for x in at.names("manifests") if x.endswith(".json") and x[:-5].isdigit()]
    if version is not None and version not in known:
        raise ValueError(f"{folder} has no version {version}")
    if not known:
        return Snapshot(spark, folder, 0, {"tables": {}, "applied": {}})
    version = max(known) if version is None else version
    return Snapshot(spark, folder, version, json.loads(at.read(_name(version))))


def _name(version: int) -> str:
    return f"manifests/{version:020d}.json"


def _commit(spark: SparkSession, folder: str, change: Callable[[dict], dict | None]) -> int:
    """The version that change made of the newest manifest; the newest one's where change gives None."""
    while True:
        last = snapshot(spark, folder)
        new = change(last.manifest)
        if new is None:
            return last.version
        if _Folder(spark, folder).write_new(_name(last.version + 1), json.dumps(new)):
            return last.version + 1


def _write(folder: str, name: str, rows: DataFrame, rules: Rules, at: int, order: str | None, schema: StructType | None = None) -> dict:
    """A table's entry for rows, once they are written as a data folder of their own."""
    spark = rows.sparkSession
    schema = schema or StructType([f for f in rows.schema if f.name != order])
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns]
    place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    out = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in rows.columns), *missing, F.lit(at).cast("long").alias(_AT), place.alias(_ROW))
    top = f"data/{uuid.uuid4().hex}/{name}"
    out = out.withColumn("part", rules.part().cast("string"))
    if at >= 0 and rules.key and not rules.by:
        out = out.repartition("part")  # upserts are narrow; as they come, each task would write a small file of each part
    with shuffles_dropped(spark):
        out.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/{top}")
    parts = {x: [f"{top}/{x}"] for x in _Folder(spark, f"{folder}/{top}").names("") if x.startswith("part=")}
    return {"schema": schema.jsonValue(), "rules": vars(rules), "parts": parts}


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], rules: dict[str, Rules] | None = None) -> int:
    """The version in which these tables replace those of their names, all at once; others stay as they are.

    If a table cannot be written, the last version stays the newest and whole. Unless rules say otherwise, a table
    is kept by location where it has one, and has no key.
    """
    made = {name: _write(folder, name, df, (rules or {}).get(name) or (Rules(by="location_id") if "location_id" in df.columns else LOG), -1, None) for name, df in tables.items()}
    return _commit(spark, folder, lambda m: m | {"tables": m["tables"] | made})


def upsert(
    spark: SparkSession, folder: str, rows: dict[str, DataFrame], stream: str, batch: int, replace: dict[str, DataFrame] | None = None, rules: dict[str, Rules] | None = None, order: str | None = None
) -> int:
    """The version in which rows are added to tables by their rules, and others are replaced, as the stream's batch.

    A batch that is already applied changes nothing. What is written is the rows alone, not the parts they belong to.
    Of equal keys in a batch that of the largest `order` counts. A table that is not there yet starts with its rows.
    """
    last = snapshot(spark, folder)
    if applied(last, stream, batch):
        return last.version
    rules = rules or {}
    made = {}
    for name, df in rows.items():
        own = last.manifest["tables"].get(name)
        made[name] = _write(folder, name, df, _rules(own) if own else rules.get(name, LOG), last.version, order if order in df.columns else None, StructType.fromJson(own["schema"]) if own else None)
    whole = {name: _write(folder, name, df, rules.get(name, LOG), -1, None) for name, df in (replace or {}).items()}

    def change(m: dict) -> dict | None:
        if m["applied"].get(stream, -1) >= batch:
            return None
        tables = m["tables"] | whole
        for name, new in made.items():
            own = tables.get(name, new | {"parts": {}})
            parts = own["parts"] | {p: own["parts"].get(p, _EMPTY) + x for p, x in new["parts"].items()}
            tables = tables | {name: own | {"parts": parts}}
        return {"tables": tables, "applied": m["applied"] | {stream: batch}}

    return _commit(spark, folder, change)


def applied(of: Snapshot, stream: str, batch: int) -> bool:
    return of.manifest["applied"].get(stream, -1) >= batch


def compact(spark: SparkSession, folder: str, name: str, least: int = 2) -> int:
    """The version in which each part of at least so many folders is one folder of merged rows.

    Upserts may go on meanwhile: a part keeps the folders that came behind those merged here. Old versions keep theirs.
    """
    last = snapshot(spark, folder)
    old = {p: x for p, x in last.manifest["tables"][name]["parts"].items() if len(x) >= least}
    if not old:
        return last.version
    own = last.manifest["tables"][name]
    schema, rules = StructType.fromJson(own["schema"]), _rules(own)
    rows = _read(spark, folder, [y for x in old.values() for y in x], schema)
    new = _write(folder, name, rules.merged(rows, schema), rules, -1, None, schema)["parts"]

    def change(m: dict) -> dict | None:
        parts = dict(m["tables"][name]["parts"])
        for p, x in old.items():
            if parts.get(p, [])[: len(x)] != x:
                return None  # another compaction was first
            parts[p] = new.get(p, []) + parts[p][len(x) :]
        return m | {"tables": m["tables"] | {name: m["tables"][name] | {"parts": {p: x for p, x in parts.items() if x}}}}

    return _commit(spark, folder, change)


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """How many data folders went: those that only versions before the last `keep` name. Such versions can no longer be read."""
    at = _Folder(spark, folder)
    versions = [x for x in at.names("manifests") if x.endswith(".json")]
    named = lambda xs: {f for x in xs for t in json.loads(at.read(f"manifests/{x}"))["tables"].values() for p in t["parts"].values() for f in p if f}
    gone, kept = versions[:-keep], versions[-keep:]
    superseded = named(gone) - named(kept)
    for name in gone:  # first, so that no version names what is missing
        at.delete(f"manifests/{name}")
    for name in superseded:
        at.delete(name)
    return len(superseded)
