"""What the corpus operators share: the cluster's shared folder, written tables, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.tables import shuffles_dropped

#: Rows up to which a narrow table (at most some 64 bytes a row) may be broadcast: about 64 MB.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir).

    Only where that setting is missing, a folder of our own is set, on a local master, as in tests; elsewhere that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for made in _OPEN.get():
        made.append(path)
    return path


#: The folders of each scratch() that is open in this thread.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end: what is to stay must be written elsewhere by then."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a written table in the shared folder: lineage ends here, and a lost executor loses nothing. Its shuffle files go."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of df clashes with."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written, narrow table only if it is counted to be within the bound; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
