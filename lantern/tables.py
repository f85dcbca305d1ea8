"""Written tables in the folder that all executors share, where an operator needs its rows to stand still."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir.

    Where that is not set, a folder of our own stands in on a local master, as in tests; a cluster's executors do not
    share one, so there it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's setting that has a query's shuffle files deleted when it ends, and not when the driver's memory is cleaned up.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nothing else reads them."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def written(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here, and later steps read the same rows.

    Zstandard, as hashes are hexadecimal digits, which Snappy leaves at their length.
    """
    path = shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """df with its rows numbered from 1 in the order of `by`, without one task that sees them all.

    Rows are range-partitioned, numbered within their partitions, and shifted by the sizes of those before.
    """
    own = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    own = own.withColumn("__part", F.shiftright("__m", 33))
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return own.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + place + 1).cast("long")).drop("__m", "__part", "__start")
