import time

import corpus_pipeline
import pytest
from lantern.llm.common import written
from pyspark.sql import functions as F
from tests.llm import linebrute
from tests.llm.test_llm_ops import check_packed, plain_overlaps
from tests.llm.test_shingledup import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1])
    assert all(x.where(F.col("n_chars") != F.length("text")).count() == 0 for x in steps[2:3])


def test_toxic_documents_go(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert after.items() <= before.items()
    terms = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting")
    assert not [i for i, t in after.items() if sum(x in (t or "").lower() for x in terms) > 2]
    assert len(after) > 0.8 * len(before)


def test_lines(steps):
    assert texts(steps[2]) == linebrute.dedup(list(texts(steps[1]).items()))


def test_one_of_each_group_stays(steps):
    assert texts(steps[3]).keys() == plain_kept(texts(steps[2]))


def test_no_benchmark_left(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in plain_overlaps(list(texts(steps[3]).items()), items)}
    assert texts(steps[4]).keys() == texts(steps[3]).keys() - hit


def test_packed(steps):
    check_packed(steps[5].collect(), texts(steps[4]).values(), 2048)


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "piece").exceptAll(steps[5].select("doc_id", "piece")).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    held = lambda: {x for x in (f.getName() for f in listed(disk.getAllFiles())) if x.startswith("shuffle_")}
    before = held()
    table = written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.monotonic() + 10
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not held() - before
    assert {r["count"] for r in table.collect()} == {100}
