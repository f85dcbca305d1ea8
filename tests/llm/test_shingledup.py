"""Near duplicates by shingles, against all pairs' Jaccard similarity."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import buckets, shingledup, simhash
from lantern.llm.common import written
from tests.llm.test_llm_ops import words

SF = "/root/testdata/sf0.001"


def plain_kept(texts, width=5, similarity=0.8):
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := words(t)) else set() for i, t in texts.items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= similarity * len(x | y) - 1e-9:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def varied(text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[random.randrange(len(w))] = f"new{random.random()}"
    return " ".join(w)


def test_stage_matches_all_pairs_of_varied_documents(spark, docs):
    random.seed(4)
    rows = []
    for g in range(25):
        base = " ".join(f"g{g}w{random.randrange(400)}" for _ in range(120))
        rows += [base] + [varied(base, k) for k in (1, 1, 2, 2, 3, 4, 6)]
    rows += ["", " \n", "one two three", "one two three", "one two four"]
    texts = dict(enumerate(rows))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(*texts.items()), SF).collect()}
    assert got == plain_kept(texts)
    assert len(got) < 150  # two bits of SimHash keep nearly all of the 200


def test_large_group_of_near_copies(docs):
    random.seed(5)
    base = " ".join(f"w{i}" for i in range(150))
    texts = {i: varied(base, random.choice((1, 2, 3))) for i in range(300)}
    assert {r.doc_id for r in shingledup.keep_one_alike(docs(*texts.items())).collect()} == plain_kept(texts)


def test_test_documents_and_odd_rows(spark, odd):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in shingledup.keep_one_alike(table).collect()} == plain_kept({r.doc_id: r.text for r in table.collect()})
    assert {r.doc_id for r in shingledup.keep_one_alike(odd).collect()} == {1, 2, 5}
    assert shingledup.shingle_duplicates(odd).count() == odd.count()
    assert shingledup.keep_one_alike(odd.where("false")).count() == 0


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    """A bucket dealt to many parts has the links of one that is not: here chains of neighbouring numbers."""
    values = [x for start in (0, 100, 200, 300, 400) for x in range(start, start + 7)] + [900, 950]
    met = spark.createDataFrame([(x, b, len(values), (x,)) for b in (1, 2) for x in values], "node long, bucket long, members long, info struct<v:long>")
    near = lambda x, y: F.expr(f"abs({x}.v - {y}.v) <= 1")
    judge = lambda pairs: pairs.withColumn("similar", F.col("b") - F.col("a") == 1)
    found = []
    for dealt in (4096, 5, 1):
        monkeypatch.setattr(buckets, "DEALT", dealt)
        found.append({r.node: r.component for r in buckets.linked_in_buckets(met, near, judge).collect()})
    assert found[0] == found[1] == found[2] == {x: x // 100 * 100 for x in values if x < 900}


def test_operator_6_proposes_pairs_that_no_band_holds(docs):
    """Without any MinHash band, texts whose fingerprints differ in two bits at most still meet; exact similarity decides."""
    long = " ".join(f"w{i}" for i in range(3000))
    spam = "buy " * 3000
    df = docs((1, long), (2, long.replace("w1500 ", "")), (3, spam + "a b c d e f"), (4, spam + " ".join(f"x{i}" for i in range(40))))
    marked = written(shingledup._marked(df, "doc_id", "text", 5)).withColumn("bands", F.array().cast("array<bigint>"))
    own = {r.doc_id: r.node for r in marked.collect()}
    prints = {r.doc_id: r.fp for r in marked.collect()}
    assert all(((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 2 for a, b in ((1, 2), (3, 4)))
    nodes = marked.groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    linked = {r.node: r.component for r in shingledup.alike_nodes(df, marked, nodes, "text", 5, 0.8).collect()}
    assert linked == {own[i]: min(own[1], own[2]) for i in (1, 2)}


def test_fingerprints_cells_are_not_broadcast(docs, monkeypatch):
    seen, real = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: seen.append(edges) or real(edges))
    assert shingledup.keep_one_alike(docs(*((i, f"one text of a few words with a number {i // 2}") for i in range(20)))).count() == 10
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
