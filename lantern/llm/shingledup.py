"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

Candidates come from two sides. Operator 6's SimHash, over the same shingles, brings texts together whose fingerprints
link at 2 or fewer differing bits; at a similarity of 0.8 fingerprints differ in some 10 bits, so it meets the nearest
copies only. MinHash brings the rest: 32 bands of 4 values each, so a pair at similarity 0.8 meets in no band with a
probability of (1 - 0.8 ** 4) ** 32, some 5 in 100 million. Exact similarity of the shingle sets decides for both.

Documents with equal sets are one node. In each bucket the members are compared with leaders first; see buckets.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.buckets import dealt, linked_in_buckets
from lantern.llm.common import prepare, written
from lantern.llm.simhash import fingerprint, fingerprint_groups, keep_least

WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 4
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
_A = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None]


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle, no words are none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + own[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out)


def bands(values: np.ndarray) -> list[int]:
    """One signed hash per band of the set's MinHash values; none for the empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 4096):
        least = np.minimum(least, (values[i : i + 4096] * _A + _B).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, node, n, fp, bands): per row, the text's hash, the hash of its shingle set, the set's size, the SimHash of operator 6 and the set's bands."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("key"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), width) for x in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(x.as_py(), width) for x in b.column(2)], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "fp", "bands"])

    return source.mapInArrow(run, "doc_id long, key long, node long, n int, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, s): the shingle sets of the texts whose hash is in wanted (key)."""
    text = F.col(text_col).cast("binary")
    source = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(wanted, "key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), width) for x in b.column(0)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    return source.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) of (a, b) pairs."""
    same = dealt(pairs, sets, "s").select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return same.select("a", "b", F.expr(f"common >= {similarity!r}D * (total - common) - 1e-9D").alias("similar"))


def alike_nodes(docs: DataFrame, marked: DataFrame, nodes: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """(node, component) of the nodes that have a similar other one."""
    by_band = marked.dropDuplicates(["node"]).select("node", F.struct("n").alias("info"), F.explode(F.array_distinct("bands")).alias("bucket"))
    # one set of shingles may have several fingerprints, as those count repeats
    prints = written(marked.where("n > 0").select("node", "n", "fp").distinct())
    groups = fingerprint_groups(prints.select("fp").distinct())
    by_print = prints.join(groups, "fp").select("node", F.struct("n").alias("info"), F.xxhash64(F.lit("simhash"), "component").alias("bucket")).distinct()
    placed = by_band.unionByName(by_print)
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = written(placed.join(shared, "bucket"))
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("key")
    sets = written(_sets(docs, wanted, text_col, width))
    # sizes alone rule many pairs out
    near = lambda x, y: F.expr(f"least({x}.n, {y}.n) >= {similarity!r}D * greatest({x}.n, {y}.n) - 1e-9D")
    return linked_in_buckets(met, near, lambda pairs: _alike(pairs, sets, similarity))


def shingle_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component_id): per input row, its shingle set's hash and the smallest id its links reach, itself included.

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at least `similarity`.
    Texts without words are alike. Null text: empty. A row with a null id gets its group's smallest id (null if the
    group has no other). Repeated rows stay. Extra columns are not read. No rows give no rows.
    """
    marked = written(_marked(docs, id_col, text_col, width))
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.min("n").alias("n")))
    linked = alike_nodes(docs, marked, nodes, text_col, width, similarity)
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = written(named.select("node", "component").join(least, "component").select("node", "component_id"))
    return marked.select("doc_id", "node").join(groups, "node").select("doc_id", "node", "component_id")


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is the smallest of its group of similar texts, with all their columns; see keep_least."""
    return keep_least(docs, shingle_duplicates(docs, id_col, text_col, width, similarity), id_col)
