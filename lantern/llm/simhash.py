"""SimHash near-duplicates over documents.

Fingerprints are embedded as vectors of per-segment bit counts. Flipping a bit moves that vector by one, so the
Manhattan distance of two vectors is a lower bound of the Hamming distance of the fingerprints: every pair within
the radius lies in one grid range. The range join sends each vector to the grid cells around it and joins on the
cell; exact Hamming distances then decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read, written
from lantern.llm.graph import connected_components

#: Four bits a segment: sixteen segments, whose counts (0 to 4) fill one hexadecimal digit each of a cell's key.
SEGMENT_BITS, SEGMENTS = 4, 16
SEED = 42


def fingerprint(text: bytes | None, width: int) -> int:
    """A signed 64-bit SimHash of the text's word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        values = [digest(b" ".join(words), SEED)]
    elif width == 3:
        values = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        values = [digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        block = np.array(values[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row. A null text counts as empty; a null id is kept."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit count of each four-bit segment, packed one to a hexadecimal digit."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def near_pairs(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): each pair of different fingerprints of column fp that differ in at most `radius` bits, once.

    Two vectors at Manhattan distance 2 or less share a cell at distance 1 or less from both, so each fingerprint
    is sent to 1 + 2 * 16 cells at most whatever the input's size. A pair is taken in one of its shared cells only.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the grid's neighbourhood covers a radius of 0 to 2 bits")
    key = F.col("key")
    cells = [key] + [
        F.when((digit < SEGMENT_BITS) if step > 0 else (digit > 0), key + F.lit(step << (4 * i)))
        for i, step in product(range(SEGMENTS), (1, -1))
        for digit in [F.shiftrightunsigned(key, 4 * i).bitwiseAND(F.lit(15))]
    ]
    placed = distinct_fps.select("fp", segment_counts(F.col("fp")).alias("key")).select("fp", "key", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    # Spark sizes an exploded table as if each row gave one, and would broadcast 33 times what it takes it for
    a, b = placed.alias("a"), placed.alias("b").hint("merge")
    return a.join(
        b,
        F.expr(
            f"a.cell = b.cell and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {radius} "
            "and case when a.key = b.key then a.cell = a.key else a.cell - a.key <= b.key - a.cell end"
        ),
    ).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def fingerprint_groups(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component): the different fingerprints of column fp, each with the smallest one that links of at most `radius` bits reach, itself included."""
    linked = connected_components(near_pairs(distinct_fps, radius)).withColumnRenamed("node", "fp")
    return distinct_fps.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): per input row, its fingerprint and the smallest id its links reach, itself included.

    Equal fingerprints collapse to one node first, so a large group of copies costs one row. Texts without words
    have fingerprint 0 and link like any other. Null text: empty. A row with a null id gets its group's smallest
    id (null if the group has no other). Repeated rows stay. Extra columns are not read. No rows give no rows.
    """
    marked = written(fingerprints(docs, id_col, text_col, width))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = fingerprint_groups(nodes, radius)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = written(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs whose id is the smallest of its near-duplicate group, with all their columns."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, width, radius), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is its group's component_id in found.

    Rows that repeat that id stay together; rows with a null id stay only in groups that have no id at all.
    """
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, with 3-word shingles and a radius of 2 bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
