"""Bound-certified best-fit packing of tokenised documents into sequences of a fixed length.

Each partition of documents is packed best-fit decreasing, and dual feasible functions give a lower bound of the
sequences it needs: a partition that meets its bound is certified. Partitions with a gap, and the emptiest sequence
of each other one, exchange their documents and are packed anew, as long as that saves sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read, written

CAPACITY = 2048
#: Documents that one partition packs; some 5 MB of lengths.
GROUP = 100_000
#: Pre-tokens whose ids a worker remembers; about 60 MB.
REMEMBERED = 300_000

# Letters, numbers and white space of Latin-1, as the tokenizer's own split pattern classes them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Encoder:
    """Token ids as little-endian unsigned 32-bit integers.

    A byte-level tokenizer encodes each pre-token by itself, so the ids of a pre-token are remembered. New ones go to a
    faster encoder built on the same vocabulary, once that has agreed with the tokenizer on a first lot of them; texts
    with characters beyond Latin-1, or with one of the tokenizer's added tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        signs = [c for c in map(chr, range(33, 0x180)) if c in set(ByteLevel.alphabet())]
        own = [ord(c) for c in signs if ord(c) < 256]
        byte = dict(zip(map(chr, own), own, strict=True)) | dict(zip((c for c in signs if ord(c) > 255), (i for i in range(256) if i not in own), strict=True))
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if set(w) <= byte.keys()}
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        added = {bytes(x, "utf-8") for x in self.added}
        self.fast = tiktoken.Encoding("pre-tokens", pat_str=r"(?s).+", mergeable_ranks={w: i for w, i in ranks.items() if w not in added}, special_tokens={})
        self.tried = 0
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._encode(parts)
        found = [array("I", self.fast.encode_ordinary(x)).tobytes() for x in parts]
        if self.tried < 2000:
            self.tried += len(parts)
            if found != (sure := self._encode(parts)):
                self.fast = None
                return sure
        return found

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._encode([text])[0]
        if any(x in text for x in self.added):
            return self._encode([text])[0]
        parts, known = _SPLIT.findall(text), self.known
        new = [x for x in set(parts) if x not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(parts))
            known.update(zip(new, self._encode_parts(new), strict=True))
        return b"".join(map(known.__getitem__, parts))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut where longer than capacity.

    Cuts count from the end, so only a document's first piece may be shorter. A null text is an empty one: its end_id alone.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or Encoder(tokenizer_path)
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                stop = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    own = ids[4 * at : 4 * stop]
                    rows.append((doc_id, piece, at, stop - at, zlib.crc32(own), own)[: len(names)])
                    at, stop = stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most sequences that any of three families of dual feasible functions proves necessary.

    Each maps lengths so that no sequence's total exceeds one; the mapped total, rounded up, is then a lower bound.
    All arithmetic is in integers.
    """
    if not len(lengths):
        return 0
    size, count = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((size * count).sum()) // capacity)
    for k in range(1, 33):  # steps of 1/k, exact multiples of 1/(k+1) kept as they are
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        total = int((np.where(whole, k * size, scaled // capacity * capacity) * count).sum())
        best = max(best, -(-total // (k * capacity)))
    for e in np.unique(np.minimum(size, capacity - size)):
        if e <= 0 or 2 * e > capacity:
            continue
        total = int((np.where(size > capacity - e, capacity, np.where(size < e, 0, size)) * count).sum())
        best = max(best, -(-total // capacity))
        if 2 * e < capacity:
            steps = capacity // e
            total = int((np.where(2 * size > capacity, steps - (capacity - size) // e, np.where(size < e, 0, 1)) * count).sum())
            best = max(best, -(-total // steps))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length its sequence and its place there; the number of sequences. Ties go by position."""
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0  # bit r of rooms: some open sequence has room r
    values = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = values[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, own, n = capacity, n, n + 1
        sequence[i], offset[i] = own, capacity - room
        if room > size:
            open_by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return sequence, offset, n


_PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, bins long, bound long, spare boolean, part long"


def _pack(loose: DataFrame, rows: int, capacity: int, group: int, turn: int) -> DataFrame:
    """Deals rows to partitions of about `group` rows, and packs each."""
    parts = max(1, -(-rows // group))
    own_bits = max(20, (2 * group).bit_length())

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("uid", ignore_index=True)
        lengths = x["length"].to_numpy()
        own, offset, n = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(own, weights=lengths, minlength=n)
        emptiest = int(filled.argmin())
        return x[["uid", "doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=((turn << 24) + int(key[0]) << own_bits) + own, offset=offset, bins=n, bound=lower_bound(lengths, capacity), spare=(own == emptiest) & (filled[emptiest] < capacity), part=int(key[0])
        )

    dealt = loose.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(run, _PACKED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """One row per piece: where it comes from, its checksum, the sequence it goes to and its place there; bins and bound.

    Partitions with a gap to their bound exchange their pieces and are packed again, as long as that saves sequences
    (in at most `rounds` rounds, where given).
    bins is the number of sequences of the partition that packed the piece, and bound how many any packing of that
    partition needs; where they are equal its count is proved least. Full pieces fill a sequence each (bins and bound
    1) and are not shuffled. Null ids, repeated ids and repeated rows are packed like any other row; a null or empty
    text is packed as its end id; extra columns are not read; no rows give no rows. Only lengths move between
    partitions, never ids or texts.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = [*names, "sequence_id", "offset", "bins", "bound"]
    one = F.lit(1).cast("long")
    settled = [cut.where(F.col("length") == capacity).select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))]
    loose = cut.where(F.col("length") < capacity)
    packed = written(_pack(loose, loose.count(), capacity, group, 0))
    for turn in count(1) if rounds is None else range(1, rounds):
        moves = (F.col("bins") > F.col("bound")) | F.col("spare")
        pool = packed.where(moves)
        rows, before, parts = pool.agg(F.count("*"), F.count_if(F.col("offset") == 0), F.count_distinct("part")).first()
        if parts < 2:  # alone, a partition would only be packed the same way again
            break
        again = written(_pack(pool.select("uid", *names), rows, capacity, group, turn))
        if again.where("offset = 0").count() >= before:
            break
        settled.append(packed.where(~moves).select(*placed))
        packed = again
    settled.append(packed.select(*placed))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, as arrays of token ids. Needs unique, non-null document ids."""
    own = pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids=True).select("doc_id", "piece", "ids")
    prepare(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def numbers(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.frombuffer(x, dtype="<u4").astype(np.int32))

    parts = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", numbers(F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))).alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, in sequences of at most 2048 tokens of a public byte-level tokenizer."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
