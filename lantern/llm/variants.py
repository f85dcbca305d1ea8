"""Groups of spelling variants: words one edit apart, each led to the far commoner one next to it.

A word is a vector of letter counts. One edit moves that vector by a squared distance of at most two, so the pairs of a
block with itself and with blocks of words one letter longer are found by a matrix product of their vectors; edits then
decide. Blocks are kept small by how many letters of each of three classes a word has: an edit moves these counts by
one at most, so only neighbouring blocks meet, and a large block is dealt into parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import broadcast_if_small, prepare, read, remove, written

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FACTOR = 5
#: Of all pairs of a document and a word, one in so many loses a letter.
TYPO = 199
#: Words of a block's part, and letters that they have together.
PART_WORDS, PART_LETTERS = 1024, 1 << 20
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Candidate pairs whose letters are compared at a time, at most.
COMPARED = 1 << 16

# The letters: a to z, then U+00C0 to U+00FF; A to Z are lowered before.
_FIRST, _LATIN, _LETTERS = ord("a"), 0xC0, 26 + 64
CLASSES = 3


def _letter(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < _LATIN, codes - np.uint32(_FIRST), codes - np.uint32(_LATIN - 26)).astype(np.int64)


def spelled(doc_id: int | None, text: str, least: int = LEAST_LETTERS, typo: int = TYPO) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text's runs of letters, one in `typo` of which lose a letter; words under `least` letters are left out."""
    lowered = text.encode().lower().decode()  # bytes lower A to Z alone
    before = zlib.crc32(b"%b:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", lowered)).items():
        h = zlib.crc32(run.encode(), before)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, typo: int = TYPO) -> DataFrame:
    """(word, n) over all texts. Tasks count first, Spark adds up."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(*b.columns, strict=True):
                for word, n in spelled(doc_id.as_py(), text.as_py() or "", least, typo):
                    held[word] += n
                if len(held) > COUNTED:
                    yield out()
        if held:
            yield out()

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cell() -> Column:
    """How many letters of each class a word has; classes are the letters' numbers by their remainder."""
    signs = ["".join(chr(c) for c in (*range(_FIRST, _FIRST + 26), *range(_LATIN, 0x100)) if (c - _FIRST if c < _LATIN else c - _LATIN + 26) % CLASSES == k) for k in range(CLASSES)]
    return F.array(*(F.length("word") - F.length(F.translate("word", x, "")) for x in signs))


def _neighbours() -> Column:
    """The cells whose words may be one edit away: one letter longer, or as long with at most one letter of another class.

    Of two cells of equal lengths only the larger meets the smaller, so each pair of cells meets once.
    """
    moved = lambda *steps: F.array(*(F.get("cell", F.lit(k)) + steps[k] for k in range(CLASSES)))
    unit = lambda *at: tuple(sum((x == k) - (x == -k - 1) for x in at) for k in range(CLASSES))
    longer = [moved(*unit(k)) for k in range(CLASSES)]
    equal = [moved(*s) for a in range(CLASSES) for b in range(CLASSES) if (s := unit(a, -b - 1)) > (0,) * CLASSES]
    return F.array(F.col("cell"), *longer, *equal)


def blocks(words: DataFrame) -> DataFrame:
    """(cell, part, words, counts): the words of each cell, dealt into parts by their hashes where a cell is large."""
    placed = words.withColumn("cell", _cell())
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"))
    length = F.aggregate("cell", F.lit(0), lambda a, x: a + x)
    room = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(F.lit(PART_LETTERS) / length)))
    sizes = broadcast_if_small(written(sizes.select("cell", F.ceil(F.col("size") / room).cast("int").alias("parts"))))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("own")).select("cell", "part", F.col("own.word").alias("words"), F.col("own.n").alias("counts"))


class Block:
    """Words of one length as code points and letter counts."""

    def __init__(self, words: list[str]) -> None:
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        m, self.length = self.codes.shape
        place = np.arange(m)[:, None] * _LETTERS + _letter(self.codes)
        kind = np.float32 if self.length < 2000 else np.float64  # in which sums of products are exact
        self.vectors = np.bincount(place.ravel(), minlength=m * _LETTERS).reshape(m, _LETTERS).astype(kind)
        self.squares = (self.vectors * self.vectors).sum(axis=1)


def near(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the words a[i], b[j] one edit apart; of a block with itself, i < j."""
    kind = np.float64 if np.float64 in (a.vectors.dtype, b.vectors.dtype) else np.float32
    squares = a.squares[:, None] + b.squares[None] - 2 * (a.vectors.astype(kind) @ b.vectors.astype(kind).T)
    close = squares <= 2
    if same:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    short, long = min(a.length, b.length), max(a.length, b.length)
    sure, step = np.zeros(len(i), bool), max(1, COMPARED * 64 // long)
    for at in range(0, len(i), step):
        x, y = a.codes[i[at : at + step]], b.codes[j[at : at + step]]
        stop = np.ones((len(x), 1), bool)
        front = np.argmax(np.hstack([x[:, :short] != y[:, :short], stop]), axis=1)
        back = np.argmax(np.hstack([(x[:, ::-1][:, :short] != y[:, ::-1][:, :short]), stop]), axis=1)
        sure[at : at + step] = (front + back >= short) if long > short else (front + back == short - 1)
    return i[sure], j[sure]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words (column word, each once, with n) exactly one edit apart."""
    prepare(words.sparkSession)
    own = written(blocks(words))
    left = own.select("cell", "part", F.col("words").alias("a"), F.col("counts").alias("an"), F.explode(_neighbours()).alias("other"))
    right = own.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("b"), F.col("counts").alias("bn"))
    met = left.join(right, "other").where("cell <> other or part <= other_part").select("a", "an", "b", "bn", (F.expr("cell = other and part = other_part")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, an, b, bn, same in zip(*batch.columns, strict=True):
                a, b, same = a.values, b.values, same.as_py()
                first = Block(a.to_pylist())
                i, j = near(first, first if same else Block(b.to_pylist()), same)
                for at in range(0, len(i), COMPARED):
                    p, q = pa.array(i[at : at + COMPARED]), pa.array(j[at : at + COMPARED])
                    w, n, v, m = a.take(p), an.values.take(p), b.take(q), bn.values.take(q)
                    yield pa.RecordBatch.from_arrays([w, n, v, m], names)
                    yield pa.RecordBatch.from_arrays([v, m, w, n], names)

    names = ["word", "n", "near", "near_n"]
    return met.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by jumps of doubling length until no root has a form. Forms never lead in a circle, as counts rise."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        remove(now)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FACTOR, typo: int = TYPO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least `least` letters and `least_count` occurrences.

    A null text has no words. A null id counts as an empty one where letters are dropped. Each row counts, repeated
    ones too. Of near words of equal counts the first in code-point order is the form. Extra columns are not read; no
    words give no rows.
    """
    words = written(counts(docs, id_col, text_col, least, typo).where(F.col("n") >= least_count))
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    enough = -F.col("top.less") >= factor * F.col("n")
    linked = written(best.select("word", "n_near", F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")))
    led = roots(linked.where("form is not null"))
    out = words.join(linked, "word", "left").join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return variants(read(spark, sf_dir, "documents"))
