"""Interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark and scored from memory-mapped sorted hash arrays.

Tasks count the n-grams of their texts and deal the distinct ones to shards by hash: bigrams by both words, trigrams by
their middle word, so that a shard knows how many words stand before each pair and what follows each context. Trigrams of
a frequent middle word are dealt by their last two words instead, and their contexts are reported to the shards of the
contexts' own hashes. A shard merges its n-grams, writes their sorted hashes and counts, and reports what it knows of
words. To score, workers map the arrays into memory and look up a block of sorted hashes at once.

Blobs name words of a book, frequent ones of a sample of the texts, by their place in it, and carry the hashes of others.
What the book holds changes how much is moved, and no count.

Texts are padded with order - 1 starts. At the highest order counts are occurrences, below it the number of different words
that stand before. Where a context was never seen, the shorter one's probability stands.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read, shared_dir, written

ORDER = 3
#: Text that one shard of the model stands for. The number of shards follows the corpus.
SHARD_BYTES = 16 << 20
#: Bits of the shard's number by which n-grams are dealt at once; more shards take another round of dealing.
DEAL_BITS = 10
#: Tokens that a task gathers before it counts or scores them, and words whose hash it remembers.
BLOCK_TOKENS, SCORE_TOKENS, REMEMBERED = 1_500_000, 400_000, 250_000
#: Words of the book, and bytes of text in the sample that it is counted in.
BOOK, SAMPLE_BYTES = 1 << 16, 32 << 20
#: A middle word is frequent if it has more than this part of a shard's share of all tokens.
FREQUENT = 1 / 16
#: Model files that a worker keeps mapped.
MAPPED = 1000
# No word holds a space, so these two stand beside all words.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"sentence start", b"sentence end"))
_WORD_FIELDS = ("count", "preceding", "total", "n1", "n2", "n3")
_U = np.uint64


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """The text's tokens: its words in lower case (A to Z), then the end."""
        words = (text or b"").lower().split()
        out = np.empty(len(words) + 1, dtype=np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        out[-1] = END
        return out


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context's hash and a word's; that of a trigram takes the first two words' for its context."""
    x = context * _U(0x9E3779B97F4A7C15) + word
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _columns(word: np.ndarray, starts: np.ndarray, order: int, start) -> list[np.ndarray]:
    """The words of each token's n-gram, the token's own last. starts: the texts' first places, which `start` stands before."""
    out = [word]
    for _ in range(order - 1):
        before = np.empty_like(word)
        before[1:], before[:1] = out[0][:-1], start
        before[starts] = start
        out.insert(0, before)
    return out


def _blocks(tokens: list[np.ndarray], order: int, most: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Slices of at most so many tokens, however long a text: (from, to, lead, words, starts), the words with `lead` earlier ones."""
    flat, starts = np.concatenate(tokens), np.cumsum([0, *map(len, tokens[:-1])])
    for lo in range(0, len(flat), most):
        hi, first = min(lo + most, len(flat)), max(lo - order + 1, 0)
        yield lo, hi, lo - first, flat[first:hi], starts[(starts >= first) & (starts < hi)] - first


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = _runs(ordered)
    return ordered[first], *(np.add.reduceat(v[order], first, dtype=np.int64) if len(keys) else v.astype(np.int64) for v in values)


def _slices(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and the places where."""
    order = np.argsort(shards.astype(np.uint32), kind="stable")
    first = _runs(shards[order])
    if not len(first):
        return
    for lo, hi in zip(first, np.append(first[1:], len(order)), strict=True):
        yield int(shards[order[lo]]), order[lo:hi]


# --- the book ---
class Book:
    """Frequent words, and which middle words are dealt by pairs. Its rows are bounded by BOOK, whatever the corpus."""

    def __init__(self, words: np.ndarray, frequent: np.ndarray | None) -> None:
        """words: the most frequent first. frequent: sorted; None for all words."""
        self.words, self.frequent = words, frequent
        self.places = np.argsort(words)
        self.ordered = words[self.places]

    def code(self, words: np.ndarray) -> np.ndarray:
        """Places in the book, -1 for words that it does not hold."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.ordered, words), len(self.ordered) - 1)
        return np.where(self.ordered[at] == words, self.places[at], -1)

    def by_pair(self, middle: np.ndarray) -> np.ndarray:
        if self.frequent is None or not len(self.frequent):
            return np.full(len(middle), self.frequent is None)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, middle), len(self.frequent) - 1)] == middle

    def dealt(self, columns: list[np.ndarray] | tuple[np.ndarray, ...]) -> np.ndarray:
        """The hashes that n-grams are dealt by."""
        pair = pair_key(columns[-2], columns[-1])
        return pair if len(columns) == 2 else np.where(self.by_pair(columns[1]), pair, columns[1])


def _book(texts: DataFrame, size: int, bits: int) -> Book:
    """The book of texts of so many bytes that are dealt to 2 ** bits shards, from some SAMPLE_BYTES of them, by their hash."""
    if size > SAMPLE_BYTES:
        texts = texts.where(F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) < F.lit((1 << 62) * SAMPLE_BYTES // size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            held = [known.of(text.as_py()) for text in b.column(0)]
            words, times = np.unique(np.concatenate([*held, np.full(len(held), START)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], ["word", "n"])

    counted = written(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.orderBy(F.desc("n"), "word").limit(BOOK).toArrow()
    words, n = np.array(top.column("word"), dtype=np.int64).view(np.uint64), np.array(top.column("n"), dtype=np.int64)
    often = n > FREQUENT * total / (1 << bits)
    # where even the book's last word is frequent, words outside it may be
    return Book(words, None if len(words) == BOOK and often[-1] else np.sort(words[often]))


# --- blobs: what moves between tasks ---
def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if most < 1 << 8 * n or n == 8))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in bytes, those of equal weight side by side, which compress better."""
    parts = []
    for a in map(_narrow, arrays):
        parts += [np.array([len(a), a.itemsize], dtype="<i8").tobytes(), np.ascontiguousarray(a.view("u1").reshape(-1, a.itemsize).T).tobytes()]
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstd.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, size = np.frombuffer(data, "<i8", 2, at).tolist()
        at += 16
        out.append(np.ascontiguousarray(np.frombuffer(data, "u1", n * size, at).reshape(size, n).T).reshape(-1).view(f"<u{size}"))
        at += n * size
    return out


def _grams_blob(columns: list[np.ndarray], times: np.ndarray, words: np.ndarray, codes: np.ndarray, book: int) -> bytes:
    """n-grams as columns of places in words, whose places in a book of so many words are codes; other words go along if they occur."""
    if len(words) > 16 * len(times):
        used = np.unique(np.concatenate(columns))
    else:
        mark = np.zeros(len(words), dtype=bool)
        for c in columns:
            mark[c] = True
        used = np.flatnonzero(mark)
    code = codes[used]
    own = code < 0
    code[own] = book + np.arange(own.sum())
    if len(words) > 16 * len(times):
        columns = [code[np.searchsorted(used, c)] for c in columns]
    else:
        table = np.empty(len(words), dtype=np.int64)
        table[used] = code
        columns = [table[c] for c in columns]
    return _pack(words[used[own]], times, *columns)


def _grams(blob: bytes, book: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    words, times, *columns = _unpack(blob)
    words = np.concatenate([book, words])
    return [words[c] for c in columns], times


def _rows(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["shard", "data"])


# --- files: the model's arrays ---
_MASK48, _MASK32 = _U((1 << 48) - 1), _U((1 << 32) - 1)


def _table(keys: np.ndarray, codes: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted keys by the 48 bits behind the shard's: where each value of the first 16 starts, the other 32, a byte of code each."""
    starts = np.searchsorted(keys >> _U(32), np.arange(1 << 16, dtype=np.uint64))
    return [np.append(starts, len(keys)).astype("<u4"), (keys & _MASK32).astype("<u4"), codes.astype("u1"), *extra]


def _below(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys << _U(bits)) >> _U(16) if bits else keys >> _U(16)


def _count_table(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Counts of 255 and more stand apart."""
    high = counts >= 255
    return _table(keys, np.minimum(counts, 255), [keys[high].astype("<u8"), counts[high].astype("<u8")])


def _context_table(keys: np.ndarray, stats: np.ndarray) -> list[np.ndarray]:
    """Contexts with (total, n1, n2, n3): the 255 most frequent such rows have a code, others stand apart."""
    small = stats.max(axis=1, initial=0) < 1 << 15
    packed = np.zeros(len(keys), dtype=np.uint64)
    for k, shift in enumerate((48, 32, 16, 0)):
        packed[small] |= stats[small, k].astype(np.uint64) << _U(shift)
    known, place, times = np.unique(packed, return_inverse=True, return_counts=True)
    best = np.argsort(-times, kind="stable")[:255]
    code = np.full(len(known), 255)
    code[best] = np.arange(len(best))
    codes = np.where(small, code[place], 255) if len(keys) else np.empty(0, dtype=np.int64)
    far = codes == 255
    rows = np.stack([(known[best] >> _U(s)) & _U(0xFFFF) for s in (48, 32, 16, 0)], axis=1) if len(keys) else np.zeros((0, 4))
    return _table(keys, codes, [rows.astype("<u8").reshape(-1), keys[far].astype("<u8"), stats[far].astype("<u8").reshape(-1)])


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays as one file whole under its name. A repeated attempt writes the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], dtype="<i8")
    with fs.open_output_stream(part, compression=None) as out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    fs.move(part, f"{path}/{name}")


@lru_cache(maxsize=MAPPED)
def _mapped(folder: str, name: str) -> list[np.ndarray] | None:
    """A file's arrays, mapped into memory; from a store without local paths they are read into it, and go when others come."""
    fs, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:  # nothing fell into this shard
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        data = np.memmap(path, dtype="u1", mode="r")
    else:
        with fs.open_input_stream(path, compression=None) as stream:
            data = np.frombuffer(stream.read(), dtype="u1")
    n = int(data[:8].view("<i8")[0])
    sizes, at, out = data[8 : 8 + 16 * n].view("<i8").reshape(-1, 2), 8 + 16 * n, []
    for length, item in sizes.tolist():
        out.append(data[at : at + length * item].view(f"<u{item}"))
        at += length * item + -(length * item) % 8
    return out


def _search(table: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that the table has: (which keys, where)."""
    starts, rest = table[0], table[1]
    head, tail = (keys >> _U(32)).astype(np.int64), (keys & _MASK32).astype(np.uint32)
    lo, hi = starts[head].astype(np.int64), starts[head + 1].astype(np.int64)
    end = hi
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (rest[np.minimum(mid, len(rest) - 1)] < tail)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    hit = np.flatnonzero(lo < end)
    hit = hit[rest[lo[hit]] == tail[hit]]
    return hit, lo[hit]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; one discount for all where a small corpus lacks some."""
    if not (n1 and n2):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, d2), (3, d3)))


def _discounted(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(counts - np.choose(np.minimum(counts, 3), [0.0, *d]), 0.0)


class Model:
    """What scoring needs besides the arrays: where they are, and the totals and discounts."""

    def __init__(self, folder: str, bits: int, order: int, book: Book, totals: dict[str, int], counted: list[list[int]]) -> None:
        """counted: per level, words first, the numbers of n-grams with counts 1, 2, 3, 4 and above 2."""
        self.folder, self.bits, self.order, self.book = folder, bits, order, book
        self.tokens, self.words, self.preceding = (totals[k] for k in ("tokens", "words", "preceding"))
        self.discount = [discounts(*c[:4]) for c in counted]
        d1, d2, d3 = self.discount[0]
        self.spare = d1 * counted[0][0] + d2 * counted[0][1] + d3 * counted[0][4]  # what the lowest level leaves for words never seen

    def _found(self, keys: np.ndarray, shards: np.ndarray, name: str, arrays: slice, bits: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """Per shard: a table, which keys it has, where, and the 48 bits behind their first `bits`."""
        for s, own in _slices(shards):
            table = (_mapped(self.folder, f"{name}-{s}") or [])[arrays]
            if table and len(table[1]):
                below = _below(keys[own], bits)
                hit, at = _search(table, below)
                yield table, own[hit], at, below[hit]

    def counts(self, keys: np.ndarray, shards: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for table, own, at, below in self._found(keys, shards, "grams", slice(0, 5) if level == self.order else slice(5, 10), self.bits if self.order == 2 else 0):
            out[own] = table[2][at]
            over = np.flatnonzero(out[own] == 255)
            out[own[over]] = table[4][np.searchsorted(table[3], below[over])]
        return out

    def contexts(self, keys: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """What follows contexts, whose second words are given."""
        out = np.zeros((len(keys), 4), dtype=np.int64)
        by_pair = self.book.by_pair(middle)
        for name, arrays, bits, asked, dealt in (("grams", slice(10, 16), 0, ~by_pair, middle), ("reports", slice(0, 6), self.bits, by_pair, keys)):
            asked = np.flatnonzero(asked)
            for table, own, at, below in self._found(keys[asked], _shard(dealt[asked], self.bits), name, arrays, bits):
                own, code = asked[own], table[2][at].astype(np.int64)
                near, far = np.flatnonzero(code < 255), np.flatnonzero(code == 255)
                out[own[near]] = table[3].reshape(-1, 4)[code[near]]
                out[own[far]] = table[5].reshape(-1, 4)[np.searchsorted(table[4], below[far])]
        return out

    def of_words(self, words: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(words), dtype=np.int64) for _ in _WORD_FIELDS]
        for s, own in _slices(_shard(words, self.bits)):
            stored = (_mapped(self.folder, f"reports-{s}") or [])[-7:]
            if stored and len(stored[0]):
                at = np.minimum(np.searchsorted(stored[0], words[own]), len(stored[0]) - 1)
                hit = stored[0][at] == words[own]
                for values, field in zip(out, stored[1:], strict=True):
                    values[own[hit]] = field[at[hit]]
        return out

    def score(self, tokens: list[np.ndarray], most: int = SCORE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, log10 probability under the add-one unigram model and under this one."""
        parts = [self._score(*(c[lead:] for c in _columns(words, starts, self.order, START))) for _, _, lead, words, starts in _blocks(tokens, self.order, most)]
        starts = np.cumsum([0, *map(len, tokens[:-1])])
        return tuple(np.add.reduceat(np.concatenate(x), starts) for x in zip(*parts, strict=True))

    def _score(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of each token."""
        word, context = columns[-1], columns[-2]
        known, place = np.unique(np.concatenate([word, context]), return_inverse=True)
        count, preceding, total, n1, n2, n3 = self.of_words(known)
        of_word, of_context = place[: len(word)], place[len(word) :]

        low = (_discounted(preceding, self.discount[0]) + self.spare / (self.words + 1)) / self.preceding if self.preceding else np.full(len(known), 1.0 / (self.words + 1))
        p, d = low[of_word], self.discount[1]
        pair = pair_key(context, word)
        shards = _shard(self.book.dealt(columns), self.bits)
        keys, first, at = np.unique(pair, return_index=True, return_inverse=True)
        seen = _discounted(self.counts(keys, shards[first], 2), d)[at]
        whole, spare = total[of_context], (d[0] * n1 + d[1] * n2 + d[2] * n3)[of_context]
        p = np.where(whole > 0, (seen + spare * p) / np.maximum(whole, 1), p)
        if self.order == 3:
            d, before = self.discount[2], pair_key(columns[0], context)
            keys, first, at = np.unique(pair_key(before, word), return_index=True, return_inverse=True)
            seen = _discounted(self.counts(keys, shards[first], 3), d)[at]
            keys, first, at = np.unique(before, return_index=True, return_inverse=True)
            stats = self.contexts(keys, context[first])
            whole, spare = stats[:, 0][at], (stats[:, 1:] @ np.array(d))[at]
            p = np.where(whole > 0, (seen + spare * p) / np.maximum(whole, 1), p)
        base = np.log10((count[of_word] + 1) / (self.tokens + self.words + 1))
        return (count[of_word] > 0).astype(np.int64), base, np.log10(p)


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)] + [int((x > 2).sum())]


def _by_context(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per context: total, and the numbers of counts 1, 2 and above 2."""
    return _sums(keys, counts, *(x.view(np.uint8) for x in (counts == 1, counts == 2, counts > 2)))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES, deal_bits: int = DEAL_BITS, block_tokens: int = BLOCK_TOKENS) -> Model | None:
    """Count all texts of docs; None without rows. A null text is an empty one."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_dir(spark)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not rows:
        return None
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / shard_bytes))))
    book = _book(texts, size, bits)

    def blobs_of(columns: list[np.ndarray], times: np.ndarray, words: np.ndarray, codes: np.ndarray, to: int) -> pa.RecordBatch:
        shards = _shard(book.dealt([words[c] for c in columns]), to)
        return _rows([(s, _grams_blob([c[at] for c in columns], times[at], words, codes, len(book.words))) for s, at in _slices(shards)])

    def by_code(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, those of the book first and the frequent ones before others; their codes; places in them instead of those in words."""
        codes = book.code(words)
        at = np.argsort(np.where(codes < 0, len(book.words), codes), kind="stable")
        place = np.empty_like(at)
        place[at] = np.arange(len(at))
        return words[at], codes[at], place[ids]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = Words(), [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            for _, _, lead, own, starts in _blocks(held, order, block_tokens):
                words, codes, ids = by_code(*np.unique(np.append(own, START), return_inverse=True))
                columns = [c[lead:] for c in _columns(ids[:-1].astype(np.uint64), starts, order, _U(ids[-1]))]
                # the last two words first, so that n-grams with equal ones lie together
                width = _U(max(int(len(words) - 1).bit_length(), 1))
                both = np.zeros(len(columns[0]), dtype=np.uint64)
                for c in (*columns[-2:], *columns[:-2]):
                    both = (both << width) | c
                both.sort()
                first = _runs(both)
                times, both, mask = np.diff(np.append(first, len(both))), both[first], (_U(1) << width) - _U(1)
                found = [(both >> (width * _U(k)) & mask).astype(np.int64) for k in range(order)]  # the last packed first
                found = [*found[: order - 2], found[-1], found[-2]]
                yield blobs_of(found, times, words, codes, min(bits, deal_bits))

        for b in batches:
            for text in b.column(0):
                held.append(known.of(text.as_py()))
                n += len(held[-1])
                if n >= block_tokens:
                    yield from merged()
                    held, n = [], 0
        if held:
            yield from merged()

    def deal_on(done: int, to: int):
        """Splits the blobs of 2 ** done shards into those of 2 ** to, gathering a block's worth first and adding up equal n-grams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def split() -> pa.RecordBatch:
                parts, times = zip(*held, strict=True)
                columns, counts = [np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(times)
                words, codes, ids = by_code(*np.unique(np.concatenate(columns), return_inverse=True))
                found = np.split(ids, order)
                at = np.lexsort((*found[:-2], found[-1], found[-2]))
                found = [c[at] for c in found]
                first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in found], axis=0)))
                return blobs_of([c[first] for c in found], np.add.reduceat(counts[at], first, dtype=np.int64), words, codes, to)

            for b in batches:
                for blob in b.column(1):
                    held.append(_grams(blob.as_py(), book.words))
                    n += len(held[-1][1])
                    if n >= block_tokens:
                        yield split()
                        held, n = [], 0
            if held:
                yield split()

        return run

    def merge_grams(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        # what is no longer needed goes at once: a worker's memory holds few arrays of a shard's length
        parts = [_grams(blob.as_py(), book.words) for blob in table.column("data")]
        times = np.concatenate([own for _, own in parts])
        columns = [np.concatenate([own.pop(0) for own, _ in parts]) for _ in range(order)]
        del parts
        whole = pair_key(columns[0], columns[1]) if order == 2 else pair_key(pair_key(columns[0], columns[1]), columns[2])
        at = np.argsort(whole)
        whole = whole[at]
        first = _runs(whole)
        n, whole, at = np.add.reduceat(times[at], first, dtype=np.int64), whole[first], at[first]
        del times, first
        tables = _count_table(_below(whole, bits if order == 2 else 0), n)  # only bigrams are dealt by their own hash
        del whole
        for k in range(order):
            columns[k] = columns[k][at]
        del at
        levels, made = [_counts_of_counts(n)], []
        occurrences = _sums(columns[-1], n)
        if order == 3:
            before, by_pair = pair_key(columns[0], columns[1]), book.by_pair(columns[1])
            columns[0] = None
            found = _by_context(before[by_pair], n[by_pair])
            for target, own in _slices(_shard(found[0], bits)):
                keys = _below(found[0][own], bits)
                made.append((target, 0, _pack(np.diff(keys, prepend=_U(0)) & _MASK32, np.diff(keys, prepend=_U(0)) >> _U(32), *(f[own] for f in found[1:]))))
            keys, *found = _by_context(before[~by_pair], n[~by_pair])
            del before, by_pair, n
            found = np.stack([_narrow(x) for x in found], axis=1)
            contexts = _context_table(_below(keys, 0), found)
            del keys, found
            suffix = pair_key(columns[1], columns[2])
            at = np.argsort(suffix)
            suffix = suffix[at]
            first = _runs(suffix)
            n = np.diff(np.append(first, len(at)))
            tables += _count_table(_below(suffix[first], 0), n) + contexts
            levels.append(_counts_of_counts(n))
            columns = [c[at[first]] for c in columns[1:]]
            del suffix, at, first
        _save(folder, f"grams-{s}", tables)
        del tables
        # words: occurrences, different words before, and what they need as contexts of pairs
        context, word = columns
        counted = (occurrences, _sums(word, np.ones(len(word), dtype=np.uint8)), _sums(context, n, *(x.view(np.uint8) for x in (n == 1, n == 2, n > 2))))
        sizes = [len(keys) for keys, *_ in counted]
        none = lambda k: np.zeros(k, dtype=np.int64)
        spread = [np.concatenate([none(sum(sizes[:i])), x, none(sum(sizes[i + 1 :]))]) for i, (_, *values) in enumerate(counted) for x in values]
        found = _sums(np.concatenate([keys for keys, *_ in counted]), *spread)
        made += [(target, 1, _pack(*(f[own] for f in found))) for target, own in _slices(_shard(found[0], bits))]
        tally = [x for level in levels for x in level] + [0] * (10 - 5 * len(levels))
        out = {"shard": pa.array([t for t, _, _ in made], pa.int64()), "kind": pa.array([x for _, x, _ in made], pa.int32()), "data": pa.array([x for _, _, x in made], pa.binary())}
        return pa.table(out | {f"c{i}": pa.array([v] + [0] * (len(made) - 1), pa.int64()) for i, v in enumerate(tally)})

    def merge_reports(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        kinds = np.array(table.column("kind"))
        blobs, tables = table.column("data"), []
        if (kinds == 0).any():
            parts = [_unpack(blobs[int(i)].as_py()) for i in np.flatnonzero(kinds == 0)]
            keys = np.concatenate([np.cumsum((p[1].astype(np.uint64) << _U(32)) | p[0].astype(np.uint64), dtype=np.uint64) for p in parts])
            found = _sums(keys, *(np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(2, 6)))
            tables = _context_table(found[0], np.stack(found[1:], axis=1))
        row, found = [0] * 8, [np.empty(0, dtype=np.int64)] * 7
        if (kinds == 1).any():
            parts = [_unpack(blobs[int(i)].as_py()) for i in np.flatnonzero(kinds == 1)]
            hashes, *values = (np.concatenate([p[i].astype(np.uint64 if not i else np.int64) for p in parts]) for i in range(7))
            found = _sums(hashes, *values)
            row = [int(found[1].sum()), int((found[1] > 0).sum()), int(found[2].sum()), *_counts_of_counts(found[2])]
        _save(folder, f"reports-{s}", [*tables, found[0].astype("<u8"), *map(_narrow, found[1:])])
        row += [sum(table.column(f"c{i}").to_pylist()) for i in range(10)]
        return pa.table({f"w{i}": pa.array([v], pa.int64()) for i, v in enumerate(row)})

    blobs, done = texts.mapInArrow(count, "shard long, data binary"), min(bits, deal_bits)
    while done < bits:
        to = min(bits, done + deal_bits)
        blobs, done = blobs.repartition("shard").mapInArrow(deal_on(done, to), "shard long, data binary"), to
    tally = ", ".join(f"c{i} long" for i in range(10))
    reports = blobs.groupBy("shard").applyInArrow(merge_grams, "shard long, kind int, data binary, " + tally)
    merged = written(reports.groupBy("shard").applyInArrow(merge_reports, ", ".join(f"w{i} long" for i in range(18))))
    w = list(merged.agg(*(F.sum(f"w{i}") for i in range(18))).first())
    levels = [w[3:8], w[8:13]] if order == 2 else [w[3:8], w[13:18], w[8:13]]
    return Model(folder, bits, order, book, {"tokens": w[0], "words": w[1], "preceding": w[2]}, levels)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = SCORE_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row: log10 probabilities of the whole text, its end included.

    Repeated rows and rows with null ids are scored like any other; a null text is an empty one. Without a model
    every word is unknown and the two scores are 0. Extra columns are not read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, held, n = Words(), [], [], 0

        def scored() -> pa.RecordBatch:
            known, base, own = model.score(held, block_tokens) if model else (np.zeros(len(held), dtype=np.int64), *np.zeros((2, len(held))))
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in held], pa.int64()), pa.array(known), pa.array(base), pa.array(own)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for doc_id, text in zip(*b.columns, strict=True):
                ids.append(doc_id.as_py())
                held.append(words.of(text.as_py()))
                n += len(held[-1])
                if n >= block_tokens:
                    yield scored()
                    ids, held, n = [], [], 0
        if held:
            yield scored()

    return source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds column perplexity, per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """All documents, under the model of those whose id's remainder is not 2. A null id is learned from."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    found = score(docs, model)
    return found.withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens if model else 0).cast("long"))
