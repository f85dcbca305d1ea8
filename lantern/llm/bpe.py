"""Byte-level BPE over whole texts, without a regular expression: encoding to token ids, and decoding back to bytes.

Where pre-tokens begin is found by a finite automaton over classes of code points. A run of symbols acts on the
automaton's states as a function, and functions compose associatively: blocks of a text are composed side by side,
a scan over the blocks' functions gives each block its entry state, and the states inside follow from it. What must
be known of the next two characters (is this white space the last of its run, is this apostrophe a contraction) is
part of a character's symbol. The slices between boundaries are merged once each and remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read

#: Characters that are scanned at a time, in numpy arrays of some 40 bytes a character.
WINDOW = 1 << 20
#: Bytes up to which a pre-token's pairs are simply looked through for the lowest rank; longer ones keep them in a heap.
SHORT = 40
#: Pre-tokens that a worker remembers, and the length up to which it does; about 100 MB.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64

# Classes of code points. Letters that a contraction needs have their own.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _QUOTE, _STMD, _R, _E, _V, _LL, _END = range(12)
# Symbols: a class and what follows it. Q1, Q2: a quote before a contraction of one or two letters. SP, WS: a blank or
# other white space right before a character that is not white space; IN: any other white space. CUT: between two texts.
_SYM_L, _SYM_N, _SYM_O, _SYM_Q1, _SYM_Q2, _SYM_SP, _SYM_WS, _SYM_IN, _SYM_CUT = range(9)
# States: what the character before belongs to. ENDED: a pre-token that nothing can join. TWO, ONE: a contraction that
# still lacks as many letters.
_ENDED, _IN_L, _IN_N, _IN_O, _AFTER_BLANK, _IN_WHITE, _TWO, _ONE = range(8)
_STATES, _BITS = 8, 4


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a pre-token begin) by symbol and state."""
    after = np.zeros((1 << _BITS, _STATES), np.uint8)
    begins = np.ones((1 << _BITS, _STATES), bool)
    for symbol, run in ((_SYM_L, _IN_L), (_SYM_N, _IN_N), (_SYM_O, _IN_O)):
        after[symbol] = run
        begins[symbol, [run, _AFTER_BLANK]] = False
    after[_SYM_L, [_TWO, _ONE]] = _ONE, _ENDED
    begins[_SYM_L, [_TWO, _ONE]] = False
    for symbol, letters in ((_SYM_Q1, _ONE), (_SYM_Q2, _TWO)):  # a contraction, unless the quote joins what stands before
        after[symbol] = letters
        after[symbol, [_IN_O, _AFTER_BLANK]] = _IN_O
        begins[symbol, [_IN_O, _AFTER_BLANK]] = False
    after[_SYM_SP] = _AFTER_BLANK
    after[_SYM_IN] = _IN_WHITE
    begins[_SYM_IN, _IN_WHITE] = False
    return after, begins


AFTER, BEGINS = _automaton()
#: Three symbols' functions composed, by the three symbols' bits.
_THREE = np.stack([AFTER[c][AFTER[b][AFTER[a]]] for a in range(16) for b in range(16) for c in range(16)]).reshape(-1)
#: Triples of symbols in a block.
_BLOCK = 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point. Letters and numbers are those of the library that the ids must agree with."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, property_ in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"\s")):
        own = tiktoken.Encoding("class", pat_str=property_, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[_codes(own.decode(own.encode_ordinary(every)))] = kind
    for signs, kind in ((" ", _BLANK), ("'", _QUOTE), ("stmd", _STMD), ("r", _R), ("e", _E), ("v", _V), ("l", _LL)):
        table[_codes(signs)] = kind
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def symbols(kinds: np.ndarray, n: int) -> np.ndarray:
    """Of the first n characters, given the classes of at least two more (_END beyond a text)."""
    k, k1, k2 = kinds[:n], kinds[1 : n + 1], kinds[2 : n + 2]
    out = np.array([_SYM_L, _SYM_N, _SYM_O, _SYM_SP, _SYM_WS, _SYM_O, *[_SYM_L] * 5, _SYM_CUT], np.uint8)[k]
    white = (k == _BLANK) | (k == _WHITE)
    out[white & ((k1 == _BLANK) | (k1 == _WHITE) | (k1 == _END))] = _SYM_IN
    if (quote := np.flatnonzero(k == _QUOTE)).size:
        a, b = k1[quote], k2[quote]
        out[quote[a == _STMD]] = _SYM_Q1
        out[quote[(b == _E) & ((a == _R) | (a == _V)) | (a == _LL) & (b == _LL)]] = _SYM_Q2
    return out


def scan(symbol: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """(the state before each symbol, the state after all), by composing the symbols' functions."""
    size = 3 * _BLOCK
    n, blocks = len(symbol), -(-len(symbol) // size)
    own = np.full(blocks * size, _SYM_CUT, np.uint8)
    own[:n] = symbol
    parts = own.reshape(-1, 3).astype(np.uint16)
    triple = (((parts[:, 0] << 2 * _BITS) | (parts[:, 1] << _BITS) | parts[:, 2]) << 3).reshape(blocks, _BLOCK)
    whole = np.tile(np.arange(_STATES, dtype=np.uint8), (blocks, 1))  # each block's function, by entry state
    for j in range(_BLOCK):
        whole = _THREE[triple[:, j, None] + whole]
    step = 1
    while step < blocks:  # of all blocks up to each, in doubling steps
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[entry], whole[:-1, entry]]).astype(np.uint8)
    before = np.empty((blocks, _BLOCK, 3), np.uint8)
    for j in range(_BLOCK):
        before[:, j, 0] = state
        state = _THREE[triple[:, j] + state]
    own = own.reshape(blocks, _BLOCK, 3)
    before[..., 1] = AFTER[own[..., 0], before[..., 0]]
    before[..., 2] = AFTER[own[..., 1], before[..., 1]]
    before = before.reshape(-1)[:n]
    return before, int(AFTER[symbol[-1], before[-1]]) if n else entry


def boundaries(text: str, cuts: np.ndarray | None = None, window: int = WINDOW) -> np.ndarray:
    """Where the pre-tokens of text begin, its end included. Each position in cuts holds a character that only parts two texts."""
    table, found, state, n = classes(), [], _ENDED, len(text)
    cuts = np.zeros(0, np.int64) if cuts is None else cuts
    for a in range(0, n, window):
        size = min(window, n - a)
        kinds = np.full(size + 2, _END, np.uint8)
        codes = _codes(text[a : a + size + 2])
        kinds[: len(codes)] = table[codes]
        kinds[cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + size + 2)] - a] = _END
        symbol = symbols(kinds, size)
        before, state = scan(symbol, state)
        found.append(np.flatnonzero(BEGINS[symbol, before]) + a)
    return np.concatenate([*found, [n]]).astype(np.int64)


class Encoder(dict):
    """The ids of a pre-token, as little-endian unsigned 32-bit integers, by its text."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}

    def __missing__(self, part: str) -> bytes:
        raw = part.encode()
        rank = self.ranks.get(raw)
        ids = np.array([rank] if rank is not None else merged(raw, self.ranks), "<u4").tobytes()
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text. The texts are scanned as one, with a character between them."""
        text = "\n".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        cuts = np.cumsum(lengths + 1)[:-1] - 1
        found = boundaries(text, cuts)
        ends = np.concatenate([np.searchsorted(found, cuts), [len(found) - 1]]).tolist()
        at = found.tolist()
        out, first = [], 0
        for last in ends:
            out.append(b"".join([self[text[a:b]] for a, b in pairwise(at[first : last + 1])]))
            first = last + 1  # behind the character between
        return out


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of all neighbours the pair of lowest rank merges, the leftmost of equals, until none has a rank."""
    return _merged_short(raw, ranks) if len(raw) <= SHORT else _merged_long(raw, ranks)


def _merged_short(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [raw[i : i + 1] for i in range(len(raw))]
    pairs = [ranks.get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
    while pairs and (low := min(pairs)) < _NONE:
        i = pairs.index(low)
        del pairs[i]
        parts[i] += parts.pop(i + 1)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[x] for x in parts]


_NONE = 1 << 32


def _merged_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Neighbours wait in a heap, so a pre-token of n bytes takes some n log n steps."""
    n = len(raw)
    end = list(range(1, n + 1))  # of the part that begins here; 0: none does
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle == n or not end[middle] or end[middle] != stop:
            continue  # one of the two has merged meanwhile
        end[i], end[middle] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(raw[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (before := left[i]) >= 0 and (r := ranks.get(raw[before:stop])) is not None:
            heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> tuple[list[bytes], np.ndarray]:
    """(bytes, their number) by id."""
    by_id = {i: raw for raw, i in _encoder(path).ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    return tokens, np.fromiter(map(len, tokens), np.int64, len(tokens))


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a window's characters together; a longer text is one of its own."""
    first = size = 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) > WINDOW:
            yield first, i
            first, size = i, 0
        size += len(x)
    if texts:
        yield first, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ends) per input row, by the ranks in the file at path.

    ids are little-endian unsigned 32-bit integers, and so are ends: of each token, the byte of the text behind it. A
    null text counts as empty and has no tokens. Null and repeated ids and repeated rows stay, extra columns are not
    read, no rows give no rows. Long texts are scanned in windows. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (_, lengths) = _encoder(path), _tokens(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in _lots(texts):
                ids = encoder.encode(texts[first:last])
                ends = [np.cumsum(lengths[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), n, pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "n_tokens", "ids", "ends"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends binary")


def decode(encoded: DataFrame, path: str, first_byte: int | None = None, last_byte: int | None = None) -> DataFrame:
    """encoded with `decoded`: the bytes that the ids stand for; by the offsets kept in `ends`, only those from first_byte to before last_byte.

    Ids without a token, and offsets that are not those of the ids, are an error. Null ids give null.
    """
    prepare(encoded.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary"
    names, at_ids, at_ends = [*encoded.columns, "decoded"], encoded.columns.index("ids"), encoded.columns.index("ends")
    low, high = first_byte or 0, last_byte

    def one(ids: bytes | None, ends: bytes | None) -> bytes | None:
        if ids is None:
            return None
        tokens, lengths = _tokens(path)
        own = np.frombuffer(ids, "<u4")
        stops = np.frombuffer(ends or b"", "<u4").astype(np.int64)
        if own.size and own.max() >= len(tokens) or not np.array_equal(np.diff(stops, prepend=0), lengths[own]):
            raise ValueError("ids and offsets do not belong together")
        if not low and high is None:
            return b"".join(map(tokens.__getitem__, own.tolist()))
        a, b = int(np.searchsorted(stops, low, "right")), len(own) if high is None else int(np.searchsorted(stops, high, "left")) + 1
        start = int(stops[a - 1]) if a else 0
        return b"".join(map(tokens.__getitem__, own[a:b].tolist()))[low - start : None if high is None else max(0, high - start)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                found = [one(x.as_py(), y.as_py()) for x, y in zip(part.column(at_ids), part.column(at_ends), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names)

    return encoded.mapInArrow(run, schema)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded, decoded and digested."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(read(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
