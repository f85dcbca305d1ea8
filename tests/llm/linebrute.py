"""Line deduplication by comparing all pairs, for tests."""

import itertools
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import xxhash


def normalised(line):
    return re.sub(r"\s+", " ", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line)).strip().lower()


def simhash(words):
    values = Counter(xxhash.xxh64_intdigest(w, 42) for w in words)
    return sum(1 << b for b in range(64) if 2 * sum(n for v, n in values.items() if v >> b & 1) > len(words))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def blocks(words, similarity=0.8):
    """What lines meet in: blocks, words but for two, characters but for two."""
    n, hashed = len(words), [(xxhash.xxh64_intdigest(w, 42), w) for w in words]
    own, line = set(), " ".join(words)
    if n >= 10:
        bits = max(2, (n // 4).bit_length() - 1)
        times = Counter(words)
        held = {}
        for h, w in sorted((h, w) for h, w in hashed if times[w] == 1):
            held.setdefault((bits, h >> (64 - bits)), []).append(w)
        own |= {(k, tuple(sorted(v))) for k, v in held.items() if len(v) >= (3 if bits > 2 else 2)}
    if 2 <= n <= 10:
        own |= {("words", x) for k in range((n >= 3) + (n >= 5) + 1) for x in itertools.combinations(words, n - k)}
    if len(line) <= 14:
        own |= {("characters", x) for k in range(int((1 - similarity) * len(line) + 1e-6) + 1) for x in itertools.combinations(line, len(line) - k)}
    return own


def alike(a, b, similarity=0.8):
    allowed = int((1 - similarity) * max(len(a), len(b)) + 1e-6)
    return abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed


def meet(a, b, radius=16):
    short = min(len(a.split(" ")), len(b.split(" "))) < 10
    return not _blocks(a).isdisjoint(_blocks(b)) and (short or (_simhash(a) ^ _simhash(b)).bit_count() <= radius)


@lru_cache(maxsize=None)
def _blocks(line):
    return blocks(line.split(" "))


@lru_cache(maxsize=None)
def _simhash(line):
    return simhash(line.split(" "))


def dedup(docs, similarity=0.8, least_words=1):
    """docs: (doc_id, text) pairs with distinct ids. Returns {doc_id: text}."""
    places = [(d, i, normalised(x)) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    places = [(d, i, n) for d, i, n in places if n and len(n.split(" ")) >= least_words]
    norms = sorted({n for *_, n in places})
    own = {n: _blocks(n) for n in norms}
    parent = {n: n for n in norms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(norms, 2):
        if not own[a].isdisjoint(own[b]) and find(a) != find(b) and meet(a, b) and alike(a, b, similarity):
            parent[find(a)] = find(b)
    first = {}
    for d, i, n in places:
        g = find(n)
        first[g] = min(first.get(g, (d, i)), (d, i))
    drop = {(d, i) for d, i, n in places if first[find(n)] != (d, i)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop) for d, t in docs}
