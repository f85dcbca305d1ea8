"""Byte-level BPE against the library whose ids it must give."""

import base64
import hashlib
import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from lantern.llm import bpe
from lantern.llm.queries import queries

SF = "/root/testdata/sf0.001"
SIGNS = "aslltrevmd'' \n\t  1２éÀ!.,—　\x85\x1c日本語'’SТт\U0001f600́"


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, lambda text: np.array(own.encode_ordinary(text), "<u4").tobytes()


def test_ids_of_any_text(library):
    path, want = library
    encoder = bpe.Encoder(path)
    random.seed(1)
    for _ in range(1500):
        texts = ["".join(random.choice(SIGNS) for _ in range(random.randrange(60))) for _ in range(random.randrange(1, 6))]
        assert encoder.encode(texts) == list(map(want, texts)), texts
    for text in ("'s's'll've'x 's", "''s !'s a's", "  \n  x", "x  ", " ", "\n\nx", "'", "'l", "a'", "I'LL i'll"):
        assert encoder.encode([text]) == [want(text)], text


def test_every_code_point(library):
    path, want = library
    encoder = bpe.Encoder(path)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000))]
    for i in range(0, len(points), 500):
        text = " ".join(f"a{c}1{c}!" for c in points[i : i + 500])
        assert encoder.encode([text]) == [want(text)]


def test_windows_and_blocks_do_not_matter():
    random.seed(2)
    text = "".join(random.choice(SIGNS) for _ in range(20_000))
    whole = bpe.boundaries(text)
    for window in (1, 2, 7, 191, 192, 193, 5000):
        assert np.array_equal(bpe.boundaries(text[:2000] if window < 7 else text, window=window), bpe.boundaries(text[:2000]) if window < 7 else whole)


def test_scan_equals_stepping():
    rng = np.random.default_rng(3)
    symbol = rng.integers(0, 9, 3000).astype(np.uint8)
    for entry in range(8):
        before, last = bpe.scan(symbol, entry)
        state = entry
        for s, b in zip(symbol.tolist(), before.tolist(), strict=True):
            assert b == state
            state = int(bpe.AFTER[s, state])
        assert last == state
    assert bpe.scan(symbol[:0], 3)[1] == 3


def test_long_pre_tokens_merge_alike(library):
    path, want = library
    ranks = bpe.Encoder(path).ranks
    random.seed(4)
    for n in (2, 39, 40, 41, 42, 500):
        for _ in range(60):
            raw = "".join(random.choice("abeinorst ") for _ in range(n)).encode()
            assert bpe._merged_short(raw, ranks) == bpe._merged_long(raw, ranks)
    text = "ab" * 100_000
    assert bpe.Encoder(path).encode([text]) == [want(text)]


def test_query(spark, library):
    _, want = library
    texts = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in queries()["op11_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(texts)
    for r in texts:
        ids = want(r["text"] or "")
        mine = got[r["doc_id"]]
        assert (mine.n_tokens, mine.ids_sha256, mine.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_odd_rows(spark, library, odd):
    path, want = library
    clashing = odd.withColumns({"ids": odd["lang"], "ends": odd["source"], "decoded": odd["lang"]})
    for rows in (odd, clashing):
        got = bpe.decode(bpe.encode(rows, path), path).collect()
        assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=str) == sorted(((r.doc_id, (r.text or "").encode()) for r in odd.collect()), key=str)
        assert sorted(bytes(r.ids) for r in got) == sorted(want(r.text or "") for r in odd.collect())
    assert bpe.decode(bpe.encode(odd.where("false"), path), path).count() == 0


def test_offsets_decode_a_part(spark, library, docs):
    path, _ = library
    text = "Ein naïves Beispiel — 日本語 with words"
    coded = bpe.encode(docs((1, text), (2, ""), (3, None)), path).persist()
    for a, b in ((0, 5), (4, 9), (3, 100), (7, 7), (15, 24), (0, 0)):
        got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, path, a, b).collect()}
        assert got == {1: text.encode()[a:b], 2: b"", 3: b""}, (a, b)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="do not belong together"):
        bpe.decode(coded.withColumn("ends", F.lit(b"\x01\x00\x00\x00")), path).collect()


def test_scratch_folders_belong_to_one_thread(spark):
    import threading
    from pathlib import Path

    from lantern.llm.common import scratch, shared_dir

    found = {}

    def other():
        found["dir"] = Path(shared_dir(spark).removeprefix("file:"))
        found["dir"].mkdir()

    with scratch(spark):
        mine = Path(shared_dir(spark).removeprefix("file:"))
        mine.mkdir()
        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert not mine.exists() and found["dir"].exists()
