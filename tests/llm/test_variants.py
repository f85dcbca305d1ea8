"""Spelling variants against plain neighbours by every possible edit."""

import random
import re
import zlib
from collections import Counter

import pyarrow.dataset as ds
from lantern.llm import variants
from lantern.llm.queries import queries

SF = "/root/testdata/sf0.001"
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def plain(texts, least=6, least_count=5, factor=5, typo=199):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typo == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= least_count}
    near = {}
    for w in n:
        edits = {w[:i] + a + w[i + d :] for i in range(len(w) + 1) for a in ("", *LETTERS) for d in (0, 1) if i + d <= len(w)} - {w}
        near[w] = [x for x in edits if x in n]
    form = {}
    for w, own in near.items():
        if own and n[best := min(own, key=lambda x: (-n[x], x))] >= factor * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query(spark):
    texts = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    got = queries()["op13_spelling_variants"](spark, SF)
    assert got.count() == len(want := plain([(r["doc_id"], r["text"]) for r in texts])) and rows(got) == want


def test_many_close_words(spark, docs, monkeypatch):
    random.seed(3)
    stems = ["abcdef", "abcdéf", "bcdefg", "aaaaaa", "aabbaa", "ÿÀ×÷ßé"]
    words = set(stems)
    for _ in range(400):
        w = random.choice(sorted(words))
        i, a = random.randrange(len(w)), random.choice("abcdefé÷À")
        words.add(random.choice([w[:i] + w[i + 1 :], w[:i] + a + w[i:], w[:i] + a + w[i + 1 :]]))
    texts = [(i, " ".join([w] * random.choice((1, 2, 11, 60)))) for i, w in enumerate(sorted(words))] * 2
    want = plain(texts, 4, 2, 5)
    assert any(f and r != f for _, f, r, *_ in want) and max(x[4] for x in want) > 8
    assert rows(variants.variants(docs(*texts), least=4, least_count=2)) == want
    monkeypatch.setattr(variants, "PART_WORDS", 3)  # every block in many parts
    assert rows(variants.variants(docs(*texts), least=4, least_count=2)) == want


def test_odd_rows(spark, odd, docs):
    assert rows(variants.variants(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    clashing = odd.withColumns({"word": odd["text"], "n": odd["doc_id"], "form": odd["lang"]})
    assert rows(variants.variants(clashing)) == rows(variants.variants(odd))
    assert variants.variants(odd.where("false")).count() == variants.variants(odd.where("text is null")).count() == 0
    long = "ab" * 30_000
    texts = [(1, f"{long} " * 5 + f"{long}a " * 25 + "Ärger ÄRGERN " * 6 + "ärgern " * 40)]
    got = rows(variants.variants(docs(*texts)))
    want = {(long, f"{long}a", f"{long}a", 5, 1, 25), (f"{long}a", None, f"{long}a", 25, 1, None)}
    assert {x for x in got if len(x[0]) > 100} == want and {x[0] for x in got if len(x[0]) < 100} == {"Ärgern", "ärgern"}
    assert ("Ärgern", "ärgern", "ärgern", 6, 1, 40) in got


def test_a_task_hands_counts_on(docs, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 2)
    texts = [(i, f"alphabet word{i} alphabet betamax gammaray") for i in range(30)]
    assert rows(variants.variants(docs(*texts), least_count=1)) == plain(texts, least_count=1)
