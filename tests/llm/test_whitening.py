"""Whitening against a plain form with numpy's own eigenvalues, and exact integers."""

from fractions import Fraction

import numpy as np
import pyarrow.dataset as ds
import pytest
from lantern.llm import whitening
from lantern.llm.queries import queries

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def check_pairs(a, k):
    values, vectors = whitening.leading(a, k)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    size = max(np.abs(want).max(), np.finfo(float).tiny)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-11
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * size
    return values


def test_leading_pairs():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    for n in (1, 2, 3, 17, 64):
        x = rng.standard_normal((n, n))
        assert len(check_pairs(x @ x.T, min(n, 32))) == min(n, 32)
    for values in (np.repeat([9.0, 9, 2, 1], 16), np.concatenate([[1], np.full(63, 1e-6)]), np.arange(64.0), 10.0 ** -np.arange(0, 16, 0.25)):
        check_pairs((q * values) @ q.T, 32)
        check_pairs(np.diag(values), 32)
    assert len(check_pairs(np.ones((64, 64)), 32)) == 1 and len(whitening.leading(np.zeros((5, 5)), 3)[0]) == 0
    w = np.diag(np.abs(np.arange(-32, 32.0))) + np.diag(np.ones(63), 1) + np.diag(np.ones(63), -1)
    check_pairs(w, 32)


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[4, 11]] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.uniform(-4, 4, 200)
    assert np.array_equal(whitening.below(d, e, at), (values[None] < at[:, None]).sum(axis=1))


def plain(vectors, k=32):
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    z = [[n * v[j] - s[j] for j in range(d)] for v in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, [sum(c * c for c in r) for r in z], (np.array(z, float) / n) @ q / np.sqrt(values), values / np.trace(cov), values


def test_query(spark):
    rows = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pylist()
    n, deviation, white, explained, values = plain([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries()["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == n * 32
    mine = np.empty((n, 32))
    for r in got:
        i = place[r.vec_id]
        mine[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[i] == r.deviation_wide and r.identity_error <= 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert values[0] > values[-1]
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_partitions_do_not_matter(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(x).collect()} for x in (rows.repartition(7), rows.coalesce(1)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)  # products of rows in other blocks round otherwise


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 0.5], 0), (1, [1.0, 2.0, 0.5], 0), (None, [3.0, -1.0, 0.0], None), (4, None, 1), (5, [1.0, None, 2.0], 1), (6, [1.0, inf, 2.0], 1), (7, [nan, 1.0, 2.0], 1), (8, [0.0, 5.0, 9.0], 1), (9, [-2.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, VEC)
    n, deviation, _, explained, _ = plain([v for i, v, _ in rows if i not in (4, 5, 6, 7)], 3)
    for x in (df, df.withColumnRenamed("label", "component").withColumn("n", df["vec_id"])):
        got = whitening.whiten(x).collect()
        assert len(got) == 5 * 3 and {r.n for r in got} == {5} and sorted(int(r.deviation) for r in got) == sorted(deviation * 3)
        assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 1 for r in got) == 6
        assert all(abs(r.explained - explained[r.component - 1]) < 1e-12 for r in got) and got[0].identity_error < 1e-12
    for none in (df.where("false"), df.where("vec_id in (4, 5)"), df.where("vec_id = 1"), spark.createDataFrame([(1, [], 0)], VEC)):
        assert whitening.whiten(none).count() == 0  # no rows, or no spread
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], VEC)).count()


def test_large_entries_stay_exact(spark):
    big = [[1e15, 3.0], [-1e15, 5.0], [5e14, -9.0]]
    n, deviation, _, _, _ = plain(big, 2)
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, int(r.deviation)) for r in got} == set(enumerate(deviation))
    wide = np.array([[(1 << 30) + 1, 7], [-(1 << 31), 3]])
    assert (sum(x.astype(object) for x in whitening._products(wide)) == wide.astype(object).T @ wide.astype(object)).all()
