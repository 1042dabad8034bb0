import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from rebound.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def save(spark, rows, folder, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).withColumn("x", F.lit("other")).withColumn("whitened", F.lit(1)).withColumn("deviation", F.lit(1))
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def check(rows, got, k=8):
    """Against numpy's dense solver on the rows that remain; signs are free, but one for all rows."""
    kept = [(i, v) for i, v in rows]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(0)
    z = x * n - sums
    c = z / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = c @ u / np.sqrt(e)
    assert len(got) == n * len(e) and {r["n"] for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    sign = None
    for (i, _), wi, zi in zip(kept, w, z):
        mine = np.array([by_row[i][j + 1][0]["whitened"] for j in range(len(e))])
        if sign is None and np.abs(wi).min() > 1e-3:
            sign = np.sign(mine * wi)
        if sign is not None:
            assert np.allclose(mine, wi * sign, atol=1e-9)
        assert by_row[i][1][0]["deviation"] == sum(int(a) ** 2 for a in zi)
    for j in range(len(e)):
        assert abs(by_row[kept[0][0]][j + 1][0]["explained"] - e[j] / np.trace(v)) <= 1e-10 * e[j] / np.trace(v)
    assert got[0]["identity_error"] < 1e-10 and len({r["identity_error"] for r in got}) == 1


def test_given_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    out = W.op13_feast_whitening(spark, SF_MID)
    assert out.columns == COLUMNS
    check(rows, out.collect())


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1 + j) for j in range(12)]) for i in range(200)] + [(None, [rng.gauss(0, 1) for _ in range(12)])]
    bad = [(300, None), (301, [0.1, None] + [0.0] * 10), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (304, []), (305, [1.0, 2.0]),
           (306, [3e38] + [0.0] * 11)]
    rows = [(i, v, 1) for i, v in good + bad + good[:1]]
    got = W.op13_feast_whitening(spark, save(spark, rows, tmp_path)).collect()
    check(good + good[:1], got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_vectors_or_no_variance(spark, tmp_path, rows):
    got = W.op13_feast_whitening(spark, save(spark, [(i, v, 1) for i, v in rows], tmp_path))
    assert got.columns == COLUMNS and got.count() == 0


def test_few_dimensions_and_low_rank(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, float(i % 3)]) for i in range(30)]
    got = W.op13_feast_whitening(spark, save(spark, [(i, v, 1) for i, v in rows], tmp_path)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_sums_beyond_a_long_stay_exact(spark):
    rows = [(i, [float(2**40 + 2**20 * i), float(-(2**41)), 0.5 * (i % 2)]) for i in range(9)]
    df = W.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    m = W.moments(df)
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    assert m.n == 9 and m.sums == [sum(c) for c in zip(*x)]
    exact = 9 * sum(r[0] * r[2] for r in x) - m.sums[0] * m.sums[2]
    assert m.covariance[0, 2] == exact / 81
    out = W.transform(df, W.Whitener(m.n, m.sums, np.ones(1), np.eye(3)[:, :1])).collect()
    for r in out:
        z = [9 * c - s for c, s in zip(r["x"], m.sums)]
        d = sum(c * c for c in z)
        assert r["deviation"] == (d if d < 2**63 else None)


def spectra():
    rng = np.random.default_rng(7)
    yield "simple", rng.random(40)
    yield "clusters", np.repeat([5.0, 3.0, 1.0], 9)
    yield "twins", np.array([2.0, 2.0, 1.0 + 1e-9, 1.0, 0.5])
    yield "steep", 10.0 ** -np.arange(12)
    yield "low rank", np.r_[rng.random(5), np.zeros(20)]
    yield "one", np.array([3.0])
    yield "equal", np.ones(6)


@pytest.mark.parametrize("name,e", list(spectra()), ids=[n for n, _ in spectra()])
def test_components_equal_the_dense_solver(name, e):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(e), len(e))))
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got, u = W.components(v, 8)
    want = np.linalg.eigvalsh(v)[::-1]
    k = min(8, int((want > len(e) * np.finfo(float).eps * np.abs(v).sum(1).max()).sum()))
    assert len(got) == k and np.allclose(got, want[:k], rtol=0, atol=1e-13 * want[0])
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(v @ u - u * got).max() < 1e-12 * want[0]


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(5)
    for _ in range(40):
        d = int(rng.integers(1, 30))
        v = rng.standard_normal((d, d))
        v = v + v.T
        e = np.linalg.eigvalsh(v)
        for at in rng.uniform(e[0] - 1, e[-1] + 1, 5):
            assert W.inertia(v, at) == (e > at).sum()
    assert W.inertia(np.zeros((4, 4)), 0.0) == 0 and W.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_projection_keeps_the_interval_only():
    v = np.diag([9.0, 5.0, 4.0, 1.0])
    p = W.contour(v, 3.0, 6.0, np.eye(4))
    assert np.allclose(np.diag(p)[1:3], 1, atol=1e-3) and abs(p[3, 3]) < 0.1 and abs(p[0, 0]) < 0.1


def test_a_missed_eigenvalue_is_refused():
    with pytest.raises(ArithmeticError):
        W.feast(np.diag([5.0, 4.0, 1.0]), 3.0, 6.0, 3)
