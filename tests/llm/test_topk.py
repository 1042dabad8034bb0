import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebound.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    own = sorted({(i, tuple(math.floor(64 * float(np.float32(x))) for x in e)) for i, e, *_ in rows
                  if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for q, v in own:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def awkward_vectors():
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, rng.uniform(-1, 1)]) for _ in range(8)], 1) for i in range(300)]
    rows += [(400, None, 1), (420, [0.1, None] + [0.0] * 6, 1), (440, [float("nan")] * 8, 1), (460, [float("inf")] + [0.0] * 7, 1),
             (480, [], 1), (500, [0.5, 0.5], 1), (None, [0.5] * 8, 1), (520, [0.0] * 8, 1), (20, rows[20][1], 1)]
    return rows


@pytest.mark.parametrize("block,shard", [(8192, 8192), (7, 23)])
def test_equals_brute_force(spark, block, shard):
    rows = awkward_vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = T.top_k(T.quantised(df), F.col("vec_id") % 20 == 0, 20, block, shard)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 20)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [1.0, 1.0], 1)]
    got = T.top_k(T.quantised(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 20)
    for few in ([], rows[:1]):
        assert T.top_k(T.quantised(spark.createDataFrame(few, SCHEMA)), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sparse", [0.0, 0.9])
def test_pruning_changes_no_result(sparse):
    rng = np.random.default_rng(3)
    v = rng.integers(-30, 31, (5000, 32)) * (rng.random((5000, 32)) >= sparse)
    v[:, :3] *= 4  # a few strong terms, so that others become non-essential
    q = v[:40]
    ids = rng.permutation(5000)
    at, who, score = T.max_score(q.astype(float), ids[:40], v.astype(float), ids, 20)
    full = q @ v.T
    for i in range(40):
        order = sorted((-int(s), int(d)) for s, d in zip(full[i], ids) if d != ids[i])[:20]
        assert [(-int(s), int(d)) for s, d in zip(score[at == i], who[at == i])] == order


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**20)), 2.0**-6], 1) for i in range(30)]
    got = T.top_k(T.quantised(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 20 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 20)


def test_memory_is_bounded_with_many_queries():
    rng = np.random.default_rng(6)
    q, v = (rng.integers(-30, 31, (n, 64)).astype(np.float32) for n in (4096, 2048))
    ids, qids = rng.permutation(2048), np.arange(10_000, 14_096)
    tracemalloc.start()
    try:
        at, who, score = T.max_score(q, qids, v, ids, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 << 20
    full = q @ v.T
    for i in range(0, 4096, 371):
        order = sorted((-int(s), int(d)) for s, d in zip(full[i], ids))[:20]
        assert [(-int(s), int(d)) for s, d in zip(score[at == i], who[at == i])] == order


@pytest.mark.parametrize("kind", [np.float64, object])
@pytest.mark.parametrize("dense", [1, 4, 10**9])
def test_probing_pair_by_pair_and_by_product_agree(monkeypatch, kind, dense):
    monkeypatch.setattr(T, "DENSE", dense)
    monkeypatch.setattr(T, "GATHER", 100)
    monkeypatch.setattr(T, "QUERY_TILE", 7)
    monkeypatch.setattr(T, "TILE", 30)
    monkeypatch.setattr(T, "SEED", 25)
    rng = np.random.default_rng(8)
    v = rng.integers(-9, 10, (300, 12))
    v[:, :2] *= 6
    big = 1 if kind is np.float64 else 2**29 + 1
    ids = rng.permutation(150).repeat(2)
    full = (v.astype(object) * big) @ (v.T.astype(object) * big)
    at, who, score = T.max_score((v[:40] * big).astype(kind), ids[:40], (v * big).astype(kind), ids, 5)
    for i in range(40):
        order = sorted((-int(s), int(d)) for s, d in zip(full[i], ids) if d != ids[i])[:5]
        assert [(-int(s), int(d)) for s, d in zip(score[at == i], who[at == i])] == order
