"""Exact retrieval that skips blocks (Q5): equal to scoring every candidate."""
import numpy as np
import pytest

from rebound.operators import blocks as B
from rebound.operators import retrieval as R

CAND, QUERY = "id long, v array<float>", "q string, v array<float>"


def found(df):
    return sorted((r["query_id"], r["candidate_id"], round(r["score"], 9)) for r in df.collect())


def clustered(rng, groups, each, dim=16, spread=0.15):
    middle = rng.normal(size=(groups, dim))
    return (middle[:, None] + spread * rng.normal(size=(groups, each, dim))).reshape(-1, dim), middle


@pytest.mark.parametrize("blocks", [None, 1, 60])
def test_equal_to_every_candidate_and_most_blocks_are_skipped(spark, blocks):
    rng = np.random.default_rng(5)
    vecs, middle = clustered(rng, 12, 50)
    cand = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], CAND)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(middle)], QUERY)
    top, read = B.search(B.build(cand, "id", "v", blocks=blocks), q, "q", "v", 7)
    assert found(top) == found(R.top_k_cosine(cand, q, "id", "v", "q", "v", 7))
    rows = read.collect()
    assert len(rows) == 12 and all(r["rows"] == 600 and r["blocks_read"] <= r["blocks"] for r in rows)
    if blocks == 60:
        assert sum(r["rows_read"] for r in rows) < 0.5 * 600 * 12


def test_unclustered_vectors_filter_and_few_candidates(spark):
    rng = np.random.default_rng(6)
    cand = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], CAND)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(9, 6)))], QUERY)
    for where, k in ((cand.id % 3 == 0, 4), (cand.id < 3, 5)):
        top, _ = B.search(B.build(cand, "id", "v", where), q, "q", "v", k)
        assert found(top) == found(R.top_k_cosine(cand, q, "id", "v", "q", "v", k, where))
        assert len(found(top)) == 9 * min(k, 4 if k == 4 else 3)


def test_awkward_vectors_copies_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 10)  # a block of copies is dealt into parts
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(80)] + [(100 + i, [0.5, float(i), 1.0]) for i in range(20)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 0.0]), (204, [nan, 1.0, 0.0]), (205, [inf, 1.0, 0.0]),
             (206, [1.0, 1.0]), (207, [2.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    cand = spark.createDataFrame(rows, CAND)
    q = spark.createDataFrame([("a", [2.0, 0.0, 0.0]), ("b", [0.0, 3.0, 1.0]), ("c", [1.0, 0.9]), ("d", None), ("e", [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])], QUERY)
    index = B.build(cand, "id", "v")
    assert index.members.select("part").distinct().count() > 1
    top, read = B.search(index, q, "q", "v", 3)
    good = cand.where(B.usable(cand.v) & cand.id.isNotNull())
    assert found(top) == found(R.top_k_cosine(good, q.where("q in ('a', 'b', 'c')"), "id", "v", "q", "v", 3))
    assert [r[1] for r in found(top) if r[0] == "a"] == [0, 1, 2] and {r[1] for r in found(top) if r[0] == "c"} == {206, 207}
    assert {r["query_id"] for r in read.collect()} == {"a", "b", "c"}


def test_empty_tables(spark):
    none, no_q = spark.createDataFrame([], CAND), spark.createDataFrame([], QUERY)
    one = spark.createDataFrame([(1, [1.0, 2.0])], CAND)
    q = spark.createDataFrame([("a", [1.0, 0.0])], QUERY)
    for c, asked in ((none, q), (one, no_q), (none, no_q)):
        top, _ = B.search(B.build(c, "id", "v"), asked, "q", "v", 3)
        assert top.count() == 0
