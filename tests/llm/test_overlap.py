import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import rebound.llm.overlap as O
from conftest import SF_MID
from llm_cases import awkward, awkward_rows, empty, prose, save, with_clashes
from rebound.llm.graph import components
from rebound.session import checkpoint_dir


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, num, den):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets[i] = shingle_set(t, size)
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = {}
    for h in holders.values():
        for a in h:
            for b in h:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), k in shared.items():
        if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 4, 5)])
def test_equals_all_pairs_on_documents(spark, size, num, den):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in O.similar_components(docs, size, num, den).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], size, num, den)


def test_awkward_rows_and_clashes(spark, tmp_path):
    got = O.op5_divide_skip(spark, save(spark, with_clashes(awkward(spark)), tmp_path)).collect()
    want = brute(awkward_rows(), 4, 85, 100)
    assert len(got) == len(awkward_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert O.similar_components(empty(spark)).count() == 0


def family(rng, n, length, edits):
    base = prose(rng, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [O.BLOCK, 3000])
def test_families_of_near_copies_in_one_and_many_blocks(spark, block):
    rng = random.Random(3)
    texts = [t for length in (5, 8, 9, 12, 20, 43, 44, 60, 150, 400) for t in family(rng, 25, length, max(1, length // 40))]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in O.similar_components(docs, 4, 85, 100, block=block).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_divide_skip_probes_long_lists(monkeypatch):
    rng = random.Random(9)
    sets = [np.unique(O.shingle_sets([t.encode()], 4)[0]) for t in family(rng, 120, 100, 3)]
    want = set()
    for long in (10**9, 64, 1):
        monkeypatch.setattr(O, "LONG_LIST", long)
        links = O.t_occurrence_links(sets, 85, 100)
        for a, b in links:
            k = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k)
        root = list(range(len(sets)))
        for a, b in links:
            ra, rb = root[a], root[b]
            root = [ra if x == rb else x for x in root]
        groups = frozenset(frozenset(i for i, x in enumerate(root) if x == r) for r in set(root))
        want.add(groups)
    assert len(want) == 1


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for n in list(range(6, 90)) + [200, 700, 3000, 20000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            drop = int(n * 15 / 100)  # the smallest linked subset
            b = np.sort(rng.permutation(a)[:n - drop])
            half = int(n * (1 - 0.85) / 1.85)  # equal sizes at the threshold
            c = np.sort(np.r_[rng.permutation(a)[:n - half], rng.integers(0, 2**64, half, np.uint64)])
            for other in (b, c):
                k = len(np.intersect1d(a, other))
                if 100 * k >= 85 * (len(a) + len(other) - k) and k < len(a):
                    assert len(np.intersect1d(O.blocking_keys(a, 85, 100), O.blocking_keys(other, 85, 100)))


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 499), (499, 498), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 498: 498, 499: 498, 500: 498}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_join_their_classes(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, d), (31, d), (40, prose(rng, 60)), (5, None), (None, a), (41, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], awkward(spark).schema)
    got = {}
    for r in O.similar_components(docs, 4, 85, 100).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {3: {3}, 5: {3}, 9: {3}, 20: {20}, 31: {20}, 40: {40}, 41: {41}, None: {3}}


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_linked_sets_share_a_sharper_key(num, den):
    rng = np.random.default_rng(7)
    for n in list(range(2, 90)) + [200, 700, 3000]:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        drop, half = n * (den - num) // den, n * (den - num) // (den + num)
        b = np.sort(rng.permutation(a)[:n - drop])  # the smallest linked subset
        c = np.sort(np.r_[rng.permutation(a)[:n - half], rng.integers(0, 2**64, half, np.uint64)])
        for other in (b, c):
            k = len(np.intersect1d(a, other))
            if den * k >= num * (len(a) + len(other) - k) and not (k == len(a) == len(other)):
                for run in O.SHARPER:
                    assert len(np.intersect1d(O.sharper_keys(a, num, den, run), O.sharper_keys(other, num, den, run)))


def test_texts_that_share_a_common_line_are_not_one_block(spark, monkeypatch):
    rng = random.Random(4)
    line, made = prose(rng, 40), []
    texts = [f"{line} {prose(rng, 60)}" for _ in range(500)] + family(rng, 30, 100, 2)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    monkeypatch.setattr(O, "materialize", lambda df, keep=O.materialize: made.append(keep(df)) or made[-1])
    got = O.similar_components(spark.createDataFrame(rows, awkward(spark).schema), 4, 85, 100, block=1000)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, 4, 85, 100)
    placed = [df for df in made if "label" in df.columns][-1]
    assert placed.groupBy("label").agg(F.sum("n").alias("n")).where("n > 1000 * 4").count() == 0


def test_components_leave_one_table(spark):
    def files():
        where = checkpoint_dir(spark).removeprefix("file:")
        return {d for d, _, names in os.walk(where) if any("part-" in n for n in names)}

    before = files()
    got = components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
    assert got.where("component <> 0").count() == 0
    assert len(files() - before) == 1
