import hashlib
import random

import numpy as np
import pytest

from conftest import SF_SMALL
from llm_cases import awkward, awkward_rows, empty, prose, save, with_clashes
from rebound.llm import fingerprint as S


def brute(rows):
    """doc_id -> (n_chars, edited digest, fp, edited fp, near_edited, near_next), by sorting all rows."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = (S.fingerprints([x.encode()]) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{int(a[0]):016x}", f"{int(b[0]):016x}",
                    1 - bin(int(a[0] ^ b[0])).count("1") / 64, 1 - bin(int(a[0] ^ c[0])).count("1") / 64))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = S.op9_simhash(spark, SF_SMALL)
    assert out.columns[:7] == COLS
    assert sorted((tuple(r)[:7] for r in out.collect()), key=repr) == brute(rows)
    got = S.op9_simhash(spark, save(spark, with_clashes(awkward(spark)), tmp_path / "a")).select(COLS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(awkward_rows())
    assert S.op9_simhash(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0


@pytest.mark.parametrize("n,parts", [(1, 4), (2, 7), (30, 1), (30, 30), (400, 5)])
def test_task_borders_and_chunks(spark, monkeypatch, n, parts):
    rng = random.Random(n)
    rows = [(i * 3 - 50, prose(rng, rng.randrange(60)), "en", "s", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], f"{r['fp'] % 2**64:016x}", f"{r['edited_fp'] % 2**64:016x}", r["near_edited"], r["near_next"])
           for r in S.compare_with_next(docs, parts).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_bits_are_a_weighted_vote():
    t = b"a b c d e f g a b c d e"
    flat, at = S.word_hashes([t])
    terms, _ = S.shingles(flat, at, 5)
    votes = [sum(1 if int(h) >> b & 1 else -1 for h in terms) for b in range(64)]
    assert int(S.fingerprints([t])[0]) == sum(1 << b for b in range(64) if votes[b] > 0)
    assert S.fingerprints([b"", None, b" "]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 60, np.uint64)
    near = [int(b) ^ sum({1 << int(x) for x in rng.integers(0, 64, k)}) for b in base for k in range(8)]
    fps = sorted({int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in [*base, *near]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    asked = df.limit(150)
    got = {tuple(r) for r in S.within_radius(asked, df, radius).collect()}
    want = {(q["fp"], x) for q in asked.collect() for x in fps if bin((q["fp"] ^ x) % 2**64).count("1") <= radius}
    assert got == want


def test_likeness_orders_copies_edits_and_strangers():
    rng = random.Random(8)
    a, b = prose(rng, 400), prose(rng, 400)
    fa, fe, fb = S.fingerprints([a.encode(), S.edited(a, b).encode(), b.encode()])
    assert S.likeness(fa, fa) == 1 and S.likeness(fa, fe) > S.likeness(fa, fb)
