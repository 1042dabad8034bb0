import hashlib
import zlib
from collections import Counter

import pytest

from llm_cases import awkward, awkward_rows, empty, save, with_clashes
from rebound.llm.shard import WHOLE_SHARE, op2_sampled_splitters, shard_by_size, sized


def key(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)  # noqa: S324


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot) by sorting all rows."""
    own = []
    for doc_id, text, *_ in rows:
        t = text or ""
        own.append((key(t), 1 << 60 if doc_id is None else key(str(doc_id)), len(t.encode()) + 8, doc_id, zlib.crc32(t.encode())))
    own.sort(key=lambda r: r[:3])
    total = sum(r[2] for r in own)
    whole = min(WHOLE_SHARE * total / shards, 2 * total / (shards * 16))
    group = Counter()
    for r in own:
        group[r[0]] += r[2]
    at, start, out, slots = 0, {}, [], Counter()
    for k, _, size, doc_id, crc in own:
        start.setdefault(k, at)
        p = start[k] if group[k] <= whole else at
        s = min(shards - 1, p * shards // total)
        out.append((doc_id, size, crc, s, slots[s]))
        slots[s] += 1
        at += size
    return out


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_equals_sorting(spark, shards):
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_by_size(sized(awkward(spark)), shards).collect()]
    same(got, brute(awkward_rows(), shards))


def test_hot_text_is_spread_and_sample_size_does_not_matter(spark):
    rows = [(i, "the same text again" if i % 2 else f"text {i} " + "pad " * (i % 50), "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    want = brute(rows, 24)
    for sample in ({}, {"per_range": 2}, {"ranges_per_shard": 16, "per_range": 200}):
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_by_size(sized(docs), 24, **sample).collect()]
        same(got, want)
    load = Counter()
    for _, size, _, s, _ in want:
        load[s] += size
    assert max(load.values()) - min(load.values()) <= 2 * max(r[1] for r in want) + WHOLE_SHARE * sum(load.values()) / 24


def test_small_groups_stay_together(spark):
    rows = [(i, f"text number {i // 3}", "en", "s", 1) for i in range(6000)]
    got = shard_by_size(sized(spark.createDataFrame(rows, awkward(spark).schema)), 4).collect()
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_query_columns_empty_and_clashes(spark, tmp_path):
    assert op2_sampled_splitters(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0
    df = op2_sampled_splitters(spark, save(spark, with_clashes(awkward(spark)), tmp_path / "a"))
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()]
    same(got, brute(awkward_rows(), 24))
