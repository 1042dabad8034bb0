"""N-gram Jaccard self-join by T-occurrence search with DivideSkip (operator 5).

A document is its set of distinct word shingles; two link when their Jaccard
similarity reaches num / den.  Equal sets are one class from the start.

Blocking.  Two linked sets differ in few shingles, so when the hash space is
cut into enough segments, some segments hold exactly the same shingles in both.
Each set emits a key per segment (the hash of what lies in it) under the
segment count of its size class, and of the next class if a partner may lie
there.  The count is chosen so that a pair right at the threshold is expected
to share 21 or more segments, and so misses all with a chance below 1e-8.
Small sets use their prefix in hash order instead, which two linked sets always
share.  Components of sets with equal keys are the blocks.  Sets that share a
common line or phrase can share a key by chance, and with enough texts such keys
connect a large part of them to one block.  A block above the task size is
therefore cut again, by keys of more shingles each, of which a linked pair is
expected to share as many.  What stays above the task size is dealt into parts,
and each pair of parts is a task of its own.

Search inside a block.  Posting lists run from each shingle to the sets that
hold it, by size.  For each set as query with overlap threshold T, the long
lists (T - 1 at most) are put aside; the short ones are merged, counting each
set's occurrences; a set that could still reach T is probed in the long lists
by binary search, until it reaches its bound or cannot any more.  Links are
reported as a spanning forest, so a group of m near copies yields m - 1 rows,
and a set already joined with the query is not probed again.

Edge cases: null, empty and blank texts have the empty set, link with nothing,
and are their own component; long texts are compared whole; rows that share a
doc_id are one node, blank ones too; sets whose rows all lack an id have no component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound.llm.graph import components
from rebound.llm.words import chunks, mix, shingles, utf8, word_hashes
from rebound.session import materialize, shared_path, stored

#: Sets under so many shingles are blocked by prefix; above, size classes double from here.
SMALL = 40
#: Expected shared segments of a pair right at the threshold.
SHARED = 21.0
#: Shingles in a task's block, about.
BLOCK = 500_000
#: A larger block is cut again, by keys of about so many shingles.
SHARPER = (8, 12, 16)
#: Such keys of a set and size class, about, where one table does not do; fewer shingles each if it takes more.
KEYS = 2048
#: Posting lists longer than this are probed rather than merged, as far as T allows.
LONG_LIST = 64


@lru_cache(maxsize=4096)
def segments(cls: int, num: int, den: int) -> int:
    """Segments of a size class: the fewest that leave ``SHARED`` whole when the largest linked pair differs most."""
    upper = SMALL << cls
    differ = 2 * (den - num) / (den + num) * upper
    s = 1
    while s * math.exp(-differ / s) < SHARED:
        s = s + max(1, s // 50)
    return s


def blocking_keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set (its sorted distinct shingle hashes), of which linked, different sets share one."""
    n = len(own)
    if n * den < num * (n + 1):  # one shingle more or less is already too much
        return np.zeros(0, np.uint64)
    cls = 0 if n < SMALL else (n // SMALL).bit_length()
    out = []
    for c in (cls, cls + 1):
        lower = 0 if c == 0 else SMALL << (c - 1)
        if c > cls and n * den < num * lower:
            break  # no partner can be that large
        if c == 0:
            out.append(mix(own[:n - -(-num * n // den) + 1], 101))
            continue
        where = (own >> np.uint64(40)).astype(np.int64) * segments(c, num, den) >> 24
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        out.append(mix(np.add.reduceat(mix(own, 103), first) + where[first].astype(np.uint64), 107 + c))
    return np.concatenate(out)


@lru_cache(maxsize=64)
def _bounds(num: int, den: int) -> list[int]:
    """Where the finer size classes begin; a partner is of the same class or a neighbour's."""
    out = [SMALL]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return out


@lru_cache(maxsize=4096)
def _tables(cls: int, num: int, den: int, run: int) -> tuple[int, int]:
    """(segments, tables) of a finer size class: segments of about ``run`` shingles or more, in as many independent
    tables as leave ``SHARED`` whole when the largest linked pair differs most."""
    upper = _bounds(num, den)[cls + 1] - 1
    differ = 2 * (den - num) / (den + num) * upper
    whole = lambda s: s * (1 - 1 / s) ** differ
    s = max(2, round(upper / run))
    while SHARED > whole(s) and s * SHARED > whole(s) * KEYS:
        s += max(1, s // 8)
    if whole(s) < SHARED:
        return s, math.ceil(SHARED / whole(s))
    least = 2  # one table leaves enough: the fewest segments that do
    while least < s:
        middle = (least + s) // 2
        least, s = (least, middle) if whole(middle) >= SHARED else (middle + 1, s)
    return s, 1


def sharper_keys(own: np.ndarray, num: int, den: int, run: int) -> np.ndarray:
    """Keys of a set like ``blocking_keys``, but of about ``run`` shingles each; of small sets of a quarter as many from a longer prefix."""
    n = len(own)
    if n * den < num * (n + 1):
        return np.zeros(0, np.uint64)
    out = []
    if n < SMALL:
        fewest = -(-num // (den - num))  # the smallest set that can have a partner
        k = max(1, min(run // 4, -(-num * fewest // den)))  # all linked sets share so many
        chosen = np.array(list(combinations(own[:n - -(-num * n // den) + k].tolist(), k)), np.uint64)
        out.append(mix(mix(chosen + np.arange(k, dtype=np.uint64), 211).sum(1, dtype=np.uint64), 213))
    bounds = _bounds(num, den)
    cls = bisect_right(bounds, n) - 1
    for c in (cls, cls + 1):
        if c < 0 or n * den < num * bounds[c]:
            continue
        s, tables = _tables(c, num, den, run)
        hashed = mix(own[:, None] + mix(np.arange(tables, dtype=np.uint64), 217 + c))
        where = (((hashed >> np.uint64(40)).astype(np.int64) * s >> 24) + np.arange(tables) * s).ravel()
        # Sums of 40 bits are exact in a double.
        held = np.bincount(where, (hashed & np.uint64((1 << 40) - 1)).astype(np.float64).ravel(), s * tables)
        full = np.flatnonzero(np.bincount(where, minlength=s * tables))
        out.append(mix(mix(held[full].astype(np.uint64)) + full.astype(np.uint64), 223 + c))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, offsets = word_hashes(texts)
    s, at = shingles(flat, offsets, size)
    return [np.unique(s[at[i]:at[i + 1]]) for i in range(len(texts))]


def _sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, e1, e2, keys): set size, 128-bit set address, blocking keys.

    A set that came up before in the same task is not given its keys again, so
    a group of copies costs its keys once per task.
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in chunks(texts):
                n, e1, e2, keys = [], [], [], []
                for own in shingle_sets(texts[a:b], size):
                    address = tuple(_address(own, salt) for salt in (1, 2))
                    n.append(len(own))
                    e1.append(address[0])
                    e2.append(address[1])
                    keys.append(np.zeros(0, np.int64) if address in seen else blocking_keys(own, num, den).view(np.int64))
                    seen.add(address)
                ends = np.zeros(len(keys) + 1, np.int32)
                np.cumsum([len(k) for k in keys], out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(np.array(e, np.uint64).view(np.int64)) for e in (e1, e2)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    names=["doc_id", "n", "e1", "e2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, e1 long, e2 long, keys array<long>")


def _blocks(keys: DataFrame) -> DataFrame:
    """(e1, label): the components of sets that share a key, by a star around the smallest address of each key, from one shuffle read twice."""
    keys = keys.repartition("key")
    least = keys.groupBy("key").agg(F.min("e1").alias("m"), F.max("e1").alias("x")).where("m < x").select("key", "m")
    meet = keys.join(least, "key").where("e1 <> m").select(F.col("m").alias("a"), F.col("e1").alias("b"))
    return components(meet).select(F.col("node").alias("e1"), F.col("component").alias("label"))


def _address(own: np.ndarray, salt: int) -> int:
    return int(mix(own, salt).sum(dtype=np.uint64))


def _sharper(texts: DataFrame, size: int, num: int, den: int, run: int) -> DataFrame:
    """(key, e1): the sharper keys of the sets of ``texts``."""

    def keys(batches):
        for batch in batches:
            flat, e1 = utf8(batch["text"]), batch["e1"].to_numpy()
            for a, b in chunks(flat):
                found = [sharper_keys(own, num, den, run) if _address(own, 1) == int(e) & (2**64 - 1) else np.zeros(0, np.uint64)
                         for own, e in zip(shingle_sets(flat[a:b], size), e1[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(e1[a:b], [len(k) for k in found]))],
                                                 names=["key", "e1"])

    return texts.select("text", "e1").mapInArrow(keys, "key long, e1 long")


def t_occurrence_links(sets: list[np.ndarray], num: int, den: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (as a spanning forest of indices) among sets; with ``part``, only between different parts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    part = None if part is None else part[order]
    ends = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    token = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(token, kind="stable")          # postings: token by token, sets by size
    posting = owner[by]
    begin = np.r_[True, token[by][1:] != token[by][:-1]] if len(by) else np.zeros(0, bool)
    start_of = np.maximum.accumulate(np.where(begin, np.arange(len(by)), 0))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))                  # where a set's own entry stands in its list
    root = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        n = int(sizes[i])
        stop = place[ends[i]:ends[i + 1]]
        start = start_of[stop]
        held = stop > start
        t = -(-num * n // den)                      # overlap that any smaller partner needs at least
        if held.sum() < t:
            continue
        low = int(np.searchsorted(sizes, t))        # smaller sets cannot hold so much
        start, stop = start[held], stop[held]
        length = stop - start
        long = np.argsort(-length, kind="stable")[:min(t - 1, int((length > LONG_LIST).sum()))]
        short = np.ones(len(length), bool)
        short[long] = False
        a, k = start[short], length[short]
        merged = posting[np.repeat(a - np.cumsum(k) + k, k) + np.arange(k.sum())]
        count = np.bincount(merged[merged >= low] - low, minlength=1)
        who = np.flatnonzero(count >= max(1, t - len(long)))
        got = count[who]
        who = who + low
        keep = root[who] != root[i]
        if part is not None:
            keep &= part[who] != part[i]
        who, got = who[keep], got[keep]
        need = -(-num * (n + sizes[who]) // (num + den))
        for nth, at in enumerate(long):
            left = len(long) - nth
            keep = got + left >= need
            who, got, need = who[keep], got[keep], need[keep]
            if not len(who) or (got >= need).all():
                break
            listed = posting[start[at]:stop[at]]
            slot = np.minimum(np.searchsorted(listed, who), len(listed) - 1)
            got = got + (listed[slot] == who)
        for j in who[got >= need]:
            if root[j] != root[i]:
                links.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return links


def similar_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links at Jaccard >= num / den of ``size``-word shingles."""
    # The keys are read once, right after the sets: they stay in the executors' memory (or are computed anew), not in the shared folder.
    keyed = _sets(docs, size, num, den).persist(StorageLevel.MEMORY_AND_DISK)
    sets = materialize(keyed.select("doc_id", "n", "e1", "e2"))
    classes = materialize(sets.where("n > 0").groupBy("e1", "e2", "n").agg(F.min("doc_id").alias("rep")))
    label = _blocks(keyed.select(F.explode("keys").alias("key"), "e1"))
    keyed.unpersist()
    cand = materialize(classes.where("rep is not null").join(label, "e1").select("rep", "e1", "n", "label"))
    # Both sides travel by id, however few the candidates are: disk and time then grow evenly with the input.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(cand.select("rep", "e1").hint("merge"), "rep")
    texts = stored(texts, shared_path(docs.sparkSession, "texts"))
    for run in SHARPER:
        large = cand.groupBy("label").agg(F.sum("n").alias("total")).where(F.col("total") > block).select("label")
        if large.isEmpty():
            break
        label = _blocks(_sharper(texts.join(cand.join(large, "label", "left_semi").select("rep", "e1"), ["rep", "e1"]), size, num, den, run))
        cut = cand.join(large, "label", "left_semi").drop("label").join(label, "e1").select("rep", "e1", "n", "label")
        cand = materialize(cand.join(large, "label", "left_anti").select("rep", "e1", "n", "label").unionByName(cut))
    total = cand.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / block))
    parts = cand.groupBy("label").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts"))
    placed = (cand.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("rep", "e1", "part",
                      F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.col("label")).alias("g"),
                      F.when(F.col("parts") == 1, -1).otherwise(F.least("part", "other")).alias("lo"),
                      F.when(F.col("parts") == 1, -1).otherwise(F.greatest("part", "other")).alias("hi")))

    def search(group: pa.Table) -> pa.Table:
        own = shingle_sets(utf8(group["text"]), size)
        address = np.array([_address(s, 1) for s in own], np.uint64).view(np.int64)
        rep, ok = group["rep"].to_numpy(), np.flatnonzero(address == group["e1"].to_numpy())
        across = group["lo"][0].as_py() != group["hi"][0].as_py()
        found = t_occurrence_links([own[i] for i in ok], num, den, group["part"].to_numpy()[ok] if across else None)
        return pa.table({"a": pa.array([rep[ok[i]] for i, _ in found], pa.int64()), "b": pa.array([rep[ok[j]] for _, j in found], pa.int64())})

    links = texts.join(placed, ["rep", "e1"]).groupBy("g", "lo", "hi").applyInArrow(search, "a long, b long")
    # An id whose rows have several sets joins the classes of those sets, even where another id names the class.
    held = sets.where("n > 0 and doc_id is not null").select("doc_id", "e1", "e2", "n").distinct()
    several = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    same = held.join(several, "doc_id").join(classes, ["e1", "e2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links.unionByName(same)).select(F.col("node").alias("rep"), "component")
    named = classes.join(joined, "rep", "left").select("e1", "e2", "n", F.coalesce("component", "rep").alias("component_id"))
    named = sets.where("n > 0").join(named, ["e1", "e2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    other = named.join(blank.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return named.unionByName(blank.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op5_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)


QUERIES = {"op5_divide_skip": (op5_divide_skip, None)}
