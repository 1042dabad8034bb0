"""Exact top-k inner-product search by MaxScore over sharded integer vectors (operator 10).

Terms are vector components; a term's posting list in a shard is the column of
that component.  For each query, terms are ordered by the largest contribution
they can make in the shard.  The terms with the smallest bounds whose sum stays
under the running threshold (the k-th best score seen so far) are non-essential:
no candidate can enter the result through them alone.  Essential postings are
traversed for every candidate; the others are probed in steps, each only for
candidates whose partial score plus the bound of what is left still reaches the
threshold.  Shards report their own best k, and a rank over each query's
reports merges them.  All scores are integers, so ties are exact.

Edge cases: vectors that are null, or hold a null or non-finite component, take
no part; an empty vector scores 0 with every other; of vectors of different
length the common components count; repeated rows count once; a row is never
its own candidate (same ``vec_id``); rows without id are left out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a shard of candidates; a task holds one of each.
QUERY_BLOCK = SHARD = 8192
#: Candidates scored at once, and those scored in full to find a first threshold.
TILE, SEED = 1024, 512
#: Queries whose scores with a tile of candidates are held at once.
QUERY_TILE = 1024
#: Components of pairs gathered at once; pairs are probed one by one when fewer than one in ``DENSE`` is left.
GATHER, DENSE = 1 << 21, 32

_OUT = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of vectors that are whole."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (vectors.where(F.col(vec_id).isNotNull() & e.isNotNull() & finite)
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
            .distinct())


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """Rows of a list column, cut or zero-filled to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width).astype(kind)
    out = np.zeros((len(ends), width), kind)
    rows = np.repeat(np.arange(len(ends)), ends)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    keep = cols < width
    out[rows[keep], cols[keep]] = flat[keep]
    return out


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return q[keep], ids[keep], score[keep]


def _probed(queries: np.ndarray, part: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of the pairs (q, c), a bounded number of components at a time."""
    step = max(1, GATHER // max(1, part.shape[1]))
    pieces = [np.einsum("ij,ij->i", queries[q[i:i + step]], part[c[i:i + step]]) for i in range(0, len(q), step)]
    return np.concatenate(pieces) if pieces else np.zeros(0, part.dtype)


def max_score(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int):
    """(query index, candidate id, score) of the k best candidates of every query in one shard."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(shard):
        hi, lo = shard.max(0), shard.min(0)
        for a in range(0, len(queries), QUERY_TILE):
            at, who, score = _tile_score(queries[a:a + QUERY_TILE], query_ids[a:a + QUERY_TILE], shard, ids, hi, lo, k)
            found.append((at + a, who, score))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile_score(queries, query_ids, shard, ids, hi, lo, k: int):
    """``max_score`` of a few queries, whose scores with a tile of candidates are held at once."""
    nq, n = len(queries), len(shard)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    theta = np.full(nq, -np.inf, object if queries.dtype == object else np.float64)  # as exact as the scores
    bound = np.maximum(queries * hi, queries * lo)               # of each term, for each query
    order = np.argsort(bound, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
    most = np.maximum.accumulate(total, 1)
    at = 0
    while at < n:
        rows = slice(at, at + (SEED if at == 0 else TILE))
        at = min(n, rows.stop)
        part, part_ids = shard[rows], ids[rows]
        non = np.zeros(bound.shape, bool)                        # non-essential terms
        np.put_along_axis(non, order, (total < theta[:, None]) & (most < theta[:, None]), 1)
        left = np.where(non, bound, 0).sum(1)
        score = np.where(non, 0, queries) @ part.T               # essential postings
        q = c = None                                             # pairs that can reach theta, once they are few
        while non.any():                                         # probe the larger half of what is left
            if q is None:
                can = score + left[:, None] >= theta[:, None]
                if np.count_nonzero(can) * DENSE < can.size:
                    q, c = np.nonzero(can)
                    score = score[q, c]
            if q is not None and not len(q):
                break
            rank = np.argsort(np.argsort(np.where(non, -bound, np.inf), axis=1, kind="stable"), axis=1)
            probe = non & (rank < (non.sum(1)[:, None] + 1) // 2)
            chosen = np.where(probe, queries, 0)
            non &= ~probe
            left = np.where(non, bound, 0).sum(1)
            if q is None:
                score = score + chosen @ part.T
            else:
                score = score + _probed(chosen, part, q, c)
                keep = score + left[q] >= theta[q]
                q, c, score = q[keep], c[keep], score[keep]
        if q is None:
            own = part_ids[None, :] == query_ids[:, None]
            if at <= SEED and score.shape[1] > k:                # a first threshold: the k-th best of the first candidates
                theta = np.maximum(theta, np.partition(np.where(own, -np.inf, score), -k, axis=1)[:, -k])
            q, c = np.nonzero((score >= theta[:, None]) & ~own)
            score = score[q, c]
        else:
            own = part_ids[c] == query_ids[q]
            q, c, score = q[~own], c[~own], score[~own]
        if not len(q):
            continue
        found = _best(*(np.concatenate(x) for x in zip(found, (q, part_ids[c], score))), k)
        last = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True])
        full = np.bincount(found[0], minlength=nq)[found[0][last]] >= k
        theta[found[0][last][full]] = found[2][last][full]
    return found


def top_k(vectors: DataFrame, is_query, k: int = 20, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row.

    ``vectors`` holds (vec_id, v: array of integers); ``is_query`` is a condition
    on it.  Queries and candidates are dealt into blocks of bounded size, and
    each pair of a query block and a candidate shard is one group: a block is
    sent once to every block of the other side, never a row to a row.
    """
    n, nq = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil((nq or 0) / query_block))

    def deal(df, own, count, other, others):
        return (df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ARROW.empty_table()
        sizes = [np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0) for t in (left, right)]
        width = int(min(sizes))
        q, c = (_matrix(t["v"], width, np.int64) for t in (left, right))
        top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object  # each holds every partial sum exactly
        ids, qids = (t["vec_id"].to_numpy() for t in (right, left))
        at, who, score = max_score(q.astype(kind), qids, c.astype(kind), ids, k)
        return pa.table([pa.array(qids[at]), pa.array(who), pa.array([int(x) for x in score], pa.int64())], schema=_ARROW)

    left = deal(vectors.where(is_query), "block", blocks, "shard", shards).groupBy("block", "shard")
    right = deal(vectors, "shard", shards, "block", blocks).groupBy("block", "shard")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (left.cogroup(right).applyInArrow(search, _OUT)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op10_max_score": (op10_max_score, SQL)}
