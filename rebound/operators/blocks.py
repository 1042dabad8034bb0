"""Exact top-K cosine retrieval that skips blocks of candidates (Q5).

Candidates are dealt to the nearest of a bounded number of centres, sampled
candidates; a block knows its rows and its radius, the largest angle between
its centre and a member.  No member of a block scores more than
cos(angle(query, centre) - radius).  A query first meets the nearest blocks
that hold K rows, which gives a score that the K-th best cannot fall under;
then only the blocks whose bound reaches that score.  Nothing else is read, and
the result equals scoring every candidate.

Centres and block sizes are bounded (``MAX_BLOCKS``, ``MAX_CENTRE_BYTES``) and
travel with the tasks; queries meet members in a join on (block, part), where
a block of many rows, such as copies of one vector, is dealt into parts.

Edge cases: vectors that are null or empty, hold null or non-finite entries or
have norm 0 take no part; only vectors of one length meet, and those of lengths
without a centre form one block each that is always read; rows without id are
left out; equal scores go to the smaller candidate id; fewer than K candidates
are all returned; query ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound.operators.ordered import top_k_per_group
from rebound.operators.retrieval import cosine
from rebound.session import materialize

#: Most blocks, and most bytes of all centres.
MAX_BLOCKS, MAX_CENTRE_BYTES = 4096, 16 << 20
#: Rows of a part of a block.
PART_ROWS = 100_000
#: Bounds are widened by this much, more than the rounding of angles.
SLACK = 1e-6


@dataclass
class BlockIndex:
    """``members``: (candidate_id, v, block, part); ``centres``: unit vectors; per block: rows and radius."""

    members: DataFrame
    centres: np.ndarray
    block: np.ndarray
    rows: np.ndarray
    radius: np.ndarray


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fit & (norm > 0) & (norm < float("inf")), F.lit(False))


def _unit_rows(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the batch's vectors of length ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(pc.list_value_length(column).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return at, flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def build(candidates: DataFrame, cand_id: str, cand_vec: str, where: Column | None = None, blocks: int | None = None) -> BlockIndex:
    """The block index of the candidates that pass ``where``."""
    c = candidates if where is None else candidates.where(where)
    c = c.select(F.col(cand_id).alias("candidate_id"), F.col(cand_vec).alias("v"))
    c = c.where(F.col("candidate_id").isNotNull() & usable(F.col("v")))
    sizes = c.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    want = min(blocks or int(np.ceil(np.sqrt(n))), MAX_BLOCKS, max(1, MAX_CENTRE_BYTES // (8 * dim)))
    drawn = c.where(F.size("v") == dim).orderBy(F.xxhash64("candidate_id", "v"), "candidate_id").limit(want).collect() if n else []
    centres = np.unique(np.array([r["v"] for r in drawn], float).reshape(-1, dim), axis=0)
    centres = centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True))

    def deal(batches):
        for batch in batches:
            block = -pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False).astype(np.int32)  # other lengths: a block of their own
            near = np.full(len(block), -1.0)
            at, unit = _unit_rows(batch["v"], dim)
            if len(at):
                score = unit @ centres.T
                block[at] = score.argmax(axis=1)
                near[at] = score.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(near)], names=[*batch.schema.names, "block", "near"])

    schema = T.StructType([*c.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("near", T.DoubleType())])
    dealt = materialize(c.mapInArrow(deal, schema))
    stats = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).orderBy("block").collect()
    block, rows, near = (np.array([r[k] for r in stats], kind) for k, kind in (("block", np.int64), ("n", np.int64), ("near", float)))
    parts = [(int(b), int(-(-m // PART_ROWS))) for b, m in zip(block, rows) if m > PART_ROWS]
    part = F.lit(0)
    if parts:
        many = F.create_map(*[F.lit(v) for pair in parts for v in pair])
        part = F.pmod(F.xxhash64("candidate_id"), F.coalesce(many[F.col("block")], F.lit(1))).cast("int")
    return BlockIndex(dealt.select("candidate_id", "v", "block", part.alias("part")), centres, block, rows, np.arccos(np.clip(near, -1, 1)))


def _asks(queries: DataFrame, index: BlockIndex, k: int, rest: bool) -> DataFrame:
    """``queries`` with ``blocks``: the nearest ones that hold k rows or, with ``rest``, the others that can reach ``least``."""
    dim, centres, name, rows = index.centres.shape[1], index.centres, index.block, index.rows
    held, radius = name >= 0, index.radius

    def choose(batches):
        for batch in batches:
            lens = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            out = [[int(b) for b in name if b == -n] if not rest else [] for n in lens.tolist()]
            at, unit = _unit_rows(batch["v"], dim)
            least = batch["least"].to_numpy(zero_copy_only=False)
            if len(at) and held.any():
                angle = np.arccos(np.clip(unit @ centres[name[held]].T, -1, 1))
                bound = np.cos(np.maximum(angle - radius[held], 0))
                order = np.argsort(angle, axis=1, kind="stable")
                before = np.cumsum(rows[held][order], axis=1) - rows[held][order]
                for i, place in enumerate(at.tolist()):
                    first = order[i][before[i] < k]
                    if not rest:
                        out[place] = name[held][first].tolist()
                    else:
                        reach = bound[i] >= least[place] - SLACK
                        reach[first] = False
                        out[place] = name[held][reach].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "blocks"])

    schema = T.StructType([*queries.schema.fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    return queries.mapInArrow(choose, schema)


def _scored(asks: DataFrame, index: BlockIndex) -> DataFrame:
    """(query_id, candidate_id, score) of each asked block's members."""
    parts = index.members.select("block", "part").distinct()  # of a bounded number of blocks
    each = asks.select("query_id", F.col("v").alias("qv"), F.explode("blocks").alias("block")).join(parts, "block")
    met = index.members.join(each, ["block", "part"])
    return met.select("query_id", "candidate_id", cosine(F.col("v"), F.col("qv")).alias("score")).where(F.col("score").isNotNull())


def search(index: BlockIndex, queries: DataFrame, query_id: str, query_vec: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(top, read): the k best (query_id, candidate_id, score); per query the blocks and rows there are and those read."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v")))
    best = lambda s: top_k_per_group(s.withColumn("__neg", -F.col("score")), ["query_id"], ["__neg", "candidate_id"], k).drop("__neg")
    near = _asks(q.withColumn("least", F.lit(-2.0)), index, k, False)
    first = materialize(best(_scored(near, index)))
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("__least"))
    bounded = q.join(least, "query_id", "left").select("query_id", "v", F.coalesce("__least", F.lit(-2.0)).alias("least"))
    rest = _asks(bounded, index, k, True)
    top = best(first.unionByName(_scored(rest, index)))
    sizes = F.create_map(*[F.lit(int(v)) for pair in zip(index.block, index.rows) for v in pair]) if len(index.block) else F.create_map().cast("map<int,int>")
    size = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + sizes[x])
    each = near.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks"))
    read = each.groupBy("query_id").agg(F.sum(F.size("blocks")).alias("blocks_read"), F.sum(size(F.col("blocks"))).alias("rows_read"))
    return top, read.select("query_id", F.lit(len(index.block)).alias("blocks"), "blocks_read", F.lit(int(index.rows.sum())).cast("long").alias("rows"), "rows_read")
