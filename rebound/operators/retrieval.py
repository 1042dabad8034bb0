"""Reference-text chunking and exact top-K cosine retrieval (Q4-Q6).

Chunking is array arithmetic per document (whole texts).  Retrieval scores
every candidate against blocks of queries, and keeps the top K per query in
each task before the shuffle, so no query's candidate list is ever gathered
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebound.operators.ordered import top_k_per_group

WS = r"[ \t\n\r\f\x0B]+"


def words(text: Column) -> Column:
    """Whitespace tokens of the whole text (leading/trailing space dropped)."""
    t = F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+", ""), r"[ \t\n\r\f\x0B]+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS))


def chunk(df: DataFrame, id_col: str, text_col: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """Q4: fixed-size word chunks with overlap: chunk i starts at word
    i * (size - overlap); the last chunk may be shorter; one row per chunk."""
    step = size - overlap
    w = words(F.col(text_col))
    d = df.select(id_col, w.alias("__w")).where(F.size("__w") > 0)
    d = d.select(id_col, "__w", F.posexplode(F.sequence(
        F.lit(0), F.greatest(F.size("__w") - 1, F.lit(0)), F.lit(step))).alias("chunk_index", "word_start"))
    d = d.where((F.col("chunk_index") == 0) | (F.col("word_start") + F.lit(overlap) < F.size("__w")))
    piece = F.slice("__w", F.col("word_start") + 1, size)
    return d.select(id_col, "chunk_index", "word_start", F.size(piece).alias("n_words"),
                    F.array_join(piece, " ").alias("chunk_text"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length arrays (NULL if a norm is 0)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group (posexplode + grouped average, no driver collect)."""
    e = df.select(group, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("__s"))
            .select(group, F.transform("__s", lambda s: s["x"]).alias("query_vector")))


#: Query sets up to so many rows are broadcast; larger ones are dealt into blocks of this size.
QUERY_BLOCK = 4096


def top_k_cosine(candidates: DataFrame, queries: DataFrame, cand_id: str, cand_vec: str, query_id: str,
                 query_vec: str, k: int = 5, where: Column | None = None) -> DataFrame:
    """Q5: exact top-K cosine neighbours per query, with an optional metadata
    filter applied to the candidates before scoring (pushed to the scan).

    Queries are gathered into blocks of ``QUERY_BLOCK`` (a table of arrays, one
    row per block); a candidate meets each block once and is scored once
    against each of its queries.  The rank bound keeps the best k per query in
    every task before anything is shuffled.
    """
    c = candidates if where is None else candidates.where(where)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = (queries.withColumn("__block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))
             .groupBy("__block").agg(F.collect_list(F.struct(F.col(query_id).alias("query_id"), F.col(query_vec).alias("v"))).alias("__qs")))
    # a single block has a bounded size and is broadcast; several are joined by their number
    if blocks == 1:
        met = c.withColumn("__block", F.lit(0)).join(F.broadcast(dealt), "__block")
    else:
        met = c.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__block")
    scored = (met.select(F.col(cand_id).alias("candidate_id"), F.col(cand_vec).alias("__cv"), F.explode("__qs").alias("__q"))
              .select(F.col("__q.query_id").alias("query_id"), "candidate_id",
                      cosine(F.col("__cv"), F.col("__q.v")).alias("score")).where(F.col("score").isNotNull()))
    return top_k_per_group(scored.withColumn("__neg", -F.col("score")), ["query_id"], ["__neg", "candidate_id"], k).drop("__neg")


def hit_rate(results: DataFrame, expected: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Q6: share of queries with at least one expected id among their results."""
    hits = results.join(expected, [query_id, "candidate_id"], "left_semi").select(query_id).distinct() \
        .withColumn("__hit", F.lit(1))
    q = results.select(query_id).distinct()
    return q.join(hits, query_id, "left").agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("__hit", F.lit(0))).alias("hit_rate"))
