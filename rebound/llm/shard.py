"""Range sharding by sampled splitters (operator 2), DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id), so that equal texts lie
together.  A size-weighted sample of the hash keys gives quantile boundaries
for many more ranges than shards; rows are range-partitioned by them.  A key
that fills whole quantiles by itself gets ranges of its own, and a range that
turns out overfull is subdivided: by the id hash if it is one key, else by the
key interval.  Sizes are then summed exactly per range, and a prefix sum over
ranges plus one inside each range places every row: shard = the position of its
first byte, scaled to the number of shards.  Sampling only decides how the work
is spread; the result is the same for every sample.

Edge cases: a null text counts as empty (size 8, checksum 0); long texts are
one row and never cut; repeated rows each get a slot; rows without id go last in
their text group; an empty table gives an empty result; more shards than bytes
leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebound.session import materialize

#: Bits of the hash keys: the first 15 hex digits of an MD5.
KEY_BITS = 60
#: A group of equal texts goes whole to one shard if it has at most this share of a shard's bytes.
WHOLE_SHARE = 0.02


def md5_key(col) -> F.Column:
    """The first 60 bits of the MD5 of a string or binary column, as a long."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, tie) of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"), md5_key(text).alias("key"),
        F.coalesce(md5_key(F.col("doc_id").cast("string")), F.lit(1 << KEY_BITS)).alias("tie"))


def _splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> DataFrame:
    """(lo, hi): half-open key ranges that cover every key, from a size-weighted sample.

    A row is drawn with probability size x rate, decided by its own hash, so a
    retried task draws the same rows; about ranges x per_range are drawn,
    whatever the input.
    """
    rate = ranges * per_range / max(1, total)
    u = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(u < F.col("size") * F.lit(rate)).groupBy("key").agg(
        F.sum(F.greatest(F.lit(1.0), F.col("size") * F.lit(rate))).alias("w"))
    by_key = Window.orderBy("key")
    at = drawn.select("key", "w", (F.sum("w").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("before"))
    cell = at.withColumn("cell", F.floor(F.col("before") / F.lit(float(per_range))))
    quantile = cell.groupBy("cell").agg(F.min("key").alias("key")).select("key")
    heavy = at.where(F.col("w") >= per_range).select(F.explode(F.array("key", F.col("key") + 1)).alias("key"))
    edges = quantile.unionByName(heavy).unionByName(
        drawn.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))).distinct()
    return edges.select(F.col("key").alias("lo"),
                        F.coalesce(F.lead("key").over(Window.orderBy("key")), F.lit((1 << KEY_BITS) + 1)).alias("hi"))


def shard_by_size(rows: DataFrame, shards: int, ranges_per_shard: int = 16, per_range: int = 32,
                  range_rows: int = 1_000_000) -> DataFrame:
    """``rows`` (key, tie, size and more columns) with ``shard`` and ``slot`` added.

    Near-equal bytes: a shard differs from the mean by at most one row, or one
    small group of equal keys, at either end.
    """
    rows = materialize(rows)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * ranges_per_shard, n // range_rows)
    cells = 1 << max(1, (4 * ranges - 1).bit_length())
    width = (1 << KEY_BITS) // cells
    edges = _splitters(rows, total, ranges, per_range)
    # A grid over the keys turns the range lookup into an equality: each cell knows the ranges that touch it.
    grid = (edges.withColumn("g", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(width)), F.floor((F.col("hi") - 1) / F.lit(width)))))
            .groupBy("g").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("r")))
    placed = (rows.withColumn("g", F.floor(F.col("key") / F.lit(width)))
              .join(F.broadcast(grid), "g")  # at most 8 x ranges entries, which the row count bounds
              .withColumn("r", F.element_at(F.filter("r", lambda r: r["lo"] <= F.col("key")), -1))
              .select("*", "r.lo", "r.hi").drop("g", "r"))
    quota = total / max(1, ranges)
    found = placed.groupBy("lo", "hi").agg(F.sum("size").alias("b"), F.min("key").alias("k0"), F.max("key").alias("k1"))
    parts = found.select("lo", "hi", F.greatest(F.lit(1), F.ceil(F.col("b") / F.lit(2 * quota or 1))).cast("long").alias("parts"),
                         (F.col("k0") == F.col("k1")).alias("one"))
    placed = (placed.join(F.broadcast(parts), ["lo", "hi"])
              .withColumn("sub", F.when(F.col("one"), F.floor(F.col("tie") / F.lit(float((1 << KEY_BITS) + 1)) * F.col("parts")))
                          .otherwise(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("parts"))))
              .withColumn("split", F.col("one") & (F.col("parts") > 1)).drop("hi", "parts", "one"))
    whole = min(WHOLE_SHARE * total / shards, 2 * quota)  # smaller than any range that is split by id
    sums = placed.groupBy("lo", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("lo", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("lo", "sub", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("lo", "sub").orderBy("key", "tie", "size")
    group = Window.partitionBy("lo", "sub", "key")
    out = (placed.join(F.broadcast(offsets), ["lo", "sub"])
           .withColumn("pos", F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
           .withColumn("row", F.col("c0") + F.row_number().over(inside) - 1)
           .withColumn("start", F.when(~F.col("split") & (F.sum("size").over(group) <= F.lit(whole)), F.min("pos").over(group)).otherwise(F.col("pos")))
           .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("start").cast("decimal(38,0)") * shards / F.lit(max(1, total)).cast("decimal(38,0)"))).cast("int"))
           .drop("lo", "sub", "split", "b0", "c0", "pos", "start"))
    out = materialize(out)
    first = out.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return out.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("first")).drop("row", "first")


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shard_by_size(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sampled_splitters": (op2_sampled_splitters, None)}
