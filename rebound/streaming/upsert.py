"""An idempotent upsert sink for streams.

The table is cut into ``buckets`` by the hash of its key.  An epoch rewrites only
the buckets that its rows touch, into ``data/epoch=<n>/bucket=<b>``, and then
commits a manifest: which epoch holds each bucket now.  A reader follows the
newest committed manifest, so it sees whole epochs only.  An epoch that runs
again starts from the manifest before it and replaces its own files: nothing
changes.  Of the rows of one key the greatest in ``order`` stays, of equal ones
that of the later epoch, and within an epoch the greatest row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rebound.session import materialize

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Committed epochs, ascending."""
    p, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(d.getName().split("=")[1]) for d in done)


def _manifest(spark: SparkSession, path: str, epoch: int | None) -> dict[int, int]:
    """bucket -> the epoch that holds it: one small row a bucket."""
    if epoch is None:
        return {}
    return {r["bucket"]: r["held_by"] for r in spark.read.parquet(f"{path}/manifest/epoch={epoch}").collect()}


def _files(path: str, held: dict[int, int], buckets=None) -> list[str]:
    return [f"{path}/data/epoch={e}/bucket={b}" for b, e in sorted(held.items()) if buckets is None or b in buckets]


def read_table(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """The table as of the newest committed epoch (or a given one)."""
    done = epochs(spark, path)
    if not done:
        raise FileNotFoundError(f"{path}: no epoch is committed")
    return spark.read.parquet(*_files(path, _manifest(spark, path, done[-1] if epoch is None else epoch))).drop("__epoch")


def merge_epoch(batch: DataFrame, epoch: int, path: str, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merge a batch into the table as epoch ``epoch``; the number of buckets must stay the same."""
    spark, columns = batch.sparkSession, batch.columns
    before = [e for e in epochs(spark, path) if e < epoch]
    held = _manifest(spark, path, before[-1] if before else None)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    mine = batch.persist()
    try:
        touched = {r[0] for r in mine.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        new = mine.withColumn("__epoch", F.lit(epoch).cast("long"))
        old = _files(path, held, touched)
        rows = new.unionByName(spark.read.parquet(*old)) if old else new
        rank = F.struct(*order, "__epoch", *[c for c in columns if c not in order])
        kept = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg(F.max_by(F.struct(*columns, "__epoch"), rank).alias("r")).select("r.*")
        # read before the write: a file of this epoch may be one that a failed attempt left
        kept = materialize(kept.withColumn("bucket", bucket))
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
    finally:
        mine.unpersist()
    held |= dict.fromkeys(touched, epoch)
    (spark.createDataFrame(sorted(held.items()), "bucket int, held_by long").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}"))


def upsert_stream(df: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS,
                  available_now: bool = True) -> StreamingQuery:
    """Write a stream as a keyed table: the newest row of each key, exactly once per epoch."""
    w = (df.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, epoch: merge_epoch(batch, epoch, path, key, order, buckets)))
    return (w.trigger(availableNow=True) if available_now else w).start()


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete data that none of the ``keep`` newest manifests names, and the older manifests; the epochs whose data went."""
    done = epochs(spark, path)
    kept = done[-keep:]
    used = {e for k in kept for e in _manifest(spark, path, k).values()}
    gone = [e for e in done if e not in used and e not in kept]
    for e in done:
        if e not in kept:
            p, fs = _fs(spark, f"{path}/manifest/epoch={e}")
            fs.delete(p, True)
    for e in gone:
        p, fs = _fs(spark, f"{path}/data/epoch={e}")
        fs.delete(p, True)
    return gone
