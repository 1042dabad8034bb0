"""Readers and writers (I1-I3, I6 sinks).

Parquet is the native format: the column list given to :func:`read_table` is
applied before any other operator so Catalyst prunes the scan, and filters
written later on raw columns reach the scan as ``PushedFilters``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one table; ``TIMESTAMP_NTZ`` columns become session-zone timestamps.

    Watermarks and ``unix_seconds`` need ``timestamp``; with the session time
    zone pinned to UTC the cast keeps the wall-clock value (trap T24).
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return ntz_to_timestamp(df)


def ntz_to_timestamp(df: DataFrame) -> DataFrame:
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if not ntz:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c)
                       for c in df.columns])


def read_attempts_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with an explicit schema.

    Only a line with more fields than the header is skipped; a short line's
    missing fields and values that do not parse are NULL.  Fields are scanned as
    text, with a spare column: a line of the right length misses it, which the
    parser reports by keeping the line in ``__short``.  Types come by ``try_cast``.
    """
    names = [f.name for f in schema.fields]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__spare", "__short"]])
    rows = (spark.read.schema(text).option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "__short").option("columnPruning", "false").csv(path))
    return rows.where(F.col("__short").isNotNull() & F.col("__spare").isNull()).select(
        *[F.col(f.name) if isinstance(f.dataType, T.StringType)
          else F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Write a table as a directory of part files (never one local file)."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """Read a small JSON config document (policy, metadata, calibrator).

    The document is read through Spark so it can live on any shared file
    system; it is a single small record, so it is brought to the driver.
    """
    text = spark.read.text(path, wholetext=True).first()
    return json.loads(text[0]) if text else {}


def config_table(spark: SparkSession, path: str) -> DataFrame:
    """I3 variant: a config that is itself a table (one JSON record per line)."""
    return spark.read.json(path)
