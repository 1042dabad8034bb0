"""Registry of named queries: a Spark builder plus an equivalent DuckDB SQL.

Result doubles are rounded on both sides by the same IEEE arithmetic,
``floor(x * 10^d + 0.5) / 10^d``, so equal inputs give bit-equal outputs and
summation-order noise (below 1e-7) does not reach the compared value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
_SCALE = 10.0 ** DIGITS


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...] = ()
    doc: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: tuple[str, ...] = (), doc: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ops, doc)
        return fn
    return deco


def fround(col, digits: int = DIGITS):
    scale = 10.0 ** digits
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column of a result (and nothing else)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fround(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(cols: list[str], inner: str, digits: int = DIGITS) -> str:
    """Wrap an oracle query so the listed double columns are rounded like
    :func:`round_doubles` (DuckDB ``SELECT * REPLACE``)."""
    if not cols:
        return inner
    scale = f"{10.0 ** digits:.1f}"
    rep = ", ".join(f"floor({c} * {scale} + 0.5) / {scale} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS __q"


def dbl(x: float) -> str:
    """A double literal for DuckDB (plain decimals would be DECIMAL there)."""
    return f"CAST({x!r} AS DOUBLE)"
