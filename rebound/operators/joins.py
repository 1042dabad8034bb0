"""Joins that keep NULL keys: NULL matches NULL, as in grouping and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on columns of equal name, null-safe; the left side's keys are kept."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, cond, how).drop(*names.values())
