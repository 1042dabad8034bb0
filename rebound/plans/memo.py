"""Per-session reuse of the shared intermediates (the modeling table, the split).

The modeling table is the one intermediate every report reads; it is
materialised once per session with a reliable checkpoint in the shared
``spark.checkpoint.dir`` (survives executor loss, cuts lineage), and the
split boundaries are computed once.  An entry holds as long as the files of its
tables do: when their listing (name, size, time of change) differs, it is built
anew and the old one is let go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MEMO: dict = {}


def _session_key(spark: SparkSession):
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        return "connect"


def _listing(spark: SparkSession, folder: str) -> tuple:
    """(name, size, time of change) of what lies in a table folder, two levels deep."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    except Exception:  # noqa: BLE001 - no JVM at hand (Spark Connect): entries hold for the session
        return ()
    out = []
    for a in fs.listStatus(path):
        inner = fs.listStatus(a.getPath()) if a.isDirectory() else [a]
        out += [(b.getPath().toString(), b.getLen(), b.getModificationTime()) for b in inner]
    return tuple(sorted(out))


def memo(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """``key`` is (name, table folder)."""
    k = (_session_key(spark), id(spark), key)
    state = _listing(spark, key[1])
    if k not in _MEMO or _MEMO[k][0] != state:
        _MEMO[k] = (state, build())
    return _MEMO[k][1]


def clear() -> None:
    _MEMO.clear()
