"""Column statistics from mergeable sketches, one row per day and column (G7, G14, G16, PSI edges).

A day is read once and reduced, in every task before the shuffle, to

* counts and sums: rows, nulls, min, max, sum, sum of squares, sums with the label;
* a KLL sketch of the numeric values and an HLL sketch of the distinct ones.

Rows of many days merge into one; medians, quartiles, PSI edges and distinct
counts over any range of days come from the merged rows, the raw ones are never
read again.  Days are written with dynamic overwrite: a day that runs again
replaces itself.  The exact path (``ordered.exact_quantiles``) stays; these are
for tables where several passes cost too much.

Error: with ``KLL_K`` = 400 the rank of a quantile is off by at most
``RANK_ERROR`` of the values, with ``HLL_LG`` = 14 a distinct count by
``DISTINCT_ERROR`` (four standard errors each, about one miss in 16,000;
counts up to some thousands are all but exact).  Merging does not add to either.

Edge cases: NULL, NaN and infinite numbers are nulls; a column without values
has NULL statistics and 0 distinct values; rows without a day form a day of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K, RANK_ERROR = 400, 0.016
HLL_LG, DISTINCT_ERROR = 14, 0.033


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def day_sketches(df: DataFrame, day: Column, numeric: Sequence[str], text: Sequence[str] = (), label: Column | None = None) -> DataFrame:
    """(day, column_name, counts, sums, kll, hll) of every day in ``df``, in one pass."""
    y = F.coalesce(label.cast("double"), F.lit(0.0)) if label is not None else F.lit(None).cast("double")
    none = F.lit(None).cast("double")
    each = ([F.struct(F.lit(c).alias("column_name"), _number(c).alias("num"), _number(c).cast("string").alias("val")) for c in numeric]
            + [F.struct(F.lit(c).alias("column_name"), none.alias("num"), F.col(c).cast("string").alias("val")) for c in text])
    long = df.select(day.alias("day"), y.alias("y"), F.explode(F.array(*each)).alias("c")).select("day", "y", "c.*")
    held = F.when(F.col("num").isNotNull(), F.col("y"))  # the HLL sketch leaves out empty texts, so each gets a first letter
    return long.groupBy("day", "column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("val").isNull()).alias("nulls"), F.count("num").alias("numbers"),
        F.min("num").alias("min_value"), F.max("num").alias("max_value"),
        F.sum("num").alias("s"), F.sum(F.col("num") * F.col("num")).alias("ss"),
        F.sum(held).alias("sy"), F.sum(held * held).alias("syy"), F.sum(F.col("num") * held).alias("sxy"),
        F.kll_sketch_agg_double("num", KLL_K).alias("kll"), F.hll_sketch_agg(F.concat(F.lit("="), "val"), HLL_LG).alias("hll"))


def write_days(state: DataFrame, folder: str) -> None:
    """Adds the days of ``state``; days that are there already are replaced."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def read_days(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    """The days [start, end); only their partitions are listed and read."""
    d = spark.read.parquet(folder)
    if start is not None:
        d = d.where(F.col("day") >= F.lit(start))
    return d if end is None else d.where(F.col("day") < F.lit(end))


def merged(state: DataFrame) -> DataFrame:
    """One row per column over all days of ``state``."""
    add = [F.sum(c).alias(c) for c in ("rows", "nulls", "numbers", "s", "ss", "sy", "syy", "sxy")]
    return state.groupBy("column_name").agg(*add, F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
                                            F.kll_merge_agg_double("kll", KLL_K).alias("kll"), F.hll_union_agg("hll").alias("hll"))


def quantile(at: float) -> Column:
    """Of a merged row; NULL without numbers."""
    return F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(float(at))))


def statistics(m: DataFrame) -> DataFrame:
    """G14 and G16 from merged rows: counts, distinct values, quartiles, mean, correlation with the label."""
    n = F.col("numbers")
    vx, vy = n * F.col("ss") - F.col("s") * F.col("s"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select("column_name", "rows", "nulls", "numbers", F.hll_sketch_estimate("hll").alias("distinct_values"), "min_value", "max_value",
                    quantile(0.25).alias("p25"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"),
                    F.when(n > 0, F.col("s") / n).alias("mean"),
                    F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("s") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)).alias("corr_with_label"))


def scaler(m: DataFrame) -> DataFrame:
    """G7 from merged rows: the median, then mean and population deviation after missing values are set to it."""
    gap = F.col("rows") - F.col("numbers")
    d = m.where(F.col("numbers") > 0).withColumn("median", quantile(0.5))
    mean = (F.col("s") + gap * F.col("median")) / F.col("rows")
    square = (F.col("ss") + gap * F.col("median") * F.col("median")) / F.col("rows")
    return d.withColumn("mean", mean).select("column_name", "median", "mean", F.sqrt(F.greatest(square - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def bin_edges(m: DataFrame, bins: int = 10) -> DataFrame:
    """(column_name, edges): distinct baseline quantiles, ends exact, for ``drift`` and ``daily.day_bins``."""
    inner = [quantile(i / bins) for i in range(1, bins)]
    return m.where(F.col("numbers") > 0).select("column_name", F.array_sort(F.array_distinct(F.array("min_value", *inner, "max_value"))).alias("edges"))


def audit(df: DataFrame, m: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketches against an exact pass over ``df``: the rank error of each quantile and the error of the distinct count.

    A quantile's rank error is how far ``at`` lies outside the share of values below it and the share of those not above it.
    """
    names = [*numeric, *text]
    each = [F.struct(F.lit(c).alias("column_name"), (_number(c) if c in numeric else F.lit(None).cast("double")).alias("num"),
                     (_number(c) if c in numeric else F.col(c)).cast("string").alias("val")) for c in names]
    told = m.select("column_name", *[quantile(a).alias(f"__q{i}") for i, a in enumerate(at)], F.hll_sketch_estimate("hll").alias("__d"))
    long = df.select(F.explode(F.array(*each)).alias("c")).select("c.*").join(F.broadcast(told), "column_name")  # one row per column
    low = [F.count_if(F.col("num") < F.col(f"__q{i}")).alias(f"__l{i}") for i in range(len(at))]
    high = [F.count_if(F.col("num") <= F.col(f"__q{i}")).alias(f"__h{i}") for i in range(len(at))]
    d = long.groupBy("column_name").agg(F.count("num").alias("__n"), F.count_distinct("val").alias("distinct_exact"), F.first("__d").alias("distinct_values"), *low, *high)
    off = [F.greatest(F.col(f"__l{i}") / F.col("__n") - F.lit(a), F.lit(a) - F.col(f"__h{i}") / F.col("__n"), F.lit(0.0)) for i, a in enumerate(at)]
    worst = F.greatest(*off, F.lit(0.0))
    return d.select("column_name", F.when(F.col("__n") > 0, worst).alias("rank_error"), "distinct_exact", "distinct_values",
                    (F.abs(F.col("distinct_values") - F.col("distinct_exact")) / F.greatest("distinct_exact", F.lit(1))).alias("distinct_error"))
