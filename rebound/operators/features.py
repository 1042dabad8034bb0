"""Feature selection, typing and encoders.

Encoders are fitted on the training rows as small grouped tables and applied
by left joins; whether such a table is broadcast is decided by its measured
size (``SMALL``, or AQE's threshold), never assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound import config as C
from rebound.functions.parse import missing_as
from rebound.operators.ordered import exact_quantiles, top_k_per_group
from rebound.session import materialize

#: Rows of an encoder that is broadcast.
SMALL = 100_000


class ForbiddenColumnError(RuntimeError):
    pass


# ---------------------------------------------------------------- P11-P14
def guard_forbidden(df: DataFrame, forbidden: Sequence[str] = tuple(C.FORBIDDEN_COLUMNS)) -> DataFrame:
    """Fail before any job when card data columns are present (any case)."""
    bad = sorted({c.lower() for c in df.columns} & {f.lower() for f in forbidden})
    if bad:
        raise ForbiddenColumnError(f"card data columns present: {bad}; refusing to build features")
    return df


def select_allowed(df: DataFrame, allowlist: Sequence[str]) -> list[str]:
    """Allowlisted columns present in the table, in table order."""
    allow = set(allowlist)
    return [c for c in df.columns if c in allow]


def select_by_exclusion(df: DataFrame, extra_exclude: Sequence[str] = ()) -> list[str]:
    """Every column except leaky, identifier and link columns."""
    ex = set(C.LEAKY_COLUMNS) | set(C.IDENTIFIER_COLUMNS) | set(extra_exclude)
    return [c for c in df.columns if c not in ex and "original_transaction_id" not in c]


def feature_kinds(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """A4: boolean / numeric / categorical by schema type."""
    kinds = {"boolean": [], "numeric": [], "categorical": []}
    for c in cols:
        t = df.schema[c].dataType
        if isinstance(t, T.BooleanType):
            kinds["boolean"].append(c)
        elif isinstance(t, T.NumericType):
            kinds["numeric"].append(c)
        else:
            kinds["categorical"].append(c)
    return kinds


def coerce_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Booleans NULL -> 0 as int, numerics as double, categoricals NULL -> 'MISSING'."""
    k = feature_kinds(df, cols)
    out = [F.col(c) for c in keep]
    for c in cols:
        if c in k["boolean"]:
            out.append(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c))
        elif c in k["numeric"]:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias(c))
    return df.select(*out)


# ---------------------------------------------------------------- G6 / J4
def _long(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    exprs = ", ".join(f"'{c}', {c}" for c in cols)
    cat = df.select(*extra, *[missing_as(c).alias(c) for c in cols])
    return cat.selectExpr(*extra, f"stack({len(cols)}, {exprs}) AS (feature, value)")


def fit_target_encoding(train: DataFrame, cols: Sequence[str], target: str,
                        smoothing: float = C.TARGET_ENCODING_SMOOTHING) -> tuple[DataFrame, float]:
    """(mean * n + global * s) / (n + s) per (feature, value) over train.

    Returns the encoder table (feature, value, rows, encoding) and the global
    mean (a single number on the driver).
    """
    y = F.coalesce(F.col(target).cast("int"), F.lit(0)).cast("double")
    g = train.agg(F.avg(y)).first()[0] or 0.0
    long = _long(train.withColumn("__y", y), cols, ["__y"])
    enc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"), F.avg("__y").alias("__m"))
    s = F.lit(float(smoothing))
    enc = enc.select("feature", "value", "rows",
                     ((F.col("__m") * F.col("rows") + F.lit(g) * s) / (F.col("rows") + s)).alias("encoding"))
    return enc, g


def apply_target_encoding(df: DataFrame, enc: DataFrame, cols: Sequence[str], global_mean: float,
                          suffix: str = "__target_encoded") -> DataFrame:
    """Lookup with default; unseen values get the global mean.

    The encoder is built and counted first: left to AQE, ``df`` would be
    shuffled whole before the encoder's size is known.
    """
    out, enc = df, materialize(enc)
    known = F.broadcast if enc.count() <= SMALL else lambda e: e
    for c in cols:
        e = enc.where(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"),
                                                    F.col("encoding").alias(f"__e_{c}"))
        out = (out.withColumn(f"__k_{c}", missing_as(c))
               .join(known(e), F.col(f"__k_{c}") == F.col(f"__v_{c}"), "left")
               .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"__e_{c}"), F.lit(global_mean)))
               .drop(f"__k_{c}", f"__v_{c}", f"__e_{c}"))
    return out


# ---------------------------------------------------------------- G7
def fit_numeric_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median (exact), then mean and population std of median-imputed values
    (std 0 or undefined -> 1).  Returns (feature, median, mean, std)."""
    spark = train.sparkSession
    long = train.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
                            + ") AS (feature, value)")
    med = exact_quantiles(long, "value", [0.5], ["feature"])
    medians = {c: (med.get((c,), [0.0])[0]) for c in cols}
    mtable = spark.createDataFrame([(c, float(medians[c])) for c in cols], "feature string, median double")
    imputed = long.join(F.broadcast(mtable), "feature").withColumn(
        "__x", F.coalesce(F.col("value"), F.col("median")))
    st = imputed.groupBy("feature", "median").agg(F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("__s"))
    return st.select("feature", "median", "mean",
                     F.when(F.col("__s").isNull() | (F.col("__s") == 0), F.lit(1.0)).otherwise(F.col("__s"))
                     .alias("std"))


def apply_numeric_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise with the fitted stats (few numbers: brought to the driver)."""
    s = {r["feature"]: r for r in stats.collect()}
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(s[c]["median"])) - F.lit(s[c]["mean"]))
                           / F.lit(s[c]["std"]) for c in cols})


# ---------------------------------------------------------------- G8 / G10
def fit_top_categories(train: DataFrame, col: str, k: int = 12) -> list[str]:
    """The k most frequent training values (ties by value)."""
    counts = (train.select(missing_as(col).alias("value")).groupBy("value")
              .agg(F.count(F.lit(1)).alias("n")).withColumn("neg", -F.col("n"))
              .withColumn("g", F.lit(0)))
    top = top_k_per_group(counts, ["g"], ["neg", "value"], k)
    return [r["value"] for r in top.orderBy("neg", "value").collect()]


def top_category_bucket(col: str, top: Sequence[str], other: str = "OTHER") -> Column:
    """G8 apply: value if among the top values, else OTHER."""
    v = missing_as(col)
    return F.when(v.isin(*top), v).otherwise(F.lit(other)) if top else F.lit(other)


def one_hot(col: str, top: Sequence[str], other: str = "OTHER") -> dict[str, Column]:
    b = top_category_bucket(col, top, other)
    return {f"{col}__{v}": (b == F.lit(v)).cast("int") for v in [*top, other]}


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (feature, value) with row counts (NULL -> MISSING)."""
    return _long(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))
