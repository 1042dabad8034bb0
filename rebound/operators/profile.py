"""Profiles, marts and data-quality tests.

Each profile unpivots the columns it covers and runs one grouped pass, so the
job count does not grow with the number of columns (the reference runs one
scan per column/segment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound import config as C
from rebound.functions.parse import missing_as
from rebound.operators.ordered import exact_quantiles, top_k_per_group


# ---------------------------------------------------------------- G4
def label_rates(modeling: DataFrame) -> DataFrame:
    """G4 overview: label, first-retry label and retried rates."""
    return modeling.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("target_recovered_by_retry").alias("recovered"),
        F.count_if("target_first_retry_approved").alias("first_retry_recovered"),
        F.count_if("has_any_retry").alias("retried"),
    ).select("*", (F.col("recovered") / F.col("rows")).alias("recovered_rate"),
             (F.col("first_retry_recovered") / F.col("rows")).alias("first_retry_recovered_rate"),
             (F.col("retried") / F.col("rows")).alias("retried_rate"))


def recovery_by_dimension(modeling: DataFrame, dims: Sequence[str], top: int = 10,
                          label: str = "target_recovered_by_retry", retried: str = "has_any_retry") -> DataFrame:
    """Rows, recovered and rate per value of each dimension, top-``top``
    values per dimension by rows (ties by value).  One grouped pass for all
    dimensions (the grouping sets of the reference, as an unpivot)."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    r = F.coalesce(F.col(retried).cast("int"), F.lit(0))
    src = modeling.select(y.alias("__y"), r.alias("__r"),
                          *[missing_as(F.col(d).cast("string")).alias(d) for d in dims])
    long = src.selectExpr("__y", "__r", f"stack({len(dims)}, " + ", ".join(f"'{d}', {d}" for d in dims)
                          + ") AS (dimension, value)")
    g = (long.groupBy("dimension", "value")
         .agg(F.count(F.lit(1)).alias("rows"), F.sum("__y").cast("bigint").alias("recovered"),
              F.sum("__r").cast("bigint").alias("retried"))
         .withColumn("__neg", -F.col("rows")))
    kept = top_k_per_group(g, ["dimension"], ["__neg", "value"], top)
    return kept.select("dimension", "value", "rows", "recovered",
                       (F.col("recovered") / F.col("rows")).alias("recovery_rate"), "retried",
                       (F.col("retried") / F.col("rows")).alias("retried_rate"))


# ---------------------------------------------------------------- G13
def merchant_week_mart(attempts: DataFrame, merchant: str = "merchant_id", ts: str = "timestamp",
                       status: str = "auth_status", code: str = "response_code", top: int = 3) -> DataFrame:
    """Per merchant and ISO week: attempts, approval / decline rates and
    the top decline codes ("code:count" joined by '|', ties by code).

    Codes are collapsed per (merchant, week, code) first, so the ranking window
    holds at most the code vocabulary per merchant-week.
    """
    wk = F.date_trunc("week", F.col(ts))
    base = attempts.select(F.col(merchant).alias("merchant_id"), wk.alias("__wk"),
                           (F.col(status) == "APPROVED").alias("__ok"), F.col(code).alias("__code"))
    totals = base.groupBy("merchant_id", "__wk").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("__ok").alias("approvals"),
        F.count_if(~F.col("__ok")).alias("declines"))
    codes = (base.where(~F.col("__ok")).groupBy("merchant_id", "__wk", "__code")
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("merchant_id", "__wk").orderBy(F.col("n").desc(), F.col("__code").asc())
    topc = (codes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
            .groupBy("merchant_id", "__wk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "__code", "n"))),
                                          lambda s: F.concat_ws(":", s["__code"], s["n"].cast("string"))),
                              "|").alias("top_decline_codes")))
    return (totals.join(topc, ["merchant_id", "__wk"], "left")
            .select("merchant_id", F.date_format("__wk", "yyyy-MM-dd").alias("week"), "attempts",
                    "approvals", "declines", (F.col("approvals") / F.col("attempts")).alias("approval_rate"),
                    (F.col("declines") / F.col("attempts")).alias("decline_rate"),
                    F.coalesce("top_decline_codes", F.lit("")).alias("top_decline_codes")))


# ---------------------------------------------------------------- G14
def _family(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "string"


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: type family, rows, nulls, distinct values, numeric min/max.

    ``approx=True`` uses ``approx_count_distinct`` for very wide tables.
    """
    spark = df.sparkSession
    cols = list(cols or df.columns)
    fam = {c: _family(df.schema[c].dataType) for c in cols}
    long = df.selectExpr(
        f"stack({len(cols)}, " + ", ".join(
            f"'{c}', CAST(`{c}` AS STRING), "
            + (f"CAST(`{c}` AS DOUBLE)" if fam[c] == "numeric" else "CAST(NULL AS DOUBLE)")
            for c in cols) + ") AS (column_name, value, num)")
    dc = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    agg = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"),
        dc.alias("distinct_values"), F.min("num").alias("min_value"), F.max("num").alias("max_value"))
    # distribution: exact quartiles of the numeric columns (one grouped pass)
    numeric = [c for c in cols if fam[c] == "numeric"]
    quart = exact_quantiles(long.where(F.col("column_name").isin(*numeric)), "num", [0.25, 0.5, 0.75],
                            ["column_name"]) if numeric else {}
    rows = [(c, fam[c], *(quart.get((c,)) or [None, None, None])) for c in cols]
    types = spark.createDataFrame(rows, "column_name string, type_family string, p25 double, p50 double, "
                                        "p75 double")
    return types.join(agg, "column_name", "left")


# ---------------------------------------------------------------- G15
def feature_coverage(df: DataFrame, derived: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Role (candidate / derived / excluded) and fill rate of every column."""
    spark = df.sparkSession
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    long = agg.selectExpr("__rows", f"stack({len(cols)}, " + ", ".join(f"'{c}', `{c}`" for c in cols)
                          + ") AS (column_name, non_null)")
    roles = spark.createDataFrame(
        [(c, "derived" if c in derived else "excluded" if c in excluded else "candidate") for c in cols],
        "column_name string, role string")
    return long.join(roles, "column_name").select(
        "column_name", "role", "non_null", F.col("__rows").alias("rows"),
        (F.col("non_null") / F.col("__rows")).alias("fill_rate"))


# ---------------------------------------------------------------- G16
def feature_statistics(df: DataFrame, numeric: Sequence[str], label: str) -> DataFrame:
    """Mean, exact median, distinct count and correlation with the label."""
    spark = df.sparkSession
    y = F.coalesce(F.col(label).cast("int"), F.lit(0)).cast("double")
    long = df.select(y.alias("__y"), *[F.col(c).cast("double").alias(c) for c in numeric]).selectExpr(
        "__y", f"stack({len(numeric)}, " + ", ".join(f"'{c}', {c}" for c in numeric) + ") AS (feature, value)")
    med = exact_quantiles(long, "value", [0.5], ["feature"])
    mt = spark.createDataFrame([(c, (med.get((c,)) or [None])[0]) for c in numeric], "feature string, median double")
    agg = long.groupBy("feature").agg(F.avg("value").alias("mean"),
                                      F.count_distinct("value").alias("distinct_values"),
                                      F.corr("value", "__y").alias("corr_with_label"))
    return agg.join(F.broadcast(mt), "feature")


# ---------------------------------------------------------------- Q1 / Q2
def table_tests(tests: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Q1/Q2: each test is (name, table, failing-row condition); returns
    (test, rows, failures).  Tests of one table share one scan and one
    aggregate, whose counts are then laid out as rows."""
    tables: list = []
    for name, df, bad in tests:
        own = next((t for t in tables if t[0] is df), None)
        if own is None:
            tables.append(own := (df, []))
        own[1].append((name, bad))
    out = None
    for df, own in tables:
        counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(f"__f{i}") for i, (_, bad) in enumerate(own)])
        r = counted.select("rows", F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.col(f"__f{i}").alias("failures"))
                                                       for i, (n, _) in enumerate(own)])).alias("t")) \
            .select("t.test", "rows", "t.failures")
        out = r if out is None else out.unionByName(r)
    return out


def duplicate_key_test(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1 unique: rows whose key occurs more than once count as failures."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("failures")) \
        .select(F.lit(name).alias("test"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
                F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


def baseline_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, share) of every category (missing ones as MISSING): what a
    table test keeps of its baseline.  One row per category, whatever the table's size."""
    n = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), missing_as(f"`{c}`").alias("value")) for c in columns])).alias("x"))
         .groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("feature").agg(F.sum("n").alias("total"))
    return n.join(total, "feature").select("feature", "value", (F.col("n") / F.col("total")).alias("share"))


def category_shift_test(df: DataFrame, baseline: DataFrame, columns: Sequence[str], limit: float = C.JS_ALERT) -> DataFrame:
    """Q2: per column (test, rows, failures, divergence, unseen_rows): Jensen-Shannon divergence (natural log) of the
    table's category shares from the stored ``baseline``.  Beyond ``limit`` all rows fail, else those of categories
    that the baseline does not have.

    The table is reduced to its category counts first; those meet the baseline
    in one join, so no row of the table is shuffled.  A column without rows has
    no divergence and no failures; against an empty baseline every row is unseen.
    """
    counts = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), missing_as(f"`{c}`").alias("value")) for c in columns])).alias("x"))
              .groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    both = (counts.join(baseline.where(F.col("feature").isin(*columns)), ["feature", "value"], "full_outer")
            .join(total, "feature", "left")
            .withColumns({"q": F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), "p": F.coalesce("share", F.lit(0.0))}))
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.lit(2.0) * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    found = both.groupBy("feature").agg(F.coalesce(F.max("total"), F.lit(0)).cast("bigint").alias("rows"),
                                        F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("n"))), F.lit(0)).alias("unseen_rows"),
                                        (F.lit(0.5) * F.sum(term("p")) + F.lit(0.5) * F.sum(term("q"))).alias("d"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(found, "feature", "left").na.fill(0, ["rows", "unseen_rows"])
    d = F.when(F.col("rows") > 0, F.col("d"))
    return named.select(F.concat(F.col("feature"), F.lit("_shift")).alias("test"), "rows",
                        F.when(d > limit, F.col("rows")).otherwise(F.col("unseen_rows")).alias("failures"), d.alias("divergence"), "unseen_rows")


# ---------------------------------------------------------------- Q3
def snake_case(name: str) -> str:
    import re
    s = re.sub(r"[^0-9A-Za-z]+", "_", name)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    return s.strip("_").lower()


def stage(df: DataFrame, casts: dict[str, str], valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Q3: snake-case names, typed casts (bad values -> NULL), invalid rows
    split off.  Returns (accepted, rejected)."""
    cols = [F.col(f"`{c}`").try_cast(casts[c]).alias(snake_case(c)) if c in casts
            else F.col(f"`{c}`").alias(snake_case(c)) for c in df.columns]
    typed = df.select(*cols)
    if valid is None:
        return typed, typed.limit(0)
    flagged = typed.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    return flagged.where("__ok").drop("__ok"), flagged.where(~F.col("__ok")).drop("__ok")
