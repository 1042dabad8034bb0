"""Per-row explanations.

Contributions live in an ``array<struct<feature, feature_value, contribution>>``
column; ranking, direction and phrases are higher-order array functions on
that column, so explanations never leave the JVM and never need a per-row
Python loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebound.functions.parse import strip_ws

# FIXED VALUES: phrase templates per feature ({v} value, {d} direction word).
TEMPLATES = {
    "response_code": "Response code `{v}` {d} the predicted retry recoverability.",
    "is_soft_decline": "`is_soft_decline={v}` {d} the predicted retry recoverability.",
    "risk_skip_flag": "`risk_skip_flag={v}` {d} the predicted retry recoverability.",
    "processor_name": "Processor `{v}` {d} the predicted retry recoverability.",
    "merchant_country": "Merchant country `{v}` {d} the predicted retry recoverability.",
    "merchant_vertical": "Merchant vertical `{v}` {d} the predicted retry recoverability.",
    "latency_ms": "Authorization latency of `{v}` ms {d} the predicted retry recoverability.",
    "event_hour": "Event hour `{v}` {d} the predicted retry recoverability.",
}
DEFAULT_TEMPLATE = "Feature `{f}` with value `{v}` {d} the predicted retry recoverability."
AMOUNT_TEMPLATE = "Transaction amount `${a}` {d} the predicted retry recoverability."
MISSING_TEMPLATE = "Feature `{f}` was not provided in the request; its contribution is treated as neutral."
ZERO_TEMPLATE = "Feature `{f}` had no measurable contribution to the predicted retry recoverability."


def contributions(terms: Sequence[tuple[str, Column, Column]], raw: dict[str, Column] | None = None) -> Column:
    """X1 (+X2): array of (position, feature, feature_value, contribution).

    ``terms``: (feature, value-as-string, contribution).  ``raw`` maps a
    feature to the caller's raw input; where it is NULL or blank the
    contribution is zeroed so an omitted input never reads as a driver.
    """
    raw = raw or {}
    items = []
    for i, (f, v, c) in enumerate(terms):
        contrib = c.cast("double")
        if f in raw:
            r = strip_ws(raw[f].cast("string"))
            contrib = F.when(r.isNull() | (r == ""), F.lit(0.0)).otherwise(contrib)
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                              v.cast("string").alias("feature_value"), contrib.alias("contribution")))
    return F.array(*items)


def linear_terms(weights: dict[str, float], means: dict[str, float]) -> list[tuple[str, Column, Column]]:
    """X1 for a linear model: w * (x - mean) per feature (exact)."""
    return [(f, F.col(f), F.lit(w) * (F.col(f).cast("double") - F.lit(means.get(f, 0.0))))
            for f, w in weights.items()]


def top_contributions(arr: Column, n: int) -> Column:
    """The n largest |contribution|, ties by feature position."""
    ordered = F.array_sort(arr, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                           .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
                           .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return F.slice(ordered, 1, n)


def direction(c: Column) -> Column:
    """X4."""
    return F.when(c == 0, F.lit("neutral")).when(c > 0, F.lit("increase")).otherwise(F.lit("decrease"))


def phrase(feature: Column, value: Column, contribution: Column) -> Column:
    """Business phrase for one contribution (neutral forms first)."""
    d = F.when(contribution > 0, F.lit("increased")).otherwise(F.lit("decreased"))

    def fill(t: str) -> Column:
        out = F.lit(t)
        out = F.replace(out, F.lit("{v}"), F.coalesce(value, F.lit("")))
        out = F.replace(out, F.lit("{d}"), d)
        return F.replace(out, F.lit("{f}"), feature)

    amt = value.try_cast("double")
    amount_text = F.replace(F.replace(F.lit(AMOUNT_TEMPLATE), F.lit("{a}"),
                                      F.format_number(F.floor(amt * 100 + 0.5) / 100, 2)), F.lit("{d}"), d)
    by_feature = fill(DEFAULT_TEMPLATE)
    for f, t in reversed(list(TEMPLATES.items())):
        by_feature = F.when(feature == f, fill(t)).otherwise(by_feature)
    by_feature = F.when((feature == "amount_usd") & amt.isNotNull(), amount_text).otherwise(by_feature)
    return (F.when(value.isNull(), fill(MISSING_TEMPLATE))
            .when(contribution == 0, fill(ZERO_TEMPLATE))
            .otherwise(by_feature))


def explain(df: DataFrame, contrib_col: str, n: int, out: str = "top_explanation_features") -> DataFrame:
    """Attach the top-n list with direction and phrase."""
    top = top_contributions(F.col(contrib_col), n)
    return df.withColumn(out, F.transform(top, lambda s, i: F.struct(
        (i + 1).alias("rank"), s["feature"].alias("feature"), s["feature_value"].alias("feature_value"),
        s["contribution"].alias("contribution"), direction(s["contribution"]).alias("direction"),
        phrase(s["feature"], s["feature_value"], s["contribution"]).alias("business_explanation"))))


def explanation_rows(df: DataFrame, id_col: str, col: str = "top_explanation_features") -> DataFrame:
    """Long form (one row per id and rank) of an explanation list."""
    return df.select(id_col, F.explode(col).alias("e")).select(id_col, "e.*")


def global_importance(df: DataFrame, contrib_col: str) -> DataFrame:
    """Mean |contribution| per feature."""
    return (df.select(F.explode(contrib_col).alias("c"))
            .groupBy(F.col("c.feature").alias("feature"))
            .agg(F.avg(F.abs("c.contribution")).alias("mean_abs_contribution")))
