"""Registered queries: encoders, challenger scores, champion/challenger reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound import config as C
from rebound.functions.parse import time_features
from rebound.operators import features as FE
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.memo import memo
from rebound.plans.q_metrics import split_modeling, split_sql

TE_COLS = ["merchant_vertical", "merchant_country"]
SCALE_COLS = ["amount_usd", "event_dayofweek", "event_month"]


def _cat(c: str) -> str:
    return f"coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING')"


TE_CTES = [
    ("gm", "SELECT avg(y) AS g FROM scored WHERE split = 'train'"),
    ("tlong", " UNION ALL ".join(f"SELECT '{c}' AS feature, {_cat(c)} AS value, y FROM scored WHERE split = 'train'"
                                 for c in TE_COLS)),
    ("enc", f"""
SELECT feature, value, count(*) AS rows,
       (avg(y) * count(*) + (SELECT g FROM gm) * {dbl(20.0)}) / (count(*) + {dbl(20.0)}) AS encoding
FROM tlong GROUP BY feature, value"""),
    ("cc", f"""
SELECT s.transaction_id, s.probability AS champion_probability,
       (coalesce(ev.encoding, (SELECT g FROM gm)) + coalesce(ec.encoding, (SELECT g FROM gm))) / {dbl(2.0)}
         AS challenger_probability
FROM scored s
LEFT JOIN enc ev ON ev.feature = 'merchant_vertical' AND ev.value = {_cat('s.merchant_vertical')}
LEFT JOIN enc ec ON ec.feature = 'merchant_country' AND ec.value = {_cat('s.merchant_country')}
WHERE s.split = 'test'"""),
    ("recon", """
SELECT *, champion_probability - challenger_probability AS probability_delta,
       abs(champion_probability - challenger_probability) AS absolute_delta FROM cc"""),
]


def challenger(spark: SparkSession, sf: str) -> DataFrame:
    """Challenger: mean of smoothed target encodings of vertical and country,
    fitted on the train window, scored on the test window (once per session)."""
    return memo(spark, ("challenger", sf), lambda: _challenger(spark, sf))


def _challenger(spark: SparkSession, sf: str) -> DataFrame:
    sm = split_modeling(spark, sf)
    enc, g = FE.fit_target_encoding(sm.where(F.col("split") == "train"), TE_COLS, "y")
    test = FE.apply_target_encoding(sm.where(F.col("split") == "test"), enc, TE_COLS, g)
    return test.select("transaction_id", ((F.col("merchant_vertical__target_encoded")
                                           + F.col("merchant_country__target_encoded")) / F.lit(2.0))
                       .alias("challenger_probability"))


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """M10 + J6: champion and challenger scores aligned by id (not by position)."""
    champ = (split_modeling(spark, sf).where(F.col("split") == "test")
             .select("transaction_id", F.col("probability").alias("champion_probability")))
    j = champ.join(challenger(spark, sf), "transaction_id")
    d = F.col("champion_probability") - F.col("challenger_probability")
    return j.withColumns({"probability_delta": d, "absolute_delta": F.abs(d)})


@register("target_encoding", sql_round(["encoding"], split_sql(
    "SELECT feature, value, rows, encoding FROM enc", TE_CTES)), ops=("G6",))
def q_target_encoding(spark, sf):
    sm = split_modeling(spark, sf)
    enc, _ = FE.fit_target_encoding(sm.where(F.col("split") == "train"), TE_COLS, "y")
    return round_doubles(enc)


@register("challenger_scores", sql_round(
    ["champion_probability", "challenger_probability", "probability_delta", "absolute_delta"],
    split_sql("SELECT * FROM recon", TE_CTES)), ops=("J4", "J6", "M10"))
def q_challenger_scores(spark, sf):
    return round_doubles(reconciliation(spark, sf))


@register("champion_challenger_summary", sql_round(
    ["mean_champion", "mean_challenger", "mean_abs_delta", "share_over_threshold"], split_sql(f"""
SELECT count(*) AS rows, avg(champion_probability) AS mean_champion,
       avg(challenger_probability) AS mean_challenger, avg(absolute_delta) AS mean_abs_delta,
       avg(CASE WHEN absolute_delta > {dbl(C.DISAGREEMENT_DELTA)} THEN 1.0 ELSE 0.0 END) AS share_over_threshold
FROM recon""", TE_CTES)), ops=("M10",))
def q_champion_challenger_summary(spark, sf):
    r = reconciliation(spark, sf)
    return round_doubles(r.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("champion_probability").alias("mean_champion"),
        F.avg("challenger_probability").alias("mean_challenger"),
        F.avg("absolute_delta").alias("mean_abs_delta"),
        F.avg(F.when(F.col("absolute_delta") > C.DISAGREEMENT_DELTA, F.lit(1.0)).otherwise(F.lit(0.0)))
        .alias("share_over_threshold")))


@register("largest_disagreements", sql_round(
    ["champion_probability", "challenger_probability", "probability_delta", "absolute_delta"],
    split_sql("SELECT * FROM recon ORDER BY absolute_delta DESC, transaction_id LIMIT 12", TE_CTES)),
    ops=("W4", "M10"))
def q_largest_disagreements(spark, sf):
    r = reconciliation(spark, sf)
    return round_doubles(r.orderBy(F.col("absolute_delta").desc(), F.col("transaction_id")).limit(12))


@register("numeric_scaler", sql_round(["median", "mean", "std"], split_sql(f"""
SELECT feature, median, avg(coalesce(value, median)) AS mean,
       CASE WHEN stddev_pop(coalesce(value, median)) IS NULL OR stddev_pop(coalesce(value, median)) = 0
            THEN {dbl(1.0)} ELSE stddev_pop(coalesce(value, median)) END AS std
FROM (SELECT l.feature, l.value, m.median FROM nl l JOIN (SELECT feature, quantile_cont(value, 0.5) AS median
                                                       FROM nl GROUP BY feature) AS m USING (feature)) AS x
GROUP BY feature, median""", [("nl", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({e} AS DOUBLE) AS value FROM scored WHERE split = 'train'"
    for c, e in [("amount_usd", "amount_usd"), ("event_dayofweek", "isodow(ts) - 1"),
                 ("event_month", "month(ts)")]))])), ops=("G7",))
def q_numeric_scaler(spark, sf):
    sm = split_modeling(spark, sf).withColumns(time_features("timestamp"))
    return round_doubles(FE.fit_numeric_scaler(sm.where(F.col("split") == "train"), SCALE_COLS))


@register("top_category_buckets", split_sql(f"""
SELECT s.transaction_id, CASE WHEN t.value IS NOT NULL THEN t.value ELSE 'OTHER' END AS merchant_country_bucket
FROM scored s LEFT JOIN (
  SELECT value FROM (SELECT {_cat('merchant_country')} AS value, count(*) AS n FROM scored WHERE split = 'train'
                     GROUP BY 1) AS c
  ORDER BY n DESC, value LIMIT 12) AS t ON t.value = {_cat('s.merchant_country')}
WHERE s.split = 'test'"""), ops=("G8",))
def q_top_category_buckets(spark, sf):
    sm = split_modeling(spark, sf)
    top = FE.fit_top_categories(sm.where(F.col("split") == "train"), "merchant_country", 12)
    return sm.where(F.col("split") == "test").select(
        "transaction_id", FE.top_category_bucket("merchant_country", top).alias("merchant_country_bucket"))


@register("category_vocabulary", split_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_cat(c)} AS value, count(*) AS rows FROM scored WHERE split = 'train' GROUP BY 2"
    for c in ["merchant_country", "merchant_vertical", "processor_name", "response_code"])), ops=("G10", "A5"))
def q_category_vocabulary(spark, sf):
    sm = split_modeling(spark, sf).where(F.col("split") == "train")
    return FE.vocabulary(sm, ["merchant_country", "merchant_vertical", "processor_name", "response_code"])


FEATURES = ["amount_usd", "is_soft_decline", "merchant_country", "merchant_vertical", "processor_name",
            "response_code", "event_hour", "event_dayofweek", "event_month", "is_weekend"]


@register("feature_matrix", sql_round(["amount_usd"], split_sql(f"""
SELECT transaction_id, CAST(amount_usd AS DOUBLE) AS amount_usd,
       coalesce(CAST(is_soft_decline AS INTEGER), 0) AS is_soft_decline,
       coalesce(merchant_country, 'MISSING') AS merchant_country,
       coalesce(merchant_vertical, 'MISSING') AS merchant_vertical,
       coalesce(processor_name, 'MISSING') AS processor_name,
       coalesce(response_code, 'MISSING') AS response_code,
       CAST(coalesce(hour(ts), 0) AS DOUBLE) AS event_hour,
       CAST(coalesce(isodow(ts) - 1, 0) AS DOUBLE) AS event_dayofweek,
       CAST(coalesce(month(ts), 0) AS DOUBLE) AS event_month,
       coalesce(CAST(coalesce(isodow(ts) - 1, 0) IN (5, 6) AS INTEGER), 0) AS is_weekend
FROM scored""")), ops=("P11", "P12", "P13", "P14", "A3", "A4", "P5"))
def q_feature_matrix(spark, sf):
    sm = FE.guard_forbidden(split_modeling(spark, sf).withColumns(time_features("timestamp")))
    cols = FE.select_allowed(sm, FEATURES)
    assert set(cols) <= set(FE.select_by_exclusion(sm)) | {"merchant_country"}
    return round_doubles(FE.coerce_features(sm, cols, keep=["transaction_id"]))
