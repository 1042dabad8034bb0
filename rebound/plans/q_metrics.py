"""Registered queries: split, quality measures, threshold search, segments, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import decide, metrics
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.memo import memo
from rebound.plans.q_labels import modeling
from rebound.plans.sqlbase import rule_probability_sql, with_ctes
from rebound.plans.sqlmetrics import bundle_sql, first_best_sql, frontier_sql, sweep_sql

THRESHOLD = C.OFFLINE_POLICY_THRESHOLD


def split_modeling(spark: SparkSession, sf: str) -> DataFrame:
    """Modeling table + temporal split + rule probability (shared base; the
    split boundaries are found once per session)."""
    def build():
        m = metrics.temporal_split(modeling(spark, sf), "timestamp", "transaction_id")
        return (m.withColumn("probability", decide.rule_probability())
                .withColumn("y", F.col("target_recovered_by_retry").cast("int")))
    return memo(spark, ("split_modeling", sf), build)


SPLIT_CTES = [
    ("split", """
SELECT *, CASE WHEN rn - 1 < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
               WHEN rn - 1 < floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts ASC NULLS LAST, transaction_id) AS rn,
             count(*) OVER () AS n FROM modeling) AS o"""),
    ("scored", f"""
SELECT *, {rule_probability_sql()} AS probability, CAST(target_recovered_by_retry AS INTEGER) AS y
FROM split"""),
]


def split_sql(body: str, more: list[tuple[str, str]] | None = None) -> str:
    return with_ctes(body, extra=SPLIT_CTES + (more or []))


@register("temporal_split", split_sql("SELECT transaction_id, split FROM split"), ops=("W1", "T5"))
def q_temporal_split(spark, sf):
    return split_modeling(spark, sf).select("transaction_id", "split")


BUNDLE_DOUBLES = ["log_loss", "brier", "precision", "recall", "f1", "predicted_positive_rate", "auc"]


@register("split_metrics", sql_round(BUNDLE_DOUBLES, split_sql(
    bundle_sql("scored", "split", dbl(THRESHOLD)))), ops=("M1", "M2", "M3", "M4", "M5", "W3"))
def q_split_metrics(spark, sf):
    return round_doubles(metrics.metric_bundle(split_modeling(spark, sf), "y", "probability",
                                               THRESHOLD, ["split"]))


@register("overall_metrics", sql_round(BUNDLE_DOUBLES, split_sql(
    bundle_sql("scored", "", dbl(THRESHOLD)))), ops=("M1", "M5"))
def q_overall_metrics(spark, sf):
    return round_doubles(metrics.metric_bundle(split_modeling(spark, sf), "y", "probability", THRESHOLD))


@register("threshold_sweep", sql_round(["precision", "recall", "f1"], split_sql(
    sweep_sql("scored", "split"))), ops=("M6", "T7"))
def q_threshold_sweep(spark, sf):
    return round_doubles(metrics.threshold_sweep(split_modeling(spark, sf), "y", "probability", ["split"]))


@register("best_f1_threshold", sql_round(["best_f1"], split_sql(first_best_sql(
    sweep_sql("scored", "split"), "split", "f1", "split, threshold AS best_threshold, f1 AS best_f1"))),
    ops=("M6",))
def q_best_f1_threshold(spark, sf):
    return round_doubles(metrics.best_f1_threshold(split_modeling(spark, sf), "y", "probability", ["split"]))


FRONTIER_DOUBLES = ["gross_margin_recovered_usd", "wasted_retry_cost_usd", "friction_cost_usd",
                    "realized_net_value_usd"]


@register("net_value_frontier", sql_round(FRONTIER_DOUBLES, split_sql(frontier_sql("scored", "split"))),
          ops=("D5b",))
def q_net_value_frontier(spark, sf):
    return round_doubles(metrics.net_value_frontier(split_modeling(spark, sf), "y", "probability",
                                                    group_cols=["split"]))


@register("best_net_value_threshold", sql_round(["best_net_value_usd"], split_sql(first_best_sql(
    frontier_sql("scored", "split"), "split", "realized_net_value_usd",
    "split, threshold AS best_threshold, realized_net_value_usd AS best_net_value_usd"))), ops=("D5",))
def q_best_net_value_threshold(spark, sf):
    f = metrics.net_value_frontier(split_modeling(spark, sf), "y", "probability", group_cols=["split"])
    return round_doubles(metrics.best_net_value_threshold(f, ["split"]))


def segment_ctes() -> list[tuple[str, str]]:
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS segment_column, coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING') AS segment_value, "
        f"y, probability FROM scored WHERE split = 'test'" for c, _ in C.SEGMENT_SPECS)
    limits = " ".join(f"WHEN '{c}' THEN {k}" for c, k in C.SEGMENT_SPECS)
    more = [
        ("seg_long", unions),
        ("seg_top", f"""
SELECT segment_column, segment_value FROM (
  SELECT segment_column, segment_value, count(*) AS n,
         row_number() OVER (PARTITION BY segment_column ORDER BY count(*) DESC, segment_value ASC) AS r
  FROM seg_long GROUP BY segment_column, segment_value) AS c
WHERE r <= CASE segment_column {limits} END AND n >= {C.SEGMENT_MIN_SUPPORT}"""),
        ("seg_rows", "SELECT l.* FROM seg_long l JOIN seg_top t USING (segment_column, segment_value)"),
    ]
    return more


def _segment_sql() -> str:
    more = segment_ctes()
    body = f"""
SELECT segment_column, segment_value, rows, positives / rows AS positive_rate, auc, precision, recall, f1
FROM ({bundle_sql('seg_rows', 'segment_column, segment_value', dbl(THRESHOLD))}) AS m"""
    return sql_round(["positive_rate", "auc", "precision", "recall", "f1"], split_sql(body, more))


@register("segment_metrics", _segment_sql(), ops=("G5", "W9", "T9", "M14"))
def q_segment_metrics(spark, sf):
    test = split_modeling(spark, sf).where(F.col("split") == "test")
    return round_doubles(metrics.segment_metrics(test, "y", "probability", THRESHOLD))


def _calibration_sql(split: str) -> str:
    qs = ", ".join(dbl(i / 10) for i in range(11))
    more = [
        ("cal_src", f"SELECT probability, y FROM scored WHERE split = '{split}' AND probability IS NOT NULL"),
        ("cal_edges", f"SELECT list_sort(list_distinct(quantile_cont(probability, [{qs}]))) AS e FROM cal_src"),
        ("cal_b", """
SELECT CAST(greatest(len(list_filter(e, lambda x: x < probability)) - 1, 0) AS INTEGER) AS bucket, probability, y
FROM cal_src, cal_edges WHERE probability <= e[len(e)]"""),
        ("cal_bounds", """
SELECT CAST(i - 1 AS INTEGER) AS bucket, e[i] AS lower, e[i + 1] AS upper
FROM cal_edges, range(1, len(cal_edges.e)) AS r(i)"""),
    ]
    body = """
SELECT b.bucket, b.lower, b.upper, coalesce(a.rows, 0) AS rows, a.mean_pred, a.event_rate
FROM cal_bounds b LEFT JOIN (SELECT bucket, count(*) AS rows, avg(probability) AS mean_pred, avg(y) AS event_rate
                             FROM cal_b GROUP BY bucket) AS a USING (bucket)"""
    return sql_round(["lower", "upper", "mean_pred", "event_rate"], split_sql(body, more))


@register("calibration_curve", _calibration_sql("test"), ops=("M7", "T10"))
def q_calibration_curve(spark, sf):
    test = split_modeling(spark, sf).where(F.col("split") == "test")
    return round_doubles(metrics.calibration_curve(test, "y", "probability"))
