"""Registered queries: traffic split, policy replay, promotion gate, fairness, cohort fallback, ECE."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import daily
from rebound.operators import decide as D
from rebound.operators import metrics as M
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.q_features import TE_CTES, challenger
from rebound.plans.q_labels import POLICY_SQL_DOUBLES, policy_summary_sql
from rebound.plans.q_metrics import segment_ctes, split_modeling, split_sql
from rebound.plans.sqlmetrics import auc_sql, bundle_sql
from rebound.session import checkpoint_dir

T = C.OFFLINE_POLICY_THRESHOLD


def hash_bucket(col: str, buckets: int = 100) -> Column:
    """Portable deterministic bucket: first 8 hex digits of md5(id) mod n."""
    return F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def _hb_sql(col: str) -> str:
    return f"(('0x' || substr(md5(CAST({col} AS VARCHAR)), 1, 8))::BIGINT % 100)"


def test_with_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = split_modeling(spark, sf).where(F.col("split") == "test")
    return t.join(challenger(spark, sf), "transaction_id")


STRATEGIES = ["always_retry", "never_retry", "rules_policy", "challenger_policy", "random_policy"]


def replay(df: DataFrame) -> DataFrame:
    """Every row under five strategies, stacked as rows (explode)."""
    def dec(p: Column) -> Column:
        return D.basic_action(p, D.expected_value(p, F.col("amount_usd")), T)
    rule, ch = F.col("probability"), F.col("challenger_probability")
    options = F.array(
        F.struct(F.lit("always_retry").alias("policy"), F.lit(D.RETRY).alias("decision"), rule.alias("p")),
        F.struct(F.lit("never_retry").alias("policy"), F.lit(D.DO_NOT_RETRY).alias("decision"), rule.alias("p")),
        F.struct(F.lit("rules_policy").alias("policy"), dec(rule).alias("decision"), rule.alias("p")),
        F.struct(F.lit("challenger_policy").alias("policy"), dec(ch).alias("decision"), ch.alias("p")),
        F.struct(F.lit("random_policy").alias("policy"),
                 F.when(hash_bucket("transaction_id") < 50, F.lit(D.RETRY)).otherwise(F.lit(D.DO_NOT_RETRY))
                 .alias("decision"), rule.alias("p")))
    return (df.select("transaction_id", "merchant_vertical", "amount_usd", "target_recovered_by_retry",
                      F.explode(options).alias("s"))
            .select("*", F.col("s.policy").alias("policy"), F.col("s.decision").alias("decision"),
                    F.col("s.p").alias("probability")).drop("s"))


_EV = (lambda p: f"{p} * coalesce(amount_usd, {dbl(0.0)}) * {dbl(C.DEFAULT_MARGIN_RATE)} - "
       f"{dbl(C.DEFAULT_RETRY_COST_USD)} - {dbl(C.DEFAULT_FRICTION_COST_USD)}")


def _dec_sql(p: str) -> str:
    return f"CASE WHEN {p} >= {dbl(T)} AND {_EV(p)} > 0 THEN 'retry' ELSE 'do_not_retry' END"


EVAL_CTES = TE_CTES + [
    ("tws", "SELECT s.*, c.challenger_probability FROM scored s JOIN cc c USING (transaction_id)"),
    ("replay", f"""
SELECT transaction_id, merchant_vertical, amount_usd, target_recovered_by_retry, 'always_retry' AS policy,
       'retry' AS decision, probability FROM tws
UNION ALL SELECT transaction_id, merchant_vertical, amount_usd, target_recovered_by_retry, 'never_retry',
       'do_not_retry', probability FROM tws
UNION ALL SELECT transaction_id, merchant_vertical, amount_usd, target_recovered_by_retry, 'rules_policy',
       {_dec_sql('probability')}, probability FROM tws
UNION ALL SELECT transaction_id, merchant_vertical, amount_usd, target_recovered_by_retry, 'challenger_policy',
       {_dec_sql('challenger_probability')}, challenger_probability FROM tws
UNION ALL SELECT transaction_id, merchant_vertical, amount_usd, target_recovered_by_retry, 'random_policy',
       CASE WHEN {_hb_sql('transaction_id')} < 50 THEN 'retry' ELSE 'do_not_retry' END, probability FROM tws"""),
]


@register("traffic_split", split_sql(f"""
SELECT transaction_id, {_hb_sql('transaction_id')} AS hash_bucket,
       CASE WHEN {_hb_sql('transaction_id')} < 20 THEN 'challenger' ELSE 'champion' END AS arm
FROM scored"""), ops=("M11",))
def q_traffic_split(spark, sf):
    s = split_modeling(spark, sf)
    b = hash_bucket("transaction_id")
    return s.select("transaction_id", b.alias("hash_bucket"),
                    F.when(b < 20, F.lit("challenger")).otherwise(F.lit("champion")).alias("arm"))


@register("policy_replay", sql_round(POLICY_SQL_DOUBLES, split_sql(policy_summary_sql("replay"), EVAL_CTES)),
          ops=("M13", "G11", "U2"))
def q_policy_replay(spark, sf):
    return round_doubles(D.policy_summary(replay(test_with_scores(spark, sf))))


@register("best_policy_by_segment", sql_round(["realized_net_value_usd"], split_sql(f"""
SELECT merchant_vertical, policy AS best_policy, realized_net_value_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_vertical ORDER BY realized_net_value_usd DESC, policy) AS r
  FROM ({policy_summary_sql('replay', 'merchant_vertical, policy')}) AS p) AS z WHERE r = 1""", EVAL_CTES)),
          ops=("M13",))
def q_best_policy_by_segment(spark, sf):
    ps = D.policy_summary(replay(test_with_scores(spark, sf)), group_cols=["merchant_vertical", "policy"])
    # one row per (vertical, strategy): five rows per window partition
    w = Window.partitionBy("merchant_vertical").orderBy(F.col("realized_net_value_usd").desc(), "policy")
    best = ps.withColumn("r", F.row_number().over(w)).where("r = 1")
    return round_doubles(best.select("merchant_vertical", F.col("policy").alias("best_policy"),
                                     "realized_net_value_usd"))


def _ece_sql(score: str) -> str:
    qs = ", ".join(dbl(i / 10) for i in range(11))
    return f"""
SELECT sum(rows / n * abs(mean_pred - event_rate)) AS ece FROM (
  SELECT count(*) AS rows, sum(count(*)) OVER () AS n, avg(p) AS mean_pred, avg(y) AS event_rate FROM (
    SELECT CAST(greatest(len(list_filter(e, lambda x: x < p)) - 1, 0) AS INTEGER) AS bucket, p, y
    FROM (SELECT {score} AS p, y FROM tws WHERE {score} IS NOT NULL) AS s,
         (SELECT list_sort(list_distinct(quantile_cont({score}, [{qs}]))) AS e FROM tws) AS q
    WHERE p <= e[len(e)]) AS b
  GROUP BY bucket) AS c"""


@register("calibration_error", sql_round(["ece_rules", "ece_challenger"], split_sql(f"""
SELECT r.ece AS ece_rules, c.ece AS ece_challenger FROM ({_ece_sql('probability')}) AS r,
       ({_ece_sql('challenger_probability')}) AS c""", EVAL_CTES)), ops=("M8", "M7"))
def q_calibration_error(spark, sf):
    t = test_with_scores(spark, sf)
    r = M.expected_calibration_error(M.calibration_curve(t, "y", "probability")).withColumn("__k", F.lit(1))
    c = M.expected_calibration_error(M.calibration_curve(t, "y", "challenger_probability")).withColumn(
        "__k", F.lit(1))
    return round_doubles(r.withColumnRenamed("ece", "ece_rules").join(
        c.withColumnRenamed("ece", "ece_challenger"), "__k").drop("__k"))


@register("promotion_gate", sql_round(["champion_net_value_usd", "challenger_net_value_usd", "net_value_lift",
                                       "ece_challenger", "z_statistic"], split_sql(f"""
SELECT champ_nv AS champion_net_value_usd, ch_nv AS challenger_net_value_usd,
       (ch_nv - champ_nv) / abs(champ_nv) AS net_value_lift, ece AS ece_challenger, z AS z_statistic,
       coalesce((ch_nv - champ_nv) / abs(champ_nv) > 0.01 AND ece < 0.05 AND z > 1.96, false) AS promote
FROM (
  SELECT a.realized_net_value_usd AS champ_nv, b.realized_net_value_usd AS ch_nv, e.ece,
         (b.recovered_count / b.retry_count - a.recovered_count / a.retry_count)
         / sqrt(((a.recovered_count + b.recovered_count) / (a.retry_count + b.retry_count))
                * (1 - (a.recovered_count + b.recovered_count) / (a.retry_count + b.retry_count))
                * (1.0 / a.retry_count + 1.0 / b.retry_count)) AS z
  FROM ({policy_summary_sql('replay')}) AS a, ({policy_summary_sql('replay')}) AS b, ({_ece_sql('challenger_probability')}) AS e
  WHERE a.policy = 'rules_policy' AND b.policy = 'challenger_policy') AS g""", EVAL_CTES)), ops=("M12", "M8"))
def q_promotion_gate(spark, sf):
    t = test_with_scores(spark, sf)
    ps = D.policy_summary(replay(t).where(F.col("policy").isin("rules_policy", "challenger_policy")))
    a = ps.where(F.col("policy") == "rules_policy").select(
        F.lit(1).alias("__k"), F.col("realized_net_value_usd").alias("champ_nv"),
        F.col("recovered_count").alias("r1"), F.col("retry_count").alias("n1"))
    b = ps.where(F.col("policy") == "challenger_policy").select(
        F.lit(1).alias("__k"), F.col("realized_net_value_usd").alias("ch_nv"),
        F.col("recovered_count").alias("r2"), F.col("retry_count").alias("n2"))
    e = M.expected_calibration_error(M.calibration_curve(t, "y", "challenger_probability")).withColumn(
        "__k", F.lit(1))
    j = a.join(b, "__k").join(e, "__k")
    pp = F.try_divide(F.col("r1") + F.col("r2"), F.col("n1") + F.col("n2"))
    z = F.try_divide(F.try_divide(F.col("r2"), F.col("n2")) - F.try_divide(F.col("r1"), F.col("n1")),
                     F.sqrt(pp * (F.lit(1) - pp) * (F.try_divide(F.lit(1.0), F.col("n1"))
                                                    + F.try_divide(F.lit(1.0), F.col("n2")))))
    lift = F.try_divide(F.col("ch_nv") - F.col("champ_nv"), F.abs(F.col("champ_nv")))
    return round_doubles(j.select(
        F.col("champ_nv").alias("champion_net_value_usd"), F.col("ch_nv").alias("challenger_net_value_usd"),
        lift.alias("net_value_lift"), F.col("ece").alias("ece_challenger"), z.alias("z_statistic"),
        F.coalesce((lift > 0.01) & (F.col("ece") < 0.05) & (z > 1.96), F.lit(False)).alias("promote")))


@register("fairness_table", sql_round(["auc", "overall_auc", "auc_gap", "positive_rate", "positive_rate_gap",
                                       "f1", "f1_gap"], split_sql(f"""
SELECT s.segment_column, s.segment_value, s.rows, s.auc, o.auc AS overall_auc, s.auc - o.auc AS auc_gap,
       s.positive_rate, s.positive_rate - o.positives / o.rows AS positive_rate_gap, s.f1, s.f1 - o.f1 AS f1_gap
FROM (SELECT segment_column, segment_value, rows, positives / rows AS positive_rate, auc, f1
      FROM ({bundle_sql('seg_rows', 'segment_column, segment_value', dbl(T))}) AS m) AS s,
     ({bundle_sql("(SELECT * FROM scored WHERE split = 'test')", '', dbl(T))}) AS o""",
    segment_ctes())), ops=("M14", "G5"))
def q_fairness_table(spark, sf):
    test = split_modeling(spark, sf).where(F.col("split") == "test")
    seg = M.segment_metrics(test, "y", "probability", T).withColumn("__k", F.lit(1))
    o = M.metric_bundle(test, "y", "probability", T).select(
        F.lit(1).alias("__k"), F.col("auc").alias("overall_auc"),
        (F.col("positives") / F.col("rows")).alias("__opr"), F.col("f1").alias("__of1"))
    j = seg.join(o, "__k")
    return round_doubles(j.select(
        "segment_column", "segment_value", "rows", "auc", "overall_auc",
        (F.col("auc") - F.col("overall_auc")).alias("auc_gap"), "positive_rate",
        (F.col("positive_rate") - F.col("__opr")).alias("positive_rate_gap"), "f1",
        (F.col("f1") - F.col("__of1")).alias("f1_gap")))


CV_CTE = ("cv", f"""
SELECT s.transaction_id,
       (coalesce(ev.encoding, (SELECT g FROM gm)) + coalesce(ec.encoding, (SELECT g FROM gm))) / {dbl(2.0)}
         AS challenger_probability
FROM scored s
LEFT JOIN enc ev ON ev.feature = 'merchant_vertical'
                AND ev.value = coalesce(NULLIF(CAST(s.merchant_vertical AS VARCHAR), ''), 'MISSING')
LEFT JOIN enc ec ON ec.feature = 'merchant_country'
                AND ec.value = coalesce(NULLIF(CAST(s.merchant_country AS VARCHAR), ''), 'MISSING')
WHERE s.split = 'validation'""")
_VAL_CH = "(SELECT v.*, c2.challenger_probability FROM scored v JOIN cv c2 USING (transaction_id)) AS vch"
_VAL = "(SELECT * FROM scored WHERE split = 'validation') AS vr"


@register("cohort_fallback", sql_round(["policy_score"], split_sql(f"""
SELECT t.transaction_id, coalesce(m.auc < r.auc, false) AS used_rules,
       CASE WHEN coalesce(m.auc < r.auc, false) THEN t.probability ELSE t.challenger_probability END AS policy_score
FROM tws t
LEFT JOIN ({auc_sql(_VAL_CH, 'merchant_vertical', 'y', 'challenger_probability')}) AS m
  ON m.merchant_vertical = t.merchant_vertical
LEFT JOIN ({auc_sql(_VAL, 'merchant_vertical', 'y', 'probability')}) AS r
  ON r.merchant_vertical = t.merchant_vertical""", EVAL_CTES + [CV_CTE])), ops=("D16",))
def q_cohort_fallback(spark, sf):
    from rebound.operators import features as FE
    from rebound.plans.q_features import TE_COLS
    sm = split_modeling(spark, sf)
    enc, g = FE.fit_target_encoding(sm.where(F.col("split") == "train"), TE_COLS, "y")
    scored = FE.apply_target_encoding(sm.where(F.col("split").isin("validation", "test")), enc, TE_COLS, g) \
        .withColumn("challenger_probability", (F.col("merchant_vertical__target_encoded")
                                               + F.col("merchant_country__target_encoded")) / F.lit(2.0))
    val = scored.where(F.col("split") == "validation")
    m_auc = M.auc(val, "y", "challenger_probability", ["merchant_vertical"]).withColumnRenamed(
        "merchant_vertical", "segment_value")
    r_auc = M.auc(val, "y", "probability", ["merchant_vertical"]).withColumnRenamed(
        "merchant_vertical", "segment_value")
    test = scored.where(F.col("split") == "test")
    out = D.cohort_fallback(test, "merchant_vertical", m_auc, r_auc, "challenger_probability", "probability")
    return round_doubles(out.select("transaction_id", "used_rules", "policy_score"))


def _delta_sql() -> str:
    both = "(SELECT y, probability AS p, 'before' AS which FROM tws UNION ALL SELECT y, challenger_probability AS p, 'after' AS which FROM tws) AS both_scores"
    return f"""
SELECT metric, max(CASE WHEN which = 'before' THEN v END) AS before, max(CASE WHEN which = 'after' THEN v END) AS after,
       max(CASE WHEN which = 'after' THEN v END) - max(CASE WHEN which = 'before' THEN v END) AS delta
FROM (UNPIVOT (SELECT which, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in M.DELTA_METRICS)} FROM ({bundle_sql(both, "which", dbl(T), "y", "p")}) AS b)
      ON {", ".join(M.DELTA_METRICS)} INTO NAME metric VALUE v) AS u
GROUP BY metric"""


@register("metric_deltas", sql_round(["before", "after", "delta"], split_sql(_delta_sql(), EVAL_CTES)), ops=("M9",))
def q_metric_deltas(spark, sf):
    """Metrics of the rules score before and the challenger score after, on the test window."""
    return round_doubles(M.metric_deltas(test_with_scores(spark, sf), "y", "probability", "challenger_probability", T))


BASE_DAYS = 120
AMOUNT_EDGES = [0.0, 250.0, 500.0, 1000.0, 1500.0, 2000.0, 2500.0, 3000.0, 4000.0, 6000.0]
_R = 10.0 ** daily.SCORE_DIGITS
_AMOUNT_BUCKET = "CASE WHEN amount_usd >= 0 AND amount_usd <= 6000 THEN least(%s, %d) END" % (
    " + ".join(f"(amount_usd >= {e})::INT" for e in AMOUNT_EDGES[1:]), len(AMOUNT_EDGES) - 2)
_NIGHT_CTES = EVAL_CTES + [
    ("nightly", f"""
SELECT 'champion' AS model, floor(probability * {_R} + 0.5) / {_R} AS p, y FROM tws
UNION ALL SELECT 'challenger', floor(challenger_probability * {_R} + 0.5) / {_R}, y FROM tws"""),
    ("separation", """
SELECT model, max(abs(cp / np - cn / nn)) AS ks FROM (
  SELECT model, sum(sum(y)) OVER (PARTITION BY model ORDER BY p) AS cp, sum(sum(1 - y)) OVER (PARTITION BY model ORDER BY p) AS cn,
         sum(sum(y)) OVER (PARTITION BY model) AS np, sum(sum(1 - y)) OVER (PARTITION BY model) AS nn
  FROM nightly WHERE p IS NOT NULL GROUP BY model, p) AS c GROUP BY model"""),
    ("amount_bins", f"""
SELECT b.bucket, count(t.amount_usd) FILTER (WHERE t.base) AS e, count(t.amount_usd) FILTER (WHERE NOT t.base) AS a
FROM (SELECT CAST(i AS INTEGER) AS bucket FROM range({len(AMOUNT_EDGES) - 1}) AS r(i)) AS b
LEFT JOIN (SELECT amount_usd, {_AMOUNT_BUCKET} AS bucket,
                  CAST(ts AS DATE) < (SELECT CAST(min(ts) AS DATE) FROM tws) + {BASE_DAYS} AS base FROM tws) AS t USING (bucket)
GROUP BY b.bucket"""),
    ("amount_psi", """
SELECT sum((ap - ep) * ln(ap / ep)) AS psi FROM (
  SELECT greatest(e / sum(e) OVER (), 1e-6) AS ep, greatest(a / sum(a) OVER (), 1e-6) AS ap FROM amount_bins) AS s"""),
]


@register("nightly_reconciliation", sql_round(["log_loss", "brier", "auc", "ks", "amount_psi", "mean_delta", "mean_abs_delta", "share_over_limit"],
                                              split_sql(f"""
SELECT m.model, m.rows, m.unscored_rows, m.positives, m.log_loss, m.brier, m.auc, s.ks, z.psi AS amount_psi,
       d.compared_rows, d.mean_delta, d.mean_abs_delta, d.share_over_limit
FROM ({bundle_sql('nightly', 'model', dbl(T), 'y', 'p')}) AS m JOIN separation s USING (model), amount_psi AS z,
     (SELECT count(*) AS compared_rows, avg(challenger_probability - probability) AS mean_delta, avg(abs(challenger_probability - probability)) AS mean_abs_delta,
             avg((abs(challenger_probability - probability) > {C.DISAGREEMENT_DELTA})::INT) AS share_over_limit
      FROM tws WHERE probability IS NOT NULL AND challenger_probability IS NOT NULL) AS d""", _NIGHT_CTES)),
          ops=("M10", "D14", "M1", "M2", "M3", "F1"))
def q_nightly_reconciliation(spark, sf):
    """Every day of the test window is reduced to state and written; the report reads the merged state alone."""
    rows = test_with_scores(spark, sf)
    day, folder = F.to_date("timestamp"), f"{checkpoint_dir(spark)}/nightly-{uuid.uuid4().hex}"
    days = sorted(r[0] for r in rows.select(day).where(day.isNotNull()).distinct().collect())  # the nights to run: one value a day
    bins = {"amount_usd": (F.col("amount_usd"), AMOUNT_EDGES)}
    models = {"champion": F.col("probability"), "challenger": F.col("challenger_probability")}
    for name, state in (("scores", daily.day_scores(rows, day, F.col("y"), models)), ("bins", daily.day_bins(rows, day, bins)),
                        ("deltas", daily.day_deltas(rows, day, *models.values(), C.DISAGREEMENT_DELTA))):
        daily.write_days(state, f"{folder}/{name}", days)
    read = lambda name: daily.read_days(spark, f"{folder}/{name}")
    first = days[0] if days else None
    psi = daily.merged_psi(read("bins"), F.col("day") < F.date_add(F.lit(first), BASE_DAYS), {"amount_usd": len(AMOUNT_EDGES) - 1})
    one = F.lit(1).alias("__k")
    out = (daily.merged_quality(read("scores")).withColumn("__k", F.lit(1))
           .join(psi.select(one, F.col("psi").alias("amount_psi")), "__k").join(daily.merged_deltas(read("deltas")).select(one, "*"), "__k"))
    return round_doubles(out.select("model", "rows", "unscored_rows", "positives", "log_loss", "brier", "auc", "ks", "amount_psi",
                                    "compared_rows", "mean_delta", "mean_abs_delta", "share_over_limit"))
