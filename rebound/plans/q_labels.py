"""Registered queries: retry-chain labels and the rules policy (step 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import chains, decide
from rebound.plans import fixture as fx
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.memo import memo
from rebound.session import materialize
from rebound.plans.sqlbase import ev_sql, rule_probability_sql, ts_text, with_ctes


def build_modeling(spark: SparkSession, sf: str) -> DataFrame:
    """A2 for the fixture: declines labelled from their retry chains."""
    return chains.label_declines(fx.declines(spark, sf), fx.retry_summary(spark, sf))


def modeling(spark: SparkSession, sf: str) -> DataFrame:
    """The modeling table, materialised once per session (reliable checkpoint)."""
    return memo(spark, ("modeling", sf), lambda: materialize(build_modeling(spark, sf)))


def with_rules(df: DataFrame) -> DataFrame:
    return df.withColumn("rule_probability", decide.rule_probability())


MODELING_OUT = ["transaction_id", "event_ts", "merchant_id", "merchant_vertical", "merchant_country",
                "processor_name", "amount_usd", "response_code", "is_soft_decline", *chains.LABEL_COLUMNS]


@register("modeling_table", sql_round(["amount_usd", "hours_to_first_retry", "hours_to_recovery"], with_ctes(f"""
SELECT transaction_id, {ts_text('ts')} AS event_ts, merchant_id, merchant_vertical, merchant_country,
       processor_name, amount_usd, response_code, is_soft_decline, has_any_retry, retry_count,
       max_retry_attempt_num, target_recovered_by_retry, target_first_retry_approved,
       first_retry_status, first_retry_attempt_num, hours_to_first_retry, recovery_attempt_num,
       hours_to_recovery
FROM modeling""")), ops=("J1", "J2", "J3", "G1", "G2", "G2b", "G3", "P17", "W2", "A2"))
def q_modeling_table(spark, sf):
    m = modeling(spark, sf).withColumn("event_ts", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return round_doubles(m.select(*MODELING_OUT))


def rules_policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = with_rules(modeling(spark, sf))
    scored = decide.score_policy(m, "rule_probability", "rules_policy", C.OFFLINE_POLICY_THRESHOLD)
    return decide.policy_summary(scored)


POLICY_SQL_DOUBLES = ["retry_rate", "recovered_rate", "recovered_volume_usd", "gross_margin_recovered_usd",
                      "wasted_retry_cost_usd", "friction_cost_usd", "realized_net_value_usd",
                      "average_retry_probability"]


def policy_summary_sql(scored_cte: str, group: str = "policy") -> str:
    """G11 in SQL over a CTE with (policy, probability, decision, target, amount)."""
    amt = "coalesce(amount_usd, CAST(0.0 AS DOUBLE))"
    y = "coalesce(target_recovered_by_retry, false)"
    return f"""
SELECT {group}, rows, retry_count, retry_count / rows AS retry_rate, recovered_count,
       recovered_count / rows AS recovered_rate, recovered_volume_usd, gross_margin_recovered_usd,
       wasted_retry_count, wasted_retry_count * CAST(0.12 AS DOUBLE) AS wasted_retry_cost_usd,
       retry_count * CAST(0.03 AS DOUBLE) AS friction_cost_usd,
       gross_margin_recovered_usd - wasted_retry_count * CAST(0.12 AS DOUBLE)
         - retry_count * CAST(0.03 AS DOUBLE) AS realized_net_value_usd,
       coalesce(avg_p, CAST(0.0 AS DOUBLE)) AS average_retry_probability
FROM (
  SELECT {group}, count(*) AS rows,
         count(*) FILTER (WHERE decision = 'retry') AS retry_count,
         count(*) FILTER (WHERE decision = 'retry' AND {y}) AS recovered_count,
         count(*) FILTER (WHERE decision = 'retry' AND NOT {y}) AS wasted_retry_count,
         sum(CASE WHEN decision = 'retry' AND {y} THEN {amt} ELSE CAST(0.0 AS DOUBLE) END) AS recovered_volume_usd,
         sum(CASE WHEN decision = 'retry' AND {y} THEN {amt} * CAST(0.35 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)
           AS gross_margin_recovered_usd,
         avg(CASE WHEN decision = 'retry' THEN probability END) AS avg_p
  FROM {scored_cte} GROUP BY {group}) AS g"""


RULES_SCORED = [("rules_scored", f"""
SELECT m.*, 'rules_policy' AS policy, p.probability,
       CASE WHEN p.probability >= CAST(0.05 AS DOUBLE) AND {ev_sql('p.probability', 'm.amount_usd')} > 0
            THEN 'retry' ELSE 'do_not_retry' END AS decision
FROM modeling m, LATERAL (SELECT {rule_probability_sql('m.is_soft_decline', 'm.amount_usd', 'm.response_code')}
                          AS probability) AS p""")]


@register("rules_policy_summary",
          sql_round(POLICY_SQL_DOUBLES, with_ctes(policy_summary_sql("rules_scored"), extra=RULES_SCORED)),
          ops=("D1", "D3", "D4", "G11", "U2"))
def q_rules_policy_summary(spark, sf):
    return round_doubles(rules_policy_summary(spark, sf))


@register("declines_with_retry", with_ctes("""
SELECT d.transaction_id, d.response_code FROM declines d
WHERE EXISTS (SELECT 1 FROM retries r WHERE r.original_transaction_id = d.transaction_id)""", upto="retries"),
          ops=("J3",))
def q_declines_with_retry(spark, sf):
    return chains.semi_flags(fx.declines(spark, sf), fx.retries(spark, sf),
                             how="left_semi").select("transaction_id", "response_code")


@register("declines_without_retry", with_ctes("""
SELECT d.transaction_id, d.response_code FROM declines d
WHERE NOT EXISTS (SELECT 1 FROM retries r WHERE r.original_transaction_id = d.transaction_id)""", upto="retries"),
          ops=("J3",))
def q_declines_without_retry(spark, sf):
    return chains.semi_flags(fx.declines(spark, sf), fx.retries(spark, sf),
                             how="left_anti").select("transaction_id", "response_code")


def _code_dim_sql() -> str:
    rows = [f"('{c}', 'hard', '{C.HARD_DECLINE_REASONS[c]}')" for c in C.HARD_DECLINE_CODES]
    rows += [f"('{c}', 'soft', NULL)" for c in C.SOFT_DECLINE_CODES]
    return "(VALUES " + ", ".join(rows) + ") AS dim(code, code_category, code_reason)"


@register("decline_enrichment", with_ctes(f"""
SELECT d.transaction_id, d.response_code, coalesce(dim.code_category, 'unknown') AS code_category, dim.code_reason
FROM declines d LEFT JOIN {_code_dim_sql()} ON trim(d.response_code) = dim.code""", upto="declines"),
          ops=("J7",))
def q_decline_enrichment(spark, sf):
    e = chains.enrich_codes(fx.declines(spark, sf))
    return e.select("transaction_id", "response_code", "code_category", "code_reason")


@register("value_labels", sql_round(["retry_value_usd"], with_ctes(f"""
SELECT transaction_id, retry_count, target_recovered_by_retry, v AS retry_value_usd, v > 0 AS target_retry_had_value
FROM (SELECT *, CASE WHEN target_recovered_by_retry THEN coalesce(amount_usd, CAST(0.0 AS DOUBLE)) * {dbl(C.DEFAULT_MARGIN_RATE)} ELSE CAST(0.0 AS DOUBLE) END
             - retry_count * {dbl(C.DEFAULT_RETRY_COST_USD + C.DEFAULT_FRICTION_COST_USD)} AS v FROM modeling) AS m""")), ops=("G2b",))
def q_value_labels(spark, sf):
    v = chains.value_label(modeling(spark, sf), C.DEFAULT_MARGIN_RATE, C.DEFAULT_RETRY_COST_USD, C.DEFAULT_FRICTION_COST_USD)
    return round_doubles(v.select("transaction_id", "retry_count", "target_recovered_by_retry", "retry_value_usd", "target_retry_had_value"))
