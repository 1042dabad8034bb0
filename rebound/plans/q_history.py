"""Registered queries: point-in-time history features, rate reports, dedup twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import history as H
from rebound.plans import fixture as fx
from rebound.plans.catalog import register, round_doubles, sql_round
from rebound.plans.sqlbase import with_ctes


@register("sequence_features", sql_round(["minutes_since_last", "hours_since_first"], with_ctes("""
SELECT transaction_id,
       row_number() OVER w AS attempt_number,
       (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS minutes_since_last,
       (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 3600000000.0 AS hours_since_first,
       coalesce(lag(response_code) OVER w <> response_code, false) AS decline_code_changed
FROM declines
WINDOW w AS (PARTITION BY merchant_id ORDER BY ts, transaction_id)""", upto="declines")),
          ops=("W5", "P18"))
def q_sequence_features(spark, sf):
    s = H.sequence_features(fx.declines(spark, sf), "merchant_id", "timestamp", "transaction_id", "response_code")
    return round_doubles(s.select("transaction_id", "attempt_number", "minutes_since_last",
                                  "hours_since_first", "decline_code_changed"))


@register("historical_rates", sql_round(["prior_decline_rate", "prior_mean_amount", "amount_deviation"], with_ctes("""
SELECT transaction_id, prior_attempts,
       CASE WHEN prior_attempts > 0 THEN prior_declines / prior_attempts END AS prior_decline_rate,
       CASE WHEN prior_amount_n > 0 THEN prior_amount_sum / prior_amount_n END AS prior_mean_amount,
       amount_usd - CASE WHEN prior_amount_n > 0 THEN prior_amount_sum / prior_amount_n END AS amount_deviation
FROM (SELECT transaction_id, amount_usd,
             count(*) OVER w AS prior_attempts,
             coalesce(sum(CASE WHEN auth_status = 'DECLINED' THEN 1 ELSE 0 END) OVER w, 0) AS prior_declines,
             CAST(coalesce(sum(CAST(amount_usd AS DECIMAL(18,4))) OVER w, 0) AS DOUBLE) AS prior_amount_sum,
             count(amount_usd) OVER w AS prior_amount_n
      FROM originals
      WINDOW w AS (PARTITION BY merchant_id ORDER BY ts
                   RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) AS h""",
    upto="originals")), ops=("W6", "W7", "P18"))
def q_historical_rates(spark, sf):
    r = H.historical_rates(fx.originals(spark, sf), "merchant_id")
    return round_doubles(r.select("transaction_id", "prior_attempts", "prior_decline_rate",
                                  "prior_mean_amount", "amount_deviation"))


@register("trailing_decline_rates", sql_round(["prior_30d_decline_rate", "prior_7d_decline_rate", "trend_7d_vs_30d"],
                                              with_ctes("""
SELECT transaction_id, n30 AS prior_30d_attempts,
       CASE WHEN n30 > 0 THEN k30 / n30 END AS prior_30d_decline_rate,
       CASE WHEN n7 > 0 THEN k7 / n7 END AS prior_7d_decline_rate,
       CASE WHEN n7 > 0 THEN k7 / n7 END - CASE WHEN n30 > 0 THEN k30 / n30 END AS trend_7d_vs_30d
FROM (SELECT transaction_id,
             count(*) OVER w30 AS n30, coalesce(sum(CASE WHEN auth_status = 'DECLINED' THEN 1 ELSE 0 END) OVER w30, 0) AS k30,
             count(*) OVER w7 AS n7, coalesce(sum(CASE WHEN auth_status = 'DECLINED' THEN 1 ELSE 0 END) OVER w7, 0) AS k7
      FROM originals
      WINDOW w30 AS (PARTITION BY merchant_country ORDER BY ts
                     RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
             w7 AS (PARTITION BY merchant_country ORDER BY ts
                    RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) AS t""",
                                                        upto="originals")), ops=("W6b",))
def q_trailing_decline_rates(spark, sf):
    o = fx.originals(spark, sf)
    dec = F.col("auth_status") == "DECLINED"
    j = H.trailing_rate(o, "merchant_country", "timestamp", [30, 7], dec)
    return round_doubles(j.select("transaction_id", "prior_30d_attempts", "prior_30d_decline_rate",
                                  "prior_7d_decline_rate",
                                  (F.col("prior_7d_decline_rate") - F.col("prior_30d_decline_rate"))
                                  .alias("trend_7d_vs_30d")))


def _rate_sql(key: str, key_type: str, limit: int) -> str:
    return f"""
SELECT '{key_type}' AS key_type, CAST({key} AS VARCHAR) AS key, count(*) AS requests,
       CAST(max(c) AS BIGINT) AS max_in_window, count(*) FILTER (WHERE c > {limit}) AS breaches
FROM (SELECT {key}, count(*) OVER (PARTITION BY {key} ORDER BY ts
                                  RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS c
      FROM events) AS e GROUP BY {key}"""


@register("rate_breaches", _rate_sql("user_id", "key", C.RATE_LIMIT_PER_KEY) + " UNION ALL "
          + _rate_sql("event_type", "address", C.RATE_LIMIT_PER_ADDRESS), ops=("W10", "T13"))
def q_rate_breaches(spark, sf):
    ev = fx.events(spark, sf, ["event_id", "ts", "user_id", "event_type"])
    by_key = H.rate_breaches(ev, "user_id", "ts", C.RATE_LIMIT_PER_KEY).select(
        F.lit("key").alias("key_type"), F.col("user_id").cast("string").alias("key"), "requests",
        "max_in_window", "breaches")
    by_addr = H.rate_breaches(ev, "event_type", "ts", C.RATE_LIMIT_PER_ADDRESS).select(
        F.lit("address").alias("key_type"), F.col("event_type").alias("key"), "requests",
        "max_in_window", "breaches")
    return by_key.unionByName(by_addr)


@register("event_dedup", """
WITH RECURSIVE k(user_id, event_type, ts) AS (
  SELECT user_id, event_type, min(ts) FROM events GROUP BY user_id, event_type
  UNION ALL
  SELECT e.user_id, e.event_type, min(e.ts)
  FROM k JOIN events e ON e.user_id IS NOT DISTINCT FROM k.user_id AND e.event_type IS NOT DISTINCT FROM k.event_type
                      AND e.ts >= k.ts + INTERVAL 24 HOURS
  GROUP BY e.user_id, e.event_type)
SELECT min(e.event_id) AS event_id, e.user_id, e.event_type, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts
FROM events e JOIN k ON e.user_id IS NOT DISTINCT FROM k.user_id AND e.event_type IS NOT DISTINCT FROM k.event_type AND e.ts = k.ts
GROUP BY e.user_id, e.event_type, e.ts""", ops=("S2", "T26"))
def q_event_dedup(spark, sf):
    ev = fx.events(spark, sf, ["event_id", "ts", "user_id", "event_type"])
    d = H.dedup_within(ev, ["user_id", "event_type"], "ts", "event_id")
    return d.select("event_id", "user_id", "event_type",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"))


@register("event_error_rates", sql_round(["prior_30d_decline_rate", "prior_7d_decline_rate"], """
SELECT event_id, n30 AS prior_30d_attempts, CASE WHEN n30 > 0 THEN k30 / n30 END AS prior_30d_decline_rate,
       n7 AS prior_7d_attempts, CASE WHEN n7 > 0 THEN k7 / n7 END AS prior_7d_decline_rate
FROM (SELECT event_id, count(*) OVER w30 AS n30, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w30, 0) AS k30,
             count(*) OVER w7 AS n7, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w7, 0) AS k7
      FROM events
      WINDOW w30 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
             w7 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) AS t"""),
          ops=("W6b",))
def q_event_error_rates(spark, sf):
    """W6b over real times of day: a user's error rate in the 30 and 7 days before each event."""
    ev = fx.events(spark, sf, ["event_id", "ts", "user_id", "event_type"])
    r = H.trailing_rate(ev, "user_id", "ts", [30, 7], F.col("event_type") == "error")
    return round_doubles(r.select("event_id", "prior_30d_attempts", "prior_30d_decline_rate",
                                  "prior_7d_attempts", "prior_7d_decline_rate"))


_FS_KEYS = {"provider": "processor_name", "country": "merchant_country", "code": "response_code",
            "code_country": "response_code, merchant_country", "merchant": "merchant_id"}
_FS_DOUBLES = ["provider_approval_rate", "provider_decline_rate", "provider_retry_success_rate", "country_approval_rate",
               "country_retry_success_rate", "amount_usd", "amount_deviation", "code_retry_rate", "code_country_retry_rate", "minutes_since_last",
               "merchant_approval_rate", "merchant_retry_success_rate", "merchant_mean_amount", "hours_since_first"]


def _fs_sums(name: str) -> str:
    w = f"w_{name}"
    return f"""
  sum(CASE WHEN kind <> 'retry' THEN 1 END) OVER {w} AS {name}_n, sum(CASE WHEN kind <> 'retry' THEN CASE WHEN auth_status = 'APPROVED' THEN 1 ELSE 0 END END) OVER {w} AS {name}_ok,
  sum(CASE WHEN kind = 'retry' THEN 1 END) OVER {w} AS {name}_r, sum(CASE WHEN kind = 'retry' THEN CASE WHEN auth_status = 'APPROVED' THEN 1 ELSE 0 END END) OVER {w} AS {name}_rok"""


def _fs_rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


@register("historical_feature_set", sql_round(_FS_DOUBLES, with_ctes(f"""
SELECT transaction_id, processor_name, {_fs_rate('provider_ok', 'provider_n')} AS provider_approval_rate,
  1.0 - {_fs_rate('provider_ok', 'provider_n')} AS provider_decline_rate, {_fs_rate('provider_rok', 'provider_r')} AS provider_retry_success_rate,
  merchant_country, {_fs_rate('country_ok', 'country_n')} AS country_approval_rate, {_fs_rate('country_rok', 'country_r')} AS country_retry_success_rate,
  amount_usd, CASE WHEN amount_usd < 50 THEN 'small' WHEN amount_usd < 200 THEN 'medium' WHEN amount_usd < 1000 THEN 'large' WHEN amount_usd IS NOT NULL THEN 'very_large' END AS amount_bucket,
  amount_usd - CASE WHEN cnt > 0 THEN amt / cnt END AS amount_deviation,
  response_code, CASE WHEN coalesce(is_soft_decline, false) THEN 'soft' ELSE 'hard' END AS decline_category, coalesce(is_soft_decline, false) AS is_soft_decline,
  {_fs_rate('code_rok', 'code_r')} AS code_retry_rate, {_fs_rate('code_country_rok', 'code_country_r')} AS code_country_retry_rate,
  CAST(hour(ts) AS INTEGER) AS event_hour, CAST(isodow(ts) - 1 AS INTEGER) AS event_dayofweek,
  hour(ts) BETWEEN 9 AND 16 AND isodow(ts) <= 5 AS is_business_hours, minutes_since_last,
  merchant_vertical, {_fs_rate('merchant_ok', 'merchant_n')} AS merchant_approval_rate, {_fs_rate('merchant_rok', 'merchant_r')} AS merchant_retry_success_rate,
  CASE WHEN cnt > 0 THEN amt / cnt END AS merchant_mean_amount, attempt_number, hours_since_first, decline_code_changed
FROM (SELECT *, {", ".join(_fs_sums(n) for n in _FS_KEYS)},
             CAST(coalesce(sum(CASE WHEN kind <> 'retry' THEN CAST(amount_usd AS DECIMAL(18,4)) END) OVER w_merchant, 0) AS DOUBLE) AS amt,
             coalesce(sum(CASE WHEN kind <> 'retry' AND amount_usd IS NOT NULL THEN 1 END) OVER w_merchant, 0) AS cnt
      FROM fsev
      WINDOW {", ".join(f"w_{n} AS (PARTITION BY {k} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)" for n, k in _FS_KEYS.items())}) AS f
WHERE kind = 'decline'""", upto="retries", extra=[("fsseq", """
SELECT transaction_id, row_number() OVER w AS attempt_number,
       (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS minutes_since_last,
       (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 3600000000.0 AS hours_since_first,
       coalesce(lag(response_code) OVER w <> response_code, false) AS decline_code_changed
FROM declines WINDOW w AS (PARTITION BY merchant_id ORDER BY ts, transaction_id)"""), ("fsev", """
SELECT o.transaction_id, o.ts, o.merchant_id, o.merchant_vertical, o.merchant_country, o.processor_name, o.response_code, o.is_soft_decline,
       o.amount_usd, o.auth_status, CASE WHEN o.auth_status = 'DECLINED' THEN 'decline' ELSE 'other' END AS kind,
       s.attempt_number, s.minutes_since_last, s.hours_since_first, s.decline_code_changed
FROM originals o LEFT JOIN fsseq s USING (transaction_id)
UNION ALL
SELECT NULL, r.ts, d.merchant_id, NULL, d.merchant_country, d.processor_name, d.response_code, NULL, NULL, r.auth_status, 'retry', NULL, NULL, NULL, NULL
FROM retries r JOIN declines d ON r.original_transaction_id = d.transaction_id""")])), ops=("P18", "W5", "W6", "W7"))
def q_historical_feature_set(spark, sf):
    return round_doubles(H.feature_set(fx.originals(spark, sf), fx.retries(spark, sf)))


_RS_KEYS = {"merchant": ["merchant_id"], "provider": ["processor_name"], "code_country": ["response_code", "merchant_country"]}
_RS_DAYS = (30, 7)


def _rs_window(columns: str, days: int) -> str:
    return f"(PARTITION BY {columns} ORDER BY ts RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@register("retry_success_history", sql_round([f"{k}_{n}d_retry_success_rate" for k in _RS_KEYS for n in _RS_DAYS], with_ctes(f"""
SELECT transaction_id, {", ".join(f"{k}_{n}d_retries, CASE WHEN {k}_{n}d_retries > 0 THEN {k}_{n}d_ok / {k}_{n}d_retries END AS {k}_{n}d_retry_success_rate" for k in _RS_KEYS for n in _RS_DAYS)}
FROM (SELECT *, {", ".join(f"count(ok) OVER w_{k}_{n} AS {k}_{n}d_retries, coalesce(sum(ok) OVER w_{k}_{n}, 0) AS {k}_{n}d_ok" for k in _RS_KEYS for n in _RS_DAYS)}
      FROM rsev
      WINDOW {", ".join(f"w_{k}_{n} AS {_rs_window(', '.join(c), n)}" for k, c in _RS_KEYS.items() for n in _RS_DAYS)}) AS h
WHERE ok IS NULL""", upto="retries", extra=[("rsev", """
SELECT d.transaction_id, d.ts, d.merchant_id, d.merchant_country, d.processor_name, d.response_code, CAST(NULL AS INTEGER) AS ok FROM declines d
UNION ALL
SELECT NULL, r.ts, d.merchant_id, d.merchant_country, d.processor_name, d.response_code, CASE WHEN r.auth_status = 'APPROVED' THEN 1 ELSE 0 END
FROM retries r JOIN declines d ON r.original_transaction_id = d.transaction_id""")])), ops=("W6b", "P18"))
def q_retry_success_history(spark, sf):
    h = H.retry_success_history(fx.originals(spark, sf), fx.retries(spark, sf), _RS_KEYS, _RS_DAYS)
    return round_doubles(h.select("transaction_id", *[f"{k}_{n}d_{c}" for k in _RS_KEYS for n in _RS_DAYS for c in ("retries", "retry_success_rate")]))
