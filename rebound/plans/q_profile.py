"""Registered queries: label profile, merchant-week mart, column profiles, data tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from rebound import config as C
from rebound.functions.parse import strip_ws, time_features
from rebound.operators import chains, profile
from rebound.operators import sketches as SK
from rebound.plans import fixture as fx
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.q_labels import modeling
from rebound.plans.sqlbase import with_ctes

DIMS = ["is_soft_decline", "response_code", "merchant_country", "processor_name"]


def _cat(c: str) -> str:
    return f"coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING')"


@register("label_rates", sql_round(["recovered_rate", "first_retry_recovered_rate", "retried_rate"], with_ctes("""
SELECT count(*) AS rows, count(*) FILTER (WHERE target_recovered_by_retry) AS recovered,
       count(*) FILTER (WHERE target_first_retry_approved) AS first_retry_recovered,
       count(*) FILTER (WHERE has_any_retry) AS retried,
       count(*) FILTER (WHERE target_recovered_by_retry) / count(*) AS recovered_rate,
       count(*) FILTER (WHERE target_first_retry_approved) / count(*) AS first_retry_recovered_rate,
       count(*) FILTER (WHERE has_any_retry) / count(*) AS retried_rate
FROM modeling""")), ops=("G4", "G2b"))
def q_label_rates(spark, sf):
    return round_doubles(profile.label_rates(modeling(spark, sf)))


def _dims_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {_cat('lower(CAST(' + d + ' AS VARCHAR))' if d == 'is_soft_decline' else d)}"
        f" AS value, CAST(target_recovered_by_retry AS INTEGER) AS y,"
        f" CAST(has_any_retry AS INTEGER) AS rt FROM modeling" for d in DIMS)
    body = f"""
SELECT dimension, value, rows, recovered, recovered / rows AS recovery_rate, retried, retried / rows AS retried_rate
FROM (
  SELECT dimension, value, count(*) AS rows, CAST(sum(y) AS BIGINT) AS recovered, CAST(sum(rt) AS BIGINT) AS retried,
         row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS r
  FROM ({long}) AS l GROUP BY dimension, value) AS g WHERE r <= 10"""
    return sql_round(["recovery_rate", "retried_rate"], with_ctes(body))


@register("recovery_by_dimension", _dims_sql(), ops=("G4", "W9"))
def q_recovery_by_dimension(spark, sf):
    return round_doubles(profile.recovery_by_dimension(modeling(spark, sf), DIMS, 10))


@register("merchant_week_mart", sql_round(["approval_rate", "decline_rate"], with_ctes("""
SELECT t.merchant_id, strftime(t.wk, '%Y-%m-%d') AS week, t.attempts, t.approvals, t.declines,
       t.approvals / t.attempts AS approval_rate, t.declines / t.attempts AS decline_rate,
       coalesce(c.top_decline_codes, '') AS top_decline_codes
FROM (SELECT merchant_id, date_trunc('week', ts) AS wk, count(*) AS attempts,
             count(*) FILTER (WHERE auth_status = 'APPROVED') AS approvals,
             count(*) FILTER (WHERE auth_status <> 'APPROVED') AS declines
      FROM originals GROUP BY 1, 2) AS t
LEFT JOIN (SELECT merchant_id, wk, string_agg(response_code || ':' || CAST(n AS VARCHAR), '|' ORDER BY r)
                    AS top_decline_codes
           FROM (SELECT merchant_id, date_trunc('week', ts) AS wk, response_code, count(*) AS n,
                        row_number() OVER (PARTITION BY merchant_id, date_trunc('week', ts)
                                           ORDER BY count(*) DESC, response_code) AS r
                 FROM originals WHERE auth_status <> 'APPROVED' GROUP BY 1, 2, 3) AS x
           WHERE r <= 3 GROUP BY 1, 2) AS c
  ON c.merchant_id = t.merchant_id AND c.wk = t.wk""", upto="originals")), ops=("G13",))
def q_merchant_week_mart(spark, sf):
    return round_doubles(profile.merchant_week_mart(fx.originals(spark, sf)))


PROFILE_COLS = {"transaction_id": "numeric", "timestamp": "timestamp", "merchant_id": "numeric",
                "merchant_vertical": "string", "merchant_country": "string", "processor_name": "string",
                "amount_usd": "numeric", "response_code": "string", "is_soft_decline": "boolean"}


def _profile_sql() -> str:
    parts = []
    for c, fam in PROFILE_COLS.items():
        src = "ts" if c == "timestamp" else c
        num = f"CAST({src} AS DOUBLE)" if fam == "numeric" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, '{fam}' AS type_family, count(*) AS rows, "
                     f"count(*) FILTER (WHERE {src} IS NULL) AS nulls, "
                     f"count(DISTINCT CAST({src} AS VARCHAR)) AS distinct_values, "
                     f"min({num}) AS min_value, max({num}) AS max_value, "
                     f"quantile_cont({num}, 0.25) AS p25, quantile_cont({num}, 0.5) AS p50, "
                     f"quantile_cont({num}, 0.75) AS p75 FROM declines")
    return sql_round(["min_value", "max_value", "p25", "p50", "p75"],
                     with_ctes(" UNION ALL ".join(parts), upto="declines"))


@register("column_profile", _profile_sql(), ops=("G14",))
def q_column_profile(spark, sf):
    return round_doubles(profile.column_profile(fx.declines(spark, sf)))


EXCLUDED = ["transaction_id", "merchant_id", "timestamp"]


def _coverage_sql() -> str:
    cols = ["transaction_id", "timestamp", "merchant_id", "merchant_vertical", "merchant_country",
            "processor_name", "amount_usd", "response_code", "is_soft_decline", *chains.LABEL_COLUMNS]
    parts = []
    for c in cols:
        role = "derived" if c in chains.LABEL_COLUMNS else "excluded" if c in EXCLUDED else "candidate"
        src = "ts" if c == "timestamp" else c
        parts.append(f"SELECT '{c}' AS column_name, '{role}' AS role, count({src}) AS non_null, "
                     f"count(*) AS rows, count({src}) / count(*) AS fill_rate FROM modeling")
    return sql_round(["fill_rate"], with_ctes(" UNION ALL ".join(parts)))


@register("feature_coverage", _coverage_sql(), ops=("G15", "T3"))
def q_feature_coverage(spark, sf):
    return round_doubles(profile.feature_coverage(modeling(spark, sf), chains.LABEL_COLUMNS, EXCLUDED))


@register("feature_statistics", sql_round(["mean", "median", "corr_with_label"], with_ctes(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg(v) AS mean, count(DISTINCT v) AS distinct_values,
       corr(v, y) AS corr_with_label, quantile_cont(v, 0.5) AS median
FROM (SELECT CAST({e} AS DOUBLE) AS v, CAST(coalesce(CAST(target_recovered_by_retry AS INTEGER), 0) AS DOUBLE) AS y
      FROM modeling) AS s"""
    for c, e in [("amount_usd", "amount_usd"), ("event_dayofweek", "isodow(ts) - 1"),
                 ("event_month", "month(ts)")]))), ops=("G16",))
def q_feature_statistics(spark, sf):
    m = modeling(spark, sf).withColumns(time_features("timestamp"))
    return round_doubles(profile.feature_statistics(m, ["amount_usd", "event_dayofweek", "event_month"],
                                                    "target_recovered_by_retry"))


_CODES = ", ".join(f"'{c}'" for c in C.HARD_DECLINE_CODES + C.SOFT_DECLINE_CODES)


@register("table_tests", with_ctes(f"""
SELECT 'declines_unique_id' AS test, CAST(sum(n) AS BIGINT) AS rows,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS failures
FROM (SELECT transaction_id, count(*) AS n FROM declines GROUP BY 1) AS a
UNION ALL
SELECT 'retries_unique_attempt', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT)
FROM (SELECT original_transaction_id, retry_attempt_num, count(*) AS n FROM retries GROUP BY 1, 2) AS b
UNION ALL SELECT 'amount_not_null', count(*), count(*) FILTER (WHERE amount_usd IS NULL) FROM declines
UNION ALL SELECT 'amount_positive', count(*), count(*) FILTER (WHERE amount_usd <= 0) FROM declines
UNION ALL SELECT 'amount_within_cap', count(*), count(*) FILTER (WHERE amount_usd > {dbl(C.AMOUNT_CAP_USD)}) FROM declines
UNION ALL SELECT 'code_accepted', count(*), count(*) FILTER (WHERE response_code IS NULL OR response_code NOT IN ({_CODES})) FROM declines
UNION ALL SELECT 'vertical_complete', count(*), count(*) FILTER (WHERE merchant_vertical IS NULL OR merchant_vertical = '') FROM declines
UNION ALL SELECT 'country_code_valid', count(*), count(*) FILTER (WHERE NOT coalesce(regexp_full_match(merchant_country, '[A-Z]{{2}}'), false)) FROM declines
UNION ALL SELECT 'retry_after_original', count(*), count(*) FILTER (WHERE hours_since_original < 0) FROM retries
""", upto="retries"), ops=("Q1", "Q2", "T21"))
def q_table_tests(spark, sf):
    d = fx.declines(spark, sf)
    r = fx.retries(spark, sf)
    amt, code = F.col("amount_usd"), F.col("response_code")
    tests = profile.table_tests([
        ("amount_not_null", d, amt.isNull()),
        ("amount_positive", d, amt <= 0),
        ("amount_within_cap", d, amt > C.AMOUNT_CAP_USD),
        ("code_accepted", d, code.isNull() | ~code.isin(*C.HARD_DECLINE_CODES, *C.SOFT_DECLINE_CODES)),
        ("vertical_complete", d, F.col("merchant_vertical").isNull() | (F.col("merchant_vertical") == "")),
        ("country_code_valid", d, ~F.coalesce(F.col("merchant_country").rlike("^[A-Z]{2}$"), F.lit(False))),
        ("retry_after_original", r, F.col("hours_since_original") < 0),
    ])
    uniq = profile.duplicate_key_test("declines_unique_id", d, ["transaction_id"]).unionByName(
        profile.duplicate_key_test("retries_unique_attempt", r, ["original_transaction_id", "retry_attempt_num"]))
    return uniq.unionByName(tests)


@register("staged_events", """
SELECT event_id, user_id, lower(trim(event_type)) AS event_type, TRY_CAST(value AS DOUBLE) AS value,
       TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS prop_k
FROM events
WHERE TRY_CAST(value AS DOUBLE) > 0 AND coalesce(trim(event_type), '') <> ''""", ops=("Q3", "P3"))
def q_staged_events(spark, sf):
    ev = fx.events(spark, sf)
    typed = ev.select("event_id", "user_id", F.lower(strip_ws("event_type")).alias("event_type"),
                      "value", F.get_json_object("props", "$.k").try_cast("int").alias("prop_k"))
    ok, _ = profile.stage(typed, {"value": "double"},
                          (F.col("value") > 0) & (F.coalesce(F.col("event_type"), F.lit("")) != ""))
    return ok


_SHIFT = ["merchant_vertical", "merchant_country", "processor_name", "response_code"]


def _shift_counts(name: str, cond: str) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS feature, coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING') AS value, count(*) AS n FROM originals WHERE {cond} GROUP BY 1, 2""" for c in _SHIFT)


@register("category_shift", sql_round(["divergence"], with_ctes(f"""
SELECT feature || '_shift' AS test, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows,
       CAST(CASE WHEN d > {C.JS_ALERT} THEN sum(coalesce(n, 0)) ELSE sum(CASE WHEN share IS NULL THEN n ELSE 0 END) END AS BIGINT) AS failures,
       d AS divergence, CAST(sum(CASE WHEN share IS NULL THEN n ELSE 0 END) AS BIGINT) AS unseen_rows
FROM (
  SELECT *, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(2.0 * p / (p + q)) ELSE 0 END) OVER f
            + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(2.0 * q / (p + q)) ELSE 0 END) OVER f AS d
  FROM (
    SELECT coalesce(c.feature, b.feature) AS feature, c.n, b.share, coalesce(b.share, 0.0) AS p,
           coalesce(c.n / c.total, 0.0) AS q
    FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM ({_shift_counts("c", "auth_status = 'DECLINED'")})) AS c
    FULL JOIN (SELECT feature, value, n / sum(n) OVER (PARTITION BY feature) AS share FROM ({_shift_counts("b", "auth_status = 'APPROVED'")})) AS b
      ON b.feature = c.feature AND b.value = c.value) AS j
  WINDOW f AS (PARTITION BY feature)) AS k
GROUP BY feature, d""", upto="originals")), ops=("Q2", "F4"))
def q_category_shift(spark, sf):
    """The declines' categories against stored shares of the approved attempts, as table tests."""
    o = fx.originals(spark, sf)
    base = profile.baseline_shares(o.where(F.col("auth_status") == "APPROVED"), _SHIFT)
    return round_doubles(profile.category_shift_test(o.where(F.col("auth_status") == "DECLINED"), base, _SHIFT))


SKETCHED_NUMBERS, SKETCHED_TEXTS = ["amount_usd", "retry_count", "hours_to_first_retry"], ["merchant_country", "response_code"]


def _sketch_sql() -> str:
    number = ("SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count({c}) AS numbers, "
              "CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, avg(CAST({c} AS DOUBLE)) AS mean, "
              "true AS quantiles_in_bound, true AS distinct_in_bound FROM modeling")
    text = ("SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, CAST(0 AS BIGINT) AS numbers, "
            "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean, "
            "CAST(NULL AS BOOLEAN) AS quantiles_in_bound, true AS distinct_in_bound FROM modeling")
    return with_ctes(" UNION ALL ".join([number.format(c=c) for c in SKETCHED_NUMBERS] + [text.format(c=c) for c in SKETCHED_TEXTS]))


@register("sketch_profile", sql_round(["min_value", "max_value", "mean"], _sketch_sql()), ops=("G14", "G16"))
def q_sketch_profile(spark, sf):
    """Statistics from merged daily sketches, and whether an exact pass finds them within the stated error."""
    m = modeling(spark, sf)
    state = SK.merged(SK.day_sketches(m, F.to_date("timestamp"), SKETCHED_NUMBERS, SKETCHED_TEXTS, F.col("target_recovered_by_retry")))
    told = SK.statistics(state).join(SK.audit(m, state, SKETCHED_NUMBERS, SKETCHED_TEXTS).select("column_name", "rank_error", "distinct_error"), "column_name")
    return round_doubles(told.select("column_name", "rows", "nulls", "numbers", "min_value", "max_value", "mean",
                                     (F.col("rank_error") <= SK.RANK_ERROR).alias("quantiles_in_bound"),
                                     (F.col("distinct_error") <= SK.DISTINCT_ERROR).alias("distinct_in_bound")))
