"""Registered queries: drift between the train window and the test window."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rebound.functions.parse import time_features
from rebound.operators import drift
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.q_metrics import split_modeling, split_sql

NUMERIC = ["amount_usd", "event_dayofweek", "event_month", "is_soft_decline"]
CATEGORICAL = ["merchant_country", "response_code", "merchant_vertical", "processor_name"]
EXPECTED = ["latency_ms"]


def drift_samples(spark: SparkSession, sf: str):
    sm = split_modeling(spark, sf).withColumns(time_features("timestamp"))
    return sm.where(F.col("split") == "train"), sm.where(F.col("split") == "test")


def _feat_cte() -> tuple[str, str]:
    return ("feat", """
SELECT CASE WHEN split = 'train' THEN 'base' ELSE 'current' END AS sample,
       CAST(amount_usd AS DOUBLE) AS amount_usd, CAST(isodow(ts) - 1 AS DOUBLE) AS event_dayofweek,
       CAST(month(ts) AS DOUBLE) AS event_month,
       CAST(coalesce(CAST(is_soft_decline AS INTEGER), 0) AS DOUBLE) AS is_soft_decline,
       merchant_country, response_code, merchant_vertical, processor_name
FROM scored WHERE split IN ('train', 'test')""")


def drift_sql() -> str:
    qs = ", ".join(dbl(i / 10) for i in range(11))
    nlong = " UNION ALL ".join(f"SELECT sample, '{f}' AS feature, {f} AS value FROM feat" for f in NUMERIC)
    clong = " UNION ALL ".join(
        f"SELECT sample, '{f}' AS feature, coalesce(NULLIF(CAST({f} AS VARCHAR), ''), 'MISSING') AS value FROM feat"
        for f in CATEGORICAL)
    series = ("list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)"
              " * exp(-2.0 * k * k * z * z)))")
    more = [
        _feat_cte(),
        ("nvals", f"SELECT * FROM ({nlong}) AS u WHERE value IS NOT NULL AND NOT isnan(value)"),
        ("edges", f"""
SELECT feature, list_sort(list_distinct(quantile_cont(value, [{qs}]))) AS e
FROM nvals WHERE sample = 'base' GROUP BY feature"""),
        ("pres", """
SELECT feature, (count(*) FILTER (WHERE sample = 'base') > 0 AND count(*) FILTER (WHERE sample = 'current') > 0) AS ok
FROM nvals GROUP BY feature"""),
        ("bins", "SELECT feature, CAST(i - 1 AS INTEGER) AS bucket FROM edges, range(1, len(e)) AS r(i) WHERE len(e) >= 3"),
        ("nb", """
SELECT v.feature, v.sample,
       CAST(CASE WHEN v.value = e[len(e)] THEN len(e) - 2
                 ELSE len(list_filter(e, lambda x: x <= v.value)) - 1 END AS INTEGER) AS bucket
FROM nvals v JOIN edges USING (feature)
WHERE len(e) >= 3 AND v.value >= e[1] AND v.value <= e[len(e)]"""),
        ("cnt", """
SELECT b.feature, b.bucket, count(*) FILTER (WHERE nb.sample = 'base') AS e_n,
       count(*) FILTER (WHERE nb.sample = 'current') AS a_n
FROM bins b LEFT JOIN nb USING (feature, bucket) GROUP BY b.feature, b.bucket"""),
        ("shares", """
SELECT feature,
       greatest(e_n / greatest(sum(e_n) OVER (PARTITION BY feature), 1), 1e-6) AS ep,
       greatest(a_n / greatest(sum(a_n) OVER (PARTITION BY feature), 1), 1e-6) AS ap
FROM cnt"""),
        ("psi", """
SELECT p.feature, CASE WHEN NOT p.ok THEN NULL WHEN len(e.e) < 3 THEN 0.0 ELSE s.psi END AS psi
FROM pres p LEFT JOIN edges e USING (feature)
LEFT JOIN (SELECT feature, sum((ap - ep) * ln(ap / ep)) AS psi FROM shares GROUP BY feature) AS s USING (feature)"""),
        ("kc", """
SELECT feature, value, count(*) FILTER (WHERE sample = 'base') AS b,
       count(*) FILTER (WHERE sample = 'current') AS c FROM nvals GROUP BY feature, value"""),
        ("kcum", """
SELECT feature, sum(b) OVER (PARTITION BY feature ORDER BY value) / sum(b) OVER (PARTITION BY feature) AS fb,
       sum(c) OVER (PARTITION BY feature ORDER BY value) / sum(c) OVER (PARTITION BY feature) AS fc,
       sum(b) OVER (PARTITION BY feature) AS nb, sum(c) OVER (PARTITION BY feature) AS nc
FROM kc"""),
        ("ks0", """
SELECT feature, max(abs(fb - fc)) AS d, CAST(max(nb) AS DOUBLE) AS nb, CAST(max(nc) AS DOUBLE) AS nc
FROM kcum GROUP BY feature"""),
        ("ks", f"""
SELECT feature, d, CASE WHEN z < 0.05 THEN 1.0 ELSE least(greatest(2.0 * {series}, 0.0), 1.0) END AS p
FROM (SELECT *, sqrt(nb * nc / (nb + nc)) * d AS z FROM ks0) AS k"""),
        ("clong", clong),
        ("ccnt", """
SELECT sample, feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY sample, feature) AS total,
       row_number() OVER (PARTITION BY sample, feature ORDER BY count(*) DESC, value ASC) AS r
FROM clong GROUP BY sample, feature, value"""),
        ("ctop", "SELECT sample, feature, value, n / total AS share FROM ccnt WHERE r <= 10"),
        ("cu", """
SELECT coalesce(b.feature, c.feature) AS feature, coalesce(b.share, 1e-6) AS p, coalesce(c.share, 1e-6) AS q
FROM (SELECT * FROM ctop WHERE sample = 'base') AS b
FULL OUTER JOIN (SELECT * FROM ctop WHERE sample = 'current') AS c
  ON b.feature = c.feature AND b.value = c.value"""),
        ("cn", """
SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM cu"""),
        ("js", """
SELECT feature, 0.5 * sum(p * ln(p / ((p + q) / 2.0))) + 0.5 * sum(q * ln(q / ((p + q) / 2.0))) AS js
FROM cn GROUP BY feature"""),
    ]
    alert = """CASE WHEN psi > 0.25 THEN 'retrain' WHEN psi > 0.2 THEN 'investigate'
            WHEN js_divergence > 0.2 THEN 'investigate' WHEN p_value < 0.05 THEN 'investigate' ELSE 'ok' END"""
    body = f"""
SELECT feature, feature_type, psi, ks_stat, p_value, js_divergence,
       CASE WHEN feature_type = 'missing' THEN NULL ELSE {alert} END AS alert
FROM (
  SELECT psi.feature, 'numeric' AS feature_type, CAST(psi.psi AS DOUBLE) AS psi, ks.d AS ks_stat,
         CAST(ks.p AS DOUBLE) AS p_value, CAST(NULL AS DOUBLE) AS js_divergence
  FROM psi LEFT JOIN ks USING (feature)
  UNION ALL
  SELECT feature, 'categorical', NULL, NULL, NULL, js FROM js
  UNION ALL
  SELECT 'latency_ms', 'missing', NULL, NULL, NULL, NULL) AS t"""
    return sql_round(["psi", "ks_stat", "p_value", "js_divergence"], split_sql(body, more))


@register("drift_metrics", drift_sql(), ops=("F1", "F2", "F3", "F4", "F5", "F6", "G9", "U1", "T8", "P5"))
def q_drift_metrics(spark, sf):
    base, cur = drift_samples(spark, sf)
    return round_doubles(drift.drift_table(base, cur, NUMERIC, CATEGORICAL, EXPECTED))


def _unseen_sql() -> str:
    clong = " UNION ALL ".join(
        f"SELECT sample, '{f}' AS feature, coalesce(NULLIF(CAST({f} AS VARCHAR), ''), 'MISSING') AS value FROM feat"
        for f in CATEGORICAL)
    body = """
SELECT feature, count(*) AS rows, count(*) FILTER (WHERE NOT seen) AS unseen_rows,
       count(*) FILTER (WHERE NOT seen) / count(*) AS unseen_rate,
       count(*) FILTER (WHERE NOT seen) / count(*) > 0.05 AS alert
FROM (SELECT c.feature, EXISTS (SELECT 1 FROM blong b WHERE b.feature = c.feature AND b.value = c.value) AS seen
      FROM clong2 c WHERE c.sample = 'current') AS x GROUP BY feature"""
    more = [_feat_cte(), ("clong2", clong),
            ("blong", "SELECT DISTINCT feature, value FROM clong2 WHERE sample = 'base'")]
    return sql_round(["unseen_rate"], split_sql(body, more))


@register("unseen_categories", _unseen_sql(), ops=("F8", "J8"))
def q_unseen_categories(spark, sf):
    base, cur = drift_samples(spark, sf)
    return round_doubles(drift.unseen_category_rate(base, cur, CATEGORICAL))
