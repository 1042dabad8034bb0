"""Registered batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import drift
from rebound.operators.ordered import exact_quantiles
from rebound.plans import fixture as fx
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.sqlbase import with_ctes

HORIZON_HOURS = int(C.DELAY_GRID_HOURS[-1])


@register("monitor_per_minute", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events,
       count(*) FILTER (WHERE event_type = 'error') AS declines,
       count(*) FILTER (WHERE event_type = 'purchase') AS approvals
FROM events GROUP BY 1""", ops=("S4", "T25"))
def q_monitor_per_minute(spark, sf):
    ev = fx.events(spark, sf, ["ts", "event_type"])
    g = ev.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("declines"),
        F.count_if(F.col("event_type") == "purchase").alias("approvals"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "events", "declines", "approvals")


BASELINE_DAYS = 7


def _psi_sql() -> str:
    qs = ", ".join(dbl(i / 10) for i in range(11))
    return f"""
WITH b0 AS (SELECT min(ts) AS t0 FROM events),
base AS (SELECT value FROM events, b0 WHERE ts < t0 + INTERVAL {BASELINE_DAYS} DAYS AND value IS NOT NULL),
edges AS (SELECT list_sort(list_distinct(quantile_cont(value, [{qs}]))) AS e FROM base),
binned AS (
  SELECT ts, CAST(CASE WHEN value = e[len(e)] THEN len(e) - 2
                       ELSE len(list_filter(e, lambda x: x <= value)) - 1 END AS INTEGER) AS bucket
  FROM events, edges WHERE value IS NOT NULL AND value >= e[1] AND value <= e[len(e)]),
bshare AS (
  SELECT bucket, count(*) AS n FROM (
    SELECT CAST(CASE WHEN value = e[len(e)] THEN len(e) - 2
                     ELSE len(list_filter(e, lambda x: x <= value)) - 1 END AS INTEGER) AS bucket
    FROM base, edges) AS q GROUP BY bucket),
bins AS (SELECT CAST(i - 1 AS INTEGER) AS bucket FROM edges, range(1, len(e)) AS r(i)),
bdense AS (SELECT b.bucket, greatest(coalesce(s.n, 0) / (SELECT sum(n) FROM bshare), 1e-6) AS ep
           FROM bins b LEFT JOIN bshare s USING (bucket)),
win AS (SELECT date_trunc('hour', ts) - to_hours(k) AS ws, bucket FROM binned, range(0, 24) AS r(k)),
wcounts AS (SELECT ws, bucket, count(*) AS n FROM win GROUP BY ws, bucket),
wtot AS (SELECT ws, sum(n) AS total FROM wcounts GROUP BY ws),
dense AS (SELECT t.ws, b.bucket, b.ep, greatest(coalesce(c.n, 0) / t.total, 1e-6) AS ap
          FROM wtot t CROSS JOIN bdense b LEFT JOIN wcounts c ON c.ws = t.ws AND c.bucket = b.bucket)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST((SELECT total FROM wtot w2 WHERE w2.ws = d.ws) AS BIGINT) AS rows,
       sum((ap - ep) * ln(ap / ep)) AS psi
FROM dense d GROUP BY ws"""


@register("sliding_value_psi", sql_round(["psi"], _psi_sql()), ops=("S5", "F7", "F1"))
def q_sliding_value_psi(spark, sf):
    ev = fx.events(spark, sf, ["ts", "value"]).where(F.col("value").isNotNull())
    t0 = ev.agg(F.min("ts")).first()[0]
    base = ev.where(F.col("ts") < F.lit(t0) + F.expr(f"INTERVAL {BASELINE_DAYS} DAYS"))
    edges = sorted(set(exact_quantiles(base, "value", [i / 10 for i in range(11)]).get((), [])))
    arr = F.array(*[F.lit(float(x)) for x in edges])
    v = F.col("value")
    bucket = (F.when((v < F.lit(float(edges[0]))) | (v > F.lit(float(edges[-1]))), F.lit(None))
              .when(v == F.lit(float(edges[-1])), F.lit(len(edges) - 2))
              .otherwise(F.size(F.filter(arr, lambda x: x <= v)) - 1))
    binned = ev.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    bcounts = {r["bucket"]: r["n"] for r in binned.where(F.col("ts") < F.lit(t0) + F.expr(
        f"INTERVAL {BASELINE_DAYS} DAYS")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    btot = sum(bcounts.values())
    # baseline shares: one number per bin (at most 10)
    shares = {b: bcounts.get(b, 0) / btot for b in range(len(edges) - 1)}
    counts = (binned.groupBy(F.window("ts", "1 day", "1 hour").alias("w"), "bucket")
              .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("ws"), "bucket", "n"))
    out = drift.psi_from_window_counts(counts, shares, len(edges) - 1, "ws")
    return round_doubles(out.select(F.date_format("ws", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                    F.col("rows").cast("bigint").alias("rows"), "psi"))


@register("horizon_labels", with_ctes(f"""
SELECT d.transaction_id, coalesce(h.n, 0) AS retries_within_horizon,
       coalesce(h.ok, false) AS recovered_within_horizon
FROM declines d LEFT JOIN (
  SELECT original_transaction_id, count(*) AS n, bool_or(auth_status = 'APPROVED') AS ok FROM retries
  WHERE hours_since_original <= {HORIZON_HOURS} GROUP BY 1) AS h ON h.original_transaction_id = d.transaction_id""",
    upto="retries"), ops=("S6",))
def q_horizon_labels(spark, sf):
    cells = fx.retry_cells(spark, sf).where(F.col("hours_since_original") <= HORIZON_HOURS)
    h = cells.groupBy("original_transaction_id").agg(
        F.sum("weight").alias("n"), F.max(F.col("auth_status") == "APPROVED").alias("ok"))
    d = fx.declines(spark, sf).select("transaction_id")
    j = d.join(h, d.transaction_id == h.original_transaction_id, "left")
    return j.select("transaction_id", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("retries_within_horizon"),
                    F.coalesce(F.col("ok"), F.lit(False)).alias("recovered_within_horizon"))
