"""SQL (DuckDB) formulations of the metric operators for the oracles."""

from __future__ import annotations

from rebound import config as C
from rebound.plans.catalog import dbl


def grid_values() -> str:
    return ", ".join(f"({dbl(g)})" for g in C.threshold_grid())


def auc_sql(src: str, group: str, y: str = "y", score: str = "probability") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc
FROM (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS neg_before
  FROM (SELECT {g}{score} AS s, sum({y}) AS pos, sum(1 - {y}) AS neg FROM {src}
        WHERE {score} IS NOT NULL GROUP BY {g}{score}) AS c) AS w
{"GROUP BY " + group if group else ""}"""


def bundle_sql(src: str, group: str, threshold: str, y: str = "y", score: str = "probability") -> str:
    """M5 + AUC; ``group`` is a comma list (may be empty)."""
    g = f"{group}, " if group else ""
    pc = f"least(greatest({score}, {dbl(C.LOG_LOSS_EPS)}), {dbl(1 - C.LOG_LOSS_EPS)})"
    pred = f"CAST({score} >= {threshold} AS INTEGER)"
    base = f"""
SELECT {g}count({score}) AS rows, count(*) FILTER (WHERE {score} IS NULL) AS unscored_rows,
       CAST(coalesce(sum({y}) FILTER (WHERE {score} IS NOT NULL), 0) AS BIGINT) AS positives,
       avg(-({y} * ln({pc}) + (1 - {y}) * ln(1.0 - {pc}))) AS log_loss,
       avg(pow({score} - {y}, 2)) AS brier,
       count(*) FILTER (WHERE {y} = 1 AND {pred} = 1) AS tp,
       count(*) FILTER (WHERE {y} = 0 AND {pred} = 1) AS fp,
       count(*) FILTER (WHERE {y} = 1 AND {pred} = 0) AS fn,
       avg({pred}) AS predicted_positive_rate
FROM {src} {"GROUP BY " + group if group else ""}"""
    prf = prf1_sql("b.tp", "b.fp", "b.fn")
    if group:
        keys = [k.strip() for k in group.split(",")]
        on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)
        sel = ", ".join(f"b.{k}" for k in keys) + ", "
        return f"""
SELECT {sel}b.rows, b.positives, b.log_loss, b.brier, b.tp, b.fp, b.fn, {prf},
       b.predicted_positive_rate, b.unscored_rows, a.auc
FROM ({base}) AS b LEFT JOIN ({auc_sql(src, group, y, score)}) AS a ON {on}"""
    return f"""
SELECT b.rows, b.positives, b.log_loss, b.brier, b.tp, b.fp, b.fn, {prf},
       b.predicted_positive_rate, b.unscored_rows, a.auc
FROM ({base}) AS b, ({auc_sql(src, group, y, score)}) AS a"""


def prf1_sql(tp: str, fp: str, fn: str) -> str:
    prec = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    rec = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {prec} + {rec} > 0 THEN 2.0 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END)"
    return f"CAST({prec} AS DOUBLE) AS precision, CAST({rec} AS DOUBLE) AS recall, CAST({f1} AS DOUBLE) AS f1"


def sweep_sql(src: str, group: str, y: str = "y", score: str = "probability") -> str:
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}threshold, tp, fp, fn, {prf1_sql('tp', 'fp', 'fn')}
FROM (SELECT {g}t.threshold,
             count(*) FILTER (WHERE {score} >= t.threshold AND {y} = 1) AS tp,
             count(*) FILTER (WHERE {score} >= t.threshold AND {y} = 0) AS fp,
             count(*) FILTER (WHERE NOT coalesce({score} >= t.threshold, false) AND {y} = 1) AS fn
      FROM {src}, (VALUES {grid_values()}) AS t(threshold)
      GROUP BY {g}t.threshold) AS c"""


def first_best_sql(inner: str, group: str, metric: str, cols: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"""
SELECT {cols} FROM (
  SELECT *, row_number() OVER ({part}ORDER BY {metric} DESC, threshold ASC) AS r FROM ({inner}) AS i) AS z
WHERE r = 1"""


def frontier_sql(src: str, group: str, y: str = "y", score: str = "probability",
                 amount: str = "amount_usd") -> str:
    g = f"{group}, " if group else ""
    ev = f"{score} * coalesce({amount}, {dbl(0.0)}) * {dbl(C.DEFAULT_MARGIN_RATE)} - {dbl(C.DEFAULT_RETRY_COST_USD)} - {dbl(C.DEFAULT_FRICTION_COST_USD)}"
    take = f"{score} >= t.threshold AND {ev} > 0"
    r, f = dbl(C.DEFAULT_RETRY_COST_USD), dbl(C.DEFAULT_FRICTION_COST_USD)
    return f"""
SELECT {g}threshold, retry_count, recovered_count, gross_margin_recovered_usd,
       (retry_count - recovered_count) * {r} AS wasted_retry_cost_usd,
       retry_count * {f} AS friction_cost_usd,
       gross_margin_recovered_usd - (retry_count - recovered_count) * {r} - retry_count * {f}
         AS realized_net_value_usd
FROM (SELECT {g}t.threshold,
             count(*) FILTER (WHERE {take}) AS retry_count,
             count(*) FILTER (WHERE {take} AND {y} = 1) AS recovered_count,
             coalesce(sum(CASE WHEN {take} AND {y} = 1
                          THEN coalesce({amount}, {dbl(0.0)}) * {dbl(C.DEFAULT_MARGIN_RATE)} END), {dbl(0.0)})
               AS gross_margin_recovered_usd
      FROM {src}, (VALUES {grid_values()}) AS t(threshold)
      GROUP BY {g}t.threshold) AS c"""
