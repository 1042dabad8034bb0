"""The fixture bindings of ``rebound.plans.fixture`` written as DuckDB SQL.

Each constant is a list of CTE bodies; :func:`with_ctes` joins the ones a
query needs.  The SQL is written independently of the Spark plan (window
ranks instead of struct minima, plain joins instead of pre-aggregation), so
agreement is a real check of the Spark operators.
"""

from __future__ import annotations

from rebound import config as C
from rebound.plans.catalog import dbl
from rebound.plans.fixture import PRIORITY_CODES

_CODE_CASE = "CASE substr(o.o_orderpriority, 1, 1) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_CODES.items()) + " END"

CTE = {
    "geo": """
SELECT c.c_custkey, c.c_mktsegment AS merchant_vertical, n.n_name AS merchant_country,
       r.r_name AS processor_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "originals": f"""
SELECT o.o_orderkey AS transaction_id, o.o_orderdate AS ts, o.o_custkey AS merchant_id,
       g.merchant_vertical, g.merchant_country, g.processor_name,
       o.o_totalprice / 100 AS amount_usd,
       CASE WHEN o.o_orderstatus = 'F' THEN {_CODE_CASE} ELSE '00' END AS response_code,
       (o.o_orderstatus = 'F' AND {_CODE_CASE} <> '54') AS is_soft_decline,
       CASE WHEN o.o_orderstatus = 'F' THEN 'DECLINED' ELSE 'APPROVED' END AS auth_status
FROM orders o LEFT JOIN geo g ON o.o_custkey = g.c_custkey""",
    "declines": """
SELECT transaction_id, ts, merchant_id, merchant_vertical, merchant_country, processor_name,
       amount_usd, response_code, is_soft_decline
FROM originals WHERE auth_status = 'DECLINED'""",
    "retries": """
SELECT l.l_orderkey AS original_transaction_id, l.l_linenumber AS retry_attempt_num,
       CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'APPROVED' ELSE 'DECLINED' END AS auth_status,
       CAST(date_diff('second', o.o_orderdate, l.l_shipdate) AS DOUBLE) / 3600.0 AS hours_since_original,
       l.l_shipdate AS ts, l.l_partkey AS tb1, l.l_suppkey AS tb2
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F' AND l.l_shipdate >= o.o_orderdate""",
    "ranked_retries": """
SELECT *,
       row_number() OVER (PARTITION BY original_transaction_id
                          ORDER BY retry_attempt_num, hours_since_original, tb1, tb2) AS rn,
       row_number() OVER (PARTITION BY original_transaction_id, auth_status = 'APPROVED'
                          ORDER BY retry_attempt_num, hours_since_original, tb1, tb2) AS rn_ok
FROM retries""",
    "summary": """
SELECT original_transaction_id, count(*) AS retry_count,
       max(retry_attempt_num) AS max_retry_attempt_num,
       bool_or(auth_status = 'APPROVED') AS any_approved,
       max(CASE WHEN rn = 1 THEN auth_status END) AS first_retry_status,
       max(CASE WHEN rn = 1 THEN retry_attempt_num END) AS first_retry_attempt_num,
       max(CASE WHEN rn = 1 THEN hours_since_original END) AS hours_to_first_retry,
       max(CASE WHEN rn_ok = 1 AND auth_status = 'APPROVED' THEN retry_attempt_num END) AS recovery_attempt_num,
       max(CASE WHEN rn_ok = 1 AND auth_status = 'APPROVED' THEN hours_since_original END) AS hours_to_recovery
FROM ranked_retries GROUP BY original_transaction_id""",
    "modeling": """
SELECT d.*,
       s.original_transaction_id IS NOT NULL AS has_any_retry,
       CAST(coalesce(s.retry_count, 0) AS BIGINT) AS retry_count,
       s.max_retry_attempt_num,
       coalesce(s.any_approved, false) AS target_recovered_by_retry,
       coalesce(s.first_retry_status = 'APPROVED', false) AS target_first_retry_approved,
       s.first_retry_status, s.first_retry_attempt_num, s.hours_to_first_retry,
       s.recovery_attempt_num, s.hours_to_recovery
FROM declines d LEFT JOIN summary s ON d.transaction_id = s.original_transaction_id""",
}

ORDER = ["geo", "originals", "declines", "retries", "ranked_retries", "summary", "modeling"]


def with_ctes(body: str, upto: str = "modeling", extra: list[tuple[str, str]] | None = None) -> str:
    names = ORDER[: ORDER.index(upto) + 1]
    parts = [f"{n} AS ({CTE[n]}\n)" for n in names]
    for n, q in extra or []:
        parts.append(f"{n} AS ({q}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body


def rule_probability_sql(soft: str = "is_soft_decline", amount: str = "amount_usd",
                         code: str = "response_code") -> str:
    s = f"coalesce({soft}, false)"
    a = f"coalesce({amount}, {dbl(0.0)})"
    cd = f"coalesce({code}, '')"
    p = f"(CASE WHEN {s} THEN {dbl(C.RULE_SOFT_BASE)} ELSE {dbl(C.RULE_HARD_BASE)} END)"
    p = (f"({p} + CASE WHEN {s} AND {a} > {dbl(C.RULE_SOFT_LARGE_AMOUNT)} "
         f"THEN {dbl(C.RULE_SOFT_LARGE_BONUS)} ELSE {dbl(0.0)} END)")
    for k, bonus in C.RULE_CODE_BONUS.items():
        p = f"({p} + CASE WHEN {cd} = '{k}' THEN {dbl(bonus)} ELSE {dbl(0.0)} END)"
    zero = ", ".join(f"'{z}'" for z in C.RULE_ZERO_CODES)
    p = f"(CASE WHEN {cd} IN ({zero}) THEN {dbl(0.0)} ELSE {p} END)"
    return f"least(greatest({p}, {dbl(0.0)}), {dbl(C.RULE_CLIP_MAX)})"


def ev_sql(prob: str, amount: str = "amount_usd", margin=C.DEFAULT_MARGIN_RATE,
           retry=C.DEFAULT_RETRY_COST_USD, friction=C.DEFAULT_FRICTION_COST_USD) -> str:
    m = dbl(margin) if isinstance(margin, float) else margin
    r = dbl(retry) if isinstance(retry, float) else retry
    f = dbl(friction) if isinstance(friction, float) else friction
    return f"{prob} * coalesce({amount}, {dbl(0.0)}) * {m} - {r} - {f}"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
