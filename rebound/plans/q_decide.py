"""Registered queries: scope guard, timing table, delay curve, decision table, work list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators import cascade as CA
from rebound.operators import decide as D
from rebound.operators import features as FE
from rebound.plans import fixture as fx
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.memo import memo
from rebound.plans.q_metrics import split_modeling, split_sql
from rebound.plans.sqlbase import ev_sql

# The fixture amounts run from 10 to 5,000 USD: a 4,000 cap exercises the guard.
FIXTURE_AMOUNT_CAP = 4000.0
VOCAB_FIELDS = {"merchant_country": "merchant_country", "merchant_vertical": "merchant_vertical",
                "processor_name": "processor_name"}
FLAGS = {k: f"__in_{k}" for k in VOCAB_FIELDS}


def scored_with_vocab(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Scored rows with a flag per scope vocabulary learnt from the train window."""
    sm = split_modeling(spark, sf)
    vocab = FE.vocabulary(sm.where(F.col("split") == "train"), list(VOCAB_FIELDS))
    return D.vocabulary_flags(sm, vocab, VOCAB_FIELDS), dict(FLAGS)


def timing(spark: SparkSession, sf: str) -> DataFrame:
    return memo(spark, ("timing", sf), lambda: D.fit_timing_table(
        fx.retry_cells(spark, sf), fx.decline_codes(spark, sf), weight="weight"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        s, vocab = scored_with_vocab(spark, sf)
        return D.decision_table(s, "probability", timing(spark, sf), attempt=1,
                                amount_cap=FIXTURE_AMOUNT_CAP, vocab=vocab)
    return memo(spark, ("decisions", sf), build)


# ---------------------------------------------------------------- SQL
def _norm(c: str) -> str:
    return rf"NULLIF(upper(regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '^\s+', ''), '\s+$', '')), '')"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '^\s+', ''), '\s+$', '')"


_SUP = ", ".join(f"'{c}'" for c in C.HARD_DECLINE_CODES + C.SOFT_DECLINE_CODES)
_HARD = ", ".join(f"'{c}'" for c in C.HARD_DECLINE_CODES)
_REASONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.HARD_DECLINE_REASONS.items())
_GRID = C.DELAY_GRID_HOURS


def _bucket_sql(h: str) -> str:
    parts = " ".join(f"WHEN {h} >= {dbl(d)} THEN {dbl(d)}" for d in reversed(_GRID[1:]))
    return f"CASE {parts} ELSE {dbl(_GRID[0])} END"


def _fr(x: str, d: int) -> str:
    s = f"{10.0 ** d:.1f}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def _money(x: str) -> str:
    """Two decimals, rounded like ``_fr``, with thousands separated (amounts below a billion)."""
    cents = f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"
    whole = f"({cents} // 100)"
    return (f"(CASE WHEN {whole} >= 1000000 THEN printf('%d,%03d,%03d', {whole} // 1000000, {whole} // 1000 % 1000, {whole} % 1000) "
            f"WHEN {whole} >= 1000 THEN printf('%d,%03d', {whole} // 1000, {whole} % 1000) ELSE printf('%d', {whole}) END "
            f"|| printf('.%02d', {cents} % 100))")


def _off(col: str, vocab_cte: str, upper: bool) -> str:
    v = _strip(col)
    key = f"upper({v})" if upper else v
    return (f"({v} IS NOT NULL AND {v} <> '' AND {key} NOT IN "
            f"(SELECT {'upper(value)' if upper else 'value'} FROM {vocab_cte} WHERE feature = '{col}'))")


_MARGIN = "CASE merchant_vertical " + " ".join(
    f"WHEN '{k}' THEN {dbl(v)}" for k, v in C.VERTICAL_MARGIN_RATES.items()) + f" ELSE {dbl(C.DEFAULT_MARGIN_RATE)} END"

DECIDE_CTES = [
    ("dvocab", " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS feature, coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING') AS value "
        f"FROM scored WHERE split = 'train'" for c in VOCAB_FIELDS)),
    ("guarded", f"""
SELECT s.*, {_MARGIN} AS margin_rate,
       CASE WHEN {_norm('response_code')} IS NULL OR {_norm('response_code')} NOT IN ({_SUP}) THEN 'response_code'
            WHEN {_norm('response_code')} IN ({_HARD}) THEN 'hard_decline'
            WHEN {_off('merchant_country', 'dvocab', True)} THEN 'merchant_country'
            WHEN {_off('merchant_vertical', 'dvocab', False)} THEN 'merchant_vertical'
            WHEN {_off('processor_name', 'dvocab', False)} THEN 'processor_name'
            WHEN amount_usd IS NOT NULL AND amount_usd > {dbl(FIXTURE_AMOUNT_CAP)} THEN 'amount' END AS scope_reason
FROM scored s"""),
    ("rt", f"""
SELECT d.response_code AS code, r.retry_attempt_num AS att, {_bucket_sql('r.hours_since_original')} AS d,
       CASE WHEN r.auth_status = 'APPROVED' THEN 1 ELSE 0 END AS ok
FROM retries r JOIN declines d ON r.original_transaction_id = d.transaction_id"""),
    ("tprior", "SELECT code, avg(ok) AS prior FROM rt GROUP BY code"),
    ("tcells", f"""
SELECT c.code, c.att, c.d, (c.m * c.n + p.prior * {dbl(20.0)}) / (c.n + {dbl(20.0)}) AS p
FROM (SELECT code, att, d, count(*) AS n, avg(ok) AS m FROM rt GROUP BY code, att, d) AS c JOIN tprior p USING (code)"""),
    ("tdense", f"""
SELECT k.code, k.att, g.d, coalesce(c.p, p.prior) AS p
FROM (SELECT DISTINCT code, att FROM tcells) AS k JOIN tprior p USING (code)
CROSS JOIN (VALUES {", ".join(f"({dbl(d)})" for d in _GRID)}) AS g(d)
LEFT JOIN tcells c ON c.code = k.code AND c.att = k.att AND c.d = g.d"""),
    ("curve", f"""
SELECT g.transaction_id, t.d AS delay_hours, coalesce(x.p, g.probability) AS p,
       {_fr('coalesce(x.p, g.probability)', 6)} AS success_probability,
       {_fr(f'coalesce(x.p, g.probability) * coalesce(g.amount_usd, {dbl(0.0)}) * g.margin_rate - {dbl(C.DEFAULT_RETRY_COST_USD)} - {dbl(C.DEFAULT_FRICTION_COST_USD)}', 4)}
         AS expected_value
FROM guarded g CROSS JOIN (VALUES {", ".join(f"({dbl(d)})" for d in _GRID)}) AS t(d)
LEFT JOIN tdense x ON x.code = g.response_code AND x.att = 1 AND x.d = t.d
WHERE g.scope_reason IS NULL"""),
    ("best", """
SELECT transaction_id, delay_hours AS b_delay, success_probability AS b_p, expected_value AS b_ev FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY expected_value DESC, delay_hours ASC) AS r
  FROM curve) AS z WHERE r = 1"""),
    ("dec", f"""
SELECT g.*, b.b_delay, b.b_p, b.b_ev,
       {dbl(C.DEFAULT_THRESHOLD)} AS decision_threshold,
       (b.b_ev >= {dbl(C.DEFAULT_MIN_RETRY_EV_USD)}) AS ev_ok, (b.b_p >= {dbl(C.DEFAULT_THRESHOLD)}) AS p_ok,
       g.probability * coalesce(g.amount_usd, {dbl(0.0)}) * g.margin_rate - {dbl(C.DEFAULT_RETRY_COST_USD)}
         - {dbl(C.DEFAULT_FRICTION_COST_USD)} AS ev
FROM guarded g LEFT JOIN best b USING (transaction_id)"""),
    ("dtable", f"""
SELECT transaction_id,
       CASE WHEN scope_reason = 'hard_decline' THEN 'do_not_retry' WHEN scope_reason IS NOT NULL THEN 'out_of_scope'
            WHEN ev_ok AND p_ok THEN 'retry' ELSE 'do_not_retry' END AS recommended_action,
       scope_reason,
       CASE WHEN scope_reason = 'response_code' THEN printf('{C.OUT_OF_SCOPE_CODE.replace("'", "''")}', coalesce({_norm('response_code')}, '<empty>'))
            WHEN scope_reason IN ('merchant_country', 'merchant_vertical', 'processor_name')
            THEN printf('{C.OUT_OF_SCOPE_CATEGORY}', scope_reason, CASE scope_reason WHEN 'merchant_country' THEN {_strip('merchant_country')}
                        WHEN 'merchant_vertical' THEN {_strip('merchant_vertical')} ELSE {_strip('processor_name')} END)
            WHEN scope_reason = 'amount' THEN 'Amount $' || {_money('amount_usd')} || ' exceeds the model''s training envelope ($'
              || {_money(dbl(FIXTURE_AMOUNT_CAP))} || '). Use a manual review or merchant''s high-ticket workflow rather than automated retry.' END
         AS out_of_scope_reason,
       '{C.MODEL_VERSION}' AS model_version, '{C.POLICY_VERSION}' AS policy_version, decision_threshold AS decision_threshold_used,
       CASE WHEN scope_reason = 'hard_decline'
            THEN coalesce(CASE {_norm('response_code')} {_REASONS} END, '{C.HARD_DECLINE_DEFAULT_REASON}') END
         AS hard_decline_reason,
       CASE WHEN scope_reason = 'hard_decline' THEN 0.0 WHEN scope_reason IS NULL THEN {_fr('probability', 6)} END
         AS recoverability_score,
       CASE WHEN scope_reason = 'hard_decline' THEN 0.0
            WHEN scope_reason IS NULL AND ev_ok AND p_ok THEN {_fr('ev', 4)} END AS expected_value,
       CASE WHEN scope_reason IS NULL
            THEN {_fr(f'least(1.0, abs(probability - decision_threshold) / {dbl(C.CONFIDENCE_SCALE)})', 4)} END
         AS confidence,
       margin_rate, decision_threshold,
       CASE WHEN scope_reason IS NULL AND ev_ok AND p_ok THEN b_delay END AS recommended_delay_hours,
       CASE WHEN scope_reason IS NULL AND ev_ok AND p_ok THEN b_p END AS recommended_delay_probability,
       CASE WHEN scope_reason IS NULL AND ev_ok AND p_ok THEN b_ev END AS recommended_delay_expected_value,
       CASE WHEN scope_reason IS NULL AND NOT (ev_ok AND p_ok) THEN
         'Attempt 1: ' || concat_ws('; ',
            CASE WHEN NOT p_ok THEN printf('best-delay success probability %.3f is below decision_threshold %.2f',
                                           {_fr('b_p', 3)}, {_fr('decision_threshold', 2)}) END,
            CASE WHEN NOT ev_ok THEN printf('best-delay expected value $%.2f is below min_retry_ev_usd $%.2f',
                                            {_fr('b_ev', 2)}, {_fr(dbl(C.DEFAULT_MIN_RETRY_EV_USD), 2)}) END)
         || '. Timing model conditions on attempt_num, so success probability decays as retries accumulate; '
         || 'once it crosses either the probability or EV floor the engine stops.' END AS attempt_decision_reason,
       target_recovered_by_retry, probability, amount_usd
FROM dec"""),
]

DT_COLS = ["transaction_id", "recommended_action", "scope_reason", "hard_decline_reason", "recoverability_score",
           "expected_value", "confidence", "margin_rate", "decision_threshold", "recommended_delay_hours",
           "recommended_delay_probability", "recommended_delay_expected_value", "attempt_decision_reason",
           "out_of_scope_reason", "model_version", "policy_version", "decision_threshold_used"]
DT_DOUBLES = ["decision_threshold_used", "recoverability_score", "expected_value", "confidence", "margin_rate", "decision_threshold",
              "recommended_delay_hours", "recommended_delay_probability", "recommended_delay_expected_value"]


def dsql(body: str, more=None) -> str:
    return split_sql(body, DECIDE_CTES + (more or []))


@register("scope_guard", dsql("""
SELECT transaction_id, scope_reason, hard_decline_reason FROM dtable"""), ops=("D6", "D7", "J8", "T12", "T14"))
def q_scope_guard(spark, sf):
    return decisions(spark, sf).select("transaction_id", "scope_reason", "hard_decline_reason")


@register("timing_table", sql_round(["code_prior", "success_probability"], dsql("""
SELECT x.code AS timing_code, x.att AS timing_attempt, p.prior AS code_prior, x.d AS delay_hours,
       x.p AS success_probability
FROM tdense x JOIN tprior p USING (code)""")), ops=("D8",))
def q_timing_table(spark, sf):
    t = timing(spark, sf)
    grid = F.array(*[F.lit(float(d)) for d in C.DELAY_GRID_HOURS])
    long = t.select("timing_code", "timing_attempt", "code_prior",
                    F.explode(F.arrays_zip(grid.alias("delay_hours"),
                                           F.col("delay_probs").alias("success_probability"))).alias("z"))
    return round_doubles(long.select("timing_code", "timing_attempt", "code_prior", "z.delay_hours",
                                     "z.success_probability"))


@register("delay_curve", sql_round(["delay_hours", "success_probability", "expected_value"], dsql("""
SELECT transaction_id, delay_hours, success_probability, expected_value FROM curve""")), ops=("D8", "A10"))
def q_delay_curve(spark, sf):
    d = decisions(spark, sf).where(F.col("scope_reason").isNull())
    return round_doubles(d.select("transaction_id", F.explode("delay_curve").alias("c")).select(
        "transaction_id", "c.delay_hours", "c.success_probability", "c.expected_value"))


@register("decision_table", sql_round(DT_DOUBLES, dsql(f"SELECT {', '.join(DT_COLS)} FROM dtable")),
          ops=("D2", "D3", "D9", "D10", "D11", "D13", "A9", "T11", "T27"))
def q_decision_table(spark, sf):
    return round_doubles(decisions(spark, sf).select(*DT_COLS))


@register("batch_score_summary", sql_round(["retry_expected_value_usd"], dsql("""
SELECT count(*) AS rows, count(*) FILTER (WHERE recommended_action = 'retry') AS retry_count,
       count(*) FILTER (WHERE recommended_action = 'do_not_retry') AS do_not_retry_count,
       count(*) FILTER (WHERE recommended_action = 'out_of_scope') AS out_of_scope_count,
       CAST(coalesce(sum(CASE WHEN recommended_action = 'retry' THEN CAST(expected_value AS DECIMAL(20,4)) END), 0)
            AS DOUBLE) AS retry_expected_value_usd,
       count(*) FILTER (WHERE recommended_action = 'retry' AND coalesce(target_recovered_by_retry, false))
         AS hindsight_recoveries
FROM dtable""")), ops=("G12", "D14"))
def q_batch_score_summary(spark, sf):
    d = decisions(spark, sf).join(split_modeling(spark, sf).select("transaction_id", "target_recovered_by_retry"),
                                  "transaction_id")
    return round_doubles(D.batch_summary(d))


@register("recovery_worklist", sql_round(["expected_value", "recoverability_score"], dsql("""
SELECT transaction_id, recommended_action, expected_value, recoverability_score FROM dtable
ORDER BY recommended_action, expected_value DESC NULLS LAST, recoverability_score DESC NULLS LAST, transaction_id""")),
          ops=("D14", "W8"))
def q_recovery_worklist(spark, sf):
    d = decisions(spark, sf)
    return round_doubles(d.select("transaction_id", "recommended_action", "expected_value", "recoverability_score")
                         .orderBy("recommended_action", F.col("expected_value").desc_nulls_last(),
                                  F.col("recoverability_score").desc_nulls_last(), "transaction_id"))


@register("three_way_actions", sql_round(["ev", "nv_weighted"], dsql(f"""
SELECT transaction_id, ev, nv_weighted,
       CASE WHEN ev > 0.5 THEN 'retry' WHEN ev < -0.1 THEN 'abandon' ELSE 'cascade' END AS action,
       CASE WHEN ev > 0.5 OR ev < -0.1 THEN NULL ELSE (
         SELECT processor_name FROM (
           SELECT processor_name, count(*) FILTER (WHERE auth_status = 'APPROVED') / count(*) AS rate
           FROM originals GROUP BY processor_name) AS pr
         ORDER BY rate DESC, processor_name LIMIT 1) END AS cascade_target
FROM (SELECT transaction_id,
             probability * coalesce(amount_usd, {dbl(0.0)}) * {dbl(C.DEFAULT_MARGIN_RATE)}
               - {dbl(C.DEFAULT_RETRY_COST_USD)} - {dbl(C.DEFAULT_FRICTION_COST_USD)} AS ev,
             probability * coalesce(amount_usd, {dbl(0.0)}) * {dbl(C.DEFAULT_MARGIN_RATE)}
               - ({dbl(1.0)} - probability) * ({dbl(C.DEFAULT_RETRY_COST_USD)} + {dbl(C.DEFAULT_FRICTION_COST_USD)})
               AS nv_weighted FROM scored) AS s""")),
          ops=("D12", "D3", "D3b"))
def q_three_way_actions(spark, sf):
    s = split_modeling(spark, sf).withColumns({
        "ev": D.expected_value("probability", "amount_usd"),
        "nv_weighted": D.net_value_failure_weighted("probability", "amount_usd")})
    o = fx.originals(spark, sf)
    best = (o.groupBy("processor_name").agg((F.count_if(F.col("auth_status") == "APPROVED") / F.count(F.lit(1)))
                                            .alias("rate"))
            .orderBy(F.col("rate").desc(), "processor_name").limit(1).collect())
    # one processor name (top-1 of a per-processor table) becomes a literal
    target = F.lit(best[0]["processor_name"] if best else None).cast("string")
    a = D.three_way_action("ev")
    return round_doubles(s.select("transaction_id", "ev", "nv_weighted", a.alias("action"),
                                  F.when(a == "cascade", target).alias("cascade_target")))


# Days after which a decline's outcome is known: the last retry delay of the grid.
OUTCOME_DAYS = int(C.DELAY_GRID_HOURS[-1] // 24)


def _cascade_ctes() -> list[tuple[str, str]]:
    """Running counts per level, traits, provider and day, joined to the days that are asked."""
    key = [", ".join(f"coalesce('=' || {c}, '-')" for c in cols) or "''" for cols in CA.LEVELS]
    each = lambda body: " UNION ALL ".join(body.format(level=i, key=f"concat_ws(chr(1), {k})") for i, k in enumerate(key))
    return [
        ("asked", "SELECT DISTINCT CAST(ts AS DATE) AS day, merchant_country, merchant_vertical, response_code, processor_name FROM scored"),
        ("cells", each(f"SELECT {{level}} AS level, {{key}} AS key, processor_name AS provider, CAST(ts AS DATE) + {OUTCOME_DAYS} AS known, "
                       "count(*) AS n, count(*) FILTER (WHERE target_recovered_by_retry) AS ok FROM scored "
                       "WHERE processor_name IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")),
        ("days", each("SELECT DISTINCT {level} AS level, {key} AS key, day FROM asked")),
        ("rates", """
SELECT d.level, d.key, d.day, c.provider, CAST(sum(c.n) AS BIGINT) AS n, sum(c.ok) / sum(c.n) AS rate
FROM days d JOIN cells c ON c.level = d.level AND c.key = d.key AND c.known < d.day
GROUP BY ALL HAVING sum(c.n) >= """ + str(CA.MIN_SUPPORT)),
        ("keyed", each("SELECT *, {level} AS level, {key} AS key FROM asked")),
        ("choice", """
SELECT * FROM (SELECT k.*, r.provider, r.rate, r.n, row_number() OVER (
                 PARTITION BY k.day, k.merchant_country, k.merchant_vertical, k.response_code, k.processor_name
                 ORDER BY k.level, r.rate DESC, r.provider) AS place
               FROM keyed k JOIN rates r ON r.level = k.level AND r.key = k.key AND r.day = k.day
               WHERE r.provider IS DISTINCT FROM k.processor_name) AS z WHERE place = 1"""),
    ]


@register("cascade_targets", sql_round(["ev", "cascade_rate"], split_sql(f"""
SELECT s.transaction_id, s.ev, CASE WHEN ev > 0.5 THEN 'retry' WHEN ev < -0.1 THEN 'abandon' ELSE 'cascade' END AS action,
       CASE WHEN ev > 0.5 OR ev < -0.1 THEN NULL ELSE c.provider END AS cascade_target,
       c.provider AS best_other_provider, CAST(c.level AS INTEGER) AS cascade_level, c.rate AS cascade_rate, c.n AS cascade_support
FROM (SELECT *, {ev_sql("probability")} AS ev FROM scored) AS s
LEFT JOIN choice c ON c.day = CAST(s.ts AS DATE) AND c.merchant_country IS NOT DISTINCT FROM s.merchant_country
  AND c.merchant_vertical IS NOT DISTINCT FROM s.merchant_vertical AND c.response_code IS NOT DISTINCT FROM s.response_code
  AND c.processor_name IS NOT DISTINCT FROM s.processor_name""", _cascade_ctes())), ops=("D12", "D3"))
def q_cascade_targets(spark, sf):
    s = split_modeling(spark, sf).withColumns({"ev": D.expected_value("probability", "amount_usd"), "__day": F.to_date("timestamp")})
    known = s.withColumn("__known", F.date_add("__day", OUTCOME_DAYS))
    t = CA.cascade_targets(s, known, "processor_name", "__day", "__known", "target_recovered_by_retry")
    a = D.three_way_action("ev")
    return round_doubles(t.select("transaction_id", "ev", a.alias("action"), F.when(a == "cascade", F.col("cascade_provider")).alias("cascade_target"),
                                  F.col("cascade_provider").alias("best_other_provider"), "cascade_level", "cascade_rate", "cascade_support"))
