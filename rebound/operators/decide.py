"""Decision layer (D1-D16, G11, G12): probabilities -> retry decisions -> dollars.

Everything is a column expression or a small grouped aggregate; the per-row
economics are columns, so every row may carry its own overrides (A9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebound import config as C
from rebound.functions.parse import normalize_code, strip_ws, to_double
from rebound.operators.metrics import scored

RETRY = "retry"
DO_NOT_RETRY = "do_not_retry"
OUT_OF_SCOPE = "out_of_scope"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


#: A side table is broadcast up to so many rows (counted, not estimated).
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- D1
def rule_probability(is_soft="is_soft_decline", amount="amount_usd", code="response_code") -> Column:
    """Rule-baseline recovery probability.

    soft .30 / hard .01; soft and amount > 150 adds .08; code 91 adds .10,
    code 51 adds .05; codes 54/62/14 are set to 0 last; clipped to [0, .95].
    """
    soft = F.coalesce(_c(is_soft).cast("boolean"), F.lit(False))
    amt = F.coalesce(to_double(amount), F.lit(0.0))
    cd = F.coalesce(_c(code).cast("string"), F.lit(""))
    p = F.when(soft, F.lit(C.RULE_SOFT_BASE)).otherwise(F.lit(C.RULE_HARD_BASE))
    p = p + F.when(soft & (amt > C.RULE_SOFT_LARGE_AMOUNT), F.lit(C.RULE_SOFT_LARGE_BONUS)).otherwise(F.lit(0.0))
    for k, bonus in C.RULE_CODE_BONUS.items():
        p = p + F.when(cd == k, F.lit(bonus)).otherwise(F.lit(0.0))
    p = F.when(cd.isin(*C.RULE_ZERO_CODES), F.lit(0.0)).otherwise(p)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(C.RULE_CLIP_MAX))


# ---------------------------------------------------------------- D2
def resolve_margin(vertical=None, override=None, margins: dict | None = None) -> Column:
    """Per-row margin: explicit override, else vertical margin, else default."""
    margins = C.VERTICAL_MARGIN_RATES if margins is None else margins
    by_vertical = None
    if vertical is not None:
        v = _c(vertical)
        for k, m in margins.items():
            by_vertical = F.when(v == k, F.lit(m)) if by_vertical is None else by_vertical.when(v == k, F.lit(m))
    candidates = []
    if override is not None:
        candidates.append(to_double(override))
    if by_vertical is not None:
        candidates.append(by_vertical)
    candidates.append(F.lit(C.DEFAULT_MARGIN_RATE))
    return F.coalesce(*candidates)


def resolve_economics(df: DataFrame, economics: C.Economics | None = None,
                      vertical_col: str | None = None, overrides: dict | None = None) -> DataFrame:
    """Attach margin_rate, retry_cost_usd, friction_cost_usd,
    decision_threshold, min_retry_ev_usd columns (row override > run config >
    vertical margin > platform default)."""
    e = economics or C.Economics()
    ov = overrides or {}
    margin = resolve_margin(vertical_col, ov.get("margin_rate"), e.vertical_margins)
    if e.margin_rate is not None:
        margin = F.coalesce(to_double(ov["margin_rate"]) if "margin_rate" in ov else F.lit(None).cast("double"),
                            F.lit(e.margin_rate))

    def pick(name, default):
        return F.coalesce(to_double(ov[name]), F.lit(default)) if name in ov else F.lit(default)

    return df.withColumns({
        "margin_rate": margin,
        "retry_cost_usd": pick("retry_cost_usd", e.retry_cost_usd),
        "friction_cost_usd": pick("friction_cost_usd", e.friction_cost_usd),
        "decision_threshold": pick("decision_threshold", e.decision_threshold),
        "min_retry_ev_usd": pick("min_retry_ev_usd", e.min_retry_ev_usd),
    })


# ---------------------------------------------------------------- D3 / D3b
def expected_value(prob, amount, margin=C.DEFAULT_MARGIN_RATE, retry_cost=C.DEFAULT_RETRY_COST_USD,
                   friction=C.DEFAULT_FRICTION_COST_USD) -> Column:
    """D3: p * amount * margin - retry_cost - friction (amount NULL -> 0)."""
    amt = F.coalesce(to_double(amount), F.lit(0.0))
    return _c(prob) * amt * _lit(margin) - _lit(retry_cost) - _lit(friction)


def net_value_failure_weighted(prob, amount, margin=C.DEFAULT_MARGIN_RATE,
                               retry_cost=C.DEFAULT_RETRY_COST_USD,
                               friction=C.DEFAULT_FRICTION_COST_USD) -> Column:
    """P * amount * margin - (1 - p) * (retry_cost + friction)."""
    amt = F.coalesce(to_double(amount), F.lit(0.0))
    p = _c(prob)
    return p * amt * _lit(margin) - (F.lit(1.0) - p) * (_lit(retry_cost) + _lit(friction))


# ---------------------------------------------------------------- D4
def basic_action(prob, ev, threshold=C.OFFLINE_POLICY_THRESHOLD) -> Column:
    """Retry iff p >= threshold and EV > 0."""
    return F.when((_c(prob) >= _lit(threshold)) & (_c(ev) > 0), F.lit(RETRY)).otherwise(F.lit(DO_NOT_RETRY))


def score_policy(df: DataFrame, prob_col: str, policy: str, threshold=C.OFFLINE_POLICY_THRESHOLD,
                 amount_col: str = "amount_usd", economics: C.Economics | None = None) -> DataFrame:
    """Attach probability, EV and decision of one policy as generic columns."""
    e = economics or C.Economics(margin_rate=C.DEFAULT_MARGIN_RATE)
    margin = C.DEFAULT_MARGIN_RATE if e.margin_rate is None else e.margin_rate
    ev = expected_value(F.col(prob_col), F.col(amount_col), margin, e.retry_cost_usd, e.friction_cost_usd)
    return df.withColumns({
        "policy": F.lit(policy),
        "probability": F.col(prob_col),
        "expected_value_usd": ev,
        "decision": basic_action(F.col(prob_col), ev, threshold),
    })


# ---------------------------------------------------------------- G11
POLICY_SUMMARY_COLUMNS = [
    "policy", "rows", "retry_count", "retry_rate", "recovered_count", "recovered_rate",
    "recovered_volume_usd", "gross_margin_recovered_usd", "wasted_retry_count",
    "wasted_retry_cost_usd", "friction_cost_usd", "realized_net_value_usd",
    "average_retry_probability",
]


def policy_summary(scored: DataFrame, target_col: str = "target_recovered_by_retry",
                   amount_col: str = "amount_usd", group_cols: Sequence[str] = ("policy",),
                   margin=C.DEFAULT_MARGIN_RATE, retry_cost=C.DEFAULT_RETRY_COST_USD,
                   friction=C.DEFAULT_FRICTION_COST_USD) -> DataFrame:
    """12 measures per policy in one grouped pass (policies stacked as rows).

    Realised value counts the retry cost only for failed retries (T17), unlike
    the EV used to decide.
    """
    y = F.coalesce(F.col(target_col).cast("boolean"), F.lit(False))
    amt = F.coalesce(to_double(amount_col), F.lit(0.0))
    retry = F.col("decision") == RETRY
    hit = retry & y
    waste = retry & ~y
    agg = (scored.groupBy(*group_cols)
           .agg(F.count(F.lit(1)).alias("rows"),
                F.count_if(retry).alias("retry_count"),
                F.count_if(hit).alias("recovered_count"),
                F.count_if(waste).alias("wasted_retry_count"),
                F.sum(F.when(hit, amt).otherwise(F.lit(0.0))).alias("recovered_volume_usd"),
                F.sum(F.when(hit, amt * _lit(margin)).otherwise(F.lit(0.0))).alias("gross_margin_recovered_usd"),
                F.avg(F.when(retry, F.col("probability"))).alias("__avg_p")))
    return agg.select(
        *group_cols, "rows", "retry_count",
        (F.col("retry_count") / F.col("rows")).alias("retry_rate"),
        "recovered_count",
        (F.col("recovered_count") / F.col("rows")).alias("recovered_rate"),
        "recovered_volume_usd", "gross_margin_recovered_usd", "wasted_retry_count",
        (F.col("wasted_retry_count") * _lit(retry_cost)).alias("wasted_retry_cost_usd"),
        (F.col("retry_count") * _lit(friction)).alias("friction_cost_usd"),
        (F.col("gross_margin_recovered_usd") - F.col("wasted_retry_count") * _lit(retry_cost)
         - F.col("retry_count") * _lit(friction)).alias("realized_net_value_usd"),
        F.coalesce(F.col("__avg_p"), F.lit(0.0)).alias("average_retry_probability"),
    )


# ---------------------------------------------------------------- D6 / D7
def scope_reason(code="response_code", country="merchant_country", vertical="merchant_vertical",
                 processor="processor_name", amount="amount_usd", amount_cap=C.AMOUNT_CAP_USD,
                 supported_codes=None, hard_codes=None, countries=None, verticals=None,
                 processors=None) -> Column:
    """First failing guard, in order: unknown code, hard decline, country,
    vertical, processor, amount above the cap; NULL when the row is in scope.

    Vocabularies are literal lists (``isin``) or boolean columns already
    computed by a join against a vocabulary table (see ``vocabulary_flags``).
    Country is compared case-insensitively, vertical and processor exactly;
    a missing / blank categorical passes (the model handles MISSING).
    """
    hard_codes = C.HARD_DECLINE_CODES if hard_codes is None else hard_codes
    supported_codes = (C.HARD_DECLINE_CODES + C.SOFT_DECLINE_CODES) if supported_codes is None else supported_codes
    cd = normalize_code(F.col(code) if isinstance(code, str) else code)

    def off(col, vocab, upper: bool):
        if vocab is None:
            return F.lit(False)
        v = strip_ws(F.col(col).cast("string"))
        given = v.isNotNull() & (v != "")
        if isinstance(vocab, Column):
            return given & ~F.coalesce(vocab, F.lit(False))
        vals = [x.upper() for x in vocab] if upper else list(vocab)
        return given & ~(F.upper(v) if upper else v).isin(*vals)

    amt = to_double(amount)
    return (F.when(cd.isNull() | ~cd.isin(*supported_codes), F.lit("response_code"))
            .when(cd.isin(*hard_codes), F.lit("hard_decline"))
            .when(off(country, countries, True), F.lit("merchant_country"))
            .when(off(vertical, verticals, False), F.lit("merchant_vertical"))
            .when(off(processor, processors, False), F.lit("processor_name"))
            .when(amt.isNotNull() & (amt > F.lit(amount_cap)), F.lit("amount")))


def vocabulary_flags(df: DataFrame, vocab: DataFrame, fields: dict[str, str]) -> DataFrame:
    """J8 for table vocabularies: one ``__in_<col>`` flag per field from a
    left join with the (feature, value) vocabulary table, broadcast when its
    counted size allows, so that the scored rows stay where they are."""
    out = df
    hinted = vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for col, feature in fields.items():
        v = (vocab.where(F.col("feature") == feature).select(F.col("value").alias(f"__vv_{col}")).distinct()
             .withColumn(f"__in_{col}", F.lit(True)))
        v = F.broadcast(v) if hinted else v
        key = strip_ws(F.col(col).cast("string"))
        if feature == "merchant_country":
            v = v.withColumn(f"__vv_{col}", F.upper(f"__vv_{col}")).distinct()
            v = F.broadcast(v) if hinted else v
            key = F.upper(key)
        out = out.withColumn(f"__k_{col}", key).join(v, F.col(f"__k_{col}") == F.col(f"__vv_{col}"), "left") \
            .drop(f"__k_{col}", f"__vv_{col}")
    return out


def out_of_scope_text(reason: Column, vocab: dict, code="response_code", amount="amount_usd",
                      amount_cap=C.AMOUNT_CAP_USD) -> Column:
    """Why a row is out of scope, in words; NULL for rows in scope and hard declines.
    A literal vocabulary is listed, a learned one (a flag column) is only named."""
    shown = F.coalesce(normalize_code(F.col(code)), F.lit("<empty>"))
    out = F.when(reason == "response_code", F.format_string(C.OUT_OF_SCOPE_CODE, shown))
    for field, known in vocab.items():
        text = F.format_string(C.OUT_OF_SCOPE_CATEGORY, F.lit(field), strip_ws(F.col(field).cast("string")))
        if isinstance(known, (list, tuple)):
            text = F.concat(text, F.lit(f" {sorted(known)}"))
        out = out.when(reason == field, text)
    return out.when(reason == "amount", F.format_string(C.OUT_OF_SCOPE_AMOUNT, _fr(to_double(amount), 2), F.lit(float(amount_cap))))


def hard_decline_reason(code="response_code") -> Column:
    """Reason text of a hard-decline code."""
    cd = normalize_code(F.col(code) if isinstance(code, str) else code)
    m = F.create_map(*[x for k, v in C.HARD_DECLINE_REASONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, cd), F.lit(C.HARD_DECLINE_DEFAULT_REASON))


# ---------------------------------------------------------------- D8 timing table
def delay_bucket(hours, grid: Sequence[float] = tuple(C.DELAY_GRID_HOURS)) -> Column:
    """A retry observed after ``hours`` counts for the largest grid delay <= hours
    (the first grid point below it)."""
    h = F.col(hours) if isinstance(hours, str) else hours
    b = F.lit(float(grid[0]))
    for d in grid[1:]:
        b = F.when(h >= F.lit(float(d)), F.lit(float(d))).otherwise(b)
    return b


def fit_timing_table(retries: DataFrame, decline_codes: DataFrame, code_col: str = "response_code",
                     link: str = "original_transaction_id", id_col: str = "transaction_id",
                     attempt: str = "retry_attempt_num", hours: str = "hours_since_original",
                     status: str = "auth_status", smoothing: float = C.TARGET_ENCODING_SMOOTHING,
                     grid: Sequence[float] = tuple(C.DELAY_GRID_HOURS), weight: str | None = None) -> DataFrame:
    """D8 (re-derived timing model): smoothed success rate of retries by
    (decline code, attempt number, delay bucket), shrunk towards the code's
    overall retry success rate.  One row per (code, attempt) holding the
    10-point probability array, so scoring is a join plus array arithmetic.
    ``weight`` names a row-count column when the retries are pre-aggregated.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    r = (retries.join(decline_codes.select(F.col(id_col).alias("__id"), F.col(code_col).alias("__code")),
                      F.col(link) == F.col("__id"))
         .select("__code", F.col(attempt).alias("__att"), delay_bucket(hours, grid).alias("__d"),
                 w.alias("__w"), (F.col(status) == "APPROVED").cast("bigint").alias("__ok")))
    r = r.withColumn("__okw", F.col("__ok") * F.col("__w"))
    # codes x attempts x 10 rows; the code's own rate is a window over them
    cells = r.groupBy("__code", "__att", "__d").agg(F.sum("__w").alias("__n"), F.sum("__okw").alias("__k"))
    code = Window.partitionBy("__code")
    cells = cells.withColumns({"__m": F.col("__k") / F.col("__n"),
                               "__prior": F.sum("__k").over(code) / F.sum("__n").over(code)})
    s = F.lit(float(smoothing))
    cells = cells.withColumn(
        "__p", (F.col("__m") * F.col("__n") + F.col("__prior") * s) / (F.col("__n") + s))
    per = cells.groupBy("__code", "__att", "__prior").agg(
        F.map_from_entries(F.collect_list(F.struct("__d", "__p"))).alias("__m"))
    grid_arr = F.array(*[F.lit(float(d)) for d in grid])
    return per.select(F.col("__code").alias("timing_code"), F.col("__att").alias("timing_attempt"),
                      F.col("__prior").alias("code_prior"),
                      F.transform(grid_arr, lambda d: F.coalesce(F.element_at(F.col("__m"), d),
                                                                 F.col("__prior"))).alias("delay_probs"))


def delay_curve(df: DataFrame, timing: DataFrame, code: str = "response_code", attempt=1,
                amount: str = "amount_usd", fallback=None,
                grid: Sequence[float] = tuple(C.DELAY_GRID_HOURS)) -> DataFrame:
    """Attach ``delay_curve`` = array<struct<delay_hours, success_probability,
    expected_value>> (p rounded to 6, EV to 4) from the timing table; needs the
    economics columns of :func:`resolve_economics`.  Codes/attempts without a
    timing row use ``fallback`` (a probability column, default the row score)."""
    att = F.col(attempt) if isinstance(attempt, str) else F.lit(attempt)
    t = timing.withColumn("__tc", normalize_code(F.col("timing_code"))).withColumnRenamed("timing_attempt", "__ta").drop("timing_code")
    j = df.join(small(t), (normalize_code(F.col(code)) == F.col("__tc")) & (att == F.col("__ta")), "left")
    amt = F.coalesce(to_double(amount), F.lit(0.0))
    fb = fallback if fallback is not None else F.lit(None).cast("double")
    grid_arr = F.array(*[F.lit(float(d)) for d in grid])
    pts = F.transform(grid_arr, lambda d, i: F.struct(
        d.alias("delay_hours"),
        F.coalesce(F.element_at(F.col("delay_probs"), i + 1), fb).alias("p")))
    curve = F.transform(pts, lambda s: F.struct(
        s["delay_hours"].alias("delay_hours"),
        _fr(s["p"], 6).alias("success_probability"),
        _fr(s["p"] * amt * F.col("margin_rate") - F.col("retry_cost_usd") - F.col("friction_cost_usd"), 4)
        .alias("expected_value")))
    return j.withColumn("delay_curve", curve).drop("__tc", "__ta", "code_prior", "delay_probs")


def best_delay(curve_col: str = "delay_curve") -> Column:
    """Point with the highest (rounded) EV; the shortest delay wins ties
    (the grid is ascending and only a strictly larger EV replaces the best)."""
    c = F.col(curve_col)
    return F.aggregate(F.slice(c, 2, F.size(c)), F.element_at(c, 1),
                       lambda best, x: F.when(x["expected_value"] > best["expected_value"], x).otherwise(best))


def confidence(prob, threshold) -> Column:
    """round(min(1, |p - t| / 0.5), 4); NULL without a score or threshold."""
    p = scored(prob)
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return F.when(p.isNotNull() & t.isNotNull(), _fr(F.least(F.lit(1.0), F.abs(p - t) / F.lit(C.CONFIDENCE_SCALE)), 4))


def _fr(c: Column, digits: int) -> Column:
    s = 10.0 ** digits
    return F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s)


SERVED_VOCABULARY = {"merchant_country": C.SUPPORTED_MERCHANT_COUNTRIES,
                     "merchant_vertical": C.SUPPORTED_MERCHANT_VERTICALS, "processor_name": C.SUPPORTED_PROCESSORS}


def decision_table(df: DataFrame, score_col: str, timing: DataFrame, attempt=1,
                   economics: C.Economics | None = None, amount_cap: float = C.AMOUNT_CAP_USD,
                   vocab: dict | None = None, id_col: str = "transaction_id",
                   model_version: str = C.MODEL_VERSION, policy_version: str = C.POLICY_VERSION) -> DataFrame:
    """The full decision per row (D6 -> D2 -> D3 -> D8 -> D9 -> D10 -> D11).

    ``vocab`` maps field -> literal list or flag column name for the scope guard;
    without it the served model's fixed lists apply.
    ``score_col`` is the recoverability score to use (raw or calibrated, T27).
    Amounts are back-filled before deciding (T11 fix).  Without a score (NULL,
    NaN) confidence and score are NULL and the reason says so; the row is
    retried only if the timing table alone supports it.
    """
    vocab = SERVED_VOCABULARY if vocab is None else vocab
    e = resolve_economics(df, economics, vertical_col="merchant_vertical")
    v = {k: (F.col(x) if isinstance(x, str) else x) for k, x in vocab.items()}
    # a literal list arrives as a list; a flag column name as a str
    reason = scope_reason(amount_cap=amount_cap, countries=v.get("merchant_country"),
                          verticals=v.get("merchant_vertical"), processors=v.get("processor_name"))
    e = e.withColumn("scope_reason", reason)
    p = scored(score_col)
    amt = F.coalesce(to_double("amount_usd"), F.lit(0.0))
    ev = p * amt * F.col("margin_rate") - F.col("retry_cost_usd") - F.col("friction_cost_usd")
    e = delay_curve(e.withColumn("__ev", ev), timing, attempt=attempt, fallback=p)
    best = best_delay()
    ran = F.col("scope_reason").isNull()
    hard = F.col("scope_reason") == "hard_decline"
    ev_ok = F.col("__best.expected_value") >= F.col("min_retry_ev_usd")
    p_ok = F.col("__best.success_probability") >= F.col("decision_threshold")
    action = (F.when(hard, F.lit(DO_NOT_RETRY)).when(~ran, F.lit(OUT_OF_SCOPE))
              .when(ev_ok & p_ok, F.lit(RETRY)).otherwise(F.lit(DO_NOT_RETRY)))
    att = F.col(attempt).cast("string") if isinstance(attempt, str) else F.lit(str(attempt))
    parts = F.array_compact(F.array(
        F.when(p.isNull(), F.lit(C.SCORE_MISSING)),
        F.when(~p_ok, F.format_string(C.BELOW_THRESHOLD, _fr(F.col("__best.success_probability"), 3),
                                      _fr(F.col("decision_threshold"), 2))),
        F.when(~ev_ok, F.format_string(C.BELOW_MIN_EV, _fr(F.col("__best.expected_value"), 2),
                                       _fr(F.col("min_retry_ev_usd"), 2)))))
    why = F.concat(F.lit("Attempt "), att, F.lit(": "), F.array_join(parts, "; "), F.lit(C.ATTEMPT_STOP))
    e = e.withColumn("__best", best).withColumn("recommended_action", action)
    is_retry = F.col("recommended_action") == RETRY
    return e.select(
        id_col, "recommended_action", "scope_reason",
        out_of_scope_text(F.col("scope_reason"), vocab, amount_cap=amount_cap).alias("out_of_scope_reason"),
        F.lit(model_version).alias("model_version"), F.lit(policy_version).alias("policy_version"),
        F.col("decision_threshold").alias("decision_threshold_used"),
        F.when(hard, hard_decline_reason()).alias("hard_decline_reason"),
        F.when(hard, F.lit(0.0)).when(ran, _fr(p, 6)).alias("recoverability_score"),
        F.when(hard, F.lit(0.0)).when(is_retry, _fr(F.col("__ev"), 4)).alias("expected_value"),
        F.when(ran, confidence(p, F.col("decision_threshold"))).alias("confidence"),
        "margin_rate", "decision_threshold",
        F.when(is_retry, F.col("__best.delay_hours")).alias("recommended_delay_hours"),
        F.when(is_retry, F.col("__best.success_probability")).alias("recommended_delay_probability"),
        F.when(is_retry, F.col("__best.expected_value")).alias("recommended_delay_expected_value"),
        F.when(ran & ~is_retry, why).alias("attempt_decision_reason"),
        F.when(ran, F.col("delay_curve")).otherwise(F.array().cast(
            "array<struct<delay_hours:double,success_probability:double,expected_value:double>>"))
        .alias("delay_curve"))


# ---------------------------------------------------------------- D12
def three_way_action(ev, retry_above: float = 0.50, abandon_below: float = -0.10) -> Column:
    """Retry when EV > 0.50, abandon when EV < -0.10, else cascade."""
    e = F.col(ev) if isinstance(ev, str) else ev
    return (F.when(e > retry_above, F.lit("retry")).when(e < abandon_below, F.lit("abandon"))
            .otherwise(F.lit("cascade")))


# ---------------------------------------------------------------- D16
def cohort_fallback(df: DataFrame, segment_col: str, model_auc: DataFrame, rules_auc: DataFrame,
                    model_score: str, rules_score: str, out: str = "policy_score") -> DataFrame:
    """Use the rules score in segments where the model's AUC is below the
    rules' AUC (per-segment metric tables are one row per segment)."""
    m = model_auc.select(F.col("segment_value").alias("__seg"), F.col("auc").alias("__m_auc"))
    r = rules_auc.select(F.col("segment_value").alias("__seg2"), F.col("auc").alias("__r_auc"))
    j = (df.join(m, F.col(segment_col) == F.col("__seg"), "left")
         .join(r, F.col(segment_col) == F.col("__seg2"), "left"))
    use_rules = F.coalesce(F.col("__m_auc") < F.col("__r_auc"), F.lit(False))
    return j.withColumn(out, F.when(use_rules, F.col(rules_score)).otherwise(F.col(model_score))) \
        .withColumn("used_rules", use_rules).drop("__seg", "__seg2", "__m_auc", "__r_auc")


# ---------------------------------------------------------------- G12
def batch_summary(scored: DataFrame, decision: str = "recommended_action", ev: str = "expected_value",
                  target: str = "target_recovered_by_retry") -> DataFrame:
    """Retry / skip counts, EV of recommended retries, hindsight recoveries."""
    r = F.col(decision) == RETRY
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(r).alias("retry_count"),
        F.count_if(F.col(decision) == DO_NOT_RETRY).alias("do_not_retry_count"),
        F.count_if(F.col(decision) == OUT_OF_SCOPE).alias("out_of_scope_count"),
        F.coalesce(F.sum(F.when(r, F.col(ev).cast("decimal(20,4)"))), F.lit(0)).cast("double")
        .alias("retry_expected_value_usd"),
        F.count_if(r & F.coalesce(F.col(target), F.lit(False))).alias("hindsight_recoveries"))
