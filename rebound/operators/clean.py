"""Cleaning and validation of raw rows.

All operators are one ``select`` (or one aggregate for inference) over the
input: no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebound.functions.parse import fee_bps, parse_bool_strict, strip_ws, time_features, to_double

# FIXED VALUES: feature field <- transaction field (first non-blank source wins).
FIELD_MAP = [
    ("amount", ["amount"]),
    ("amount_usd", ["amount_usd"]),
    ("currency", ["currency"]),
    ("merchant_vertical", ["merchant_vertical"]),
    ("merchant_mcc", ["merchant_mcc"]),
    ("merchant_country", ["merchant_country"]),
    ("archetype", ["merchant_tier", "industry"]),
    ("processor_name", ["processor"]),
    ("routing_reason", ["routing_strategy"]),
    ("card_brand", ["card_brand"]),
    ("card_type", ["card_funding_type"]),
    ("card_country", ["card_country"]),
    ("card_funding_source", ["card_funding_type"]),
    ("token_type", ["token_type"]),
    ("present_mode", ["presence_mode"]),
    ("response_code", ["response_code"]),
    ("response_message", ["response_message"]),
    ("scheme_response_code", ["provider_response_code", "response_code"]),
    ("three_ds_version", ["three_ds_version"]),
    ("three_ds_flow", ["authentication_flow"]),
    ("three_ds_eci", ["eci"]),
    ("sca_exemption", ["sca_exemption"]),
    ("latency_ms", ["processing_time_ms"]),
    ("latency_auth_ms", ["provider_latency_ms"]),
    ("fx_rate", ["fx_rate"]),
    ("settlement_currency", ["settlement_currency"]),
    ("risk_score", ["risk_score"]),
    ("risk_model_version", ["risk_provider"]),
    ("billing_country", ["customer_country"]),
    ("shipping_country", ["customer_country"]),
    ("ip_country", ["customer_ip_country"]),
    ("issuer_country", ["card_country"]),
    ("payment_method", ["payment_method_type"]),
    ("wallet_type", ["wallet_provider"]),
    ("entry_mode", ["channel"]),
    ("pan_entry_mode", ["presence_mode"]),
    ("cardholder_verification_method", ["authentication_flow"]),
    ("cvv_result", ["cvv_result"]),
    ("avs_result", ["avs_result"]),
    ("payment_method_details", ["payment_method_subtype"]),
    ("issuer_bank_country", ["card_country"]),
    ("card_product_type", ["card_category"]),
    ("card_category", ["card_category"]),
    ("card_commercial_type", ["card_category"]),
    ("user_agent_family", ["device_type"]),
    ("device_os", ["channel"]),
    ("issuer_size", ["issuer_parent_group"]),
    ("mastercard_advice_code", ["merchant_advice_code"]),
    ("scheme_ms", ["provider_latency_ms"]),
    ("transaction_type", ["transaction_type"]),
    ("fx_bps", ["fx_spread_pct"]),
    ("routed_network", ["card_brand"]),
]

# FIXED VALUES: boolean feature <- transaction flag (true/1/yes/y, false/0/no/n).
BOOL_MAP = [
    ("is_cross_border", "is_cross_border"),
    ("is_token", "is_tokenized"),
    ("fraud_flag", "is_fraud"),
    ("timeout_flag", "is_outage"),
    ("account_updater_used", "account_updater_triggered"),
    ("routing_optimized", "smart_routing"),
    ("mcc_routing_optimized", "smart_routing"),
    ("smart_routed", "smart_routing"),
]


def _src(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    s = _src(df, name).cast("string")
    return F.when(strip_ws(s) == "", F.lit(None)).otherwise(s)


def map_transaction(df: DataFrame, keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """P10: one transaction row -> the scoring feature schema (a single select).

    Missing source fields give NULL; NULL means "not provided" (T18 fix: a
    missing text is never read as true).
    """
    out = [_src(df, k).alias(k) for k in keep if k in df.columns]
    for target, sources in FIELD_MAP:
        cand = [_src(df, s) for s in sources]
        cand = [F.when(strip_ws(c.cast("string")) == "", F.lit(None)).otherwise(c) for c in cand]
        out.append((F.coalesce(*cand) if len(cand) > 1 else cand[0]).alias(target))
    for target, source in BOOL_MAP:
        out.append(parse_bool_strict(_src(df, source)).alias(target))
    bucket = F.lower(F.coalesce(_text(df, "decline_category"), F.lit("unknown")))
    frictionless = F.coalesce(parse_bool_strict(_src(df, "three_ds_frictionless")), F.lit(False))
    rate = to_double(_src(df, "fx_rate"))
    token = F.lower(F.coalesce(strip_ws(_src(df, "token_type").cast("string")), F.lit("")))
    avs = F.upper(F.coalesce(strip_ws(_src(df, "avs_result").cast("string")), F.lit("")))
    risk = F.lower(F.coalesce(strip_ws(_src(df, "risk_decision").cast("string")), F.lit("")))
    out += [
        bucket.alias("decline_bucket"),
        (bucket == "soft").alias("is_soft_decline"),
        (F.coalesce(strip_ws(_src(df, "three_ds_version").cast("string")), F.lit("")) != "")
        .alias("three_ds_requested"),
        F.coalesce(_text(df, "three_ds_status"),
                   F.when(frictionless, F.lit("authenticated")).otherwise(F.lit("not_requested")))
        .alias("three_ds_outcome"),
        F.lit(0).alias("latency_3ds_ms"),
        fee_bps(_src(df, "processing_fee_usd"), _src(df, "amount_usd")).alias("processor_fee_bps"),
        fee_bps(_src(df, "interchange_fee_usd"), _src(df, "amount_usd")).alias("interchange_estimate_bps"),
        fee_bps(_src(df, "scheme_fee_usd"), _src(df, "amount_usd")).alias("scheme_fee_bps"),
        (rate.isNotNull() & (rate != 1.0)).alias("fx_applied"),
        (token == "network_token").alias("network_token_present"),
        avs.isin("Y", "Z").alias("avs_zip_match"),
        avs.isin("Y", "A").alias("avs_street_match"),
        (risk == "approve").alias("risk_skip_flag"),
    ]
    ts = F.try_to_timestamp(_src(df, "created_at").cast("string"))  # a malformed time is missing, not an error
    feats = time_features(ts)
    out += [F.when(ts.isNotNull(), c).alias(n) for n, c in feats.items()]
    return df.select(*out)


# ---------------------------------------------------------------- P15 / P16
def unknown_fields(json_col: Column, allowed: Sequence[str]) -> Column:
    """Keys of a JSON object that are not allow-listed (NULL when not an object)."""
    return F.array_except(F.json_object_keys(json_col), F.array(*[F.lit(a) for a in allowed]))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks (each rule is a 'broken' condition)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))


def amount_rule(col: Column) -> Column:
    """Amount must be a finite number > 0 and not a boolean / blank / text."""
    s = col.cast("string")
    d = s.try_cast("double")
    is_bool = F.lower(strip_ws(s)).isin("true", "false")
    return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))) | (d <= 0) | is_bool


def range_rule(col: Column, lo: float, hi: float) -> Column:
    """Config bounds: present values must be finite and inside [lo, hi]."""
    d = col.cast("string").try_cast("double")
    return col.isNotNull() & (d.isNull() | F.isnan(d) | (d < lo) | (d > hi))


# ---------------------------------------------------------------- P2 / P3
def infer_text_schema(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P2 + P3 on all-text input (a CSV read without inference): a column is
    boolean when every non-NULL lower-cased value is true/false, numeric when
    every non-NULL value parses as a double, else string; one aggregate job."""
    spark = df.sparkSession
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        s = F.col(f"`{c}`").cast("string")
        aggs += [F.count(s).alias(f"n__{c}"),
                 F.count_if(s.isNotNull() & ~F.lower(s).isin("true", "false")).alias(f"nb__{c}"),
                 F.count_if(s.isNotNull() & s.try_cast("double").isNull()).alias(f"nn__{c}")]
    r = df.agg(*aggs).first()
    rows = []
    for c in cols:
        n, nb, nn = r[f"n__{c}"], r[f"nb__{c}"], r[f"nn__{c}"]
        kind = "boolean" if n > 0 and nb == 0 else ("numeric" if n > 0 and nn == 0 else "string")
        rows.append((c, kind, int(n)))
    return spark.createDataFrame(rows, "column_name string, inferred_type string, non_null bigint")


# ---------------------------------------------------------------- I6
def report_table(df: DataFrame, report: str, section_col: str, measures: Sequence[str]) -> DataFrame:
    """A metric table as long rows (report, section, key, value)."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in measures)
    return df.selectExpr(f"CAST(`{section_col}` AS STRING) AS section",
                         f"stack({len(measures)}, {stack}) AS (key, value)").select(
        F.lit(report).alias("report"), "section", "key", "value")

