"""Decision economics, code lists and other constants.

FIXED VALUES: these must equal the behaviour being reproduced, so they are
stated plainly here, once, and every operator reads them from this module.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- FIXED VALUES: platform economics -------------------------------------
DEFAULT_MARGIN_RATE = 0.35
DEFAULT_RETRY_COST_USD = 0.12
DEFAULT_FRICTION_COST_USD = 0.03
DEFAULT_THRESHOLD = 0.10            # scoring service default
OFFLINE_POLICY_THRESHOLD = 0.05     # offline policy evaluation default
DEFAULT_MIN_RETRY_EV_USD = 1.00
AMOUNT_CAP_USD = 25000.0

# ---- FIXED VALUES: margin rate by merchant vertical ------------------------
VERTICAL_MARGIN_RATES = {
    "saas": 0.75,
    "digital_goods": 0.70,
    "high_risk": 0.40,
    "ecom": 0.30,
    "marketplace": 0.15,
    "travel": 0.10,
}

# ---- FIXED VALUES: retry delay grid in hours -------------------------------
DELAY_GRID_HOURS = [0.25, 1.0, 4.0, 12.0, 24.0, 48.0, 72.0, 168.0, 336.0, 720.0]

# ---- FIXED VALUES: response code vocabularies ------------------------------
HARD_DECLINE_CODES = ["04", "07", "14", "15", "41", "43", "54", "57", "59", "62", "R0", "R1"]
SOFT_DECLINE_CODES = ["05", "51", "61", "65", "91", "92", "96", "NW", "PR", "RC"]
HARD_DECLINE_REASONS = {
    "04": "Pick up card — card flagged by issuer",
    "07": "Pick up card, special conditions",
    "14": "Invalid card number",
    "15": "No such issuer",
    "41": "Lost card — do not retry",
    "43": "Stolen card — do not retry",
    "54": "Expired card — needs a new PAN (Account Updater may help)",
    "57": "Transaction not permitted to cardholder",
    "59": "Suspected fraud",
    "62": "Restricted card",
    "R0": "Customer requested stop",
    "R1": "Customer requested stop of all recurring",
}
HARD_DECLINE_DEFAULT_REASON = "Hard decline — no delay recovers this code"

# ---- FIXED VALUES: texts of refused and stopped decisions ------------------
OUT_OF_SCOPE_CODE = ("Response code `%s` is not in the model's trained vocabulary. "
                     "Use a manual review path rather than automated retry.")
OUT_OF_SCOPE_CATEGORY = "%s `%s` not in trained allowlist"
OUT_OF_SCOPE_AMOUNT = ("Amount $%,.2f exceeds the model's training envelope ($%,.2f). Use a manual review "
                       "or merchant's high-ticket workflow rather than automated retry.")
BELOW_THRESHOLD = "best-delay success probability %.3f is below decision_threshold %.2f"
BELOW_MIN_EV = "best-delay expected value $%.2f is below min_retry_ev_usd $%.2f"
SCORE_MISSING = "recoverability score is missing"  # own text: the score is NULL or NaN
ATTEMPT_STOP = (". Timing model conditions on attempt_num, so success probability decays as retries "
                "accumulate; once it crosses either the probability or EV floor the engine stops.")

# ---- FIXED VALUES: versions reported when the caller names none ------------
MODEL_VERSION = "v1"
POLICY_VERSION = "v1"

# ---- FIXED VALUES: scope vocabularies of the served model ------------------
SUPPORTED_MERCHANT_COUNTRIES = [
    "AE", "AR", "AU", "BR", "CA", "CL", "CN", "CO", "DE", "EG", "ES", "FR",
    "GB", "HK", "ID", "IE", "IN", "IT", "JP", "MX", "MY", "NL", "PE", "PH",
    "PL", "SA", "SE", "SG", "TH", "US",
]
SUPPORTED_MERCHANT_VERTICALS = ["digital_goods", "ecom", "high_risk", "marketplace", "saas", "travel"]
SUPPORTED_PROCESSORS = [
    "cross-border-fx-specialist-a", "cross-border-fx-specialist-b",
    "global-acquirer-a", "global-acquirer-b",
    "high-risk-or-orchestrator-a", "high-risk-or-orchestrator-b",
    "regional-bank-processor-a", "regional-bank-processor-b",
    "regional-bank-processor-c",
    "regional-card-specialist-a", "regional-card-specialist-b",
]

# ---- FIXED VALUES: rule baseline probability -------------------------------
RULE_SOFT_BASE = 0.30
RULE_HARD_BASE = 0.01
RULE_SOFT_LARGE_AMOUNT = 150.0
RULE_SOFT_LARGE_BONUS = 0.08
RULE_CODE_BONUS = {"91": 0.10, "51": 0.05}
RULE_ZERO_CODES = ["54", "62", "14"]
RULE_CLIP_MAX = 0.95

# ---- FIXED VALUES: metric constants ----------------------------------------
LOG_LOSS_EPS = 1e-12
PSI_EPS = 1e-6
JS_EPS = 1e-6
TARGET_ENCODING_SMOOTHING = 20.0
SEGMENT_MIN_SUPPORT = 25
SEGMENT_SPECS = [("merchant_country", 8), ("processor_name", 8), ("response_code", 8), ("merchant_vertical", 6)]
CONFIDENCE_SCALE = 0.5
PSI_ALERT_INVESTIGATE = 0.2
PSI_ALERT_RETRAIN = 0.25
JS_ALERT = 0.2
KS_P_ALERT = 0.05
DISAGREEMENT_DELTA = 0.20
RATE_WINDOW_SECONDS = 60
RATE_LIMIT_PER_KEY = 100
RATE_LIMIT_PER_ADDRESS = 60
DEDUP_HORIZON = "24 hours"
LATENCY_FAST_MS = 250.0
LATENCY_MEDIUM_MS = 700.0

# ---- FIXED VALUES: card data that must never enter a feature table ---------
FORBIDDEN_COLUMNS = [
    "pan", "card_number", "primary_account_number", "full_pan", "cardnumber",
    "cvv", "cvc", "cvv2", "cvc2", "cvn", "security_code",
    "track1", "track2", "track_data", "magstripe",
    "cardholder_name", "card_holder_name", "name_on_card",
    "pin", "pin_block",
]

# ---- FIXED VALUES: columns that leak later outcomes into features ----------
LEAKY_COLUMNS = [
    "transaction_id", "timestamp", "auth_status", "is_retry",
    "original_transaction_id", "original_transaction_id_x", "original_transaction_id_y",
    "retry_attempt_num", "retry_reason", "hours_since_original",
    "has_any_retry", "retry_count", "first_retry_status", "first_retry_attempt_num",
    "hours_to_first_retry", "recovery_attempt_num", "hours_to_recovery",
    "target_recovered_by_retry", "target_first_retry_approved",
    "approved_amount", "auth_code", "captured_amount", "refunded_amount",
    "captured_at", "refunded_at", "voided_at", "settled_at", "chargeback_reason_code",
]

# ---- FIXED VALUES: identifier columns, never features ----------------------
IDENTIFIER_COLUMNS = [
    "merchant_id", "psp_transaction_id", "psp_reference", "gateway_id",
    "network_transaction_id", "stan", "rrn", "arn", "session_id", "correlation_id",
    "trace_id", "device_fingerprint", "subscription_id", "wallet_token",
    "merchant_descriptor", "dynamic_descriptor", "soft_descriptor", "terminal_id",
    "billing_zip", "billing_city", "billing_state", "issuer_bank_name",
    "issuer_bank_bin_range", "stored_credential_id", "bin_first6", "acquirer_bin",
]


def threshold_grid() -> list[float]:
    """The 46 thresholds of ``linspace(0.05, 0.50, 46)`` as exact doubles
    (e.g. 0.060000000000000005), so comparisons at grid points behave like the
    reference's; the same literals are shared with the SQL oracles (T7)."""
    import numpy as np
    return [float(x) for x in np.linspace(0.05, 0.50, 46)]


@dataclass(frozen=True)
class Economics:
    """Per-run decision assumptions; any field may be overridden per row."""

    margin_rate: float | None = None          # None -> by vertical, else default
    retry_cost_usd: float = DEFAULT_RETRY_COST_USD
    friction_cost_usd: float = DEFAULT_FRICTION_COST_USD
    decision_threshold: float = DEFAULT_THRESHOLD
    min_retry_ev_usd: float = DEFAULT_MIN_RETRY_EV_USD
    vertical_margins: dict = field(default_factory=lambda: dict(VERTICAL_MARGIN_RATES))
