"""Column -> Column cleaning functions.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rebound import config as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip`` semantics: remove every leading/trailing white space
    character, not only the ASCII space that ``trim`` removes (T14)."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"^\s+", ""), r"\s+$", "")


def parse_bool_lenient(col) -> Column:
    """Batch boolean parse.

    NULL -> false; 'true'/'false' in any case -> that value; any other text ->
    true when non-empty (so '0' and 'no' become true, trap T1).  Booleans pass
    through; numbers are true when non-zero.
    """
    c = _c(col)
    s = c.cast("string")
    low = F.lower(s)
    return (F.when(c.isNull(), F.lit(False))
            .when(low == "true", F.lit(True))
            .when(low == "false", F.lit(False))
            .otherwise(F.length(s) > 0))


def parse_bool_lenient_numeric(col) -> Column:
    """P1 for numeric input: 0 -> false, other values -> true, NULL -> false."""
    c = _c(col)
    return F.coalesce(c != 0, F.lit(False))


def parse_bool_strict(col) -> Column:
    """Scoring parse. true/1/yes/y and false/0/no/n after trimming;
    anything else (and NULL/blank) is unknown -> NULL."""
    low = F.lower(strip_ws(_c(col).cast("string")))
    return (F.when(low.isin("true", "1", "yes", "y"), F.lit(True))
            .when(low.isin("false", "0", "no", "n"), F.lit(False)))


def bool_feature(col) -> Column:
    """Scoring feature value of a boolean input: unknown -> 0 else 0/1."""
    return F.coalesce(parse_bool_strict(col).cast("int"), F.lit(0))


def to_double(col) -> Column:
    """Numeric coercion; unparsable text -> NULL; NaN -> NULL."""
    d = _c(col).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def retry_number(col) -> Column:
    """Retry attempt number, unparsable/NULL -> 0, integer."""
    return F.coalesce(to_double(_c(col).cast("string")).try_cast("int"), F.lit(0))


def time_features(ts) -> dict[str, Column]:
    """P5: hour, Monday=0 weekday, month, weekend flag; NULL -> 0 / false (T4)."""
    t = _c(ts)
    dow = F.coalesce(F.weekday(t), F.lit(0))
    return {
        "event_hour": F.coalesce(F.hour(t), F.lit(0)),
        "event_dayofweek": dow,
        "event_month": F.coalesce(F.month(t), F.lit(0)),
        "is_weekend": dow.isin(5, 6),
    }


def latency_bucket(latency_ms, existing=None) -> Column:
    """Fast (<250), medium (<700), slow; only where no bucket was given."""
    lat = to_double(latency_ms)
    derived = (F.when(lat.isNull(), F.lit(None).cast("string"))
               .when(lat < C.LATENCY_FAST_MS, F.lit("fast"))
               .when(lat < C.LATENCY_MEDIUM_MS, F.lit("medium"))
               .otherwise(F.lit("slow")))
    if existing is None:
        return derived
    return F.coalesce(F.nullif(_c(existing), F.lit("")), derived)


def backfill_amounts(amount_usd, amount) -> tuple[Column, Column]:
    """Mutual backfill of amount_usd and amount."""
    a_usd, a = to_double(amount_usd), to_double(amount)
    return F.coalesce(a_usd, a), F.coalesce(a, a_usd)


def fx_applied(fx_applied_raw, fx_rate) -> Column:
    """Keep a given flag, else derive |fx_rate - 1| > 1e-9 when the rate parses."""
    given = _c(fx_applied_raw)
    rate = to_double(fx_rate)
    derived = F.when(rate.isNotNull(), F.abs(rate - F.lit(1.0)) > F.lit(1e-9))
    return F.when(given.isNull() | (given.cast("string") == ""), derived).otherwise(parse_bool_strict(given))


def fee_bps(fee_usd, amount_usd) -> Column:
    """Fee in basis points of the amount, only for positive amounts."""
    amt = to_double(amount_usd)
    fee = to_double(fee_usd)
    return F.when((amt > 0) & fee.isNotNull(), fee / amt * F.lit(10000.0))


def missing_as(col, token: str = "MISSING") -> Column:
    """Categorical NULL/blank -> token."""
    s = _c(col).cast("string")
    return F.when(s.isNull() | (s == ""), F.lit(token)).otherwise(s)


def normalize_code(col) -> Column:
    """Response code normalised like the scope guard: stripped, upper-case, blank -> NULL."""
    s = F.upper(strip_ws(_c(col).cast("string")))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)
