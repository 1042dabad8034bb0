from rebound.functions.parse import (backfill_amounts, bool_feature, fee_bps, fx_applied,
                                     latency_bucket, missing_as, normalize_code,
                                     parse_bool_lenient, parse_bool_strict, retry_number,
                                     strip_ws, time_features, to_double)

__all__ = ["backfill_amounts", "bool_feature", "fee_bps", "fx_applied", "latency_bucket",
           "missing_as", "normalize_code", "parse_bool_lenient", "parse_bool_strict",
           "retry_number", "strip_ws", "time_features", "to_double"]
