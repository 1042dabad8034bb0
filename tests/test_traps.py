"""Hand-made frames for the traps of SURVEY section 2.13 and the decision rules."""
import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rebound import config as C
from rebound.functions import parse as P
from rebound.operators import chains, decide, drift, explain, history, metrics
from rebound.operators import clean as CL


def col_values(df, c):
    return [r[c] for r in df.collect()]


# ---------------------------------------------------------------- T1 / P1 / P1b
def test_boolean_parses(spark):
    vals = ["true", "FALSE", "yes", "0", "", None, " y "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string").orderBy("i")
    lenient = col_values(df.select(P.parse_bool_lenient("v").alias("b")), "b")
    strict = col_values(df.select(P.parse_bool_strict("v").alias("b")), "b")
    assert lenient == [True, False, True, True, False, False, True]   # '0' and 'yes' are true (T1)
    assert strict == [True, False, True, False, None, None, True]


def test_strip_all_whitespace(spark):
    df = spark.createDataFrame([("\t 51\n",)], "c string")
    assert df.select(P.strip_ws("c").alias("s")).first()["s"] == "51"
    assert df.select(P.normalize_code("c").alias("s")).first()["s"] == "51"


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,)], "c string")
    assert col_values(df.select(P.to_double("c").alias("d")), "d") == [1.5, None, None, None]
    assert col_values(df.select(P.retry_number("c").alias("d")), "d") == [1, 0, 0, 0]


# ---------------------------------------------------------------- T4
def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 10),), (dt.datetime(2024, 1, 8, 23),), (None,)],
                               "ts timestamp")
    f = P.time_features("ts")
    rows = df.select(*[c.alias(n) for n, c in f.items()]).collect()
    assert (rows[0]["event_dayofweek"], rows[0]["is_weekend"], rows[0]["event_hour"]) == (5, True, 10)
    assert (rows[1]["event_dayofweek"], rows[1]["is_weekend"]) == (0, False)
    assert (rows[2]["event_dayofweek"], rows[2]["event_month"], rows[2]["is_weekend"]) == (0, 0, False)


# ---------------------------------------------------------------- P6-P9
def test_payload_enrichment(spark):
    df = spark.createDataFrame([(100.0, None, None, "1.0", 5.0), (None, "20", "abc", "1.2", None)],
                               "amount_usd double, amount string, latency string, fx_rate string, fee double")
    a_usd, a = P.backfill_amounts("amount_usd", "amount")
    r = df.select(a_usd.alias("u"), a.alias("a"), P.latency_bucket(F.lit(300)).alias("lb"),
                  P.fx_applied(F.lit(None), "fx_rate").alias("fx"), P.fee_bps("fee", "amount_usd").alias("bps")
                  ).collect()
    assert (r[0]["u"], r[0]["a"], r[0]["lb"], r[0]["fx"], r[0]["bps"]) == (100.0, 100.0, "medium", False, 500.0)
    assert (r[1]["u"], r[1]["a"], r[1]["fx"], r[1]["bps"]) == (20.0, 20.0, True, None)


# ---------------------------------------------------------------- T2 / T21 chains
def test_chain_labels(spark):
    att = spark.createDataFrame([
        Row(transaction_id="A", auth_status="DECLINED", is_retry=False, original_transaction_id=None,
            retry_attempt_num=0, hours_since_original=None),
        Row(transaction_id="B", auth_status="DECLINED", is_retry=False, original_transaction_id=None,
            retry_attempt_num=0, hours_since_original=None),
        Row(transaction_id="C", auth_status="DECLINED", is_retry=False, original_transaction_id=None,
            retry_attempt_num=0, hours_since_original=None),
        Row(transaction_id="D", auth_status="DECLINED", is_retry=False, original_transaction_id=None,
            retry_attempt_num=0, hours_since_original=None),
        Row(transaction_id="OK", auth_status="APPROVED", is_retry=False, original_transaction_id=None,
            retry_attempt_num=0, hours_since_original=None),
        Row(transaction_id="b1", auth_status="APPROVED", is_retry=True, original_transaction_id="B",
            retry_attempt_num=1, hours_since_original=4.0),
        Row(transaction_id="c1", auth_status="DECLINED", is_retry=True, original_transaction_id="C",
            retry_attempt_num=1, hours_since_original=1.0),
        Row(transaction_id="c2", auth_status="APPROVED", is_retry=True, original_transaction_id="C",
            retry_attempt_num=2, hours_since_original=24.0),
        Row(transaction_id="d2", auth_status="APPROVED", is_retry=True, original_transaction_id="D",
            retry_attempt_num=1, hours_since_original=2.0),
        Row(transaction_id="d1", auth_status="DECLINED", is_retry=True, original_transaction_id="D",
            retry_attempt_num=1, hours_since_original=2.0),
        Row(transaction_id="o1", auth_status="APPROVED", is_retry=True, original_transaction_id=None,
            retry_attempt_num=1, hours_since_original=1.0),
        Row(transaction_id="o2", auth_status="APPROVED", is_retry=True, original_transaction_id=" ",
            retry_attempt_num=1, hours_since_original=1.0),
    ])
    m = {r["transaction_id"]: r for r in chains.label_attempts(att).collect()}
    assert set(m) == {"A", "B", "C", "D"}                           # approved original and retries excluded
    assert (m["A"]["has_any_retry"], m["A"]["retry_count"], m["A"]["target_recovered_by_retry"]) == (False, 0, False)
    assert (m["B"]["target_recovered_by_retry"], m["B"]["target_first_retry_approved"]) == (True, True)
    assert (m["C"]["first_retry_status"], m["C"]["recovery_attempt_num"], m["C"]["hours_to_recovery"]) == \
        ("DECLINED", 2, 24.0)
    assert m["C"]["max_retry_attempt_num"] == 2
    # equal attempt number and hours: the id breaks the tie (d1 < d2)
    assert (m["D"]["first_retry_status"], m["D"]["retry_count"]) == ("DECLINED", 2)


# ---------------------------------------------------------------- T5 / W1
def test_split_order_nulls_last_ties_by_id(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i // 2)) for i in range(16)] + [(100, None), (101, None), (99, None), (98, None)]
    df = spark.createDataFrame(rows, "transaction_id long, timestamp timestamp")
    out = {r["transaction_id"]: r["split"] for r in metrics.temporal_split(df).collect()}
    n = len(rows)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or base, r[0]))
    expect = {}
    for pos, (i, _) in enumerate(order):
        expect[i] = "train" if pos < math.floor(n * 0.7) else "validation" if pos < math.floor(n * 0.85) else "test"
    assert out == expect


def test_split_invariant_to_partitions(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 7) % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_id long, timestamp timestamp")
    res = [sorted((r["transaction_id"], r["split"]) for r in metrics.temporal_split(df.repartition(p)).collect())
           for p in (1, 4, 32)]
    assert res[0] == res[1] == res[2]


# ---------------------------------------------------------------- T15 / M1
def test_auc_midranks(spark):
    def auc(rows):
        df = spark.createDataFrame(rows, "y int, p double")
        return metrics.auc(df, "y", "p").first()["auc"]
    assert auc([(1, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2)]) == 1.0
    assert auc([(1, 0.9), (1, 0.1)]) is None                          # one class
    # midrank on ties: pos {0.3, 0.5}, neg {0.3, 0.1}: (1.5 + 2) / 4
    assert auc([(1, 0.3), (0, 0.3), (1, 0.5), (0, 0.1)]) == pytest.approx(0.875)


def test_log_loss_clip_and_brier(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "y int, p double")
    r = metrics.metric_bundle(df, "y", "p", 0.5, with_auc=False).first()
    assert r["log_loss"] == pytest.approx(-math.log(1e-12) / 3, rel=1e-6)
    assert r["brier"] == pytest.approx(1 / 3)
    assert (r["precision"], r["recall"]) == (1.0, 0.5)


# ---------------------------------------------------------------- T7 / M6
def test_grid_exact_values_and_first_wins(spark):
    df = spark.createDataFrame([(1, 0.05), (0, 0.04), (1, 0.50), (0, 0.49)], "y int, p double")
    sw = {r["threshold"]: r for r in metrics.threshold_sweep(df, "y", "p").collect()}
    assert sw[0.05]["tp"] == 2 and sw[0.05]["fp"] == 1             # p >= 0.05 includes 0.05
    assert sw[0.5]["tp"] == 1 and sw[0.5]["fp"] == 0
    flat = spark.createDataFrame([(0, 0.9), (0, 0.8)], "y int, p double")
    b = metrics.best_f1_threshold(flat, "y", "p").first()
    assert (b["best_threshold"], b["best_f1"]) == (0.05, 0.0)     # all F1 equal: lowest threshold


# ---------------------------------------------------------------- T8 / F1-F4
def test_psi_edge_cases(spark):
    base = spark.createDataFrame([(float(i % 10), 1.0, True) for i in range(100)], "x double, k double, b boolean")
    same = drift.drift_table(base, base, ["x", "k", "b"], [], ["absent"])
    r = {row["feature"]: row for row in same.collect()}
    assert r["x"]["psi"] == pytest.approx(0.0, abs=1e-12) and r["x"]["ks_stat"] == 0.0
    assert r["k"]["psi"] == 0.0                                     # constant column: < 3 edges
    assert r["b"]["psi"] == 0.0                                     # boolean: < 3 edges
    assert r["absent"]["feature_type"] == "missing" and r["absent"]["psi"] is None
    shifted = spark.createDataFrame([(float(i % 10) + 100, 1.0, True) for i in range(100)], "x double, k double, b boolean")
    out = {row["feature"]: row for row in drift.drift_table(base, shifted, ["x"], []).collect()}
    # every new value lies outside the baseline range and is dropped (T8): the
    # current shares are all clipped to eps, baseline shares are 0.1 each
    assert out["x"]["psi"] == pytest.approx(10 * (1e-6 - 0.1) * math.log(1e-6 / 0.1))
    assert out["x"]["ks_stat"] == 1.0 and out["x"]["alert"] == "retrain"
    empty = shifted.where("x < 0")
    e = {row["feature"]: row for row in drift.drift_table(base, empty, ["x"], []).collect()}
    assert e["x"]["psi"] is None


def test_js_identical_zero(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbccccd" * 3], "c string")
    assert drift.jensen_shannon(df, df, ["c"]).first()["js_divergence"] == pytest.approx(0.0, abs=1e-12)


# ---------------------------------------------------------------- T10 / M7
def test_calibration_right_closed(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.1), (1, 0.2), (1, 0.3), (0, 0.3), (1, 0.9)], "y int, p double")
    cur = metrics.calibration_curve(df, "y", "p").orderBy("bucket").collect()
    assert cur[0]["lower"] == 0.1 and cur[-1]["upper"] == 0.9
    assert sum(r["rows"] for r in cur) == 6                         # lowest edge included


# ---------------------------------------------------------------- T13 / W10, S2 twin
def test_rate_window_open_lower_edge(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(seconds=60)), (1, t0 + dt.timedelta(seconds=119))],
                               "k long, ts timestamp")
    c = sorted(r["lookback_value"] for r in history.lookback_counts(df, ["k"], "ts", 60_000_000).collect())
    assert c == [1, 1, 2]                                           # exactly 60 s apart is not counted


def test_dedup_within_horizon(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t0), (2, "a", t0 + dt.timedelta(hours=5)),
                                (3, "a", t0 + dt.timedelta(hours=30)), (4, "b", t0 + dt.timedelta(hours=1))],
                               "id long, k string, ts timestamp")
    kept = sorted(r["id"] for r in history.dedup_within(df, ["k"], "ts").collect())
    assert kept == [1, 3, 4]


def test_sequence_features_cross_day(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 0)
    df = spark.createDataFrame([(1, 7, t0, "51"), (2, 7, t0 + dt.timedelta(hours=2), "05"),
                                (3, 7, t0 + dt.timedelta(hours=3), "05")], "id long, m long, ts timestamp, code string")
    r = {x["id"]: x for x in history.sequence_features(df, "m", "ts", "id", "code").collect()}
    assert [r[i]["attempt_number"] for i in (1, 2, 3)] == [1, 2, 3]
    assert r[2]["minutes_since_last"] == 120.0 and r[2]["decline_code_changed"] is True
    assert r[3]["hours_since_first"] == 3.0 and r[3]["decline_code_changed"] is False


# ---------------------------------------------------------------- D1 / D3 / D4
def test_rule_probability_and_ev(spark):
    df = spark.createDataFrame([(True, 5834.24, "51"), (True, 100.0, "91"), (False, 900.0, "05"),
                                (True, 500.0, "54")], "is_soft_decline boolean, amount_usd double, response_code string")
    r = df.select(decide.rule_probability().alias("p")).collect()
    assert [x["p"] for x in r] == pytest.approx([0.43, 0.40, 0.01, 0.0])
    ev = df.select(decide.expected_value(decide.rule_probability(), "amount_usd").alias("ev")).first()["ev"]
    assert ev == pytest.approx(877.90312, abs=1e-6)                  # 0.43 * 5834.24 * 0.35 - 0.15


# ---------------------------------------------------------------- D6 scope cascade
def test_scope_cascade_order(spark):
    rows = [("99", "US", "saas", "global-acquirer-a", 10.0),        # unknown code
            ("  ", "US", "saas", "global-acquirer-a", 10.0),        # blank code
            ("54", "XX", "saas", "global-acquirer-a", 99999.0),     # hard decline wins over the rest
            ("51", "us", "saas", "global-acquirer-a", 25000.0),     # lower-case country ok, cap inclusive
            ("51", "XX", "nope", "global-acquirer-a", 10.0),        # country before vertical
            ("51", "US", "nope", "global-acquirer-a", 10.0),
            ("51", "US", "saas", "Global-Acquirer-A", 10.0),        # processor is case-sensitive
            ("51", "US", "saas", "global-acquirer-a", 25000.01),
            ("51", None, "", "global-acquirer-a", None)]            # missing categoricals pass
    df = spark.createDataFrame(rows, "response_code string, merchant_country string, merchant_vertical string, "
                                     "processor_name string, amount_usd double")
    reason = decide.scope_reason(countries=C.SUPPORTED_MERCHANT_COUNTRIES, verticals=C.SUPPORTED_MERCHANT_VERTICALS,
                                 processors=C.SUPPORTED_PROCESSORS)
    got = col_values(df.select(reason.alias("r")), "r")
    assert got == ["response_code", "response_code", "hard_decline", None, "merchant_country",
                   "merchant_vertical", "processor_name", "amount", None]
    hr = df.select(decide.hard_decline_reason().alias("h")).collect()[2]["h"]
    assert hr == C.HARD_DECLINE_REASONS["54"]


# ---------------------------------------------------------------- D2 / D8-D11
def _timing(spark, probs):
    return spark.createDataFrame([("51", 1, 0.2, probs)],
                                 "timing_code string, timing_attempt int, code_prior double, delay_probs array<double>")


def test_delay_ties_and_gates(spark):
    base = [("t1", "51", "US", "saas", "global-acquirer-a", 100.0, 0.5)]
    df = spark.createDataFrame(base, "transaction_id string, response_code string, merchant_country string, "
                                     "merchant_vertical string, processor_name string, amount_usd double, p double")
    # equal best EV at 4 h and 12 h: the shorter delay wins
    probs = [0.1, 0.2, 0.6, 0.6, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3]
    r = decide.decision_table(df, "p", _timing(spark, probs)).first()
    assert r["recommended_action"] == "retry" and r["recommended_delay_hours"] == 4.0
    assert r["margin_rate"] == 0.75                                  # saas vertical margin
    assert r["expected_value"] == pytest.approx(0.5 * 100 * 0.75 - 0.15)
    assert r["confidence"] == pytest.approx(0.8)
    # best EV below the floor: do_not_retry with the EV reason; p below threshold: both reasons
    low = [0.0133] * 10
    r2 = decide.decision_table(df, "p", _timing(spark, low)).first()
    assert r2["recommended_action"] == "do_not_retry" and r2["expected_value"] is None
    assert "below min_retry_ev_usd $1.00" in r2["attempt_decision_reason"]
    assert "decision_threshold 0.10" in r2["attempt_decision_reason"]
    assert r2["recommended_delay_hours"] is None


def test_hard_decline_row(spark):
    df = spark.createDataFrame([("t", "57", "US", "saas", "global-acquirer-a", 100.0, 0.5)],
                               "transaction_id string, response_code string, merchant_country string, "
                               "merchant_vertical string, processor_name string, amount_usd double, p double")
    r = decide.decision_table(df, "p", _timing(spark, [0.5] * 10)).first()
    assert (r["recommended_action"], r["recoverability_score"], r["expected_value"], r["confidence"]) == \
        ("do_not_retry", 0.0, 0.0, None)
    assert r["hard_decline_reason"] == C.HARD_DECLINE_REASONS["57"]


# ---------------------------------------------------------------- X2-X5
def test_explanations_neutral_and_ties(spark):
    df = spark.createDataFrame([("r", None, "US", "51")], "id string, vertical string, country string, code string")
    terms = [("merchant_vertical", F.col("vertical"), F.lit(0.3)), ("merchant_country", F.col("country"), F.lit(-0.2)),
             ("response_code", F.col("code"), F.lit(0.2))]
    arr = explain.contributions(terms, {"merchant_vertical": F.col("vertical")})
    e = explain.explain(df.withColumn("c", arr), "c", 3).first()["top_explanation_features"]
    # the omitted input is zeroed and ranks last; |-0.2| == |0.2| ties by feature order
    assert [x["feature"] for x in e] == ["merchant_country", "response_code", "merchant_vertical"]
    assert [x["direction"] for x in e] == ["decrease", "increase", "neutral"]
    assert e[0]["business_explanation"] == "Merchant country `US` decreased the predicted retry recoverability."
    assert e[2]["business_explanation"] == ("Feature `merchant_vertical` was not provided in the request; "
                                            "its contribution is treated as neutral.")


def test_amount_phrase(spark):
    df = spark.createDataFrame([("1234.5",)], "v string")
    p = df.select(explain.phrase(F.lit("amount_usd"), F.col("v"), F.lit(1.0)).alias("t")).first()["t"]
    assert p == "Transaction amount `$1,234.50` increased the predicted retry recoverability."


# ---------------------------------------------------------------- P10 / P15 / P16
def test_transaction_mapping(spark):
    row = {"transaction_id": "txn_123", "created_at": "2025-07-26T11:16:06Z", "amount_usd": 5834.24,
           "processor": "global-acquirer-a", "response_code": "51", "decline_category": "soft",
           "processing_fee_usd": 53.52, "avs_result": "Y", "token_type": "network_token", "fx_rate": 1.0,
           "three_ds_version": "2.2.0", "is_tokenized": True, "risk_decision": "review"}
    df = spark.createDataFrame([row])
    r = CL.map_transaction(df).first()
    assert (r["response_code"], r["is_soft_decline"], r["event_hour"], r["processor_name"]) == \
        ("51", True, 11, "global-acquirer-a")
    assert r["processor_fee_bps"] == pytest.approx(53.52 / 5834.24 * 10000)
    assert (r["avs_zip_match"], r["network_token_present"], r["fx_applied"], r["is_token"]) == (True, True, False, True)
    assert r["three_ds_requested"] is True and r["risk_skip_flag"] is False


def test_payload_rules(spark):
    vals = ["10", None, "0", "-5", "abc", "NaN", "Infinity", "true", ""]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    got = col_values(df.select(CL.amount_rule(F.col("a")).alias("bad")), "bad")
    assert got == [False, True, True, True, True, True, True, True, True]
    js = spark.createDataFrame([('{"k": 1}',), ('{"k": 1, "x": 2}',), ("[1]",)], "j string")
    u = [r["u"] for r in js.select(CL.unknown_fields(F.col("j"), ["k"]).alias("u")).collect()]
    assert u == [[], ["x"], None]


def test_forbidden_columns_guard(spark):
    from rebound.operators.features import ForbiddenColumnError, guard_forbidden
    with pytest.raises(ForbiddenColumnError):
        guard_forbidden(spark.createDataFrame([(1,)], "PAN int"))


def test_key_lookup_and_code_enrichment(spark):
    df = spark.createDataFrame([(1, "54"), (2, " 51"), (3, "XX")], "transaction_id long, response_code string")
    req = spark.createDataFrame([(2,), (3,), (3,), (9,)], "id long")
    assert sorted(r["transaction_id"] for r in chains.lookup_keys(df, req, "transaction_id", "id").collect()) == [2, 3]
    e = {r["transaction_id"]: r for r in chains.enrich_codes(df).collect()}
    assert (e[1]["code_category"], e[1]["code_reason"]) == ("hard", C.HARD_DECLINE_REASONS["54"])
    assert (e[2]["code_category"], e[3]["code_category"]) == ("soft", "unknown")


def test_trailing_rate_is_exact_to_the_microsecond(spark):
    t0 = dt.datetime(2024, 2, 10, 5)
    us, day = dt.timedelta(microseconds=1), dt.timedelta(days=1)
    rows = [(1, "k", t0, True), (2, "k", t0 - 30 * day, True), (3, "k", t0 - 30 * day - us, True),
            (4, "k", t0 - dt.timedelta(hours=3), False), (5, "k", t0 - us, True), (6, "k", t0, False),
            (7, None, t0, True), (8, None, t0 - day, False), (9, "k", None, True), (5, "k", t0 - us, True)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, dec boolean")
    out = history.trailing_rate(df, "key", "ts", [30, 7], F.col("dec")).collect()
    assert sorted((r["id"]) for r in out) == sorted(r[0] for r in rows)   # nothing lost or multiplied
    for r in out:
        for n in (30, 7):
            own = [d for _, k, t, d in rows if k == r["key"] and t is not None and r["ts"] is not None
                   and r["ts"] - n * day <= t < r["ts"]]
            assert r[f"prior_{n}d_attempts"] == len(own)
            assert r[f"prior_{n}d_decline_rate"] == (pytest.approx(sum(own) / len(own)) if own else None)


def _awkward_events(spark):
    """NULL keys and times, equal times, repeated ids, times off midnight."""
    import random
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(100), rnd.choice(["a", "b", None]),
             rnd.choice([None] + [t0 + dt.timedelta(seconds=rnd.choice([0, 30, 60, 61, 119, 3599, 3650]) + 120 * (i % 7), microseconds=i % 3)] * 9),
             rnd.choice(["51", "91", None]), float(rnd.randrange(50))) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id long, k string, ts timestamp, code string, amount_usd double")


def test_history_keeps_rows_with_null_keys_times_and_repeated_ids(spark):
    rows, df = _awkward_events(spark)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    out = history.sequence_features(df, "k", "ts", "id", "code")
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("attempt_number", F.row_number().over(w))
    assert sorted(key(r[:3]) for r in out.select("id", "k", "ts").collect()) == sorted(key(r[:3]) for r in rows)
    assert sorted((str(r["k"]), r["attempt_number"]) for r in out.collect()) == sorted((str(r["k"]), r["attempt_number"]) for r in plain.collect())
    hist = history.historical_rates(df.withColumnRenamed("ts", "timestamp"), "k", declined=F.col("code") == "51").collect()
    assert len(hist) == len(rows)
    for r in hist:
        own = [c == "51" for _, k, t, c, _ in rows if k == r["k"] and t is not None and r["timestamp"] is not None and t < r["timestamp"]]
        assert r["prior_attempts"] == len(own)
    look = history.lookback_counts(df, ["k"], "ts", 60_000_000).collect()
    assert len(look) == len(rows)
    for r in look:
        own = sum(1 for _, k, t, _, _ in rows if k == r["k"] and t is not None and r["ts"] is not None
                  and r["ts"] - dt.timedelta(seconds=60) < t <= r["ts"])
        assert r["lookback_value"] == (own if r["ts"] is not None else None)
    total = history.rate_breaches(df, "k", "ts", 5).agg(F.sum("requests")).first()[0]
    assert total == len(rows)


def test_dedup_keeps_the_first_and_then_the_next_after_the_horizon(spark):
    import random
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "b", None]), t0 + dt.timedelta(hours=rnd.randrange(500), minutes=rnd.choice([0, 0, 30]))) for i in range(400)]
    rows += [(1000, "c", t0), (1001, "c", t0 + dt.timedelta(hours=20)), (1002, "c", t0 + dt.timedelta(hours=40)),
             (1003, "d", t0), (1004, "d", t0 + dt.timedelta(hours=24)), (1005, "d", t0), (1006, "e", None), (1007, "e", None)]
    kept, last = [], {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or t >= last[k] + dt.timedelta(hours=24):
            last[k] = t
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = sorted(r["id"] for r in history.dedup_within(df, ["k"], "ts", "id").collect())
    assert got == sorted([*kept, 1006, 1007])
    assert {1000, 1002, 1003, 1004} <= set(got) and not {1001, 1005} & set(got)


def test_metrics_keep_a_null_group(spark):
    rows = [(g, y, p) for g in ("a", None) for y, p in ((1, 0.9), (0, 0.2), (1, 0.3), (0, 0.4))]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    b = {r["g"]: r["auc"] for r in metrics.metric_bundle(df, "y", "p", 0.5, ["g"]).collect()}
    assert b == {"a": 0.75, None: 0.75}
    t = metrics.threshold_sweep(df, "y", "p", ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in t} == {"a": 46, None: 46}


def test_grid_uses_linspace_doubles(spark):
    from rebound import config as C
    g = C.threshold_grid()
    assert g[1] == 0.060000000000000005 and g[0] == 0.05 and g[-1] == 0.5
    df = spark.createDataFrame([(1, 0.06)], "y int, p double")
    sw = {r["threshold"]: r for r in metrics.threshold_sweep(df, "y", "p").collect()}
    assert sw[g[1]]["tp"] == 0                                        # 0.06 < 0.060000000000000005 (T7)


def test_calibration_fewer_rows_than_buckets(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (1, 0.8)], "y int, p double")
    cur = metrics.calibration_curve(df, "y", "p").orderBy("bucket").collect()
    # q = min(10, 3) = 3 buckets: edges at the 0, 1/3, 2/3, 1 quantiles (interpolated)
    assert [r["rows"] for r in cur] == [1, 1, 1]
    assert [r["upper"] for r in cur] == pytest.approx([0.3, 0.4 + (0.8 - 0.4) / 3, 0.8])


def test_roles_rename(spark):
    from rebound.roles import Roles
    df = spark.createDataFrame([("a", 10.0, "51")], "txn string, amt double, rc string")
    r = Roles(transaction_id="txn", amount_usd="amt", response_code="rc")
    c = r.to_canonical(df)
    assert c.columns == ["transaction_id", "amount_usd", "response_code"]
    assert r.from_canonical(c).columns == ["txn", "amt", "rc"]


def test_date_range_scoring_pushes_filter(spark):
    from rebound.plans import fixture as fx
    d = fx.declines_between(spark, "/root/testdata/sf0.01", "1996-01-01", "1997-01-01")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan.split("PushedFilters")[1].split("]")[0]
    n = d.count()
    allf = fx.declines(spark, "/root/testdata/sf0.01")
    m = allf.where((F.col("timestamp") >= "1996-01-01") & (F.col("timestamp") < "1997-01-01")).count()
    assert n == m and n > 0


def test_quantiles_ignore_nan_and_null(spark):
    from rebound.operators import ordered
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,), (2.0,)], "x double")
    assert ordered.exact_quantiles(df, "x", [0.0, 0.5, 1.0])[()] == [1.0, 2.0, 3.0]


def test_vocabulary_join_equals_lists(spark, monkeypatch):
    from rebound.operators import features as FE
    rows = [("t1", "51", "A", "v1", "p1", 10.0), ("t2", "51", "B", "v1", "p1", 10.0),
            ("t3", "51", "Z", "v9", "p1", 10.0)]
    df = spark.createDataFrame(rows, "transaction_id string, response_code string, merchant_country string, "
                                     "merchant_vertical string, processor_name string, amount_usd double")
    fields = {c: c for c in ("merchant_country", "merchant_vertical", "processor_name")}
    vocab = FE.vocabulary(df.where("transaction_id != 't3'"), list(fields))
    by_list = decide.scope_reason(countries=["A", "B"], verticals=["v1"], processors=["p1"])
    by_join = decide.scope_reason(countries=F.col("__in_merchant_country"), verticals=F.col("__in_merchant_vertical"),
                                  processors=F.col("__in_processor_name"))
    for bound in (decide.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decide, "BROADCAST_ROWS", bound)
        flagged = decide.vocabulary_flags(df, vocab, fields)
        a = sorted((r[0], r[1]) for r in flagged.select("transaction_id", by_join).collect())
        b = sorted((r[0], r[1]) for r in df.select("transaction_id", by_list).collect())
        assert a == b == [("t1", None), ("t2", None), ("t3", "merchant_country")]


def test_decisions_guard_by_default_and_say_why(spark):
    rows = [("t1", "51", "XX", "nope", "nope", 10.0, 0.5), ("t2", " zz ", "US", "saas", None, 10.0, 0.5),
            ("t3", "51", "US", "saas", "global-acquirer-a", 1234567.891, 0.5), ("t4", " 51 ", "us", "saas", "global-acquirer-a", 100.0, 0.5),
            ("t5", "", "US", "saas", None, 10.0, 0.5), ("t6", "51", "US", "Saas", None, 10.0, 0.5)]
    df = spark.createDataFrame(rows, "transaction_id string, response_code string, merchant_country string, "
                                     "merchant_vertical string, processor_name string, amount_usd double, p double")
    out = {r["transaction_id"]: r for r in decide.decision_table(df, "p", _timing(spark, [0.6] * 10), model_version="m2").collect()}
    assert {k: r["recommended_action"] for k, r in out.items()} == {
        "t1": "out_of_scope", "t2": "out_of_scope", "t3": "out_of_scope", "t4": "retry", "t5": "out_of_scope", "t6": "out_of_scope"}
    assert out["t1"]["out_of_scope_reason"] == f"merchant_country `XX` not in trained allowlist {sorted(C.SUPPORTED_MERCHANT_COUNTRIES)}"
    assert out["t2"]["out_of_scope_reason"].startswith("Response code `ZZ` is not in") and "`<empty>`" in out["t5"]["out_of_scope_reason"]
    assert out["t3"]["out_of_scope_reason"].startswith("Amount $1,234,567.89 exceeds the model's training envelope ($25,000.00).")
    assert out["t6"]["scope_reason"] == "merchant_vertical" and out["t4"]["out_of_scope_reason"] is None
    # the padded code finds its timing row: 0.6, not the row score 0.5
    assert out["t4"]["recommended_delay_probability"] == 0.6
    assert (out["t4"]["model_version"], out["t4"]["policy_version"], out["t4"]["decision_threshold_used"]) == ("m2", "v1", 0.1)


def test_best_delay_reads_the_whole_curve(spark):
    curve = [(float(i), 0.1, 1.0 if i < 130 else 2.0) for i in range(150)]
    df = spark.createDataFrame([(curve,)], "delay_curve array<struct<delay_hours:double,success_probability:double,expected_value:double>>")
    assert df.select(decide.best_delay().alias("b")).first()["b"]["delay_hours"] == 130.0


def test_malformed_time_is_missing(spark):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "not a time"), ("c", None)], "transaction_id string, created_at string")
    from rebound.operators import clean
    out = {r["transaction_id"]: r for r in clean.map_transaction(df).collect()}
    assert len(out) == 3 and sum(v is not None for v in out["b"].asDict().values()) <= sum(v is not None for v in out["a"].asDict().values())


def test_trees_take_many_categories(spark):
    from rebound.operators import model as MD
    rows = [(i, f"c{i % 90}", float(i % 7), int(i % 90 < 30)) for i in range(1800)]
    df = spark.createDataFrame(rows, "id long, cat string, num double, y int")
    m = MD.fit_gbt(df, ["num"], ["cat"], "y", max_iter=2)
    assert MD.apply_model(m, df, "p", ["num"], ["cat"]).count() == 1800


@pytest.mark.parametrize("block", [4096, 2])
def test_retrieval_in_one_and_many_query_blocks(spark, monkeypatch, block):
    import random
    from rebound.operators import retrieval as R
    rnd = random.Random(1)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(4)]
    qs, cs = [(i, vec()) for i in range(7)], [(i, vec()) for i in range(50)]
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    got = R.top_k_cosine(spark.createDataFrame(cs, "cid int, e array<double>"), spark.createDataFrame(qs, "qid int, v array<double>"),
                         "cid", "e", "qid", "v", 3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(q, i) for q, v in qs for i in [i for _, i in sorted((-cos(v, e), i) for i, e in cs)[:3]]}
    assert {(r["query_id"], r["candidate_id"]) for r in got.collect()} == want
