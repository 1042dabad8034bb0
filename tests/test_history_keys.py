"""History over many keys at once, against a row-by-row brute force."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rebound.operators import history as H

T0 = dt.datetime(2024, 1, 1, 9, 59, 58)
SCHEMA = "id long, merchant string, code string, ts timestamp, v long"


def rows_of(seed, n=220):
    """A hot merchant, NULL and empty keys, repeated rows and instants, rows without a time."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = None if rng.random() < 0.05 else T0 + dt.timedelta(microseconds=rng.choice([0, 1, 999_999, 3_600_000_000, 7_200_000_000, rng.randrange(20_000_000_000)]))
        out.append((i if i % 9 else 0, rng.choice(["hot", "hot", "hot", "m1", "m2", None, ""]), rng.choice(["51", "05", None, ""]), t, rng.choice([1, 2, 3, None])))
    return out + out[:5]


def brute(events, asked, lookback):
    """Sums and counts strictly before each row, and within the look-back."""
    out = []
    for i, m, c, t, v in asked:
        answer = [i, m, c, t, v]
        for key in ((1,), (1, 2)):
            mine = [e for e in events if t is not None and e[3] is not None and e[3] < t and all(e[k] == (None, m, c)[k] for k in key)]
            late = [e for e in mine if e[3] >= t - lookback]
            for rows in (mine, late):
                answer.append(len(rows))
            for rows in (mine, late):
                answer.append(sum(e[4] or 0 for e in rows))
        out.append(tuple(answer))
    return Counter(out)


@pytest.mark.parametrize("seed,bucket", [(1, 3600), (2, 1), (3, 10**6)])
def test_equals_brute_force(spark, seed, bucket):
    rows, lookback = rows_of(seed), dt.timedelta(hours=1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.history_of_keys(df, df, {"m": ["merchant"], "mc": ["merchant", "code"]}, "ts", {"n": F.lit(1).cast("bigint"), "s": F.col("v")},
                            [3_600_000_000], bucket)
    names = ["id", "merchant", "code", "ts", "v"] + [f"{k}_{c}" for k in ("m", "mc") for c in ("n", "n_0", "s", "s_0")]
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, rows, lookback)


def test_no_events_and_nobody_asking(spark):
    rows = rows_of(4, 20)
    df, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    keys, sums = {"m": ["merchant"]}, {"n": F.lit(1).cast("bigint")}
    got = H.history_of_keys(none, df, keys, "ts", sums)
    assert got.count() == len(rows) and got.agg(F.sum("m_n")).first()[0] == 0
    assert H.history_of_keys(df, none, keys, "ts", sums).count() == 0


def test_the_plan_does_not_grow_with_the_keys(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    df = spark.createDataFrame(rows_of(5, 30), SCHEMA)
    sums = {"n": F.lit(1).cast("bigint")}

    def exchanges(out):
        return out._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    few = exchanges(H.history_of_keys(df, df, {"m": ["merchant"]}, "ts", sums))
    many = exchanges(H.history_of_keys(df, df, {f"k{i}": ["merchant", "code"][: 1 + i % 2] for i in range(7)}, "ts", sums))
    assert many <= few + 1 and many <= 14
    assert exchanges(E.queries()["historical_feature_set"](spark, SF_SMALL)) <= 20


def test_retry_success_counts_retries_of_the_look_back_only(spark):
    day = dt.timedelta(days=1)
    attempts = [(1, T0, "m", "de", "p", "51", 1.0, "DECLINED"), (2, T0 + 5 * day, "m", "de", "p", "51", 1.0, "DECLINED"),
                (3, T0 + 40 * day, "m", "de", "p", "51", 1.0, "DECLINED"), (4, T0 + 5 * day, "n", "de", "p", "51", 1.0, "DECLINED"),
                (5, T0, "m", "de", "p", "00", 1.0, "APPROVED")]
    a = spark.createDataFrame(attempts, "transaction_id long, timestamp timestamp, merchant_id string, merchant_country string, processor_name string, "
                                        "response_code string, amount_usd double, auth_status string")
    retries = [(1, T0 + day, "DECLINED"), (1, T0 + 2 * day, "APPROVED"), (2, T0 + 5 * day, "APPROVED"), (99, T0 + day, "APPROVED"), (1, None, "APPROVED")]
    r = spark.createDataFrame(retries, "original_transaction_id long, timestamp timestamp, auth_status string")
    got = {x["transaction_id"]: (x["merchant_30d_retries"], x["merchant_30d_retry_success_rate"], x["merchant_4d_retries"], x["merchant_4d_retry_success_rate"])
           for x in H.retry_success_history(a, r, {"merchant": ["merchant_id"]}, [30, 4]).collect()}
    assert got == {1: (0, None, 0, None), 2: (2, 0.5, 2, 0.5), 3: (0, None, 0, None), 4: (0, None, 0, None)}
