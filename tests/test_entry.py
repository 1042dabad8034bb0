import __spark_entry__ as E


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["policy"] == "rules_policy"
    assert rows[0]["rows"] > 0


def test_flagship_numbers_sf001(spark):
    """Survey step 1: 4,933 declines, 3,925 rule retries, 1,083 hits, 964,816.89 net."""
    r = E.queries()["rules_policy_summary"](spark, "/root/testdata/sf0.01").first()
    assert (r["rows"], r["retry_count"], r["recovered_count"]) == (4933, 3925, 1083)
    assert abs(r["realized_net_value_usd"] - 964816.89) < 0.01
