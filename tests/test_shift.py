"""Category shift as a table test (Q2), by hand."""
import math

from rebound.operators import profile


def run(spark, now, before, columns=("c",)):
    schema = ", ".join(f"{c} string" for c in columns)
    base = profile.baseline_shares(spark.createDataFrame(before, schema), list(columns))
    return {r["test"]: r for r in profile.category_shift_test(spark.createDataFrame(now, schema), base, list(columns)).collect()}


def test_equal_shares_do_not_fail(spark):
    r = run(spark, [("a",)] * 3 + [("b",)] + [(None,)] * 4, [("a",)] * 6 + [("b",)] * 2 + [("",)] * 8)["c_shift"]
    assert (r["rows"], r["failures"], r["unseen_rows"]) == (8, 0, 0) and abs(r["divergence"]) < 1e-12


def test_a_new_category_fails_by_its_rows_and_a_new_mix_by_all(spark):
    r = run(spark, [("a",)] * 95 + [("new",)] * 5, [("a",)] * 10)["c_shift"]
    want = 0.5 * math.log(2 / 1.95) + 0.5 * (0.95 * math.log(1.9 / 1.95) + 0.05 * math.log(2))
    assert (r["rows"], r["failures"], r["unseen_rows"]) == (100, 5, 5) and abs(r["divergence"] - want) < 1e-12
    r = run(spark, [("a",)] * 2 + [("b",)] * 98, [("a",)] * 99 + [("b",)])["c_shift"]
    assert (r["rows"], r["failures"], r["unseen_rows"]) == (100, 100, 0) and r["divergence"] > 0.2


def test_empty_tables(spark):
    r = run(spark, [], [("a", "x")], ("c", "d"))
    assert {t: (x["rows"], x["failures"], x["divergence"]) for t, x in r.items()} == {"c_shift": (0, 0, None), "d_shift": (0, 0, None)}
    r = run(spark, [("a",)] * 4, [])["c_shift"]
    assert (r["rows"], r["failures"], r["unseen_rows"]) == (4, 4, 4)
