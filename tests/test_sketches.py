"""Mergeable column statistics against exact ones."""
import datetime as dt
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from rebound.operators import sketches as S

D0 = dt.date(2026, 3, 1)
ROW = "day date, x double, k int, t string, y boolean"


def rows(n, days, seed=1):
    rng = random.Random(seed)
    return [(D0 + dt.timedelta(days=rng.randrange(days)), rng.lognormvariate(3, 2) if rng.random() > 0.1 else None, rng.randrange(50),
             f"t{rng.randrange(9000)}", rng.random() < 0.3) for _ in range(n)]


def sketched(df):
    return S.day_sketches(df, F.col("day"), ["x", "k"], ["t"], F.col("y"))


def test_merged_days_keep_the_stated_error(spark):
    data = rows(40_000, 12)
    df = spark.createDataFrame(data, ROW)
    m = S.merged(sketched(df))
    got = {r["column_name"]: r for r in S.statistics(m).collect()}
    x = np.array([r[1] for r in data if r[1] is not None])
    y = np.array([float(r[4]) for r in data if r[1] is not None])
    r = got["x"]
    assert (r["rows"], r["nulls"], r["numbers"], r["min_value"], r["max_value"]) == (40_000, 40_000 - len(x), len(x), x.min(), x.max())
    assert abs(r["mean"] - x.mean()) < 1e-6 and abs(r["corr_with_label"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    for at, q in ((0.25, r["p25"]), (0.5, r["p50"]), (0.75, r["p75"])):
        assert abs((x < q).mean() - at) <= S.RANK_ERROR
    assert got["k"]["distinct_values"] == 50 and got["t"]["p50"] is None
    for r in S.audit(df, m, ["x", "k"], ["t"]).collect():
        assert (r["rank_error"] is None) == (r["column_name"] == "t") and (r["rank_error"] or 0) <= S.RANK_ERROR and r["distinct_error"] <= S.DISTINCT_ERROR
    sc = {r["column_name"]: r for r in S.scaler(m).collect()}["x"]
    filled = np.array([sc["median"] if r[1] is None else r[1] for r in data])
    assert abs(sc["mean"] - filled.mean()) < 1e-6 and abs(sc["std"] / filled.std() - 1) < 1e-9
    edges = {r["column_name"]: r["edges"] for r in S.bin_edges(m).collect()}
    assert edges["x"][0] == x.min() and edges["x"][-1] == x.max() and len(edges["x"]) == 11 and set(edges) == {"x", "k"}
    assert all(abs((x < e).mean() - i / 10) <= S.RANK_ERROR for i, e in enumerate(edges["x"][1:-1], 1))


def test_a_day_that_runs_again_replaces_itself(spark):
    folder = tempfile.mkdtemp(prefix="rebound-sketches-") + "/state"
    df = spark.createDataFrame(rows(3000, 4), ROW)
    S.write_days(sketched(df), folder)
    again = df.where(F.col("day") == D0).limit(10)
    S.write_days(sketched(again), folder)
    kept = df.where(F.col("day") != D0)
    total = {r["column_name"]: r["rows"] for r in S.merged(S.read_days(spark, folder)).collect()}
    assert total == {c: kept.count() + again.count() for c in ("x", "k", "t")}
    part = S.merged(S.read_days(spark, folder, D0 + dt.timedelta(days=1), D0 + dt.timedelta(days=3)))
    want = df.where(F.col("day").between(D0 + dt.timedelta(days=1), D0 + dt.timedelta(days=2))).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert [tuple(r) for r in part.where("column_name = 'x'").select("min_value", "max_value", "numbers").collect()] == [tuple(want)]


def test_missing_values_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(D0, nan, None, None, None), (D0, inf, None, "", True), (None, None, None, None, True)], ROW)
    got = {r["column_name"]: r for r in S.statistics(S.merged(sketched(df))).collect()}
    assert all((r["rows"], r["numbers"], r["p50"], r["mean"]) == (3, 0, None, None) for r in got.values())
    assert (got["x"]["nulls"], got["x"]["distinct_values"], got["t"]["nulls"], got["t"]["distinct_values"]) == (3, 0, 2, 1)
    assert S.scaler(S.merged(sketched(df))).count() == 0 and S.bin_edges(S.merged(sketched(df))).count() == 0
    assert S.statistics(S.merged(sketched(spark.createDataFrame([], ROW)))).count() == 0
