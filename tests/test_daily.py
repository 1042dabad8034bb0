"""Mergeable daily state against recomputation from raw rows, and scores that are missing."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rebound.operators import daily, decide, metrics

SCHEMA = "id long, day date, y boolean, a double, b double, v double"
D0 = dt.date(2024, 1, 1)
MODELS = ("a", "b")
EDGES = [0.0, 1.0, 2.0, 4.0]


def rows_of(seed, days=range(6), n=40):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, float("nan"), *[round(rng.random(), 2) for _ in range(12)]])
    return [(100 * d + i, D0 + dt.timedelta(days=d), rng.choice([True, False, False, None]), score(), score(), rng.choice([None, float("nan"), -1.0, 4.0, 9.0, rng.uniform(0, 4)]))
            for d in days for i in range(n)]


def write(spark, rows, folder, days):
    df = spark.createDataFrame(rows, SCHEMA)
    named = [D0 + dt.timedelta(days=d) for d in days]
    daily.write_days(daily.day_scores(df, F.col("day"), F.col("y"), {m: F.col(m) for m in MODELS}), f"{folder}/scores", named)
    daily.write_days(daily.day_bins(df, F.col("day"), {"v": (F.col("v"), EDGES)}), f"{folder}/bins", named)
    daily.write_days(daily.day_deltas(df, F.col("day"), F.col("a"), F.col("b"), 0.2), f"{folder}/deltas", named)


def reports(spark, folder, first=None, last=None):
    read = lambda n: daily.read_days(spark, f"{folder}/{n}", first, last)
    q = {r["model"]: r.asDict() for r in daily.merged_quality(read("scores")).collect()}
    p = daily.merged_psi(read("bins"), F.col("day") < F.lit(D0 + dt.timedelta(days=3)), {"v": 3}).collect()
    return q, [tuple(r) for r in p], tuple(daily.merged_deltas(read("deltas")).first())


def brute(rows):
    ok = lambda x: x is not None and not math.isnan(x)
    quality = {}
    for m, k in (("a", 3), ("b", 4)):
        s = [(r[k], int(bool(r[2]))) for r in rows if ok(r[k])]
        pos, neg = [p for p, y in s if y], [p for p, y in s if not y]
        clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
        quality[m] = {"model": m, "rows": len(s), "unscored_rows": len(rows) - len(s), "positives": len(pos),
                      "log_loss": sum(-math.log(clip(p) if y else 1 - clip(p)) for p, y in s) / len(s), "brier": sum((p - y) ** 2 for p, y in s) / len(s),
                      "auc": sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)),
                      "ks": max(abs(sum(p <= t for p in pos) / len(pos) - sum(p <= t for p in neg) / len(neg)) for t, _ in s)}
    bins = [[0, 0, 0], [0, 0, 0]]
    for r in rows:
        if ok(r[5]) and 0 <= r[5] <= 4:
            bins[r[1] >= D0 + dt.timedelta(days=3)][min(sum(r[5] >= e for e in EDGES[1:]), 2)] += 1
    share = [[max(c / sum(b), 1e-6) for c in b] if sum(b) else None for b in bins]
    psi = sum((a - e) * math.log(a / e) for e, a in zip(*share)) if all(share) else None
    d = [r[4] - r[3] for r in rows if ok(r[3]) and ok(r[4])]
    deltas = (len(d), sum(d) / len(d), sum(map(abs, d)) / len(d), sum(round(abs(x), 9) > 0.2 for x in d) / len(d))
    return quality, [("v", sum(bins[0]), sum(bins[1]), psi)], deltas


def same(got, want):
    assert set(got[0]) == set(want[0])
    for m in want[0]:
        for k, v in want[0][m].items():
            assert got[0][m][k] == (v if k == "model" else pytest.approx(v, rel=1e-9)), (m, k)
    assert len(got[1]) == 1 and got[1][0][:3] == want[1][0][:3] and got[1][0][3] == pytest.approx(want[1][0][3], rel=1e-9)
    assert got[2] == pytest.approx(want[2], rel=1e-9)


def test_merged_days_equal_recomputation_and_a_rerun_replaces_its_day(spark, tmp_path):
    rows = rows_of(1)
    for d in range(6):  # night by night
        write(spark, [r for r in rows if r[1] == D0 + dt.timedelta(days=d)], tmp_path, [d])
    same(reports(spark, tmp_path), brute(rows))
    again = rows_of(2, [4], 25)
    write(spark, again, tmp_path, [4])
    write(spark, again, tmp_path, [4])
    kept = [r for r in rows if r[1] != again[0][1]] + again
    same(reports(spark, tmp_path), brute(kept))
    window = [r for r in kept if dt.date(2024, 1, 2) <= r[1] <= dt.date(2024, 1, 5)]
    same(reports(spark, tmp_path, dt.date(2024, 1, 2), dt.date(2024, 1, 5)), brute(window))


def test_rows_of_other_days_are_not_written_and_an_empty_day_is_emptied(spark, tmp_path):
    rows = rows_of(3, range(4))
    write(spark, rows, tmp_path, [0, 1, 2, 3])
    write(spark, rows_of(9, [0, 1]), tmp_path, [2])  # nothing of day 2 is left; days 0 and 1 are not this night's
    same(reports(spark, tmp_path), brute([r for r in rows if r[1] != dt.date(2024, 1, 3)]))
    before = sorted(p.name for p in (tmp_path / "scores").rglob("*.parquet"))
    daily.write_days(daily.day_scores(spark.createDataFrame(rows, SCHEMA), F.col("day"), F.col("y"), {m: F.col(m) for m in MODELS}), f"{tmp_path}/scores", [])
    assert sorted(p.name for p in (tmp_path / "scores").rglob("*.parquet")) == before


def test_a_range_reads_its_own_partitions(spark, tmp_path):
    write(spark, rows_of(4, range(3)), tmp_path, [0, 1, 2])
    plan = daily.read_days(spark, f"{tmp_path}/scores", D0, D0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


# ---------------------------------------------------------------- missing scores, by hand
def scores(spark):
    return spark.createDataFrame([(1, 0.9, 100.0), (0, 0.1, 100.0), (1, None, 100.0), (1, float("nan"), 100.0), (0, 0.5, 100.0)], "y int, p double, amount_usd double")


def test_bundle_leaves_missing_scores_out(spark):
    r = metrics.metric_bundle(scores(spark), "y", "p", 0.5).first()
    assert (r["rows"], r["unscored_rows"], r["positives"]) == (3, 2, 1)
    assert r["brier"] == pytest.approx((0.01 + 0.01 + 0.25) / 3)
    assert r["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.9) + math.log(0.5)) / 3)
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0) and r["predicted_positive_rate"] == pytest.approx(2 / 3)
    assert r["auc"] == 1.0


def test_no_score_at_all(spark):
    r = metrics.metric_bundle(scores(spark).where("p IS NULL"), "y", "p", 0.5).first()
    assert (r["rows"], r["unscored_rows"], r["positives"], r["brier"], r["auc"]) == (0, 1, 0, None, None)


def test_sweep_and_frontier_leave_missing_scores_out(spark):
    t = {round(r["threshold"], 2): (r["tp"], r["fp"], r["fn"]) for r in metrics.threshold_sweep(scores(spark), "y", "p").collect()}
    assert t[0.05] == (1, 2, 0) and t[0.2] == (1, 1, 0) and t[0.5] == (1, 1, 0)
    f = {round(r["threshold"], 2): (r["retry_count"], r["recovered_count"]) for r in metrics.net_value_frontier(scores(spark), "y", "p").collect()}
    assert f[0.05] == (3, 1) and f[0.2] == (2, 1)


def test_decision_without_a_score(spark):
    df = spark.createDataFrame([(1, "51", 100.0, None), (2, "51", 100.0, float("nan")), (3, "51", 100.0, 0.9)], "transaction_id long, response_code string, amount_usd double, p double")
    df = df.selectExpr("*", "'CA' merchant_country", "'retail' merchant_vertical", "'adyen' processor_name", "true is_soft_decline")
    timing = spark.createDataFrame([], "timing_code string, timing_attempt int, code_prior double, delay_probs array<double>")
    vocab = {"merchant_country": ["CA"], "merchant_vertical": ["retail"], "processor_name": ["adyen"]}
    got = {r["transaction_id"]: r for r in decide.decision_table(df, "p", timing, vocab=vocab).collect()}
    for i in (1, 2):
        assert got[i]["recommended_action"] == "do_not_retry" and got[i]["confidence"] is None and got[i]["recoverability_score"] is None
        assert "recoverability score is missing" in got[i]["attempt_decision_reason"]
    assert got[3]["recommended_action"] == "retry" and got[3]["confidence"] == 1.0
