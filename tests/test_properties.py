"""Properties: invariances and additivity."""
import random

import pytest
from pyspark.sql import functions as F

from rebound.operators import drift, metrics, ordered
from rebound.operators import model as MD


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(7)
    rows = [(i, int(rnd.random() < 0.3), round(rnd.random(), 2)) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, y int, p double")


def test_auc_bounds_and_monotone_invariance(spark, scores):
    a = metrics.auc(scores, "y", "p").first()["auc"]
    b = metrics.auc(scores.withColumn("q", F.exp(F.col("p") * 3) - 7), "y", "q").first()["auc"]
    assert 0.0 <= a <= 1.0 and a == pytest.approx(b, abs=1e-12)


def test_auc_matches_bruteforce(spark, scores):
    rows = scores.collect()
    pos = [r["p"] for r in rows if r["y"] == 1]
    neg = [r["p"] for r in rows if r["y"] == 0]
    u = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    assert metrics.auc(scores, "y", "p").first()["auc"] == pytest.approx(u / (len(pos) * len(neg)))


def test_auc_invariant_to_partitions_and_buckets(spark, scores):
    base = metrics.auc(scores, "y", "p").first()["auc"]
    for parts in (1, 4, 32):
        assert metrics.auc(scores.repartition(parts), "y", "p").first()["auc"] == pytest.approx(base)
    # force many prefix buckets
    collapsed = scores.groupBy(F.col("p").alias("__s")).agg(F.sum("y").alias("pos"),
                                                           F.sum(F.lit(1) - F.col("y")).alias("neg"))
    pre = ordered.prefix_sums(collapsed, "__s", ["neg"], buckets=90)
    one = ordered.prefix_sums(collapsed, "__s", ["neg"])
    a = sorted((r["__s"], r["neg_before"]) for r in pre.collect())
    b = sorted((r["__s"], r["neg_before"]) for r in one.collect())
    assert a == b


def test_exact_quantiles_match_numpy(spark, scores):
    import numpy as np
    vals = np.array([r["p"] for r in scores.collect()])
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ordered.exact_quantiles(scores, "p", qs)[()]
    assert got == pytest.approx(list(np.quantile(vals, qs)), abs=1e-12)
    narrow = ordered.order_statistics(scores, "p", {(): [0, 999, 1999]}, fanout=4)
    s = sorted(vals)
    assert [narrow[((), k)] for k in (0, 999, 1999)] == [s[0], s[999], s[1999]]


def test_psi_js_zero_for_identical(spark, scores):
    t = drift.drift_table(scores, scores, ["p"], [])
    r = t.first()
    assert r["psi"] == pytest.approx(0.0, abs=1e-12) and r["ks_stat"] == 0.0 and r["p_value"] == 1.0


def test_split_sizes_and_order(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "transaction_id long, timestamp timestamp")
    s = metrics.temporal_split(df)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 700, "validation": 150, "test": 150}
    mx = {r["split"]: r["mx"] for r in s.groupBy("split").agg(F.max("timestamp").alias("mx")).collect()}
    mn = {r["split"]: r["mn"] for r in s.groupBy("split").agg(F.min("timestamp").alias("mn")).collect()}
    assert mx["train"] <= mn["validation"] and mx["validation"] <= mn["test"]


def test_isotonic_monotone_and_tree_additivity(spark):
    rnd = random.Random(3)
    rows = [(i, float(rnd.random() * 1000), rnd.choice(["a", "b", "c"]), 0) for i in range(600)]
    rows = [(i, a, c, int((a > 500) ^ (c == "a") ^ (rnd.random() < 0.1))) for i, a, c, _ in rows]
    df = spark.createDataFrame(rows, "id long, amount double, cat string, y int")
    m = MD.fit_gbt(df, ["amount"], ["cat"], "y", max_iter=8)
    scored = MD.apply_model(m, df, "p", ["amount"], ["cat"])
    iso = MD.fit_isotonic(scored, "p", "y")
    cal = MD.apply_isotonic(iso, scored, "p").select("p", "calibrated_probability").collect()
    pairs = sorted((r["p"], r["calibrated_probability"]) for r in cal)
    assert all(b1 <= b2 + 1e-12 for (_, b1), (_, b2) in zip(pairs, pairs[1:]))
    prep = MD.prepare_gbt_input(df, ["amount"], ["cat"])
    c = MD.tree_contributions(m, prep, ["amount", "cat"], "id")
    from pyspark.ml.functions import vector_to_array
    raw = m.transform(prep).select("id", vector_to_array("__raw")[1].alias("raw"))
    worst = c.join(raw, "id").agg(F.max(F.abs(F.col("margin") - F.col("raw")))).first()[0]
    assert worst < 1e-9


def test_logistic_contributions_additive(spark):
    from pyspark.ml.functions import vector_to_array
    from rebound.operators import explain as X
    rnd = random.Random(11)
    rows = [(i, rnd.random(), rnd.random(), int(rnd.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    m = MD.fit_logistic(df, ["a", "b"], "y", l2=0.01)
    lr = m.stages[-1]
    w = dict(zip(["a", "b"], lr.coefficients.toArray().tolist()))
    means = {r[0]: r[1] for r in [("a", df.agg(F.avg("a")).first()[0]), ("b", df.agg(F.avg("b")).first()[0])]}
    terms = X.linear_terms(w, means)
    base = lr.intercept + sum(w[f] * means[f] for f in w)
    out = m.transform(df).withColumn("c", X.contributions(terms)).select(
        vector_to_array("__raw")[1].alias("margin"),
        (F.lit(base) + F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x["contribution"])).alias("sum"))
    assert out.agg(F.max(F.abs(F.col("margin") - F.col("sum")))).first()[0] < 1e-9


def test_one_hot_numeric_bool_and_scale_settings(spark):
    from rebound.functions.parse import parse_bool_lenient_numeric
    from rebound.operators.features import one_hot
    from rebound.session import scale_settings
    df = spark.createDataFrame([("US", 0), ("FR", 2), (None, None)], "c string, n int")
    oh = df.select(*[v.alias(k) for k, v in one_hot("c", ["US"]).items()],
                   parse_bool_lenient_numeric("n").alias("b")).collect()
    assert [(r["c__US"], r["c__OTHER"], r["b"]) for r in oh] == [(1, 0, False), (0, 1, True), (0, 1, False)]
    s = scale_settings(100e12)
    assert int(s["spark.sql.shuffle.partitions"]) > 16000 and s["spark.sql.adaptive.enabled"] == "true"


def test_decisions_invariant_to_partitions(spark):
    from conftest import SF_SMALL
    from rebound.operators import decide
    from rebound.plans import fixture as fx
    d = fx.declines(spark, SF_SMALL).withColumn("p", decide.rule_probability())
    timing = decide.fit_timing_table(fx.retry_cells(spark, SF_SMALL), fx.declines(spark, SF_SMALL), weight="weight")
    cols = ["transaction_id", "recommended_action", "scope_reason", "recoverability_score", "expected_value",
            "confidence", "recommended_delay_hours", "attempt_decision_reason"]
    res = []
    for parts in (1, 4, 32):
        t = decide.decision_table(d.repartition(parts), "p", timing.repartition(parts), amount_cap=4000.0)
        res.append(sorted(tuple(r) for r in t.select(*cols).collect()))
    assert res[0] == res[1] == res[2] and len(res[0]) > 0


def test_cosine_top_k_with_filter_matches_bruteforce(spark):
    import numpy as np
    from conftest import SF_SMALL
    from rebound.operators import retrieval as R
    from rebound.sources import read_table
    emb = read_table(spark, SF_SMALL, "embeddings", ["vec_id", "embedding", "label"])
    q = R.centroids(emb, "label", "embedding").where("label IN (1, 2)")
    top = R.top_k_cosine(emb, q, "vec_id", "embedding", "label", "query_vector", 3,
                         where=F.col("label") == 3)
    got = {(r["query_id"], r["candidate_id"]) for r in top.collect()}
    rows = emb.collect()
    vecs = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    labels = {r["vec_id"]: r["label"] for r in rows}
    exp = set()
    for qr in q.collect():
        qv = np.array(qr["query_vector"])
        sc = sorted(((-(v @ qv) / (np.linalg.norm(v) * np.linalg.norm(qv)), i)
                     for i, v in vecs.items() if labels[i] == 3))
        exp |= {(qr["label"], i) for _, i in sc[:3]}
    assert got == exp and len(got) == 6


def test_frontier_agrees_with_policy_summary(spark):
    from conftest import SF_MID
    from rebound.operators import decide
    from rebound.plans.q_metrics import split_modeling
    sm = split_modeling(spark, SF_MID)
    fr = {r["threshold"]: r for r in metrics.net_value_frontier(sm, "y", "probability").collect()}
    t = 0.05
    ps = decide.policy_summary(decide.score_policy(sm, "probability", "rules", t)).first()
    row = fr[t]
    assert (row["retry_count"], row["recovered_count"]) == (ps["retry_count"], ps["recovered_count"])
    assert row["realized_net_value_usd"] == pytest.approx(ps["realized_net_value_usd"], rel=1e-12)
