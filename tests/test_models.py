"""Models: both learners beat the rules on a planted label, and run on the given one."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from rebound.plans import memo, q_models


def planted_label(df):
    """Logistic in code, amount and country, noise from the md5 of the id."""
    u = F.conv(F.substring(F.md5(F.col("transaction_id").cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    logit = (F.lit(-2.0) + F.when(F.col("response_code").isin("91", "51"), 1.5).otherwise(0.0) + F.col("amount_usd") / F.lit(1000.0)
             - F.when(F.col("merchant_country").isin("NATION_1", "NATION_2", "NATION_3"), 1.0).otherwise(0.0))
    return (u < F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).cast("int")


def test_models_beat_rules_on_planted_label(spark, monkeypatch):
    memo.clear()
    monkeypatch.setattr(q_models, "data", lambda s, sf: q_models.split_modeling(s, sf).withColumn(q_models.LABEL, planted_label(q_models.split_modeling(s, sf))))
    rows = {r["model"]: r for r in E.queries()["model_quality"](spark, SF_MID).collect()}
    memo.clear()
    assert set(rows) == {"rules", "gbt", "logistic_v2", "gbt_isotonic"}
    for m in ("gbt", "logistic_v2", "gbt_isotonic"):
        assert rows[m]["auc"] > rows["rules"]["auc"] + 0.05
        assert rows[m]["log_loss"] < rows["rules"]["log_loss"]


def test_models_run_on_the_given_label(spark):
    rows = {r["model"]: r for r in E.queries()["model_quality"](spark, SF_MID).collect()}
    assert all(0.3 < r["auc"] < 0.7 and r["rows"] > 500 for r in rows.values())


def _answer(nodes, x, known):
    """What a tree says when only ``known`` features may be looked at: both sides count by their training rows otherwise."""
    def at(i):
        n = nodes[i]
        if n["leaf"]:
            return n["pred"]
        if n["feat"] in known:
            kind, arg = n["rule"]
            v = x[n["feat"]]
            return at(n["l"] if (v <= arg if kind == "le" else v in arg) else n["r"])
        return sum(at(c) * nodes[c]["cover"] for c in (n["l"], n["r"])) / n["cover"]
    return at(0)


def _all_subsets(nodes, x, d):
    """Shapley values by listing every subset of features."""
    from itertools import combinations
    from math import factorial
    out = [0.0] * d
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for k in range(d):
            for s in combinations(others, k):
                gain = _answer(nodes, x, {*s, i}) - _answer(nodes, x, set(s))
                out[i] += factorial(k) * factorial(d - 1 - k) / factorial(d) * gain
    return out


def _random_tree(rng, d, depth):
    """A node table with repeated features on a path, sets of categories and sides that no row took."""
    nodes = []

    def grow(cover, left):
        i = len(nodes)
        nodes.append({})
        if left == 0 or rng.random() < 0.15:
            nodes[i] = {"leaf": True, "pred": rng.uniform(-2, 2), "cover": cover}
            return i
        f = rng.randrange(d)
        rule = ("le", rng.uniform(0, 4)) if f % 2 else ("in", sorted(rng.sample([0.0, 1.0, 2.0, 3.0, 4.0], 2)))
        part = rng.choice([0.0, 1.0, rng.random(), rng.random()])
        a, b = grow(cover * part, left - 1), grow(cover * (1 - part), left - 1)
        nodes[i] = {"leaf": False, "pred": 0.0, "cover": cover, "feat": f, "rule": rule, "l": a, "r": b}
        return i

    grow(100.0, depth)
    return nodes


def test_tree_values_equal_all_subsets():
    import random

    import numpy as np

    from rebound.operators.treeshap import TreeShap, expected_value
    rng, d = random.Random(3), 6
    for depth in (0, 1, 3, 6):
        trees = []
        while len(trees) < 3:  # the brute force divides by covers: only trees where every inner node was reached
            t = _random_tree(rng, d, depth)
            if all(n["leaf"] or n["cover"] > 0 for n in t):
                trees.append(t)
        weights = [1.0, 0.05, -2.0]
        x = np.array([[float(rng.randrange(5)) for _ in range(d)] for _ in range(12)])
        shap = TreeShap(trees, weights)
        for row, got in zip(x, shap(x)):
            want = np.sum([w * np.array(_all_subsets(t, row, d)) for t, w in zip(trees, weights)], axis=0)
            assert np.allclose(got, want, atol=1e-12)
            assert abs(shap.bias + got.sum() - sum(w * _answer(t, row, set(range(d))) for t, w in zip(trees, weights))) < 1e-12
        assert abs(shap.bias - sum(w * _answer(t, x[0], set()) for t, w in zip(trees, weights))) < 1e-12
        assert abs(expected_value(trees[0]) - _answer(trees[0], x[0], set())) < 1e-12


def test_tree_values_of_a_fitted_model(spark):
    """All subsets, on a model with a numeric and a many-valued category column; additive, and equal to the model's margin."""
    from pyspark.ml.functions import vector_to_array

    from rebound.operators import model as MD
    rows = [(i, f"c{i % 12}", float((i * 37) % 101), int((i * 37) % 101 > 50 or i % 12 < 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, cat string, num double, y int")
    m = MD.fit_gbt(df, ["num"], ["cat"], "y", max_iter=5)
    prep = MD.prepare_gbt_input(df, ["num"], ["cat"]).withColumn("bias", df["num"])
    trees, weights = MD.extract_trees(m)
    assert all(abs(n["cover"] - t[n["l"]]["cover"] - t[n["r"]]["cover"]) < 1e-9 for t in trees for n in t if not n["leaf"])
    scored = m.transform(prep).select("id", vector_to_array("__features").alias("x"), vector_to_array("__raw").alias("raw"))
    xs = {r["id"]: (r["x"], r["raw"][1]) for r in scored.collect()}
    got = MD.tree_contributions(m, prep, ["num", "cat"], "id").collect()
    assert len(got) == 600
    for r in got:
        x, raw = xs[r["id"]]
        want = [sum(w * v for w, v in zip(weights, vs)) for vs in zip(*(_all_subsets(t, x, 2) for t in trees))]
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["contributions"], want))
        assert abs(r["margin"] - r["bias"] - sum(r["contributions"])) < 1e-12
        assert abs(r["margin"] - raw) < 1e-9


def test_model_importance(spark):
    imp = E.queries()["model_importance"](spark, SF_MID).collect()
    assert {r["kind"] for r in imp} == {"gbt_gain", "logistic_top", "logistic_bottom"}
    assert abs(sum(r["value"] for r in imp if r["kind"] == "gbt_gain") - 1.0) < 1e-9


def test_time_folds_expanding(spark):
    import datetime as dt
    from rebound.operators import model as MD
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(90)]
    df = spark.createDataFrame(rows, "transaction_id long, timestamp timestamp")
    folds = MD.time_folds(df, "timestamp", "transaction_id", 2)
    sizes = [(tr.count(), va.count()) for tr, va in folds]
    assert sizes == [(30, 30), (60, 30)]
    tr, va = folds[0]
    assert tr.agg({"timestamp": "max"}).first()[0] < va.agg({"timestamp": "min"}).first()[0]


def test_threshold_search_rows(spark):
    from conftest import SF_SMALL
    rows = E.queries()["threshold_search"](spark, SF_SMALL).collect()
    assert len(rows) == 3 and sum(r["chosen"] for r in rows) == 1
