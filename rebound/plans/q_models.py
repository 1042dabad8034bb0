"""Registered model queries (L1-L7, X1, M9): rows-only checks (no SQL oracle).

Models learn ``target_recovered_by_retry``, the label the tables give.  (It
is nearly independent of the features in the test tables; that the learners
find a signal where there is one is tested on a planted label in the tests.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound.operators import explain as X
from rebound.operators import features as FE
from rebound.operators import metrics as M
from rebound.operators import model as MD
from rebound.plans.catalog import register, round_doubles
from rebound.plans.memo import memo
from rebound.plans.q_metrics import split_modeling

NUM = ["amount_usd"]
CAT = ["response_code", "merchant_country", "merchant_vertical"]
LABEL = "recovered"


def data(spark: SparkSession, sf: str) -> DataFrame:
    return split_modeling(spark, sf).withColumn(LABEL, F.col("target_recovered_by_retry").cast("int"))


def gbt(spark: SparkSession, sf: str):
    def build():
        d = data(spark, sf).where(F.col("split").isin("train", "validation"))
        return MD.fit_gbt(d.withColumn("__is_val", F.col("split") == "validation"), NUM, CAT, LABEL,
                          validation_col="__is_val", max_iter=40)
    return memo(spark, ("gbt", sf), build)


def logistic_inputs(spark: SparkSession, sf: str):
    """v2-style design: scaled amount + smoothed target encodings (fit on train)."""
    def build():
        d = data(spark, sf)
        train = d.where(F.col("split") == "train")
        stats = FE.fit_numeric_scaler(train, NUM)
        enc, g = FE.fit_target_encoding(train, CAT, LABEL)
        x = FE.apply_numeric_scaler(FE.apply_target_encoding(d, enc, CAT, g), stats, NUM)
        return x
    return memo(spark, ("lr_inputs", sf), build)


LR_FEATURES = NUM + [f"{c}__target_encoded" for c in CAT]


def logistic(spark: SparkSession, sf: str):
    def build():
        x = logistic_inputs(spark, sf)
        return MD.fit_logistic(x.where(F.col("split") == "train"), LR_FEATURES, LABEL)
    return memo(spark, ("lr", sf), build)


def _bundle(df: DataFrame, score: str, name: str) -> DataFrame:
    return M.metric_bundle(df, LABEL, score, 0.5).select(
        F.lit(name).alias("model"), "rows", "auc", "log_loss", "brier", "precision", "recall", "f1")


@register("model_quality", None, ops=("L1", "L2", "L3", "L4", "M9"))
def q_model_quality(spark, sf):
    test = data(spark, sf).where(F.col("split") == "test")
    g = MD.apply_model(gbt(spark, sf), test, "gbt_p", NUM, CAT)
    x = logistic_inputs(spark, sf)
    lr = MD.apply_model(logistic(spark, sf), x.where(F.col("split") == "test"), "lr_p")
    val = MD.apply_model(gbt(spark, sf), data(spark, sf).where(F.col("split") == "validation"), "gbt_p", NUM, CAT)
    iso = MD.fit_isotonic(val, "gbt_p", LABEL)
    cal = MD.apply_isotonic(iso, g, "gbt_p", "gbt_cal")
    out = (_bundle(test, "probability", "rules").unionByName(_bundle(g, "gbt_p", "gbt"))
           .unionByName(_bundle(lr, "lr_p", "logistic_v2")).unionByName(_bundle(cal, "gbt_cal", "gbt_isotonic")))
    return round_doubles(out)


@register("model_importance", None, ops=("L5", "L6"))
def q_model_importance(spark, sf):
    imp = MD.importance_table(gbt(spark, sf), NUM + CAT)
    w = MD.signed_weights(logistic(spark, sf), LR_FEATURES, 15)
    rows = ([("gbt_gain", f, v) for f, v in imp] + [("logistic_top", f, v) for f, v in w["top"]]
            + [("logistic_bottom", f, v) for f, v in w["bottom"]])
    # a handful of model parameters (one per feature) read off the fitted models
    return spark.createDataFrame(rows, T.StructType([T.StructField("kind", T.StringType()),
                                                     T.StructField("feature", T.StringType()),
                                                     T.StructField("value", T.DoubleType())]))


@register("tree_explanations", None, ops=("X1", "X3", "X4", "X5"))
def q_tree_explanations(spark, sf):
    test = data(spark, sf).where(F.col("split") == "test")
    prep = MD.prepare_gbt_input(test, NUM, CAT)
    c = MD.tree_contributions(gbt(spark, sf), prep, NUM + CAT, "transaction_id")
    names = NUM + CAT
    j = c.join(test.select("transaction_id", *names), "transaction_id")
    terms = [(f, F.col(f), F.col("contributions")[i]) for i, f in enumerate(names)]
    e = X.explain(j.withColumn("__c", X.contributions(terms)), "__c", 3)
    return round_doubles(X.explanation_rows(e.select("transaction_id", "top_explanation_features"),
                                            "transaction_id"))


@register("threshold_search", None, ops=("L7", "D5", "W1"))
def q_threshold_search(spark, sf):
    """Regularisation grid for the logistic model, scored by the best
    net value on time-ordered expanding folds of the train + validation rows."""
    d = data(spark, sf).where(F.col("split").isin("train", "validation"))
    folds = MD.time_folds(d, "timestamp", "transaction_id", n_folds=2)

    def fit(tr, l2):
        # encoders are refitted inside each fold's earlier window (no leakage)
        stats = FE.fit_numeric_scaler(tr, NUM)
        enc, g = FE.fit_target_encoding(tr, CAT, LABEL)
        x = FE.apply_numeric_scaler(FE.apply_target_encoding(tr, enc, CAT, g), stats, NUM)
        return stats, enc, g, MD.fit_logistic(x, LR_FEATURES, LABEL, l2=l2)

    def score(m, v):
        stats, enc, g, model = m
        x = FE.apply_numeric_scaler(FE.apply_target_encoding(v, enc, CAT, g), stats, NUM)
        return MD.apply_model(model, x, "p")

    def objective(scored):
        f = M.net_value_frontier(scored, LABEL, "p")
        return M.best_net_value_threshold(f).first()["best_net_value_usd"]

    grid = [{"l2": 0.0}, {"l2": 0.002}, {"l2": 0.1}]
    best, _, results = MD.grid_search_net_value(folds, fit, grid, score, objective)
    return spark.createDataFrame([(float(p["l2"]), float(v), p == best) for p, v in results],
                                 "l2 double, mean_validation_net_value_usd double, chosen boolean")
