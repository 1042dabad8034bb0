"""Registered queries: explanations of an additive scorecard.

The explained model is an additive scorecard fitted on the train window:
score = g + sum_f (te_f(x) - g) / |F| over the smoothed target encodings of
four categorical features, so each feature's contribution is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebound.operators import explain as X
from rebound.operators import features as FE
from rebound.plans.catalog import dbl, register, round_doubles, sql_round
from rebound.plans.memo import memo
from rebound.plans.q_metrics import split_modeling, split_sql

SC_FEATURES = ["merchant_vertical", "merchant_country", "processor_name", "response_code"]
TOP_N = 3


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return memo(spark, ("scorecard", sf), lambda: _scorecard(spark, sf))


def _scorecard(spark: SparkSession, sf: str) -> DataFrame:
    sm = split_modeling(spark, sf)
    enc, g = FE.fit_target_encoding(sm.where(F.col("split") == "train"), SC_FEATURES, "y")
    test = FE.apply_target_encoding(sm.where(F.col("split") == "test"), enc, SC_FEATURES, g)
    k = float(len(SC_FEATURES))
    terms = [(f, F.col(f), (F.col(f"{f}__target_encoded") - F.lit(g)) / F.lit(k)) for f in SC_FEATURES]
    raw = {f: F.col(f) for f in SC_FEATURES}
    out = test.withColumn("contributions", X.contributions(terms, raw))
    return out.withColumn("explained_score", F.lit(g) + F.aggregate(
        "contributions", F.lit(0.0), lambda acc, c: acc + c["contribution"]))


def _cat(c: str) -> str:
    return f"coalesce(NULLIF(CAST({c} AS VARCHAR), ''), 'MISSING')"


_TEMPL = {
    "response_code": "'Response code `' || v || '` ' || d || ' the predicted retry recoverability.'",
    "processor_name": "'Processor `' || v || '` ' || d || ' the predicted retry recoverability.'",
    "merchant_country": "'Merchant country `' || v || '` ' || d || ' the predicted retry recoverability.'",
    "merchant_vertical": "'Merchant vertical `' || v || '` ' || d || ' the predicted retry recoverability.'",
}

SC_CTES = [
    ("gm", "SELECT avg(y) AS g FROM scored WHERE split = 'train'"),
    ("tl", " UNION ALL ".join(f"SELECT '{c}' AS feature, {_cat(c)} AS value, y FROM scored WHERE split = 'train'"
                              for c in SC_FEATURES)),
    ("enc", f"""
SELECT feature, value, (avg(y) * count(*) + (SELECT g FROM gm) * {dbl(20.0)}) / (count(*) + {dbl(20.0)}) AS encoding
FROM tl GROUP BY feature, value"""),
    ("contrib", " UNION ALL ".join(f"""
SELECT s.transaction_id, {i} AS pos, '{c}' AS feature, CAST(s.{c} AS VARCHAR) AS feature_value,
       CASE WHEN s.{c} IS NULL OR trim(CAST(s.{c} AS VARCHAR)) = '' THEN {dbl(0.0)}
            ELSE (coalesce(e.encoding, (SELECT g FROM gm)) - (SELECT g FROM gm)) / {dbl(float(len(SC_FEATURES)))} END
         AS contribution, s.probability
FROM scored s LEFT JOIN enc e ON e.feature = '{c}' AND e.value = {_cat('s.' + c)}
WHERE s.split = 'test'""" for i, c in enumerate(SC_FEATURES))),
    ("ranked", f"""
SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, pos) AS rank,
       CASE WHEN contribution = 0 THEN 'neutral' WHEN contribution > 0 THEN 'increase' ELSE 'decrease' END
         AS direction,
       CASE WHEN contribution > 0 THEN 'increased' ELSE 'decreased' END AS d, feature_value AS v
FROM contrib"""),
    ("phrased", f"""
SELECT *, CASE WHEN v IS NULL THEN 'Feature `' || feature || '` was not provided in the request; its contribution is treated as neutral.'
               WHEN contribution = 0 THEN 'Feature `' || feature || '` had no measurable contribution to the predicted retry recoverability.'
               {" ".join(f"WHEN feature = '{f}' THEN {t}" for f, t in _TEMPL.items())}
               ELSE 'Feature `' || feature || '` with value `' || v || '` ' || d || ' the predicted retry recoverability.'
          END AS business_explanation
FROM ranked"""),
]


@register("explanations", sql_round(["contribution"], split_sql(f"""
SELECT transaction_id, CAST(rank AS INTEGER) AS rank, feature, feature_value, contribution, direction,
       business_explanation
FROM phrased WHERE rank <= {TOP_N}""", SC_CTES)), ops=("X1", "X2", "X3", "X4", "X5"))
def q_explanations(spark, sf):
    e = X.explain(scorecard(spark, sf), "contributions", TOP_N)
    return round_doubles(X.explanation_rows(e, "transaction_id"))


@register("global_importance", sql_round(["mean_abs_contribution"], split_sql("""
SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM contrib GROUP BY feature""", SC_CTES)),
          ops=("X6",))
def q_global_importance(spark, sf):
    return round_doubles(X.global_importance(scorecard(spark, sf), "contributions"))


@register("explained_top_rows", sql_round(["explained_score", "contribution"], split_sql("""
SELECT t.row_rank, p.transaction_id, t.explained_score, CAST(p.rank AS INTEGER) AS rank, p.feature,
       p.contribution, p.business_explanation
FROM (SELECT transaction_id, explained_score,
             row_number() OVER (ORDER BY explained_score DESC, transaction_id) AS row_rank
      FROM (SELECT transaction_id, (SELECT g FROM gm) + sum(contribution ORDER BY pos) AS explained_score
            FROM contrib GROUP BY transaction_id) AS s) AS t
JOIN phrased p USING (transaction_id)
WHERE t.row_rank <= 20 AND p.rank <= 5""", SC_CTES)), ops=("X7", "W4"))
def q_explained_top_rows(spark, sf):
    s = scorecard(spark, sf)
    top = (s.orderBy(F.col("explained_score").desc(), "transaction_id").limit(20)
           # a window over the 20 rows kept by the top-k (bounded)
           .withColumn("row_rank", F.row_number().over(
               Window.orderBy(F.col("explained_score").desc(), "transaction_id")).cast("bigint")))
    e = X.explain(top, "contributions", 5)
    rows = e.select("row_rank", "transaction_id", "explained_score",
                    F.explode("top_explanation_features").alias("x")).select(
        "row_rank", "transaction_id", "explained_score", "x.rank", "x.feature", "x.contribution",
        "x.business_explanation")
    return round_doubles(rows)
