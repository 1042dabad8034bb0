"""Nightly reconciliation from mergeable daily state.

Each night the scored rows of a day are reduced to tables whose rows add up:

* ``scores``  (day, model, score, pos, neg): rows by score and outcome.  Scores
  are rounded to ``digits`` places, which bounds a day at 10^digits rows a model;
* ``bins``    (day, feature, bucket, n): rows by the baseline's bins;
* ``deltas``  (day, n, sums): challenger score minus champion score.

They are written partitioned by day with dynamic overwrite, so a day that runs
again replaces itself and touches no other.  Every day that is named gets a
marker row, so a day whose rows are gone is emptied as well.  AUC, KS, log loss,
Brier, PSI and deltas over any range of days come from the merged counts and
equal a recomputation from the raw rows; those are never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators.metrics import auc_of_counts
from rebound.operators.ordered import count_below, prefix_sums

SCORE_DIGITS = 6


def _scored(c: Column) -> Column:
    """NaN is missing."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------- one night
def day_scores(rows: DataFrame, day: Column, label: Column, models: dict[str, Column], digits: int = SCORE_DIGITS) -> DataFrame:
    """(day, model, score, pos, neg); the row of score NULL counts what has no score."""
    y, scale = F.coalesce(label.cast("int"), F.lit(0)), 10.0 ** digits
    options = F.array(*[F.struct(F.lit(m).alias("model"), (F.floor(_scored(c) * scale + 0.5) / scale).alias("score")) for m, c in models.items()])
    return (rows.select(day.alias("day"), y.alias("y"), F.explode(options).alias("m"))
            .groupBy("day", "m.model", "m.score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))


def day_bins(rows: DataFrame, day: Column, features: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """(day, feature, bucket, n) by fixed edges; the last edge belongs to the last bin, values outside and missing ones have bucket NULL."""
    def bucket(c: Column, edges: Sequence[float]) -> Column:
        v, arr, last = _scored(c), F.array(*[F.lit(float(e)) for e in edges]), len(edges) - 2
        below = count_below(arr, v, len(edges))
        b = F.least(F.when(F.get(arr, below) == v, below).otherwise(below - 1), F.lit(last))
        return F.when((v >= float(edges[0])) & (v <= float(edges[-1])), b).cast("int")

    options = F.array(*[F.struct(F.lit(f).alias("feature"), bucket(c, e).alias("bucket")) for f, (c, e) in features.items()])
    return (rows.select(day.alias("day"), F.explode(options).alias("f")).groupBy("day", "f.feature", "f.bucket")
            .agg(F.count(F.lit(1)).alias("n")))


def day_deltas(rows: DataFrame, day: Column, champion: Column, challenger: Column, limit: float) -> DataFrame:
    """(day, n, delta_sum, abs_sum, over): the challenger's differences, where both scored."""
    d = (_scored(challenger) - _scored(champion)).cast("decimal(20,12)")
    return (rows.select(day.alias("day"), d.alias("d")).where(F.col("d").isNotNull()).groupBy("day")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("delta_sum"), F.sum(F.abs("d")).alias("abs_sum"),
                 F.count_if(F.abs("d") > F.lit(limit).cast("decimal(20,12)")).alias("over")))


def write_days(state: DataFrame, folder: str, days: Sequence) -> None:
    """Replace the partitions of ``days`` (dates) with their rows of ``state``; other days stay as they are."""
    if not days:
        return
    spark = state.sparkSession
    named = spark.createDataFrame([(d,) for d in days], "day date")
    rows = state.join(F.broadcast(named), "day")  # one row per night that runs
    marked = rows.withColumn("is_marker", F.lit(False)).unionByName(named.withColumn("is_marker", F.lit(True)), allowMissingColumns=True)
    (marked.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder))


def read_days(spark: SparkSession, folder: str, first=None, last=None) -> DataFrame:
    """The state of the days in [first, last]; only their partitions are read."""
    rows = spark.read.parquet(folder)
    for bound, keep in ((first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
        if bound is not None:
            rows = rows.where(keep)
    return rows.where(~F.col("is_marker")).drop("is_marker")


# ---------------------------------------------------------------- reports from merged state
def merged_quality(scores: DataFrame) -> DataFrame:
    """Per model: rows, unscored rows, positives, AUC, KS between the outcomes' scores, log loss and Brier; NULL without scored rows."""
    counts = scores.groupBy("model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = F.col("score"), F.col("pos") + F.col("neg")
    pc = F.least(F.greatest(p, F.lit(C.LOG_LOSS_EPS)), F.lit(1 - C.LOG_LOSS_EPS))
    has = p.isNotNull()
    total = F.sum(F.when(has, n))
    plain = counts.groupBy("model").agg(
        F.coalesce(total, F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~has, n)), F.lit(0)).alias("unscored_rows"),
        F.coalesce(F.sum(F.when(has, F.col("pos"))), F.lit(0)).alias("positives"),
        (F.sum(F.when(has, -(F.col("pos") * F.log(pc) + F.col("neg") * F.log(F.lit(1.0) - pc)))) / total).alias("log_loss"),
        (F.sum(F.col("pos") * F.pow(p - 1, 2) + F.col("neg") * F.pow(p, 2)) / total).alias("brier"))
    known = counts.where(has)
    ranked = prefix_sums(known, "score", ["pos", "neg"], ["model"])
    ends = ranked.groupBy("model").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    gap = F.abs((F.col("pos_before") + F.col("pos")) / F.col("__p") - (F.col("neg_before") + F.col("neg")) / F.col("__n"))
    ks = ranked.join(ends, "model").where((F.col("__p") > 0) & (F.col("__n") > 0)).groupBy("model").agg(F.max(gap).alias("ks"))
    return plain.join(auc_of_counts(known, "score", ["model"]), "model", "left").join(ks, "model", "left")


def merged_psi(bins: DataFrame, is_baseline: Column, n_bins: dict[str, int]) -> DataFrame:
    """(feature, base_rows, current_rows, psi) of the baseline days against the others; NULL where one side has no rows."""
    counts = bins.where(F.col("bucket").isNotNull()).groupBy("feature", "bucket").agg(
        F.sum(F.when(is_baseline, F.col("n"))).alias("e"), F.sum(F.when(~is_baseline, F.col("n"))).alias("a"))
    grid = bins.sparkSession.createDataFrame([(f, b) for f, n in n_bins.items() for b in range(n)], "feature string, bucket int")
    dense = F.broadcast(grid).join(counts, ["feature", "bucket"], "left").na.fill(0, ["e", "a"])  # one row per feature and bin
    size = dense.groupBy("feature").agg(F.sum("e").alias("base_rows"), F.sum("a").alias("current_rows"))
    ep, ap = (F.greatest(F.col(x) / F.col(t), F.lit(C.PSI_EPS)) for x, t in (("e", "base_rows"), ("a", "current_rows")))
    both = (F.col("base_rows") > 0) & (F.col("current_rows") > 0)
    return (dense.join(size, "feature").groupBy("feature", "base_rows", "current_rows")
            .agg(F.sum(F.when(both, (ap - ep) * F.log(ap / ep))).alias("psi")))


def merged_deltas(deltas: DataFrame) -> DataFrame:
    """One row: rows both models scored, mean and mean absolute difference, share over the limit."""
    s = deltas.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("delta_sum").cast("double").alias("d"),
                   F.sum("abs_sum").cast("double").alias("a"), F.sum("over").alias("o"))
    n = F.nullif(F.col("n"), F.lit(0))
    return s.select(F.col("n").alias("compared_rows"), (F.col("d") / n).alias("mean_delta"), (F.col("a") / n).alias("mean_abs_delta"),
                    (F.col("o") / n).alias("share_over_limit"))
