"""Model quality measures.

Every measure is a grouped aggregate, so "overall", "per split" and "per
segment" are the same code with different ``group_cols``.  Threshold sweeps
are one pass: rows are bucketed on the fixed 46-point grid and suffix sums
over at most 47 buckets per group give every threshold at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebound import config as C
from rebound.operators.joins import join_on
from rebound.operators.ordered import exact_quantiles, kth_boundaries, prefix_sums, top_k_per_group


def _y(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(c.cast("boolean").cast("int"), F.lit(0))


# ---------------------------------------------------------------- W1
def temporal_split(df: DataFrame, ts_col: str = "timestamp", id_col: str = "transaction_id",
                   fractions: Sequence[float] = (0.70, 0.85),
                   names: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """70/15/15 split by position in (ts asc NULLS LAST, id) order.

    The two boundary rows are found by exact order statistics, then the split
    is a pure comparison per row: no shuffle, no single-task sort.
    """
    keyed = df.withColumn("__tnull", F.col(ts_col).isNull())
    _, bounds = kth_boundaries(keyed, ["__tnull", ts_col, id_col], fractions)
    key = F.struct(F.col("__tnull").alias("c0"), F.col(ts_col).alias("c1"), F.col(id_col).alias("c2"))
    ktype = keyed.select(key.alias("k")).schema["k"].dataType
    expr = None
    for b, name in zip(bounds, names[:-1]):
        if b is None:
            cond = F.lit(True)
        else:
            lit = F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(b)]).cast(ktype)
            cond = key < lit
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return keyed.withColumn("split", expr).drop("__tnull")


# ---------------------------------------------------------------- M1
def scored(score) -> Column:
    """The score as a double; NaN and infinities are missing like NULL."""
    c = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M1: AUC by midranks (ties share the average rank, T15) of the rows with a
    score; NULL when one class is absent."""
    y = _y(label)
    collapsed = (df.withColumn("__s", scored(score)).where(F.col("__s").isNotNull())
                 .groupBy(*group_cols, "__s")
                 .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))
    return auc_of_counts(collapsed, "__s", group_cols)


def auc_of_counts(collapsed: DataFrame, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AUC from (group, score, pos, neg) counts with a score in every row.

    AUC = sum over scores s of pos(s) * (neg(<s) + neg(s)/2) / (P * N), equal
    to (R+ - P(P+1)/2) / (P N); NULL when one class is absent.
    """
    group_cols = list(group_cols)
    pre = prefix_sums(collapsed, score, ["neg"], group_cols)
    u = pre.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).alias("__u"),
        F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return u.select(*group_cols, F.when((F.col("__p") > 0) & (F.col("__n") > 0),
                                        F.col("__u") / (F.col("__p") * F.col("__n"))).alias("auc"))


# ---------------------------------------------------------------- M2-M5
def metric_bundle(df: DataFrame, label: str, score: str, threshold=0.5,
                  group_cols: Sequence[str] = (), with_auc: bool = True) -> DataFrame:
    """M5: rows, positives, AUC, log loss, Brier, precision, recall, F1 and
    predicted-positive rate at a threshold, in one grouped pass (+ AUC).

    All are of the rows with a score; those without (NULL, NaN) are counted in
    ``unscored_rows``.  A group without scores has 0 rows and NULL averages."""
    df, group_cols, drop = _with_group(df, group_cols)
    df = df.withColumn("__score", scored(score))
    p = F.col("__score")
    has = p.isNotNull()
    y = F.when(has, _y(label))
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pc = F.least(F.greatest(p, F.lit(C.LOG_LOSS_EPS)), F.lit(1 - C.LOG_LOSS_EPS))
    pred = (p >= t).cast("int")
    agg = df.groupBy(*group_cols).agg(
        F.count_if(has).alias("rows"), F.count_if(~has).alias("unscored_rows"),
        F.coalesce(F.sum(y), F.lit(0)).cast("bigint").alias("positives"),
        F.avg(-(y * F.log(pc) + (F.lit(1) - y) * F.log(F.lit(1.0) - pc))).alias("log_loss"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
        F.avg(pred).alias("predicted_positive_rate"))
    out = agg.select(*group_cols, "rows", "positives", "log_loss", "brier", "tp", "fp", "fn",
                     *prf1(F.col("tp"), F.col("fp"), F.col("fn")), "predicted_positive_rate", "unscored_rows")
    if with_auc:
        out = join_on(out, auc(df, label, "__score", group_cols), group_cols, "left")
    return out.drop(*drop)


def prf1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """M4: precision, recall, F1; 0 when undefined."""
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return [prec.alias("precision"), rec.alias("recall"), f1.alias("f1")]


# ---------------------------------------------------------------- grid sweep
def grid_bucket(score, grid: Sequence[float] | None = None) -> Column:
    """Number of grid thresholds <= score (0..46): predicted positive at
    threshold j (0-based) iff bucket >= j + 1; 0 without a score."""
    grid = grid or C.threshold_grid()
    s = scored(score)
    b = F.lit(0)
    for g in grid:
        b = b + (s >= F.lit(g)).cast("int")
    return F.coalesce(b, F.lit(0))


def _grid_table(df: DataFrame, group_cols, sums: dict, score: str, grid) -> DataFrame:
    """Per group and grid threshold: suffix sums of ``sums`` over buckets."""
    group_cols = list(group_cols)
    b = grid_bucket(score, grid)
    per_bucket = df.groupBy(*group_cols, b.alias("bucket")).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()])
    # every (group, threshold) row must exist even when its bucket is empty:
    # each group explodes the fixed 46-point grid (no join of two tables)
    grid_arr = F.array(*[F.struct(F.lit(i + 1).alias("bucket"), F.lit(float(g)).alias("threshold"))
                         for i, g in enumerate(grid)])
    dense = (per_bucket.select(*group_cols).distinct()
             .select(*group_cols, F.explode(grid_arr).alias("__t"))
             .select(*group_cols, "__t.bucket", "__t.threshold"))
    zero = [F.lit(0).cast(per_bucket.schema[n].dataType).alias(n) for n in sums]
    full = (per_bucket.select(*group_cols, "bucket", F.lit(None).cast("double").alias("threshold"), *sums)
            .unionByName(dense.select(*group_cols, "bucket", "threshold", *zero))
            .groupBy(*group_cols, "bucket")
            .agg(F.max("threshold").alias("threshold"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]))
    w = (Window.partitionBy(*group_cols).orderBy(F.col("bucket").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    suffix = full.select(*group_cols, "bucket", "threshold",
                         *[F.sum(n).over(w).alias(n) for n in sums])
    return suffix.where(F.col("threshold").isNotNull())


def _with_group(df: DataFrame, group_cols):
    """Ungrouped measures run as one constant group, so results are joined
    on a key instead of a cross product."""
    group_cols = list(group_cols)
    if group_cols:
        return df, group_cols, []
    return df.withColumn("__all", F.lit(0)), ["__all"], ["__all"]


def threshold_sweep(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = (),
                    grid: Sequence[float] | None = None) -> DataFrame:
    """Confusion counts and F1 at each of the 46 thresholds (one pass), of the rows with a score."""
    grid = grid or C.threshold_grid()
    y = _y(label)
    df, group_cols, drop = _with_group(df.where(scored(score).isNotNull()), group_cols)
    t = _grid_table(df, group_cols, {"tp": y, "fp": F.lit(1) - y}, score, grid)
    tot = df.groupBy(*group_cols).agg(F.sum(y).alias("__pos"))
    t = join_on(t, tot, group_cols)
    t = t.withColumn("fn", F.col("__pos") - F.col("tp"))
    return t.select(*group_cols, "threshold", "tp", "fp", "fn",
                    *prf1(F.col("tp"), F.col("fp"), F.col("fn"))).drop(*drop)


def _first_best(df: DataFrame, group_cols, metric: str) -> DataFrame:
    """Strict '>' sweep in ascending threshold order: the lowest threshold wins ties."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(metric).desc(), F.col("threshold").asc())
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def best_f1_threshold(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M6: best-F1 threshold on the 0.05..0.50 grid, first wins ties."""
    sw = threshold_sweep(df, label, score, group_cols)
    return _first_best(sw, list(group_cols), "f1").select(
        *group_cols, F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))


def net_value_frontier(df: DataFrame, label: str, score: str, amount: str = "amount_usd",
                       group_cols: Sequence[str] = (), margin=C.DEFAULT_MARGIN_RATE,
                       retry_cost=C.DEFAULT_RETRY_COST_USD, friction=C.DEFAULT_FRICTION_COST_USD,
                       grid: Sequence[float] | None = None) -> DataFrame:
    """Retries, recoveries, wasted cost, friction and realised net value
    of the rule "retry iff p >= t and EV > 0" at every grid threshold; rows
    without a score are never retried."""
    from rebound.operators.decide import expected_value
    grid = grid or C.threshold_grid()
    y = _y(label)
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    ev_pos = expected_value(F.col(score), F.col(amount), margin, retry_cost, friction) > 0
    ind = F.when(ev_pos, F.lit(1)).otherwise(F.lit(0))
    sums = {
        "retry_count": ind,
        "recovered_count": ind * y,
        "gross_margin_recovered_usd": F.when(ev_pos & (y == 1), amt * F.lit(margin)).otherwise(F.lit(0.0)),
    }
    df, group_cols, drop = _with_group(df.where(scored(score).isNotNull()), group_cols)
    t = _grid_table(df, group_cols, sums, score, grid)
    return t.drop(*drop).select(
        *[g for g in group_cols if g not in drop], "threshold", F.col("retry_count").cast("bigint").alias("retry_count"),
        F.col("recovered_count").cast("bigint").alias("recovered_count"),
        "gross_margin_recovered_usd",
        ((F.col("retry_count") - F.col("recovered_count")) * F.lit(retry_cost)).alias("wasted_retry_cost_usd"),
        (F.col("retry_count") * F.lit(friction)).alias("friction_cost_usd"),
        (F.col("gross_margin_recovered_usd") - (F.col("retry_count") - F.col("recovered_count")) * F.lit(retry_cost)
         - F.col("retry_count") * F.lit(friction)).alias("realized_net_value_usd"))


def best_net_value_threshold(frontier: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The threshold with the highest realised net value (first wins ties)."""
    return _first_best(frontier, list(group_cols), "realized_net_value_usd").select(
        *group_cols, F.col("threshold").alias("best_threshold"),
        F.col("realized_net_value_usd").alias("best_net_value_usd"))


# ---------------------------------------------------------------- M7 / M8
def calibration_curve(df: DataFrame, label: str, score: str, buckets: int = 10) -> DataFrame:
    """M7: equal-frequency buckets from exact quantile edges with duplicates
    dropped; right-closed, lowest edge included (T10).  Also the bucket's
    weight, so M8 (expected calibration error) is a sum over this table."""
    from rebound.operators.ordered import group_counts
    counts = group_counts(df, score)
    n = counts.get((), 0)
    q_n = max(1, min(buckets, n))                 # fewer rows than buckets: one per row
    probs = [i / q_n for i in range(q_n + 1)]
    q = exact_quantiles(df, score, probs, counts=counts).get(()) if n else None
    spark = df.sparkSession
    if not q:
        return spark.createDataFrame([], "bucket int, lower double, upper double, rows bigint, "
                                         "mean_pred double, event_rate double")
    edges = sorted(set(q))
    y = _y(label)
    s = F.col(score)
    b = F.lit(None).cast("int")
    # bucket i covers (e_i, e_{i+1}], the first bucket also holds e_0
    for i in range(len(edges) - 1, 0, -1):
        cond = (s <= F.lit(edges[i])) & ((s > F.lit(edges[i - 1])) if i > 1 else (s >= F.lit(edges[0])))
        b = F.when(cond, F.lit(i - 1)).otherwise(b)
    agg = (df.where(s.isNotNull()).withColumn("bucket", b).where(F.col("bucket").isNotNull())
           .groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.avg(s).alias("mean_pred"),
                                  F.avg(y).alias("event_rate")))
    bounds = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
                                   "bucket int, lower double, upper double")
    return bounds.join(agg, "bucket", "left").select(
        "bucket", "lower", "upper", F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
        "mean_pred", "event_rate")


def expected_calibration_error(curve: DataFrame) -> DataFrame:
    """M8: sum of (rows / N) * |mean_pred - event_rate| over the buckets."""
    w = Window.partitionBy()
    return (curve.where(F.col("rows") > 0)
            .withColumn("__n", F.sum("rows").over(w))
            .agg(F.sum(F.col("rows") / F.col("__n") * F.abs(F.col("mean_pred") - F.col("event_rate")))
                 .alias("ece")))


# ---------------------------------------------------------------- G5
def segment_metrics(df: DataFrame, label: str, score: str, threshold=0.5,
                    specs: Sequence[tuple[str, int]] = tuple(C.SEGMENT_SPECS),
                    min_support: int = C.SEGMENT_MIN_SUPPORT) -> DataFrame:
    """Metrics for the top-N values of each segment column.

    The segment columns are unpivoted with ``stack`` so all of them go through
    one grouped pass; top-N is by row count, ties by value (T9); support is a
    filter on the grouped counts.
    """
    from rebound.functions.parse import missing_as
    n = len(specs)
    stack = "stack({}, {}) as (segment_column, segment_value)".format(
        n, ", ".join(f"'{c}', {c}" for c, _ in specs))
    long = df.select(label, score, *[missing_as(c).alias(c) for c, _ in specs]).selectExpr(
        label, score, stack)
    counts = (long.groupBy("segment_column", "segment_value").agg(F.count(F.lit(1)).alias("__rows"))
              .withColumn("__neg", -F.col("__rows")))
    limit = dict(specs)
    parts = top_k_per_group(counts, ["segment_column"], ["__neg", "segment_value"], lambda g: limit.get(g[0], 0))
    top = parts.where(F.col("__rows") >= min_support).select("segment_column", "segment_value")
    # top holds at most sum(N) rows per segment column: bounded broadcast
    kept = long.join(F.broadcast(top), ["segment_column", "segment_value"])
    m = metric_bundle(kept, label, score, threshold, ["segment_column", "segment_value"])
    return m.select("segment_column", "segment_value", "rows",
                    F.try_divide("positives", "rows").alias("positive_rate"),
                    "auc", "precision", "recall", "f1")


# ---------------------------------------------------------------- M9 deltas
DELTA_METRICS = ("auc", "log_loss", "brier", "precision", "recall", "f1")


def metric_deltas(df: DataFrame, label: str, before: str, after: str, threshold=0.5) -> DataFrame:
    """M9: (metric, before, after, delta) of two score columns over the same
    rows, e.g. raw and calibrated, or champion and challenger."""
    scores = F.explode(F.array(F.struct(F.lit("before").alias("which"), F.col(before).alias("p")),
                               F.struct(F.lit("after").alias("which"), F.col(after).alias("p"))))
    both = df.select(F.col(label), scores.alias("s")).select(label, "s.which", "s.p")
    m = metric_bundle(both, label, "p", threshold, ["which"])
    long = m.select("which", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v"))
                                                 for n in DELTA_METRICS])).alias("x")).select("which", "x.metric", "x.v")
    out = long.groupBy("metric").agg(F.max(F.when(F.col("which") == "before", F.col("v"))).alias("before"),
                                     F.max(F.when(F.col("which") == "after", F.col("v"))).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before"))
